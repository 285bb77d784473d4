"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Edges are long pairs; loops, repeats and rows with a null end are ignored. Each round is two shuffles of the
    edges, and the number of rounds is logarithmic in the longest chain. Only the number of edges and a checksum
    reach the driver. Minima are kept by partial aggregates, so a hot node makes no large group. Every round is
    written to the shared folder, so a lost executor costs that round alone. If the edges still change after ``max_rounds``, it is an error.
    """
    now = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col("u") > F.col("v"))
        .distinct()
    )
    now, seen = written(now, "edges"), None
    for _ in range(max_rounds):
        now = written(_small_star(_large_star(now)), "edges")
        sign = now.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
        if (sign["n"], sign["s"]) == seen:
            break
        seen = (sign["n"], sign["s"])
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter(F.col("v") > F.col("u"))
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of those neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
