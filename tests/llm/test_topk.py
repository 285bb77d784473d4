import math
import random

from tidewater.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=5, every=50):
    seen = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        seen[i] = min(seen.get(i, q), q)
    out = []
    for i, v in seen.items():
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in seen.items() if j != i and len(w) == len(v))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, group=8192):
    import numpy as np

    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    vectors = topk.quantised(spark.createDataFrame(rows, SCHEMA))
    got = topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), group=group)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect()), plain(rows)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) * (1 if i % 3 else 4) for _ in range(24)]) for i in range(700)]
    rows += [(1000 + i, rows[50][1]) for i in range(12)]  # ties
    got, want = run(spark, rows, group=100)
    assert got == want


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0])]
    rows += [(250, [1.0]), (1, [1.0, -1.0]), (1, [1.0, -1.0]), (2, []), (300, []), (None, [1.0, 1.0]), (-50, [0.5, 0.5])]
    got, want = run(spark, rows)
    assert got == want
    assert run(spark, []) == ([], [])


def test_bounds_survive_large_values(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([1e5, 1.0, 0.01]) * rng.gauss(0, 1) for _ in range(40)]) for i in range(400)]
    got, want = run(spark, rows, group=100)
    assert got == want


def test_bounds_leave_values_unread(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * 0.7**j for j in range(64)]) for i in range(3000)]
    vectors = topk.quantised(spark.createDataFrame(rows, SCHEMA)).cache()
    queries = vectors.filter("vec_id % 50 = 0")
    read = topk.group_finds(vectors, queries, group=1000).groupBy("query_id").agg({"read": "max"}).toPandas()
    assert read["max(read)"].mean() < 0.5 * 1000 * 64
    assert vectors.unpersist()


def test_queries_do_not_pass_a_shuffle(spark):
    vectors = topk.quantised(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)], SCHEMA))
    plan = topk.group_finds(vectors, vectors.filter("vec_id % 50 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan and "explode" not in plan
