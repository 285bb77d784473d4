"""Readers of the object formats: CSV, JSON, Parquet, compressed objects, byte ranges, archives and audit segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.sources.objects import read_objects


def read_csv(spark: SparkSession, path: str, header: str = "USE", sep: str = ",", record: str = "\n", quote: str = '"', escape: str = '"', comment: str = "#", lazy: bool = False) -> DataFrame:
    """All columns are text. header: USE takes the names from it; IGNORE and NONE give _1, _2, ...; rows that are short have NULLs.

    Record ends of one or two characters are the CSV reader's own; longer ones are split off as text first. ``lazy`` reads
    quoted line breaks and keeps quotes inside a field.
    """
    if len(record) > 2:
        lines = spark.read.option("lineSep", record).text(path)
        return from_lines(lines, header, sep, quote, escape)
    reader = spark.read.option("header", header != "NONE").option("inferSchema", False).option("sep", sep).option("quote", quote).option("escape", escape)
    reader = reader.option("multiLine", lazy).option("mode", "PERMISSIVE").option("enforceSchema", False)
    if comment:
        reader = reader.option("comment", comment)
    if not lazy and record != "\n":
        reader = reader.option("lineSep", record)
    df = reader.csv(path)
    return df if header == "USE" else df.toDF(*[f"_{i}" for i in range(1, len(df.columns) + 1)])


def from_lines(lines: DataFrame, header: str, sep: str, quote: str, escape: str) -> DataFrame:
    """CSV records that are rows of text, as the text reader gives them; the first gives the number of fields and, for USE, their names.

    Unless ``header`` is NONE the first record of every file is left out, by its place and not by what it says.
    """
    first = lines.select("value").first()
    if first is None:
        return lines.sparkSession.createDataFrame([], T.StructType([]))
    options = {"sep": sep, "quote": quote, "escape": escape}
    one = lines.sparkSession.range(1)
    n = one.select(F.schema_of_csv(F.lit(first[0]), options).alias("s")).first()[0].count(": ")
    schema = ", ".join(f"_{i} string" for i in range(1, n + 1))
    names = list(one.select(F.from_csv(F.lit(first[0]), schema, options).alias("r")).first()[0]) if header == "USE" else [f"_{i}" for i in range(1, n + 1)]
    if header != "NONE":
        placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
        heads = placed.groupBy("file").agg(F.min(F.when(F.col("block") == 0, F.col("place"))).alias("place"))
        lines = placed.join(heads, ["file", "place"], "left_anti")
    return lines.select(F.from_csv("value", schema, options).alias("r")).select("r.*").toDF(*names)


def invalid_text(spark: SparkSession, path: str, block: int = 128 << 10) -> DataFrame:
    """(path, valid): whether the first block of each object is UTF-8; no more than that is read."""
    return read_objects(spark, path, "check", block=block)


def read_json(spark: SparkSession, path: str, document: bool = False, separated: bool = False, most: int = 10 << 20) -> DataFrame:
    """(value, raw): a VARIANT for each JSON value, and its text.

    One value for each line, which splits large objects; or ``separated`` by any white space, several in a line or one over several
    lines, an object being one task's work; or a whole object as one ``document`` of up to ``most`` bytes.
    """
    if separated:
        text = read_objects(spark, path, "values", most=most).select("value")
    else:
        text = spark.read.option("wholetext", document).text(path).filter(F.trim("value") != "")
    if document:
        text = text.select(F.when(F.octet_length("value") > most, F.raise_error(F.lit("OverMaxRecordSize"))).otherwise(F.col("value")).alias("value"))
    return text.select(F.parse_json("value").alias("value"), F.col("value").alias("raw"))


def as_records(values: DataFrame) -> DataFrame:
    """Values that aren't objects become records with the single field ``_1``."""
    is_object = F.schema_of_variant("value").startswith("OBJECT")
    return values.withColumn("value", F.when(is_object, F.col("value")).otherwise(F.parse_json(F.concat(F.lit('{"_1":'), F.to_json("value"), F.lit("}")))))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Top-level columns; leaves of nested groups read as NULL under dotted names."""
    df = spark.read.parquet(path)
    out: list[Column] = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += [F.lit(None).cast(g.dataType).alias(f"{f.name}.{g.name}") for g in f.dataType.fields]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


# --- compressed objects and archives -------------------------------------------------------------------------------


def read_compressed(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, error): the lines of gzip (any number of members), bzip2, zstd, lz4 or plain objects, read as streams.

    An object that ends early or is damaged gives a row with the error after the lines before it. An object is one task's
    work, as its stream can't be split.
    """
    return read_objects(spark, path, "lines")


def scan_range(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, piece: int = 64 << 20) -> DataFrame:
    """(line) of a plain byte slice: from start to end (inclusive), from start on, or the last ``end`` bytes. Only the slice is read.

    The slice cuts rows: a part of a first and last row comes as it is, with U+FFFD for what a cut leaves of a character. Slices of more
    than ``piece`` bytes are cut at line breaks into several tasks.
    """
    return read_objects(spark, path, "range", start=start, end=end, piece=piece).select("line")


def archive_members(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(path, member, size, content) of zip and tar archives (tar also compressed); members come one by one."""
    return read_objects(spark, path, "members", prefix=prefix)


def list_archive(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(path, member, size) of zip and tar archives; of a zip only the directory is read."""
    return read_objects(spark, path, "list", prefix=prefix)


def read_audit(spark: SparkSession, path: str, schema: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Audit segments of JSON lines in folders day=...; days outside the bounds are not opened."""
    df = spark.read.schema(f"{schema}, day date").json(path)
    if first:
        df = df.filter(F.col("day") >= F.lit(first).cast("date"))
    return df.filter(F.col("day") <= F.lit(last).cast("date")) if last else df
