"""Metrics over requests: totals, latency histograms, sliding windows, decaying averages, merges over nodes, alert expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the time-to-first-byte histogram.
TTFB_BOUNDS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def api_stats(requests: DataFrame, *keys: str) -> DataFrame:
    """Totals by key from (status): 499 is canceled and no error."""
    s = F.col("status")
    return requests.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(s == 499).alias("canceled"), F.count_if((s >= 400) & (s != 499)).alias("errors"),
        F.count_if((s >= 400) & (s < 500) & (s != 499)).alias("errors_4xx"), F.count_if(s >= 500).alias("errors_5xx"),
    )


def ttfb_histogram(requests: DataFrame, api: str = "api", seconds: str = "ttfb") -> DataFrame:
    """(api, le, n): requests of each bin, zero bins included; the last bound is infinite."""
    bounds = [*TTFB_BOUNDS, float("inf")]
    counts = F.array(*[F.count_if((F.col(seconds) <= hi) & (F.col(seconds) > lo)) for lo, hi in zip([float("-inf"), *TTFB_BOUNDS], bounds, strict=True)])
    wide = requests.groupBy(api).agg(counts.alias("ns"))
    return wide.select(api, F.posexplode("ns").alias("bin", "n")).select(api, F.get(F.array(*map(F.lit, bounds)), F.col("bin")).alias("le"), "n")


def cumulative(histogram: DataFrame, api: str = "api") -> DataFrame:
    """The histogram as it is exported: each bound with all requests up to it."""
    return histogram.select(api, "le", F.sum("n").over(Window.partitionBy(api).orderBy("le").rowsBetween(Window.unboundedPreceding, 0)).alias("n"))


def last_window(samples: DataFrame, by: str, seconds: int = 60) -> DataFrame:
    """samples (ts, by, x) with the sum and mean of x over the last ``seconds`` one-second slots, the own one included.

    A slot's samples are added up before the slots of a key are put in order, so a key's order is as long as its time and not as its samples.
    """
    slotted = samples.withColumn("_slot", F.unix_seconds(F.col("ts").cast("timestamp")))
    slots = slotted.groupBy(by, "_slot").agg(F.sum("x").alias("_x"), F.count("x").alias("_n"))
    at = Window.partitionBy(by).orderBy("_slot").rangeBetween(-(seconds - 1), 0)
    sums = slots.select(by, "_slot", F.sum("_x").over(at).alias("sum"), (F.sum("_x").over(at) / F.sum("_n").over(at)).alias("avg"))
    return slotted.join(sums, [by, "_slot"]).drop("_slot")


def last_hour(failures: DataFrame, by: str) -> DataFrame:
    """(minute, by, n, last_hour): failures of each minute and of the 60 minutes up to it."""
    minutes = failures.groupBy(F.date_trunc("minute", "ts").alias("minute"), by).agg(F.count("*").alias("n"))
    at = Window.partitionBy(by).orderBy((F.unix_seconds(F.col("minute").cast("timestamp")) / 60).cast("bigint")).rangeBetween(-59, 0)
    return minutes.withColumn("last_hour", F.sum("n").over(at))


def _decayed(samples: DataFrame, by: str, keep: float, *more: Column) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("seq"))
    ranked = samples.withColumn("_back", F.row_number().over(order) - 1)
    n = F.count("*").over(Window.partitionBy(by))
    weight = F.pow(F.lit(keep), F.col("_back")) * F.when(F.col("_back") == n - 1, 1.0).otherwise(1 - keep)
    return ranked.withColumn("_w", weight).groupBy(by).agg(F.sum(F.col("x") * F.col("_w")).alias("ewma"), F.count("*").alias("n"), F.max("x").alias("peak"), *more)


def decaying(samples: DataFrame, by: str, keep: float = 0.9) -> DataFrame:
    """(by, ewma, n, peak): avg = keep * avg + (1 - keep) * x in order of time, beginning with the first x.

    The average is a weighted sum: sample i of n has the weight (1 - keep) * keep^(n - i), the first keep^(n - 1). So it
    comes from a rank and a sum, without a list of a key's samples.
    """
    return _decayed(samples, by, keep)


def queue_stats(samples: DataFrame, by: str, keep: float = 0.9) -> DataFrame:
    """(by, ewma, n, peak, mean) of a queue's samples (ts, seq, x): the decaying average beside the plain one."""
    return _decayed(samples, by, keep, F.avg("x").alias("mean"))


def merge_nodes(metrics: DataFrame) -> DataFrame:
    """Realtime metrics (host, metric, n, peak, at) of all nodes, by host and in total (host NULL)."""
    return metrics.rollup("metric", "host").agg(F.sum("n").alias("n"), F.max("peak").alias("peak"), F.max("at").alias("at")).filter("metric IS NOT NULL")


def increase(series: DataFrame, by: str, seconds: int) -> DataFrame:
    """series (ts, by, value) of a counter with its increase over the last ``seconds``; a fall is a restart from zero."""
    return over_time(series, by, seconds).select(*series.columns, "increase")


def over_time(series: DataFrame, by: str, seconds: int) -> DataFrame:
    """series (ts, by, value) with what alert rules ask of the last ``seconds``: increase and rate (a second) of a counter, delta and max_over_time of a gauge.

    delta is the value less the first of the window. Samples of one instant are in order of their values.

    Time is cut into blocks as long as a window, so a window is the beginning of its sample's block and the end of the block before. Both are
    running aggregates: the end is read off by a second row of each sample, a probe, that lies in the block before, where the window begins.
    So the work doesn't grow with what a window holds, and a task has blocks of a key and not the whole key.
    """
    ts = F.col("ts").cast("timestamp")
    rows = _stepped(series.withColumns({"_s": F.unix_seconds(ts), "_t": F.unix_micros(ts), "_block": F.floor(F.unix_seconds(ts) / seconds)}), by)
    block = Window.partitionBy(by, "_block")
    so_far = block.orderBy(F.asc_nulls_last("_s")).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_first", F.first("value").over(_in_order(by).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"_sum": F.sum("_step").over(so_far), "_max": F.max("value").over(so_far)})

    probe = F.col("_probe")
    both = rows.withColumn("_probe", F.explode(F.array(F.lit(False), F.lit(True)))).filter(probe | F.col("_s").isNotNull())
    carried = [F.when(probe, F.col(x)).alias(x) for x in [*series.columns, "_first", "_sum", "_max"] if x not in (by, "value")]
    back = probe.cast("bigint")
    places = [(F.col(x) - back * n).alias(x) for x, n in (("_block", 1), ("_s", seconds), ("_t", seconds * 1_000_000))]
    both = both.select(by, "value", *carried, "_probe", F.when(~probe, F.col("_step")).alias("_step"), *places)
    exact, whole = [block.orderBy(*map(F.desc, keys)).rangeBetween(Window.unboundedPreceding, 0) for keys in (("_s", "_t"), ("_s",))]
    both = both.withColumn("_first_before", F.min(F.when(~probe, F.struct("_t", "value"))).over(exact))
    both = both.withColumns({"_sum_before": F.sum("_step").over(whole), "_max_before": F.max(F.when(~probe, F.col("value"))).over(whole)})

    total = F.col("_sum") + F.coalesce("_sum_before", F.lit(0))
    first = F.when(F.col("_first_before").isNull(), F.col("_first")).otherwise(F.col("_first_before")["value"])
    return both.filter(probe).select(
        *series.columns, total.alias("increase"), (total / seconds).alias("rate"), (F.col("value") - first).alias("delta"), F.greatest("_max", "_max_before").alias("max_over_time")
    )


def _in_order(by: str) -> Window:
    """A block's samples, those without a time last; the seconds stand before so that one sort serves all windows."""
    return Window.partitionBy(by, "_block").orderBy(F.asc_nulls_last("_s"), F.asc_nulls_last("_t"), "value")


def _stepped(rows: DataFrame, by: str) -> DataFrame:
    """rows (by, _block, _s, _t, value) with _step, the growth since the sample before; each block begins with a copy of the last sample before it, which goes again."""
    lasts = rows.groupBy(by, "_block").agg(F.max(F.struct("_s", "_t", "value")).alias("_last"))
    following = F.lead(F.struct("_block")).over(Window.partitionBy(by).orderBy(F.asc_nulls_last("_block")))
    copies = lasts.withColumn("_next", following).filter("_next IS NOT NULL").select(by, "_next._block", "_last.*", F.lit(True).alias("_copy"))
    step = F.col("value") - F.lag("value").over(_in_order(by))
    both = rows.withColumn("_copy", F.lit(False)).unionByName(copies, allowMissingColumns=True)
    return both.withColumn("_step", F.when(step < 0, F.col("value")).otherwise(F.coalesce(step, F.lit(0)))).filter("NOT _copy").drop("_copy")


def predict_linear(series: DataFrame, by: str, ahead: int) -> DataFrame:
    """(by, predicted): the least-squares line through (ts, value), ``ahead`` seconds after the last sample."""
    t = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    based = series.withColumn("_t", t - F.min(t).over(Window.partitionBy(by)))
    fit = based.groupBy(by).agg(F.regr_slope("value", "_t").alias("k"), F.regr_intercept("value", "_t").alias("b"), F.max("_t").alias("last"))
    return fit.select(by, (F.col("b") + F.col("k") * (F.col("last") + ahead)).alias("predicted"))


def exposition(metrics: DataFrame) -> DataFrame:
    """(line): families of (name, help, type, labels map, value) in the text exposition format, sorted by name and labels."""
    pair = lambda k, v: F.concat(k, F.lit('="'), F.regexp_replace(F.regexp_replace(v, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    entries = F.array_sort(F.map_entries("labels"))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: pair(e["key"], e["value"])), ","), F.lit("}"))).otherwise("")
    lines = metrics.select("name", F.lit(2).alias("place"), F.concat(F.col("name"), labels, F.lit(" "), F.col("value").cast("string")).alias("line"))
    heads = metrics.select("name", "help", "type").distinct()
    helps = heads.select("name", F.lit(0).alias("place"), F.concat(F.lit("# HELP "), "name", F.lit(" "), "help").alias("line"))
    types = heads.select("name", F.lit(1).alias("place"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "type").alias("line"))
    return helps.unionByName(types).unionByName(lines).orderBy("name", "place", "line").select("line")


