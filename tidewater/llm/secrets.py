"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

Every version of a text is addressed by its content (SHA-256). The ledger holds, for each blob, which rule versions
have scanned it and what they found. A scan takes the distinct blobs of its input, leaves out the (blob, rule version)
pairs that the ledger has, scans the rest, appends to the ledger, and joins the findings back to all paths. A
rule's version is a hash of its definition, so a changed rule is run anew over every blob and the others are not.

Copies of a blob meet in partial aggregates, and the join back to the paths carries no texts. A match's place is a running sum of
lengths over the blob's matches, which lie where the blob lies.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import fresh_path, if_small


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    ``inner``: the span is the group alone, which ends the match. ``holds``: what every match holds, so that texts without it aren't searched.
    """

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = True
    inner: bool = False
    holds: str = ""

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least, self.inner)).encode()).hexdigest()[:16]


#: In the order in which spans of one start are listed.
RULES = (
    Rule("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    Rule("hex", r"([0-9a-f]{24,})", 1, 24),
    Rule("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1, False),
    # Only where no such character stands before: a run of them is read once, however often it begins anew.
    Rule("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)", 1, 1, False, True, "eyJ"),
)

#: Blobs with findings whose addresses may be sent to every task.
BROADCAST = 200_000
FINDINGS = "array<struct<start:int,end:int,version:string>>"
LEDGER = f"blob string, versions array<string>, findings {FINDINGS}"
PIECES = "array<struct<rule:int,i:int,gap:int,match:int,core:int>>"


def _pieces(text: Column, place: int, rule: Rule) -> Column:
    """The lengths of a rule's matches, of what stands before each, and of their groups: leftmost matches, none overlapping."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("core"),
    )
    lengths = F.transform(
        F.filter(parts, lambda p: p["match"].isNotNull()),
        lambda p, i: F.struct(F.lit(place).alias("rule"), i.alias("i"), F.length(p["gap"]).alias("gap"), F.length(p["match"]).alias("match"), F.length(p["core"]).alias("core")),
    )
    there = text.contains(rule.holds) & text.rlike(rule.pattern) if rule.holds else text.rlike(rule.pattern)
    return F.when(there, lengths).otherwise(F.array().cast(PIECES))


def _scanned(unseen: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger's rows for ``unseen`` (blob, text, done), one row for each blob."""
    versions = F.array(*[F.lit(r.version) for r in rules])
    each = [F.when(F.array_contains("done", r.version), F.array().cast(PIECES)).otherwise(_pieces(F.col("text"), i, r)) for i, r in enumerate(rules)]
    rows = unseen.select("blob", F.array_except(versions, "done").alias("versions"), F.explode_outer(F.concat(*each)).alias("p")).select("blob", "versions", "p.*")
    before = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("match")).over(before).cast("int"))
    of_rule = lambda values: F.get(F.array(*map(F.lit, values)), F.col("rule"))
    start = F.col("end") - F.when(of_rule([r.inner for r in rules]), F.col("core")).otherwise(F.col("match"))
    finding = F.struct(start.alias("start"), F.col("end").alias("end"), of_rule([r.version for r in rules]).alias("version"))
    found = F.collect_list(F.when(F.col("core") >= of_rule([r.least for r in rules]), finding))
    return rows.groupBy("blob").agg(F.first("versions").alias("versions"), found.cast(FINDINGS).alias("findings"))


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_ledger(blobs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the unseen pairs of ``blobs`` (blob, text) and rules, append them to the ledger at ``path``, return it whole.

    The ledger has a row for each blob and scan: blob, versions (of the rules that were run), findings.
    """
    spark = blobs.sparkSession
    versions = F.array(*[F.lit(r.version) for r in rules])
    known = _ledger(spark, path)
    if known is not None:
        done = known.groupBy("blob").agg(F.flatten(F.collect_list("versions")).alias("done"))
        complete = done.filter(F.size(F.array_except(versions, "done")) == 0).select("blob")
        unseen = blobs.join(complete, "blob", "left_anti").dropDuplicates(["blob"]).join(done, "blob", "left")
        unseen = unseen.withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
    else:
        unseen = blobs.dropDuplicates(["blob"]).withColumn("done", F.array().cast("array<string>"))
    _scanned(unseen, rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def with_spans(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row of ``docs``: spans is an array of (start, kind, end), kind the rule's place.

    ``ledger`` is the path of the ledger, which need not exist yet.
    """
    paths = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    paths = paths.withColumn("blob", F.sha2(F.encode("text", "UTF-8"), 256))
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.version, i)])
    whole = update_ledger(paths.select("blob", "text"), ledger, rules).filter(F.size("findings") > 0)
    spans = F.transform("findings", lambda f: F.struct(f["start"].alias("start"), place[f["version"]].alias("kind"), f["end"].alias("end")))
    current = F.filter(spans, lambda s: s["kind"].isNotNull())
    by_blob = whole.select("blob", current.alias("spans")).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return paths.select("doc_id", "blob").join(by_blob, "blob", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def report(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    base_sha256 is over the spans of the three base kinds, spans has those of all. A null text counts as empty.
    Repeated rows and null ids keep their rows; other columns are not read; an empty table gives an empty result.
    Without ``ledger`` a new one is begun.
    """
    df = with_spans(docs, ledger or fresh_path(docs.sparkSession, "ledger"), rules, id_col, text_col)
    names = F.array(*[F.lit(r.kind) for r in rules])
    base = [i for i, r in enumerate(rules) if r.base]
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    of_kind = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long").alias(f"n_{rules[i].kind}")
    return df.select("doc_id", *map(of_kind, base), F.sha2(shown(of_base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def without_secrets(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text no rule finds a secret; columns stay as they are.

    Null and empty texts are clean; rows that repeat stay or go together; an empty table stays empty.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    blob = F.sha2(F.encode(text, "UTF-8"), 256)
    ledger = update_ledger(docs.select(blob.alias("blob"), text.alias("text")), fresh_path(docs.sparkSession, "ledger"))
    bad = if_small(ledger.filter(F.size("findings") > 0).select(F.col("blob").alias("bad_blob")), BROADCAST)
    return docs.join(bad, blob == bad["bad_blob"], "left_anti")
