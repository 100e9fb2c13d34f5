"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every text is addressed by the SHA-256 of its content. The ledger remembers which
(blob, rule, rule version) has been scanned, and which paths held which blobs; a scan runs only the pairs
it has not seen, once for a blob however many paths hold it. Findings are joined back to the paths of
one scan, or, in report(), to those of all scans.

The ledger is four append-only Parquet tables. A batch writes its paths, its findings, its scanned
pairs and last its name; of a batch without a name nothing is read, so a scan that dies is simply
scanned again.

Nulls, empties: a null text is the empty blob, which has no findings. Null ids are kept; repeated
rows are returned each. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomfield.llm.common import materialize, shared_dir
from loomfield.operators.ranking import salted_join


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern whose group has `least` characters or more.
    A changed rule needs a new version."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Runs of hex digits, and of what may follow AKIA, are maximal: asking for their length in the
#: pattern finds the same matches as dropping the short ones later. A short value after an
#: assignment may hide another keyword, so its length is asked afterwards.
RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)

#: More kinds, whose spans come beside those of RULES.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("vendor", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35,}|sk_live_[0-9a-zA-Z]{24,})"),
    Rule("url", r"(?:https?|ftps?|ssh|git|mysql|postgres(?:ql)?|mongodb|redis|amqps?)://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@"),
)
ALL_RULES = RULES + MORE_RULES

_BATCHES = T.StructType([T.StructField("batch", T.StringType())])
_SCANS = T.StructType([T.StructField(c, T.StringType()) for c in ("batch", "blob", "rule")])
_FINDINGS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("batch", "blob", "rule", "kind")]
    + [T.StructField(c, T.LongType()) for c in ("start", "end")]
)


def _found(rule: Rule, matches: Column) -> Column:
    """Of each match: characters since the last one, its length, and that of its group."""
    lengths = lambda c: F.transform(c, lambda x: F.length(x))
    whole = lambda group: F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(group))
    parts = F.arrays_zip(
        lengths(F.split("text", rule.pattern, -1)).alias("gap"),
        lengths(matches).alias("size"),
        lengths(whole(rule.group) if rule.group else matches).alias("kept"),
    )
    tagged = F.transform(
        parts,
        lambda x: F.struct(
            F.lit(rule.key).alias("rule"),
            F.lit(rule.kind).alias("kind"),
            (x["kept"] >= rule.least).alias("ok"),
            x["gap"].alias("gap"),
            x["size"].alias("size"),
        ),
    )
    return F.when(F.size(matches) > 0, tagged)


def scan_texts(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, kind, start, end) for blobs(blob, text, todo): todo lists the rules to run. Rows of
    one blob are alike and count once."""
    todo = lambda r: F.array_contains("todo", r.key)
    hits = blobs.select(
        "blob",
        "text",
        *[
            F.when(todo(r), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias(f"m{k}")
            for k, r in enumerate(rules)
        ],
    )
    each = F.flatten(F.array_compact(F.array(*[_found(r, F.col(f"m{k}")) for k, r in enumerate(rules)])))
    # The outer form keeps the optimizer from testing the matches, and so finding them, twice.
    rows = hits.select("blob", F.posexplode_outer(each).alias("n", "f")).select("blob", "n", "f.*").filter("size IS NOT NULL")
    # A blob that came in several rows has each match as often; ends are sums over one row a match.
    rows = rows.dropDuplicates(["blob", "rule", "n"])
    end = F.sum((F.col("gap") + F.col("size")).cast("long")).over(
        W.partitionBy("blob", "rule").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        rows.withColumn("end", end)
        .filter("ok")
        .select("blob", "rule", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    )


class BlobLedger:
    """A ledger in a folder that all executors see; made on the first scan."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _finished(self, name: str, schema: T.StructType) -> DataFrame:
        """Rows of a table whose batch has run to its end."""
        return self._read(name, schema).join(self._read("batches", _BATCHES), "batch", "left_semi").drop("batch")

    def scans(self) -> DataFrame:
        return self._finished("scans", _SCANS)

    def findings(self) -> DataFrame:
        return self._finished("findings", _FINDINGS)

    def scan(
        self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = ALL_RULES
    ) -> DataFrame:
        """(id, blob, spans) for every row of versions: spans(start, rank, kind, end) of all rules,
        sorted by start, then by the order of rules; code points, end exclusive."""
        texts = versions.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn(
            "blob", F.sha2("text", 256)
        )
        batch = uuid.uuid4().hex
        named = F.lit(batch).alias("batch")
        form = T.StructType([T.StructField("batch", T.StringType()), T.StructField("id", versions.schema[id_col].dataType), T.StructField("blob", T.StringType())])
        texts.select(named, "id", "blob").write.mode("append").parquet(f"{self.path}/paths")
        paths = self._read("paths", form).filter(F.col("batch") == batch).drop("batch")
        blobs = paths.groupBy("blob").agg(F.min("id").alias("id"))
        done = self.scans().join(paths.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.collect_set("rule").alias("done"))
        every = F.array(*[F.lit(r.key) for r in rules])
        todo = (
            blobs.join(done, "blob", "left")
            .select("blob", "id", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))).alias("todo"))
            .filter(F.size("todo") > 0)
        )
        todo = materialize(todo, "unseen")
        if todo.take(1):
            one = todo.withColumnRenamed("id", "at").withColumnRenamed("blob", "want").hint("shuffle_hash")
            unseen = texts.join(one, (F.col("blob") == F.col("want")) & F.col("id").eqNullSafe(F.col("at")))
            found = scan_texts(unseen.select("blob", "text", "todo"), rules)
            found.select(named, *_FINDINGS.names[1:]).write.mode("append").parquet(f"{self.path}/findings")
            todo.select(named, "blob", F.explode("todo").alias("rule")).write.mode("append").parquet(f"{self.path}/scans")
        self.spark.range(1).select(named).write.mode("append").parquet(f"{self.path}/batches")
        return self._told(paths, rules)

    def _told(self, paths: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        rank = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.key), F.lit(k))])
        known = (
            self.findings()
            .join(paths.select("blob"), "blob", "left_semi")
            .withColumn("rank", rank[F.col("rule")])
            .filter("rank IS NOT NULL")
            .groupBy("blob")
            .agg(F.array_sort(F.collect_set(F.struct("start", "rank", "kind", "end"))).alias("spans"))
        )
        none = F.array().cast("array<struct<start: bigint, rank: int, kind: string, end: bigint>>")
        # Copies of one blob may hold most paths, and findings have just been grouped by blob.
        return salted_join(paths, known, ["blob"], ["id"], "left").select("id", "blob", F.coalesce("spans", none).alias("spans"))

    def report(self, rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
        """What scan() gives, for the paths of all finished scans. Ids must have had one type."""
        paths = self.spark.read.parquet(f"{self.path}/paths").join(self._read("batches", _BATCHES), "batch", "left_semi")
        return self._told(paths.drop("batch"), rules)


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every stretch that spans cover, overlapping ones together, replaced by mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        fresh = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(fresh.alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)
