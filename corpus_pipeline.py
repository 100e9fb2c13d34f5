"""The corpus pipeline: language ID, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns
of documents. Decisions of the stages depend on a row's text, so rows that are equal are decided alike;
near-duplicates also depend on its id, and of equal rows one stays. An empty table gives an empty one.
Extra columns are kept as they are, whatever their names. Stages hold the session's Arrow batches to
rows that fit (common.bounded_batches).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.common import bounded_batches, fresh, has_repeats, materialize, shared_dir
from loomfield.llm.decontamination import contamination
from loomfield.llm.language import fit, tagged
from loomfield.llm.queries import packing_digests
from loomfield.llm.secrets import BlobLedger, redacted
from loomfield.llm.simhash import simhash_groups
from loomfield.operators.ranking import salted_join


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that the model knows go: those without a letter (null and empty texts among
    them), or with less support by the words of training texts than texts in their languages have. Mixtures
    of known languages stay. Where no row is labelled no language is known, and all with a letter stay."""
    bounded_batches(spark)
    model = fit(docs, support=True)
    if not model.labels:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    language, score, support = fresh(docs, "language", "score", "support")
    found = tagged(docs, model, added=(language, score, support))
    return found.filter((F.col(language) != "und") & (F.col(support) >= model.least_support)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the least id stays, one without an id only where none has
    one. Texts that are null or have no word are one group. Where ids are null or repeat, rows are told apart
    by a stored number of their own; of rows with the group's least id the one of the least number stays."""
    bounded_batches(spark)
    (first, row) = fresh(docs, "first", "row")
    if not has_repeats(docs, "doc_id"):
        least = simhash_groups(docs).filter("doc_id = component_id").select(F.col("doc_id").alias(first))
        return docs.join(least, F.col("doc_id") == F.col(first), "left_semi")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = simhash_groups(rows.select(row, "text"), id_col=row).select(row, "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", row)
    least = groups.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(order)[row].alias(first))
    return rows.join(least, F.col(row) == F.col(first), "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; null and empty texts are never contaminated."""
    bounded_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    (bad,) = fresh(docs, "bad")
    found = contamination(docs.select(F.sha2("text", 256).alias("digest"), "text"), benchmark, id_col="digest")
    hit = found.filter("contaminated").select(F.col("digest").alias(bad)).distinct()
    return docs.join(hit, F.sha2("text", 256) == F.col(bad), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows; no document goes, and null texts stay null."""
    blob, spans = fresh(docs, "blob", "spans")
    found = BlobLedger(spark).scan(docs).filter(F.size("spans") > 0)
    marks = found.select(F.col("blob").alias(blob), F.col("spans").alias(spans)).dropDuplicates([blob])
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col(spans)))
    # Copies of one text, and null texts, may be most rows. Hashed, not sorted: whole texts are not held for a sort.
    keyed = docs.withColumn(blob, F.sha2("text", 256))
    joined = salted_join(keyed, marks.hint("shuffle_hash"), [blob], [blob, "doc_id"], "left").withColumn("text", text)
    return joined.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token pieces with their places in sequences; a null text is an empty one, and every row
    is packed, whether it repeats or has no id."""
    bounded_batches(spark)
    return packing_digests(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: The language model and the packing have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
