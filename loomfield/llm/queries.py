"""Registered queries of this subpackage: thin views of the operators over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import oracles
from loomfield.llm.common import bounded_batches, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, and a session whose Arrow batches hold few enough whole texts."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfield.llm.decontamination import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), within=64)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        "n_near",
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table arrives in two batches, by a hash of the id; the second scans only what the first has not
    seen, and the report joins the findings to the paths of both."""
    from loomfield.llm.secrets import RULES, BlobLedger

    docs, ledger = table(spark, sf_dir, "documents"), BlobLedger(spark)
    for batch in (0, 1):
        ledger.scan(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == batch))
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = listed(F.filter("found", lambda x: x["rank"] < len(RULES)))
    found = ledger.report().withColumnRenamed("spans", "found")
    return found.select(
        F.col("id").alias("doc_id"), of("assign"), of("access"), of("hex"), F.sha2(base, 256).alias("base_sha256"), listed(F.col("found")).alias("spans")
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfield.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfield.llm.topk import exact_topk

    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def packing_digests(docs: DataFrame) -> DataFrame:
    """Packed pieces with a checksum in place of their ids."""
    from loomfield.llm.packing import placed, token_pieces

    pieces = token_pieces(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return placed(pieces).select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digests(table(spark, sf_dir, "documents"))


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no preferences: each conversation is preferred to the one with another's reply in it."""
    from loomfield.llm.chat import formatted, mask_runs, rendered, swapped_replies

    found = formatted(swapped_replies(table(spark, sf_dir, "conversations")))
    return found.select(
        "pair_id",
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        "prompt",
        rendered(F.col("chosen")).alias("chosen"),
        mask_runs(F.col("chosen")).alias("chosen_mask"),
        rendered(F.col("rejected")).alias("rejected"),
        mask_runs(F.col("rejected")).alias("rejected_mask"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfield.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfield.llm.sharding import shard_groups

    placed = shard_groups(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfield.llm.suffix_dedup import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfield.llm.language import fit, held_out, predict

    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def planted_periods(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with one text in ten made periodic from some word on, as the contract says; a null
    id counts as an empty one. Words are listed in a step of their own, so that they are found once."""
    listed = docs.select("doc_id", "text", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"))
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10).cast("long")
    rows = listed.withColumn("n", F.size("words")).withColumn("g", F.when((h % 10 == 0) & (F.col("n") > 0), g))
    rows = rows.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", 1, F.col("a")), F.slice(again, 1, rest)), " ")
    return rows.select("doc_id", F.when(F.col("g").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfield.llm.periods import periodic_runs

    found = periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    key = lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))
    best = F.array_min(F.transform("runs", key))
    rows = found.select("id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.array_join(lines, "").alias("lines"), "collapsed")
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_runs",
        F.col("b.start").alias("start"),
        (-F.col("b.less")).alias("length"),
        F.col("b.period").alias("period"),
        F.floor(1000 * -F.col("b.less") / F.col("b.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted_misspellings(runs: DataFrame) -> DataFrame:
    """runs(doc_id, word), about one in 97 without one of its letters, as the contract says; a null id counts
    as an empty one."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word"))
    at = (h % F.length("word")).cast("int")
    less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return runs.select(F.when(h % 97 == 0, less).otherwise(F.col("word")).alias("word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfield.llm.spelling import spelling_variants, word_counts, word_runs

    runs = word_runs(table(spark, sf_dir, "documents"), "doc_id")
    return spelling_variants(word_counts(planted_misspellings(runs)))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as an archive in the shared folder, and what is read back from it."""
    from loomfield.llm.warc import WarcSource, payload_sha1, with_revisits

    scheme = "urn:page:"
    number = lambda c: F.substring(c, len(scheme) + 1, 99).try_cast("long")
    records = table(spark, sf_dir, "pages").select(
        F.concat(F.lit(scheme), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.col("url").alias("uri"),
        F.lit(None).cast("string").alias("date"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
        "page_id",
    )
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    spark.dataSource.register(WarcSource)
    with_revisits(records, rank="page_id").write.format("warc").mode("append").save(folder)
    return spark.read.format("warc").load(folder).select(
        number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        payload_sha1().alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
