"""Checks of caches, records, pairs and documents. Each returns the rows that break a rule, with the
rule's name, never a bare yes or no."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions.vectors import norm
from loomfield.operators.ranking import beside


def broken(rows: DataFrame, keep: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keep..., rule) for every row and every rule whose condition holds (null: it does not)."""
    each = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select(*keep, F.explode(each).alias("rule"))


def cache_breaches(manifest: DataFrame, stored: DataFrame, tolerance: float) -> DataFrame:
    """manifest(token, size, digest) against stored(token, size, digest, vector): MISSING and UNLISTED
    entries, SIZE and DIGEST that differ, vectors that are not of length one (NOT_UNIT)."""
    held = stored.select("token", F.col("size").alias("_size"), F.col("digest").alias("_digest"), norm(F.col("vector")).alias("_norm"), F.lit(True).alias("_held"))
    both = manifest.select("token", "size", "digest", F.lit(True).alias("_listed")).join(held, "token", "full_outer")
    listed, there = F.col("_listed").isNotNull(), F.col("_held").isNotNull()
    rules = {
        "MISSING": ~there,
        "UNLISTED": ~listed,
        "SIZE": listed & there & (F.col("size") != F.col("_size")),
        "DIGEST": listed & there & (F.col("digest") != F.col("_digest")),
        "NOT_UNIT": there & (F.abs(F.col("_norm") - 1) > tolerance),
    }
    return broken(both, ["token"], rules)


def pack_breaches(manifest: DataFrame, total: int) -> DataFrame:
    """manifest(token, offset, size) of one packed file of total bytes: slices that do not begin where the
    one before ends (GAP, the first one at 0), and the last one if it does not end the file (SHORT)."""
    one = manifest.withColumn("_pack", F.lit(0)).withColumn("_end", F.col("offset") + F.col("size"))
    before = beside(one, ["_pack"], [F.col("offset"), F.col("token")], -1, {"_before": "_end"})
    placed = beside(before, ["_pack"], [F.col("offset"), F.col("token")], 1, {"_after": "offset"})
    rules = {"GAP": F.col("offset") != F.coalesce("_before", F.lit(0)), "SHORT": F.col("_after").isNull() & (F.col("_end") != total)}
    return broken(placed, ["token"], rules)


def pair_breaches(requests: DataFrame, truth: DataFrame, most: int) -> DataFrame:
    """requests(pair_id, query) and truth(pair_id, query_session, reference_session, same, stratum, other):
    REPEATED ids, ids of one side only (UNMATCHED), pairs within a SESSION, positives of two identities and
    negatives of one (LABEL); queries with over `most` pairs (CAP) or one negative identity in two strata
    (REUSED), told by the query's least pair."""
    repeated = requests.groupBy("pair_id").count().filter("count > 1").select("pair_id", F.lit("REPEATED").alias("rule"))
    ids, known = requests.select("pair_id").distinct(), truth.select("pair_id").distinct()
    unmatched = ids.exceptAll(known).union(known.exceptAll(ids)).withColumn("rule", F.lit("UNMATCHED"))
    positive = F.col("stratum") == "POSITIVE"
    rows = requests.join(truth, "pair_id")
    own = broken(rows, ["pair_id"], {"SESSION": F.col("query_session") == F.col("reference_session"), "LABEL": positive != F.col("same")})
    per = rows.groupBy("query").agg(
        F.min("pair_id").alias("pair_id"), F.count("*").alias("n"), F.count(F.when(~positive, F.col("other"))).alias("negatives"),
        F.count_distinct(F.when(~positive, F.col("other"))).alias("others"),
    )
    of_query = broken(per, ["pair_id"], {"CAP": F.col("n") > most, "REUSED": F.col("negatives") > F.col("others")})
    return reduce(DataFrame.union, [repeated, unmatched, own, of_query])


def record_breaches(records: DataFrame, key: str, capture: str, binding: list[str]) -> DataFrame:
    """(kind, token, rows): keys that repeat (KEY), and captures whose rows differ in their binding columns
    (CAPTURE)."""
    keys = records.groupBy(F.col(key).cast("string").alias("token")).agg(F.count("*").alias("rows")).filter("rows > 1")
    bound = records.groupBy(F.col(capture).cast("string").alias("token")).agg(F.count("*").alias("rows"), F.count_distinct(F.struct(*binding)).alias("n")).filter("n > 1")
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "token", "rows")
    return named(keys, "KEY").union(named(bound, "CAPTURE"))


def binding_breaches(claims: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """claims(key, digest) against payloads(key, payload): rows whose payload is missing (MISSING) or has
    another SHA-256 (DIGEST)."""
    rows = claims.join(payloads.select(key, F.col("payload").cast("string").alias("_p"), F.lit(True).alias("_there")), key, "left")
    return broken(rows, [key], {"MISSING": F.col("_there").isNull(), "DIGEST": F.sha2("_p", 256) != F.col("digest")})


def report_breaches(report: DataFrame) -> DataFrame:
    """report(metric, value, denominator, note) -> (metric, rule): REPEATED metrics, values without a count
    (EMPTY), missing values without a note (SILENT), noted ones that have a value (NOTED), and values that
    are not finite (NOT_FINITE)."""
    n = report.groupBy("metric").agg(F.count("*").alias("_n"))
    value, note = F.col("value"), F.col("note")
    rules = {
        "REPEATED": F.col("_n") > 1,
        "EMPTY": value.isNotNull() & (F.coalesce("denominator", F.lit(0)) <= 0),
        "SILENT": value.isNull() & note.isNull(),
        "NOTED": value.isNotNull() & note.isNotNull(),
        "NOT_FINITE": F.isnan(value) | (F.abs(value) == float("inf")),
    }
    return broken(report.join(n, "metric"), ["metric"], rules).distinct()


class _Refused(ValueError):
    pass


def _strict(text: str | None, most_bytes: int, most_depth: int, most_nodes: int) -> str | None:
    """The first rule that a JSON text breaks: MISSING, BYTES, REPEATED_KEY, NOT_JSON, NUMBER, DEPTH, NODES."""

    def once(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise _Refused("REPEATED_KEY")
        return dict(pairs)

    def number(_: str):
        raise _Refused("NUMBER")

    if text is None:
        return "MISSING"
    if len(text.encode()) > most_bytes:
        return "BYTES"
    try:
        level = [json.loads(text, object_pairs_hook=once, parse_constant=number)]
    except _Refused as e:
        return str(e)
    except (ValueError, RecursionError):
        return "NOT_JSON"
    nodes, depth = 0, 0
    while level:
        nodes, depth = nodes + len(level), depth + 1
        if depth > most_depth:
            return "DEPTH"
        if nodes > most_nodes:
            return "NODES"
        level = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
    return None


def strict_documents(rows: DataFrame, column: str, most_bytes: int = 1 << 20, most_depth: int = 32, most_nodes: int = 100_000) -> DataFrame:
    """rows with `rule`, the first rule that the JSON text in a column breaks, or null; and its SHA-256."""
    names = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = pa.array([_strict(x.as_py(), most_bytes, most_depth, most_nodes) for x in batch.column(names.index(column))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, told], names=[*names, "rule"])

    return rows.mapInArrow(run, rows.withColumn("rule", F.lit(None).cast("string")).schema).withColumn("sha256", F.sha2(column, 256))
