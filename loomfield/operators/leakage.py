"""Leakage between roles, association of identities with domains, and gates. Gates return the rows
that break a rule, never a bare yes or no."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.operators.ranking import beside


def association(rows: DataFrame, episode: list[str], identity: str, domain: str) -> DataFrame:
    """Mutual information of identity and domain, one vote for each (episode, identity): events,
    identities, domains, nats, normalised by the root of the entropies (null if one is zero), and
    how often a majority guess of one from the other is right."""
    votes = rows.select(*episode, F.col(identity).alias("i"), F.col(domain).alias("d")).distinct()
    pair = votes.groupBy("i", "d").agg(F.count("*").alias("n"))
    one, two = pair.groupBy("i").agg(F.sum("n").alias("ni"), F.max("n").alias("mi")), pair.groupBy("d").agg(F.sum("n").alias("nd"), F.max("n").alias("md"))
    total = pair.agg(F.sum("n").alias("t"))
    joined = pair.join(one, "i").join(two, "d").crossJoin(F.broadcast(total))  # total is one row
    info = joined.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("ni") * F.col("nd")))).alias("mutual_information"))
    entropy = lambda c: -F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))
    of_i = one.crossJoin(F.broadcast(total)).agg(
        F.count("*").alias("identities"), F.max("t").alias("events"), entropy("ni").alias("hi"), (F.max("ni") / F.max("t")).alias("global_majority"),
        (F.sum("mi") / F.max("t")).alias("identity_concentration"),
    )
    of_d = two.crossJoin(F.broadcast(total)).agg(F.count("*").alias("domains"), entropy("nd").alias("hd"), (F.sum("md") / F.max("t")).alias("domain_majority"))
    out = info.crossJoin(of_i).crossJoin(of_d)  # one row each
    nmi = F.when((F.col("hi") > 1e-12) & (F.col("hd") > 1e-12), F.col("mutual_information") / F.sqrt(F.col("hi") * F.col("hd")))
    return out.select(
        "events", "identities", "domains", "mutual_information", nmi.alias("nmi"), "domain_majority", "global_majority", "identity_concentration"
    )


def tokens(rows: DataFrame, kinds: list[str], extra: list[str] | None = None) -> DataFrame:
    """Columns as (kind, token) rows, nulls left out."""
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("token")) for k in kinds])
    return rows.select(*(extra or []), F.explode(parts).alias("x")).select(*(extra or []), "x.kind", "x.token").filter("token IS NOT NULL")


def role_overlaps(rows: DataFrame, kinds: list[str], role: str = "role") -> DataFrame:
    """(kind, token, roles): tokens in more than one role."""
    return (
        tokens(rows, kinds, [role])
        .groupBy("kind", "token")
        .agg(F.array_join(F.array_sort(F.collect_set(role)), ",").alias("roles"), F.count_distinct(role).alias("n"))
        .filter("n > 1")
        .drop("n")
    )


def shared_values(a: DataFrame, b: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, token) that two sides have in common."""
    return tokens(a, kinds).intersect(tokens(b, kinds))


def reversed_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (left, right) of a that b has, in either order."""
    key = lambda df: df.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()
    return key(a).join(key(b), ["left", "right"], "left_semi")


def too_early(gallery: DataFrame, queries: DataFrame, identity: str, start: str, end: str, gap: float) -> DataFrame:
    """Queries that start less than gap after their identity's last gallery end (times as numbers)."""
    last = gallery.groupBy(identity).agg(F.max(end).alias("last_end"))
    return queries.join(last, identity).filter(F.col(start) - F.col("last_end") < gap)


def open_set_breaches(gallery: DataFrame, known: DataFrame, unknown: DataFrame, identity: str) -> DataFrame:
    """(identity, rule): known queries without gallery, unknown queries with one."""
    have = gallery.select(identity).distinct()
    none = known.select(identity).distinct().join(have, identity, "left_anti").withColumn("rule", F.lit("KNOWN_WITHOUT_GALLERY"))
    some = unknown.select(identity).distinct().join(have, identity, "left_semi").withColumn("rule", F.lit("UNKNOWN_WITH_GALLERY"))
    return none.union(some)


def unchanged(gallery: DataFrame, queries: DataFrame, identity: str, signature: Column) -> DataFrame:
    """Identities of both sides for which no pair differs in signature: each has one, the same."""
    one = lambda df, n: df.groupBy(identity).agg(F.min(signature).alias(f"lo_{n}"), F.max(signature).alias(f"hi_{n}"))
    both = one(gallery, "g").join(one(queries, "q"), identity)
    return both.filter("lo_g = hi_g AND lo_q = hi_q AND lo_g = lo_q").select(identity)


def stage_regressions(history: DataFrame, candidate: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """candidate(stage, keys) whose key was once in a later stage of order: (kind, token, was, now)."""
    rank = F.create_map(*[x for k, s in enumerate(order) for x in (F.lit(s), F.lit(k))])
    was = tokens(history.withColumn("_r", rank[F.col("stage")]), keys, ["_r", "stage"]).groupBy("kind", "token").agg(F.max("_r").alias("was"))
    now = tokens(candidate.withColumn("_r", rank[F.col("stage")]), keys, ["_r"]).groupBy("kind", "token").agg(F.min("_r").alias("now"))
    return now.join(was, ["kind", "token"]).filter("was > now")


def limit_breaches(summary: DataFrame, limits: dict[str, float]) -> DataFrame:
    """summary (one row) as (code, value, limit) of the columns beyond their limits."""
    each = F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).cast("double").alias("value"), F.lit(float(x)).alias("limit")) for c, x in limits.items()])
    return summary.select(F.explode(each).alias("x")).select("x.*").filter("value > limit")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, repeats counted, with the side they are on; empty if the two are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def chunk_breaks(chunks: DataFrame) -> DataFrame:
    """chunks(lineage, start, end) whose start is not the end of the chunk before (0 at first)."""
    paired = beside(chunks, ["lineage"], [F.col("start"), F.col("end")], -1, {"expected": "end"})
    return paired.withColumn("expected", F.coalesce("expected", F.lit(0))).filter("start <> expected")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
