"""Embedding diagnostics and comparison of two scorings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomfield.functions.vectors import as_double, dot, norm, unit
from loomfield.operators.ranking import running_sums
from loomfield.operators.search import pair_scores
from loomfield.storage import stored


def finite_summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, extremes, 5th, 50th and 95th percentile, mean and population deviation of finite values."""
    x = F.col(value).cast("double")
    fine = rows.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = lambda p: F.expr(f"percentile(cast({value} as double), {p})")
    return fine.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.min(x).alias("min"), q(0.05).alias("p05"), q(0.5).alias("median"), q(0.95).alias("p95"),
        F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
    )


def mean_vectors(rows: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """(by..., n, mean): element-wise means. Each row gives its components as one row each, which the
    partial aggregate adds up before the shuffle."""
    long = rows.select(*by, F.posexplode(as_double(vector)).alias("k", "x"))
    parts = long.groupBy(*by, "k").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    grouped = parts.groupBy(*by).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "m"))).alias("p"))
    return grouped.select(*by, "n", F.transform("p", lambda p: p["m"]).alias("mean"))


def dispersion(rows: DataFrame, vector: str, by: list[str]) -> DataFrame:
    """(by..., n, dispersion): one minus the length of the mean unit vector."""
    units = rows.select(*by, unit(as_double(vector)).alias("u")).filter("u IS NOT NULL")
    return mean_vectors(units, "u", by).select(*by, "n", (1 - norm(F.col("mean"))).alias("dispersion"))


def centroid_cosines(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """(a, b, cosine) of the mean unit vectors of each two keys (whole numbers), a < b, scored in blocks."""
    means = mean_vectors(rows.select(key, unit(as_double(vector)).alias("u")).filter("u IS NOT NULL"), "u", [key])
    side = stored(means.select(F.col(key).cast("long").alias("id"), F.col("mean").alias("vector")), "means")
    found = pair_scores(side, side, digits=9).filter("query_id < template_id")
    kind = rows.schema[key].dataType
    return found.select(F.col("query_id").cast(kind).alias("a"), F.col("template_id").cast(kind).alias("b"), F.col("score").alias("cosine"))


def domain_shift(rows: DataFrame, vector: str, identity: str, domain: str) -> DataFrame:
    """(identity, pairs, shift): mean cosine distance of an identity's domain centroids, two by two."""
    means = mean_vectors(
        rows.select(identity, domain, unit(as_double(vector)).alias("u")).filter("u IS NOT NULL"), "u", [identity, domain]
    ).select(identity, domain, unit(F.col("mean")).alias("u"))
    other = means.select(identity, F.col(domain).alias("_d"), F.col("u").alias("v"))
    return (
        means.join(other, identity)
        .filter(F.col(domain) < F.col("_d"))
        .groupBy(identity)
        .agg(F.count("*").alias("pairs"), F.avg(1 - dot(F.col("u"), F.col("v"))).alias("shift"))
    )


def gram(rows: DataFrame, vector: str) -> DataFrame:
    """(i, j, cov): the population covariance of the components, i <= j. Each task adds up the matrix
    products of its batches and hands on as many sums as there are component pairs, whatever the table's
    size. Null vectors take no part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            lists = batch.column(0)
            if len(lists):
                at = lists.offsets.to_numpy()
                v = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].reshape(len(lists), -1)
                v = np.hstack([v, np.ones((len(v), 1))])
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

    v = rows.select(as_double(vector).alias("v")).filter("v IS NOT NULL")
    sums = stored(v.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")), "gram")
    last = sums.agg(F.max("j").alias("d"))
    whole = sums.join(F.broadcast(last), F.col("j") == F.col("d")).select(F.col("i").alias("_k"), F.col("s").alias("_s"), "d")
    n = F.broadcast(whole.filter("_k = d").select("d", F.col("_s").alias("n")))  # one row
    mean = lambda k: F.broadcast(whole.filter("_k < d").select(F.col("_k").alias(k), F.col("_s").alias(f"s_{k}")))  # noqa: E731  a row a component
    cells = sums.crossJoin(n).filter("j < d").join(mean("i"), "i").join(mean("j"), "j")
    return cells.select("i", "j", (F.col("s") / F.col("n") - F.col("s_i") / F.col("n") * (F.col("s_j") / F.col("n"))).alias("cov"))


def spectrum(rows: DataFrame, vector: str) -> list[tuple[int, float]]:
    """Eigenvalues of the covariance, largest first. The matrix is as wide as a vector is long."""
    cells = gram(rows, vector).collect()
    size = 1 + max((r.j for r in cells), default=-1)
    m = np.zeros((size, size))
    for r in cells:
        m[r.i, r.j] = m[r.j, r.i] = r.cov
    return list(enumerate(np.maximum(0.0, np.linalg.eigvalsh(m)[::-1]).tolist())) if size else []


def average_ranks(rows: DataFrame, value: str, out: str) -> DataFrame:
    """rows with the mid-rank of value: ties share the mean of their places. Ranks come from counts of
    the distinct values."""
    counts = rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    upto = running_sums(counts, [F.col("_v")], {"_upto": F.col("_c")})
    ranks = upto.select("_v", (F.col("_upto") - (F.col("_c") - 1) / 2).alias(out))
    return rows.join(ranks, F.col(value) == F.col("_v")).drop("_v")


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation; null if one side does not vary."""
    both = average_ranks(average_ranks(rows.select(a, b), a, "_ra"), b, "_rb")
    return both.agg(F.try_divide(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb")).alias("spearman"))


def hubness(neighbours: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """neighbours(item) counts how often each of items is among the nearest of another: skewness of
    the in-degree, part that never is, part of all links held by the top tenth, and concentration.
    All follow from the counts of items by degree, a short table."""
    linked = neighbours.groupBy(item).agg(F.count("*").alias("d"))
    counts = items.select(item).join(linked, item, "left").groupBy(F.coalesce("d", F.lit(0)).alias("d")).agg(F.count("*").alias("c"))
    whole = W.partitionBy(F.lit(0))
    n, links = F.sum("c").over(whole), F.sum(F.col("c") * F.col("d")).over(whole)
    above = F.coalesce(F.sum("c").over(W.orderBy(F.col("d").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = counts.withColumns({"n": n, "mu": links / n, "above": above})
    top = F.greatest(F.lit(0), F.least("c", F.ceil(F.col("n") * 0.1) - F.col("above")))
    m = lambda k: F.sum(F.col("c") * F.pow(F.col("d") - F.col("mu"), F.lit(k))) / F.sum("c")
    all_links = F.sum(F.col("c") * F.col("d"))
    return rows.agg(
        F.sum("c").alias("items"),
        F.when(m(2) > 0, m(3) / F.pow(m(2), F.lit(1.5))).alias("skewness"),
        (F.sum(F.when(F.col("d") == 0, F.col("c")).otherwise(0)) / F.sum("c")).alias("never"),
        F.try_divide(F.sum(top * F.col("d")), all_links).alias("top_tenth"),
        F.try_divide(F.sum(F.col("c") * F.col("d") * F.col("d")), all_links * all_links).alias("concentration"),
    )


def element_drift(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs(id, a, b) of vectors -> (id, max_abs, mean_abs, cosine)."""
    x, y = as_double(a), as_double(b)
    gap = F.zip_with(x, y, lambda p, q: F.abs(p - q))
    return pairs.select(
        "id",
        F.array_max(gap).alias("max_abs"),
        (F.aggregate(gap, F.lit(0.0), lambda s, g: s + g) / F.size(gap)).alias("mean_abs"),
        (dot(x, y) / (norm(x) * norm(y))).alias("cosine"),
    )


def drift_by(pairs: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """pairs(by, id, a, b) -> (by, max_abs, mean_abs, pairs): element drift of each scenario."""
    rows = pairs.select("id", by).join(element_drift(pairs, a, b), "id")
    return rows.groupBy(by).agg(F.max("max_abs").alias("max_abs"), F.avg("mean_abs").alias("mean_abs"), F.count("*").alias("pairs"))


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """Sections, tables of one row, as (section, metric, value)."""
    out = None
    for name, df in sections.items():
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in df.columns])).alias("x")
        part = df.select(F.lit(name).alias("section"), each).select("section", "x.*")
        out = part if out is None else out.union(part)
    return out


def rank_drift(scores: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """scores(query_id, slot, a, b): two scorings of the same candidates. Per query the largest score
    gap and rank displacement, whether the best differs, top-k members not shared, tied pairs and
    inversions (pairs that the two order differently)."""
    q = W.partitionBy("query_id")
    rows = scores.withColumn("ra", F.row_number().over(q.orderBy(F.col("a").desc(), "slot"))).withColumn(
        "rb", F.row_number().over(q.orderBy(F.col("b").desc(), "slot"))
    )
    apart = [F.count(F.when((F.col("ra") <= k) != (F.col("rb") <= k), 1)).alias(f"top_{k}_apart") for k in ks]
    base = rows.groupBy("query_id").agg(
        F.max(F.abs(F.col("a") - F.col("b"))).alias("max_score_gap"),
        F.max(F.abs(F.col("ra") - F.col("rb"))).alias("max_rank_gap"),
        F.count(F.when((F.col("ra") == 1) & (F.col("rb") != 1), 1)).alias("best_changed"),
        *apart,
    )
    ties = scores.groupBy("query_id", "a").agg(F.count("*").alias("c")).groupBy("query_id").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("long").alias("tied_pairs"))
    return base.join(ties, "query_id").join(inversions(rows.select("query_id", "ra", "rb")), "query_id")


def crossed(values: np.ndarray) -> np.ndarray:
    """For each of distinct values in order, how many larger ones come before it: bit by bit from the
    highest, values that agree so far are kept in order, and those with a zero count the ones before."""
    out, order = np.zeros(len(values), np.int64), np.arange(len(values))
    for bit in range(int(values.max(initial=0)).bit_length() - 1, -1, -1):
        own = values[order]
        one, above = (own >> bit) & 1, own >> (bit + 1)
        ones = np.cumsum(one)
        first = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
        base = np.repeat(ones[first] - one[first], np.diff(np.append(first, len(own))))
        out[order] += np.where(one == 0, ones - base, 0)
        order = order[np.lexsort((one, above))]
    return out


def inversions(ranks: DataFrame) -> DataFrame:
    """ranks(query_id, ra, rb), both from 1 -> (query_id, inversions): pairs that the two order differently.
    The candidates of a query meet in one task, in order; they are counted in n log n steps."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def solve(query: np.ndarray, rb: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
            number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(query))))
            n = np.bincount(number, crossed(number * (int(rb.max()) + 1) + rb)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(query[first]), pa.array(n)], names=["query_id", "inversions"])

        for batch in batches:
            query, rb = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            if held is not None:
                query, rb = np.concatenate([held[0], query]), np.concatenate([held[1], rb])
            if not len(query):
                continue
            done = int(np.flatnonzero(np.append(True, query[1:] != query[:-1]))[-1])
            if done:
                yield solve(query[:done], rb[:done])
            held = query[done:], rb[done:]
        if held is not None and len(held[0]):
            yield solve(*held)

    kind = ranks.schema["query_id"].dataType.simpleString()
    sorted_ = ranks.repartition("query_id").sortWithinPartitions("query_id", "ra").select("query_id", "rb")
    return sorted_.mapInArrow(run, f"query_id {kind}, inversions long")


def row_zscores(scores: DataFrame, floor: float = 1e-12) -> DataFrame:
    """scores(query_id, template_id, score) with z: standardised within the query; 0 if it hardly varies."""
    q = W.partitionBy("query_id")
    sd = F.stddev_pop("score").over(q)
    return scores.withColumn("z", F.when(sd > floor, (F.col("score") - F.avg("score").over(q)) / sd).otherwise(0.0))


def state_changes(before: DataFrame, after: DataFrame, key: str, state: str) -> DataFrame:
    """Counts by (was, now): states of keys on both sides; MISSING on the side that lacks the key."""
    a, b = before.select(key, F.col(state).alias("was")), after.select(key, F.col(state).alias("now"))
    both = a.join(b, key, "full_outer")
    return both.groupBy(F.coalesce("was", F.lit("MISSING")).alias("was"), F.coalesce("now", F.lit("MISSING")).alias("now")).agg(F.count("*").alias("n"))


def weighted_mean_vector(rows: DataFrame, vector: str, weight: str, by: list[str]) -> DataFrame:
    """(by..., mean): unit vectors averaged by weight, scaled to length one."""
    long = rows.select(*by, F.col(weight).alias("w"), F.posexplode(unit(as_double(vector))).alias("k", "x"))
    parts = long.groupBy(*by, "k").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    grouped = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("p"))
    return grouped.select(*by, unit(F.transform("p", lambda p: p["m"])).alias("mean"))
