"""Bootstrap intervals over whole clusters: of any per-row metrics, and of paired differences.

Clusters are numbered in order and drawn with replacement, as many as there are. A resample is never a
table: rows are summed by cluster first, clusters are packed into blocks, and a task turns the draws of a
block into multiplicities, one vector for each resample, and multiplies them with the block's sums. What
is shuffled is a row for each cluster (repeated for a few chunks of resamples while there are fewer blocks
than tasks) and a row of sums for each block and resample. All metrics, and both methods of a pair, share
the draws.

Draws come from SHA-256, alike on every engine. With one block, draw d of resample r is cluster
hash(seed|r|d) mod n. With more, these draws are first only counted by the block that they fall into, and
the draws of a block are then hash(seed|r|block|d) mod its size, which has the same distribution.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomfield.operators.ranking import numbered
from loomfield.storage import stored

BLOCK = 65_536


def hash_draw(seed: int, resample: Column, draw: Column, n: Column) -> Column:
    """A uniform cluster number in [0, n) from SHA-256, alike on every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), resample.cast("string"), draw.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long"), n)


def _drawn(text: str, draws: int, n: int) -> np.ndarray:
    """How often each of n is drawn."""
    number = [int(hashlib.sha256(f"{text}|{d}".encode()).hexdigest()[:12], 16) % n for d in range(draws)]
    return np.bincount(np.array(number, np.int64), minlength=n)


def resampled(sums: DataFrame, cluster: str, columns: list[str], resamples: int, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(r, columns): sums of each column over the clusters of resample r. sums has a row for each cluster."""
    spark = sums.sparkSession
    placed = numbered(sums.select(cluster, *columns), [F.col(cluster)], "_k")
    n = placed.count()
    blocks = max(1, -(-n // block))
    chunks = max(1, min(resamples, -(-4 * spark.sparkContext.defaultParallelism // blocks)))
    if blocks == 1:
        counts = spark.range(resamples).select(F.lit(0).cast("long").alias("b"), F.col("id").alias("r"), F.lit(n).cast("long").alias("draws"))
    else:
        each = spark.range(resamples * n).select(F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("d"))
        at = F.floor(hash_draw(seed, F.col("r"), F.col("d"), F.lit(n)) / block)
        counts = each.groupBy(at.alias("b"), "r").agg(F.count("*").alias("draws"))
    own = placed.withColumn("b", F.floor((F.col("_k") - 1) / block)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = counts.withColumn("chunk", (F.col("r") % chunks).cast("int"))

    def drawn(key: tuple, clusters: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        values = clusters.sort_values("_k")[columns].to_numpy(np.float64)
        out = np.zeros((len(counts), len(columns)))
        for i, (r, draws) in enumerate(zip(counts["r"].tolist(), counts["draws"].tolist(), strict=True)):
            text = f"{seed}|{r}" if blocks == 1 else f"{seed}|{r}|{key[0]}"
            out[i] = _drawn(text, draws, len(values)) @ values
        return pd.DataFrame({"r": counts["r"].astype(np.int64)} | {c: out[:, j] for j, c in enumerate(columns)})

    shape = "r long, " + ", ".join(f"`{c}` double" for c in columns)
    parts = own.groupBy("b", "chunk").cogroup(asked.groupBy("b", "chunk")).applyInPandas(drawn, shape)
    return parts.groupBy("r").agg(*[F.sum(c).alias(c) for c in columns])


def percentile_bounds(values: DataFrame, by: list[str], value: str, confidence: float, interpolate: bool) -> DataFrame:
    """(by, lo, hi) of resamples' values: order statistics ceil(q * n), or interpolated quantiles. Nulls are left
    out. A row for each resample and group is all there is."""
    tail, rows = (1 - confidence) / 2, values.filter(F.col(value).isNotNull())
    if interpolate:
        return rows.groupBy(*by).agg(F.expr(f"percentile({value}, {tail})").alias("lo"), F.expr(f"percentile({value}, {1 - tail})").alias("hi"))
    placed = rows.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(value))).withColumn("_n", F.count("*").over(W.partitionBy(*by)))
    at = lambda q: F.min(F.when(F.col("_i") >= F.greatest(F.lit(1), F.ceil(F.round(F.lit(q) * F.col("_n"), 9))), F.col(value)))
    return placed.groupBy(*by).agg(at(tail).alias("lo"), at(1 - tail).alias("hi"))


def bootstrap_intervals(
    rows: DataFrame, cluster: str, values: list[str], resamples: int = 200, confidence: float = 0.95, seed: int = 7,
    interpolate: bool = False, block: int = BLOCK,
) -> DataFrame:
    """rows(cluster, values) -> (metric, estimate, lo, hi, rows, clusters): for each column of values its mean
    over rows and an interval of it over resamples of whole clusters. A null value takes no part in its
    metric (a query without relevant templates has no rank); a null cluster, a value that is not finite, and
    fewer than two clusters are errors."""
    number = lambda v: F.col(v).cast("double")
    odd = [F.count(F.when(F.isnan(number(v)) | (F.abs(number(v)) == float("inf")), 1)).alias(f"o{k}") for k, v in enumerate(values)]
    # Stored: read several times, and rows may be dear.
    sums = rows.groupBy(cluster).agg(
        F.count("*").alias("_rows"),
        *odd,
        *[F.coalesce(F.sum(number(v)), F.lit(0.0)).alias(f"s{k}") for k, v in enumerate(values)],
        *[F.count(v).cast("double").alias(f"n{k}") for k, v in enumerate(values)],
    )
    sums = stored(sums, "clusters")
    unnamed, *infinite = sums.agg(F.coalesce(F.sum(F.when(F.col(cluster).isNull(), F.col("_rows"))), F.lit(0)), *[F.coalesce(F.sum(f"o{k}"), F.lit(0)) for k in range(len(values))]).first()
    if unnamed or any(infinite):
        raise ValueError(f"{unnamed} rows without a cluster, values that are not finite: {dict(zip(values, infinite, strict=True))}")
    clusters = sums.count()
    if clusters < 2:
        raise ValueError("resampling clusters takes at least two of them")
    columns = [f"{c}{k}" for c in "sn" for k in range(len(values))]
    long = F.explode(
        F.array(*[F.struct(F.lit(v).alias("metric"), F.try_divide(f"s{k}", f"n{k}").alias("v"), F.col(f"n{k}").cast("long").alias("rows")) for k, v in enumerate(values)])
    ).alias("m")
    bounds = percentile_bounds(resampled(sums, cluster, columns, resamples, seed, block).select(long).select("m.*"), ["metric"], "v", confidence, interpolate)
    whole = sums.agg(*[F.sum(c).alias(c) for c in columns]).select(long).select("m.metric", F.col("m.v").alias("estimate"), "m.rows")
    return whole.join(bounds, "metric", "left").withColumn("clusters", F.lit(clusters).cast("long"))


def paired_intervals(
    left: DataFrame, right: DataFrame, key: str, cluster: str, values: list[str], resamples: int = 1000, confidence: float = 0.95,
    seed: int = 7, interpolate: bool = True, block: int = BLOCK,
) -> DataFrame:
    """left and right(key, cluster, values) -> bootstrap_intervals() of left minus right, key by key. Both must
    have the same keys, each once, in the same clusters; a null on either side leaves the key out of
    that metric."""
    sided = lambda df, side: df.select(F.col(key).alias("key"), F.col(cluster).alias("cluster"), *[F.col(v).cast("double").alias(v) for v in values], F.lit(side).alias("_side"))
    of = lambda side, c: F.max(F.when(F.col("_side") == side, F.col(c)))
    count = lambda side: F.count(F.when(F.col("_side") == side, 1))
    both = sided(left, 1).union(sided(right, -1)).groupBy("key").agg(
        (count(1) != 1).alias("_l"), (count(-1) != 1).alias("_r"), F.min("cluster").alias("cluster"),
        (F.min("cluster") != F.max("cluster")).alias("_apart"), *[(of(1, v) - of(-1, v)).alias(v) for v in values],
    )
    both = stored(both, "paired")  # read more than once, and either side may be dear
    wrong = lambda c: F.count(F.when(F.col(c), 1))
    found = both.agg(wrong("_l"), wrong("_r"), wrong("_apart")).first()
    if any(found):
        raise ValueError("keys that are not once on the left: {}, on the right: {}, in two clusters: {}".format(*found))
    return bootstrap_intervals(both.select("cluster", *values), "cluster", values, resamples, confidence, seed, interpolate, block)


def cluster_bootstrap(clusters: DataFrame, resamples: int = 200, confidence: float = 0.95, seed: int = 7, interpolate: bool = False) -> DataFrame:
    """clusters(cluster, events, trials): estimate, lo, hi of the rate over resamples of whole clusters."""
    rates = resampled(clusters, "cluster", ["events", "trials"], resamples, seed).select(F.lit(1).alias("g"), (F.col("events") / F.col("trials")).alias("rate"))
    bounds = percentile_bounds(rates, ["g"], "rate", confidence, interpolate).drop("g")
    return clusters.agg((F.sum("events") / F.sum("trials")).alias("estimate")).crossJoin(bounds)  # one row each
