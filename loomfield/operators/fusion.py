"""Simplex weights of channels fitted out of fold, and one calibrator a channel.

A weight vector is judged on every row at once with all others of a grid: batches give, for each fold, class
and grid point, sums of weighted squared errors. A fold's weights are chosen on all other rows, whose sums
are the whole table's less the fold's own, so all folds are fitted in one pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.operators.metrics import fused, interpolated, isotonic, simplex_grid
from loomfield.storage import stored


def _usable(scores: Column, available: Column | None) -> Column:
    """By channel: it has a score and is said to be available."""
    there = F.transform(scores, lambda s: s.isNotNull())
    return there if available is None else F.zip_with(there, available, lambda a, b: a & F.coalesce(b, F.lit(False)))


def _optional(rows: DataFrame, name: str) -> Column | None:
    return F.col(name) if name in rows.columns else None


def oof_weights(
    rows: DataFrame, channels: int, resolution: int = 20, l2: float = 0.0, prior: list[float] | None = None, floor: float = 0.0,
    balanced: bool = False,
) -> DataFrame:
    """rows(fold, scores, label, and if there: available, quality, weight) -> (fold, weights, loss, brier, rows):
    for each fold the grid point with the least loss on the rows of all other folds, and under a null fold
    that of all rows. The loss is the weighted mean squared error of the fused score (brier; balanced: the
    mean of those of the two classes) plus l2 times the squared distance from prior (uniform by default); ties go
    to the smaller distance, then to the first in order of weights.

    A channel without a score or not available has no weight in a row; quality counts as floor at least. Rows
    without a channel left, a label or a fold take no part; a grid point that leaves some other row without
    weight is not chosen. Scores must be in [0, 1], weights positive, and each of two folds or more have both
    classes."""
    grid = np.array(simplex_grid(channels, resolution))
    center = np.full(channels, 1 / channels) if prior is None else np.asarray(prior, float)
    if len(center) != channels or (center <= 0).any() or abs(center.sum() - 1) > 1e-12:
        raise ValueError("the prior must be positive weights of all channels that sum to one")
    distance = ((grid - center) ** 2).sum(axis=1)
    usable, quality, weight = _usable(F.col("scores"), _optional(rows, "available")), _optional(rows, "quality"), _optional(rows, "weight")
    at = lambda c, k: F.element_at(c, k + 1)
    share = lambda k: F.lit(1.0) if quality is None else F.greatest(F.coalesce(at(quality, k), F.lit(0.0)), F.lit(floor)).cast("double")
    prepared = rows.filter("fold IS NOT NULL AND label IS NOT NULL").select(
        F.col("fold").cast("long").alias("fold"),
        F.col("label").cast("int").alias("label"),
        (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"),
        *[F.coalesce(at(F.col("scores"), k).cast("double"), F.lit(0.0)).alias(f"s{k}") for k in range(channels)],
        *[F.when(at(usable, k), share(k)).otherwise(0.0).alias(f"e{k}") for k in range(channels)],
    )

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            fold, label, w = column[:3]
            s, e = np.stack(column[3 : 3 + channels], axis=1), np.stack(column[3 + channels :], axis=1)
            live = e.sum(axis=1) > 0
            fold, label, w, s, e = fold[live], label[live], w[live], s[live], e[live]
            if not (((s >= 0) & (s <= 1)).all() and (w > 0).all() and np.isin(label, (0, 1)).all()):
                raise ValueError("scores must be in [0, 1], weights positive and labels 0 or 1")
            if not len(s):
                continue
            total = e @ grid.T
            error = np.divide((s * e) @ grid.T, total, out=np.zeros_like(total), where=total > 0) - label[:, None]
            keys, own = np.unique(np.stack([fold, label], axis=1), axis=0, return_inverse=True)
            member = np.arange(len(keys))[:, None] == own.ravel()[None, :]
            sse, lost = (member * w) @ (error * error), member @ (total <= 0).astype(np.int64)
            n = len(grid)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(keys[:, 0], n)), pa.array(np.repeat(keys[:, 1], n).astype(np.int32)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(keys))),
                    pa.array(sse.ravel()), pa.array(np.repeat(member @ w, n)), pa.array(np.repeat(member.sum(axis=1), n)), pa.array(lost.ravel()),
                ],
                names=["fold", "label", "g", "sse", "w", "n", "lost"],
            )

    sums = ["sse", "w", "n", "lost"]
    parts = prepared.mapInArrow(judged, "fold long, label int, g int, sse double, w double, n long, lost long")
    parts = stored(parts.groupBy("fold", "label", "g").agg(*[F.sum(c).alias(c) for c in sums]), "fold-sums")
    kinds = parts.select("fold", "label").distinct().groupBy("fold").agg(F.count("*").alias("n")).collect()  # a row a fold
    if len(kinds) < 2 or any(r["n"] != 2 for r in kinds):
        raise ValueError("out-of-fold fitting takes two folds or more, each with rows of both classes")
    whole = parts.groupBy("label", "g").agg(*[F.sum(c).alias(f"all_{c}") for c in sums])
    rest = parts.join(whole, ["label", "g"]).select("fold", "label", "g", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in sums])
    rest = rest.union(whole.select(F.lit(None).cast("long"), "label", "g", *[f"all_{c}" for c in sums]))
    brier = F.avg(F.col("sse") / F.col("w")) if balanced else F.sum("sse") / F.sum("w")
    points = F.array(*[F.array(*map(F.lit, p)) for p in grid.tolist()])
    away = F.element_at(F.array(*map(F.lit, distance.tolist())), F.col("g") + 1)
    loss = rest.groupBy("fold", "g").agg(brier.alias("brier"), F.sum("n").alias("rows"), F.sum("lost").alias("lost")).filter("lost = 0")
    told = F.struct(F.round(F.col("brier") + l2 * away, 9).alias("loss"), F.round(away, 12).alias("away"), F.element_at(points, F.col("g") + 1).alias("weights"), "brier", "rows")
    best = loss.groupBy("fold").agg(F.min(told).alias("b"))
    return best.select("fold", "b.weights", "b.loss", "b.brier", "b.rows")


def oof_scores(rows: DataFrame, weights: DataFrame, floor: float = 0.0) -> DataFrame:
    """rows(fold, scores, and if there: available, quality) with fused: the score by the weights of the row's
    fold, which were fitted without it. Null where no channel with weight is left, or no fold is."""
    usable = _usable(F.col("scores"), _optional(rows, "available"))
    named = weights.filter("fold IS NOT NULL").select(F.col("fold").alias("_fold"), F.col("weights").alias("_weights"))
    joined = rows.join(named, F.col("fold") == F.col("_fold"), "left")
    quality = _optional(rows, "quality")
    return joined.withColumn("fused", fused(F.col("scores"), F.col("_weights"), usable, quality, floor)).drop("_fold", "_weights")


def channel_calibrators(rows: DataFrame) -> DataFrame:
    """rows(channel, score, label) -> (channel, kx, ky): the knots of one isotonic calibrator for each channel, as
    metrics.interpolated() takes them. Channels are a handful; each is fitted by MLlib over its own rows, and
    its knots are the model's. Null scores and labels take no part; a channel without both classes, and a
    score that is not finite, are errors."""
    spark = rows.sparkSession
    live = rows.filter("score IS NOT NULL AND label IS NOT NULL AND channel IS NOT NULL")
    odd = F.count(F.when(F.isnan(F.col("score").cast("double")) | (F.abs(F.col("score").cast("double")) == float("inf")), 1))
    told = live.groupBy("channel").agg(F.count_distinct("label").alias("kinds"), odd.alias("odd")).collect()
    if bad := [r["channel"] for r in told if r["kinds"] != 2 or r["odd"]]:
        raise ValueError(f"channels without both classes, or with scores that are not finite: {bad}")
    kind = rows.schema["channel"].dataType.simpleString()
    out = spark.createDataFrame([], f"channel {kind}, kx double, ky double")
    for name in sorted(r["channel"] for r in told):
        model = isotonic(live.filter(F.col("channel") == F.lit(name)))
        knots = [(name, float(x), float(y)) for x, y in zip(model.boundaries, model.predictions, strict=True)]
        out = out.union(spark.createDataFrame(knots, f"channel {kind}, kx double, ky double"))
    return out


def calibrated(rows: DataFrame, knots: DataFrame) -> DataFrame:
    """rows(channel, x, ...) with y, the calibrated score; rows of a channel without a calibrator are absent."""
    return interpolated(rows, knots.dropDuplicates(["channel", "kx"]))
