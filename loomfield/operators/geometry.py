"""Boxes and keypoints: matching, suppression, detection quality, consensus. One image's boxes are a
short list, so greedy choices run per image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.operators.ranking import running_sums

BOX = ["x1", "y1", "x2", "y2"]


def _overlap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intersection areas and IoU of every box of a with every box of b."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(axis=2)
    area = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(axis=1)
    return both, both / np.maximum(area(a)[:, None] + area(b)[None, :] - both, 1e-6)


def matched(predicted: DataFrame, truth: DataFrame, threshold: float, by_confidence: bool = False) -> DataFrame:
    """predicted(image, id, box, confidence) and truth(image, id, box) -> (image, predicted, truth,
    iou), one to one. Pairs of at least threshold in order of IoU, ties by ids; or predictions in order
    of confidence, each taking the free target with the best IoU (ties: the least id)."""

    def taken(iou: np.ndarray) -> list[tuple[int, int]]:
        free, out = np.ones(iou.shape[1], bool), []
        if by_confidence:
            for i in range(len(iou)):
                j = int(np.where(free, iou[i], -1).argmax())
                if free[j] and iou[i, j] >= threshold:
                    free[j] = False
                    out.append((i, j))
        else:
            i, j = np.nonzero(iou >= threshold)
            left = np.ones(len(iou), bool)
            for k in np.lexsort((j, i, -iou[i, j])):
                if left[i[k]] and free[j[k]]:
                    left[i[k]] = free[j[k]] = False
                    out.append((i[k], j[k]))
        return out

    def pick(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["confidence", "id"], ascending=[False, True], ignore_index=True) if by_confidence else p.sort_values("id", ignore_index=True)
        t = t.sort_values("id", ignore_index=True)
        code = pd.factorize(np.concatenate([p.image.to_numpy(), t.image.to_numpy()]), use_na_sentinel=False)[0]
        images = np.arange(code.max(initial=-1) + 2)
        (rows, at), (targets, to) = ((o, np.searchsorted(c[o], images)) for c in (code[: len(p)], code[len(p) :]) for o in [np.argsort(c, kind="stable")])
        box, other = p[BOX].to_numpy(float)[rows], t[BOX].to_numpy(float)[targets]
        out: list[tuple] = []
        for g in np.flatnonzero((np.diff(at) > 0) & (np.diff(to) > 0)):
            iou = _overlap(box[at[g] : at[g + 1]], other[to[g] : to[g + 1]])[1]
            out += [(rows[at[g] + i], targets[to[g] + j], iou[i, j]) for i, j in taken(iou)]
        i, j, iou = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
        return pd.DataFrame({"image": p.image.to_numpy()[i] if i else [], "predicted": p.id.to_numpy()[i] if i else [], "truth": t.id.to_numpy()[j] if j else [], "iou": iou})

    # Images meet in buckets of some 10,000 boxes: handing a group to pandas costs as much as hundreds of boxes.
    spark = predicted.sparkSession
    buckets = max(4 * spark.sparkContext.defaultParallelism, -(-predicted.count() // 10_000))
    bucket = F.when(F.col("image").isNull(), -1).otherwise(F.pmod(F.xxhash64("image"), F.lit(buckets)))
    columns = lambda df, more: df.select(bucket.alias("_b"), *[F.col(c).alias(c) for c in ("image", "id", *BOX, *more)])  # noqa: E731  apart, should both come from one table
    sides = columns(predicted, ["confidence"] if by_confidence else []), columns(truth, [])
    return sides[0].groupBy("_b").cogroup(sides[1].groupBy("_b")).applyInPandas(pick, "image long, predicted long, truth long, iou double")


def suppressed(boxes: DataFrame, threshold: float = 0.5, containment: float = 0.9) -> DataFrame:
    """boxes(image, id, box, confidence) that remain: in order of confidence (ties by id), without
    those that a kept box overlaps by the threshold or contains by the containment."""

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["confidence", "id"], ascending=[False, True], ignore_index=True)
        box = group[BOX].to_numpy(float)
        both, iou = _overlap(box, box)
        area = np.maximum(np.clip(box[:, 2:] - box[:, :2], 0, None).prod(axis=1), 1e-6)
        kept: list[int] = []
        for i in range(len(group)):
            if all(iou[k, i] < threshold and both[k, i] / min(area[k], area[i]) < containment for k in kept):
                kept.append(i)
        return group.iloc[kept]

    return boxes.groupBy("image").applyInPandas(keep, boxes.schema)


def detection_summary(pairs: DataFrame, predicted: int, truth: int, thresholds: tuple[float, ...] = (0.5, 0.75)) -> DataFrame:
    """Precision, recall and F1 of matched pairs at each IoU threshold."""
    levels = pairs.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    hits = levels.join(pairs, F.col("iou") >= F.col("threshold"), "left").groupBy("threshold").agg(F.count("iou").alias("tp"))
    p, r = F.try_divide("tp", F.lit(predicted)), F.try_divide("tp", F.lit(truth))
    return hits.select("threshold", "tp", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def average_precision_101(predicted: DataFrame, pairs: DataFrame, truth: int) -> DataFrame:
    """Mean over the recalls 0, 0.01, ..., 1 of the best precision at that recall or more."""
    rows = predicted.join(pairs.select("image", F.col("predicted").alias("id"), F.lit(1).alias("hit")), ["image", "id"], "left")
    order = [F.col("confidence").desc(), F.col("image"), F.col("id")]
    curve = running_sums(rows, order, {"tp": F.coalesce("hit", F.lit(0)), "k": F.lit(1)})
    # Precision at each count of hits is best where that count is first reached.
    steps = curve.groupBy("tp").agg(F.max(F.col("tp") / F.col("k")).alias("precision")).withColumn("recall", F.col("tp") / truth)
    grid = predicted.sparkSession.range(101).select((F.col("id") / 100).alias("at"))
    best = grid.join(steps, F.col("recall") >= F.col("at") - 1e-12, "left").groupBy("at").agg(F.max("precision").alias("p"))
    return best.agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("ap"))


def fused_boxes(boxes: DataFrame, by: list[str], weight: str = "confidence") -> DataFrame:
    """Weighted mean box of each group; weights sum to 1e-6 at least."""
    return boxes.groupBy(*by).agg(
        *[(F.sum(F.col(c) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1e-6))).alias(c) for c in BOX], F.count("*").alias("boxes")
    )


def robust_points(points: DataFrame, by: list[str], scale: float = 2.0) -> DataFrame:
    """points(by..., x, y, w) -> weighted mean of those within scale median distances of the first mean."""
    mean = lambda c: (F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c)
    first = points.groupBy(*by).agg(mean("x").alias("_x"), mean("y").alias("_y"))
    far = points.join(first, by).withColumn("_d", F.sqrt(F.pow(F.col("x") - F.col("_x"), F.lit(2)) + F.pow(F.col("y") - F.col("_y"), F.lit(2))))
    mid = far.groupBy(*by).agg(F.expr("percentile(_d, 0.5)").alias("_m"))
    return far.join(mid, by).filter(F.col("_d") <= scale * F.col("_m") + 1e-9).groupBy(*by).agg(mean("x"), mean("y"), F.count("*").alias("points"))


def presence_overlap(present: DataFrame, by: str, model: str) -> DataFrame:
    """(a, b, jaccard): how alike two models are in which images they find something."""
    seen = present.select(by, model).distinct()
    counts = seen.groupBy(model).agg(F.count("*").alias("n"))
    two = seen.select(by, F.col(model).alias("b"))
    both = seen.select(by, F.col(model).alias("a")).join(two, by).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    one = counts.select(F.col(model).alias("a"), F.col("n").alias("na"))
    pairs = one.join(counts.select(F.col(model).alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    c = F.coalesce("c", F.lit(0))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", (c / F.greatest(F.col("na") + F.col("nb") - c, F.lit(1))).alias("jaccard"))


def keypoint_error(predicted: DataFrame, truth: DataFrame, head: str, thresholds: tuple[float, ...] = (0.05, 0.1)) -> DataFrame:
    """(id, name, x, y) predictions against visible truth(id, name, x, y, head): mean distance by head
    size, and the part of points within each threshold of it."""
    t = truth.select("id", "name", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col(head).alias("h"))
    d = F.sqrt(F.pow(F.col("x") - F.col("tx"), F.lit(2)) + F.pow(F.col("y") - F.col("ty"), F.lit(2))) / F.col("h")
    return predicted.join(t, ["id", "name"]).agg(
        F.count("*").alias("points"), F.avg(d).alias("nme"), *[F.avg((d <= x).cast("double")).alias(f"pck_{round(100 * x):02d}") for x in thresholds]
    )
