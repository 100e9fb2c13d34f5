"""Scalar expressions: intervals, tokens, boxes, buckets, decisions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def token(domain: str, value: Column) -> Column:
    """SHA-256 of a value under the name of its domain."""
    return F.sha2(F.concat(F.lit(domain + "\x00"), value.cast("string")), 256)


def stable_rank(*parts: Column) -> Column:
    """A hash that orders rows in a fixed, seed-dependent way."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version-5 UUID of a name in a namespace (a UUID string)."""
    raw = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary"))
    h = F.sha1(raw)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        F.substring(variant, -1, 1), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def normalized_label(c: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")


def wilson(events: Column, trials: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval of a rate; null without trials."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    p = events / trials
    base = 1 + z * z / trials
    mid = (p + z * z / (2 * trials)) / base
    half = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials)) / base
    some = lambda x: F.when(trials > 0, x)
    return some(F.greatest(F.lit(0.0), mid - half)), some(F.least(F.lit(1.0), mid + half))


def zero_event_upper(trials: Column, confidence: float = 0.95) -> Column:
    """Exact upper bound of a rate of which no event was seen."""
    return F.when(trials > 0, -F.expm1(F.log1p(F.lit(-confidence)) / trials))


def trials_for_zero_events(upper: Column, confidence: float = 0.95) -> Column:
    """Trials without an event that bound a rate by upper."""
    return F.ceil(F.log1p(F.lit(-confidence)) / F.log1p(-upper)).cast("long")


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(F.least(a, b) - F.greatest(a, b)))


def allowed_accepts(trials: Column, rate: float, alpha: float) -> Column:
    """The greatest k for which k or fewer events in trials, at this rate, have probability alpha or
    less; -1 if none. Terms are summed in log space, each from the one before."""
    start = F.struct(
        (trials * F.log1p(F.lit(-rate))).alias("term"), F.lit(float("-inf")).alias("total"), F.lit(-1).cast("long").alias("best")
    )

    def step(acc: Column, k: Column) -> Column:
        term = F.when(k == 0, acc["term"]).otherwise(
            acc["term"] + F.log((trials - k + 1) / k) + F.log(F.lit(rate)) - F.log1p(F.lit(-rate))
        )
        total = F.when(acc["total"] == float("-inf"), term).otherwise(log_add_exp(acc["total"], term))
        return F.struct(term.alias("term"), total.alias("total"), F.when(total <= F.log(F.lit(alpha)), k).otherwise(acc["best"]).alias("best"))

    reach = F.least(trials, F.ceil(trials * rate).cast("long") + 1)
    return F.aggregate(F.sequence(F.lit(0).cast("long"), reach), start, step, lambda acc: acc["best"])


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two (x1, y1, x2, y2) boxes; the union counts 1e-6 at least."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    both = wide * high
    return both / F.greatest(area(a) + area(b) - both, F.lit(1e-6))


def square_box(box: tuple[Column, ...], scale: float, width: float, height: float) -> tuple[Column, ...]:
    """The square around a box's centre, of scale times its longer side, clipped to the image and
    truncated to integers."""
    half = F.greatest(box[2] - box[0], box[3] - box[1]) * (scale / 2)
    x, y = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    clip = lambda v, top: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), v)).cast("int")
    return clip(x - half, width), clip(y - half, height), clip(x + half, width), clip(y + half, height)


def is_truncated(box: tuple[Column, ...], width: float, height: float, threshold: float = 0.2) -> Column:
    """Whether more than threshold of a box lies outside its image; boxes without area do."""
    area = (box[2] - box[0]) * (box[3] - box[1])
    inside = F.greatest(F.lit(0.0), F.least(box[2], F.lit(float(width))) - F.greatest(box[0], F.lit(0.0))) * F.greatest(
        F.lit(0.0), F.least(box[3], F.lit(float(height))) - F.greatest(box[1], F.lit(0.0))
    )
    return (area <= 0) | (1 - inside / area > threshold)


def rate_bucket(usable: Column, total: Column) -> Column:
    """ZERO, LOW (a quarter at most), MID (a half at most), HIGH or ALL, by integer comparison."""
    return (
        F.when(usable == 0, "ZERO")
        .when(usable == total, "ALL")
        .when(4 * usable <= total, "LOW")
        .when(2 * usable <= total, "MID")
        .otherwise("HIGH")
    )


def size_bucket(size: Column) -> Column:
    """Names and bounds of identity sizes."""
    return (
        F.when(size == 0, "IDENTITY_FREE")
        .when(size == 1, "SINGLETON")
        .when(size <= 4, "SMALL_2_4")
        .when(size <= 19, "MEDIUM_5_19")
        .otherwise("LARGE_20_PLUS")
    )


def routed(score: Column, confidence: Column, high: float, low: float) -> Column:
    """ACCEPT if both reach high, REJECT if either is under low, else REVIEW."""
    return (
        F.when((score >= high) & (confidence >= high), "ACCEPT").when((score < low) | (confidence < low), "REJECT").otherwise("REVIEW")
    )
