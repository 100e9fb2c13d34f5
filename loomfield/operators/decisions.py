"""Rule tables as expressions: decisions, policies, exposure, promotion, costs, crops and reliabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomfield.functions.vectors import as_double, dot, unit
from loomfield.operators.diagnostics import weighted_mean_vector


def projected_status(stream: Column, occupancy: Column, evidence: Column, conflict: Column, visual: Column) -> Column:
    """One status of five axes, by the first that settles it; null if the stream failed or the
    occupancy is not known."""
    return (
        F.when(stream == "FAILED", None)
        .when(occupancy.isin("NO_DOG", "MULTIPLE_DOGS"), occupancy)
        .when(occupancy.isin("NOT_EVALUATED", "UNCERTAIN"), None)
        .when(evidence == "NO_USABLE_EVIDENCE", evidence)
        .when(evidence == "NOT_EVALUATED", "DOG_PRESENT")
        .when(conflict == "IDENTITY_CONFLICT", conflict)
        .otherwise(visual)
    )


def refused(rows: DataFrame, registry: DataFrame, provisional: DataFrame, identity: str, kind: str) -> DataFrame:
    """Rows that a registered-only policy refuses, with the first reason."""
    listed = registry.select(identity).distinct().withColumn("_r", F.lit(True))
    generated = provisional.select(identity).distinct().withColumn("_p", F.lit(True))
    reason = (
        F.when(F.col(kind) != "REGISTERED", "PROVISIONAL_KIND").when(F.col("_p"), "KNOWN_PROVISIONAL").when(F.col("_r").isNull(), "UNREGISTERED")
    )
    return rows.join(listed, identity, "left").join(generated, identity, "left").withColumn("reason", reason).filter("reason IS NOT NULL").drop("_r", "_p")


def exposure(declared: DataFrame, key: str, stage: str, source: str, order: list[str]) -> DataFrame:
    """(key, stage, sources): the latest stage of each key in the order, and the sorted sources that
    declare it."""
    rank = F.create_map(*[x for k, s in enumerate(order) for x in (F.lit(s), F.lit(k))])
    return declared.groupBy(key).agg(
        F.max_by(stage, rank[F.col(stage)]).alias("stage"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources")
    )


def allowed(role_stage: Column, history: Column, order: list[str]) -> Column:
    """Whether a role's stage is as late as the history, if there is one."""
    rank = F.create_map(*[x for k, s in enumerate(order) for x in (F.lit(s), F.lit(k))])
    return history.isNull() | (rank[role_stage] >= rank[history])


def cohort_digests(uses: DataFrame, by: list[str], identity: str) -> DataFrame:
    """Identities of each cohort: their count and a digest of the sorted set."""
    own = uses.select(*by, identity).distinct()
    return own.groupBy(*by).agg(
        F.count("*").alias("identities"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(identity).cast("string"))), ","), 256).alias("digest")
    )


def best_frames(frames: DataFrame, by: str, k: int, least: float) -> DataFrame:
    """frames(by, frame, sharpness, area): of those sharp enough the k with the largest sharpness times
    the root of the area; ties to the earlier frame."""
    score = F.col("sharpness") * F.sqrt("area")
    order = W.partitionBy(by).orderBy(F.col("score").desc(), "frame")
    return frames.filter(F.col("sharpness") >= least).withColumn("score", score).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def promotion(metrics: DataFrame, by: list[str]) -> DataFrame:
    """metrics(by..., kind PROTECTED or IMPROVEMENT, margin, lower, upper) of degradations: REJECT if a
    protected one is surely beyond its margin, PROMOTE if none can be and some improvement is sure,
    else INCONCLUSIVE."""
    kept, better = F.col("kind") == "PROTECTED", F.col("kind") == "IMPROVEMENT"
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = metrics.groupBy(*by).agg(
        any_(kept & (F.col("lower") > F.col("margin"))).alias("_worse"),
        any_(kept & (F.col("upper") > F.col("margin"))).alias("_unsure"),
        any_(better & (F.col("upper") < 0)).alias("_better"),
        (any_(kept) & any_(better)).alias("_complete"),
    )
    outcome = (
        F.when(~F.col("_complete"), "INCONCLUSIVE").when(F.col("_worse"), "REJECT").when(F.col("_unsure"), "INCONCLUSIVE").when(F.col("_better"), "PROMOTE").otherwise("INCONCLUSIVE")
    )
    return flags.select(*by, outcome.alias("decision"))


def total_cost(fixed: list[Column], calls: list[tuple[Column, Column]]) -> Column:
    """Fixed costs and calls times their cost."""
    out = F.lit(0.0)
    for c in fixed:
        out = out + c
    for n, c in calls:
        out = out + n * c
    return out


def call_reduction(idle: Column, busy: Column, share: Column) -> Column:
    """What adapting the call rate saves against always calling at the larger rate; 0 if both are."""
    top = F.greatest(idle, busy)
    return F.when(top == 0, F.lit(0.0)).otherwise(1 - ((1 - share) * idle + share * busy) / top)


def encoded_bytes(megabits_per_second: Column, seconds: Column) -> Column:
    return F.ceil(megabits_per_second * 1_000_000 / 8 * seconds)


def unit_value(c: Column, name: str) -> Column:
    """c, which must be from 0 to 1: anything else fails the query."""
    return F.when((c >= 0) & (c <= 1), c).otherwise(F.raise_error(F.lit(f"{name} must be from 0 to 1")).cast("double"))


def face_reliability(overall: Column, short_side: Column) -> Column:
    overall = unit_value(overall, "overall")
    size = F.sqrt(F.least(F.lit(1.0), short_side / 64.0))
    return F.greatest(F.lit(0.02), F.least(F.lit(1.0), overall * (0.5 + 0.5 * size)))


def nose_reliability(confidence: Column, frontality: Column, short_side: Column, blur: Column, contrast: Column) -> Column:
    parts = {"confidence": confidence, "frontality": frontality, "blur": blur, "contrast": contrast}
    confidence, frontality, blur, contrast = (unit_value(c, n) for n, c in parts.items())
    size = F.sqrt(F.least(F.lit(1.0), short_side / 32.0))
    product = confidence * (0.25 + 0.75 * blur) * (0.5 + 0.5 * contrast) * (0.35 + 0.65 * size) * (0.6 + 0.4 * frontality)
    return F.greatest(F.lit(0.02), F.least(F.lit(1.0), product))


def face_region(x1: Column, y1: Column, x2: Column, y2: Column, high: float = 0.55, wide: float = 0.40, shift: float = -0.05) -> tuple[Column, ...]:
    """The box where a face is expected in a body box."""
    w, h = (x2 - x1) * wide / 2, (y2 - y1) * high / 2
    x, y = (x1 + x2) / 2, y1 + (y2 - y1) * (0.35 + shift)
    return x - w, y - h, x + w, y + h


def in_square_crop(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """A source point in the unit square of a crop that is padded to a square; integer corners."""
    w, h = x2 - x1, y2 - y1
    side = F.greatest(w, h)
    clip = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return clip((x - x1 + F.floor((side - w) / 2)) / side), clip((y - y1 + F.floor((side - h) / 2)) / side)


def box_quality(confidence: Column, agreement: Column, truncated: Column, width: Column, height: Column, boxes: Column, blur: Column) -> Column:
    """The mean of confidence, agreement, completeness, native size (224 is full), loneliness and blur."""
    native = F.least(F.lit(1.0), F.greatest(width / 224.0, height / 224.0))
    return (confidence + agreement + (1 - truncated.cast("double")) + native + 1 / F.greatest(boxes, F.lit(1)) + blur) / 6


def face_quality(landmarks: Column, anchors: Column, offset: Column, longer_side: Column, truncated: Column, blur: Column) -> Column:
    """The mean of six parts: confidence of all landmarks and of the anchors (arrays; none counts 0), how
    near the nose is to the middle of the eyes (offset by the eyes' distance; 0.5 is nothing, unknown is 1),
    native size (112 is full), completeness and blur."""
    mean = lambda a: F.coalesce(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a)), F.lit(0.0))
    yaw = F.coalesce(F.greatest(F.lit(0.0), 1 - offset / 0.5), F.lit(1.0))
    size = F.coalesce(F.least(F.lit(1.0), longer_side / 112.0), F.lit(1.0))
    return (mean(landmarks) + mean(anchors) + yaw + size + (1 - F.coalesce(truncated.cast("double"), F.lit(0.0))) + blur) / 6


def nose_quality(agreement: Column, short_side: Column, blur: Column, specular: Column, truncated: Column, muzzle: Column, support: Column) -> Column:
    """The mean of seven parts; a native size that is not known counts a half, 224 is full."""
    native = F.when(short_side > 0, F.least(F.lit(1.0), short_side / 224.0)).otherwise(0.5)
    return (agreement + native + blur + (1 - specular) + (1 - truncated.cast("double")) + (1 - muzzle) + support) / 7


def frontality(left: Column, right: Column, root: Column, lower: Column) -> dict[str, Column]:
    """Columns of four points (x, y, confidence), both eyes and both ends of the nose: symmetry, level,
    their product, the least confidence, and both together; 0 but for the confidence if the eyes meet."""
    dx, dy = right["x"] - left["x"], right["y"] - left["y"]
    apart = F.sqrt(dx * dx + dy * dy)
    far = apart > 1e-8
    offset = F.abs((root["x"] + lower["x"]) / 2 - (left["x"] + right["x"]) / 2) / apart
    part = lambda x: F.when(far, F.greatest(F.lit(0.0), 1 - x / 0.5)).otherwise(0.0)
    zero = lambda x: F.when(x <= 1e-12, 0.0).otherwise(x)
    symmetry, level = part(offset), part(F.abs(dy) / apart)
    sure = F.least(left["c"], right["c"], root["c"], lower["c"])
    geometry = zero(symmetry * level)
    return {"symmetry": symmetry, "level": level, "geometric": geometry, "anchor": sure, "combined": zero(geometry * sure)}


def consensus(rows: DataFrame, vector: str, quality: str, by: str, item: str, scale: float = 2.5, least: float = -1.0) -> DataFrame:
    """(by, n, accepted, mean, dispersion): unit vectors averaged by quality; those whose cosine to that
    mean is under the median by more than scale times the median absolute deviation (0.02 at least) are
    left out, but two remain; then averaged again. dispersion is the weighted mean of 1 - cosine."""
    units = rows.select(by, item, unit(as_double(vector)).alias("u"), F.greatest(quality, F.lit(1e-6)).alias("q"))
    first = weighted_mean_vector(units, "u", "q", [by]).withColumnRenamed("mean", "_m")
    near = units.join(first, by).withColumn("c", dot(F.col("u"), F.col("_m"))).drop("_m")
    near = near.join(near.groupBy(by).agg(F.expr("percentile(c, 0.5)").alias("_med")), by)
    near = near.join(near.groupBy(by).agg(F.expr("percentile(abs(c - _med), 0.5)").alias("_mad")), by)
    cut = F.greatest(F.lit(least), F.col("_med") - scale * F.greatest("_mad", F.lit(0.02)))
    own = W.partitionBy(by)
    placed = near.withColumns(
        {"_ok": F.col("c") >= cut, "_r": F.row_number().over(own.orderBy(F.col("c").desc(), item)), "n": F.count("*").over(own)}
    ).withColumn("_k", F.count(F.when(F.col("_ok"), 1)).over(own))
    kept = placed.filter(F.when(F.col("_k") >= 2, F.col("_ok")).otherwise(F.col("_r") <= 2))
    mean = weighted_mean_vector(kept, "u", "q", [by])
    off = 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("u"), F.col("mean"))))
    spread = kept.join(mean, by).groupBy(by).agg(
        F.max("n").alias("n"), F.count("*").alias("accepted"), (F.sum(F.col("q") * off) / F.sum("q")).alias("dispersion")
    )
    return spread.join(mean, by).select(by, "n", "accepted", "mean", "dispersion")
