"""Retrieval, verification, open-set and calibration metrics over score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomfield.operators.ranking import running_sums


def relevance_ranks(scores: DataFrame) -> DataFrame:
    """scores(query_id, template_id, score, relevant) with rank and hits so far, best first, ties to
    the smaller template id."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "template_id")
    return scores.withColumn("rank", F.row_number().over(order)).withColumn(
        "hits", F.sum(F.col("relevant").cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0))
    )


def placed_outcomes(places: DataFrame, queries: DataFrame) -> DataFrame:
    """The same from places(query_id, place), the ranks of relevant templates, and queries(query_id)."""
    order = W.partitionBy("query_id").orderBy("place")
    hits = places.withColumn("hits", F.row_number().over(order))
    found = hits.groupBy("query_id").agg(
        F.count("*").alias("n_relevant"),
        F.min("place").alias("first_hit"),
        F.avg(F.col("hits") / F.col("place")).alias("ap"),
        (F.count("*") / F.max("place")).alias("inp"),
    )
    return queries.join(found, "query_id", "left").fillna(0, ["n_relevant"])


def retrieval_summary(outcomes: DataFrame, by: list[str] | None = None, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Rank-k and MRR over queries that have relevant templates, mAP over all queries (those without
    count zero), mINP over the former."""
    known = F.col("n_relevant") > 0
    share = lambda k: F.avg(F.when(known, (F.col("first_hit") <= k).cast("double"))).alias(f"rank_{k}")
    return outcomes.groupBy(*(by or [])).agg(
        F.count("*").alias("queries"),
        F.count(F.when(known, 1)).alias("evaluated"),
        *[share(k) for k in ks],
        F.avg(F.when(known, 1 / F.col("first_hit"))).alias("mrr"),
        F.avg(F.coalesce("ap", F.lit(0.0))).alias("map"),
        F.avg(F.when(known, F.col("inp"))).alias("minp"),
    )


def outcome_values(outcomes: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """outcomes with one column for each metric of retrieval_summary(), to be averaged or resampled: rank_k,
    mrr and minp are null for queries without relevant templates, map is zero for them."""
    known = F.col("n_relevant") > 0
    ranks = {f"rank_{k}": F.when(known, (F.col("first_hit") <= k).cast("double")) for k in ks}
    rest = {"mrr": F.when(known, 1 / F.col("first_hit")), "map": F.coalesce("ap", F.lit(0.0)), "minp": F.when(known, F.col("inp"))}
    return outcomes.withColumns(ranks | rest)


def score_counts(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """pairs(score, label) -> counts of positives and negatives at each distinct score: all curves are
    built from these, so what is sorted is as long as there are distinct scores."""
    return pairs.groupBy(*(by or []), "score").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") == 0, 1)).alias("neg")
    )


def verification_curve(counts: DataFrame) -> DataFrame:
    """Accepts at every threshold (score >= threshold): threshold, tp, fp, tar, far; an infinite
    threshold accepts nothing. Sums run over ranges of the scores, so their number has no bound."""
    total = counts.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("p"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n"))
    none = F.lit(0).cast("long")
    top = counts.agg(F.lit(float("inf")).alias("score"), none.alias("pos"), none.alias("neg"))
    rows = counts.select("score", "pos", "neg").union(top).withColumnRenamed("score", "threshold")
    summed = running_sums(rows, [F.col("threshold").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    return (
        summed.crossJoin(F.broadcast(total))  # one row
        .withColumn("tar", F.when(F.col("p") > 0, F.col("tp") / F.col("p")))
        .withColumn("far", F.when(F.col("n") > 0, F.col("fp") / F.col("n")))
        .select("threshold", "tp", "fp", "tar", "far")
    )


def threshold_at_far(curve: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target_far the threshold with the largest tar whose far is no larger; ties to the
    higher threshold. Targets that only the infinite threshold meets have none and are absent."""
    fits = curve.join(F.broadcast(targets), F.col("far") <= F.col("target_far"))
    best = fits.groupBy("target_far").agg(F.max(F.struct("tar", "threshold", "far")).alias("b"))
    return best.select("target_far", "b.threshold", "b.tar", "b.far").filter(F.col("threshold") < float("inf"))


def verification_summary(counts: DataFrame) -> DataFrame:
    """AUC (ties count half), equal error rate (least |FRR - FAR|, ties to the higher threshold),
    d-prime and class moments of counts(score, pos, neg)."""
    curve = verification_curve(counts).join(counts, F.col("threshold") == F.col("score"), "left")
    gap = F.abs(1 - F.col("tar") - F.col("far"))
    ahead = F.col("tp") - F.col("pos") / 2
    rates = curve.agg(
        (F.sum(F.col("neg") * ahead) / (F.sum("pos") * F.sum("neg"))).alias("auc"),
        F.max_by((1 - F.col("tar") + F.col("far")) / 2, F.struct(-gap, "threshold")).alias("eer"),
    )
    mean = lambda c: F.sum(F.col("score") * F.col(c)) / F.sum(c)
    square = lambda c: F.sum(F.col("score") * F.col("score") * F.col(c)) / F.sum(c)
    std = lambda c: F.sqrt(F.greatest(F.lit(0.0), square(c) - mean(c) * mean(c)))
    moments = counts.agg(mean("pos").alias("pos_mean"), mean("neg").alias("neg_mean"), std("pos").alias("pos_std"), std("neg").alias("neg_std")).withColumn(
        "d_prime", (F.col("pos_mean") - F.col("neg_mean")) / F.sqrt((F.pow("pos_std", F.lit(2)) + F.pow("neg_std", F.lit(2))) / 2)
    )
    return rates.crossJoin(moments)  # one row each


def average_precision(counts: DataFrame) -> DataFrame:
    """Step-wise average precision over the distinct scores of counts(score, pos, neg)."""
    curve = verification_curve(counts).join(counts, F.col("threshold") == F.col("score"))
    return curve.agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("ap"))


def confusion(counts: DataFrame, threshold: float | Column) -> DataFrame:
    """Counts and rates of counts(score, pos, neg) accepted at score >= threshold."""
    said = F.col("score") >= threshold
    count = lambda c, name: F.coalesce(F.sum(F.when(c, F.col(name))), F.lit(0))
    rows = counts.agg(
        count(said, "pos").alias("tp"), count(said, "neg").alias("fp"), count(~said, "pos").alias("fn"), count(~said, "neg").alias("tn")
    )
    rate = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return rows.withColumns({"tar": rate("tp", "fn"), "far": rate("fp", "tn"), "frr": rate("fn", "tp")})


def open_set_thresholds(tops: DataFrame, targets: DataFrame) -> DataFrame:
    """tops(query_id, known, correct, score): each query's best match. For each target_fpir the
    threshold whose false-positive identification rate is no larger and which accepts the most
    correct matches; ties to the higher threshold, which may be infinite."""
    counts = tops.groupBy("score").agg(
        F.count(F.when(~F.col("known"), 1)).alias("neg"), F.count(F.when(F.col("known") & F.col("correct"), 1)).alias("pos")
    )
    curve = verification_curve(counts).select("threshold", F.col("far").alias("fpir"), F.col("tp").alias("accepted"))
    fits = curve.join(F.broadcast(targets), F.col("fpir") <= F.col("target_fpir"))
    best = fits.groupBy("target_fpir").agg(F.max(F.struct("accepted", "threshold", "fpir")).alias("b"))
    return best.select("target_fpir", "b.threshold", "b.accepted", "b.fpir")


def open_set_outcomes(tops: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Detection-and-identification rate, misidentifications, rejections and FPIR of tops at each
    target's threshold."""
    joined = tops.crossJoin(F.broadcast(thresholds.select("target_fpir", "threshold")))  # a row for each target
    take, known, right = F.col("score") >= F.col("threshold"), F.col("known"), F.col("correct")
    count = lambda c: F.count(F.when(c, 1))
    return (
        joined.groupBy("target_fpir")
        .agg(
            count(known).alias("known"),
            count(~known).alias("unknown"),
            count(known & take & right).alias("identified"),
            count(known & take & ~right).alias("misidentified"),
            count(known & ~take).alias("rejected"),
            count(~known & take).alias("false_positives"),
        )
        .withColumn("dir", F.try_divide("identified", "known"))
        .withColumn("fpir", F.try_divide("false_positives", "unknown"))
    )


def dispositions(top: DataFrame, threshold: float, margin: float) -> DataFrame:
    """top(query_id, rank, identity, score), ranks 1 and 2 at least -> best identity, margin to the
    next, and KNOWN, UNKNOWN (under threshold) or REVIEW_REQUIRED (margin too small)."""
    two = top.filter("rank <= 2").groupBy("query_id").agg(
        F.min_by("identity", "rank").alias("identity"), F.max("score").alias("score"), F.count("*").alias("n"), F.min("score").alias("next")
    )
    gap = F.when(F.col("n") == 2, F.col("score") - F.col("next"))
    return two.select(
        "query_id",
        "identity",
        "score",
        gap.alias("margin"),
        F.when(F.col("score") < threshold, "UNKNOWN").when(gap < margin, "REVIEW_REQUIRED").otherwise("KNOWN").alias("disposition"),
    )


def calibration_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """rows(probability, label) -> every bin (empty ones too): bin, lo, hi, n, mean_probability,
    positive_rate. Bins are [lo, hi), the last one closed, compared with their explicit edges."""
    p = F.col("probability")
    at = F.lit(bins - 1)
    for k in range(bins - 2, -1, -1):
        at = F.when(p < (k + 1) / bins, F.lit(k)).otherwise(at)
    used = rows.groupBy(at.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("probability").alias("mean_probability"), F.avg("label").alias("positive_rate")
    )
    edges = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") / bins).alias("lo"), ((F.col("id") + 1) / bins).alias("hi"))
    return edges.join(used, "bin", "left").fillna(0, ["n"])


def calibration_summary(rows: DataFrame, bins: int = 10, clip: float = 1e-15) -> DataFrame:
    """Expected calibration error, Brier score and negative log-likelihood of rows(probability, label)."""
    n = W.partitionBy(F.lit(0))
    ece = calibration_bins(rows, bins).withColumn("total", F.sum("n").over(n)).agg(
        F.sum(F.col("n") / F.col("total") * F.abs(F.col("mean_probability") - F.col("positive_rate"))).alias("ece")
    )
    p = F.least(F.greatest("probability", F.lit(clip)), F.lit(1 - clip))
    likely = F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))
    rest = rows.agg(F.avg(F.pow(F.col("probability") - F.col("label"), F.lit(2))).alias("brier"), (-F.avg(likely)).alias("nll"))
    return ece.crossJoin(rest)  # one row each


def simplex_grid(channels: int, resolution: int) -> list[list[float]]:
    """All weight vectors of non-negative multiples of 1/resolution that sum to one."""
    if channels == 1:
        return [[1.0]]
    out: list[list[int]] = [[]]
    for _ in range(channels - 1):
        out = [[*w, k] for w in out for k in range(resolution - sum(w) + 1)]
    return [[k / resolution for k in (*w, resolution - sum(w))] for w in out]


def fused(scores: Column, weights: Column, available: Column | None = None, quality: Column | None = None, floor: float = 0.05) -> Column:
    """Weighted mean of channel scores over available channels, weights times quality (floor at
    least); null if no weight is left."""
    w = weights
    if available is not None:
        w = F.zip_with(w, available, lambda x, a: F.when(a, x).otherwise(0.0))
    if quality is not None:
        w = F.zip_with(w, quality, lambda x, q: x * F.greatest(F.coalesce(q, F.lit(0.0)), F.lit(floor)))
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
    value = F.aggregate(F.zip_with(w, scores, lambda x, s: x * F.coalesce(s, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, value / total)


def fit_simplex(rows: DataFrame, channels: int, resolution: int = 10, l2: float = 1e-3) -> DataFrame:
    """rows(scores, label) -> (weights, loss): the grid point with the least mean squared error plus
    l2 times its squared length; ties to the first in order of weights. Rows are evaluated at every
    point of the grid, whose size is fixed by its resolution, and summed before the shuffle."""
    grid = F.array(*[F.array(*map(F.lit, w)) for w in simplex_grid(channels, resolution)])
    error = F.pow(fused(F.col("scores"), F.col("weights")) - F.col("label"), F.lit(2))
    length = F.aggregate("weights", F.lit(0.0), lambda s, x: s + x * x)
    loss = rows.withColumn("weights", F.explode(grid)).groupBy("weights").agg(F.avg(error).alias("mse"))
    return loss.withColumn("loss", F.round(F.col("mse") + l2 * length, 9)).orderBy("loss", "weights").limit(1).select("weights", "loss")


def interpolated(rows: DataFrame, knots: DataFrame) -> DataFrame:
    """rows(channel, x, ...) with y on the polyline of knots(channel, kx, ky), constant beyond its
    ends. A channel's knots are a short sorted array, joined once."""
    lines = knots.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("kx", "ky"))).alias("k"))
    joined = rows.join(lines, "channel").withColumn("lo", F.try_element_at(F.filter("k", lambda p: p["kx"] <= F.col("x")), F.lit(-1))).withColumn(
        "up", F.try_element_at(F.filter("k", lambda p: p["kx"] > F.col("x")), F.lit(1))
    )
    y = (
        F.when(F.col("lo").isNull(), F.col("up.ky"))
        .when(F.col("up").isNull(), F.col("lo.ky"))
        .otherwise(F.col("lo.ky") + (F.col("x") - F.col("lo.kx")) * (F.col("up.ky") - F.col("lo.ky")) / (F.col("up.kx") - F.col("lo.kx")))
    )
    return joined.withColumn("y", y).drop("k", "lo", "up")


def isotonic(rows: DataFrame):
    """An MLlib isotonic model of rows(score, label)."""
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol="score", labelCol="label").fit(rows.select(F.col("score").cast("double"), F.col("label").cast("double")))
