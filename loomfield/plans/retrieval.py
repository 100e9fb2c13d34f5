"""Search, retrieval, verification, open-set and calibration queries over `embeddings`.

Templates are vectors, identities their labels; every fifth vector is a query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.functions import scalars as S
from loomfield.functions.vectors import as_double, cosine
from loomfield.operators import fusion as U
from loomfield.operators import metrics as M
from loomfield.operators import resampling as B
from loomfield.operators import search as X
from loomfield.operators import splits as P
from loomfield.plans.registering import query, rounded
from loomfield.storage import stored

IS_QUERY = "vec_id % 5 = 0"

_SCORES = """
WITH s AS (
  SELECT q.vec_id AS query_id, q.label AS own, g.vec_id AS template_id, g.label AS identity,
    round(list_cosine_similarity(q.embedding::DOUBLE[], g.embedding::DOUBLE[]), 6) AS score, (g.vec_id % 101) / 100.0 AS quality
  FROM embeddings q JOIN embeddings g ON q.vec_id % 5 = 0 AND g.vec_id % 5 <> 0
), best AS (
  SELECT query_id, own, identity, max(score) AS score, arg_max(-template_id, (score, -template_id)) AS t FROM s GROUP BY ALL
), ranked AS (
  SELECT query_id, own, identity, score, -t AS template_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identity) AS rank FROM best
)
"""


def _sides(t):
    e = t("embeddings")
    side = lambda df: df.select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("identity"),
        F.array(as_double("embedding")).alias("channels"),
        (F.col("vec_id") % 7).alias("group"),
        F.lit(None).cast("array<long>").alias("excluded"),
    )
    return side(e.filter(IS_QUERY)), side(e.filter(f"NOT ({IS_QUERY})"))


def _best(t):
    return X.best_templates(*_sides(t))


def _named(t):
    side = lambda df: df.select(F.col("vec_id").alias("id"), F.col("label").alias("identity"), as_double("embedding").alias("vector"))
    return side(t("embeddings").filter(IS_QUERY)), side(t("embeddings").filter(f"NOT ({IS_QUERY})"))


def _outcomes(t):
    return X.relevance_outcomes(*_named(t))


@query(_SCORES + "SELECT query_id, CAST(rank AS INTEGER) AS rank, identity, template_id, score FROM ranked WHERE rank <= 5")
def search_topk(t):
    return X.top_identities(X.best_templates(*_sides(t), k=5), 5).select("query_id", "rank", "identity", "template_id", "score")


@query("""
WITH s AS (
  SELECT q.vec_id AS query_id, g.vec_id AS template_id, g.label AS identity,
    round(list_cosine_similarity(q.embedding::DOUBLE[], g.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings g ON q.vec_id % 5 = 0 AND g.vec_id % 5 <> 0
  WHERE g.label IN (1, 3, 5, 7) AND g.vec_id % 7 <> q.vec_id % 7 AND g.vec_id <> q.vec_id + 1
), best AS (SELECT query_id, identity, max(score) AS score, -arg_max(-template_id, (score, -template_id)) AS template_id FROM s GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identity) AS INTEGER) AS rank, identity, template_id, score
FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identity) <= 3
""")
def search_filtered(t):
    """An allow-list of identities, and exclusions of one template and of a duplicate group, all before
    the best template is taken. Groups are told from templates by sign."""
    q, g = _sides(t)
    group = lambda c: -1 - F.col(c) % 7
    q = q.withColumn("excluded", F.array(F.col("id") + 1, group("id")))
    g = g.filter(F.col("identity").isin(1, 3, 5, 7)).withColumn("group", group("id"))
    return X.top_identities(X.best_templates(q, g, k=3), 3).select("query_id", "rank", "identity", "template_id", "score")


@query(_SCORES + "SELECT query_id, identity, score, rank FROM ranked WHERE identity = own")
def search_own_rank(t):
    asked = t("embeddings").filter(IS_QUERY).select(F.col("vec_id").alias("query_id"), F.col("label").alias("identity"))
    return X.rank_of(_best(t), asked).select("query_id", "identity", "score", "rank")


@query(_SCORES + "SELECT query_id, template_id, score FROM ranked WHERE identity = 3")
def search_explain(t):
    """The template that speaks best for one identity."""
    q, g = _sides(t)
    return X.best_templates(q, g.filter("identity = 3")).select("query_id", "template_id", "score")


@query("""
WITH c AS (
  SELECT vec_id, label, list_transform(range(0, 4), lambda k: CASE WHEN (k = 3 AND vec_id % 3 = 0) OR (k = 1 AND vec_id % 4 = 0) THEN NULL
    ELSE list_slice(embedding::DOUBLE[], k * 16 + 1, k * 16 + 16) END) AS ch FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, g.vec_id AS template_id, g.label AS identity, round(
    list_sum(list_transform(range(1, 5), lambda k: CASE WHEN q.ch[k] IS NULL OR g.ch[k] IS NULL THEN 0 ELSE [0.4, 0.3, 0.2, 0.1][k] * list_cosine_similarity(q.ch[k], g.ch[k]) END))
    / list_sum(list_transform(range(1, 5), lambda k: CASE WHEN q.ch[k] IS NULL OR g.ch[k] IS NULL THEN 0 ELSE [0.4, 0.3, 0.2, 0.1][k] END)), 6) AS score
  FROM c q JOIN c g ON q.vec_id % 5 = 0 AND g.vec_id % 5 <> 0
), best AS (SELECT query_id, identity, max(score) AS score, -arg_max(-template_id, (score, -template_id)) AS template_id FROM s GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identity) AS INTEGER) AS rank, identity, template_id, score
FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identity) <= 5
""")
def search_channels(t):
    """Four channels of 16 components, two of them missing in places: weights are scaled to the
    channels that both sides have."""
    parts = X.split_channels("embedding", [16] * 4, {1: F.col("vec_id") % 4 == 0, 3: F.col("vec_id") % 3 == 0})
    side = lambda df: df.select(
        F.col("vec_id").alias("id"), F.col("label").alias("identity"), parts.alias("channels"), F.lit(None).cast("long").alias("group"),
        F.lit(None).cast("array<long>").alias("excluded"),
    )
    e = t("embeddings")
    found = X.best_templates(side(e.filter(IS_QUERY)), side(e.filter(f"NOT ({IS_QUERY})")), weights=[0.4, 0.3, 0.2, 0.1], k=5)
    return X.top_identities(found, 5).select("query_id", "rank", "identity", "template_id", "score")


@query(_SCORES + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, identity ORDER BY score DESC, template_id) AS k,
  max(score) OVER (PARTITION BY query_id, identity) AS m FROM s)
SELECT query_id, identity, max(score) AS max_score, round(avg(score), 6) AS mean_score, round(quantile_cont(score, 0.5), 7) AS median_score,
  round(avg(score) FILTER (k <= 3), 6) AS top_k_mean, round(max(m) + 0.1 * ln(sum(exp((score - m) / 0.1)) / count(*)), 6) AS log_mean_exp,
  round(sum(quality * score) / sum(quality), 6) AS quality_mean FROM r GROUP BY query_id, identity
""")
def template_aggregates(t):
    q, g = _named(t)
    out = rounded(X.template_aggregates(q, g.withColumn("quality", F.col("id") % 101 / 100)), "mean_score", "top_k_mean", "log_mean_exp", "quality_mean")
    return rounded(out, "median_score", digits=7)  # means of two six-digit scores


_OUTCOMES = _SCORES + """, h AS (
  SELECT query_id, own = identity AS rel, row_number() OVER w AS rank, sum(CASE WHEN own = identity THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS hits
  FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, template_id)
), o AS (
  SELECT query_id, count(*) FILTER (rel) AS n, min(rank) FILTER (rel) AS f, avg(hits / rank) FILTER (rel) AS ap, count(*) FILTER (rel) / max(rank) FILTER (rel) AS inp
  FROM h GROUP BY query_id
)
"""


@query(_OUTCOMES + """SELECT CAST(query_id % 4 AS BIGINT) AS cohort, count(*) AS queries, count(*) FILTER (n > 0) AS evaluated,
  round(avg((f <= 1)::INT) FILTER (n > 0), 6) AS rank_1, round(avg((f <= 3)::INT) FILTER (n > 0), 6) AS rank_3, round(avg((f <= 5)::INT) FILTER (n > 0), 6) AS rank_5,
  round(avg(1 / f) FILTER (n > 0), 6) AS mrr, round(avg(coalesce(ap, 0)), 6) AS map, round(avg(inp) FILTER (n > 0), 6) AS minp FROM o GROUP BY 1""")
def retrieval_cohorts(t):
    outcomes = _outcomes(t).withColumn("cohort", F.col("query_id") % 4)
    return rounded(M.retrieval_summary(outcomes, ["cohort"]), "rank_1", "rank_3", "rank_5", "mrr", "map", "minp")


@query(_OUTCOMES + "SELECT query_id, n AS n_relevant, f AS first_hit, round(ap, 6) AS ap, round(inp, 6) AS inp FROM o")
def retrieval_outcomes(t):
    return rounded(_outcomes(t), "ap", "inp")


def _counts(t):
    return stored(X.score_counts(*_named(t)), "counts")


_CURVE = _SCORES + """, c AS (
  SELECT score, count(*) FILTER (own = identity) AS pos, count(*) FILTER (own <> identity) AS neg FROM s GROUP BY score
), v AS (
  SELECT score AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, (sum(pos) OVER w) / (SELECT sum(pos) FROM c) AS tar,
    (sum(neg) OVER w) / (SELECT sum(neg) FROM c) AS far FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
)
"""


@query(_CURVE + """SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tar, 6) AS tar, round(far, 6) AS far FROM v
UNION ALL SELECT 'inf'::DOUBLE, 0, 0, 0, 0""")
def verification_curve(t):
    return rounded(M.verification_curve(_counts(t)), "tar", "far")


@query(_CURVE + """SELECT target_far, threshold, round(tar, 6) AS tar, round(far, 6) AS far FROM (VALUES (0.1::DOUBLE), (0.01), (0.001)) x(target_far) JOIN v ON far <= target_far
QUALIFY row_number() OVER (PARTITION BY target_far ORDER BY tar DESC, threshold DESC) = 1""")
def verification_thresholds(t):
    spark = t("embeddings").sparkSession
    targets = spark.createDataFrame([(0.1,), (0.01,), (0.001,)], "target_far double")
    return rounded(M.threshold_at_far(M.verification_curve(_counts(t)), targets), "tar", "far")


@query(_CURVE + """, a AS (SELECT neg, pos, coalesce(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM c),
e AS (SELECT (1 - tar + far) / 2 AS eer FROM (SELECT * FROM v UNION ALL SELECT 'inf'::DOUBLE, 0, 0, 0, 0) ORDER BY abs(1 - tar - far), threshold DESC LIMIT 1),
m AS (SELECT avg(score) FILTER (own = identity) AS pm, avg(score) FILTER (own <> identity) AS nm, stddev_pop(score) FILTER (own = identity) AS ps, stddev_pop(score) FILTER (own <> identity) AS ns FROM s)
SELECT round((SELECT sum(neg * (above + pos / 2)) / (sum(pos) * sum(neg)) FROM a), 6) AS auc, round(eer, 6) AS eer, round(pm, 6) AS pos_mean, round(nm, 6) AS neg_mean,
  round(ps, 6) AS pos_std, round(ns, 6) AS neg_std, round((pm - nm) / sqrt((ps * ps + ns * ns) / 2), 6) AS d_prime FROM e, m""")
def verification_summary(t):
    return rounded(M.verification_summary(_counts(t)), "auc", "eer", "pos_mean", "neg_mean", "pos_std", "neg_std", "d_prime")


@query(_SCORES + """SELECT count(*) FILTER (score >= 0.2 AND own = identity) AS tp, count(*) FILTER (score >= 0.2 AND own <> identity) AS fp,
  count(*) FILTER (score < 0.2 AND own = identity) AS fn, count(*) FILTER (score < 0.2 AND own <> identity) AS tn,
  round(count(*) FILTER (score >= 0.2 AND own = identity) / count(*) FILTER (own = identity), 6) AS tar,
  round(count(*) FILTER (score >= 0.2 AND own <> identity) / count(*) FILTER (own <> identity), 6) AS far,
  round(count(*) FILTER (score < 0.2 AND own = identity) / count(*) FILTER (own = identity), 6) AS frr FROM s""")
def verification_confusion(t):
    return rounded(M.confusion(X.score_counts(*_named(t), cuts=[0.2]), 0.2), "tar", "far", "frr")


@query(_CURVE + "SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS ap FROM c JOIN v ON v.threshold = c.score")
def verification_average_precision(t):
    return rounded(M.average_precision(_counts(t)), "ap")


def _tops(t, unknown_from: int = 7):
    """Best identity of each query; labels from unknown_from on are not enrolled."""
    e = t("embeddings")
    q, g = _sides(t)
    top = X.top_identities(X.best_templates(q, g.filter(F.col("identity") < unknown_from), k=2), 2)
    own = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    return top.join(own, "query_id").withColumn("known", F.col("own") < unknown_from).withColumn("correct", F.col("own") == F.col("identity"))


_TOPS = """
WITH s AS (
  SELECT q.vec_id AS query_id, q.label AS own, g.label AS identity, round(list_cosine_similarity(q.embedding::DOUBLE[], g.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings g ON q.vec_id % 5 = 0 AND g.vec_id % 5 <> 0 AND g.label < 7
), b AS (SELECT query_id, own, identity, max(score) AS score FROM s GROUP BY ALL), tops AS (
  SELECT *, own < 7 AS known, own = identity AS correct, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identity) AS rank FROM b
), c AS (
  SELECT score, count(*) FILTER (NOT known) AS neg, count(*) FILTER (known AND correct) AS pos FROM tops WHERE rank = 1 AND query_id % 2 = 0 GROUP BY score
), v AS (
  SELECT score AS threshold, sum(pos) OVER w AS accepted, (sum(neg) OVER w) / (SELECT sum(neg) FROM c) AS fpir FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT 'inf'::DOUBLE, 0, 0
), th AS (
  SELECT target_fpir, threshold, accepted, fpir FROM (VALUES (0.05::DOUBLE), (0.2)) x(target_fpir) JOIN v ON fpir <= target_fpir
  QUALIFY row_number() OVER (PARTITION BY target_fpir ORDER BY accepted DESC, threshold DESC) = 1
)
"""


def _calibrated(t):
    tops = _tops(t).filter("rank = 1")
    targets = t("embeddings").sparkSession.createDataFrame([(0.05,), (0.2,)], "target_fpir double")
    even = F.col("query_id") % 2 == 0
    return tops.filter(~even), M.open_set_thresholds(tops.filter(even), targets)


@query(_TOPS + "SELECT target_fpir, threshold, CAST(accepted AS BIGINT) AS accepted, round(fpir, 6) AS fpir FROM th")
def open_set_thresholds(t):
    return rounded(_calibrated(t)[1], "fpir")


@query(_TOPS + """SELECT target_fpir, count(*) FILTER (known) AS known, count(*) FILTER (NOT known) AS unknown, count(*) FILTER (known AND score >= threshold AND correct) AS identified,
  count(*) FILTER (known AND score >= threshold AND NOT correct) AS misidentified, count(*) FILTER (known AND score < threshold) AS rejected,
  count(*) FILTER (NOT known AND score >= threshold) AS false_positives,
  round(count(*) FILTER (known AND score >= threshold AND correct) / count(*) FILTER (known), 6) AS dir,
  round(count(*) FILTER (NOT known AND score >= threshold) / count(*) FILTER (NOT known), 6) AS fpir
FROM tops, th WHERE rank = 1 AND query_id % 2 = 1 GROUP BY target_fpir""")
def open_set_outcomes(t):
    return rounded(M.open_set_outcomes(*_calibrated(t)), "dir", "fpir")


@query(_TOPS + """, two AS (SELECT query_id, arg_min(identity, rank) AS identity, max(score) AS score, count(*) AS n, min(score) AS nxt FROM tops WHERE rank <= 2 GROUP BY query_id)
SELECT query_id, identity, score, round(CASE WHEN n = 2 THEN score - nxt END, 6) AS margin,
  CASE WHEN score < 0.3 THEN 'UNKNOWN' WHEN n = 2 AND round(score - nxt, 6) < 0.02 THEN 'REVIEW_REQUIRED' ELSE 'KNOWN' END AS disposition FROM two""")
def open_set_dispositions(t):
    return rounded(M.dispositions(_tops(t), 0.3, 0.02 - 1e-9), "margin")


_PROBABLE = "WITH p AS (SELECT (d.doc_id * 7919 % 1000) / 1000.0::DOUBLE AS probability, l.quality AS label FROM documents d JOIN labels l USING (doc_id))"


def _probable(t):
    p = (F.col("doc_id") * 7919 % 1000) / 1000
    return t("documents").join(t("labels"), "doc_id").select(p.alias("probability"), F.col("quality").alias("label"))


@query(_PROBABLE + """, b AS (SELECT least(9, len(list_filter(range(1, 10), lambda k: probability >= k / 10.0::DOUBLE))) AS bin, count(*) AS n, avg(probability) AS mp, avg(label) AS pr FROM p GROUP BY 1)
SELECT CAST(k AS INTEGER) AS bin, round(k / 10.0, 6) AS lo, round((k + 1) / 10.0, 6) AS hi, coalesce(n, 0) AS n, round(mp, 6) AS mean_probability, round(pr, 6) AS positive_rate
FROM range(10) r(k) LEFT JOIN b ON b.bin = k""")
def calibration_bins(t):
    return rounded(M.calibration_bins(_probable(t)), "lo", "hi", "mean_probability", "positive_rate")


@query(_PROBABLE + """, b AS (SELECT least(9, len(list_filter(range(1, 10), lambda k: probability >= k / 10.0::DOUBLE))) AS bin, count(*) AS n, avg(probability) AS mp, avg(label) AS pr FROM p GROUP BY 1)
SELECT round((SELECT sum(n * abs(mp - pr)) / sum(n) FROM b), 6) AS ece, round(avg((probability - label) ** 2), 6) AS brier,
  round(-avg(CASE WHEN label = 1 THEN ln(least(greatest(probability, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(probability, 1e-15), 1 - 1e-15)) END), 6) AS nll FROM p""")
def calibration_summary(t):
    return rounded(M.calibration_summary(_probable(t)), "ece", "brier", "nll")


@query("""
WITH g AS (SELECT a / 10.0::DOUBLE AS a, b / 10.0::DOUBLE AS b, (10 - a - b) / 10.0::DOUBLE AS c FROM range(11) x(a), range(11) y(b) WHERE a + b <= 10
), r AS (SELECT (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS s1, (doc_id * 104729 % 1000) / 1000.0::DOUBLE AS s2, quality::DOUBLE AS s3, toxic AS label FROM labels
), l AS (SELECT a, b, c, round(avg(((a * s1 + b * s2 + c * s3) / (a + b + c) - label) ** 2) + 1e-3 * (a * a + b * b + c * c), 9) AS loss FROM g, r GROUP BY a, b, c)
SELECT concat_ws(',', CAST(a * 10 AS INT), CAST(round(b * 10) AS INT), CAST(round(c * 10) AS INT)) AS weights, round(loss, 6) AS loss FROM l ORDER BY l.loss, a, b, c LIMIT 1
""")
def fusion_simplex(t):
    score = lambda k: (F.col("doc_id") * k % 1000) / 1000
    rows = t("labels").select(F.array(score(7919), score(104729), F.col("quality").cast("double")).alias("scores"), F.col("toxic").alias("label"))
    best = M.fit_simplex(rows, 3)
    text = F.array_join(F.transform("weights", lambda w: F.round(w * 10).cast("int").cast("string")), ",")
    return best.select(text.alias("weights"), F.round("loss", 6).alias("loss"))


_OOF = """WITH k AS (SELECT doc_id, CAST((row_number() OVER (ORDER BY sha256('oof' || chr(31) || doc_id), doc_id) - 1) % 3 AS BIGINT) AS fold FROM labels
), r AS (SELECT doc_id, fold, quality AS y, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS s1, (doc_id * 104729 % 1000) / 1000.0::DOUBLE AS s2, toxic::DOUBLE AS s3,
  CASE WHEN doc_id % 50 = 0 THEN 0 ELSE greatest((doc_id % 11) / 10.0::DOUBLE, 0.05) END AS e1, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS e2, CASE WHEN doc_id % 50 = 0 THEN 0 ELSE 0.5 END AS e3
  FROM labels JOIN k USING (doc_id)
), g AS (SELECT a / 10.0::DOUBLE AS a, b / 10.0::DOUBLE AS b, (10 - a - b) / 10.0::DOUBLE AS c FROM range(11) x(a), range(11) y(b) WHERE a + b <= 10
), p AS (SELECT fold, y, a, b, c, a * e1 + b * e2 + c * e3 AS t, (a * e1 * s1 + b * e2 * s2 + c * e3 * s3) AS v FROM r, g WHERE e1 + e2 + e3 > 0
), l AS (SELECT f, a, b, c, (avg((v / t - y) ** 2) FILTER (y = 1) + avg((v / t - y) ** 2) FILTER (y = 0)) / 2 AS brier,
    count(*) AS n, (a - 1 / 3) ** 2 + (b - 1 / 3) ** 2 + (c - 1 / 3) ** 2 AS away
  FROM p, (SELECT 0::BIGINT AS f UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT NULL) WHERE fold IS DISTINCT FROM f GROUP BY f, a, b, c HAVING min(t) > 0
), w AS (SELECT f AS fold, a, b, c, round(brier + 1e-3 * away, 9) AS loss, brier, n FROM l
  QUALIFY row_number() OVER (PARTITION BY f ORDER BY round(brier + 1e-3 * away, 9), round(away, 12), a, b, c) = 1)
"""


def _oof(t):
    """Three channels with gaps: quality of the first, none of the second for every fifth row, no channel for
    every fiftieth."""
    score = lambda k: (F.col("doc_id") * k % 1000) / 1000
    every = lambda k: F.col("doc_id") % k == 0
    rows = P.hash_folds(t("labels"), "doc_id", 3, "oof").select(
        "doc_id", F.col("fold").cast("long").alias("fold"), F.col("quality").alias("label"),
        F.array(score(7919), F.when(~every(5), score(104729)), F.col("toxic").cast("double")).alias("scores"),
        F.array(~every(50), F.lit(True), ~every(50)).alias("available"),
        F.array(F.col("doc_id") % 11 / 10, F.lit(1.0), F.lit(0.5)).alias("quality"),
    )
    return rows, U.oof_weights(rows, 3, resolution=10, l2=1e-3, floor=0.05, balanced=True)


@query(_OOF + "SELECT fold, concat_ws(',', CAST(round(a * 10) AS INT), CAST(round(b * 10) AS INT), CAST(round(c * 10) AS INT)) AS weights, round(loss, 7) AS loss, round(brier, 7) AS brier, n AS rows FROM w")
def oof_fusion_weights(t):
    """Weights of each fold fitted on the others, classes weighing the same, and of all folds."""
    text = F.array_join(F.transform("weights", lambda w: F.round(w * 10).cast("int").cast("string")), ",")
    return rounded(_oof(t)[1].withColumn("weights", text), "loss", "brier", digits=7)


@query(_OOF + "SELECT doc_id, r.fold, round(CASE WHEN a * e1 + b * e2 + c * e3 > 0 THEN (a * e1 * s1 + b * e2 * s2 + c * e3 * s3) / (a * e1 + b * e2 + c * e3) END, 6) AS fused FROM r JOIN w USING (fold)")
def oof_fusion_scores(t):
    """Every row by the weights of the fold that did not see it; null where no channel is left."""
    return rounded(U.oof_scores(*_oof(t), floor=0.05), "fused").select("doc_id", "fold", "fused")


@query("""SELECT doc_id, round(CASE WHEN w > 0 THEN v / w END, 6) AS fused FROM (
  SELECT doc_id, 0.5 * greatest((doc_id % 11) / 10.0, 0.05) * s1 + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 0.5 * greatest((doc_id % 7) / 10.0, 0.05) * s2 END AS v,
    0.5 * greatest((doc_id % 11) / 10.0, 0.05) + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 0.5 * greatest((doc_id % 7) / 10.0, 0.05) END AS w
  FROM (SELECT doc_id, (doc_id * 7919 % 1000) / 1000.0 AS s1, (doc_id * 104729 % 1000) / 1000.0 AS s2 FROM labels))""")
def fusion_scores(t):
    score = lambda k: (F.col("doc_id") * k % 1000) / 1000
    value = M.fused(
        F.array(score(7919), score(104729)), F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(True), F.col("doc_id") % 3 != 0),
        F.array(F.col("doc_id") % 11 / 10, F.col("doc_id") % 7 / 10),
    )
    return t("labels").select("doc_id", F.round(value, 6).alias("fused"))


@query("""WITH k(channel, kx, ky) AS (VALUES (0, 0.0::DOUBLE, 0.1::DOUBLE), (0, 500.0, 0.5), (0, 900.0, 0.9), (1, 100.0, 0.0), (1, 800.0, 1.0)),
r AS (SELECT doc_id, CAST(doc_id % 2 AS INT) AS channel, (doc_id * 7919 % 1000)::DOUBLE AS x FROM documents),
j AS (SELECT r.*, arg_max(k.kx, k.kx) FILTER (k.kx <= x) AS lx, arg_max(k.ky, k.kx) FILTER (k.kx <= x) AS ly, arg_min(k.kx, k.kx) FILTER (k.kx > x) AS ux, arg_min(k.ky, k.kx) FILTER (k.kx > x) AS uy
  FROM r JOIN k USING (channel) GROUP BY ALL)
SELECT doc_id, channel, x, round(CASE WHEN lx IS NULL THEN uy WHEN ux IS NULL THEN ly ELSE ly + (x - lx) * (uy - ly) / (ux - lx) END, 6) AS y FROM j""")
def calibrator_interpolation(t):
    d = t("documents")
    knots = d.sparkSession.createDataFrame(
        [(0, 0.0, 0.1), (0, 500.0, 0.5), (0, 900.0, 0.9), (1, 100.0, 0.0), (1, 800.0, 1.0)], "channel int, kx double, ky double"
    )
    rows = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("channel"), (F.col("doc_id") * 7919 % 1000).cast("double").alias("x"))
    return rounded(M.interpolated(rows, knots), "y").select("doc_id", "channel", "x", "y")


_RETRIEVAL_VALUES = _OUTCOMES + """, m AS (
  SELECT query_id, label AS cluster, unnest(['rank_1', 'rank_5', 'mrr', 'map', 'minp']) AS metric,
    unnest([CASE WHEN n > 0 THEN (f <= 1)::INT::DOUBLE END, CASE WHEN n > 0 THEN (f <= 5)::INT::DOUBLE END, CASE WHEN n > 0 THEN 1 / f END, coalesce(ap, 0), CASE WHEN n > 0 THEN inp END]) AS v
  FROM o JOIN embeddings ON vec_id = query_id
)"""

_INTERVALS = """, c AS (SELECT cluster, metric, sum(v) AS s, count(v) AS n FROM m GROUP BY ALL
), k AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS k FROM (SELECT DISTINCT cluster FROM m)
), rates AS (SELECT r, metric, sum(s) / sum(n) AS rate FROM d JOIN k USING (k) JOIN c USING (cluster) GROUP BY ALL
), i AS (SELECT metric, rate, row_number() OVER (PARTITION BY metric ORDER BY rate) AS i FROM rates WHERE rate IS NOT NULL
), b AS (SELECT metric, {} FROM i GROUP BY metric)
SELECT metric, round(sum(s) / sum(n), 7) AS estimate, CAST(sum(n) AS BIGINT) AS rows, round(any_value(lo), 7) AS lo, round(any_value(hi), 7) AS hi, count(*) AS clusters
FROM c JOIN b USING (metric) GROUP BY metric"""

_DRAWS = ", d AS (SELECT r, ('0x' || substr(sha256('7|' || r || '|' || i), 1, 12))::BIGINT % (SELECT count(DISTINCT cluster) FROM m) AS k FROM range({0}) x(r), range((SELECT count(DISTINCT cluster) FROM m)) y(i))"


@query(_RETRIEVAL_VALUES + _DRAWS.format(200) + _INTERVALS.format("max(rate) FILTER (i = 5) AS lo, max(rate) FILTER (i = 195) AS hi"))
def bootstrap_retrieval(t):
    """Intervals of rank-1, rank-5, MRR, mAP and mINP: whole identities are drawn."""
    own = t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("cluster"))
    rows = M.outcome_values(_outcomes(t)).join(own, "query_id")
    return rounded(B.bootstrap_intervals(rows, "cluster", ["rank_1", "rank_5", "mrr", "map", "minp"]), "estimate", "lo", "hi", digits=7)


@query("""WITH m AS (SELECT o_custkey AS cluster, unnest(['open', 'price']) AS metric,
    unnest([(o_orderstatus = 'O')::INT::DOUBLE, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice::DOUBLE END]) AS v FROM orders
), z AS (SELECT count(DISTINCT cluster) AS z FROM m
), f AS (SELECT r, ('0x' || substr(sha256('7|' || r || '|' || i), 1, 12))::BIGINT % z // 64 AS b FROM z, range(50) x(r), range((SELECT z FROM z)) y(i)
), g AS (SELECT r, b, unnest(range(count(*))) AS j FROM f GROUP BY r, b
), d AS (SELECT r, b * 64 + ('0x' || substr(sha256('7|' || r || '|' || b || '|' || j), 1, 12))::BIGINT % least(64, z - b * 64) AS k FROM g, z)"""
       + _INTERVALS.format("max(rate) FILTER (i = 2) AS lo, max(rate) FILTER (i = 49) AS hi"))
def bootstrap_in_blocks(t):
    """Customers drawn in blocks of 64: draws are counted by block, then made within each."""
    price = F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice").cast("double"))
    rows = t("orders").select(F.col("o_custkey").alias("cluster"), (F.col("o_orderstatus") == "O").cast("double").alias("open"), price.alias("price"))
    return rounded(B.bootstrap_intervals(rows, "cluster", ["open", "price"], resamples=50, block=64), "estimate", "lo", "hi", digits=7)


def _halves(part: str) -> str:
    cosine_ = "round(list_cosine_similarity(list_slice(q.embedding::DOUBLE[], {0}), list_slice(g.embedding::DOUBLE[], {0})), 6)"
    return f"""s{part} AS (SELECT q.vec_id AS query_id, q.label = g.label AS rel, g.vec_id AS template_id, {cosine_.format("1, 32" if part == "l" else "33, 64")} AS score
  FROM embeddings q JOIN embeddings g ON q.vec_id % 5 = 0 AND g.vec_id % 5 <> 0
), h{part} AS (SELECT query_id, rel, row_number() OVER w AS rank, sum(rel::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM s{part} WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, template_id)
), out_{part} AS (SELECT query_id, count(*) FILTER (rel) AS n, min(rank) FILTER (rel) AS f, avg(hits / rank) FILTER (rel) AS ap FROM h{part} GROUP BY query_id)"""


@query(f"WITH {_halves('l')}, {_halves('r')}" + """, m AS (SELECT label AS cluster, unnest(['rank_1', 'map']) AS metric,
    unnest([CASE WHEN l.n > 0 AND r.n > 0 THEN (l.f <= 1)::INT - (r.f <= 1)::INT END, coalesce(l.ap, 0) - coalesce(r.ap, 0)]) AS v FROM out_l l JOIN out_r r USING (query_id) JOIN embeddings ON vec_id = query_id
)""" + _DRAWS.format(200) + _INTERVALS.format("quantile_cont(rate, 0.025) AS lo, quantile_cont(rate, 0.975) AS hi"))  # fmt: skip
def paired_retrieval_delta(t):
    """What the first half of the vectors gains over the second, query by query, on the same draws."""
    own = t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("cluster"))

    def values(begin):
        q, g = (x.withColumn("vector", F.slice("vector", begin, 32)) for x in _named(t))
        return M.outcome_values(X.relevance_outcomes(q, g)).join(own, "query_id")

    found = B.paired_intervals(values(1), values(33), "query_id", "cluster", ["rank_1", "map"], resamples=200)
    return rounded(found, "estimate", "lo", "hi", digits=7)


def _bootstrap_sql(bounds: str) -> str:
    return f"""
WITH c AS (SELECT l_suppkey % 50 AS cluster, count(*) FILTER (l_returnflag = 'R') AS events, count(*) AS trials FROM lineitem GROUP BY 1
), n AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS k FROM c
), d AS (SELECT r, ('0x' || substr(sha256('7|' || r || '|' || i), 1, 12))::BIGINT % (SELECT count(*) FROM n) AS k FROM range(200) x(r), range((SELECT count(*) FROM n)) y(i)
), rates AS (SELECT r, sum(events) / sum(trials) AS rate FROM d JOIN n USING (k) GROUP BY r
), o AS (SELECT rate, row_number() OVER (ORDER BY rate) AS i FROM rates)
SELECT round((SELECT sum(events) / sum(trials) FROM c), 9) AS estimate, {bounds}"""


def _clusters(t):
    rows = t("lineitem").groupBy((F.col("l_suppkey") % 50).alias("cluster"))
    return rows.agg(F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("events"), F.count("*").alias("trials"))


@query(_bootstrap_sql("round((SELECT rate FROM o WHERE i = 5), 9) AS lo, round((SELECT rate FROM o WHERE i = 195), 9) AS hi"))
def bootstrap_order_statistic(t):
    return rounded(B.cluster_bootstrap(_clusters(t)), "estimate", "lo", "hi", digits=9)


@query(_bootstrap_sql("round((SELECT quantile_cont(rate, 0.025) FROM rates), 9) AS lo, round((SELECT quantile_cont(rate, 0.975) FROM rates), 9) AS hi"))
def bootstrap_quantile(t):
    return rounded(B.cluster_bootstrap(_clusters(t), interpolate=True), "estimate", "lo", "hi", digits=9)


@query("""
WITH c AS (SELECT s_nationkey AS nation, count(*) FILTER (s_acctbal < 0) AS events, count(*) AS trials FROM supplier GROUP BY 1
), z AS (SELECT *, 1.959963984540054 AS z, events / trials AS p FROM c)
SELECT nation, events, trials, round(greatest(0, ((p + z * z / (2 * trials)) - z * sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))) / (1 + z * z / trials)), 6) AS lo,
  round(least(1, ((p + z * z / (2 * trials)) + z * sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))) / (1 + z * z / trials)), 6) AS hi,
  round(1 - 0.05 ** (1 / trials), 6) AS zero_upper FROM z
""")
def binomial_intervals(t):
    rows = t("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.count(F.when(F.col("s_acctbal") < 0, 1)).alias("events"), F.count("*").alias("trials")
    )
    lo, hi = S.wilson(F.col("events"), F.col("trials"))
    return rounded(rows.withColumns({"lo": lo, "hi": hi, "zero_upper": S.zero_event_upper(F.col("trials"))}), "lo", "hi", "zero_upper")


@query("""
WITH RECURSIVE n AS (SELECT c_nationkey AS nation, count(*) AS trials FROM customer GROUP BY 1), t(nation, trials, k, term, total) AS (
  SELECT nation, trials, 0, 0.9::DOUBLE ** trials, 0.9::DOUBLE ** trials FROM n
  UNION ALL SELECT nation, trials, k + 1, term * (trials - k) / (k + 1) / 9, total + term * (trials - k) / (k + 1) / 9 FROM t WHERE k < trials)
SELECT n.nation, n.trials, CAST(coalesce(max(k), -1) AS BIGINT) AS allowed FROM n LEFT JOIN t ON t.nation = n.nation AND total <= 0.05 GROUP BY 1, 2
""")
def binomial_allowed_accepts(t):
    """For each nation's count of customers as trials."""
    rows = t("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("trials"))
    return rows.select("nation", "trials", S.allowed_accepts(F.col("trials"), 0.1, 0.05).cast("long").alias("allowed"))


@query("""WITH n AS (SELECT s_nationkey AS nation, count(*) AS suppliers, 0.001 * (1 + s_nationkey) AS rate FROM supplier GROUP BY 1)
SELECT nation, suppliers, CAST(ceil(round(ln(0.05) / ln(1 - rate), 9)) AS BIGINT) AS needed FROM n""")
def zero_event_trials(t):
    """Trials without an event that bound each nation's rate with 95 % confidence."""
    rows = t("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return rows.select("nation", "suppliers", S.trials_for_zero_events(0.001 * (1 + F.col("nation"))).cast("long").alias("needed"))


@query("""WITH b AS (SELECT o_orderkey, o_custkey % 500 AS x, o_orderkey % 300 AS y, 10 + o_orderkey % 200 AS w, 5 + o_custkey % 150 AS h FROM orders),
c AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy, greatest(w, h) * 0.75 AS r FROM b)
SELECT o_orderkey, CAST(trunc(greatest(0, least(640, cx - r))) AS INTEGER) AS x1, CAST(trunc(greatest(0, least(480, cy - r))) AS INTEGER) AS y1,
  CAST(trunc(greatest(0, least(640, cx + r))) AS INTEGER) AS x2, CAST(trunc(greatest(0, least(480, cy + r))) AS INTEGER) AS y2 FROM c""")
def square_boxes(t):
    """Boxes widened by half to squares within an image of 640 by 480."""
    x, y = F.col("o_custkey") % 500, F.col("o_orderkey") % 300
    box = (x, y, x + 10 + F.col("o_orderkey") % 200, y + 5 + F.col("o_custkey") % 150)
    square = S.square_box(box, 1.5, 640, 480)
    return t("orders").select("o_orderkey", *[c.alias(n) for c, n in zip(square, ("x1", "y1", "x2", "y2"), strict=True)])


@query("""SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def pair_similarity(t):
    e = t("embeddings")
    other = e.select((F.col("vec_id") - 1).alias("left_id"), F.col("vec_id").alias("right_id"), as_double("embedding").alias("v"))
    both = e.select(F.col("vec_id").alias("left_id"), as_double("embedding").alias("u")).join(other, "left_id")
    return both.select("left_id", "right_id", F.round(cosine(F.col("u"), F.col("v")), 6).alias("similarity"))


@query(_SCORES + """SELECT query_id, template_id, round(CASE WHEN stddev_pop(score) OVER w > 1e-12 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END, 5) AS z FROM s
WINDOW w AS (PARTITION BY query_id)""")
def score_zscores(t):
    return X.score_zscores(*_named(t)).withColumn("z", F.round("z", 5))


@query("""WITH p AS (SELECT doc_id % 2 AS channel, (doc_id * 7919 % 100) / 100.0::DOUBLE AS x, quality AS y FROM labels
), d AS (SELECT channel, x, count(*) AS w, sum(y) AS s, row_number() OVER (PARTITION BY channel ORDER BY x) AS i FROM p GROUP BY channel, x
), c AS (SELECT *, sum(s) OVER v AS cs, sum(w) OVER v AS cw FROM d WINDOW v AS (PARTITION BY channel ORDER BY i)
), m AS (SELECT a.channel, a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM c a JOIN c b ON b.channel = a.channel AND b.i >= a.i
), n AS (SELECT channel, b, min(m) OVER (PARTITION BY channel, a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS m FROM m
), k AS (SELECT n.channel, x AS kx, max(m) AS ky FROM n JOIN c ON c.channel = n.channel AND c.i = n.b GROUP BY n.channel, x
), r AS (SELECT doc_id, doc_id % 2 AS channel, (doc_id * 104729 % 1200) / 1000.0::DOUBLE - 0.1 AS x FROM documents
), j AS (SELECT doc_id, r.channel, x, arg_max(kx, kx) FILTER (kx <= x) AS lx, arg_max(ky, kx) FILTER (kx <= x) AS ly, arg_min(kx, kx) FILTER (kx > x) AS ux, arg_min(ky, kx) FILTER (kx > x) AS uy
  FROM r JOIN k USING (channel) GROUP BY ALL)
SELECT doc_id, channel, round(CASE WHEN lx IS NULL THEN uy WHEN ux IS NULL THEN ly ELSE ly + (x - lx) * (uy - ly) / (ux - lx) END, 6) AS calibrated FROM j""")
def calibrator_channels(t):
    """One isotonic calibrator a channel, and scores of all documents through it, beyond its ends too."""
    knots = U.channel_calibrators(
        t("labels").select((F.col("doc_id") % 2).alias("channel"), (F.col("doc_id") * 7919 % 100 / 100).alias("score"), F.col("quality").alias("label"))
    )
    rows = t("documents").select("doc_id", (F.col("doc_id") % 2).alias("channel"), (F.col("doc_id") * 104729 % 1200 / 1000 - 0.1).alias("x"))
    return U.calibrated(rows, knots).select("doc_id", "channel", F.round("y", 6).alias("calibrated"))


@query(_PROBABLE + """, d AS (SELECT probability AS score, count(*) AS w, sum(label) AS s, row_number() OVER (ORDER BY probability) AS i FROM p GROUP BY 1
), c AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw FROM d), m AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM c a JOIN c b ON b.i >= a.i
), n AS (SELECT b, min(m) OVER (PARTITION BY a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS m FROM m)
SELECT score, round(max(m), 6) AS probability FROM n JOIN c ON c.i = n.b GROUP BY score""")
def calibrator_isotonic(t):
    """Isotonic calibration of a score by MLlib."""
    rows = _probable(t).select(F.col("probability").alias("score"), "label")
    model = M.isotonic(rows)
    return model.transform(rows.select("score").distinct()).select("score", F.round("prediction", 6).alias("probability"))


