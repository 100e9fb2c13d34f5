"""Decision, exposure, promotion, cost and reliability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.operators import decisions as D
from loomfield.plans.registering import query, rounded


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'FAILED' ELSE 'OK' END AS s, (['NO_DOG', 'MULTIPLE_DOGS', 'UNCERTAIN', 'SINGLE_DOG', 'SINGLE_DOG'])[o_orderkey % 5 + 1] AS o,
  (['NO_USABLE_EVIDENCE', 'NOT_EVALUATED', 'USABLE'])[o_orderkey % 3 + 1] AS e, CASE WHEN o_orderkey % 7 = 0 THEN 'IDENTITY_CONFLICT' ELSE 'NONE' END AS c, (['KNOWN', 'UNKNOWN', 'REVIEW_REQUIRED'])[o_custkey % 3 + 1] AS v FROM orders)
SELECT CASE WHEN s = 'FAILED' THEN NULL WHEN o IN ('NO_DOG', 'MULTIPLE_DOGS') THEN o WHEN o = 'UNCERTAIN' THEN NULL WHEN e = 'NO_USABLE_EVIDENCE' THEN e WHEN e = 'NOT_EVALUATED' THEN 'DOG_PRESENT' WHEN c = 'IDENTITY_CONFLICT' THEN c ELSE v END AS status, count(*) AS n FROM o GROUP BY 1""")
def decision_status(t):
    k = F.col("o_orderkey")
    pick = lambda names, x: F.get(F.array(*map(F.lit, names)), x.cast("int"))
    status = D.projected_status(
        F.when(k % 17 == 0, "FAILED").otherwise("OK"),
        pick(["NO_DOG", "MULTIPLE_DOGS", "UNCERTAIN", "SINGLE_DOG", "SINGLE_DOG"], k % 5),
        pick(["NO_USABLE_EVIDENCE", "NOT_EVALUATED", "USABLE"], k % 3),
        F.when(k % 7 == 0, "IDENTITY_CONFLICT").otherwise("NONE"),
        pick(["KNOWN", "UNKNOWN", "REVIEW_REQUIRED"], F.col("o_custkey") % 3),
    )
    return t("orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'PROVISIONAL_KIND' WHEN o_custkey % 19 = 0 THEN 'KNOWN_PROVISIONAL' ELSE 'UNREGISTERED' END AS reason FROM orders
WHERE o_orderstatus = 'P' OR o_custkey % 19 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)""")
def policy_refusals(t):
    rows = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "P", "GENID").otherwise("REGISTERED").alias("kind"))
    c = t("customer").select("c_custkey")
    made = t("orders").filter("o_custkey % 19 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return D.refused(rows, c.filter("c_custkey % 4 <> 0"), made, "c_custkey", "kind").select("o_orderkey", "reason")


@query("""WITH e AS (SELECT o_custkey, arg_max(o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) AS stage, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS sources FROM orders GROUP BY 1)
SELECT o_custkey, stage, sources, CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 1 END >= CASE stage WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS allowed FROM e""")
def exposure_ledger(t):
    order = ["O", "P", "F"]
    e = D.exposure(t("orders"), "o_custkey", "o_orderstatus", "o_orderpriority", order)
    role = F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("P")
    return e.withColumn("allowed", D.allowed(role, F.col("stage"), order))


@query("""SELECT o_orderpriority, o_orderstatus, count(DISTINCT o_custkey) AS identities, sha256(string_agg(DISTINCT CAST(o_custkey AS VARCHAR), ',' ORDER BY CAST(o_custkey AS VARCHAR))) AS digest FROM orders GROUP BY 1, 2""")
def cohort_digests(t):
    return D.cohort_digests(t("orders"), ["o_orderpriority", "o_orderstatus"], "o_custkey")


@query("""SELECT user_id, event_id AS frame, round(value * sqrt(event_id % 13 + 1), 6) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value * sqrt(event_id % 13 + 1) DESC, event_id) AS INTEGER) AS place
FROM events WHERE value >= 50 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value * sqrt(event_id % 13 + 1) DESC, event_id) <= 3""")
def best_frames(t):
    rows = t("events").select("user_id", F.col("event_id").alias("frame"), F.col("value").alias("sharpness"), (F.col("event_id") % 13 + 1).alias("area"))
    return rounded(D.best_frames(rows, "user_id", 3, 50.0).select("user_id", "frame", "score", "place"), "score")


@query("""WITH m AS (SELECT l_suppkey, CASE WHEN l_linenumber <= 3 THEN 'PROTECTED' ELSE 'IMPROVEMENT' END AS kind, l_tax + 0.095 AS margin, l_discount - 0.05 AS lower, l_discount - 0.002 AS upper FROM lineitem
), f AS (SELECT l_suppkey, bool_or(kind = 'PROTECTED' AND lower > margin) AS w, bool_or(kind = 'PROTECTED' AND upper > margin) AS u, bool_or(kind = 'IMPROVEMENT' AND upper < 0) AS b, bool_or(kind = 'PROTECTED') AND bool_or(kind = 'IMPROVEMENT') AS c FROM m GROUP BY 1)
SELECT l_suppkey, CASE WHEN NOT c THEN 'INCONCLUSIVE' WHEN w THEN 'REJECT' WHEN u THEN 'INCONCLUSIVE' WHEN b THEN 'PROMOTE' ELSE 'INCONCLUSIVE' END AS decision FROM f""")
def promotion_decisions(t):
    rows = t("lineitem").select(
        "l_suppkey", F.when(F.col("l_linenumber") <= 3, "PROTECTED").otherwise("IMPROVEMENT").alias("kind"), (F.col("l_tax") + 0.095).alias("margin"),
        (F.col("l_discount") - 0.05).alias("lower"), (F.col("l_discount") - 0.002).alias("upper"),
    )
    return D.promotion(rows, ["l_suppkey"])


@query("""SELECT p_partkey, round(p_retailprice + p_size * 2.5 + (p_partkey % 7) * 0.25, 6) AS cost, round(CASE WHEN greatest(p_size % 5, p_size % 11) = 0 THEN 0 ELSE 1 - ((1 - 0.3) * (p_size % 5) + 0.3 * (p_size % 11)) / greatest(p_size % 5, p_size % 11) END, 6) AS saved FROM part""")
def pipeline_costs(t):
    size, k = F.col("p_size"), F.col("p_partkey")
    cost = D.total_cost([F.col("p_retailprice")], [(size, F.lit(2.5)), (k % 7, F.lit(0.25))])
    return rounded(t("part").select("p_partkey", cost.alias("cost"), D.call_reduction(size % 5, size % 11, F.lit(0.3)).alias("saved")), "cost", "saved")


@query("""WITH p AS (SELECT p_partkey, (p_partkey % 100) / 100.0 AS a, (p_partkey % 10) / 10.0 AS b, p_size::DOUBLE AS s FROM part)
SELECT p_partkey, round(greatest(0.02, least(1, a * (0.5 + 0.5 * sqrt(least(1, s / 64))))), 6) AS face, round(greatest(0.02, least(1, a * (0.25 + 0.75 * b) * (0.5 + 0.5 * a) * (0.35 + 0.65 * sqrt(least(1, s / 32))) * (0.6 + 0.4 * b))), 6) AS nose,
  round((a + b + (1 - (p_partkey % 2)) + least(1, greatest(s / 224, 2 * s / 224)) + 1 / greatest(p_partkey % 3, 1) + 0.5) / 6, 6) AS quality FROM p""")
def reliabilities(t):
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    a, b = k % 100 / 100, k % 10 / 10
    rows = t("part").select(
        "p_partkey", D.face_reliability(a, s).alias("face"), D.nose_reliability(a, b, s, b, a).alias("nose"),
        D.box_quality(a, b, k % 2 == 1, s, 2 * s, k % 3, F.lit(0.5)).alias("quality"),
    )
    return rounded(rows, "face", "nose", "quality")


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 50 AS x1, p_partkey % 30 AS y1, p_partkey % 50 + 10 + p_size AS x2, p_partkey % 30 + 20 AS y2 FROM part), q AS (SELECT *, greatest(x2 - x1, y2 - y1) AS side FROM p)
SELECT k AS p_partkey, round((x1 + x2) / 2 - (x2 - x1) * 0.2, 6) AS face_x1, round(y1 + (y2 - y1) * 0.3 - (y2 - y1) * 0.275, 6) AS face_y1,
  round(least(1, greatest(0, (x1 + 7 - x1 + (side - (x2 - x1)) // 2) / side)), 6) AS nx, round(least(1, greatest(0, (y1 + 9 - y1 + (side - (y2 - y1)) // 2) / side)), 6) AS ny FROM q""")
def crop_geometry(t):
    k = F.col("p_partkey")
    x1, y1, x2, y2 = k % 50, k % 30, k % 50 + 10 + F.col("p_size"), k % 30 + 20
    face = D.face_region(x1, y1, x2, y2)
    nx, ny = D.in_square_crop(x1 + 7, y1 + 9, x1, y1, x2, y2)
    return rounded(t("part").select("p_partkey", face[0].alias("face_x1"), face[1].alias("face_y1"), nx.alias("nx"), ny.alias("ny")), "face_x1", "face_y1", "nx", "ny")


@query()
def consensus_vectors(t):
    """Held against NumPy in the tests."""
    rows = t("embeddings").withColumn("q", F.col("vec_id") % 7 / 7)
    return rounded(D.consensus(rows, "embedding", "q", "label", "vec_id").select("label", "n", "accepted", "dispersion"), "dispersion")
