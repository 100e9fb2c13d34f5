"""Adjudication, bindings, panels, controls and capacity queries; extractors over text."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.functions.vectors import as_double
from loomfield.operators import evidence as E
from loomfield.operators import extraction as X
from loomfield.plans.registering import query, rounded

_PAIRS = """
WITH p AS (SELECT o_orderkey AS left_id, o_orderkey + 1 AS right_id FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey + 1 IN (SELECT o_orderkey FROM orders)
), x AS (SELECT left_id, right_id FROM p WHERE left_id % 14 = 0), r AS (SELECT left_id, right_id, CASE left_id % 3 WHEN 0 THEN 'CONFIRM' WHEN 1 THEN 'REJECT' ELSE 'OPEN' END AS verdict FROM p WHERE left_id % 10 = 0
), g AS (SELECT left_id, right_id, left_id % 4 = 0 AS admitted FROM p WHERE left_id % 6 = 0), i AS (SELECT o_orderkey AS id, o_custkey % 20 AS identity FROM orders)
"""


def _pairs(t):
    o = t("orders").select("o_orderkey")
    p = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("left_id"), (F.col("o_orderkey") + 1).alias("right_id"))
    p = p.join(o.select(F.col("o_orderkey").alias("right_id")), "right_id", "left_semi")
    verdict = F.when(F.col("left_id") % 3 == 0, "CONFIRM").when(F.col("left_id") % 3 == 1, "REJECT").otherwise("OPEN")
    exact = p.filter("left_id % 14 = 0")
    reviews = p.filter("left_id % 10 = 0").withColumn("verdict", verdict)
    geometry = p.filter("left_id % 6 = 0").withColumn("admitted", F.col("left_id") % 4 == 0)
    identities = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("identity"))
    return p, exact, identities, reviews, geometry


@query(_PAIRS + """SELECT p.left_id, p.right_id, CASE WHEN x.left_id IS NOT NULL THEN 'EXACT_CONFIRMED' WHEN a.identity = b.identity THEN 'SAME_IDENTITY' WHEN verdict = 'CONFIRM' THEN 'REVIEW_CONFIRMED'
  WHEN verdict = 'REJECT' THEN 'REVIEW_REJECTED' WHEN verdict IS NOT NULL THEN 'REVIEW_UNRESOLVED' WHEN admitted THEN 'GEOMETRIC_CONFIRMED' WHEN admitted IS NOT NULL THEN 'GEOMETRIC_UNADMITTED' ELSE 'UNRESOLVED' END AS outcome
FROM p LEFT JOIN x USING (left_id, right_id) LEFT JOIN r USING (left_id, right_id) LEFT JOIN g USING (left_id, right_id) LEFT JOIN i a ON a.id = p.left_id LEFT JOIN i b ON b.id = p.right_id""")
def adjudication(t):
    return E.adjudicated(*_pairs(t))


@query(_PAIRS + "SELECT left_id, right_id FROM x JOIN r USING (left_id, right_id) WHERE verdict = 'REJECT'")
def adjudication_contradictions(t):
    p, exact, _, reviews, _ = _pairs(t)
    return E.contradictions(p, exact, reviews)


@query(_PAIRS + """, l AS (SELECT left_id, right_id, 'EXACT' AS k FROM x UNION ALL SELECT left_id, right_id, 'REVIEW' FROM r UNION ALL SELECT left_id, right_id, 'GEOMETRY' FROM g)
SELECT left_id, right_id, string_agg(DISTINCT k, ',' ORDER BY k) AS kinds FROM l GROUP BY 1, 2""")
def evidence_kinds(t):
    _, exact, _, reviews, geometry = _pairs(t)
    return E.gathered({"EXACT": exact, "REVIEW": reviews, "GEOMETRY": geometry})


@query("""SELECT least(o_orderkey, o_custkey) AS left_id, greatest(o_orderkey, o_custkey) AS right_id FROM orders""")
def dependency_edges(t):
    """An edge for each row that names another one."""
    return E.ordered(t("orders"), "o_orderkey", "o_custkey").select("left_id", "right_id")


@query("""WITH a AS (SELECT o_custkey AS k, min(o_orderstatus) AS role, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1)
SELECT k AS c_custkey, role, c_mktsegment AS dataset, CASE WHEN n > 1 THEN 'CONFLICT' WHEN c_custkey IS NOT NULL THEN 'BOUND' ELSE 'UNREGISTERED' END AS state FROM a LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = k""")
def registry_binding(t):
    assigned = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("role"))
    registry = t("customer").filter("c_custkey % 5 <> 0").select("c_custkey", F.col("c_mktsegment").alias("dataset"))
    return E.bindings(assigned, registry, "c_custkey")


@query("""WITH s AS (SELECT l_shipdate::DATE AS d, l_orderkey AS pair, CASE l_linenumber WHEN 1 THEN 'ORIGINAL' WHEN 2 THEN 'BLUR' ELSE 'CROP' END AS kind, l_linenumber AS n, l_orderkey % 2 AS label, l_orderkey % 5 AS panel, l_extendedprice AS score FROM lineitem WHERE l_linenumber <= 3)
SELECT a.panel, a.kind, a.label, count(*) AS pairs, round(avg(a.score - o.score), 7) AS delta FROM s a JOIN s o ON a.panel = o.panel AND a.pair = o.pair AND a.kind <> 'ORIGINAL' AND o.kind = 'ORIGINAL' GROUP BY 1, 2, 3""")
def control_deltas(t):
    n = F.col("l_linenumber")
    rows = t("lineitem").filter(n <= 3).select(
        (F.col("l_orderkey") % 5).alias("panel"), F.col("l_orderkey").alias("pair"), F.when(n == 1, "ORIGINAL").when(n == 2, "BLUR").otherwise("CROP").alias("kind"),
        (F.col("l_orderkey") % 2).alias("label"), F.col("l_extendedprice").alias("score"),
    )
    return rounded(E.control_deltas(rows), "delta", digits=7)


@query("""WITH o AS (SELECT o_custkey, o_orderpriority AS c, min((sha256('panel' || chr(31) || o_orderkey), o_orderkey)) AS b FROM orders GROUP BY 1, 2
), r AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY b[1], b[2]) AS r FROM o)
SELECT o_custkey, CASE WHEN r = 1 THEN 'QUERY' ELSE 'GALLERY' END AS role, b[2] AS o_orderkey, CAST(r - 1 AS INTEGER) AS place FROM r WHERE n > 3 AND r <= 4""")
def gallery_panels(t):
    return E.panels(t("orders"), "o_custkey", "o_orderpriority", "o_orderkey", 3, "panel")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 86400000000 AS day FROM orders), f AS (SELECT *, min(day) OVER (PARTITION BY o_custkey) AS f FROM o
), r AS (SELECT *, CASE WHEN day = f THEN 'GALLERY' WHEN day >= f + 365 THEN 'QUERY' END AS role FROM f), n AS (SELECT *, count(*) FILTER (role = 'QUERY') OVER (PARTITION BY o_custkey) AS n FROM r)
SELECT o_custkey, o_orderkey, day, role FROM n WHERE n >= 4 AND role IS NOT NULL""")
def temporal_plan(t):
    rows = t("orders").select("o_custkey", "o_orderkey", F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400).alias("day"))
    return E.spaced(rows, "o_custkey", "day", 365, 4)


@query("""SELECT label * 100 + vec_id % 20 AS repeat, count(*) AS n, round(stddev_pop(ln(1 + abs(embedding[1]::DOUBLE))), 6) AS log_length_std FROM embeddings GROUP BY 1 HAVING count(*) > 1""")
def repeat_noise(t):
    rows = t("embeddings").withColumn("repeat", F.col("label") * 100 + F.col("vec_id") % 20)
    return rounded(E.repeat_noise(rows, "repeat", 1 + F.abs(as_double("embedding")[0])), "log_length_std")


@query("""WITH r AS (SELECT l_suppkey, l_quantity AS v, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_linenumber END AS w FROM lineitem), p AS (
  SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v) AS run, sum(w) OVER (PARTITION BY l_suppkey) AS a, sum(v * w) OVER (PARTITION BY l_suppkey) / sum(w) OVER (PARTITION BY l_suppkey) AS m FROM r WHERE w > 0)
SELECT l_suppkey, min(v) FILTER (run >= a / 2) AS median, round(sum(w * (v - m) ** 2) / sum(w), 5) AS variance, count(*) AS n FROM p GROUP BY 1""")
def weighted_medians(t):
    w = F.when(F.col("l_linenumber") % 4 == 0, 0).otherwise(F.col("l_linenumber"))
    rows = t("lineitem").select("l_suppkey", F.col("l_quantity").alias("v"), w.alias("w"))
    return rounded(E.weighted_medians(rows, ["l_suppkey"], "v", "w"), "variance", digits=5)


@query("""WITH b AS (SELECT s_nationkey, sum(s_acctbal * 0.001) AS busy FROM supplier GROUP BY 1) SELECT n_name AS resource, round(coalesce(busy, 0) / (n_regionkey + 1), 6) AS load FROM nation LEFT JOIN b ON s_nationkey = n_nationkey""")
def capacity_loads(t):
    names = t("nation").select(F.col("n_name").alias("resource"), (F.col("n_regionkey") + 1).alias("units"), "n_nationkey")
    stages = t("supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).select("resource", F.col("s_acctbal").alias("rate"), F.lit(0.001).alias("seconds"))
    return rounded(E.resource_loads(stages, names), "load")


@query("""WITH r AS (SELECT o_custkey AS q, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS b FROM orders
), f AS (SELECT q, a, b FROM r QUALIFY row_number() OVER (PARTITION BY q ORDER BY k) = 1) SELECT count(*) AS queries, count(*) FILTER (a > 1 AND b = 1) AS rescues, count(*) FILTER (a = 1 AND b > 1) AS breaks FROM f""")
def rescues_and_breaks(t):
    from pyspark.sql import Window as W

    own = W.partitionBy("o_custkey")
    r = t("orders").select(
        F.col("o_custkey").alias("query_id"), "o_orderkey", F.row_number().over(own.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("a"),
        F.row_number().over(own.orderBy(F.desc("o_orderdate"), "o_orderkey")).alias("b"), F.row_number().over(own.orderBy("o_orderkey")).alias("f"),
    ).filter("f = 1")
    return E.rescues_and_breaks(r.select("query_id", F.col("a").alias("rank")), r.select("query_id", F.col("b").alias("rank")))


def _letters():
    def embed(texts):
        import numpy as np

        return [np.bincount(np.frombuffer(x.encode(), np.uint8) % 16, minlength=16) / len(x.encode()) if x else None for x in texts]

    return embed


def _lengths():
    return lambda texts: [[float(len(x)), float(len(x.split()))] for x in texts]


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN 'MISSING' WHEN text = '' THEN 'REJECTED' ELSE 'AVAILABLE' END AS letters, CASE WHEN text IS NULL THEN 'MISSING' ELSE 'AVAILABLE' END AS lengths,
  coalesce(text <> '', false) AS admitted, length(text)::DOUBLE AS chars FROM documents""")
def channel_extraction(t):
    """Two extractors over texts, one required: letter frequencies and lengths."""
    channels = [X.Channel("letters", 16, _letters), X.Channel("lengths", 2, _lengths, required=False)]
    out = X.extracted(t("documents"), "doc_id", "text", channels)
    return out.select("doc_id", F.col("status")["letters"].alias("letters"), F.col("status")["lengths"].alias("lengths"), "admitted", F.col("vectors")["lengths"][0].cast("double").alias("chars"))


@query("""WITH RECURSIVE n AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS block, [count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'O'), count(*) FILTER (o_orderstatus = 'P')] AS r,
    row_number() OVER (ORDER BY count(*) DESC, lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) AS k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
), t AS (SELECT [count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'O'), count(*) FILTER (o_orderstatus = 'P')] AS t FROM orders JOIN customer ON o_custkey = c_custkey
), g(k, have, block, role) AS (SELECT 0, [[0, 0, 0], [0, 0, 0], [0, 0, 0]]::BIGINT[][], NULL::VARCHAR, NULL::BIGINT UNION ALL
  SELECT k, list_transform(have, lambda h, j: CASE WHEN j = pick THEN list_transform(h, lambda x, i: x + r[i]) ELSE h END), block, pick FROM (
    SELECT n.k, g.have, n.block, n.r, list_min(list_transform([1, 2, 3], lambda j: {
      'e': round(list_sum(list_transform([1, 2, 3], lambda i: greatest(0.0, g.have[j][i] + n.r[i] - [0.15::DOUBLE, 0.15, 0.7][j] * t.t[i]))), 9), 'f': list_sum(g.have[j]) / [0.15::DOUBLE, 0.15, 0.7][j], 'j': j})).j AS pick
    FROM g JOIN n ON n.k = g.k + 1, t))
SELECT block, ['CAL', 'DEV', 'FIT'][role] AS role FROM g WHERE k > 0""")
def block_allocation(t):
    """Nations as blocks, order states as strata, placed to hold every role to its share."""
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "o_orderstatus").count().collect()
    blocks: dict[str, dict[str, int]] = {}
    for r in rows:
        blocks.setdefault(f"{r.c_nationkey:02d}", {})[r.o_orderstatus] = r["count"]
    roles = E.stratified_blocks(sorted(blocks.items()), {"FIT": 0.7, "DEV": 0.15, "CAL": 0.15})
    return t("orders").sparkSession.createDataFrame(sorted(roles.items()), "block string, role string")


