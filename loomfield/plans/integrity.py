"""Checks, views, assembled splits, quality scores and figure data."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.functions.vectors import as_double
from loomfield.operators import decisions as D
from loomfield.operators import diagnostics as G
from loomfield.operators import evidence as E
from loomfield.operators import integrity as I
from loomfield.operators import metrics as M
from loomfield.operators import search as X
from loomfield.operators import splits as P
from loomfield.operators import views as V
from loomfield.plans import evidence, panels, retrieval
from loomfield.plans.registering import query, rounded

# Vectors as cache entries: their digest is that of their components in steps of 1/256. Every 37th claims another digest,
# every 41st another size, every 43rd is not in the manifest, every 47th not in the cache.
_CACHE = """
WITH v AS (SELECT vec_id AS token, sha256(array_to_string(list_transform(embedding::DOUBLE[], lambda x: CAST(floor(256 * x) AS BIGINT)), ',')) AS digest,
  sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
), m AS (SELECT token, CASE WHEN token % 41 = 0 THEN 260 ELSE 256 END AS size, CASE WHEN token % 37 = 0 THEN 'other' ELSE digest END AS digest FROM v WHERE token % 43 <> 0
), s AS (SELECT * FROM v WHERE token % 47 <> 0), b AS (SELECT coalesce(m.token, s.token) AS token, m.size, m.digest AS md, s.digest AS sd, s.n, m.token AS mt, s.token AS st FROM m FULL JOIN s USING (token))
"""


def _cache(t):
    v, k = as_double("embedding"), F.col("vec_id")
    digest = F.sha2(F.array_join(F.transform(v, lambda x: F.floor(256 * x).cast("string")), ","), 256)
    rows = t("embeddings").select(k.alias("token"), digest.alias("digest"), v.alias("vector"), F.lit(256).cast("long").alias("size"))
    claimed = rows.filter("token % 43 <> 0").select(
        "token", F.when(F.col("token") % 41 == 0, 260).otherwise(256).cast("long").alias("size"), F.when(F.col("token") % 37 == 0, "other").otherwise(F.col("digest")).alias("digest")
    )
    return claimed, rows.filter("token % 47 <> 0")


@query(_CACHE + """SELECT token, 'MISSING' AS rule FROM b WHERE st IS NULL UNION ALL SELECT token, 'UNLISTED' FROM b WHERE mt IS NULL UNION ALL SELECT token, 'SIZE' FROM b WHERE st IS NOT NULL AND size <> 256
UNION ALL SELECT token, 'DIGEST' FROM b WHERE md <> sd UNION ALL SELECT token, 'NOT_UNIT' FROM b WHERE abs(n - 1) > 1e-7""")
def cache_breaches(t):
    return I.cache_breaches(*_cache(t), tolerance=1e-7)


@query(_CACHE + """, p AS (SELECT token, token * 256 AS o, token * 256 + size AS e FROM m), q AS (SELECT *, lag(e) OVER w AS b, lead(o) OVER w AS a FROM p WINDOW w AS (ORDER BY o, token))
SELECT token, 'GAP' AS rule FROM q WHERE o <> coalesce(b, 0) UNION ALL SELECT token, 'SHORT' FROM q WHERE a IS NULL AND e <> 100""")
def pack_breaches(t):
    claimed, _ = _cache(t)
    return I.pack_breaches(claimed.withColumn("offset", F.col("token") * 256), total=100)


# Pairs of orders next to each other: sessions are priorities, strata follow the customer.
_TRUTH = """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS s FROM orders), p AS (
  SELECT a.k AS pair_id, a.c % 500 AS query, a.s AS query_session, b.s AS reference_session, a.c % 3 = b.c % 3 AS same, CASE WHEN a.k % 4 = 0 THEN 'POSITIVE' ELSE 'NEAR' END AS stratum, b.c AS other
  FROM o a JOIN o b ON b.k = a.k + 1)
"""


def _truth(t):
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("s"))
    b = o.select((F.col("k") - 1).alias("k"), F.col("c").alias("other"), F.col("s").alias("reference_session"))
    return o.join(b, "k").select(
        F.col("k").alias("pair_id"), (F.col("c") % 500).alias("query"), F.col("s").alias("query_session"), "reference_session", (F.col("c") % 3 == F.col("other") % 3).alias("same"),
        F.when(F.col("k") % 4 == 0, "POSITIVE").otherwise("NEAR").alias("stratum"), "other",
    )


@query(_TRUTH + """, r AS (SELECT pair_id, query FROM p WHERE pair_id % 101 <> 0 UNION ALL SELECT pair_id, query FROM p WHERE pair_id % 97 = 0), j AS (SELECT * EXCLUDE (query), r.query FROM r JOIN p USING (pair_id)
), q AS (SELECT query, min(pair_id) AS pair_id, count(*) AS n, count(other) FILTER (stratum <> 'POSITIVE') AS neg, count(DISTINCT other) FILTER (stratum <> 'POSITIVE') AS d FROM j GROUP BY 1)
SELECT pair_id, 'REPEATED' AS rule FROM r GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT pair_id, 'UNMATCHED' FROM p WHERE pair_id NOT IN (SELECT pair_id FROM r)
UNION ALL SELECT pair_id, 'SESSION' FROM j WHERE query_session = reference_session UNION ALL SELECT pair_id, 'LABEL' FROM j WHERE (stratum = 'POSITIVE') <> same
UNION ALL SELECT pair_id, 'CAP' FROM q WHERE n > 12 UNION ALL SELECT pair_id, 'REUSED' FROM q WHERE neg > d""")
def pair_breaches(t):
    p = _truth(t)
    ids = p.select("pair_id", "query")
    requests = ids.filter("pair_id % 101 <> 0").union(ids.filter("pair_id % 97 = 0"))
    return I.pair_breaches(requests, p.drop("query"), 12)


@query(_TRUTH + "SELECT pair_id, query, query_session, reference_session FROM p")
def pairs_scoring_view(t):
    return V.blind(_truth(t))


@query(_TRUTH + "SELECT pair_id, same, stratum, other FROM p")
def pairs_truth_view(t):
    return V.labels_only(_truth(t), "pair_id")


@query("""SELECT 'KEY' AS kind, CAST(o_custkey AS VARCHAR) AS token, count(*) AS rows FROM orders GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'CAPTURE', CAST(o_orderdate::DATE AS VARCHAR), count(*) FROM orders GROUP BY 2 HAVING count(DISTINCT (o_orderstatus, o_orderpriority)) > 1""")
def record_breaches(t):
    rows = t("orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return I.record_breaches(rows, "o_custkey", "day", ["o_orderstatus", "o_orderpriority"])


@query("""SELECT doc_id, 'DIGEST' AS rule FROM documents WHERE doc_id % 7 = 0 AND text IS NOT NULL AND doc_id % 11 <> 0 UNION ALL SELECT doc_id, 'MISSING' FROM documents WHERE doc_id % 11 = 0""")
def binding_breaches(t):
    d = t("documents")
    claims = d.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("digest"))
    return I.binding_breaches(claims, d.filter("doc_id % 11 <> 0").select("doc_id", F.col("text").alias("payload")), "doc_id")


@query("""WITH r AS (SELECT n_name AS metric, CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 7 = 1 THEN 'inf'::DOUBLE ELSE n_nationkey / 10.0::DOUBLE END AS value, n_nationkey % 4 AS denominator, CASE WHEN n_nationkey % 3 = 0 THEN 'note' END AS note FROM nation)
SELECT metric, 'EMPTY' AS rule FROM r WHERE value IS NOT NULL AND denominator <= 0 UNION ALL SELECT metric, 'SILENT' FROM r WHERE value IS NULL AND note IS NULL
UNION ALL SELECT metric, 'NOTED' FROM r WHERE value IS NOT NULL AND note IS NOT NULL UNION ALL SELECT metric, 'NOT_FINITE' FROM r WHERE isinf(value)""")
def report_breaches(t):
    k = F.col("n_nationkey")
    value = F.when(k % 5 == 0, None).when(k % 7 == 1, float("inf")).otherwise(k / 10)
    report = t("nation").select(F.col("n_name").alias("metric"), value.alias("value"), (k % 4).alias("denominator"), F.when(k % 3 == 0, "note").alias("note"))
    return I.report_breaches(report)


@query("""SELECT n_name AS nation, round(avg(c_acctbal), 6) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def report_public_view(t):
    """Of a report with names and identifiers, the two columns that may be told."""
    report = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name").agg(F.avg("c_acctbal").alias("mean"), F.max("c_name").alias("someone"))
    return V.public(report, {"nation": F.col("n_name"), "balance": F.round("mean", 6)})


@query("""WITH a(role, dataset, split) AS (VALUES ('O', 'BUILDING', 'train'), ('O', 'MACHINERY', 'train'), ('F', 'BUILDING', 'test')) SELECT o_orderkey, split FROM orders JOIN customer ON o_custkey = c_custkey JOIN a ON role = o_orderstatus AND dataset = c_mktsegment""")
def split_admissions(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_orderstatus").alias("role"), F.col("c_mktsegment").alias("dataset"))
    known = [("O", "BUILDING", "train"), ("O", "MACHINERY", "train"), ("F", "BUILDING", "test")]
    admissions = rows.sparkSession.createDataFrame(known, "role string, dataset string, split string")
    return V.admitted(rows, admissions, ["role", "dataset"]).select("o_orderkey", "split")


@query(panels._PAIRS + """, z AS (SELECT p.left_id, p.right_id FROM p LEFT JOIN x USING (left_id, right_id) LEFT JOIN r USING (left_id, right_id) LEFT JOIN g USING (left_id, right_id) LEFT JOIN i a ON a.id = p.left_id LEFT JOIN i b ON b.id = p.right_id
  WHERE x.left_id IS NULL AND a.identity <> b.identity AND verdict IS NULL AND admitted IS NULL)
SELECT left_id, right_id, a.o_orderpriority AS left_location, b.o_orderpriority AS right_location, CASE WHEN left_id % 8 = 0 THEN left_id % 10 END AS distance FROM z JOIN orders a ON a.o_orderkey = left_id JOIN orders b ON b.o_orderkey = right_id""")
def review_queue(t):
    pairs = panels._pairs(t)
    locations = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("location"))
    distances = pairs[0].filter("left_id % 8 = 0").select("left_id", "right_id", (F.col("left_id") % 10).alias("distance"))
    return E.review_queue(E.adjudicated(*pairs), locations, distances)


@query(evidence._BLOCKS + """, b AS (SELECT root, count(*) AS n, bool_or(o_orderstatus = 'P') AS bad FROM c JOIN orders ON o_orderkey = node GROUP BY 1
), r AS (SELECT root, (sum(n) OVER (ORDER BY sha256('split' || chr(31) || root), root ROWS UNBOUNDED PRECEDING) - n) / (SELECT sum(n) FROM b WHERE NOT bad) AS x FROM b WHERE NOT bad)
SELECT node, root, CASE WHEN x IS NULL THEN 'QUARANTINED' WHEN x < 0.7 THEN 'TRAIN' WHEN x < 0.85 THEN 'DEV' ELSE 'TEST' END AS role FROM c LEFT JOIN r USING (root)""")
def assembled_split(t):
    bad = t("orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("node"))
    return P.assembled_split(evidence._blocks(t), bad, [("TRAIN", 0.7), ("DEV", 0.15), ("TEST", 0.15)], "split")


@query(evidence._BLOCKS + """, b AS (SELECT root, count(*) AS n FROM c GROUP BY 1), r AS (SELECT root, (row_number() OVER (ORDER BY n DESC, sha256('kfold' || chr(31) || root), root) - 1) % 10 AS k FROM b)
SELECT node, root, CAST(CASE WHEN k < 5 THEN k ELSE 9 - k END AS INTEGER) AS fold FROM c JOIN r USING (root)""")
def assembled_folds(t):
    return P.assembled_folds(evidence._blocks(t), 5, "kfold")


@query("""WITH u AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING NOT bool_or(o_orderstatus = 'P'))
SELECT o_custkey, count(*) AS units, CAST(sum(n) AS BIGINT) AS samples FROM u GROUP BY 1 HAVING count(*) >= 2 AND sum(n) >= 4""")
def retrieval_eligible(t):
    rows = t("orders").withColumn("bad", F.col("o_orderstatus") == "P")
    return P.eligible(rows, "o_custkey", "o_orderpriority", "bad", 4)


@query("""SELECT p_partkey, round(((c1 + c2 + c3) / 3 + (c1 + c2) / 2 + greatest(0, 1 - o / 0.5) + least(1, s / 112) + (1 - (p_partkey % 2)) + 0.5) / 6, 6) AS face,
  round((c1 + CASE WHEN p_size % 3 > 0 THEN least(1, s / 224) ELSE 0.5 END + 0.5 + (1 - c2) + (1 - (p_partkey % 2)) + (1 - c3) + c1) / 7, 6) AS nose
FROM (SELECT p_partkey, p_size, (p_partkey % 10) / 10.0::DOUBLE AS c1, (p_partkey % 7) / 10.0::DOUBLE AS c2, (p_partkey % 3) / 10.0::DOUBLE AS c3, (p_partkey % 13) / 20.0::DOUBLE AS o, CASE WHEN p_size % 3 > 0 THEN p_size * 4.0::DOUBLE ELSE 8 END AS s FROM part)""")
def face_and_nose_quality(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    c1, c2, c3, side = k % 10 / 10, k % 7 / 10, k % 3 / 10, F.when(size % 3 > 0, size * 4.0).otherwise(8.0)
    face = D.face_quality(F.array(c1, c2, c3), F.array(c1, c2), k % 13 / 20, side, k % 2 == 1, F.lit(0.5))
    nose = D.nose_quality(c1, F.when(size % 3 > 0, side).otherwise(0.0), F.lit(0.5), c2, k % 2 == 1, c3, c1)
    return rounded(t("part").select("p_partkey", face.alias("face"), nose.alias("nose")), "face", "nose")


@query("""WITH p AS (SELECT p_partkey, (p_partkey % 5) / 10.0::DOUBLE AS lx, (p_partkey % 3) / 20.0::DOUBLE AS ly, (p_partkey % 5) / 10.0::DOUBLE + (p_size % 4) / 10.0::DOUBLE AS rx, (p_partkey % 2) / 20.0::DOUBLE AS ry, (p_size % 9) / 10.0::DOUBLE AS nx, (p_partkey % 10) / 10.0::DOUBLE AS c FROM part
), q AS (SELECT *, sqrt((rx - lx) ** 2 + (ry - ly) ** 2) AS d FROM p), r AS (SELECT *, CASE WHEN d > 1e-8 THEN greatest(0, 1 - abs(nx - (lx + rx) / 2) / d / 0.5) ELSE 0 END AS s, CASE WHEN d > 1e-8 THEN greatest(0, 1 - abs(ry - ly) / d / 0.5) ELSE 0 END AS l FROM q)
SELECT p_partkey, round(s, 6) AS symmetry, round(l, 6) AS level, round(s * l, 6) AS geometric, round(c, 6) AS anchor, round(s * l * c, 6) AS combined FROM r""")
def frontality(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    point = lambda x, y, c: F.struct(x.alias("x"), y.alias("y"), c.alias("c"))
    left, right = point(k % 5 / 10, k % 3 / 20, F.lit(1.0)), point(k % 5 / 10 + size % 4 / 10, k % 2 / 20, F.lit(1.0))
    nose = point(size % 9 / 10, F.lit(0.5), k % 10 / 10)
    parts = D.frontality(left, right, nose, nose)
    return rounded(t("part").select("p_partkey", *[c.alias(n) for n, c in parts.items()]), *parts)


@query("""SELECT p_partkey, CAST(ceil(p_size * 1000000 / 8.0::DOUBLE * (p_partkey % 60)) AS BIGINT) AS bytes FROM part""")
def video_bytes(t):
    return t("part").select("p_partkey", D.encoded_bytes(F.col("p_size"), F.col("p_partkey") % 60).cast("long").alias("bytes"))


_NESTED = """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS q FROM lineitem)"""


def _lines(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))


@query(_NESTED + """SELECT l_orderkey, count(*) AS lines, sha256('[' || string_agg('{"q":' || q || ',"l_partkey":' || l_partkey || ',"l_linenumber":' || l_linenumber || '}', ',' ORDER BY -q, l_linenumber, l_partkey) || ']') AS digest FROM b GROUP BY 1""")
def prediction_cache(t):
    cache = V.nested_cache(_lines(t), ["l_orderkey"], [-F.col("q"), F.col("l_linenumber")], ["q", "l_partkey", "l_linenumber"], "boxes")
    return cache.select("l_orderkey", F.size("boxes").cast("long").alias("lines"), "digest")


@query(_NESTED + """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY -q, l_linenumber, l_partkey) - 1 AS INTEGER) AS place, q, l_partkey, l_linenumber FROM b""")
def prediction_cache_rows(t):
    cache = V.nested_cache(_lines(t), ["l_orderkey"], [-F.col("q"), F.col("l_linenumber")], ["q", "l_partkey", "l_linenumber"], "boxes")
    return V.unnested(cache, ["l_orderkey"], "boxes")


# Every vector against all others: how well labels are found again.
_TRANSFER = """
WITH s AS (SELECT q.vec_id AS query_id, q.label = g.label AS rel, g.vec_id AS template_id, round(list_cosine_similarity(q.embedding::DOUBLE[], g.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings g ON q.vec_id <> g.vec_id
), h AS (SELECT *, row_number() OVER w AS rank, sum(rel::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, template_id)
), o AS (SELECT query_id, count(*) FILTER (rel) AS n, min(rank) FILTER (rel) AS f, avg(hits / rank) FILTER (rel) AS ap FROM h GROUP BY 1)
"""


@query(_TRANSFER + """SELECT count(*) AS queries, count(*) FILTER (n > 0) AS evaluated, round(avg((f <= 1)::INT) FILTER (n > 0), 6) AS rank_1, round(avg((f <= 5)::INT) FILTER (n > 0), 6) AS rank_5, round(avg(coalesce(ap, 0)), 6) AS map FROM o""")
def transfer_scores(t):
    e = t("embeddings")
    side = e.select(F.col("vec_id").alias("id"), F.col("label").alias("identity"), as_double("embedding").alias("vector"))
    outcomes = X.relevance_outcomes(side, side, itself=False)
    return rounded(M.retrieval_summary(outcomes, ks=(1, 5)).select("queries", "evaluated", "rank_1", "rank_5", "map"), "rank_1", "rank_5", "map")


@query(_TRANSFER + "SELECT query_id, CAST(rank AS INTEGER) AS place, template_id, score, rel AS same FROM h WHERE rank <= 3")
def transfer_traces(t):
    e = t("embeddings")
    side = e.select(F.col("vec_id").alias("id"), as_double("embedding").alias("vector"))
    label = lambda name, out: e.select(F.col("vec_id").alias(name), F.col("label").alias(out))
    top = X.top_templates(side, side, 3).join(label("query_id", "_a"), "query_id").join(label("template_id", "_b"), "template_id")
    return top.select("query_id", F.col("r").alias("place"), "template_id", "score", (F.col("_a") == F.col("_b")).alias("same"))


@query(retrieval._CURVE + """, w AS (SELECT * FROM v UNION ALL SELECT 'inf'::DOUBLE, 0, 0, 0, 0), c2 AS (SELECT threshold::VARCHAR AS x, tar, far FROM w)
SELECT 'curve' AS figure, series, count(*) AS points, round(min(y), 6) AS least, round(max(y), 6) AS most FROM (SELECT 'tar' AS series, tar AS y FROM c2 UNION ALL SELECT 'far', far FROM c2) GROUP BY 2
UNION ALL SELECT 'labels', m, count(*), min(y), max(y) FROM (SELECT 'quality' AS m, quality::DOUBLE AS y FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) GROUP BY 2""")
def figure_ranges(t):
    """Extent of each series that the two figures draw."""
    curve = M.verification_curve(retrieval._counts(t))
    rows = V.figure_series({"curve": (curve, "threshold", ["tar", "far"]), "labels": (t("labels"), "doc_id", ["quality", "toxic"])})
    return rounded(rows.groupBy("figure", "series").agg(F.count("*").alias("points"), F.min("y").alias("least"), F.max("y").alias("most")), "least", "most")


@query("""WITH e AS (SELECT label, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT label, unnest(range(1, 65)) AS k, unnest(list_transform(v, lambda x: x / n)) AS x FROM e
), m AS (SELECT label, k, avg(x) AS m FROM l GROUP BY 1, 2), d AS (SELECT label, 1 - sqrt(sum(m * m)) AS d FROM m GROUP BY 1), c AS (SELECT label, list(m ORDER BY k) AS m FROM m GROUP BY 1
), p AS (SELECT list_cosine_similarity(a.m, b.m) AS s FROM c a JOIN c b ON a.label < b.label)
SELECT 'norms' AS section, 'mean' AS metric, round(avg(n), 6) AS value FROM e UNION ALL SELECT 'norms', 'std', round(stddev_pop(n), 6) FROM e UNION ALL SELECT 'norms', 'max', round(max(n), 6) FROM e
UNION ALL SELECT 'identities', 'count', count(*) FROM d UNION ALL SELECT 'identities', 'mean_dispersion', round(avg(d), 6) FROM d UNION ALL SELECT 'centroids', 'mean_cosine', round(avg(s), 6) FROM p UNION ALL SELECT 'centroids', 'max_cosine', round(max(s), 6) FROM p""")
def diagnostics_report(t):
    from loomfield.functions.vectors import norm

    e = t("embeddings")
    norms = e.select(norm(as_double("embedding")).alias("n"))
    spread = G.dispersion(e, "embedding", ["label"])
    near = G.centroid_cosines(e, "embedding", "label")
    return G.report(
        {
            "norms": norms.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.max("n").alias("max")),
            "identities": spread.agg(F.count("*").alias("count"), F.avg("dispersion").alias("mean_dispersion")),
            "centroids": near.agg(F.avg("cosine").alias("mean_cosine"), F.max("cosine").alias("max_cosine")),
        }
    )


@query("""SELECT vec_id % 3 AS scenario, max(round(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x - round(x, 2)))), 6)) AS max_abs, round(avg(list_avg(list_transform(embedding::DOUBLE[], lambda x: abs(x - round(x, 2))))), 6) AS mean_abs, count(*) AS pairs FROM embeddings GROUP BY 1""")
def scenario_drift(t):
    v = as_double("embedding")
    pairs = t("embeddings").select((F.col("vec_id") % 3).alias("scenario"), F.col("vec_id").alias("id"), v.alias("a"), F.transform(v, lambda x: F.round(x, 2)).alias("b"))
    return rounded(G.drift_by(pairs, "a", "b", "scenario"), "max_abs", "mean_abs")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('pk' || chr(31) || o_orderkey), o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders
), b AS (SELECT o_custkey, (row_number() OVER (ORDER BY sha256('pk' || chr(31) || o_custkey), o_custkey) - 1) // 16 AS batch FROM (SELECT DISTINCT o_custkey FROM r WHERE n >= 4))
SELECT batch, o_custkey, o_orderkey, CAST(place AS INTEGER) AS place FROM r JOIN b USING (o_custkey) WHERE place <= 4""")
def identity_batches(t):
    return P.identity_batches(t("orders"), "o_custkey", "o_orderkey", 16, 4, "pk")


@query("""WITH RECURSIVE n AS (SELECT CAST(c_nationkey AS VARCHAR) AS block, count(*) AS n, row_number() OVER (ORDER BY sha256('subset' || chr(31) || c_nationkey), CAST(c_nationkey AS VARCHAR)) AS k FROM customer GROUP BY c_nationkey
), m AS (SELECT count(*) AS m, CAST(sum(n) // 2 AS BIGINT) AS target FROM n
), r(k, reach) AS (SELECT m + 1, [0]::BIGINT[] FROM m UNION ALL SELECT n.k, list_distinct(list_concat(reach, list_transform(reach, lambda x: x + n.n))) FROM r JOIN n ON n.k = r.k - 1
), g(k, rest, block, took) AS (SELECT 0, target, NULL::VARCHAR, false FROM m UNION ALL
  SELECT k, CASE WHEN ok THEN rest - n ELSE rest END, block, ok FROM (SELECT n.k, g.rest, n.n, n.block, g.rest >= n.n AND list_contains(r.reach, g.rest - n.n) AS ok FROM g JOIN n ON n.k = g.k + 1 JOIN r ON r.k = n.k + 1))
SELECT block FROM g WHERE took AND (SELECT list_contains(reach, target) FROM r, m WHERE r.k = 1)""")
def blocks_with_sum(t):
    """Nations whose customers are half of all, the earliest in hash order preferred; nations (25) are blocks."""
    from loomfield.functions.scalars import stable_rank

    rows = t("customer").groupBy(F.col("c_nationkey").cast("string").alias("block")).count()
    ranked = rows.orderBy(stable_rank(F.lit("subset"), F.col("block")), "block").collect()
    chosen = P.subset_with_sum([(r.block, r["count"]) for r in ranked], sum(r["count"] for r in ranked) // 2)
    return t("customer").sparkSession.createDataFrame([(x,) for x in chosen or []], "block string")
