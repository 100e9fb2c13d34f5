"""Diagnostics, drift, time series, registry and geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.functions import scalars as S
from loomfield.functions.vectors import as_double
from loomfield.operators import coverage as C
from loomfield.operators import diagnostics as D
from loomfield.operators import geometry as Z
from loomfield.operators import registry as R
from loomfield.operators import search as X
from loomfield.plans.registering import query, rounded

_UNIT = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
), u AS (SELECT vec_id, label, n, list_transform(v, lambda x: x / n) AS u FROM e)"""


@query("""SELECT event_type, count(*) AS n, min(value) AS min, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95,
  max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events WHERE isfinite(value) GROUP BY 1""")
def finite_summary(t):
    return rounded(D.finite_summary(t("events"), "value", ["event_type"]), "p05", "median", "p95", "mean", "std")


@query(_UNIT + """, l AS (SELECT label, unnest(range(1, 65)) AS k, unnest(u) AS x, count(*) OVER (PARTITION BY label, unnest(range(1, 65))) AS c FROM u
), m AS (SELECT label, k, avg(x) AS m, count(*) AS n FROM l GROUP BY label, k)
SELECT label, max(n) AS n, round(1 - sqrt(sum(m * m)), 6) AS dispersion FROM m GROUP BY label""".replace(", count(*) OVER (PARTITION BY label, unnest(range(1, 65))) AS c", ""))
def identity_dispersion(t):
    return rounded(D.dispersion(t("embeddings"), "embedding", ["label"]), "dispersion")


_CENTROIDS = _UNIT + """, l AS (SELECT label, vec_id % 4 AS domain, unnest(range(1, 65)) AS k, unnest(u) AS x FROM u)"""


@query(_CENTROIDS + """, m AS (SELECT label, k, avg(x) AS m FROM l GROUP BY label, k), n AS (SELECT label, list(m ORDER BY k) AS m FROM m GROUP BY label)
SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.m, b.m), 6) AS cosine FROM n a JOIN n b ON a.label < b.label""")
def centroid_cosines(t):
    return rounded(D.centroid_cosines(t("embeddings"), "embedding", "label"), "cosine")


@query(_CENTROIDS + """, m AS (SELECT label, domain, k, avg(x) AS m FROM l GROUP BY label, domain, k), n AS (SELECT label, domain, list(m ORDER BY k) AS m FROM m GROUP BY label, domain)
SELECT a.label, count(*) AS pairs, round(avg(1 - list_cosine_similarity(a.m, b.m)), 6) AS shift FROM n a JOIN n b ON a.label = b.label AND a.domain < b.domain GROUP BY a.label""")
def domain_shift(t):
    return rounded(D.domain_shift(t("embeddings").withColumn("domain", F.col("vec_id") % 4), "embedding", "label", "domain"), "shift")


@query("""WITH l AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(avg(a.x * b.x) - avg(a.x) * avg(b.x), 8) AS cov FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i""")
def covariance(t):
    return rounded(D.gram(t("embeddings"), "embedding"), "cov", digits=8)


@query()
def covariance_spectrum(t):
    rows = D.spectrum(t("embeddings"), "embedding")
    total = sum(x for _, x in rows) or 1.0
    return t("embeddings").sparkSession.createDataFrame([(k, round(x, 8), round(x / total, 6)) for k, x in rows], "k int, eigenvalue double, share double")


@query("""WITH p AS (SELECT round(embedding[1]::DOUBLE, 2) AS n, (vec_id % 101) / 100.0 AS q FROM embeddings),
r AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS a, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2 AS b FROM p)
SELECT round(corr(a, b), 6) AS spearman FROM r""")
def quality_spearman(t):
    rows = t("embeddings").select(F.round(as_double("embedding")[0], 2).alias("n"), (F.col("vec_id") % 101 / 100).alias("q"))
    return rounded(D.spearman(rows, "n", "q"), "spearman")


def _neighbours(t, k: int = 5):
    e = t("embeddings")
    side = e.select(F.col("vec_id").alias("id"), as_double("embedding").alias("vector"))
    return X.top_templates(side.filter("id % 5 = 0"), side, k)


@query("""WITH s AS (SELECT a.vec_id AS q, b.vec_id AS g, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
), k AS (SELECT g FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, g) <= 5), d AS (SELECT vec_id, count(g) AS d FROM embeddings LEFT JOIN k ON g = vec_id GROUP BY vec_id
), o AS (SELECT d, row_number() OVER (ORDER BY d DESC, vec_id) AS r, count(*) OVER () AS n, avg(d) OVER () AS mu FROM d)
SELECT count(*) AS items, round(avg((d - mu) ** 3) / avg((d - mu) ** 2) ** 1.5, 6) AS skewness, round(avg((d = 0)::INT), 6) AS never, round(sum(d) FILTER (r <= ceil(n * 0.1)) / sum(d), 6) AS top_tenth, round(sum(d * d) / sum(d) ** 2, 6) AS concentration FROM o""")
def neighbour_hubness(t):
    """Neighbours of every vector among all others."""
    side = t("embeddings").select(F.col("vec_id").alias("id"), as_double("embedding").alias("vector"))
    found = X.top_templates(side, side, 5).select(F.col("template_id").alias("vec_id"))
    return rounded(D.hubness(found, t("embeddings"), "vec_id"), "skewness", "never", "top_tenth", "concentration")


@query("""SELECT vec_id AS id, round(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x - round(x, 2)))), 6) AS max_abs,
  round(list_avg(list_transform(embedding::DOUBLE[], lambda x: abs(x - round(x, 2)))), 6) AS mean_abs,
  round(list_cosine_similarity(embedding::DOUBLE[], list_transform(embedding::DOUBLE[], lambda x: round(x, 2))), 6) AS cosine FROM embeddings""")
def element_drift(t):
    pairs = t("embeddings").select(F.col("vec_id").alias("id"), as_double("embedding").alias("a"), F.transform(as_double("embedding"), lambda x: F.round(x, 2)).alias("b"))
    return rounded(D.element_drift(pairs, "a", "b"), "max_abs", "mean_abs", "cosine")


@query("""WITH s AS (SELECT o_custkey AS query_id, o_orderkey AS slot, o_orderpriority, round(o_totalprice / 1000) AS a, round((o_totalprice + (o_orderkey * 7919 % 40000)) / 1000) AS b FROM orders
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, slot) AS ra, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, slot) AS rb FROM s
), i AS (SELECT x.query_id, count(*) FILTER (x.ra < y.ra AND x.rb > y.rb) AS inversions, count(*) FILTER (x.slot < y.slot AND x.a = y.a) AS tied_pairs FROM r x JOIN r y USING (query_id) GROUP BY 1)
SELECT query_id, max(abs(a - b)) AS max_score_gap, CAST(max(abs(ra - rb)) AS INTEGER) AS max_rank_gap, count(*) FILTER (ra = 1 AND rb <> 1) AS best_changed,
  count(*) FILTER ((ra <= 1) <> (rb <= 1)) AS top_1_apart, count(*) FILTER ((ra <= 5) <> (rb <= 5)) AS top_5_apart, max(tied_pairs) AS tied_pairs, max(inversions) AS inversions FROM r JOIN i USING (query_id) GROUP BY 1""")
def rank_drift(t):
    s = t("orders").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("slot"), F.round(F.col("o_totalprice") / 1000).alias("a"),
        F.round((F.col("o_totalprice") + F.col("o_orderkey") * 7919 % 40000) / 1000).alias("b"),
    )
    return D.rank_drift(s)


@query("""SELECT coalesce(a.o_orderstatus, 'MISSING') AS was, coalesce(b.o_orderstatus, 'MISSING') AS now, count(*) AS n FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) a
FULL JOIN (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0) b USING (o_orderkey) GROUP BY 1, 2""")
def state_changes(t):
    o = t("orders")
    after = o.filter("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 200000, "F").otherwise(F.col("o_orderstatus")))
    return D.state_changes(o.filter("o_orderkey % 3 <> 0"), after, "o_orderkey", "o_orderstatus")


@query(_UNIT + """, l AS (SELECT label, (vec_id % 101 + 1) / 101.0 AS w, unnest(range(1, 65)) AS k, unnest(u) AS x FROM u
), m AS (SELECT label, k, sum(w * x) / sum(w) AS m FROM l GROUP BY label, k), s AS (SELECT label, sqrt(sum(m * m)) AS s FROM m GROUP BY label)
SELECT label, CAST(k - 1 AS INTEGER) AS k, round(m / s, 6) AS x FROM m JOIN s USING (label)""")
def weighted_mean_vectors(t):
    rows = t("embeddings").withColumn("w", (F.col("vec_id") % 101 + 1) / 101)
    return D.weighted_mean_vector(rows, "embedding", "w", ["label"]).select("label", F.posexplode("mean").alias("k", "x")).withColumn("x", F.round("x", 6))


# Events as observations of a camera (the user), in microseconds.
def _observed(t):
    return t("events").select("user_id", "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


_OBSERVED = "WITH o AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) AS tus FROM events)"
_HOLD, _PERIOD = 3_600_000_000, 600_000_000
_HELD = _OBSERVED + f""", g AS (SELECT *, coalesce(lead(tus) OVER (PARTITION BY user_id ORDER BY tus, event_id) - tus, {_PERIOD}) AS d FROM o
), h AS (SELECT *, least(d, {_HOLD}) AS held, d - least(d, {_HOLD}) AS gap FROM g)
"""


def _held(t):
    # One order of equal times: the event number in the lowest digits.
    rows = _observed(t)
    return C.held(rows.withColumn("at", F.col("at")), "user_id", "at", _HOLD, _PERIOD)


@query(_HELD + "SELECT user_id, CAST(sum(held) AS BIGINT) AS observed, CAST(sum(gap) AS BIGINT) AS unobserved, CAST(coalesce(sum(held) FILTER (value >= 50), 0) AS BIGINT) AS high, CAST(coalesce(sum(held) FILTER (event_type = 'click'), 0) AS BIGINT) AS clicks FROM h GROUP BY 1")
def coverage_durations(t):
    return C.durations(_held(t), {"high": F.col("value") >= 50, "clicks": F.col("event_type") == "click"}, ["user_id"])


@query(_HELD + """, k AS (SELECT *, coalesce(value >= 20, false) AS ok, lag(coalesce(value >= 20, false)) OVER w AS pok, lag(event_type) OVER w AS pk, lag(gap) OVER w AS pg FROM h WINDOW w AS (PARTITION BY user_id ORDER BY tus)
), r AS (SELECT *, sum(CASE WHEN coalesce(pok, false) AND pk = event_type AND pg = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY tus ROWS UNBOUNDED PRECEDING) AS run FROM k)
SELECT user_id, event_type AS key, min(tus) AS start, count(*) AS rows, CAST(sum(held) AS BIGINT) AS duration FROM r WHERE ok GROUP BY user_id, run, event_type HAVING sum(held) >= 1200000000""")
def coverage_runs(t):
    return C.runs(_held(t), "user_id", "at", F.col("value") >= 20, F.col("event_type"), 1_200_000_000)


_LATE = "WITH o AS (SELECT user_id, event_id, epoch_us(ts) - event_id % 7 * 3000000000 AS tus FROM events)"


def _late(t):
    """Observations that arrive in order of their number, some of them late."""
    return _observed(t).withColumn("at", F.col("at") - F.col("event_id") % 7 * 3_000_000_000)


@query(_LATE + """, g AS (SELECT user_id, tus - lag(tus) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM o)
SELECT user_id, 0::BIGINT AS nulls, count(*) AS frames, count(*) FILTER (g < 0) AS inversions, count(*) FILTER (g = 0) AS duplicates,
  CAST(coalesce(sum(greatest(0, (g + 300000000) // 600000000 - 1)) FILTER (g > 0), 0) AS BIGINT) AS missing, max(g) FILTER (g > 0) AS max_gap FROM g GROUP BY 1""")
def timestamp_audit(t):
    return C.gap_audit(_late(t), "user_id", "event_id", "at", _PERIOD)


@query(_LATE + """SELECT user_id, event_id, tus AS at_us FROM (SELECT *, lag(tus) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM o) WHERE tus <= p""")
def timestamp_order_breaches(t):
    return C.order_breaches(_late(t), "user_id", "event_id", "at").select("user_id", "event_id", F.col("at").alias("at_us"))


@query(_OBSERVED + """, s AS (SELECT user_id, value, (value + lag(value) OVER w) / 2 * ((tus - lag(tus) OVER w) / 1000000.0::DOUBLE) AS s FROM o WINDOW w AS (PARTITION BY user_id ORDER BY tus))
SELECT user_id, round(avg(value), 4) AS mean, max(value) AS max, round(coalesce(sum(s), 0), 2) AS integral FROM s GROUP BY 1""")
def telemetry_energy(t):
    rows = _observed(t).withColumn("s", F.col("at") / 1e6)
    out = C.integral(rows, "user_id", "s", "value")
    return out.select("user_id", F.round("mean", 4).alias("mean"), "max", F.round("integral", 2).alias("integral"))


@query(_OBSERVED + """, i AS (SELECT event_type, tus AS s, tus + 2000000000 AS e FROM o), m AS (SELECT *, max(e) OVER (PARTITION BY event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i
), n AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT event_type, max(l) AS longest FROM (SELECT event_type, max(e) - min(s) AS l FROM n GROUP BY event_type, k) GROUP BY 1""")
def longest_cover(t):
    return C.longest_cover(_observed(t).withColumn("end", F.col("at") + 2_000_000_000), "event_type", "at", "end")


@query("""SELECT u.user_id, k.event_type FROM (SELECT DISTINCT user_id FROM events) u, (VALUES ('click'), ('view'), ('infrared')) k(event_type)
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = k.event_type)""")
def missing_modalities(t):
    return C.missing_kinds(t("events"), "user_id", "event_type", ["click", "view", "infrared"])


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, max(value) FILTER (r = ceil(0.5 * n)) AS p50, max(value) FILTER (r = ceil(0.95 * n)) AS p95 FROM r GROUP BY 1""")
def timing_summary(t):
    return rounded(C.nearest_rank(t("events"), "value", ["event_type"]), "mean")


@query("""SELECT event_id, CASE WHEN event_type IS NULL OR value IS NULL THEN NULL ELSE event_type <> 'click' AND value >= 10 END AS usable,
  CASE WHEN value >= 80 AND event_id % 10 >= 8 THEN 'ACCEPT' WHEN value < 20 OR event_id % 10 < 2 THEN 'REJECT' ELSE 'REVIEW' END AS route FROM events""")
def quality_and_routing(t):
    ok = C.three_valued([F.col("event_type") != "click", F.col("value") >= 10], [F.col("event_type"), F.col("value")])
    return t("events").select("event_id", ok.alias("usable"), S.routed(F.col("value"), (F.col("event_id") % 10) * 10, 80.0, 20.0).alias("route"))


# Registry.
@query("""WITH k AS (SELECT c_mktsegment || ':' || (c_custkey % 200) AS key, count(*) AS images FROM customer GROUP BY 1), n AS (SELECT DISTINCT c_mktsegment || ':' || (c_custkey % 300) AS key FROM customer WHERE c_custkey % 2 = 0)
SELECT key, split_part(key, ':', 1) AS dataset, sha256('identity' || chr(0) || key) AS identity_token, CAST(sum(images) AS BIGINT) AS images FROM (SELECT * FROM k UNION ALL SELECT key, 1 FROM n) GROUP BY key""")
def registry_upsert(t):
    key = lambda n: F.concat_ws(":", "c_mktsegment", (F.col("c_custkey") % n).cast("string")).alias("key")
    c = t("customer")
    first = R.registered(None, c.select(key(200)), "key")
    both = R.registered(first, c.filter("c_custkey % 2 = 0").select(key(300)), "key", once=True)
    return R.with_ids(both, "key").drop("registered_id")


@query(f"""WITH k AS (SELECT 'nation:' || n_name AS key FROM nation), h AS (SELECT key, sha1(unhex('{R.NAMESPACE.replace("-", "")}') || key::BLOB) AS h FROM k)
SELECT key, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][('0x' || substr(h, 17, 1))::INT % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS registered_id FROM h""")
def registry_ids(t):
    """RFC 4122 ids of version 5."""
    keys = t("nation").select(F.concat(F.lit("nation:"), F.col("n_name")).alias("key"), F.lit(1).alias("images"))
    return R.with_ids(keys, "key").select("key", "registered_id")


@query("""WITH e AS (SELECT p_partkey AS key, p_name AS payload FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN p_name || '!' ELSE p_name END AS payload FROM part)
SELECT b.key, b.payload, CASE WHEN e.payload <> b.payload THEN 'CONFLICT' WHEN e.key IS NULL THEN 'CREATED' ELSE 'SAME' END AS outcome FROM b LEFT JOIN e USING (key)""")
def enrolment_outcomes(t):
    p = t("part")
    old = p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("payload"))
    new = p.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("payload"))
    return R.enrolment(old, new, "key", "payload")


@query("""SELECT o_orderkey AS id, was, now FROM (SELECT o_orderkey, o_orderstatus AS was, CASE WHEN o_orderkey % 3 = 0 THEN 'O' ELSE 'F' END AS now FROM orders) WHERE (was, now) NOT IN (('O', 'P'), ('O', 'F'), ('P', 'F'))""")
def registry_illegal_changes(t):
    c = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("was"), F.when(F.col("o_orderkey") % 3 == 0, "O").otherwise("F").alias("now"))
    return R.illegal_changes(c, [("O", "P"), ("O", "F"), ("P", "F")]).select("id", "was", "now")


# Boxes made from parts: eight to an image.
def _boxes(t, dx: float = 0.0):
    k = F.col("p_partkey")
    x, y = (k * 37 % 60).cast("double") + dx, (k * 53 % 40).cast("double")
    return t("part").select(
        F.floor(k / 8).alias("image"), k.alias("id"), x.alias("x1"), y.alias("y1"), (x + 10 + F.col("p_size") % 17).alias("x2"),
        (y + 12 + F.col("p_size") % 13).alias("y2"), (k * 7919 % 1000 / 1000).alias("confidence"),
    )


_BOXES = """WITH b AS (SELECT p_partkey // 8 AS image, p_partkey AS id, (p_partkey * 37 % 60)::DOUBLE AS x1, (p_partkey * 53 % 40)::DOUBLE AS y1, p_partkey * 37 % 60 + 10.0::DOUBLE + p_size % 17 AS x2,
  p_partkey * 53 % 40 + 12.0::DOUBLE + p_size % 13 AS y2, (p_partkey * 7919 % 1000) / 1000.0 AS confidence FROM part)"""


@query(_BOXES + """, p AS (SELECT a.id AS left_id, b.id AS right_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM b a JOIN b b ON a.image = b.image AND a.id < b.id)
SELECT left_id, right_id, round(i / greatest(s - i, 1e-6), 6) AS iou FROM p WHERE i > 0""")
def box_overlaps(t):
    b = _boxes(t)
    other = b.select("image", F.col("id").alias("right_id"), *[F.col(c).alias(f"o_{c}") for c in Z.BOX])
    iou = S.iou(tuple(map(F.col, Z.BOX)), tuple(F.col(f"o_{c}") for c in Z.BOX))
    rows = b.join(other, "image").filter("id < right_id").select(F.col("id").alias("left_id"), "right_id", F.round(iou, 6).alias("iou"), iou.alias("exact"))
    return rows.filter("exact > 0").drop("exact")


@query(_BOXES + """SELECT id, CAST(greatest(0, least(80, (x1 + x2) / 2 - greatest(x2 - x1, y2 - y1) * 0.6)) - 0.5 + 0.5 AS DOUBLE) AS raw,
  1 - greatest(0, least(x2, 64) - x1) * greatest(0, least(y2, 48) - y1) / ((x2 - x1) * (y2 - y1)) > 0.2 AS truncated FROM b""")
def box_truncation(t):
    box = tuple(map(F.col, Z.BOX))
    half = F.greatest(box[2] - box[0], box[3] - box[1]) * 0.6
    raw = F.greatest(F.lit(0.0), F.least(F.lit(80.0), (box[0] + box[2]) / 2 - half))
    return _boxes(t).select("id", raw.alias("raw"), S.is_truncated(box, 64, 48).alias("truncated"))


@query(_BOXES + """SELECT image, round(sum(x1 * confidence) / greatest(sum(confidence), 1e-6), 6) AS x1, round(sum(y1 * confidence) / greatest(sum(confidence), 1e-6), 6) AS y1,
  round(sum(x2 * confidence) / greatest(sum(confidence), 1e-6), 6) AS x2, round(sum(y2 * confidence) / greatest(sum(confidence), 1e-6), 6) AS y2, count(*) AS boxes FROM b GROUP BY image""")
def box_fusion(t):
    return rounded(Z.fused_boxes(_boxes(t), ["image"]), *Z.BOX)


_OVERLAP = """greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"""
_AREA = "(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


def _iou_sql(a: str, b: str) -> str:
    both = _OVERLAP.format(a=a, b=b)
    return f"({both}) / greatest({_AREA.format(a=a)} + {_AREA.format(a=b)} - ({both}), 1e-6)"


@query(_BOXES.replace("WITH b", "WITH RECURSIVE b") + f"""
, o AS (SELECT *, {{'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS x, row_number() OVER (PARTITION BY image ORDER BY confidence DESC, id) AS k FROM b
), s(image, k, kept) AS (SELECT image, k, [x] FROM o WHERE k = 1 UNION ALL
  SELECT o.image, o.k, CASE WHEN len(list_filter(s.kept, lambda q: {_iou_sql("q", "o.x")} >= 0.5 OR {_OVERLAP.format(a="q", b="o.x")} / least({_AREA.format(a="q")}, {_AREA.format(a="o.x")}) >= 0.9)) = 0 THEN list_append(s.kept, o.x) ELSE s.kept END
  FROM s JOIN o ON o.image = s.image AND o.k = s.k + 1
), f AS (SELECT image, unnest(list_transform(kept, lambda q: q.id)) AS id FROM s QUALIFY row_number() OVER (PARTITION BY image ORDER BY k DESC) = 1)
SELECT b.* FROM b JOIN f USING (image, id)""")
def box_suppression(t):
    return Z.suppressed(_boxes(t))


_MOVED = _BOXES.replace("WITH b", "WITH RECURSIVE b") + """, p AS (SELECT image, id, x1 + 1.5 AS x1, y1, x2 + 1.5 AS x2, y2, confidence FROM b)"""


@query(_MOVED + f""", j AS (SELECT image, i, j, iou, row_number() OVER (PARTITION BY image ORDER BY iou DESC, i, j) AS k FROM (SELECT p.image, p.id AS i, b.id AS j, {_iou_sql("p", "b")} AS iou FROM p JOIN b ON p.image = b.image) WHERE iou >= 0.5
), s(image, k, took) AS (SELECT image, k, [{{'i': i, 'j': j, 'iou': iou}}] FROM j WHERE k = 1 UNION ALL
  SELECT j.image, j.k, CASE WHEN len(list_filter(s.took, lambda q: q.i = j.i OR q.j = j.j)) = 0 THEN list_append(s.took, {{'i': j.i, 'j': j.j, 'iou': j.iou}}) ELSE s.took END FROM s JOIN j ON j.image = s.image AND j.k = s.k + 1
), f AS (SELECT image, unnest(took) AS q FROM s QUALIFY row_number() OVER (PARTITION BY image ORDER BY k DESC) = 1)
SELECT image, q.i AS predicted, q.j AS truth, round(q.iou, 6) AS iou FROM f""")
def box_matching(t):
    return rounded(Z.matched(_boxes(t, 1.5), _boxes(t).drop("confidence"), 0.5), "iou")


@query(_MOVED + f""", t AS (SELECT image, list({{'id': id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY id) AS free FROM b WHERE id % 3 <> 0 GROUP BY 1
), o AS (SELECT p.*, row_number() OVER (PARTITION BY image ORDER BY confidence DESC, id) AS k FROM p
), s(image, k, id, hit, free) AS (SELECT image, 0, NULL::BIGINT, false, free FROM t UNION ALL SELECT image, k, id, hit, CASE WHEN hit THEN list_filter(free, lambda q: q.id <> -best['n']) ELSE free END FROM (SELECT *, coalesce(best['iou'] >= 0.5, false) AS hit FROM (
    SELECT o.image, o.k, o.id, s.free, list_max(list_transform(s.free, lambda q: {{'iou': {_iou_sql("o", "q")}, 'n': -q.id}})) AS best FROM s JOIN o ON o.image = s.image AND o.k = s.k + 1))
), c AS (SELECT sum(coalesce(hit, false)::INT) OVER w AS tp, row_number() OVER w AS k FROM p LEFT JOIN (SELECT image, id, hit FROM s WHERE k > 0) USING (image, id) WINDOW w AS (ORDER BY confidence DESC, image, id)
), z AS (SELECT tp / (SELECT count(*) FROM b WHERE id % 3 <> 0) AS recall, max(tp / k) AS precision FROM c GROUP BY tp), g AS (SELECT a, (SELECT max(precision) FROM z WHERE recall >= a / 100 - 1e-12) AS p FROM range(101) r(a))
SELECT round(avg(coalesce(p, 0)), 6) AS ap FROM g""")
def detection_quality(t):
    truth = _boxes(t).filter("id % 3 <> 0").drop("confidence")
    pairs = Z.matched(_boxes(t, 1.5), truth, 0.5, by_confidence=True)
    return rounded(Z.average_precision_101(_boxes(t, 1.5), pairs, truth.count()), "ap")


@query(_MOVED + f""", j AS (SELECT image, i, j, iou, row_number() OVER (PARTITION BY image ORDER BY iou DESC, i, j) AS k FROM (SELECT p.image, p.id AS i, b.id AS j, {_iou_sql("p", "b")} AS iou FROM p JOIN b ON p.image = b.image AND b.id % 3 <> 0) WHERE iou >= 0.3
), s(image, k, took) AS (SELECT image, k, [{{'i': i, 'j': j, 'iou': iou}}] FROM j WHERE k = 1 UNION ALL
  SELECT j.image, j.k, CASE WHEN len(list_filter(s.took, lambda q: q.i = j.i OR q.j = j.j)) = 0 THEN list_append(s.took, {{'i': j.i, 'j': j.j, 'iou': j.iou}}) ELSE s.took END FROM s JOIN j ON j.image = s.image AND j.k = s.k + 1
), f AS (SELECT unnest(took).iou AS iou FROM s QUALIFY row_number() OVER (PARTITION BY image ORDER BY k DESC) = 1
), c AS (SELECT t AS threshold, count(iou) AS tp, (SELECT count(*) FROM b) AS p, (SELECT count(*) FROM b WHERE id % 3 <> 0) AS r FROM (VALUES (0.5::DOUBLE), (0.75), (0.95)) x(t) LEFT JOIN f ON iou >= t GROUP BY t)
SELECT threshold, tp, round(tp / p, 6) AS precision, round(tp / r, 6) AS recall, round(2 * (tp / p) * (tp / r) / (tp / p + tp / r), 6) AS f1 FROM c""")
def detection_rates(t):
    truth = _boxes(t).filter("id % 3 <> 0").drop("confidence")
    pairs = Z.matched(_boxes(t, 1.5), truth, 0.3)
    rates = Z.detection_summary(pairs, t("part").count(), truth.count(), (0.5, 0.75, 0.95))
    return rounded(rates, "precision", "recall", "f1")


@query("""WITH p AS (SELECT p_brand AS g, (p_partkey * 37 % 60)::DOUBLE AS x, (p_partkey * 53 % 40)::DOUBLE AS y, (p_partkey % 9 + 1)::DOUBLE AS w FROM part), f AS (SELECT g, sum(x * w) / sum(w) AS mx, sum(y * w) / sum(w) AS my FROM p GROUP BY g
), d AS (SELECT p.*, sqrt((x - mx) ** 2 + (y - my) ** 2) AS d FROM p JOIN f USING (g)), m AS (SELECT g, quantile_cont(d, 0.5) AS m FROM d GROUP BY g)
SELECT g, round(sum(x * w) / sum(w), 6) AS x, round(sum(y * w) / sum(w), 6) AS y, count(*) AS points FROM d JOIN m USING (g) WHERE d <= 1.5 * m + 1e-9 GROUP BY g""")
def robust_points(t):
    k = F.col("p_partkey")
    p = t("part").select(F.col("p_brand").alias("g"), (k * 37 % 60).cast("double").alias("x"), (k * 53 % 40).cast("double").alias("y"), (k % 9 + 1).cast("double").alias("w"))
    return rounded(Z.robust_points(p, ["g"], 1.5), "x", "y")


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS i, l_linenumber AS m FROM lineitem), c AS (SELECT m, count(*) AS n FROM s GROUP BY m), b AS (SELECT x.m AS a, y.m AS b, count(*) AS c FROM s x JOIN s y USING (i) WHERE x.m < y.m GROUP BY ALL)
SELECT x.m AS a, y.m AS b, round(coalesce(b.c, 0) / greatest(x.n + y.n - coalesce(b.c, 0), 1), 6) AS jaccard FROM c x JOIN c y ON x.m < y.m LEFT JOIN b ON b.a = x.m AND b.b = y.m""")
def presence_overlap(t):
    return rounded(Z.presence_overlap(t("lineitem"), "l_orderkey", "l_linenumber"), "jaccard")


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey * 37 % 60)::DOUBLE AS tx, (p_partkey * 53 % 40)::DOUBLE AS ty, (p_partkey % 7)::DOUBLE / 2 AS e, 20.0 + p_size AS h FROM part)
SELECT count(*) AS points, round(avg(sqrt(2 * e * e) / h), 6) AS nme, round(avg((sqrt(2 * e * e) / h <= 0.05)::INT), 6) AS pck_05, round(avg((sqrt(2 * e * e) / h <= 0.1)::INT), 6) AS pck_10 FROM p""")
def keypoint_error(t):
    k, name = F.col("p_partkey"), F.lit("nose").alias("name")
    x, y = (k * 37 % 60).cast("double"), (k * 53 % 40).cast("double")
    truth = t("part").select(k.alias("id"), name, x.alias("x"), y.alias("y"), (20 + F.col("p_size")).cast("double").alias("h"))
    seen = t("part").select(k.alias("id"), name, (x + k % 7 / 2).alias("x"), (y + k % 7 / 2).alias("y"))
    return rounded(Z.keypoint_error(seen, truth, "h"), "nme", "pck_05", "pck_10")


@query("""SELECT n_name, sha256('identity' || chr(0) || n_name) AS token, regexp_replace(trim(lower(r_name)), '\\s+', ' ', 'g') AS label FROM nation JOIN region ON n_regionkey = r_regionkey""")
def identity_tokens(t):
    both = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_name", S.token("identity", F.col("n_name")).alias("token"), S.normalized_label(F.col("r_name")).alias("label"))


