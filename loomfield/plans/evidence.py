"""Near duplicates, graphs, splits, leakage and census queries.

Fingerprints are the signs of an embedding's 64 components, in two orientations, or four thresholds of each; identities,
sessions and domains are proxies named in each query.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.functions import scalars as S
from loomfield.functions.vectors import as_double, sign_bits
from loomfield.operators import graph as G
from loomfield.operators import leakage as L
from loomfield.operators import neardup as N
from loomfield.operators import splits as P
from loomfield.plans.registering import query, rounded

# Two rows a vector: as it is (even ids), and shifted a little, every third one also reversed (odd ids).
_SHIFTED = """WITH r AS (SELECT 2 * vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings
  UNION ALL SELECT 2 * vec_id + 1, list_transform(CASE WHEN vec_id % 3 = 0 THEN list_reverse(embedding::DOUBLE[]) ELSE embedding::DOUBLE[] END, lambda x: x + 0.015::DOUBLE) FROM embeddings)"""


def _shifted(t):
    v, k = as_double("embedding"), F.col("vec_id")
    other = F.transform(F.when(k % 3 == 0, F.reverse(v)).otherwise(v), lambda x: x + 0.015)
    return t("embeddings").select(F.explode(F.array(F.struct((2 * k).alias("id"), v.alias("e")), F.struct((2 * k + 1).alias("id"), other.alias("e")))).alias("x")).select("x.*")


# 64 signs as four words of 16 bits; a second orientation reverses them. Pairs are those of kinds, under their least ids.
_FP = _SHIFTED + """, f AS (
  SELECT id, list_transform(range(0, 4), lambda k: list_sum(list_transform(range(0, 16), lambda i: CASE WHEN e[k * 16 + i + 1] > 0 THEN CAST(2 ** i AS BIGINT) ELSE 0 END))::BIGINT) AS w,
    list_transform(range(0, 4), lambda k: list_sum(list_transform(range(0, 16), lambda i: CASE WHEN e[64 - (k * 16 + i)] > 0 THEN CAST(2 ** i AS BIGINT) ELSE 0 END))::BIGINT) AS v
  FROM r
), m AS (SELECT min(id) OVER (PARTITION BY w, v) AS representative, id AS member FROM f
), k AS (SELECT * FROM f WHERE id IN (SELECT representative FROM m)), o AS (SELECT id, 0 AS o, w FROM k UNION ALL SELECT id, 1, v FROM k), p AS (
  SELECT a.id AS left_id, b.id AS right_id, a.o AS lo, b.o AS ro, CAST(list_sum(list_transform(range(1, 5), lambda j: bit_count(xor(a.w[j], b.w[j])))) AS INTEGER) AS d
  FROM o a JOIN o b ON a.id < b.id
)
"""


def _fingerprints(t):
    v = F.col("e")
    one = lambda o, x: F.struct(F.lit(o).alias("o"), F.array(*[sign_bits(x, 16 * k, 16) for k in range(4)]).alias("words"))
    return _shifted(t).select("id", F.array(one(0, v), one(1, F.reverse(v))).alias("orientations"))


@query(_FP + """SELECT left_id, right_id, d AS distance, lo AS left_o, ro AS right_o FROM p WHERE d <= 10
QUALIFY row_number() OVER (PARTITION BY left_id, right_id ORDER BY d, lo, ro) = 1""")
def near_duplicates(t):
    kinds, _ = N.representatives(_fingerprints(t))
    return N.near_pairs(kinds, words=4, radius=10)


@query(_FP + "SELECT representative, member FROM m")
def near_duplicate_members(t):
    return N.representatives(_fingerprints(t))[1]


@query(_FP + """, e AS (SELECT left_id AS a, right_id AS b FROM p WHERE d <= 10 UNION SELECT representative, member FROM m WHERE representative <> member
), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), c AS (WITH RECURSIVE w(node, seen) AS (SELECT id, id FROM r UNION SELECT u.b, w.seen FROM w JOIN u ON u.a = w.node) SELECT node, min(seen) AS root FROM w GROUP BY node)
SELECT node, root FROM c""")
def near_duplicate_components(t):
    kinds, members = N.representatives(_fingerprints(t))
    pairs = N.near_pairs(kinds, words=4, radius=10).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    nodes = members.select(F.col("member").alias("node"))
    return G.closed(nodes, pairs.union(members.filter("representative <> member")))


# 256 bits: 64 components against four thresholds, as sixteen words.
_CUTS = (-0.1, 0.0, 0.05, 0.1)


@query(_SHIFTED + """, f AS (
  SELECT min(id) AS id, w FROM (SELECT id, list_transform(range(0, 16), lambda k: list_sum(list_transform(range(0, 16), lambda i:
    CASE WHEN e[(k % 4) * 16 + i + 1] - [-0.1::DOUBLE, 0.0, 0.05, 0.1][k // 4 + 1] > 0 THEN CAST(2 ** i AS BIGINT) ELSE 0 END))::BIGINT) AS w FROM r) GROUP BY w
), p AS (SELECT a.id AS left_id, b.id AS right_id, CAST(list_sum(list_transform(range(1, 17), lambda j: bit_count(xor(a.w[j], b.w[j])))) AS INTEGER) AS d FROM f a JOIN f b ON a.id < b.id)
SELECT left_id, right_id, d AS distance, 0 AS left_o, 0 AS right_o FROM p WHERE d <= 31""")
def near_duplicates_wide(t):
    over = lambda c: F.transform("e", lambda x: x - c)
    words = [sign_bits(over(c), 16 * k, 16) for c in _CUTS for k in range(4)]
    one = F.array(F.struct(F.lit(0).alias("o"), F.array(*words).alias("words")))
    kinds, _ = N.representatives(_shifted(t).select("id", one.alias("orientations")))
    return N.near_pairs(kinds, words=16, radius=31)


@query("""SELECT sha256(lower(text)) AS key, min(doc_id) AS representative, count(*) AS members FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicates(t):
    return N.exact_groups(t("documents"), F.sha2(F.lower("text"), 256), "doc_id")


@query("""SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows, coalesce(max(n), 0) AS largest FROM (SELECT count(*) AS n FROM documents GROUP BY lower(text) HAVING count(*) > 1)""")
def exact_duplicate_summary(t):
    return N.duplicate_summary(N.exact_groups(t("documents"), F.sha2(F.lower("text"), 256), "doc_id"))


@query("""SELECT sha256(text) AS key, count(DISTINCT source) AS sources, count(*) AS members FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""")
def cross_source_duplicates(t):
    return (
        t("documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.count_distinct("source").alias("sources"), F.count("*").alias("members")).filter("sources > 1")
    )


@query("""WITH g AS (SELECT text, min(doc_id) AS r FROM documents GROUP BY text), m AS (SELECT g.r, d.doc_id AS m FROM documents d JOIN g USING (text)),
p AS (SELECT a.r AS x, b.r AS y FROM (SELECT DISTINCT r FROM m) a JOIN (SELECT DISTINCT r FROM m) b ON b.r = a.r + 1)
SELECT least(a.m, b.m) AS left_id, greatest(a.m, b.m) AS right_id, 1 AS distance FROM p JOIN m a ON a.r = p.x JOIN m b ON b.r = p.y""")
def duplicate_pair_expansion(t):
    d = t("documents")
    first = d.groupBy("text").agg(F.min("doc_id").alias("representative"))
    members = d.join(first, "text").select("representative", F.col("doc_id").alias("member"))
    reps = first.select("representative")
    pairs = reps.select(F.col("representative").alias("left_id"), (F.col("representative") + 1).alias("right_id")).join(
        reps.select(F.col("representative").alias("right_id")), "right_id", "left_semi"
    )
    return N.expanded_pairs(pairs.select("left_id", "right_id", F.lit(1).alias("distance")), members)


# Orders as evidence: those of one customer and year, or of one total price, belong together.
_BLOCKS = """
WITH RECURSIVE o AS (SELECT o_orderkey AS node, CAST(o_custkey * 100 + year(o_orderdate) % 100 AS VARCHAR) AS k1, CAST(o_totalprice AS VARCHAR) AS k2 FROM orders
), l AS (SELECT node, 'a' || k1 AS k FROM o UNION ALL SELECT node, 'b' || k2 FROM o
), h AS (SELECT k, min(node) AS b FROM l GROUP BY k), e AS (SELECT node AS a, b FROM l JOIN h USING (k) WHERE node <> b
), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(node, seen) AS (SELECT node, node FROM o UNION SELECT u.b, w.seen FROM w JOIN u ON u.a = w.node
), c AS (SELECT node, min(seen) AS root FROM w GROUP BY node)
"""


def _blocks(t):
    o = t("orders").select(
        F.col("o_orderkey").alias("node"), (F.col("o_custkey") * 100 + F.year("o_orderdate") % 100).alias("k1"), F.col("o_totalprice").alias("k2")
    )
    return G.closed(o.select("node"), G.shared_key_edges(o, "node", ["k1", "k2"]))


@query(_BLOCKS + "SELECT node, root FROM c")
def shared_key_blocks(t):
    return _blocks(t)


@query(_BLOCKS + "SELECT root, sha256(string_agg(CAST(node AS VARCHAR), ',' ORDER BY CAST(node AS VARCHAR))) AS component_id, count(*) AS size FROM c GROUP BY root")
def component_ids(t):
    return G.component_ids(_blocks(t))


@query(_BLOCKS + "SELECT size, count(*) AS components FROM (SELECT count(*) AS size FROM c GROUP BY root) GROUP BY size")
def component_capacity(t):
    return G.component_ids(_blocks(t)).groupBy("size").agg(F.count("*").alias("components"))


@query(_BLOCKS + """SELECT node, root, root IN (SELECT root FROM c JOIN orders ON o_orderkey = node WHERE o_orderstatus = 'P') AS quarantined FROM c""")
def component_quarantine(t):
    bad = t("orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("node"))
    return G.quarantined(_blocks(t), bad)


@query("""WITH g AS (SELECT DISTINCT o_orderstatus AS dataset, o_custkey AS identity FROM orders), one AS (SELECT min(dataset) AS dataset, identity FROM g GROUP BY identity)
SELECT identity, dataset, CAST((row_number() OVER (PARTITION BY dataset ORDER BY sha256('s1' || chr(31) || identity), identity) - 1) % 5 AS INTEGER) AS fold,
  CASE (row_number() OVER (PARTITION BY dataset ORDER BY sha256('s1' || chr(31) || identity), identity) - 1) % 5 WHEN 2 THEN 'TEST' WHEN 3 THEN 'DEV' ELSE 'TRAIN' END AS role FROM one""")
def split_folds(t):
    one = t("orders").groupBy(F.col("o_custkey").alias("identity")).agg(F.min("o_orderstatus").alias("dataset"))
    return P.fold_roles(P.hash_folds(one, "identity", 5, "s1", ["dataset"]), test=2, folds=5)


@query("""WITH c AS (SELECT o_orderkey, o_orderpriority AS d, o_custkey % 37 AS i, count(*) OVER (PARTITION BY o_orderpriority, o_custkey % 37) AS s FROM orders
), n AS (SELECT d, count(DISTINCT i) AS k FROM c GROUP BY d)
SELECT o_orderkey, round((SELECT count(*) FROM c) / ((SELECT count(*) FROM n) * k * s::DOUBLE), 6) AS weight FROM c JOIN n USING (d)""")
def split_weights(t):
    rows = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("d"), (F.col("o_custkey") % 37).alias("i"))
    return rounded(P.hierarchical_weights(rows, "d", "i").select("o_orderkey", "weight"), "weight")


@query("""WITH k AS (SELECT DISTINCT o_custkey AS c FROM orders), r AS (SELECT c, row_number() OVER (ORDER BY sha256('dev' || chr(31) || c), c) AS r, count(*) OVER () AS n FROM k)
SELECT c AS o_custkey, CASE WHEN r <= greatest(1, least(n - 1, floor(n * 0.2 + 0.5))) THEN 'DEV' ELSE 'TRAIN' END AS role FROM r""")
def split_dev_identities(t):
    return P.dev_identities(t("orders"), "o_custkey", 0.2, "dev")


@query("""WITH u AS (SELECT DISTINCT o_custkey AS i, o_orderpriority AS u FROM orders), r AS (
  SELECT i, u, count(*) OVER (PARTITION BY i) AS n, row_number() OVER (PARTITION BY i ORDER BY sha256('gq' || chr(31) || i || chr(31) || u), u) AS r FROM u)
SELECT o_orderkey, CASE WHEN r = 1 THEN 'GALLERY' ELSE 'QUERY' END AS role FROM orders JOIN r ON i = o_custkey AND u = o_orderpriority WHERE n >= 2""")
def split_gallery_query(t):
    return P.gallery_and_queries(t("orders"), "o_custkey", "o_orderpriority", "gq").select("o_orderkey", "role")


@query("""WITH s AS (SELECT o_custkey, o_orderpriority, arg_min(o_orderkey, (sha256('bq' || chr(31) || o_orderkey), o_orderkey)) AS o_orderkey, min(sha256('bq' || chr(31) || o_orderkey)) AS h FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderpriority, o_orderkey FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY h, o_orderkey) <= 2""")
def split_bounded_queries(t):
    return P.bounded_queries(t("orders"), "o_custkey", "o_orderpriority", "o_orderkey", 2, "bq")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE n <= 4 OR list_contains(list_transform(range(0, 4), lambda i: i * (n - 1) // 3), k)""")
def select_evenly(t):
    return P.evenly_spaced(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 4)


@query("""SELECT o_orderkey, o_orderpriority, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('rr' || chr(31) || o_orderkey), o_orderkey) AS turn FROM orders)
ORDER BY turn, o_orderpriority LIMIT 23""")
def select_round_robin(t):
    return P.round_robin(t("orders"), "o_orderpriority", "o_orderkey", 23, "rr").select("o_orderkey", "o_orderpriority", "turn")


@query("""WITH x AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k, count(*) OVER (PARTITION BY c_nationkey) AS n,
  ('0x' || substr(sha256('rot' || chr(31) || c_nationkey), 1, 12))::BIGINT AS h FROM customer)
SELECT c_nationkey, c_custkey, CAST((k - h % n + n) % n AS BIGINT) AS position FROM x""")
def select_rotated(t):
    return P.rotated(t("customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", "rot").withColumn("position", F.col("position").cast("long"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a FROM orders)
SELECT o_custkey, o_orderkey, CASE WHEN a <= 3 THEN 'GALLERY' ELSE 'QUERY' END AS role FROM r WHERE n >= 8 AND (a <= 3 OR n + 1 - a <= 3)""")
def select_first_and_last(t):
    return P.first_and_last(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"], 3, 8).drop("o_orderdate")


def _pairing(t):
    rows = t("orders").select(
        F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("identity"), F.col("o_orderpriority").alias("session"),
        (F.col("o_custkey") % 50).alias("brand"), (F.col("o_custkey") % 3).alias("size"),
    )
    return rows, rows


_SIDES = """
WITH o AS (SELECT o_orderkey AS item, o_custkey AS identity, o_orderpriority AS session, o_custkey % 50 AS brand, o_custkey % 3 AS size FROM orders
), g AS (SELECT * FROM o), q AS (SELECT * FROM o)
"""


@query(_SIDES + """SELECT q.item AS query, q.identity, g.item AS reference FROM q JOIN g ON g.identity = q.identity AND g.session <> q.session
QUALIFY row_number() OVER (PARTITION BY q.item ORDER BY sha256('pos' || chr(31) || q.item || chr(31) || g.item), g.item) <= 2""")
def pairs_positive(t):
    return P.positive_pairs(*_pairing(t), 2, "pos")


@query(_SIDES + """, b1 AS (SELECT brand, identity AS other, min((sha256('neg/brand' || chr(31) || item), item)) AS b FROM g GROUP BY ALL
), t1 AS (SELECT q.item AS query, q.identity, b1.other, b1.b[2] AS reference, 'brand' AS stratum FROM q JOIN b1 ON b1.brand = q.brand AND b1.other <> q.identity
  QUALIFY row_number() OVER (PARTITION BY q.item ORDER BY b1.b[1], b1.other) <= 2
), b2 AS (SELECT size, identity AS other, min((sha256('neg/size' || chr(31) || item), item)) AS b FROM g GROUP BY ALL
), t2 AS (SELECT q.item AS query, q.identity, b2.other, b2.b[2] AS reference, 'size' AS stratum FROM q JOIN b2 ON b2.size = q.size AND b2.other <> q.identity
  WHERE NOT EXISTS (SELECT 1 FROM t1 WHERE t1.query = q.item AND t1.other = b2.other) QUALIFY row_number() OVER (PARTITION BY q.item ORDER BY b2.b[1], b2.other) <= 3)
SELECT * FROM t1 UNION ALL SELECT * FROM t2""")
def pairs_negative(t):
    return P.negative_pairs(*_pairing(t), [("brand", "brand", 2), ("size", "size", 3)], "neg")


@query("""WITH n AS (SELECT l_returnflag || l_linestatus AS grp, count(*) AS n FROM lineitem GROUP BY 1), x AS (SELECT *, n * 1000 / (SELECT sum(n) FROM n) AS x FROM n
), r AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, grp) AS r FROM x)
SELECT grp, n, CAST(floor(x) + CASE WHEN r <= 1000 - (SELECT sum(floor(x)) FROM x) THEN 1 ELSE 0 END AS BIGINT) AS share FROM r""")
def quota_shares(t):
    return P.shares(t("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("grp")), "grp", 1000)


@query("""WITH RECURSIVE n AS (SELECT CAST(c_nationkey AS VARCHAR) AS block, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST(c_nationkey AS VARCHAR)) AS k FROM customer GROUP BY 1
), g(k, loads, block, fold) AS (SELECT 0, [0, 0, 0, 0]::BIGINT[], NULL::VARCHAR, NULL::INTEGER UNION ALL
  SELECT n.k, list_transform(g.loads, lambda x, i: CASE WHEN i = list_position(g.loads, list_min(g.loads)) THEN x + n.n ELSE x END), n.block, CAST(list_position(g.loads, list_min(g.loads)) - 1 AS INTEGER) FROM g JOIN n ON n.k = g.k + 1)
SELECT block, fold FROM g WHERE k > 0""")
def greedy_block_folds(t):
    """Customers of a nation are a block; blocks (25) are placed greedily."""
    n = t("customer").groupBy("c_nationkey").count().collect()
    folds = P.greedy_folds([(str(r.c_nationkey), r["count"]) for r in n], 4)
    return t("customer").sparkSession.createDataFrame(sorted(folds.items()), "block string, fold int")


@query("""WITH o AS (SELECT user_id, epoch_us(ts) AS tus, min(event_id) AS event_id FROM events GROUP BY ALL), c1 AS (SELECT user_id, [min(tus)] AS t FROM o GROUP BY 1
), d1 AS (SELECT user_id, o.tus, list_min(list_transform(t, lambda x: abs(o.tus - x))) AS d FROM o JOIN c1 USING (user_id)), n1 AS (SELECT user_id, arg_min(tus, (-d, tus)) AS nx FROM d1 WHERE d >= 500000 AND d > 0 GROUP BY 1
), c2 AS (SELECT user_id, CASE WHEN nx IS NULL THEN t ELSE list_append(t, nx) END AS t FROM c1 LEFT JOIN n1 USING (user_id)
), d2 AS (SELECT user_id, o.tus, list_min(list_transform(t, lambda x: abs(o.tus - x))) AS d FROM o JOIN c2 USING (user_id)), n2 AS (SELECT user_id, arg_min(tus, (-d, tus)) AS nx FROM d2 WHERE d >= 500000 AND d > 0 GROUP BY 1
), c3 AS (SELECT user_id, CASE WHEN nx IS NULL THEN t ELSE list_append(t, nx) END AS t FROM c2 LEFT JOIN n2 USING (user_id)
), d3 AS (SELECT user_id, o.tus, list_min(list_transform(t, lambda x: abs(o.tus - x))) AS d FROM o JOIN c3 USING (user_id)), n3 AS (SELECT user_id, arg_min(tus, (-d, tus)) AS nx FROM d3 WHERE d >= 500000 AND d > 0 GROUP BY 1
), c4 AS (SELECT user_id, CASE WHEN nx IS NULL THEN t ELSE list_append(t, nx) END AS t FROM c3 LEFT JOIN n3 USING (user_id)
) SELECT o.user_id, event_id, o.tus AS "at" FROM o JOIN c4 USING (user_id) WHERE list_contains(t, o.tus)""")
def capture_farthest_in_time(t):
    rows = t("events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return P.farthest_in_time(rows, "user_id", "event_id", "at", 4, 500_000.0)


# Leakage and association: suppliers are domains, parts identities.
@query("""WITH v AS (SELECT DISTINCT l_orderkey AS e, l_partkey % 97 AS i, l_suppkey % 13 AS d FROM lineitem), p AS (SELECT i, d, count(*) AS n FROM v GROUP BY ALL
), a AS (SELECT i, sum(n) AS n, max(n) AS m FROM p GROUP BY i), b AS (SELECT d, sum(n) AS n, max(n) AS m FROM p GROUP BY d), t AS (SELECT sum(n) AS t FROM p
), mi AS (SELECT sum(p.n / t * ln(p.n * t / (a.n * b.n))) AS x FROM p JOIN a USING (i) JOIN b USING (d), t), hi AS (SELECT -sum(n / t * ln(n / t)) AS x FROM a, t), hd AS (SELECT -sum(n / t * ln(n / t)) AS x FROM b, t)
SELECT CAST(t AS BIGINT) AS events, (SELECT count(*) FROM a) AS identities, (SELECT count(*) FROM b) AS domains, round(mi.x, 6) AS mutual_information, round(mi.x / sqrt(hi.x * hd.x), 6) AS nmi,
  round((SELECT sum(m) FROM b) / t, 6) AS domain_majority, round((SELECT max(n) FROM a) / t, 6) AS global_majority, round((SELECT sum(m) FROM a) / t, 6) AS identity_concentration FROM t, mi, hi, hd""")
def association_audit(t):
    rows = t("lineitem").select("l_orderkey", (F.col("l_partkey") % 97).alias("i"), (F.col("l_suppkey") % 13).alias("d"))
    return rounded(L.association(rows, ["l_orderkey"], "i", "d"), "mutual_information", "nmi", "domain_majority", "global_majority", "identity_concentration")


def _roles(t):
    return t("orders").select(
        F.when(F.col("o_orderkey") % 10 < 7, "TRAIN").when(F.col("o_orderkey") % 10 < 8, "DEV").otherwise("TEST").alias("role"),
        F.col("o_custkey").alias("customer"), F.col("o_orderdate").cast("date").alias("day"),
    )


_ROLES = """WITH r AS (SELECT CASE WHEN o_orderkey % 10 < 7 THEN 'TRAIN' WHEN o_orderkey % 10 < 8 THEN 'DEV' ELSE 'TEST' END AS role, CAST(o_custkey AS VARCHAR) AS customer, CAST(o_orderdate::DATE AS VARCHAR) AS day FROM orders
), l AS (SELECT role, 'customer' AS kind, customer AS token FROM r UNION ALL SELECT role, 'day', day FROM r)"""


@query(_ROLES + "SELECT kind, token, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM l GROUP BY kind, token HAVING count(DISTINCT role) > 1")
def leakage_role_overlaps(t):
    return L.role_overlaps(_roles(t), ["customer", "day"])


@query(_ROLES + "SELECT kind, token FROM l WHERE role = 'TRAIN' INTERSECT SELECT kind, token FROM l WHERE role = 'TEST'")
def leakage_shared_values(t):
    r = _roles(t)
    return L.shared_values(r.filter("role = 'TRAIN'"), r.filter("role = 'TEST'"), ["customer", "day"])


@query("""SELECT DISTINCT least(l_partkey, l_suppkey) AS "left", greatest(l_partkey, l_suppkey) AS "right" FROM lineitem WHERE l_linenumber = 1
INTERSECT SELECT least(l_suppkey, l_partkey), greatest(l_suppkey, l_partkey) FROM lineitem WHERE l_linenumber = 2""")
def leakage_reversed_pairs(t):
    li = t("lineitem")
    a = li.filter("l_linenumber = 1").select(F.col("l_partkey").alias("left"), F.col("l_suppkey").alias("right"))
    b = li.filter("l_linenumber = 2").select(F.col("l_suppkey").alias("left"), F.col("l_partkey").alias("right"))
    return L.reversed_pairs(a, b)


@query("""WITH g AS (SELECT o_custkey, max(epoch_us(o_orderdate) // 1000000) AS last_end FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1)
SELECT o_orderkey, o_custkey FROM orders JOIN g USING (o_custkey) WHERE o_orderkey % 3 = 0 AND epoch_us(o_orderdate) // 1000000 - last_end < 8640000""")
def leakage_too_early(t):
    o = t("orders").withColumn("at", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    late = L.too_early(o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 3 = 0"), "o_custkey", "at", "at", 8_640_000)
    return late.select("o_orderkey", "o_custkey")


@query("""SELECT DISTINCT o_custkey, 'KNOWN_WITHOUT_GALLERY' AS rule FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT DISTINCT o_custkey, 'UNKNOWN_WITH_GALLERY' FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def leakage_open_set(t):
    o = t("orders")
    return L.open_set_breaches(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "o_custkey")


@query("""WITH g AS (SELECT o_custkey, o_orderpriority AS s FROM orders WHERE o_orderkey % 2 = 0), q AS (SELECT o_custkey, o_orderpriority AS s FROM orders WHERE o_orderkey % 2 = 1)
SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM g INTERSECT SELECT DISTINCT o_custkey FROM q) x WHERE NOT EXISTS (SELECT 1 FROM g JOIN q USING (o_custkey) WHERE g.o_custkey = x.o_custkey AND g.s <> q.s)""")
def leakage_unchanged_signature(t):
    o = t("orders")
    return L.unchanged(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), "o_custkey", F.col("o_orderpriority"))


@query("""WITH h AS (SELECT CAST(o_custkey AS VARCHAR) AS token, max(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) AS was FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
n AS (SELECT CAST(o_custkey AS VARCHAR) AS token, min(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) AS now FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT 'o_custkey' AS kind, token, now, was FROM n JOIN h USING (token) WHERE was > now""")
def leakage_stage_regressions(t):
    o = t("orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("stage"))
    return L.stage_regressions(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), ["o_custkey"], ["O", "P", "F"])


@query("""SELECT 'mean' AS code, avg(l_quantity) AS value, 10.0::DOUBLE AS "limit" FROM lineitem""")
def gate_limits(t):
    summary = t("lineitem").agg(F.avg("l_quantity").alias("mean"), F.max("l_discount").alias("top"))
    return L.limit_breaches(summary, {"mean": 10, "top": 1})


@query("""WITH r AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A')
SELECT l_partkey, 'left' AS side FROM r WHERE l_partkey NOT IN (SELECT l_partkey FROM a) UNION ALL SELECT l_partkey, 'right' FROM a WHERE l_partkey NOT IN (SELECT l_partkey FROM r)""")
def gate_same_rows(t):
    of = lambda flag: t("lineitem").filter(F.col("l_returnflag") == flag).select("l_partkey").distinct()
    return L.same_rows(of("R"), of("A"))


@query("""WITH c AS (SELECT o_orderstatus AS lineage, o_orderkey AS "start", o_orderkey + 1 AS "end" FROM orders)
SELECT * FROM (SELECT *, coalesce(lag("end") OVER (PARTITION BY lineage ORDER BY "start"), 0) AS expected FROM c) WHERE "start" <> expected""")
def gate_chunk_cover(t):
    c = t("orders").select(F.col("o_orderstatus").alias("lineage"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 1).alias("end"))
    return L.chunk_breaks(c)


@query("""SELECT grouping_id(l_returnflag, l_linestatus, l_linenumber)::BIGINT AS gid, l_returnflag, l_linestatus, l_linenumber, count(*) AS n, count(DISTINCT l_suppkey) AS identities FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber), (l_returnflag, l_linestatus), (l_returnflag, l_linenumber), ())""")
def census(t):
    flag, status, line = (F.col(c) for c in ("l_returnflag", "l_linestatus", "l_linenumber"))
    sets = [[flag], [status], [line], [flag, status], [flag, line], []]
    grouped = t("lineitem").groupingSets(sets, flag, status, line)
    return grouped.agg(F.grouping_id().cast("long").alias("gid"), F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("identities"))


@query("""WITH i AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1)
SELECT CASE WHEN n = 0 THEN 'IDENTITY_FREE' WHEN n = 1 THEN 'SINGLETON' WHEN n <= 4 THEN 'SMALL_2_4' WHEN n <= 19 THEN 'MEDIUM_5_19' ELSE 'LARGE_20_PLUS' END AS size,
  CASE WHEN f = 0 THEN 'ZERO' WHEN f = n THEN 'ALL' WHEN 4 * f <= n THEN 'LOW' WHEN 2 * f <= n THEN 'MID' ELSE 'HIGH' END AS rate, count(*) AS identities FROM i GROUP BY 1, 2""")
def census_strata(t):
    i = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"))
    return i.groupBy(S.size_bucket(F.col("n")).alias("size"), S.rate_bucket(F.col("f"), F.col("n")).alias("rate")).agg(F.count("*").alias("identities"))


@query("""WITH i AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT (SELECT count(*) FROM orders) AS samples, count(*) AS identities, min(n) AS fewest, max(n) AS most, round(avg(n), 6) AS mean, round(median(n), 6) AS median,
  round((SELECT avg((o_orderstatus = 'F')::INT) FROM orders), 6) AS labelled FROM i""")
def dataset_statistics(t):
    o = t("orders")
    i = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"))
    return rounded(
        i.agg(
            F.sum("n").alias("samples"), F.count("*").alias("identities"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.avg("n").alias("mean"),
            F.median("n").alias("median"), (F.sum("f") / F.sum("n")).alias("labelled"),
        ),
        "mean", "median", "labelled",
    )


@query("""SELECT l_returnflag AS stratum, round(sum(l_discount) / sum(l_tax), 6) AS micro, round(avg(CASE WHEN l_tax > 0 THEN l_discount / l_tax END), 6) AS macro FROM lineitem GROUP BY 1
UNION ALL SELECT 'all', round(sum(l_discount) / sum(l_tax), 6), round(avg(CASE WHEN l_tax > 0 THEN l_discount / l_tax END), 6) FROM lineitem""")
def micro_macro(t):
    r = t("lineitem").rollup("l_returnflag").agg(
        (F.sum("l_discount") / F.sum("l_tax")).alias("micro"), F.avg(F.when(F.col("l_tax") > 0, F.col("l_discount") / F.col("l_tax"))).alias("macro")
    )
    return rounded(r.select(F.coalesce("l_returnflag", F.lit("all")).alias("stratum"), "micro", "macro"), "micro", "macro")


@query("""WITH m AS (SELECT 'quality' AS metric, quality AS v FROM labels UNION ALL SELECT 'toxic', toxic FROM labels)
SELECT metric, round(avg(v), 6) AS value, CAST(count(*) AS BIGINT) AS denominator, NULL::VARCHAR AS note FROM m GROUP BY metric UNION ALL SELECT 'absent', NULL, 0, 'NOT_APPLICABLE'""")
def master_table(t):
    labels = t("labels")
    parts = [labels.agg(F.lit(m).alias("metric"), F.round(F.avg(m), 6).alias("value"), F.count("*").alias("denominator")) for m in ("quality", "toxic")]
    absent = labels.sparkSession.createDataFrame(
        [("absent", None, 0, "NOT_APPLICABLE")],
        T.StructType([T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("denominator", T.LongType()), T.StructField("note", T.StringType())]),
    )
    return L.union_all([absent, *parts]).select("metric", "value", "denominator", "note")
