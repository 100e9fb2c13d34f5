"""Literal cases and properties of the library's operators."""

import hashlib
import math
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomfield.functions import scalars as S
from loomfield.operators import coverage as C
from loomfield.operators import evidence as E
from loomfield.operators import geometry as Z
from loomfield.operators import graph as G
from loomfield.operators import leakage as L
from loomfield.operators import metrics as M
from loomfield.operators import neardup as N
from loomfield.operators import ranking as K
from loomfield.operators import registry as R
from loomfield.operators import search as X
from loomfield.operators import splits as P
from loomfield.streaming.sessions import sessions


def test_association_literals(spark):
    one = spark.createDataFrame([(k, k, k) for k in range(4)], "e int, i int, d int")
    r = L.association(one.union(one), ["e"], "i", "d").first()
    assert (r.events, round(r.nmi, 9), r.domain_majority, r.global_majority, r.identity_concentration) == (4, 1.0, 1.0, 0.25, 1.0)
    two = spark.createDataFrame([(k, k % 2, k // 2) for k in range(4)], "e int, i int, d int")
    r = L.association(two, ["e"], "i", "d").first()
    assert abs(r.nmi) < 1e-9 and (r.domain_majority, r.global_majority, r.identity_concentration) == (0.5, 0.5, 0.5)
    alone = spark.createDataFrame([(0, 0, 0)], "e int, i int, d int")
    assert L.association(alone, ["e"], "i", "d").first().nmi is None


def sides(spark, queries, gallery):
    shape = "id long, identity int, channels array<array<double>>, group long, excluded array<long>"
    return spark.createDataFrame(queries, shape), spark.createDataFrame(gallery, shape)


def test_search_ties_and_exclusions(spark):
    q, g = sides(
        spark,
        [(1, 0, [[1.0, 0.0], None], None, [12]), (2, 0, [None, [1.0]], None, None)],
        [(10, 5, [[2.0, 0.0], None], 1, None), (11, 4, [[3.0, 0.0], [1.0]], 1, None), (12, 3, [[9.0, 0.0], None], 1, None), (13, 4, [[1.0, 0.0], [-1.0]], 1, None)],
    )
    got = [tuple(r) for r in X.top_identities(X.best_templates(q, g, [0.5, 0.5]), 5).orderBy("query_id", "rank").select("query_id", "rank", "identity", "template_id", "score").collect()]
    assert got == [(1, 1, 4, 11, 1.0), (1, 2, 5, 10, 1.0), (2, 1, 4, 11, 1.0)]


def test_search_is_exact_with_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(X, "QUERY_ROWS", 5)
    monkeypatch.setattr(X, "GALLERY_ROWS", 7)
    rng = np.random.default_rng(0)
    vec = [[float(x) for x in rng.normal(size=3)] for _ in range(60)]
    q, g = sides(spark, [(k, 0, [v], None, None) for k, v in enumerate(vec[:20])], [(k, k % 6, [v], None, None) for k, v in enumerate(vec[20:])])
    got = {(r.query_id, r.identity): r.score for r in X.best_templates(q, g).collect()}
    unit = np.array(vec) / np.linalg.norm(vec, axis=1)[:, None]
    s = np.round(unit[:20] @ unit[20:].T, 6)
    assert got == {(i, k): s[i, k::6].max() for i in range(20) for k in range(6)}


def test_open_set_literals(spark):
    rows = spark.createDataFrame([(1, True, True, 1.0), (2, True, True, 1.0), (3, False, False, 0.0)], "query_id int, known boolean, correct boolean, score double")
    t = M.open_set_thresholds(rows, spark.createDataFrame([(0.0,), (0.5,)], "target_fpir double"))
    out = M.open_set_outcomes(rows, t).collect()
    assert [(r.dir, r.fpir) for r in out] == [(1.0, 0.0)] * 2
    bad = spark.createDataFrame([(1, True, False, 1.0), (2, False, False, 0.7)], "query_id int, known boolean, correct boolean, score double")
    r = M.open_set_outcomes(bad, t.filter("target_fpir = 0")).first()
    assert r.dir == 0.0 and r.misidentified == 1


def test_curve_needs_a_finite_threshold(spark):
    pairs = spark.createDataFrame([(0.9, 0), (0.1, 1)], "score double, label int")
    curve = M.verification_curve(M.score_counts(pairs))
    targets = spark.createDataFrame([(0.0,), (1.0,)], "target_far double")
    assert [(r.target_far, r.threshold) for r in M.threshold_at_far(curve, targets).collect()] == [(1.0, 0.1)]


def test_binomial_scalars(spark):
    r = spark.range(1).select(
        S.zero_event_upper(F.lit(59)).alias("u"), S.trials_for_zero_events(F.lit(0.05)).alias("n"), S.log_add_exp(F.lit(math.log(2)), F.lit(math.log(3))).alias("l")
    ).first()
    assert abs(r.u - (1 - 0.05 ** (1 / 59))) < 1e-12 and r.n == 59 and abs(math.exp(r.l) - 5) < 1e-12


def test_registered_ids(spark):
    df = spark.createDataFrame([("set:1", 1), ("set:é", 1)], "key string, images long")
    want = {k: str(uuid.uuid5(uuid.UUID(R.NAMESPACE), k)) for k in ("set:1", "set:é")}
    assert {r.key: r.registered_id for r in R.with_ids(df, "key").collect()} == want


@pytest.mark.parametrize(("flips", "found"), [(9, True), (10, True), (11, False)])
def test_spread_bits_are_found_up_to_the_radius(spark, flips, found):
    words = [0, 0, 0, 0]
    for k in range(flips):
        words[k % 4] |= 1 << (k // 4)
    rows = [("a", [(0, [0, 0, 0, 0])]), ("b", [(0, words)])]
    df = spark.createDataFrame(rows, "id string, orientations array<struct<o: int, words: array<long>>>")
    got = [(r.left_id, r.right_id, r.distance) for r in N.near_pairs(df, words=4, radius=10).collect()]
    assert got == ([("a", "b", flips)] if found else [])


def test_copies_are_joined_once(spark):
    rows = [(k, [(0, [5])]) for k in range(9)] + [(20, [(0, [4])]), (21, [(0, [4])])]
    df = spark.createDataFrame(rows, "id int, orientations array<struct<o: int, words: array<long>>>")
    kinds, members = N.representatives(df)
    pairs = N.near_pairs(kinds, words=1, radius=1)
    assert [(r.left_id, r.right_id) for r in pairs.collect()] == [(0, 20)] and members.count() == 11
    assert N.expanded_pairs(pairs.select("left_id", "right_id", "distance"), members).count() == 18


def test_wide_fingerprints_with_orientations(spark):
    rng = np.random.default_rng(3)
    rows, prints = [], {}
    for k in range(12):
        base = [int(x) for x in rng.integers(0, 1 << 16, 16)] if k % 3 == 0 else [w ^ (1 << int(rng.integers(0, 16))) for w in prints[k - k % 3][0]]
        prints[k] = [base, base[::-1]]
        rows.append((k, list(enumerate(prints[k]))))
    df = spark.createDataFrame(rows, "id int, orientations array<struct<o: int, words: array<long>>>")
    d = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
    want = {(a, b): m for a in prints for b in prints if a < b and (m := min(d(x, y) for x in prints[a] for y in prints[b])) <= 31}
    assert {(r.left_id, r.right_id): r.distance for r in N.near_pairs(df, words=16, radius=31).collect()} == want and want


def shuffled_rows(spark) -> int:
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_near_pairs_are_probed_where_they_arrive(spark):
    """A fingerprint is sent to the cells in reach, not to each of the 4 * 137 values in reach."""
    rng = np.random.default_rng(8)
    rows = [(k, [(0, [int(x) for x in rng.integers(0, 1 << 16, 4)])]) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, orientations array<struct<o: int, words: array<long>>>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_rows(spark)
        N.near_pairs(df, words=4, radius=10).collect()
        assert shuffled_rows(spark) - before < 300 * 4 * 137 / 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_meet_the_minima_of_their_keys_in_one_shuffle(spark):
    rows = spark.range(20000).selectExpr("if(id % 50 = 0, null, id % 9000) AS key", "id AS v")
    before = shuffled_rows(spark)
    got = {(r.key, r.v): r.least for r in K.least_of_key(rows, "key", "v", "least", "v").collect()}
    assert shuffled_rows(spark) - before < 1.1 * 20000
    least = {}
    for key, v in got:
        least[key] = min(v, least.get(key, v))
    assert len(got) == 19600 and all(m == least[key] for (key, _), m in got.items())
    hot = spark.range(30000).selectExpr("if(id % 10 > 0, 7, id) AS key", "30000 - id AS v")
    plain = K.with_least(hot, "key", "v", "least", "v")
    assert sorted(K.least_of_key(hot, "key", "v", "least", "v").collect()) == sorted(plain.select("key", "v", "least").collect())


@pytest.mark.parametrize("at_once", [1024, 7])
def test_positive_pairs_are_not_shuffled(spark, no_broadcast, at_once):
    rows = [(k, 0 if k < 80 else k % 40 + 1, f"s{k % 5}" if k % 9 else None) for k in range(200)] + [(900, None, "s1")]
    df = spark.createDataFrame(rows, "item long, identity long, session string")
    want = set()
    for q, i, s in rows:
        fits = [r for r, j, t in rows if i is not None and i == j and s and t and s != t]
        want |= {(q, i, r) for r in sorted(fits, key=lambda r: (hashlib.sha256(f"p\x1f{q}\x1f{r}".encode()).hexdigest(), r))[:2]}
    before = shuffled_rows(spark)
    got = [tuple(r) for r in P.positive_pairs(df, df, 2, "p", at_once=at_once).collect()]
    assert set(got) == want and len(got) == len(want) and shuffled_rows(spark) - before < 4000  # there are about 5,000 pairs


def test_kinds_of_evidence_are_flags_and_not_sets(spark):
    """A set a pair is an object on the heap; flags lie in the aggregate's own pages."""
    of = lambda *pairs: spark.createDataFrame(list(pairs), "left_id long, right_id long")
    found = E.gathered({"B": of((1, 2), (1, 2), (3, 4)), "A": of((1, 2)), "C": of((5, 6), (3, 4))})
    assert {tuple(r) for r in found.collect()} == {(1, 2, "A,B"), (3, 4, "B,C"), (5, 6, "C")}
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in G.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100 + k: 100 for k in range(40)} | {200: 200, 201: 200}


def test_subset_sum_and_greedy():
    assert P.subset_with_sum([("a", 5), ("b", 3), ("c", 4)], 7) == ["b", "c"]
    assert P.subset_with_sum([("a", 2), ("b", 2)], 3) is None
    assert P.greedy_folds([("a", 5), ("b", 3), ("c", 3)], 2) == {"a": 0, "b": 1, "c": 1}


def test_coverage_literals(spark):
    rows = spark.createDataFrame([("c", 0, True, "k"), ("c", 100, True, "k"), ("c", 900, True, "k"), ("c", 1000, False, "k")], "s string, at long, ok boolean, k string")
    held = C.held(rows, "s", "at", 200, 100)
    assert [(r.held, r.gap) for r in held.orderBy("at").collect()] == [(100, 0), (200, 600), (100, 0), (100, 0)]
    runs = C.runs(held, "s", "at", F.col("ok"), F.col("k"), 200).collect()
    assert [(r.start, r.duration, r["rows"]) for r in runs] == [(0, 300, 2)]


def test_three_valued(spark):
    df = spark.createDataFrame([(1, None), (None, 0), (1, 0), (1, 1)], "a int, b int")
    got = df.select(C.three_valued([F.col("a") == 1, F.col("b") == 1], [F.col("a"), F.col("b")]).alias("x")).collect()
    assert [r.x for r in got] == [None, None, False, True]


def test_sessions(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:30"), ("a", "2024-01-01 00:05:00")], "s string, at string").withColumn("at", F.to_timestamp("at"))
    assert [r["rows"] for r in sessions(df, "s", "at", "1 minute", "1 hour").orderBy("start").collect()] == [2, 1]


def test_matching_and_suppression(spark):
    shape = "image long, id long, x1 double, y1 double, x2 double, y2 double, confidence double"
    p = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 0.0, 11.0, 10.0, 0.8), (2, 3, 0.0, 0.0, 1.0, 1.0, 0.5)], shape)
    t = p.filter("id <> 1").drop("confidence")
    assert {(r.predicted, r.truth) for r in Z.matched(p, t, 0.5).collect()} == {(2, 2), (3, 3)}
    assert {(r.predicted, r.truth) for r in Z.matched(p, t, 0.5, by_confidence=True).collect()} == {(1, 2), (3, 3)}
    assert {r.id for r in Z.suppressed(p).collect()} == {1, 3}
    assert [(r.tp, r.precision) for r in Z.detection_summary(Z.matched(p, t, 0.5), 3, 2, (0.5,)).collect()] == [(2, 2 / 3)]


def test_consensus_matches_numpy(spark):
    from loomfield.operators.decisions import consensus

    rng = np.random.default_rng(11)
    v = rng.normal(size=(30, 4)) * 0.2 + np.array([1.0, 0, 0, 0])
    v[[3, 17]] = [[-1, 0, 0, 0.1], [0, -1, 0.2, 0]]
    q = np.round(rng.random(30), 3)
    df = spark.createDataFrame([(0, k, [float(x) for x in v[k]], float(q[k])) for k in range(30)], "g int, i int, v array<double>, q double")
    r = consensus(df, "v", "q", "g", "i").first()
    u, w = v / np.linalg.norm(v, axis=1)[:, None], np.maximum(q, 1e-6)
    m = (u * w[:, None]).sum(0)
    c = u @ (m / np.linalg.norm(m))
    mad = np.median(abs(c - np.median(c)))
    ok = c >= np.median(c) - 2.5 * max(mad, 0.02)
    m = (u[ok] * w[ok, None]).sum(0)
    m /= np.linalg.norm(m)
    assert r.accepted == ok.sum() < 30 and np.allclose(r["mean"], m)
    assert np.isclose(r.dispersion, (w[ok] * (1 - u[ok] @ m)).sum() / w[ok].sum())


def test_places_over_many_partitions(spark):
    from loomfield.operators.ranking import numbered, running_sums

    rows = spark.range(500).select((F.col("id") * 7919 % 503).alias("k"), (F.col("id") % 3).alias("g"), (F.col("id") % 5).alias("x"))
    got = sorted(running_sums(rows, [F.col("k")], {"s": F.col("x")}).collect(), key=lambda r: r.k)
    assert [r.s for r in got] == list(np.cumsum([r.x for r in got]))
    by = numbered(rows, [F.col("k").desc()], "n", ["g"]).collect()
    for g in range(3):
        own = sorted((r for r in by if r.g == g), key=lambda r: -r.k)
        assert [r.n for r in own] == list(range(1, len(own) + 1))


def test_blocks_of_all_orders_match_brute_force(spark):
    from loomfield import plans

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS n", "o_custkey * 100 + year(o_orderdate) % 100 AS a", "o_totalprice AS b", "o_orderstatus AS s").collect()
    own, first = {r.n: r.n for r in rows}, {}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for r in rows:
        for key in (("a", r.a), ("b", r.b)):
            x, y = root(r.n), root(first.setdefault(key, r.n))
            own[max(x, y)] = min(x, y)
    want = {r.n: root(r.n) for r in rows}
    sizes, bad = {}, {want[r.n] for r in rows if r.s == "P"}
    for x in want.values():
        sizes[x] = sizes.get(x, 0) + 1
    run = lambda name: plans.queries()[name](spark, sf).collect()
    assert {r.node: r.root for r in run("shared_key_blocks")} == want
    assert {r.root: r["size"] for r in run("component_ids")} == sizes
    assert {r["size"]: r.components for r in run("component_capacity")} == {n: list(sizes.values()).count(n) for n in sizes.values()}
    assert {r.node: r.quarantined for r in run("component_quarantine")} == {n: x in bad for n, x in want.items()}


def hot(spark, n=4000):
    """One key in 9 of 10 rows, nulls among the others."""
    rows = [(k, "hot" if k % 10 else (None if k % 100 == 0 else f"k{k % 7}")) for k in range(n)]
    return spark.createDataFrame(rows, "node long, key string").repartition(4)


def largest_task(spark, df):
    """Rows of the largest partition that a join hands on, broadcasts off."""
    tasks = df.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n"), F.max(F.xxhash64(*df.columns)))
    return max(r.n for r in tasks.collect())


@pytest.fixture
def no_broadcast(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_hot_keys_are_dealt(spark, no_broadcast):
    rows = hot(spark)
    other = rows.dropna().groupBy("key").agg(F.count("*").alias("size"))
    plain = rows.join(other, "key", "left")
    assert largest_task(spark, plain) > 3000
    for how in ("left", "inner", "left_semi", "left_anti"):
        dealt, want = K.salted_join(rows, other, ["key"], ["node"], how), rows.join(other, ["key"], how)
        assert sorted(map(str, dealt.collect())) == sorted(map(str, want.collect())) and dealt.columns == want.columns
        if how != "left_anti":
            assert largest_task(spark, dealt) < 1000
    twice = other.union(other)
    assert K.salted_join(rows, twice, ["key"], ["node"]).count() == 2 * rows.dropna().count()
    assert K.salted_join(rows.limit(0), other, ["key"], ["node"]).count() == 0
    least = K.with_least(rows, "key", "node", "least", "node")
    assert largest_task(spark, least) < 1000 and {r.least for r in least.filter("key = 'hot'").collect()} == {1}
    most = K.with_least(rows, "key", "node", "most", "node", extreme=F.max)
    assert {r.most for r in most.filter("key = 'hot'").collect()} == {3999}
    placed = K.numbered(rows, [F.col("node").desc()], "place", ["key"])
    assert largest_task(spark, placed) < 1000
    want = {}
    for node, key in sorted(((r.node, r.key) for r in rows.dropna().collect()), reverse=True):
        want.setdefault(key, []).append(node)
    assert {(r.key, r.place, r.node) for r in placed.collect()} == {(k, i + 1, n) for k, v in want.items() for i, n in enumerate(v)}
    edges = G.shared_key_edges(rows, "node", ["key"])
    assert edges.count() == rows.dropna().count() - rows.dropna().select("key").distinct().count()
    prints = rows.select(F.col("node").alias("id"), F.array(F.struct(F.lit(0).alias("o"), F.array(F.length("key").cast("long")).alias("words"))).alias("orientations"))
    kinds, members = N.representatives(prints)
    assert largest_task(spark, members) < 1000 and members.count() == 4000 and kinds.count() == 3


def test_longest_cover_leaves_out_what_is_no_interval(spark):
    rows = [("a", 0, 5), ("a", 6, None), ("b", 0, 7), ("b", 10, 11), ("c", 9, 2), (None, 0, 99), ("d", 1, 1), ("d", 1, 3), ("e", None, 4)]
    got = C.longest_cover(spark.createDataFrame(rows, "s string, lo int, hi int"), "s", "lo", "hi").collect()
    assert {r.s: r.longest for r in got} == {"a": 5, "b": 7, "d": 2}


def test_search_defines_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, "a", [1.0, 0.0]), (2, "a", None), (3, "b", [nan, 1.0]), (4, "b", [None, 1.0]), (5, "c", [1.0]), (6, "c", [0.5, 0.5]), (7, "d", [float("inf"), 0.0]), (8, "d", [2.0]), (9, "e", [])]
    df = spark.createDataFrame(rows, "id long, identity string, vector array<double>")
    got = {(r.query_id, r.template_id): r.score for r in X.top_templates(df, df, 9).collect()}
    half = round(0.5**0.5, 6)
    assert got == {(1, 6): half, (6, 1): half, (5, 8): 1.0, (8, 5): 1.0}
    assert {(r.score, r.pos, r.neg) for r in X.score_counts(df.filter("id < 5"), df.filter("id = 6")).collect()} == {(half, 0, 1)}
    side = df.select("id", "identity", F.array("vector", F.array(F.lit(1.0))).alias("channels"), F.lit(None).cast("long").alias("group"), F.lit(None).cast("array<long>").alias("excluded"))
    side = side.union(spark.createDataFrame([(10, "z")], "id long, identity string").selectExpr("*", "null", "null", "null"))
    best = {(r.query_id, r.identity): r.score for r in X.best_templates(side.filter("id = 1"), side).collect()}
    assert best == {(1, "a"): 1.0, (1, "b"): 1.0, (1, "c"): 1.0, (1, "d"): 1.0, (1, "e"): 1.0}
    two = X.best_templates(side.filter("id = 1"), side, weights=[1.0, 0.5], k=2).collect()
    assert sorted((r.identity, r.template_id, r.score) for r in two) == [("a", 1, 1.0), ("b", 3, 1.0)]


def test_search_hands_on_k_identities_a_block(spark, monkeypatch):
    monkeypatch.setattr(X, "QUERY_ROWS", 6)
    monkeypatch.setattr(X, "GALLERY_ROWS", 11)
    rng = np.random.default_rng(5)
    vec = [[float(x) for x in np.round(rng.normal(size=2), 1)] for _ in range(150)]
    q, g = sides(spark, [(k, 0, [v], None, None) for k, v in enumerate(vec[:20])], [(100 + k, k % 37, [v], None, None) for k, v in enumerate(vec[20:])])
    for k in (1, 3, 36, 50):
        want = X.top_identities(X.best_templates(q, g), k).drop("rank").collect()
        assert sorted(map(tuple, X.best_templates(q, g, k=k).collect())) == sorted(map(tuple, want)) and len(want) == 20 * min(k, 37)


def test_boxes_of_many_images_meet_in_buckets(spark):
    rng = np.random.default_rng(5)
    rows = [(None if k % 50 == 0 else k % 60, k, *map(float, (x, y, x + 10, y + 12)), float(k * 7 % 13)) for k, (x, y) in enumerate(rng.integers(0, 12, (400, 2)).tolist())]
    df = spark.createDataFrame(rows, "image long, id long, x1 double, y1 double, x2 double, y2 double, confidence double")
    other = df.filter("id % 3 > 0").drop("confidence")
    iou = lambda a, b: (o := max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))) / (240 - o)
    want = {}
    for image in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == image]
        pairs = sorted((-iou(a, b), a[1], b[1]) for a in own for b in own if b[1] % 3 and iou(a, b) >= 0.3)
        p, t = set(), set()
        for s, i, j in pairs:
            if i not in p and j not in t:
                p.add(i), t.add(j)
                want[i, j] = (image, -s)
    found = Z.matched(df, other, 0.3)
    got = {(r.predicted, r.truth): (r.image, r.iou) for r in found.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    assert not Z.matched(df.limit(0), other, 0.3).collect() and not Z.matched(df, other, 2.0, by_confidence=True).collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas [_b" in plan  # not a group for each image
