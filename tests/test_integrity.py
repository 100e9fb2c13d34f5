"""Integrity checks, views, registries and readers on small literal cases."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomfield import storage
from loomfield.operators import coverage as C
from loomfield.operators import decisions as D
from loomfield.operators import diagnostics as G
from loomfield.operators import integrity as I
from loomfield.operators import metrics as M
from loomfield.operators import ranking
from loomfield.operators import snapshots
from loomfield.operators import search as X
from loomfield.operators import splits as P
from loomfield.operators import views as V
from loomfield.sources import formats


def test_strict_documents(spark):
    deep = "[" * 9 + "]" * 9
    texts = ['{"a": [1, 2, {"b": null}]}', '{"a": 1, "a": 2}', "{", "[NaN]", deep, json.dumps(list(range(50))), None, '"' + "x" * 300 + '"', "3"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    got = {r.id: r.rule for r in I.strict_documents(df, "body", most_bytes=250, most_depth=6, most_nodes=40).collect()}
    assert got == {0: None, 1: "REPEATED_KEY", 2: "NOT_JSON", 3: "NUMBER", 4: "DEPTH", 5: "NODES", 6: "MISSING", 7: "BYTES", 8: None}


def test_cache_checks(spark):
    unit, long = [0.6, 0.8], [3.0, 4.0]
    manifest = spark.createDataFrame([(1, 8, "a"), (2, 8, "b"), (3, 9, "c"), (4, 8, "d")], "token int, size long, digest string")
    held = spark.createDataFrame([(1, 8, "a", unit), (2, 8, "x", long), (3, 8, "c", unit), (5, 8, "e", unit)], "token int, size long, digest string, vector array<double>")
    got = {(r.token, r.rule) for r in I.cache_breaches(manifest, held, 1e-6).collect()}
    assert got == {(2, "DIGEST"), (2, "NOT_UNIT"), (3, "SIZE"), (4, "MISSING"), (5, "UNLISTED")}
    pack = spark.createDataFrame([(1, 0, 8), (2, 8, 8), (3, 17, 8)], "token int, offset long, size long")
    assert [(r.token, r.rule) for r in I.pack_breaches(pack, 25).collect()] == [(3, "GAP")]
    assert [(r.token, r.rule) for r in I.pack_breaches(pack.filter("token < 3"), 25).collect()] == [(2, "SHORT")]


def test_pairs_records_and_reports(spark):
    requests = spark.createDataFrame([(1, 7), (2, 7), (2, 7), (3, 8)], "pair_id int, query int")
    truth = spark.createDataFrame(
        [(1, "s", "t", True, "POSITIVE", 5), (2, "s", "s", True, "NEAR", 6), (4, "s", "t", False, "NEAR", 6)],
        "pair_id int, query_session string, reference_session string, same boolean, stratum string, other int",
    )
    got = {(r.pair_id, r.rule) for r in I.pair_breaches(requests, truth, 2).collect()}
    assert got == {(2, "REPEATED"), (3, "UNMATCHED"), (4, "UNMATCHED"), (2, "SESSION"), (2, "LABEL"), (1, "CAP"), (1, "REUSED")}
    view = V.blind(requests.join(truth, "pair_id"))
    assert not set(view.columns) & set(V.LABELS) and "pair_id" in V.labels_only(truth, "pair_id").columns
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 3), (3, "b", 3)], "id int, capture string, camera int")
    assert {(r.kind, r.token) for r in I.record_breaches(rows, "id", "capture", ["camera"]).collect()} == {("KEY", "1"), ("CAPTURE", "a")}


def test_generations_are_verified_and_migrated(spark, tmp_path):
    at, df = str(tmp_path / "store"), spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    digest = snapshots.publish(df, at, "old", ["id"])
    assert snapshots.publish(df, at, "old", ["id"]) == digest and snapshots.latest(spark, at, "old").count() == 2
    snapshots.migrate(spark, at, "old", "new", lambda rows: rows.withColumn("version", F.lit(4)), ["id"])
    assert snapshots.latest(spark, at, "new").columns == ["id", "name", "version"] and snapshots.latest(spark, at, "old").columns == ["id", "name"]
    df.filter("id = 1").write.mode("overwrite").parquet(snapshots.last_snapshot(spark, at, "old").path)
    with pytest.raises(ValueError, match="digest"):
        snapshots.latest(spark, at, "old")
    assert snapshots.latest(spark, at, "old", verify=False).count() == 1


def test_csv_sink_and_region_reader(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "x"', None), (1, "a,b", 0.5)], "id int, name string, value double")
    formats.write_csv(df, str(tmp_path / "csv"), ["id"])
    (file,) = (tmp_path / "csv").glob("*.csv")
    assert file.read_bytes() == b'id,name,value\r\n1,"a,b",0.5\r\n2,"say ""x""",\r\n'
    shape = "image string, scores array<double>, boxes array<array<double>>"
    spark.createDataFrame([("i", [0.5, 0.25], [[0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0]])], shape).write.parquet(str(tmp_path / "good"))
    rows = formats.load(spark, "region_candidates", str(tmp_path / "good")).orderBy("place").collect()
    assert [(r.place, r.score, r.box[0]) for r in rows] == [(0, 0.5, 0.0), (1, 0.25, 2.0)]
    spark.createDataFrame([("i", [0.5], [[0.0, 0.0, 1.0]])], shape).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="differ in shape"):
        formats.load(spark, "region_candidates", str(tmp_path / "bad")).collect()


def test_reliabilities_refuse_values_outside_the_unit_interval(spark):
    one = spark.range(1)
    assert one.select(D.face_reliability(F.lit(0.5), F.lit(64.0)).alias("x")).first().x == 0.5
    for bad in (-0.1, 1.1, float("nan")):
        with pytest.raises(Exception, match="from 0 to 1"):
            one.select(D.nose_reliability(F.lit(0.5), F.lit(bad), F.lit(32.0), F.lit(0.5), F.lit(0.5)).alias("x")).collect()


def test_inversions_of_batches_of_queries(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for q in range(40):
        p = rng.permutation(int(rng.integers(1, 60))).tolist()
        rows += [(q, k + 1, x + 1) for k, x in enumerate(p)]
        want[q] = sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r.query_id: r.inversions for r in G.inversions(spark.createDataFrame(rows, "query_id long, ra int, rb int").repartition(3)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_channels_of_sliced_blocks():
    lists = pa.array([[[9.0, 9.0], None], [[1.0, 2.0], [3.0]], [None, [4.0]]], pa.list_(pa.list_(pa.float64()))).slice(1)
    told = lambda k: {n: (rows.tolist(), v.tolist()) for n, (rows, v) in X._channel(lists, k).items()}
    assert told(0) == {2: ([0], [[1.0, 2.0]])} and told(1) == {1: ([0, 1], [[3.0], [4.0]])}
    block = pa.StructArray.from_arrays([pa.array([[0.0, 0.0], [1.0, 2.0], [3.0, 4.0]])], names=["vector"]).slice(1)
    assert X._stack(block, "vector").tolist() == [[1.0, 2.0], [3.0, 4.0]]


def test_places_of_relevant_templates_match_the_ranks(spark, monkeypatch):
    monkeypatch.setattr(X, "QUERY_ROWS", 4)
    monkeypatch.setattr(X, "GALLERY_ROWS", 7)
    rng = np.random.default_rng(2)
    rows = [(k, k % 3, [float(x) for x in np.round(rng.normal(size=2), 1)]) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, identity int, vector array<double>")
    q, g = df.filter("id < 9"), df.filter("id >= 9")
    scores = X.pair_scores(q.drop("identity"), g.drop("identity")).join(q.select(F.col("id").alias("query_id"), F.col("identity").alias("a")), "query_id")
    scores = scores.join(g.select(F.col("id").alias("template_id"), F.col("identity").alias("b")), "template_id").withColumn("relevant", F.col("a") == F.col("b"))
    want = {(r.query_id, r.template_id): r.rank for r in M.relevance_ranks(scores).filter("relevant").collect()}
    for at_once in (4096, 2):
        assert {(r.query_id, r.template_id): r.place for r in X.relevant_places(q, g, at_once=at_once).collect()} == want
    counts = {(r.score, r.pos, r.neg) for r in X.score_counts(q, g).collect()}
    assert counts == {(r.score, r.pos, r.neg) for r in M.score_counts(scores.withColumn("label", F.col("relevant").cast("int"))).collect()}
    top = {(r.query_id, r.r): r.template_id for r in X.top_templates(q.drop("identity"), df.drop("identity"), 4).collect()}
    all_ = X.pair_scores(q.drop("identity"), df.drop("identity")).filter("query_id <> template_id").collect()
    for i in range(9):
        own = sorted((-r.score, r.template_id) for r in all_ if r.query_id == i)[:4]
        assert [top[i, k + 1] for k in range(4)] == [t for _, t in own]


def test_rows_of_scores_are_judged_where_they_are_scored(spark, monkeypatch):
    """As by ranks over all pairs, and nothing is shuffled after the scores are there."""
    monkeypatch.setattr(X, "GALLERY_ROWS", 7)
    rng = np.random.default_rng(4)
    rows = [(k, k % 3 if k % 11 else None, [float(x) for x in np.round(rng.normal(size=2 + (k % 10 == 0)), 1)]) for k in range(60)]
    df = spark.createDataFrame([*rows, (90, 1, None), (91, 9, [1.0, 2.0])], "id long, identity int, vector array<double>")
    q = df.filter("id < 20 OR id > 89")
    name = lambda c, i: df.select(F.col("id").alias(c), F.col("identity").alias(i))
    pairs = X.pair_scores(q.drop("identity"), df.drop("identity")).join(name("query_id", "a"), "query_id").join(name("template_id", "b"), "template_id")
    for itself in (True, False):
        own = pairs if itself else pairs.filter("query_id <> template_id")
        ranks = M.relevance_ranks(own.withColumn("relevant", F.coalesce(F.col("a") == F.col("b"), F.lit(False)))).filter("relevant")
        want = {r.query_id: r for r in M.placed_outcomes(ranks.select("query_id", F.col("rank").alias("place")), q.select(F.col("id").alias("query_id"))).collect()}
        for r in X.relevance_outcomes(q, df, itself=itself).collect():
            w = want.pop(r.query_id)
            assert (r.n_relevant, r.first_hit, r.inp) == (w.n_relevant, w.first_hit, w.inp) and (r.ap == w.ap or abs(r.ap - w.ap) < 1e-12)
        assert not want
    told = X.score_zscores(q, df)
    z = {(r.query_id, r.template_id): r.z for r in told.collect()}
    want = {(r.query_id, r.template_id): r.z for r in G.row_zscores(pairs).collect()}
    assert z.keys() == want.keys() and all(abs(z[k] - want[k]) < 1e-9 for k in z)
    plan = told._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "CartesianProduct" in plan  # the one that deals the queries


def test_a_gallery_goes_to_a_task_once_however_many_scores_it_holds(spark, monkeypatch):
    """Blocks of a few scores each are met in the same tasks where the gallery's vectors may be kept there, with the same results."""
    monkeypatch.setattr(X, "GALLERY_ROWS", 40)
    rng = np.random.default_rng(5)
    rows = [(k, "abc"[k % 3] if k % 11 else None, [float(x) for x in np.round(rng.normal(size=2 + (k % 10 == 0)), 1)]) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, identity string, vector array<double>")

    def work(ids, names, parts):
        for k, (i, name) in enumerate(zip(ids.tolist(), names, strict=True)):
            yield [[i], pa.array([name], pa.string()), [int(sum(p[0][k].sum() for p in parts))], [sum(len(p[1]) for p in parts)], [len(ids)]]

    found, tasks = [], []
    for held in (1 << 29, 0):
        monkeypatch.setattr(X, "VECTORS_HELD", held)
        out = X._per_block(df, df, "id long, identity string, total long, templates long, block long", work, scores_held=300)
        tasks.append(out.rdd.getNumPartitions())
        got = out.collect()
        assert all(r.block * r.templates <= 300 for r in got) or not held
        found.append({r.id: (r.identity, r.total, r.templates) for r in got})
    assert found[0] == found[1] and len(found[0]) == 150
    assert tasks == [2 * spark.sparkContext.defaultParallelism, 75]


@pytest.mark.parametrize("spread", [2, 400, 100_000, 1_000_000])
def test_places_by_short_keys_are_those_of_a_whole_sort(spread):
    """Ties within a range of ids, beyond it, with the template that is left out, and where most scores are tied."""
    rng = np.random.default_rng(spread)
    n, ids = 5000, rng.permutation(20_000)[:5000]
    names, scores = rng.integers(0, 4, n), rng.integers(-spread, spread + 1, (6, n)).astype(np.int32)
    cuts = [slice(0, 1700), slice(1700, 1701), slice(1701, n)]
    parts = [(scores[:, c], ids[c], names[c]) for c in cuts]
    order = np.argsort(ids)
    for top in (1_000_000, 1_000_001):  # the latter sorts all
        placed = X._placed(parts, top)
        for k, (identity, without) in enumerate([(1, None), (1, int(ids[7])), (2, int(ids[np.flatnonzero(names == 2)[0]])), (9, None), (None, None), (0, -5)]):
            left = order[ids[order] != without] if without is not None else order
            fall = left[np.lexsort((ids[left], -scores[k, left]))]
            want = np.flatnonzero(names[fall] == identity) + 1 if identity is not None else []
            assert placed([p[0] for p in parts], k, identity, without).tolist() == list(want)


def test_all_scores_leave_their_task_sorted_over_its_queries(spark, monkeypatch):
    """So equal values follow each other in a column file, over some blocks of templates at a time; none is lost."""
    monkeypatch.setattr(X, "GALLERY_ROWS", 7)
    monkeypatch.setattr(X, "BATCH_ROWS", 50)
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(k, k % 3, [float(x) for x in np.round(rng.normal(size=3), 1)]) for k in range(300)], "id long, identity int, vector array<double>")
    q = df.filter("id < 80")
    rows = X.score_zscores(q, df).withColumn("p", F.spark_partition_id()).collect()
    want = {(r.query_id, r.template_id): r.z for r in G.row_zscores(X.pair_scores(q.drop("identity"), df.drop("identity"))).collect()}
    assert len(rows) == len(want) == 80 * 300 and all(abs(r.z - want[r.query_id, r.template_id]) < 1e-9 for r in rows)
    tiles = -(-(-(-300 // 7)) // X.SORTED_BLOCKS)
    for p in {r.p for r in rows}:
        own = [r for r in rows if r.p == p]
        falls = [k for k in range(1, len(own)) if own[k].z < own[k - 1].z]
        assert len(falls) < tiles
        for a, b in zip([0, *falls], [*falls, len(own)], strict=True):
            assert len({r.query_id for r in own[a:b]}) == len({r.query_id for r in own})


def test_counts_at_cuts_are_those_of_all_scores(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(k, k % 3, [float(x) for x in np.round(rng.normal(size=2), 1)]) for k in range(40)], "id long, identity int, vector array<double>")
    cuts = [0.5, -0.2]
    want = {}
    for r in X.score_counts(df, df).collect():
        at = max((c for c in cuts if r.score >= c), default=-np.inf)
        want[at] = tuple(np.add(want.get(at, (0, 0)), (r.pos, r.neg)))
    assert {r.score: (r.pos, r.neg) for r in X.score_counts(df, df, cuts=cuts).collect()} == want


@pytest.mark.parametrize("most", [6, 2**45])
def test_places_of_marked_scores(most):
    rng = np.random.default_rng(5)
    scores, own = rng.integers(-most, most, 3000), rng.random(3000) < 0.1
    want = np.flatnonzero(own[np.argsort(-scores, kind="stable")]) + 1
    assert X._places(scores, own).tolist() == want.tolist() and X._places(scores[:0], own[:0]).tolist() == []


def test_longest_cover_and_nearest_rank_of_long_streams(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 8, 9), ("a", 1, 2), ("b", 3, 3), ("b", 4, 6), (None, 0, 9)], "s string, x long, y long")
    assert {r.s: r.longest for r in C.longest_cover(rows, "s", "x", "y").collect()} == {"a": 7, "b": 2}
    values = spark.createDataFrame([("g", float(k % 10)) for k in range(40)] + [("h", 1.0), ("h", None)], "g string, v double")
    got = {r.g: (r.n, r.p50, r.p95) for r in C.nearest_rank(values, "v", ["g"]).collect()}
    assert got == {"g": (40, 4.0, 9.0), "h": (1, 1.0, 1.0)}


def test_farthest_in_time(spark):
    rows = spark.createDataFrame([("c", k, t) for k, t in enumerate([0, 10, 4, 10, 6, 1])] + [("d", 9, 3)], "cap string, item int, at long")
    got = sorted((r.cap, r.item, r["at"]) for r in P.farthest_in_time(rows, "cap", "item", "at", 3, 2.0).collect())
    assert got == [("c", 0, 0), ("c", 1, 10), ("c", 2, 4), ("d", 9, 3)]


def test_minima_of_hot_keys(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), (1000 - F.col("id")).alias("v"))
    got = ranking.with_least(rows, "k", "v", "m", "v").collect()
    least = {}
    for r in got:
        least[r.k] = min(least.get(r.k, 10**9), r.v)
    assert len(got) == 1000 and all(r.m == least[r.k] for r in got)


def test_scope_deletes_what_was_stored_in_it(spark, tmp_path):
    df = spark.range(5)
    with storage.scope(spark):
        kept = storage.stored(df, "inner")
        assert kept.count() == 5
        kept.write.parquet(str(tmp_path / "out"))
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(kept.inputFiles()[0])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_covariance_spectrum_over_all_rows(spark):
    from loomfield import plans

    sf = "/root/testdata/sf0.01"
    v = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], float)
    want = np.linalg.eigvalsh(np.cov(v.T, bias=True))[::-1]
    got = sorted(plans.queries()["covariance_spectrum"](spark, sf).collect(), key=lambda r: r.k)
    assert np.allclose([r.eigenvalue for r in got], want, atol=1e-7) and np.allclose([r.share for r in got], want / want.sum(), atol=1e-5)


def test_consensus_over_all_rows(spark):
    from loomfield import plans

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = {}
    for label in {r.label for r in rows}:
        own = [r for r in rows if r.label == label]
        u = np.array([r.embedding for r in own], float)
        u /= np.linalg.norm(u, axis=1)[:, None]
        q = np.maximum(np.array([r.vec_id % 7 / 7 for r in own]), 1e-6)
        mean = lambda keep: (lambda m: m / np.linalg.norm(m))((u[keep] * q[keep, None]).sum(axis=0))  # noqa: B023, E731
        c = u @ mean(np.ones(len(own), bool))
        med = np.median(c)
        keep = c >= max(-1.0, med - 2.5 * max(np.median(np.abs(c - med)), 0.02))
        last = mean(keep)
        want[label] = (len(own), int(keep.sum()), round(float((q[keep] * (1 - u[keep] @ last)).sum() / q[keep].sum()), 5))
    got = {r.label: (r.n, r.accepted, round(r.dispersion, 5)) for r in plans.queries()["consensus_vectors"](spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("fragment", [4096, 3])
def test_near_pairs_with_hot_blocks_match_brute_force(spark, fragment):
    from loomfield.operators import neardup as N

    rng = np.random.default_rng(6)
    base = [int(x) for x in rng.integers(0, 1 << 16, 4)]
    rows = []
    for k in range(60):
        w = list(base) if k % 2 else [base[0], *(int(x) for x in rng.integers(0, 1 << 16, 3))]
        for b in rng.integers(0, 64, int(rng.integers(0, 9))):
            w[int(b) // 16] ^= 1 << (int(b) % 16)
        rows.append((k, [(0, w), (1, w[::-1])]))
    df = spark.createDataFrame(rows, "id int, orientations array<struct<o: int, words: array<long>>>")
    want = {}
    for i, a in rows:
        for j, b in rows:
            if i < j:
                d, lo, ro = min((sum((x ^ y).bit_count() for x, y in zip(p, q, strict=True)), lo, ro) for lo, p in a for ro, q in b)
                if d <= 10:
                    want[i, j] = (d, lo, ro)
    got = N.near_pairs(df, words=4, radius=10, max_fragment=fragment).collect()
    assert {(r.left_id, r.right_id): (r.distance, r.left_o, r.right_o) for r in got} == want and len(want) > 100


def test_an_older_state_can_be_published_again(spark, tmp_path):
    at = str(tmp_path / "store")
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"), spark.createDataFrame([(3, "c")], "id int, name string")
    with pytest.raises(LookupError):
        snapshots.latest(spark, at, "t")
    for rows in (a, b, a):
        snapshots.publish(rows, at, "t", ["id"])
    assert {r.id for r in snapshots.latest(spark, at, "t").collect()} == {1, 2}
    told = snapshots.snapshots(spark, at, "t")
    assert [(s.number, s.base) for s in told] == [(1, 0), (2, 1), (3, 2)] and told[0].path == told[2].path != told[1].path
    assert {r.id for r in snapshots.latest(spark, at, "t", number=2).collect()} == {3}
    assert snapshots.rollback(spark, at, "t", 2).number == 4 and {r.id for r in snapshots.latest(spark, at, "t").collect()} == {3}
    with pytest.raises(LookupError):
        snapshots.rollback(spark, at, "t", 9)
    with pytest.raises(snapshots.Conflict):
        snapshots.rollback(spark, at, "t", 1, base=2)
    assert snapshots.snapshots(spark, at, "other") == []


def test_of_two_writers_from_one_base_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    at = str(tmp_path / "store")
    of = lambda k: spark.createDataFrame([(k,)], "id int")
    snapshots.publish(of(0), at, "t", ["id"])
    last, gate = snapshots.last_snapshot(spark, at, "t"), Barrier(8)

    def write(k):
        gate.wait()
        try:
            return snapshots._append(spark, at, last, "t", f"digest-{k}", f"{at}/t/none").number
        except snapshots.Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [x for x in pool.map(write, range(8)) if x is not None]
    assert won == [2] and [s.number for s in snapshots.snapshots(spark, at, "t")] == [1, 2]
    with pytest.raises(snapshots.Conflict, match="at 2, not at 1"):
        snapshots.publish(of(5), at, "t", ["id"], base=1)
    assert not [f for f in (tmp_path / "store/_log/t").iterdir() if "draft" in f.name]


def test_a_write_that_dies_is_never_read(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "store")
    of = lambda k: spark.createDataFrame([(k,)], "id int")
    snapshots.publish(of(1), at, "t", ["id"])
    monkeypatch.setattr(snapshots, "_append", lambda *a: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        snapshots.publish(of(2), at, "t", ["id"])
    monkeypatch.undo()
    assert [r.id for r in snapshots.latest(spark, at, "t").collect()] == [1]
    snapshots.publish(of(2), at, "t", ["id"])
    assert [r.id for r in snapshots.latest(spark, at, "t").collect()] == [2]


def test_best_and_counts_are_kept_where_they_are_scored(spark, monkeypatch):
    """As from all scores, with many copies, close scores and odd lengths; the best of a query are never shuffled."""
    for name, n in (("GALLERY_ROWS", 16), ("QUERY_BLOCK", 9), ("TILE_ROWS", 4)):
        monkeypatch.setattr(X, name, n)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6, 3))
    rows = [(k, k % 3 if k % 11 else None, (base[k % 6] + 1e-7 * rng.normal(size=3) * (k % 4 == 0)).tolist()[: 3 - (k % 20 == 0)]) for k in range(90)]
    df = spark.createDataFrame([*rows, (95, 1, []), (96, 1, []), (97, 2, [0.0, 0.0])], "id long, identity int, vector array<double>")
    q = df.filter("id % 2 = 0 OR id > 90")
    name = lambda c, i: df.select(F.col("id").alias(c), F.col("identity").alias(i))
    pairs = X.pair_scores(q.drop("identity"), df.drop("identity")).join(name("query_id", "a"), "query_id").join(name("template_id", "b"), "template_id").collect()
    found = X.top_templates(q.drop("identity"), df.drop("identity"), 4)
    got = {(r.query_id, r.r): (r.template_id, r.score) for r in found.collect()}
    want = {}
    for i in {r.query_id for r in pairs}:
        own = sorted((-r.score, r.template_id) for r in pairs if r.query_id == i and r.template_id != i)[:4]
        want |= {(i, k + 1): (t, -s) for k, (s, t) in enumerate(own)}
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "Window" not in plan  # the one that deals the queries
    counts = {}
    for r in pairs:
        n = counts.setdefault(r.score, [0, 0])
        n[r.a != r.b] += 1
    assert {r.score: [r.pos, r.neg] for r in X.score_counts(q, df).collect()} == counts
