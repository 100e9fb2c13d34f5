"""Exact sums, image arrays, geometry of matches and principal axes: against plain Python, numpy and planted truth."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.operators import exact as E
from loomfield.operators import homography as H
from loomfield.operators import images as I
from loomfield.operators import neardup as N
from loomfield.operators import projection as J
from loomfield.plans import arrays as A
from loomfield.plans import queries

SF = "/root/testdata/sf0.001"


def test_sums_are_exact_whatever_the_partitions(spark):
    rng = np.random.default_rng(0)
    groups = {
        "cancel": [1e16, 1.0, -1e16, 3.5] * 50 + [1e-9],
        "wide": (rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300)).tolist(),
        "tiny": [5e-324, 2.2250738585072014e-308, -5e-324, 4.9e-320, 1.5e-308],
        "huge": [1.7976931348623157e308, -1.7976931348623157e308, 1.0, 2.0**1023, -(2.0**1023)],
        "powers": [s * 2.0**k for k in range(-1074, 1024, 7) for s in (1, -1)] + [2.0**-1074],
        "zero": [0.0, -0.0, 0.0],
        "half": [1.0, 2.0**-53, 2.0**-80],
    }
    rows = [(k, x) for k, v in groups.items() for x in v] + [("cancel", None), ("none", None), (None, 2.5)]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[k] for k in order], "k string, x double")
    for parts in (1, 7):
        got = {r.k: r for r in E.exact_sums(df.repartition(parts), ["k"], "x").collect()}
        assert set(got) == {*groups, None}
        for k, v in groups.items():
            assert got[k].value == math.fsum(v) and got[k].n == len(v), k
        assert got["half"].error == 2.0**-80 - 2.0**-52 + 2.0**-53 and got["cancel"].error != 0 and got[None].value == 2.5
    odd = spark.createDataFrame([("n", float("nan")), ("n", 1.0), ("i", float("inf")), ("i", 5.0), ("b", float("inf")), ("b", float("-inf")), ("o", 1.7e308), ("o", 1.7e308)], "k string, x double")
    got = {r.k: r.value for r in E.exact_sums(odd, ["k"], "x").collect()}
    assert math.isnan(got["n"]) and got["i"] == math.inf and math.isnan(got["b"]) and got["o"] == math.inf
    whole = E.exact_sums(df, [], "x").first()
    assert (whole.value, whole.n) == (float(sum(Fraction(x) for _, x in rows if x is not None)), sum(map(len, groups.values())) + 1)
    assert E.exact_sums(df.limit(0), ["k"], "x").count() == 0


def plain_bits(luma):
    basis = [[math.sqrt((1 if f == 0 else 2) / 32) * math.cos(math.pi * (2 * x + 1) * f / 64) for x in range(32)] for f in range(32)]
    mean = math.fsum(luma) / 1024
    value = []
    for u, v in I.coefficients():
        rows = [math.fsum((luma[32 * y + x] - mean) * basis[u][x] for x in range(32)) for y in range(32)]
        value.append(math.fsum(rows[y] * basis[v][y] for y in range(32)))
    out = []
    for turned in (value, [-c if u % 2 else c for c, (u, _) in zip(value, I.coefficients())]):
        middle = sorted(turned)
        out.append([c > (middle[31] + middle[32]) / 2 for c in turned])
    return out


def pictures():
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0:32, 0:32]
    smooth = [np.clip(128 + 60 * np.sin(x / (2 + k)) + 50 * np.cos(y / (3 + k % 4) + k), 0, 255).round() for k in range(6)]
    flat = [np.full((32, 32), 7.0), np.where(x < 16, 0.0, 255.0), np.where((x + y) % 2, 10.0, 20.0), np.minimum(x, 31 - x) * 8.0, (x + y) * 4.0]
    noise = [rng.integers(0, 256, (32, 32)).astype(float) for _ in range(10)]
    near = [np.clip(p + rng.integers(-2, 3, p.shape), 0, 255) for p in smooth + noise[:3]]
    mirrored = [np.clip(p[:, ::-1] + rng.integers(-1, 2, p.shape), 0, 255) for p in noise[3:6]]
    return [p.astype(int).ravel().tolist() for p in smooth + flat + noise + near + mirrored]


def test_coefficients_are_a_zig_zag():
    places = I.coefficients()
    assert places[:9] == [(0, 1), (1, 0), (2, 0), (1, 1), (0, 2), (0, 3), (1, 2), (2, 1), (3, 0)] and places[-1] == (1, 9) and len(set(places)) == 64


def test_fingerprints_from_luma_and_their_pairs(spark):
    luma = pictures()
    df = spark.createDataFrame([(k, p) for k, p in enumerate(luma)] + [(900, None), (901, [None] * 1024)], "id long, luma array<int>")
    prints = {r.id: [list(o.words) for o in r.orientations] for r in I.luma_fingerprints(df, "id", "luma").collect()}
    want = {k: [[sum(1 << i for i in range(16) if bits[16 * w + i]) for w in range(4)] for bits in plain_bits(p)] for k, p in enumerate(luma)}
    assert prints == want
    raw = spark.createDataFrame([(k, bytearray(p)) for k, p in enumerate(luma)], "id long, luma binary")
    assert {r.id: [list(o.words) for o in r.orientations] for r in I.luma_fingerprints(raw, "id", "luma").collect()} == want
    with pytest.raises(Exception, match="32 times 32"):
        I.luma_fingerprints(spark.createDataFrame([(1, [1, 2])], "id long, luma array<int>"), "id", "luma").collect()
    # A flip of the picture gives the flipped fingerprint.
    again = I.luma_bits(np.array([np.array(p).reshape(32, 32)[:, ::-1].ravel() for p in luma[11:21]], float))
    for a, b in zip(I.luma_bits(np.array(luma[11:21], float)), again[::-1]):
        assert (a == b).all()
    bits = lambda w: sum(x << (16 * k) for k, x in enumerate(w))
    pairs = {(r.left_id, r.right_id): r.distance for r in N.near_pairs(I.luma_fingerprints(df, "id", "luma"), 4, 10).collect()}
    far = lambda a, b: min((bits(x) ^ bits(y)).bit_count() for x in want[a] for y in want[b])
    assert pairs == {(a, b): far(a, b) for a in want for b in want if a < b and far(a, b) <= 10}
    assert (11, 27) in pairs and (14, 30) in pairs


def plain_texture(luma, width, mask):
    image = np.array(luma, float).reshape(-1, width)
    inside = np.ones(image.shape, bool) if mask is None else np.array(mask, bool).reshape(image.shape)
    counts = [0] * 256
    for y in range(1, image.shape[0] - 1):
        for x in range(1, width - 1):
            if inside[y - 1 : y + 2, x - 1 : x + 2].all():
                around = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
                counts[sum(1 << k for k, (a, b) in enumerate(around) if image[y + a, x + b] >= image[y, x])] += 1
    return sum(counts), [c / max(1, sum(counts)) for c in counts]


def test_texture_under_a_mask(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k, (high, wide) in enumerate([(3, 3), (2, 9), (7, 5), (12, 9), (12, 9), (1, 1), (20, 16), (20, 16)]):
        luma = [float(x) for x in rng.integers(0, 5, high * wide)]
        mask = None if k % 3 == 0 else [bool(x) for x in rng.random(high * wide) < 0.95]
        rows.append((k, luma, wide, mask))
    rows.append((50, [1.0] * 25, 5, [False] * 25))
    df = spark.createDataFrame([*rows, (60, None, 3, None), (61, [1.0], None, None)], "id long, luma array<double>, width int, mask array<boolean>")
    plain = {r.id: (r.pixels, list(r.histogram)) for r in I.texture_histograms(df, "id", "luma", "width").collect()}
    assert plain == {k: plain_texture(luma, w, None) for k, luma, w, _ in rows}
    masked = df.withColumn("mask", F.coalesce("mask", F.array_repeat(F.lit(True), F.size("luma"))))
    got = {r.id: (r.pixels, list(r.histogram)) for r in I.texture_histograms(masked, "id", "luma", "width", "mask").collect()}
    assert got == {k: plain_texture(luma, w, m) for k, luma, w, m in rows} and got[50] == (0, [0.0] * 256)
    for bad in ((1, [1.0, 2.0], 3, None), (1, [float("nan")] * 9, 3, None), (1, [1.0] * 9, 3, [True])):
        with pytest.raises(Exception, match="an image must|as large as"):
            I.texture_histograms(spark.createDataFrame([bad], df.schema), "id", "luma", "width", "mask" if bad[3] else None).collect()


def test_pixel_digest(spark):
    rgb = bytes(range(18))
    df = spark.createDataFrame([(2, 3, bytearray(rgb)), (3, 2, bytearray(rgb)), (2, 2, bytearray(rgb)), (None, 3, bytearray(rgb)), (2, 3, None)], "h int, w int, rgb binary")
    got = [r.d for r in df.select(I.pixel_digest(F.col("h"), F.col("w"), F.col("rgb")).alias("d")).collect()]
    sha = lambda h, w: hashlib.sha256(h.to_bytes(4, "big") + w.to_bytes(4, "big") + rgb).hexdigest()
    assert got == [sha(2, 3), sha(3, 2), None, None, None]


TRUTH = np.array([[0.9, -0.2, 40.0], [0.15, 1.05, -20.0], [1e-4, -5e-5, 1.0]])


def planted(rng, n, wrong, h=TRUTH, noise=0.3, line=False):
    """n matches between images of 640 by 480, a share of them wrong."""
    p = rng.uniform([20, 20], [620, 460], (n, 2))
    if line:
        p[:, 1] = 100 + 0.3 * p[:, 0]
    q = H.mapped(h, p)[0] + rng.normal(scale=noise, size=(n, 2))
    bad = rng.random(n) < wrong
    q[bad] = rng.uniform([0, 0], [640, 480], (bad.sum(), 2))
    return [tuple(map(float, (*a, *b))) for a, b in zip(p, q)], ~bad


def test_pairs_are_held_against_geometry(spark):
    rng = np.random.default_rng(4)
    cases, good = {}, {}
    for k, wrong in enumerate([0.0, 0.2, 0.4, 0.5]):
        cases[f"true{k}"], good[f"true{k}"] = planted(rng, 80, wrong)
    mirror = np.array([[-1.0, 0, 640], [0, 1, 0], [0, 0, 1]])
    cases["mirrored"], good["mirrored"] = planted(rng, 60, 0.3, mirror)
    cases["random"] = planted(rng, 80, 1.0)[0]
    cases["few"], cases["none"], cases["null"] = planted(rng, 9, 0.0)[0], [], None
    cases["line"] = planted(rng, 60, 0.0, line=True, noise=0.0)[0]
    cases["point"] = [(100.0, 100.0, 200.0, 200.0)] * 40
    corner = lambda m: [(x / 20, y / 20, u, v) for x, y, u, v in m]
    cases["corner"] = corner(planted(rng, 60, 0.0, np.diag([1 / 20, 1 / 20, 1.0]), noise=0.02)[0])
    cases["corner"] = [(a, b, a * 1.1, b * 1.1) for a, b, _, _ in cases["corner"]]
    cases["flattened"] = [(x, y, 320 + (x - 320) * 0.9, 240 + (y - 240) * 0.9 * 0.04) for x, y, *_ in planted(rng, 60, 0.0)[0]]
    cases["holes"] = planted(rng, 60, 0.1)[0] + [(None, 1.0, 2.0, 3.0), (float("nan"), 1.0, 1.0, 1.0), (1.0, 1.0, float("inf"), 1.0)]
    df = spark.createDataFrame([(k, 640, 480, 640, 480, m) for k, m in cases.items()], f"pair_id string, left_width int, left_height int, right_width int, right_height int, matches {H.MATCHES}")
    got = {r.pair_id: r for r in H.verified_pairs(df).collect()}
    assert {k: r.reason for k, r in got.items()} == {
        "true0": H.CONFIRMED, "true1": H.CONFIRMED, "true2": H.CONFIRMED, "true3": H.CONFIRMED, "mirrored": H.CONFIRMED, "holes": H.CONFIRMED,
        "random": H.FEW_INLIERS, "few": H.FEW_MATCHES, "none": H.FEW_MATCHES, "null": H.FEW_MATCHES, "line": H.NO_MODEL, "point": H.NO_MODEL,
        "corner": H.NO_SPREAD, "flattened": H.NO_SPREAD,
    }
    for k, ok in good.items():
        assert set(np.flatnonzero(ok)) <= set(got[k].inlier_places) and got[k].inliers <= ok.sum() + 2
        h = np.array(got[k].mapping).reshape(3, 3)
        truth = mirror if k == "mirrored" else TRUTH
        grid = np.array([[x, y] for x in (50, 320, 600) for y in (50, 240, 440)], float)
        assert np.abs(H.mapped(h, grid)[0] - H.mapped(truth, grid)[0]).max() < 1
    assert got["holes"].matches == 60
    assert H.verified_pairs(df.repartition(3)).filter("pair_id = 'true2'").first() == got["true2"]
    assert H.verified_pairs(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="positive sizes"):
        H.verified_pairs(df.withColumn("left_width", F.lit(0))).collect()


def test_drawn_sets_are_distinct_places():
    at = H.drawn_sets("p", 1, 501, 5)
    assert at.shape == (501, 4) and all(len(set(r)) == 4 and max(r) < 5 for r in at.tolist()) and len({tuple(r) for r in at.tolist()}) > 90
    assert (H.drawn_sets("p", 1, 501, 5) == at).all() and (H.drawn_sets("q", 1, 501, 5) != at).any()


def test_impossible_mappings_are_refused():
    size, limits = (640.0, 480.0), H.Limits()
    fine = [TRUTH, np.eye(3), np.diag([-1.0, 1, 1]) + [[0, 0, 640], [0, 0, 0], [0, 0, 0]]]
    horizon = np.array([[1.0, 0, 0], [0, 1, 0], [-1 / 300, 0, 1]])
    bad = [horizon, np.diag([1.0, 0.01, 1]), np.diag([0.001, 0.001, 1]), np.diag([50.0, 50, 1])]
    assert all(H._possible(h, size, size, limits) for h in fine) and not any(H._possible(h, size, size, limits) for h in bad)


@pytest.mark.parametrize("scaled", [False, True])
def test_principal_axes_match_numpy(spark, scaled):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 12)) @ np.diag([9, 7, 5, 3, 2, 1.5, 1, 0.8, 0.5, 0.3, 0.1, 0]) @ rng.normal(size=(12, 12)) + rng.normal(size=12) * 50
    x[:, 7] = 4.0
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None), (901, [float("nan")] * 12), (902, [None] * 12)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    axes = J.principal_axes(df, "v", 4, scaled)
    centred = x - x.mean(axis=0)
    if scaled:
        s = x.std(axis=0)
        centred = centred / np.where(s > 1e-9, s, 1)
    _, value, vt = np.linalg.svd(centred, full_matrices=False)
    want = vt[:4] * np.sign(vt[np.arange(4), np.abs(vt[:4]).argmax(axis=1)])[:, None]
    assert np.allclose(axes.directions, want, atol=1e-6) and np.allclose(axes.variance, value[:4] ** 2 / 499) and np.allclose(axes.share, value[:4] ** 2 / (value**2).sum())
    got = {r.id: r.coordinates for r in J.projected(df, "id", "v", axes).collect()}
    assert np.allclose([got[k] for k in range(500)], centred @ want.T, atol=1e-5) and [got[k] for k in (900, 901, 902)] == [None] * 3 and axes.rows == 500
    for bad, k in ((df.limit(0), 2), (df.filter("id = 3"), 2), (df, 0)):
        with pytest.raises(ValueError):
            J.principal_axes(bad, "v", k)


@pytest.mark.parametrize("size, k, spare", [(12, 4, 4), (30, 2, 1)])
def test_axes_of_variances_too_close_for_few_directions(spark, size, k, spare):
    """Directions as good as alike: power iteration with few of them takes thousands of passes."""
    rng = np.random.default_rng(8)
    x = np.linalg.qr(rng.normal(size=(200, size)) - 0.0)[0]
    x = np.vstack([x, -x]) * (1 + np.arange(size)[::-1] * 1e-3)
    axes = J.principal_axes(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>"), "v", k, spare=spare)
    _, value, vt = np.linalg.svd(x - x.mean(axis=0))
    want = vt[:k] * np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(axis=1)])[:, None]
    assert np.allclose(axes.directions, want, atol=1e-6) and np.allclose(axes.variance, value[:k] ** 2 / 399)


def vectors(spark):
    return {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}


def plain_pictures(spark):
    y, x = np.divmod(np.arange(1024), 32)
    out = {}
    for v, e in vectors(spark).items():
        out[2 * v] = np.clip(np.floor(128 + 300 * e[(x * 3 + y * 5) % 64]), 0, 255).astype(int).tolist()
        if v % 5 == 0:
            noise = (np.arange(1024) * 31 + v) % 3 - 1
            out[2 * v + 1] = np.clip(np.floor(128 + 300 * e[((31 - x) * 3 + y * 5) % 64]) + noise, 0, 255).astype(int).tolist()
    return out


def test_registered_fingerprints_and_textures(spark):
    luma = plain_pictures(spark)
    prints = {k: tuple(sum(1 << i for i, b in enumerate(bits) if b) for bits in plain_bits(p)) for k, p in luma.items()}
    kinds = {}
    for k, p in sorted(prints.items()):
        kinds.setdefault(p, k)
    members = {(r.representative, r.member) for r in queries()["luma_near_members"](spark, SF).collect()}
    assert members == {(kinds[p], k) for k, p in prints.items()}
    of = {k: p for p, k in kinds.items()}
    a = np.array([of[k] for k in sorted(of)], np.uint64)
    far = np.min([[np.bitwise_count(a[:, None, i] ^ a[None, :, j]) for j in (0, 1)] for i in (0, 1)], axis=(0, 1))
    ids = sorted(of)
    want = {(ids[i], ids[j]): int(far[i, j]) for i, j in zip(*np.nonzero(far <= 10)) if i < j}
    assert {(r.left_id, r.right_id): r.distance for r in queries()["luma_near_pairs"](spark, SF).collect()} == want and len(want) > 10
    got = {r.id: (r.pixels, r.histogram) for r in queries()["texture_patterns"](spark, SF).collect()}
    assert set(got) == set(luma)
    for k in list(luma)[::9]:
        pixels, shares = plain_texture(luma[k], 32, [i % 37 != k % 37 for i in range(1024)])
        assert got[k][0] == pixels and np.allclose(got[k][1], shares, atol=1e-9)


def test_registered_pairs_reach_pictures_of_one_fingerprint(spark, tmp_path):
    """Copies and pictures that differ by less than a fingerprint tells are linked, as their kind is to others."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 40")
    again = e.filter("vec_id % 4 = 0").withColumn("vec_id", F.col("vec_id") + 1000)
    lighter = e.filter("vec_id % 10 = 0").withColumns({"vec_id": F.col("vec_id") + 2000, "embedding": F.transform("embedding", lambda x: (x + 1 / 300).cast("float"))})
    turned = e.filter("vec_id < 2").withColumns({"vec_id": F.col("vec_id") + 3000, "embedding": F.transform("embedding", lambda x, k: (x + k % 3 / 300).cast("float"))})
    e.union(again).union(lighter).union(turned).write.parquet(f"{tmp_path}/embeddings.parquet")
    luma = {r.id: r.luma for r in A.pictures(lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")).collect()}
    prints = {k: tuple(sum(1 << i for i, b in enumerate(bits) if b) for bits in plain_bits(p)) for k, p in luma.items()}
    rows = queries()["luma_near_pairs"](spark, str(tmp_path)).collect()
    kind = {r.right_id: r.left_id for r in rows if r.same_kind}
    near = {(r.left_id, r.right_id): r.distance for r in rows if not r.same_kind}
    assert all(r.distance == 0 for r in rows if r.same_kind) and len(rows) == len(kind) + len(near)
    of = lambda a, b: 0 if a == b else near.get((min(a, b), max(a, b)), 99)
    far = lambda a, b: min((x ^ y).bit_count() for x in prints[a] for y in prints[b])
    ids = sorted(prints)
    want = {(a, b): far(a, b) for a in ids for b in ids if a < b and far(a, b) <= 10}
    assert {(a, b): d for a in ids for b in ids if a < b and (d := of(kind.get(a, a), kind.get(b, b))) <= 10} == want
    assert (0, 2000) in want and sum(luma[a] != luma[b] for b, a in kind.items()) > 0


def test_registered_verification(spark):
    """Planted inliers of every pair are found; pairs of wrong matches alone are left open."""
    found = {r.pair_id: r for r in queries()["verified_matches"](spark, SF).collect()}
    assert set(found) == set(vectors(spark))
    for v, r in found.items():
        good = {k for k in range(32) if (k + v) % 7 >= v % 4 and v % 9}
        if good:
            assert good <= set(r.inlier_places) and len(r.inlier_places) <= len(good) + 3 and r.reason in (H.CONFIRMED, H.NO_SPREAD), (v, r)
            h = np.array(r.mapping).reshape(3, 3)
            assert np.abs(h / h[2, 2] - TRUTH).max() < 0.5
        else:
            assert r.reason == H.FEW_INLIERS
    assert sum(r.reason == H.CONFIRMED for r in found.values()) > 0.8 * len(found)


def test_registered_projection(spark):
    own = vectors(spark)
    x = np.stack([own[k] for k in sorted(own)])
    centred = x - x.mean(axis=0)
    vt = np.linalg.svd(centred, full_matrices=False)[2][:4]
    want = centred @ (vt * np.sign(vt[np.arange(4), np.abs(vt).argmax(axis=1)])[:, None]).T
    got = {r.vec_id: r.coordinates for r in queries()["principal_coordinates"](spark, SF).collect()}
    assert np.allclose([got[k] for k in sorted(own)], want, atol=2e-5)


def test_minimal_sets_in_closed_form_are_those_by_singular_vectors(spark):
    rng = np.random.default_rng(9)
    source, target = rng.uniform(0, 640, (50, 4, 2)), rng.uniform(0, 480, (50, 4, 2))
    a, b = H.exact(source, target), H.fitted(source, target)
    b /= np.linalg.norm(b, axis=(1, 2))[:, None, None]
    assert np.abs(a * np.sign((a * b).sum(axis=(1, 2)))[:, None, None] - b).max() < 1e-6
    for wrong in (0.0, 0.3, 1.0):
        m = np.array(planted(rng, 40, wrong)[0])
        at = H.drawn_sets("x", 1, 300, 40)
        count, h, _ = H._best(at, m[:, :2], m[:, 2:], 800.0, 800.0, 0.004)
        reach, _ = H._in_reach(at, m[:, :2], m[:, 2:], 800.0, 800.0, 0.004)
        again = H._best(reach, m[:, :2], m[:, 2:], 800.0, 800.0, 0.004)
        assert (len(reach) < 100 or wrong == 1) and again[0] == count and (again[1] == h).all()  # if all are wrong, sets fit themselves alone
    one = spark.createDataFrame([(k, 640, 480, 640, 480, []) for k in range(40)], f"pair_id int, left_width int, left_height int, right_width int, right_height int, matches {H.MATCHES}").coalesce(1)
    assert H.verified_pairs(one).rdd.getNumPartitions() > 1
