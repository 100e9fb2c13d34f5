"""Bootstrap intervals and out-of-fold fusion against numpy, with their errors and odd rows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.functions import scalars as S
from loomfield.operators import fusion as U
from loomfield.operators import metrics as M
from loomfield.operators import resampling as B


def drawn(seed, r, n, block):
    """Cluster numbers of a resample."""
    pick = lambda text, m: int(hashlib.sha256(text.encode()).hexdigest()[:12], 16) % m
    first = [pick(f"{seed}|{r}|{d}", n) for d in range(n)]
    if block >= n:
        return first
    counts = Counter(k // block for k in first)
    return [b * block + pick(f"{seed}|{r}|{b}|{j}", min(block, n - b * block)) for b, c in counts.items() for j in range(c)]


def plain_interval(rows, resamples, seed, block, interpolate):
    """(estimate, lo, hi) of rows(cluster, value or None)."""
    names = sorted({c for c, _ in rows})
    s = np.array([sum(v for c, v in rows if c == n and v is not None) for n in names])
    k = np.array([sum(c == n and v is not None for c, v in rows) for n in names])
    values = []
    for r in range(resamples):
        at = drawn(seed, r, len(names), block)
        if k[at].sum():
            values.append(s[at].sum() / k[at].sum())
    values.sort()
    if interpolate:
        lo, hi = np.quantile(values, (0.05, 0.95))
    else:
        lo, hi = (values[max(1, int(np.ceil(round(q * len(values), 9)))) - 1] for q in (0.05, 0.95))
    return s.sum() / k.sum(), lo, hi


@pytest.mark.parametrize("block, interpolate", [(65_536, False), (7, False), (1, True), (10, True)])
def test_intervals_of_several_metrics(spark, block, interpolate):
    rng = np.random.default_rng(block)
    rows = [(int(c), float(x), None if rng.random() < 0.3 else float(y)) for c, x, y in zip(rng.integers(0, 23, 400), rng.normal(size=400), rng.integers(0, 2, 400))]
    rows += [(99, 1.0, None)] + [(5, 0.25, 1.0)] * 300  # a cluster with one metric only, and a hot one
    df = spark.createDataFrame(rows, "c int, x double, y double")
    got = {r.metric: r for r in B.bootstrap_intervals(df, "c", ["x", "y"], 60, 0.9, 3, interpolate, block).collect()}
    for k, name in enumerate("xy"):
        want = plain_interval([(r[0], r[1 + k]) for r in rows], 60, 3, block, interpolate)
        assert np.allclose((got[name].estimate, got[name].lo, got[name].hi), want) and got[name].clusters == len({r[0] for r in rows})
    assert got["y"].rows == sum(r[2] is not None for r in rows) and got["x"].rows == len(rows)


def test_blocks_draw_as_often_as_there_are_clusters(spark):
    sums = spark.range(100).select("id", F.lit(1.0).alias("one"), F.col("id").cast("double").alias("k"))
    for block in (1000, 9):
        out = B.resampled(sums, "id", ["one", "k"], 200, 1, block).toPandas()
        assert (out["one"] == 100).all() and len(out) == 200 and abs(out["k"].mean() / 100 - 49.5) < 1 and 2 < (out["k"] / 100).std() < 4


def test_no_resample_is_shuffled_row_by_row(spark):
    plan = B.resampled(spark.range(3000).select("id", F.lit(1.0).alias("one")), "id", ["one"], 500)._jdf.queryExecution().toString()
    assert "1500000" not in plan and "CoGroup" in plan  # no table of resamples times clusters


def test_paired_delta_and_its_errors(spark):
    rng = np.random.default_rng(2)
    left = [(k, f"c{k % 9}", float(x)) for k, x in enumerate(rng.random(80))]
    right = [(k, c, None if k % 17 == 0 else x - 0.1 + 0.01 * (k % 5)) for k, c, x in left]
    of = lambda rows: spark.createDataFrame(rows, "q long, c string, v double")
    got = B.paired_intervals(of(left), of(right[::-1]), "q", "c", ["v"], 80, 0.9, 5).first()
    delta = [(c, None if y is None else x - y) for (_, c, x), (_, _, y) in zip(left, right)]
    assert np.allclose((got.estimate, got.lo, got.hi), plain_interval(delta, 80, 5, 10**6, True)) and 0 < got.lo < got.hi
    same = B.paired_intervals(of(left), of(left), "q", "c", ["v"], 20).first()
    assert (same.estimate, same.lo, same.hi) == (0, 0, 0)
    bad = [(right[1:], "on the right: 1"), (right + [(999, "c1", 1.0)], "on the left: 1"), (right + right[:1], "on the right: 1"), ([(0, "c8", 0.5)] + right[1:], "two clusters: 1")]
    for rows, said in bad:
        with pytest.raises(ValueError, match=said):
            B.paired_intervals(of(left), of(rows), "q", "c", ["v"], 5)
    for rows in ([(1, None, 1.0), (2, "a", 1.0)], [(1, "a", float("nan")), (2, "b", 1.0)], [(1, "a", float("inf")), (2, "b", 1.0)], [(1, "a", 1.0)], []):
        with pytest.raises(ValueError):
            B.bootstrap_intervals(of(rows), "c", ["v"], 5)


def test_outcome_values(spark):
    rows = [(1, 2, 1, 0.5, 0.25), (2, 0, None, None, None), (3, 1, 4, 0.25, 0.25)]
    df = M.outcome_values(spark.createDataFrame(rows, "query_id long, n_relevant long, first_hit int, ap double, inp double"), (1, 4))
    got = {r.query_id: (r.rank_1, r.rank_4, r.mrr, r["map"], r.minp) for r in df.collect()}
    assert got == {1: (1.0, 1.0, 1.0, 0.5, 0.25), 2: (None, None, None, 0.0, None), 3: (0.0, 1.0, 0.25, 0.25, 0.25)}


def plain_fit(rows, grid, l2, prior, floor, balanced, but):
    best = None
    for w in grid:
        errors, lost = {0: [], 1: []}, False
        for fold, s, a, q, y, weight in rows:
            e = [max(qk, floor) if ak and sk is not None else 0 for sk, ak, qk in zip(s, a, q)]
            if fold is None or fold == but or not sum(e):
                continue
            t = sum(x * y_ for x, y_ in zip(w, e))
            lost |= t == 0
            errors[y].append((weight, ((sum(x * y_ * (z or 0) for x, y_, z in zip(w, e, s)) / t if t else 0) - y) ** 2))
        if lost:
            continue
        mean = lambda v: sum(a * b for a, b in v) / sum(a for a, _ in v)
        brier = (mean(errors[0]) + mean(errors[1])) / 2 if balanced else mean(errors[0] + errors[1])
        away = sum((a - b) ** 2 for a, b in zip(w, prior))
        key = (round(brier + l2 * away, 9), round(away, 12), w)
        best = min(best or key, key)
    return best[2]


@pytest.mark.parametrize("balanced, floor, l2", [(False, 0.0, 0.0), (True, 0.1, 0.05)])
def test_folds_are_fitted_on_the_others(spark, balanced, floor, l2):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(240):
        y = int(rng.random() < 0.3)
        s = [float(np.clip(y * 0.4 + rng.normal() * 0.2 + 0.3, 0, 1)), float(rng.random()), float(np.clip(y * 0.2 + rng.random() * 0.8, 0, 1))]
        if k % 7 == 0:
            s[1] = None
        available = [k % 5 > 0, True, k % 11 > 0] if k % 60 else [False, False, False]
        rows.append((k % 4 if k % 31 else None, s, available, [float(k % 3) / 2, 1.0, 0.7], y, 1.0 + k % 2))
    df = spark.createDataFrame(rows, "fold int, scores array<double>, available array<boolean>, quality array<double>, label int, weight double")
    weights = U.oof_weights(df, 3, 8, l2, [0.5, 0.25, 0.25], floor, balanced)
    grid = M.simplex_grid(3, 8)
    got = {r.fold: list(r.weights) for r in weights.collect()}
    assert got == {f: plain_fit(rows, grid, l2, [0.5, 0.25, 0.25], floor, balanced, f) for f in (0, 1, 2, 3)} | {None: plain_fit(rows, grid, l2, [0.5, 0.25, 0.25], floor, balanced, -1)}
    for r in U.oof_scores(df.withColumn("k", F.monotonically_increasing_id()), weights, floor).collect():
        e = [max(q, floor) if a and s is not None else 0 for s, a, q in zip(r.scores, r.available, r.quality)]
        t = None if r.fold is None else sum(a * b for a, b in zip(got[r.fold], e))
        assert r.fused is None if not t else abs(r.fused - sum(a * b * (s or 0) for a, b, s in zip(got[r.fold], e, r.scores)) / t) < 1e-9


def test_fusion_refuses_what_it_cannot_fit(spark):
    of = lambda rows: spark.createDataFrame(rows, "fold int, scores array<double>, label int")
    fine = [(f, [0.1 * f, 0.5], y) for f in (0, 1) for y in (0, 1)]
    assert U.oof_weights(of(fine), 2, 4).count() == 3
    for rows in (fine[:2], fine[:3], []):
        with pytest.raises(ValueError, match="both classes"):
            U.oof_weights(of(rows), 2, 4)
    with pytest.raises(Exception, match="scores must be in"):
        U.oof_weights(of([*fine, (0, [1.5, 0.1], 0)]), 2, 4)
    with pytest.raises(ValueError, match="prior"):
        U.oof_weights(of(fine), 2, 4, prior=[1.0, 0.0])
    scores = lambda rows: spark.createDataFrame(rows, "channel string, score double, label int")
    for rows in ([("a", 0.1, 0), ("a", 0.2, 0)], [("a", 0.1, 0), ("a", float("nan"), 1)]):
        with pytest.raises(ValueError, match="'a'"):
            U.channel_calibrators(scores(rows))
    knots = U.channel_calibrators(scores([("a", 0.1, 0), ("a", 0.2, 1), ("b", 1.0, 1), ("b", 2.0, 0), ("b", None, 1)]))
    rows = spark.createDataFrame([("a", 0.15), ("a", 9.0), ("b", -1.0), ("c", 1.0)], "channel string, x double")
    assert sorted((r.channel, r.x, round(r.y, 9)) for r in U.calibrated(rows, knots).collect()) == [("a", 0.15, 0.5), ("a", 9.0, 1.0), ("b", -1.0, 0.5)]


def test_allowed_accepts_of_many_trials_match_whole_numbers(spark):
    """Beyond 7,000 trials 0.9 ** trials is zero in doubles; terms in logarithms are not."""

    def exact(n):
        term, total, k = 9**n, 9**n, 0
        while 20 * total <= 10**n:
            term = term * (n - k) // ((k + 1) * 9)
            total, k = total + term, k + 1
        return k - 1

    trials = [0, 28, 29, 600, 8000, 36000]
    rows = spark.createDataFrame([(n,) for n in trials], "n long").select("n", S.allowed_accepts(F.col("n"), 0.1, 0.05).alias("k"))
    assert {r.n: r.k for r in rows.collect()} == {n: exact(n) for n in trials}


def test_rows_are_worked_out_once(spark):
    """Scores behind the rows of a comparison may be dear."""
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(k, k % 4, float(k % 3)) for k in range(20)], "q long, c long, v double")
    dear = rows.mapInArrow(told, rows.schema)
    B.paired_intervals(dear, rows, "q", "c", ["v"], 20).collect()
    assert seen.value == 20
    B.bootstrap_intervals(dear, "c", ["v"], 20).collect()
    assert seen.value == 40
