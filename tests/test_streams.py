"""Streams whose rows arrive out of order: equal to batches, through restarts, with late rows and streams that end."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomfield.operators import coverage as C
from loomfield.streaming import ordered as O

SHAPE = "stream string, time timestamp, seq long, usable boolean, run_key string, claimed long, value double"


def made(n=120):
    """Two streams of seconds, one with gaps, and values that are missing at times."""
    rng = np.random.default_rng(3)
    rows = []
    for s in "ab":
        at = np.cumsum(rng.integers(1, 40, n))
        for k, t in enumerate(at):
            claim = None if k % 31 == 30 else int(t + rng.integers(-30, 30)) * 1_000_000
            rows.append((s, int(t), k, None if k % 17 == 0 else bool(rng.random() < 0.8), None if k % 23 == 0 else str(k // 9), claim, None if k % 13 == 0 else float(rng.integers(0, 90))))
    return rows


def table(spark, rows):
    pdf = pd.DataFrame(rows, columns=["stream", "s", "seq", "usable", "run_key", "claimed", "value"]).astype({"claimed": "Int64"})
    raw = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf.astype(object).itertuples(index=False)], "stream string, s long, seq long, usable boolean, run_key string, claimed long, value double")
    return raw.select("stream", F.timestamp_seconds("s").alias("time"), "seq", "usable", "run_key", "claimed", "value")


def streamed(spark, folder, parts, fold, delay="200 seconds", idle=10_000_000, stop_after=None):
    """Updates of fold over parts, a file each; with stop_after the query ends there and starts again."""
    def arrive(rows):
        table(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def go():
        rows = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        told = O.in_order(rows, fold, "time", delay, idle)
        q = told.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{folder}/out"))
        with O.rocksdb_state(spark):
            q.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    for k, part in enumerate(parts):
        arrive(part)
        if k == stop_after:
            go()
    go()
    return spark.read.parquet(f"{folder}/out")


END = ("~", 9_000, 0, None, None, None, None)


def shuffled(rows, seed, files=5, span=150):
    """Files by time, rows up to `span` seconds out of order."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[1] + rng.uniform(0, span))
    cut = -(-len(order) // files)
    return [order[k : k + cut] for k in range(0, len(order), cut)] + [[END]]


@pytest.mark.parametrize("stop_after", [None, 2])
def test_shuffled_arrival_equals_batches(spark, tmp_path, stop_after):
    rows = made()
    batch = table(spark, rows).withColumn("at", F.unix_micros("time"))
    last = {}
    for name, fold in (("coverage", O.CoverageFold(20_000_000, 30_000_000)), ("audit", O.AuditFold(10_000_000)), ("energy", O.EnergyFold())):
        updates = streamed(spark, tmp_path / name, shuffled(rows, 7), fold, stop_after=stop_after)
        assert updates.filter("late > 0").count() == 0 and updates.filter("stream = 'a'").count() > 3
        last[name] = O.latest_totals(updates).filter("stream <> '~'").drop("late", "opened", "closed").toPandas().set_index("stream")
        assert (last[name]["rows"] == 120).all()
    held = C.held(batch, "stream", "at", 20_000_000, 0)
    good = F.coalesce(F.col("usable"), F.lit(False)) & F.col("run_key").isNotNull()
    want = C.durations(held, {"usable": good}, ["stream"]).toPandas().set_index("stream")
    for s in "ab":
        assert [last["coverage"].loc[s, c] for c in ("observed", "unobserved", "usable")] == [want.loc[s, c] for c in ("observed", "unobserved", "usable")]
    runs = C.runs(held, "stream", "at", F.col("usable"), F.col("run_key"), 30_000_000).toPandas()
    ends = batch.groupBy("stream").agg(F.max("at").alias("end")).toPandas().set_index("stream")["end"]
    for s in "ab":  # a run that the last row belongs to is still open on the stream
        final = max((r for r in rows if r[0] == s), key=lambda r: r[1])
        own = runs[runs.stream == s]
        closed = own[(own.start + own.duration < ends[s]) | (not final[3]) | (own.key != final[4])]
        assert last["coverage"].loc[s, "runs"] == len(closed) > 3
    audit = C.gap_audit(batch.withColumn("arrival", F.col("at") * 1000 + F.col("seq")), "stream", "arrival", "claimed", 10_000_000).toPandas().set_index("stream")
    for s in "ab":
        got = last["audit"].loc[s]
        assert [got[c] for c in ("frames", "nulls", "inversions", "duplicates", "missing", "max_gap")] == [audit.loc[s, c] for c in ("frames", "nulls", "inversions", "duplicates", "missing", "max_gap")]
    energy = C.integral(batch, "stream", "at", "value").toPandas().set_index("stream")
    for s in "ab":
        got = last["energy"].loc[s]
        assert np.allclose([got["total"] / got["valid"], got["peak"], got["integral"]], energy.loc[s, ["mean", "max", "integral"]].astype(float))


def test_late_rows_are_counted_and_go_no_further(spark, tmp_path):
    rows = [("a", 10 * k, k, True, "k", None, float(k)) for k in range(60)]
    late = [("a", 15, 900, True, "k", None, 1e9), ("a", 205, 901, True, "k", None, 1e9)]
    parts = [rows[:30], rows[30:50], late + rows[50:], [END], [("a", 77, 902, True, "k", None, 1e9)]]
    last = O.latest_totals(streamed(spark, tmp_path, parts, O.EnergyFold(), "50 seconds")).filter("stream = 'a'").first()
    assert (last["rows"], last.late, last.peak, last.total) == (60, 3, 59.0, sum(range(60)))


def test_streams_end_and_their_state_goes(spark, tmp_path):
    first = [("a", k, k, True, "k", None, 1.0) for k in range(20)]
    other = [("b", 500 + k, k, True, "k", None, 2.0) for k in range(20)]
    again = [("a", 1000 + k, k, True, "k", None, 3.0) for k in range(5)]
    updates = streamed(spark, tmp_path, [first, other, again, [END]], O.EnergyFold(), "10 seconds", idle=100_000)
    got = {(r.stream, r.opened): (r["rows"], r.total, r.closed) for r in O.latest_totals(updates).collect()}
    assert got == {("a", 0): (20, 20.0, True), ("b", 500_000_000): (20, 40.0, True), ("a", 1_000_000_000): (5, 15.0, True)}


def test_folds_do_not_hang_on_how_rows_are_cut():
    frame = pd.DataFrame(made()[:120], columns=["stream", "at", "seq", "usable", "run_key", "claimed", "value"])
    frame = pd.concat([frame, frame.iloc[[5, 50]]]).sort_values(["at", "seq"])  # two rows of one time
    for fold in (O.CoverageFold(20, 30), O.AuditFold(10_000_000), O.EnergyFold()):
        whole = fold.fold(fold.start, frame)
        for step in (1, 3, 50):
            state = fold.start
            for k in range(0, len(frame), step):
                state = fold.fold(state, frame.iloc[k : k + step])
            assert all(a == b or abs(a - b) < 1e-6 for a, b in zip(state, whole)), fold


def test_streams_of_a_bucket_share_the_calls_to_the_state_store():
    calls, kept, timers = [], {}, set()

    class Value:
        def get(self):
            calls.append("get")
            return kept.get("v")

        def update(self, v):
            calls.append("update")
            kept["v"] = v

        def clear(self):
            calls.append("clear")
            kept.clear()

    class Handle:
        getValueState = staticmethod(lambda name, schema: Value())  # noqa: N815
        registerTimer = staticmethod(timers.add)  # noqa: N815
        deleteTimer = staticmethod(timers.discard)  # noqa: N815

    class Clock:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    processor = O.InOrder(O.EnergyFold(), 10_000)
    processor.init(Handle())
    rows = pd.DataFrame([(0, str(s), 1_000_000 * k, k, float(s)) for s in range(200) for k in (3, 1, 2)], columns=["bucket", "stream", "at", "seq", "value"])
    assert not list(processor.handleInputRows((0,), iter([rows]), Clock(0))) and calls == ["get", "update"] and timers == {1000}
    told = pd.concat(processor.handleExpiredTimer((0,), Clock(2500), None))
    assert (told["samples"] == 2).all() and len(told) == 200 and len(calls) == 4 and timers == {3000}
    told = pd.concat(processor.handleExpiredTimer((0,), Clock(90_000), None)).set_index("stream")
    assert told["closed"].all() and (told["samples"] == 3).all() and told.loc["7", "total"] == 21.0 and not kept and not timers


def test_streams_are_folded_at_once_as_one_by_one():
    frames, calls = [], []
    for k in range(40):
        own = pd.DataFrame(made()[3 * k % 60 : 3 * k % 60 + k], columns=["stream", "at", "seq", "usable", "run_key", "claimed", "value"]).sort_values(["at", "seq"])
        frames.append(pd.concat([own, own.iloc[:1]]).sort_values(["at", "seq"]))
    for fold in (O.CoverageFold(20, 30), O.AuditFold(10_000_000), O.EnergyFold()):
        alone, together = [fold.start] * 40, [fold.start] * 40
        for part in (lambda f: f.iloc[: len(f) // 2], lambda f: f.iloc[len(f) // 2 :]):
            alone = [fold.fold(s, part(f)) for s, f in zip(alone, frames)]
            own = np.repeat(np.arange(40), [len(part(f)) for f in frames])
            together = fold.folds(together, own, pd.concat([part(f) for f in frames]))
        assert together[0] == fold.start and all(a == b or abs(a - b) < 1e-6 for x, y in zip(alone, together) for a, b in zip(x, y)), fold

    class Counted(O.EnergyFold):
        def folds(self, states, own, rows):
            calls.append(len(states))
            return super().folds(states, own, rows)

    streams = {str(s): (dict(zip(O._CLOCK, (None, None, None, 0, 0, 0))), O.EnergyFold.start) for s in range(200)}
    processor = O.InOrder(Counted(), 10_000)
    # Every stream opens twice, the second time after a pause.
    rows = pd.DataFrame([(str(s), at, None, float(s)) for s in range(200) for at in (0, 1000, 90_000_000)], columns=["stream", "at", "seq", "value"])
    told, waiting = processor._released(streams, processor._frame(rows), 90_001)
    assert calls == [200, 200] and not len(waiting) and len(told) == 400 and sum(t[-1] for t in told) == 200
