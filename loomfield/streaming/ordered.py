"""Folds over streams whose rows arrive out of order, with keyed buffers, event-time timers and state that ends.

Rows of a stream wait in its buffer until the watermark passes their time; then all that it has passed
are folded in order of time (ties by seq), a batch of them at once, and the totals so far are told. What a
stream holds is its buffer (rows of the delay's length), its totals and when it is next due; streams share
buckets, of one timer each. A row at or before what has been released already is late: it is counted and goes no
further. A pause of more than `idle` closes a stream: its totals are told a last time and its state goes. Whether
rows after the pause have arrived by then makes no difference. Where there is no state, rows further behind the watermark than `idle` count as late.

Totals are running ones, from `opened`, the time of the first row since the stream (re)opened (null for a
stream that late rows alone came to). Of an opening's updates the one with the most rows is its state
so far, whatever order sinks see them in. Restarts go on from the checkpoint. Rows without a stream or time take
no part. The session's state store must be RocksDB's (rocksdb_state() sets it for a while): Spark keeps
several states of a key in no other.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


class Fold:
    """A rule with its columns, totals, what is carried from batch to batch, and the start of a state (totals, carried)."""

    def fold(self, state: tuple, rows: pd.DataFrame) -> tuple:
        """The state after the rows of one stream in order."""
        return self.folds([state], np.zeros(len(rows), np.int64), rows)[0]

    def folds(self, states: list[tuple], own: np.ndarray, rows: pd.DataFrame) -> list[tuple]:
        """States of many streams after their rows: own is the place of each row's stream in states, rising; rows
        of a stream are in order."""
        raise NotImplementedError


def _behind(own: np.ndarray, carried: np.ndarray, columns: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """own and columns, each (values of states, values of rows), with a stream's carried values before its rows."""
    at = np.flatnonzero(carried)
    both = np.concatenate([at, own])
    order = np.argsort(both, kind="stable")
    return both[order], *[np.concatenate([old[at], new])[order] for old, new in columns]


def _first_of_time(own: np.ndarray, at: np.ndarray, seen: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which rows are the first of their stream and time, none of the time carried."""
    new = np.append(True, at[1:] > at[:-1]) if len(at) else np.zeros(0, bool)
    begins = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(at) else np.zeros(0, np.int64)
    new[begins] = ~seen[own[begins]] | (at[begins] > last[own[begins]])
    return new


def _added(before: list, own: np.ndarray, values: np.ndarray) -> list:
    out = np.array(before, values.dtype)
    np.add.at(out, own, values)
    return out.tolist()


def _known(values: list, missing: object, kind: type) -> tuple[np.ndarray, np.ndarray]:
    return np.array([v is not None for v in values]), np.array([missing if v is None else v for v in values], kind)


@dataclass(frozen=True)
class CoverageFold(Fold):
    """Held time of rows(usable, run_key): an observation stands until the next one, max_hold at most; a run of
    usable rows of one key ends at another key and after a gap. Runs are counted once they have ended and
    stood for `least`; what the last row stands for is not known yet. Rows of one time are one: the first."""

    max_hold: int
    least: int
    columns = "usable boolean, run_key string"
    totals = "observed long, unobserved long, usable long, runs long"
    carried = "last long, good boolean, run string, held long"
    start = (0, 0, 0, 0, None, False, None, 0)

    def folds(self, states: list[tuple], own: np.ndarray, rows: pd.DataFrame) -> list[tuple]:
        observed, unobserved, usable, runs, last, good, run, held = zip(*states, strict=True)
        seen, last = _known(last, 0, np.int64)
        at, key = rows["at"].to_numpy(np.int64), rows["run_key"]
        ok = rows["usable"].eq(True).fillna(False).to_numpy(bool) & key.notna().to_numpy(bool)
        code, names = pd.factorize(np.concatenate([np.array(run, object), key.to_numpy(object)]))  # -1 for none
        new = _first_of_time(own, at, seen, last)
        own, at, ok, code = _behind(own[new], seen, [(last, at[new]), (np.array(good, bool), ok[new]), (code[: len(run)], code[len(run) :][new])])
        if not len(own):
            return states
        same = own[1:] == own[:-1]
        step = np.where(same, np.diff(at), 0)
        stands = np.minimum(step, self.max_hold)
        stood = np.where(ok[:-1], stands, 0)
        goes_on = same & ok[:-1] & ok[1:] & (step <= self.max_hold) & (code[1:] == code[:-1])
        number = np.append(0, np.cumsum(~goes_on))
        length = np.zeros(number[-1] + 1, np.int64)
        np.add.at(length, number[:-1], stood)
        begins = np.flatnonzero(np.append(True, ~same))
        length[number[begins]] += np.array(held, np.int64)[own[begins]]
        over = np.flatnonzero(same & ~goes_on & ok[:-1])
        over = over[length[number[over]] >= self.least]
        totals = _added(observed, own[1:], stands), _added(unobserved, own[1:], step - stands), _added(usable, own[1:], stood), _added(runs, own[over], np.ones(len(over), np.int64))
        out, ends = list(states), np.append(begins[1:], len(own)) - 1
        for k, t, o, c, n in zip(own[ends].tolist(), at[ends].tolist(), ok[ends].tolist(), code[ends].tolist(), length[number[ends]].tolist(), strict=True):
            out[k] = (*[x[k] for x in totals], t, o, names[c] if o else None, n)
        return out


@dataclass(frozen=True)
class AuditFold(Fold):
    """Steps of rows(claimed), the times that rows claim, in order of arrival: inversions, repeats, missing
    frames (each positive step in whole periods, less one) and the largest step. A null claim is counted and
    skipped."""

    period: int
    columns = "claimed long"
    totals = "frames long, nulls long, inversions long, duplicates long, missing long, max_gap long"
    carried = "last long"
    start = (0, 0, 0, 0, 0, None, None)

    def folds(self, states: list[tuple], own: np.ndarray, rows: pd.DataFrame) -> list[tuple]:
        frames, nulls, inversions, duplicates, missing, widest, last = zip(*states, strict=True)
        there = rows["claimed"].notna().to_numpy(bool)
        seen, last = _known(last, 0, np.int64)
        one = np.ones(len(own), np.int64)
        frames, nulls = _added(frames, own[there], one[there]), _added(nulls, own[~there], one[~there])
        own, claimed = _behind(own[there], seen, [(last, rows["claimed"][there].to_numpy(np.int64))])
        same = own[1:] == own[:-1]
        step, at = np.diff(claimed)[same], own[1:][same]
        up = np.maximum(step, 0)
        widest = np.array([w or 0 for w in widest], np.int64)
        np.maximum.at(widest, at, up)
        over = np.where(step > 0, np.maximum(0, (up + self.period // 2) // self.period - 1), 0)
        seen[own], last[own] = True, claimed  # the last of a stream's stays
        last = [t if s else None for t, s in zip(last.tolist(), seen.tolist(), strict=True)]
        counts = frames, nulls, _added(inversions, at, (step < 0).astype(np.int64)), _added(duplicates, at, (step == 0).astype(np.int64)), _added(missing, at, over)
        return list(zip(*counts, [w or None for w in widest.tolist()], last, strict=True))


@dataclass(frozen=True)
class EnergyFold(Fold):
    """Mean, maximum and trapezoid integral over time (in the unit of at) of rows(value); a step counts if both its
    ends have a value, and a null value is sampled but has none. Rows of one time are one: the first."""

    columns = "value double"
    totals = "samples long, valid long, total double, peak double, integral double"
    carried = "last long, value double"
    start = (0, 0, 0.0, None, 0.0, None, None)

    def folds(self, states: list[tuple], own: np.ndarray, rows: pd.DataFrame) -> list[tuple]:
        samples, valid, total, peak, integral, last, before = zip(*states, strict=True)
        seen, last = _known(last, 0, np.int64)
        before = np.array([np.nan if v is None else v for v in before], np.float64)
        at, value = rows["at"].to_numpy(np.int64), rows["value"].to_numpy(np.float64, na_value=np.nan)
        new = _first_of_time(own, at, seen, last)
        own, at, value = own[new], at[new], value[new]
        there = ~np.isnan(value)
        peak = np.array([-np.inf if p is None else p for p in peak], np.float64)
        np.maximum.at(peak, own[there], value[there])
        one = np.ones(len(own), np.int64)
        samples, valid, total = _added(samples, own, one), _added(valid, own[there], one[there]), _added(total, own[there], value[there])
        own, at, value = _behind(own, seen, [(last, at), (before, value)])
        area = (value[1:] + value[:-1]) / 2 * np.diff(at)
        step = (own[1:] == own[:-1]) & ~np.isnan(area)
        integral = _added(integral, own[1:][step], area[step])
        seen[own], last[own], before[own] = True, at, value  # the last of a stream's stays
        last = [t if s else None for t, s in zip(last.tolist(), seen.tolist(), strict=True)]
        before = [None if np.isnan(v) else v for v in before.tolist()]
        peak = [p if n else None for p, n in zip(peak.tolist(), valid, strict=True)]
        return list(zip(samples, valid, total, peak, integral, last, before, strict=True))


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


_CLOCK = ("released", "last", "opened", "rows", "late", "timer")
_KINDS = {"long": "Int64", "boolean": "boolean", "string": object, "double": "float64"}


class InOrder(StatefulProcessor):
    """Buffers rows of the streams of a key, releases them at the watermark and folds them. A key is a bucket of
    streams: a call to the state store or to pandas costs as much as hundreds of rows, and is made once for all of them."""

    unit = 1000  # of a row's time in a millisecond, which timers and watermarks count in

    def __init__(self, fold, idle_ms: int):
        self.rule, self.idle_ms = fold, idle_ms
        self.kept = ["at", "seq", *_names(fold.columns)]
        self.kinds = {"stream": object, "at": "int64"} | {x.split()[0]: _KINDS[x.split()[1]] for x in f"seq long, {fold.columns}".split(", ")}
        self.told = ["stream", *_names(fold.totals), "rows", "late", "opened", "closed"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "due long, kept binary")

    def _load(self) -> tuple[int | None, dict[str, tuple], pd.DataFrame]:
        """When the bucket's timer is due, by stream its clock and state, and the rows that wait."""
        held = self.bucket.get()
        streams, waiting = pickle.loads(bytes(held[1])) if held else ({}, None)
        return held[0] if held else None, streams, self._frame(pd.DataFrame(columns=list(self.kinds))) if waiting is None else waiting

    def _frame(self, rows: pd.DataFrame) -> pd.DataFrame:
        """rows with a type for each column that nulls do not change: pandas has made floats of longs with gaps."""
        return rows[list(self.kinds)].astype(self.kinds)

    def _keep(self, before: int | None, streams: dict[str, tuple], waiting: pd.DataFrame) -> None:
        due = min((clock["timer"] for clock, _ in streams.values()), default=None)
        if streams:
            self.bucket.update((due, pickle.dumps((streams, waiting if len(waiting) else None))))
        else:
            self.bucket.clear()
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)

    def _opened(self, watermark: int) -> tuple:
        """A stream without state. released: the time up to which all is folded or late; last: of the rows folded
        since opened; timer: when the next is due, null for none."""
        released = (watermark - self.idle_ms) * self.unit if watermark > 0 else None
        return dict(zip(_CLOCK, (released, None, None, 0, 0, None), strict=True)), self.rule.start

    def _row(self, stream: str, state: tuple, clock: dict, closed: bool) -> tuple:
        return (stream, *state[: len(self.told) - 5], clock["rows"], clock["late"], clock["opened"], closed)

    def _rows(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=self.told)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new, watermark = pd.concat([self._frame(r) for r in rows], ignore_index=True), timerValues.getCurrentWatermarkInMs()
        (timer, streams, waiting), out = self._load(), []
        own, names = pd.factorize(new["stream"].to_numpy(object))
        at = new["at"].to_numpy()
        for stream in names:
            if stream not in streams:
                streams[stream] = self._opened(watermark)
        limits = [streams[s][0]["released"] for s in names]
        fresh = at > np.array([np.iinfo(np.int64).min if x is None else x for x in limits], np.int64)[own]
        late = np.bincount(own[~fresh], minlength=len(names)).tolist()
        first = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(first, own[fresh], at[fresh])
        some = np.bincount(own[fresh], minlength=len(names)) > 0
        for stream, n, at_first, there in zip(names, late, first.tolist(), some.tolist(), strict=True):
            clock, state = streams[stream]
            clock["late"] += n
            if there:
                due = -(-at_first // self.unit)
                clock["timer"] = due if clock["timer"] is None else min(due, clock["timer"])
            elif clock["timer"] is None:  # nothing but late rows: the state still has to end
                clock["timer"] = watermark + self.idle_ms
            if n and clock["rows"]:
                out.append(self._row(stream, state, clock, False))
        told, waiting = self._released(streams, pd.concat([waiting, new[fresh]], ignore_index=True), watermark)
        self._keep(timer, streams, waiting)
        yield from self._rows(out + told)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer, streams, waiting = self._load()
        out, waiting = self._released(streams, waiting, timerValues.getCurrentWatermarkInMs())
        self._keep(timer, streams, waiting)
        yield from self._rows(out)

    def _released(self, streams: dict[str, tuple], waiting: pd.DataFrame, watermark: int) -> tuple[list[tuple], pd.DataFrame]:
        """Totals of the streams that are due, whose rows up to the watermark are folded, and the rows that wait on;
        ended streams are taken out. The first openings of all streams are folded at once, then the second ones."""
        due = [s for s, (clock, _) in streams.items() if clock["timer"] < watermark]
        if not due:
            return [], waiting
        idle, upto, out = self.idle_ms * self.unit, watermark * self.unit, []
        own, at = pd.Index(due, dtype=object).get_indexer(waiting["stream"]), waiting["at"].to_numpy()
        go = (own >= 0) & (at <= upto)
        following = np.full(len(due), np.iinfo(np.int64).max)
        np.minimum.at(following, own[~go & (own >= 0)], at[~go & (own >= 0)])
        rows, waiting, own = waiting[go], waiting[~go], own[go]
        order = np.lexsort((rows["seq"].to_numpy(np.int64, na_value=0), rows["seq"].isna().to_numpy(bool), at[go], own))
        rows, own = rows.iloc[order], own[order]
        at = rows["at"].to_numpy()
        begins = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (np.diff(at) > idle))) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.append(begins, len(at)))
        whose = own[begins]
        place = np.arange(len(begins)) - np.searchsorted(whose, whose)  # among the openings of a stream
        by_place = np.argsort(place, kind="stable")
        for at_once in np.split(by_place, np.flatnonzero(np.diff(place[by_place])) + 1) if len(begins) else []:
            states = []
            for stream, lo in zip((due[k] for k in whose[at_once]), begins[at_once], strict=True):
                clock, state = streams[stream]
                if clock["rows"] and at[lo] - clock["last"] > idle:
                    out.append(self._row(stream, state, clock, True))
                    state, clock["rows"], clock["late"] = self.rule.start, 0, 0
                if not clock["rows"]:
                    clock["opened"] = int(at[lo])
                states.append(state)
            n = size[at_once]
            taken = np.arange(n.sum()) + np.repeat(begins[at_once] - (np.cumsum(n) - n), n)
            states = self.rule.folds(states, np.repeat(np.arange(len(n)), n), rows.iloc[taken])
            for stream, state, hi, k in zip((due[k] for k in whose[at_once]), states, (begins + size)[at_once].tolist(), n.tolist(), strict=True):
                clock = streams[stream][0]
                clock["last"], clock["rows"] = int(at[hi - 1]), clock["rows"] + k
                streams[stream] = clock, state
        told = np.bincount(own, minlength=len(due)) > 0
        for stream, some, after in zip(due, told.tolist(), following.tolist(), strict=True):
            clock, state = streams.pop(stream)
            if some:
                clock["released"] = upto
            after = None if after == np.iinfo(np.int64).max else after
            ended = not clock["rows"] and after is None
            if clock["rows"]:
                ended = upto - clock["last"] >= idle and (after is None or after - clock["last"] > idle)
            if ended or some:
                out.append(self._row(stream, state, clock, ended))
            if ended:
                state, clock["rows"], clock["late"], clock["opened"] = self.rule.start, 0, 0, None
            if ended and after is None:
                continue
            ends = max(watermark + 1, -(-(clock["last"] + idle) // self.unit)) if clock["rows"] else None
            clock["timer"] = min(x for x in (ends, None if after is None else -(-after // self.unit)) if x is not None)
            streams[stream] = clock, state
        return out, waiting

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB; the session's own setting is put back."""
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    old = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def in_order(rows: DataFrame, fold, time: str, delay: str, idle_ms: int, buckets: int = 128) -> DataFrame:
    """rows(stream string, time timestamp, seq long, the fold's columns), a stream -> running totals of each
    stream: (stream, the fold's totals, rows, late, opened, closed). Rows wait for `delay`; a stream closes after
    idle_ms. Times are folded as microseconds. State is kept for `buckets` of streams, each read and written as one:
    as many as make a few thousand streams at most in each; a checkpoint goes on with the number it began with."""
    marked = rows.withWatermark(time, delay).filter(F.col("stream").isNotNull() & F.col(time).isNotNull())
    # The time goes on as a plain number: Spark drops late rows by a watermarked column, and they are to be counted.
    bucket = F.pmod(F.xxhash64("stream"), F.lit(buckets)).alias("bucket")
    plain = marked.select(bucket, "stream", F.unix_micros(time).alias("at"), "seq", *_names(fold.columns))
    shape = f"stream string, {fold.totals}, rows long, late long, opened long, closed boolean"
    return plain.groupBy("bucket").transformWithStateInPandas(InOrder(fold, idle_ms), shape, "Update", "EventTime")


def latest_totals(updates: DataFrame) -> DataFrame:
    """Of each stream and opening the update with the most rows, and of those with the most late ones."""
    rest = [c for c in updates.columns if c not in ("stream", "opened")]
    best = F.max_by(F.struct(*rest), F.struct("rows", "late", "closed")).alias("u")
    return updates.groupBy("stream", "opened").agg(best).select("stream", "opened", *[f"u.{c}" for c in rest])
