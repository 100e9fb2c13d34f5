"""Periodic runs in the words of documents: stretches that repeat with a period, all of them and exactly.

A run is a stretch of words with smallest period q (words q apart are equal) of at least 2q words, and of at
least `least` words, that no neighbour extends with that period.

Karp-Miller-Rosenberg naming. Texts of a batch are laid out one after the other, each behind a separator that
equals nothing. Words are named by numbers, and stretches of 2, 4, 8, ... words by the pair of the names of
their halves; only stretches whose halves both occur twice can occur twice, so the pairs that are sorted
soon are few, and levels end where nothing repeats. How far two places go on alike, forward or
backward, is then found by going down the levels, for all places of a batch at once.

Every run of period q holds two words q apart of which the first is at a multiple of q from the text's start,
so the candidates of a text of n words are about n ln n places, of which those with two different words go
at once. The others are extended both ways. Of equal stretches the smallest period is kept: a larger one
is a multiple of it.

No text is looked at beyond itself, so there is no shuffle. A batch holds at_once words or one text;
a text of n words takes up to 4 n log2(n) bytes of names (if it is periodic throughout) and its
candidates are made in blocks.

Nulls, empties: a null text has no words, no runs and collapses to an empty text. Null ids and repeated rows
are kept, each by itself. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def power_names(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """names[j][i] for i up to len(ids) - 2**j: equal where the 2**j ids from i on are equal, for j up to
    the last level at which anything repeats and 2**j <= longest. Negative ids equal nothing."""
    names, live = [ids.astype(np.int32)], ids >= 0
    while (step := 1 << len(names) - 1) * 2 <= longest:
        last = names[-1]
        both = np.flatnonzero(live[:-step] & live[step:])
        if not len(both):
            break
        pair = last[both].astype(np.int64) * (int(last.max()) + 1) + last[both + step]
        order = np.argsort(pair, kind="stable")
        new = np.append(True, pair[order][1:] != pair[order][:-1])
        number = np.cumsum(new) - 1
        repeated = np.bincount(number)[number] > 1
        if not repeated.any():
            break
        name = -1 - np.arange(len(last) - step, dtype=np.int32)  # a stretch that occurs once
        name[both[order[repeated]]] = number[repeated]
        names.append(name)
        live = name >= 0
    return names


def ahead(names: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words from x and from y on are equal, for x < y."""
    at = np.zeros(len(x), np.int64)
    for j in range(len(names) - 1, -1, -1):
        name = names[j]
        to = y + at
        inside = to < len(name)
        to = np.where(inside, to, 0)
        at += (inside & (name[np.where(inside, x + at, 0)] == name[to])) * (1 << j)
    return at


def behind(names: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words before x and before y are equal, for x < y."""
    at = np.zeros(len(x), np.int64)
    for j in range(len(names) - 1, -1, -1):
        name, step = names[j], 1 << j
        begin = x - at - step
        inside = begin >= 0
        at += (inside & (name[np.where(inside, begin, 0)] == name[np.where(inside, y - at - step, 0)])) * step
    return at


def grid(n: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i (multiples of q) and periods q with i + q < n, for q up to n // 2, about most at once."""
    periods = np.arange(1, n // 2 + 1)
    count = -(-(n - periods) // periods)
    total = np.cumsum(count)
    lo = 0
    while lo < len(periods):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        c = count[lo:hi]
        q = np.repeat(periods[lo:hi], c)
        k = np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c)
        yield k * q, q
        lo = hi


def find_runs(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of the texts ids[start:start + size], in order of start, then
    period; places are of the whole layout."""
    names = power_names(ids, int(sizes.max(initial=1)))
    found = [np.empty((0, 3), np.int64)]
    held: list[np.ndarray] = []

    def extend() -> None:
        i, q = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        held.clear()
        begin, end = i - behind(names, i, i + q), i + q + ahead(names, i, i + q)
        good = end - begin >= np.maximum(least, 2 * q)
        found.append(np.unique(np.stack([begin[good], end[good], q[good]], axis=1), axis=0))

    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        if size < least:
            continue
        for i, q in grid(size):
            same = np.flatnonzero(ids[start + i] == ids[start + i + q])
            if len(same):
                held.append(np.stack([start + i[same], q[same]]))
        if sum(h.shape[1] for h in held) > 1 << 20:
            extend()
    if held:
        extend()
    runs = np.unique(np.concatenate(found), axis=0)
    # Sorted by start, end, period: of a stretch the smallest period is its first.
    first = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)) if len(runs) else np.empty(0, bool)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _parts(texts: list[bytes | None], at_once: int) -> Iterator[list[list[bytes]]]:
    part, n = [], 0
    for text in texts:
        words = (text or b"").split()  # splits at spaces and bytes 9 to 13
        if part and n + len(words) > at_once:
            yield part
            part, n = [], 0
        part.append(words)
        n += len(words)
    if part:
        yield part


def _solved(texts: list[list[bytes]], least: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Runs of texts (start within its text, length, period), how many each has, and collapsed texts."""
    sizes = np.array([len(w) for w in texts])
    starts = np.cumsum(sizes + 1) - sizes
    ids, number = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64), {}
    ids[np.append(starts - 1, len(ids) - 1)] = -1 - np.arange(len(texts) + 1)
    for start, words in zip(starts.tolist(), texts, strict=True):
        ids[start : start + len(words)] = [number.setdefault(w, len(number)) for w in words]
    runs = find_runs(ids, starts, sizes, least)
    owner = np.searchsorted(starts, runs[:, 0], "right") - 1
    depth = np.zeros(len(ids) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    dropped = np.cumsum(depth) > 0
    has = np.bincount(owner, minlength=len(texts))
    out = []
    for start, words, n in zip(starts.tolist(), texts, has.tolist(), strict=True):
        out.append(b" ".join([w for w, gone in zip(words, dropped[start : start + len(words)].tolist(), strict=True) if not gone] if n else words))
    return np.stack([runs[:, 0] - starts[owner], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1), has, out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, at_once: int = 100_000) -> DataFrame:
    """(id, n_words, runs, collapsed) for every row: runs(start, length, period) in order of start, then period,
    counted in words from 0, and the words that no run holds after its first period, joined by one space.
    Words are stretches without space, tab, line feed, vertical tab, form feed and return."""
    shape = f"n_words long, runs {RUNS}, collapsed string"
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL(shape).fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        form = to_arrow_schema(schema)
        kind = form.field("runs").type
        for batch in batches:
            at = 0
            for part in _parts(batch.column(1).to_pylist(), at_once):
                runs, has, collapsed = _solved(part, least)
                values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in runs.T], fields=list(kind.value_type))
                offsets = pa.array(np.append(0, np.cumsum(has)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(part)).cast(form.field(0).type),
                        pa.array([len(w) for w in part], pa.int64()),
                        pa.ListArray.from_arrays(offsets, values).cast(kind),
                        pa.array(collapsed, pa.binary()).cast(form.field(3).type),
                    ],
                    schema=form,
                )
                at += len(part)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)
