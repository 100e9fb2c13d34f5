"""Removal of repeated byte strings by longest-previous-factor arrays of anchored suffix orders.

A position repeats if the `length` bytes that start there also start elsewhere, that is, if its longest
previous factor, or the longest factor that it shares with a later position, is at least that long.
Both follow from suffix order: the previous and next smaller positions around an entry give the longest
match that starts earlier, the previous and next larger ones the longest that starts later.

Suffixes are never sorted all together. Each window of `length` bytes has an anchor: the gram with
the least hash in it, so equal windows have equal anchors, at equal distances. The windows that share
an anchor position are consecutive and form a context. Contexts meet by the hash of their anchor:
- anchors that occur once cannot hold a repeat; they drop out after one pre-aggregated count;
- contexts of equal bytes (by a 128-bit digest) repeat in all their windows, however many copies there are;
- the distinct contexts of an anchor go to one group, where their windows are put in suffix order (by
  doubling, cut off at `length` bytes) and get their factor lengths from common prefixes.

A group of more than max_contexts distinct contexts is split by the distance of a window from its
anchor: half of the distances share `gram` bytes and half of the rest, so each half of a context goes to
a smaller group, named by the digest of the bytes that all windows at these distances hold there. Groups
are halved until they are small enough, or a window is its group's name and nothing is left to compare.

keep="none" removes all copies of a repeat, keep="first" all but the first in order of key and
position. Matches never cross texts and are judged on the input; removed bytes are all bytes of all
repeating windows.

Nulls, empties: a null text is an empty one; texts shorter than `length` lose nothing. Null ids and
repeated rows are kept, each row a text of its own (rows whose ids repeat, or are no integers, are
numbered in a stored snapshot first). An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.llm.common import has_repeats, materialize
from loomfield.llm.hashing import prefix_hashes, substring_hashes

_LOW = np.uint64((1 << 24) - 1)
_MARKS = "key long, lo long, hi long, gram long"
_PIECES = "grp binary, near int, far int, key long, lo long, target boolean, text binary"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _ranked(own: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of own, and these with their lower 24 bits replaced by the place."""
    place = np.arange(len(own) - gram + 1)
    h = substring_hashes(prefix_hashes(own), place, place + gram)
    return h, (h & ~_LOW) | place.astype(np.uint64)


def anchored(data: np.ndarray, length: int, gram: int, part: int = 1 << 23) -> tuple[np.ndarray, ...]:
    """The contexts of data: first and last window start, hash of the anchor gram. The anchor of a
    window is its gram with the least hash, ties (of the upper 40 bits) to the first. Windows are taken
    `part` at a time; a context that goes on beyond is two, of one anchor."""
    found = []
    for at in range(0, max(0, len(data) - length + 1), part):
        h, ranked = _ranked(data[at : at + part + length - 1], gram)
        # Sliding minima: the end of one block of grams and the beginning of the next.
        width = length - gram + 1
        n = len(h) - width + 1
        blocks = np.concatenate([ranked, np.full(-len(h) % width, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _LOW).astype(np.int64)
        lo = np.flatnonzero(np.diff(anchor, prepend=-1))
        hi = np.append(lo[1:], n) - 1
        found.append((at + lo, at + hi, h[anchor[lo]]))
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def halves(text: bytes, near: int, far: int, length: int, gram: int) -> Iterator[tuple[bytes, int, int, int, int]]:
    """The two parts of a context (of windows between `near` and `far` bytes before their anchor): name of
    the group, its distances, first and last window."""
    data, last = np.frombuffer(text, np.uint8), len(text) - length
    anchor = last + int(np.argmin(_ranked(data[last:length], gram)[1]))
    middle = (near + far) // 2
    for a, b in ((near, middle), (middle + 1, far)):
        lo, hi = max(0, anchor - b), min(last, anchor - a)
        if a <= b and lo <= hi:
            shared = text[anchor - a : anchor - b + length]
            yield digest(a.to_bytes(4, "little") + b.to_bytes(4, "little") + shared), a, b, lo, hi


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of [start, end) rows as maximal disjoint rows, touching ones joined."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]], axis=1)


def prefix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(size, rank of the size bytes from each position on) for sizes that double up to length, in
    lexicographic order; beyond the end of data bytes are zero. The last size is length."""
    n, size = len(data), min(8, length)
    padded = np.concatenate([data, np.zeros(size, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(size):
        word = (word << np.uint64(8)) | padded[k : k + n]
    out = [(size, np.unique(word, return_inverse=True)[1].astype(np.int64))]
    while size < length:
        step = min(size, length - size)
        rank = out[-1][1]
        second = np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])
        size += step
        out.append((size, np.unique(rank * (n + 1) + second, return_inverse=True)[1].astype(np.int64)))
    return out


def common_prefixes(ranks: list[tuple[int, np.ndarray]], data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Length of the common prefix of the windows at a and at b, element by element."""
    got, end = np.zeros(len(a), np.int64), len(data) - 1
    for size, rank in reversed(ranks):
        same = rank[np.minimum(a + got, end)] == rank[np.minimum(b + got, end)]
        got[same] += size
    for _ in range(ranks[0][0]):
        same = (got < length) & (data[np.minimum(a + got, end)] == data[np.minimum(b + got, end)])
        if not same.any():
            break
        got[same] += 1
    return np.minimum(got, length)


def previous_factors(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factor of each entry of a suffix order: position of each entry, and common prefix
    with the entry before. The nearest entries with a smaller position on both sides are found by
    following pointers over entries that are larger, which carry the least common prefix on the way."""

    def side(position: np.ndarray, reach: np.ndarray) -> np.ndarray:
        at, reach = np.arange(-1, len(position) - 1), reach.copy()
        todo = np.flatnonzero((at >= 0) & (position[at] > position))
        while todo.size:
            over = at[todo]
            reach[todo], at[todo] = np.minimum(reach[todo], reach[over]), at[over]
            now = at[todo]
            todo = todo[(now >= 0) & (reach[todo] > 0) & (position[now] > position[todo])]
        reach[(at < 0) | (position[at] > position)] = 0
        return reach

    before = side(position, lcp)
    after = side(position[::-1], np.append(lcp[1:], 0)[::-1])[::-1]
    return np.maximum(before, after)


def repeats_in_order(group: np.ndarray, data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows in order of position: has an earlier, has a later copy within its group."""
    ranks = prefix_ranks(data, length)
    order = np.lexsort((ranks[-1][1][start], group))
    lcp = np.zeros(len(order), np.int64)
    if len(order):
        inner = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        lcp[inner] = common_prefixes(ranks, data, start[order[inner - 1]], start[order[inner]], length)
    earlier, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    earlier[order] = previous_factors(order, lcp) >= length
    later[order] = previous_factors(-order, lcp) >= length
    return earlier, later


def longest_previous_factors(data: bytes) -> np.ndarray:
    """LPF array of one text: for each position the longest match that starts earlier, from the
    suffix array (by doubling), its common prefixes, and previous and next smaller positions."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    rank, size = np.frombuffer(data, np.uint8).astype(np.int64), 1
    while True:
        second = np.concatenate([rank[size:] + 1, np.zeros(min(size, n), np.int64)])[:n]
        order = np.lexsort((second, rank))
        new = np.concatenate(([0], np.cumsum((rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1]))))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        size *= 2
    lcp, k = np.zeros(n, np.int64), 0
    for i in range(n):
        if rank[i]:
            j = int(order[rank[i] - 1])
            while i + k < n and j + k < n and data[i + k] == data[j + k]:
                k += 1
            lcp[rank[i]] = k
            k = max(0, k - 1)
        else:
            k = 0
    out = np.zeros(n, np.int64)
    out[order] = previous_factors(order, lcp)
    return out


def _marks(rows: DataFrame, length: int, gram: int, part: int, whole: bool) -> DataFrame:
    """The contexts of all rows; with whole, also the digest of each one's bytes."""
    names = ["key", "lo", "hi", "gram", "whole"][: 5 if whole else 4]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts, digests = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py() or b""
                found = anchored(np.frombuffer(data, np.uint8), length, gram, part)
                keys.append(np.full(len(found[0]), key))
                parts.append(found)
                if whole:
                    digests += [digest(data[a:b]) for a, b in zip(found[0].tolist(), (found[1] + length).tolist(), strict=True)]
            if parts:
                lo, hi, h = (np.concatenate(x) for x in zip(*parts, strict=True))
                columns = [pa.array(c) for c in (np.concatenate(keys).astype(np.int64), lo, hi, h.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(digests, pa.binary())] if whole else [])], names=names)

    return rows.select("key", "text").mapInArrow(run, _MARKS + (", whole binary" if whole else ""))


def _salt() -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(32)).alias("salt")


def _counted(marks: DataFrame, grp: str) -> DataFrame:
    """marks with the copies of their context, whether they are the first of them, and the distinct contexts
    of their group, all and those without a copy (contexts, lone). Copies of one context may be most of the
    marks: they are counted by salt, then whole, and the counts go back to the salts that they came from."""
    marks = marks.withColumn("salt", _salt())
    parts = marks.groupBy(grp, "whole", "salt").agg(F.count("*").alias("n"), F.min(F.struct("key", "lo")).alias("f"))
    kinds = parts.groupBy(grp, "whole").agg(F.sum("n").alias("copies"), F.min("f").alias("first"), F.collect_list("salt").alias("salts"))
    kinds = materialize(kinds, "kinds")
    groups = kinds.groupBy(grp).agg(F.count("*").alias("contexts"), F.count(F.when(F.col("copies") == 1, 1)).alias("lone"))
    kinds = kinds.join(groups, grp).withColumn("salt", F.explode("salts")).drop("salts")
    first = (F.col("key") == F.col("first.key")) & (F.col("lo") == F.col("first.lo"))
    return marks.join(kinds, [grp, "whole", "salt"]).withColumn("is_first", first).drop("first", "salt")


def _finish(data: bytes, spans: np.ndarray, texts: bool) -> tuple:
    gone = merged(spans)
    edges = [0, *gone.ravel().tolist(), len(data)]
    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    removed = int((gone[:, 1] - gone[:, 0]).sum())
    return len(data), removed, [{"start": a, "end": b} for a, b in gone.tolist()], hashlib.sha256(kept).hexdigest(), kept if texts else None


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 200,
    gram: int = 64,
    keep: str = "none",
    texts: bool = True,
    max_contexts: int = 4096,
    part: int = 1 << 23,
) -> DataFrame:
    """Every row: id_col, n_bytes, n_removed, spans (removed byte ranges), kept_sha256, and the
    remaining bytes as kept (null unless texts is set). Windows are anchored `part` at a time, and groups
    hold at most max_contexts contexts; neither changes the result."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep is {keep!r}; it may be 'none' or 'first'")
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    if isinstance(id_type, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) and not has_repeats(rows, "id"):
        rows = rows.select("id", F.col("id").cast("long").alias("key"), "text")
    else:
        rows = materialize(rows.withColumn("key", F.monotonically_increasing_id()), "snapshot")

    # A gram may be in most of the marks: it is counted, and looked up again, by salt.
    counts = _marks(rows, length, gram, part, False).groupBy("gram", _salt()).count()
    often = counts.groupBy("gram").agg(F.sum("count").alias("n"), F.collect_list("salt").alias("salts")).filter("n > 1")
    often = often.select("gram", F.explode("salts").alias("salt"))
    marks = _marks(rows, length, gram, part, True).withColumn("salt", _salt())
    repeated = materialize(marks.join(often, ["gram", "salt"]).drop("salt"), "repeated")
    counted = materialize(_counted(repeated, "gram"), "counted")
    spans = lambda df: df.select("key", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    copied = "copies > 1" if keep == "none" else "NOT is_first"
    unlike = "is_first AND contexts > 1" + (" AND lone > 0" if keep == "none" else "")
    known, asked = spans(counted.filter(copied)), counted.filter(unlike)

    # One join of the texts with what is known of them and what is asked of them.
    span_type = "array<struct<start: bigint, end: bigint>>"
    ask_type = "array<struct<lo: bigint, hi: bigint, gram: bigint, target: boolean, contexts: bigint>>"
    target = (F.col("copies") == 1) | F.lit(keep == "first")
    notes = (
        known.select("key", F.struct("start", "end").alias("span"), F.lit(None).cast(ask_type[6:-1]).alias("ask"))
        .union(
            asked.select(
                "key",
                F.lit(None).cast(span_type[6:-1]),
                F.struct("lo", "hi", "gram", target.alias("target"), "contexts"),
            )
        )
        .groupBy("key")
        .agg(F.collect_list("span").alias("spans"), F.collect_list("ask").alias("asks"))
    )
    joined = rows.join(notes.hint("shuffle_hash"), "key", "left")
    result = T.StructType(
        [T.StructField("key", T.LongType()), T.StructField("id", id_type), T.StructField("text", T.BinaryType())]
        + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed")]
        + [
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
            T.StructField("kept_sha256", T.StringType()),
            T.StructField("kept", T.BinaryType()),
            T.StructField("grp", T.BinaryType()),
            T.StructField("lo", T.LongType()),
            T.StructField("target", T.BooleanType()),
            T.StructField("contexts", T.LongType()),
            T.StructField("kind", T.StringType()),
        ]
    )

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """done: a row that nothing is asked of, finished; open: one that waits for answers; context:
        the bytes of a context."""
        from pyspark.sql.pandas.types import to_arrow_schema

        form = to_arrow_schema(result)
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                data = row["text"] or b""
                own = row["spans"] or []
                if not row["asks"]:
                    gone = np.array([(x["start"], x["end"]) for x in own], np.int64)
                    done = dict(zip(("n_bytes", "n_removed", "spans", "kept_sha256", "kept"), _finish(data, gone, texts), strict=True))
                    out.append(done | {"key": row["key"], "id": row["id"], "kind": "done"})
                else:
                    out.append({"key": row["key"], "id": row["id"], "text": data, "spans": own, "kind": "open"})
                for x in row["asks"] or []:
                    piece = {"lo": x["lo"], "text": data[x["lo"] : x["hi"] + length], "target": x["target"], "contexts": x["contexts"]}
                    out.append(piece | {"key": row["key"], "grp": x["gram"].to_bytes(8, "little", signed=True), "kind": "context"})
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=form)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=form)

    looked = materialize(joined.select("key", "id", "text", "spans", "asks").mapInArrow(look, result), "looked")

    def resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(groups: list, keys: list, los: list, targets: list, pieces: list) -> pa.RecordBatch:
            data = np.frombuffer(b"".join(pieces), np.uint8)
            size = np.array([len(x) for x in pieces])
            n = size - length + 1
            first = np.cumsum(size) - size
            name = np.cumsum([0, *(a != b for a, b in zip(groups[1:], groups[:-1], strict=True))])
            of = np.repeat(np.arange(len(pieces)), n)
            step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            start = first[of] + step
            # Rows come in order of group, key and position.
            earlier, later = repeats_in_order(name[of], data, start, length)
            gone = np.array(targets)[of] & (earlier if keep == "first" else earlier | later)
            begins = gone & ~np.append(False, gone[:-1] & (of[1:] == of[:-1]))
            ends = gone & ~np.append(gone[1:] & (of[1:] == of[:-1]), False)
            a, b = np.flatnonzero(begins), np.flatnonzero(ends)
            lo, key = np.array(los, np.int64), np.array(keys, np.int64)
            columns = [key[of[a]], lo[of[a]] + step[a], lo[of[b]] + step[b] + length]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "start", "end"])

        held: list[list] = [[], [], [], [], []]
        total = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if total > 1 << 20 and row[0] != held[0][-1]:
                    yield solve(*held)
                    held, total = [[], [], [], [], []], 0
                for column, x in zip(held, row, strict=True):
                    column.append(x)
                total += len(row[4])
        if held[0]:
            yield solve(*held)

    def halve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                for grp, a, b, lo, hi in halves(x["text"], x["near"], x["far"], length, gram):
                    text = x["text"][lo : hi + length]
                    out.append({"grp": grp, "near": a, "far": b, "key": x["key"], "lo": x["lo"] + lo, "hi": x["lo"] + hi, "target": x["target"], "text": text, "whole": digest(text)})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=halved)

    halved = pa.schema(
        [(n, t) for n, t in zip(("grp", "near", "far", "key", "lo"), (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
        + [("target", pa.bool_()), ("text", pa.binary()), ("hi", pa.int64()), ("whole", pa.binary())]
    )
    distances = [F.lit(0).alias("near"), F.lit(length - gram).alias("far")]
    pieces = looked.filter("kind = 'context'").select("grp", *distances, "key", "lo", "target", "text", "contexts")
    small, found, rounds = [], [], asked.filter(F.col("contexts") > max_contexts).limit(1)
    while rounds.take(1):
        small.append(pieces.filter(F.col("contexts") <= max_contexts))
        large = pieces.filter(F.col("contexts") > max_contexts).drop("contexts")
        parts = materialize(large.mapInArrow(halve, _PIECES + ", hi long, whole binary"), "halved")
        parts = materialize(_counted(parts, "grp"), "halved")
        found.append(spans(parts.filter("target").filter(copied)))
        alone = F.col("target") & ((F.col("copies") == 1) | F.lit(keep == "first"))
        pieces = parts.filter(unlike).withColumn("target", alone).select(*pieces.columns)
        rounds = pieces.filter(F.col("contexts") > max_contexts).limit(1)
    for x in small:
        pieces = pieces.unionByName(x)
    answers = (
        pieces.select("grp", "key", "lo", "target", "text")
        .repartition("grp")
        .sortWithinPartitions("grp", "key", "lo")
        .mapInArrow(resolve, "key long, start long, end long")
    )
    for x in found:
        answers = answers.union(x)
    answers = answers.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("answers"))

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        form = to_arrow_schema(T.StructType([result[c] for c in ("id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept")]))
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                gone = np.array([(x["start"], x["end"]) for x in [*row["spans"], *(row["answers"] or [])]], np.int64)
                out.append((row["id"], *_finish(row["text"], gone, texts)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), form, strict=True)], schema=form)

    told = ["id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"]
    waiting = looked.filter("kind = 'open'").select("key", "id", "text", "spans").join(answers.hint("shuffle_hash"), "key", "left")
    closed = waiting.select("id", "text", "spans", "answers").mapInArrow(close, T.StructType([result[c] for c in told]))
    return looked.filter("kind = 'done'").select(*told).union(closed).withColumnRenamed("id", id_col)

