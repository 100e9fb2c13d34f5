"""Benchmark decontamination over a positional inverted index.

build_index() turns training texts into index segments: self-contained blocks of about
`segment_words` words, each with its term dictionary, its posting lists (word positions, sorted,
delta-coded) and its document directory. Segments are written once to the shared folder and can be
searched against any number of benchmarks. A search sends the test phrases to every segment, in
blocks of bounded size, so postings are never shuffled and no key can be hot: a segment has a
bounded number of words, whatever the words are (one document longer than that has a segment of
its own).

Within a segment a phrase is looked up from its rarest term: the positions of that term, less the
term's offset, are the candidate starts, which are intersected with the offset-adjusted lists of
the other terms, rarer ones first. Documents are one position apart, so no phrase crosses them.

Nulls, empties: a null or empty text has no words and no hits; a null id is returned as it is. Rows
that repeat are indexed and returned one by one. Items without words match nothing. An empty
benchmark gives no hits; empty documents give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.llm.common import materialize

#: Upper-case ASCII to lower case, every other ASCII byte but digits and letters to a blank. Bytes
#: of 0x80 and more belong to words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters, as UTF-8."""
    return text.translate(_WORD_BYTES).split() if text else []


class _Intern(dict):
    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def _segment(ids: list, lengths: list[int], coded: list[np.ndarray], terms: _Intern) -> dict:
    n = np.array(lengths, np.int64)
    starts = np.concatenate(([0], np.cumsum(n + 1)[:-1]))
    term = np.concatenate(coded) if coded else np.empty(0, np.int32)
    position = np.arange(len(term)) + np.repeat(np.arange(len(n)), n)
    listed = position[np.argsort(term, kind="stable")]
    return {
        "segment": uuid.uuid4().hex,
        "ids": ids,
        "lengths": n.astype(np.int32).tolist(),
        "starts": starts.tolist(),
        "terms": b"\n".join(terms),
        "counts": np.bincount(term, minlength=len(terms)).astype("<i4").tobytes(),
        "positions": np.diff(listed, prepend=0).astype("<i4").tobytes(),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = 1 << 19) -> DataFrame:
    """Index segments of all words of all rows, stored in the shared folder."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("segment", T.StringType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("lengths", T.ArrayType(T.IntegerType())),
            T.StructField("starts", T.ArrayType(T.LongType())),
            T.StructField("terms", T.BinaryType()),
            T.StructField("counts", T.BinaryType()),
            T.StructField("positions", T.BinaryType()),
        ]
    )

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        form = to_arrow_schema(schema)
        ids, lengths, coded, terms, total = [], [], [], _Intern(), 0
        pack = lambda: pa.RecordBatch.from_pylist([_segment(ids, lengths, coded, terms)], schema=form)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words(text.as_py())
                if total and total + len(own) > segment_words:
                    yield pack()
                    ids, lengths, coded, terms, total = [], [], [], _Intern(), 0
                ids.append(key)
                lengths.append(len(own))
                coded.append(np.fromiter(map(terms.__getitem__, own), np.int32, len(own)))
                total += len(own) + 1
        if ids:
            yield pack()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return materialize(rows.mapInArrow(index, schema), "postings")


class _Segment:
    """A stored segment, opened for the terms of a query."""

    def __init__(self, row: dict, query_terms: dict[bytes, int]):
        self.ids, self.lengths = row["ids"], np.array(row["lengths"], np.int64)
        self.starts = np.array(row["starts"], np.int64)
        self.size = int(self.lengths.sum()) + len(self.lengths)
        counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
        positions = np.cumsum(np.frombuffer(row["positions"], "<i4"), dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(counts)))
        terms = row["terms"].split(b"\n") if counts.size else []
        wanted = np.fromiter((query_terms.get(t, -1) for t in terms), np.int64, len(terms))
        here = np.flatnonzero(wanted >= 0)
        here = here[np.argsort(wanted[here])]
        self.count = np.zeros(len(query_terms), np.int64)
        self.count[wanted[here]] = counts[here]
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.positions = (
            np.concatenate([positions[first[t] : first[t + 1]] for t in here]) if here.size else np.empty(0, np.int64)
        )
        #: Posting lists of all query terms as one sorted list of term and position.
        self.keys = np.repeat(np.arange(len(query_terms)), self.count) * (self.size + 1) + self.positions

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        ok = (position >= 0) & (position < self.size)
        key = term * (self.size + 1) + np.where(ok, position, 0)
        at = np.searchsorted(self.keys, key)
        ok &= at < len(self.keys)
        ok[ok] = self.keys[at[ok]] == key[ok]
        return ok

    def phrases(self, windows: np.ndarray, at_once: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
        """Window number and start of every occurrence. windows: term ids, -1 beyond the end."""
        found_w, found_s = [], []
        if not windows.size or not self.keys.size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        huge = np.int64(1) << 60
        rarity = np.where(windows >= 0, self.count[windows], huge)
        live = np.flatnonzero(rarity.min(axis=1) > 0)
        if not live.size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        order = np.argsort(rarity[live], axis=1, kind="stable")
        least = np.take_along_axis(rarity[live], order[:, :1], 1)[:, 0]
        ends = np.cumsum(least)
        lo = 0
        while lo < len(live):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + at_once, "right")))
            n, rank = least[lo:hi], order[lo:hi]
            row = np.repeat(np.arange(lo, hi), n)
            term = windows[live[lo:hi], rank[:, 0]]
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = self.positions[np.repeat(self.first[term], n) + within] - np.repeat(rank[:, 0], n)
            for k in range(1, windows.shape[1]):
                offset = order[row, k]
                other = windows[live[row], offset]
                keep = other < 0
                some = ~keep
                keep[some] = self.has(other[some], start[some] + offset[some])
                row, start = row[keep], start[keep]
            found_w.append(live[row])
            found_s.append(start)
            lo = hi
        return np.concatenate(found_w), np.concatenate(found_s)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1

    def proximity(self, terms: list[int], within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document numbers and word spans (start, end exclusive) of all minimal spans of at most `within` words
        that hold every term: spans of which no part does."""
        none = np.empty(0, np.int64)
        if not terms or min(self.count[t] for t in terms) == 0:
            return none, none, none
        lists = [self.positions[self.first[t] : self.first[t + 1]] for t in terms]
        rarest = min(lists, key=len)
        lists = [x[self._near(x, rarest, within)] for x in lists]
        if not all(map(len, lists)):
            return none, none, none
        place = np.concatenate(lists)
        order = np.argsort(place, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # Where the term of each place comes next, by rank; a place is its term's last one until then.
        cuts, place = np.cumsum([len(x) for x in lists]), place[order]
        following = np.append(rank[1:], len(order))
        following[cuts - 1] = len(order)
        until = np.maximum.accumulate(following[order])
        b = np.arange(max(int(rank[c - len(x)]) for c, x in zip(cuts, lists, strict=True)), len(order))  # all terms have come
        a = np.searchsorted(until, b, "right")
        new = np.append(True, a[1:] > a[:-1])
        lo, hi = place[a[new]], place[b[new]]
        doc = self.doc_of(lo)
        fits = (hi - lo < within) & (hi < self.starts[doc] + self.lengths[doc])
        doc, lo, hi = doc[fits], lo[fits], hi[fits]
        return doc, lo - self.starts[doc], hi + 1 - self.starts[doc]

    @staticmethod
    def _near(x: np.ndarray, anchors: np.ndarray, within: int) -> np.ndarray:
        at = np.searchsorted(anchors, x - within)
        return (at < len(anchors)) & (anchors[np.minimum(at, len(anchors) - 1)] <= x + within)


def _blocks(items: DataFrame, id_col: str, text_col: str, max_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The distinct test items, in blocks that hold about max_words words (or one item); each is collected and
    broadcast alone."""
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (6 * max_words)))
    for b in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
        yield [(r.id, words(r.text.encode())) for r in part.collect() if r.text]


def _windows(items: list[tuple[str | None, list[bytes]]], size: int):
    terms, seen = _Intern(), {}
    for item, own in items:
        for k in range(max(1, len(own) - size + 1) if own else 0):
            seen.setdefault(tuple(map(terms.__getitem__, own[k : k + size])), set()).add(item)
    table = np.full((len(seen), size), -1, np.int64)
    for k, w in enumerate(seen):
        table[k, : len(w)] = w
    owners = [sorted(x for x in v if x is not None) for v in seen.values()]
    return dict(terms), table, np.array([len(w) for w in seen], np.int64), owners


def phrase_matches(
    index: DataFrame,
    items: DataFrame,
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    max_block_words: int = 500_000,
    placed: bool = False,
) -> DataFrame:
    """Every indexed row with its exact phrase matches: id, n_words, n_hit (words inside any
    occurrence of a window of `window` consecutive item words; a shorter item is one window),
    items (ids as strings, sorted), spans (hit word ranges, end exclusive, merged); placed: with its
    segment and ordinal, which tell rows of one id apart."""
    place = ["segment", "ordinal"] if placed else []
    spark = index.sparkSession
    id_type = index.schema["ids"].dataType.elementType
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(
        [
            T.StructField("segment", T.StringType()),
            T.StructField("ordinal", T.IntegerType()),
            T.StructField("id", id_type),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("spans", span),
        ]
    )

    def search(sent):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            form = to_arrow_schema(schema)
            terms, table, sizes, owners = sent.value
            for batch in batches:
                for row in batch.to_pylist():
                    seg = _Segment(row, terms)
                    w, s = seg.phrases(table)
                    edge = np.zeros(seg.size + 1, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + sizes[w], -1)
                    hit = np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8), [0]))[: seg.size + 2]
                    total = np.concatenate(([0], np.cumsum(hit[1:])))
                    n_hit = total[seg.starts + seg.lengths] - total[seg.starts]
                    turn = np.diff(hit)
                    begins, ends = np.flatnonzero(turn > 0), np.flatnonzero(turn < 0)
                    items: list[set] = [()] * len(seg.ids)
                    spans: list[list] = [[]] * len(seg.ids)
                    pairs = np.unique(seg.doc_of(s) * max(1, len(sizes)) + w)
                    for d, k in zip((pairs // max(1, len(sizes))).tolist(), (pairs % max(1, len(sizes))).tolist(), strict=True):
                        items[d] = {*items[d], *owners[k]} if len(owners[k]) > 1 or not items[d] else items[d] | {*owners[k]}
                    for d, a, b in zip(seg.doc_of(begins).tolist(), begins.tolist(), ends.tolist(), strict=True):
                        at = int(seg.starts[d])
                        spans[d] = [*spans[d], {"start": a - at, "end": b - at}]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["segment"]] * len(seg.ids), form.field(0).type),
                            pa.array(np.arange(len(seg.ids)), form.field(1).type),
                            pa.array(seg.ids, form.field(2).type),
                            pa.array(seg.lengths, form.field(3).type),
                            pa.array(n_hit, form.field(4).type),
                            pa.array([sorted(x) for x in items], form.field(5).type),
                            pa.array(spans, form.field(6).type),
                        ],
                        schema=form,
                    )

        return run

    parts = [
        index.mapInArrow(search(spark.sparkContext.broadcast(_windows(block, window))), schema)
        for block in _blocks(items, item_id, item_text, max_block_words)
    ]
    if len(parts) == 1:
        return parts[0] if placed else parts[0].drop("segment", "ordinal")
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    merged = F.expr(
        "aggregate(array_sort(flatten(collect_list(spans))), cast(array() as array<struct<start: bigint, end: bigint>>), (a, x) -> "
        "if(size(a) > 0 and element_at(a, -1).end >= x.start, "
        "concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).end, x.end) as end))), "
        "concat(a, array(x))))"
    )
    return (
        both.groupBy("segment", "ordinal")
        .agg(
            F.first("id").alias("id"),
            F.max("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            merged.alias("spans"),
        )
        .select(*place, "id", "n_words", F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)").alias("n_hit"), "items", "spans")
    )


def proximity_matches(
    index: DataFrame,
    items: DataFrame,
    within: int,
    item_id: str = "item_id",
    item_text: str = "text",
    max_block_words: int = 500_000,
) -> DataFrame:
    """Rows (segment, ordinal, id, item, start, end): all minimal spans of at most `within` words of a document
    that hold every distinct word of an item; those of one item may overlap, none holds another. segment and
    ordinal tell documents of one id apart. Items that repeat count once."""
    spark = index.sparkSession
    id_type = index.schema["ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("segment", T.StringType()),
            T.StructField("ordinal", T.IntegerType()),
            T.StructField("id", id_type),
            T.StructField("item", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )

    def search(sent):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            form = to_arrow_schema(schema)
            terms, queries = sent.value
            for batch in batches:
                for row in batch.to_pylist():
                    seg = _Segment(row, terms)
                    out = [
                        {"segment": row["segment"], "ordinal": d, "id": seg.ids[d], "item": item, "start": a, "end": b}
                        for item, own in queries
                        for d, a, b in zip(*(x.tolist() for x in seg.proximity(own, within)), strict=True)
                    ]
                    yield pa.RecordBatch.from_pylist(out, schema=form)

        return run

    out = None
    for block in _blocks(items, item_id, item_text, max_block_words):
        terms = _Intern()
        queries = [(item, sorted({terms[w] for w in own})) for item, own in block if own]
        part = index.mapInArrow(search(spark.sparkContext.broadcast((dict(terms), queries))), schema)
        out = part if out is None else out.unionByName(part)
    return out


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", within: int | None = None, **options
) -> DataFrame:
    """phrase_matches() of all docs, with the contaminated flag: some words hit, and they are at
    least a twentieth of the document's words. With `within` also n_near, the document's proximity_matches()
    within so many words."""
    index = build_index(docs, id_col, text_col)
    found = phrase_matches(index, items, placed=within is not None, **options)
    if within is not None:
        near = proximity_matches(index, items, within).groupBy("segment", "ordinal").agg(F.count("*").alias("n_near"))
        found = found.join(near, ["segment", "ordinal"], "left").fillna(0, ["n_near"]).drop("segment", "ordinal")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).withColumnRenamed(
        "id", id_col
    )
