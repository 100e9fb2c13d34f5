"""Best-fit packing of whole documents into token sequences, certified by bin-count bounds.

Documents are tokenized once into a stored table of pieces. Pieces are dealt into partitions of
bounded size by a hash of their key, and each partition is packed best-fit decreasing. Dual-feasible
functions bound the bins that a partition needs from below; a partition that meets its bound is done.
The others exchange the documents of their bins that are not full: whole bins are dealt over partitions by a
new hash of their number, so that each is released and packed again in one place, and a repacking is
kept if it takes fewer bins than came in. A bin settles when it is full, when its partition meets its
bound, or after `patience` rounds in a row that saved nothing in its partition. Rounds that save end, as bins
do. certificate() holds the outcome against the bound of the whole table.

Nulls, empties: a null text is an empty one, which is its end-of-document id alone. Null ids and
repeated rows are kept, each row packed by itself. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.llm.common import materialize


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 1,
    texts_at_once: int = 256,
) -> DataFrame:
    """Stored pieces (key, id, piece, start, length, ids): ids are little-endian unsigned 32-bit."""
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomfield.llm.tokens import held
        from pyspark.sql.pandas.types import to_arrow_schema

        form, tokenizer = to_arrow_schema(schema), held(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(at, texts_at_once)
                rows: list[tuple] = []
                for key, ids in zip(
                    part.column(0).to_pylist(), tokenizer.encode([x or "" for x in part.column(1).to_pylist()]), strict=True
                ):
                    ids += end
                    for k in range(-(-len(ids) // (4 * capacity))):
                        own = ids[4 * capacity * k : 4 * capacity * (k + 1)]
                        rows.append((key, k, capacity * k, len(own) // 4, own))
                columns = [pa.array(c, form.field(i).type) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=form)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return materialize(rows.withColumn("key", F.monotonically_increasing_id()), "pieces")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the count of bins. Longest first, ties in the given order,
    each into the fullest bin that has room."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # rooms: bit r is set if some bin has room r
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, n


def lower_bound(count: np.ndarray, depth: int = 32) -> int:
    """The largest bound on the bins that count[size] pieces of each size need (the last size is the
    capacity) which these dual-feasible functions give: the identity, the staircase functions for k up to
    depth, and the threshold functions for every threshold."""
    capacity = len(count) - 1
    size = np.arange(capacity + 1)
    total = int((count * size).sum())
    best = -(-total // capacity)
    for k in range(1, depth + 1):
        steps, whole = divmod((k + 1) * size, capacity)
        exact = whole == 0
        a, b = int((count * steps)[~exact].sum()), int((count * size)[exact].sum())
        best = max(best, -(-(a * capacity + b * k) // (k * capacity)))
    # Threshold t: sizes over capacity - t count whole, sizes under t count nothing.
    mass, number = np.cumsum(count * size), np.cumsum(count)
    t = np.arange(1, capacity // 2 + 1)
    middle = mass[capacity - t] - mass[t - 1]
    large = number[capacity] - number[capacity - t]
    if len(t):
        best = max(best, int((large + -(-middle // capacity)).max()))
    return int(best)


_ASSIGNED = "key long, length long, sequence_id long, offset long, open boolean, tries int"


def _packer(capacity: int, level: int, patience: int):
    """Packs a partition's pieces. At level 0 they are new; later they make up whole sequences, which are
    replaced all together or stay as they are."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        sequence, tries = (level << 44) + (int(key[0]) << 20) + bins, np.zeros(len(rows), np.int32)
        if level and n >= (before := rows["sequence_id"].nunique()):
            sequence, offsets, n = rows["sequence_id"].to_numpy(), rows["offset"].to_numpy(), before
            tries = rows["tries"].to_numpy(np.int32) + 1
        gap = n > lower_bound(np.bincount(lengths, minlength=capacity + 1).astype(np.int64))
        fill = rows["length"].groupby(sequence).transform("sum").to_numpy()
        go_on = (fill < capacity) & gap & (tries < patience)
        return pd.DataFrame({"key": rows["key"], "length": lengths, "sequence_id": sequence, "offset": offsets, "open": go_on, "tries": tries})

    return pack


def pack(pieces: DataFrame, capacity: int = 4096, partition_pieces: int = 20_000, patience: int = 3) -> DataFrame:
    """(key, sequence_id, offset) for pieces(key, length), lengths from 1 to capacity."""
    own = pieces.select("key", "length")
    parts = lambda n: max(1, -(-n // partition_pieces))
    dealt = lambda df, by, n, level: df.withColumn("part", F.pmod(F.xxhash64(by, F.lit(level)), F.lit(n)))
    fixed = parts(own.count())
    now = materialize(dealt(own, "key", fixed, 0).groupBy("part").applyInPandas(_packer(capacity, 0, patience), _ASSIGNED), "packed")
    settled, level = [], 0
    while fixed > 1:  # one partition has nothing to exchange with
        loose = now.filter("open")
        if not (n := loose.count()):
            break
        level, fixed = level + 1, parts(n)
        settled.append(now.filter("NOT open"))
        again = dealt(loose.drop("open"), "sequence_id", fixed, level).groupBy("part")
        now = materialize(again.applyInPandas(_packer(capacity, level, patience), _ASSIGNED), "packed")
    out = now
    for done in settled:
        out = out.unionByName(done)
    return out.select("key", "sequence_id", "offset")


def certificate(packed: DataFrame, capacity: int = 4096) -> tuple[int, int]:
    """Sequences that packed(sequence_id, length) takes, and the bound that no packing of all its pieces can
    undercut; one row for each length, of which there are capacity at most, comes to the driver."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in packed.groupBy("length").count().collect():
        count[length] = n
    return packed.select("sequence_id").distinct().count(), lower_bound(count)


def placed(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces(key, length, ...) with sequence_id and offset in place of the key; the other columns
    are carried through the join, so leave out what is not wanted."""
    return pieces.join(pack(pieces, capacity), "key").drop("key")


def packed_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096
) -> DataFrame:
    """Every piece of every row with its ids and its place: id, piece, start, length, ids,
    sequence_id, offset. Sorting a sequence's pieces by offset gives the sequence without gaps."""
    return placed(token_pieces(docs, tokenizer_path, id_col, text_col, capacity), capacity)
