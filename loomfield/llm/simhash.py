"""SimHash near-duplicates with multi-index hashing.

Fingerprints: 64 bits, each set if it is set in over half of the XXH64 hashes (seed 42) of a text's
word shingles. Two fingerprints link at `radius` or fewer differing bits.

Links are found among distinct fingerprints (copies of one are linked at distance zero and never
expanded). A fingerprint is cut into m segments. Two fingerprints within r = s*m + a bits differ in
at most s bits of one of the first a + 1 segments, or in at most s - 1 bits of a later one; so each
fingerprint is filed in m tables under its segment values, and is looked up under every value of the
small Hamming ball of that radius around each of them. m follows the count of fingerprints, so that a
table key stays about as selective as the fingerprints are many. Matches are verified on all bits.

A table key shared by many fingerprints is cut into a grid of bounded cells (rows by left fragment,
columns by right fragment), so no task has to hold it, and a cell gives back the edges of a spanning
forest of its links instead of all of them. Components are then closed over these edges.

Nulls, empties: a text that is null or without words has fingerprint zero and links like any other.
Null ids are kept, and are never a component id unless the whole group has none. Repeated rows are
returned each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfield.llm.common import materialize
from loomfield.operators.graph import connected_components
from loomfield.operators.ranking import with_least

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Row v holds the bits of byte v, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles, repeats included."""
    own = text.translate(_LOWER).split() if text else []
    if not own:
        return np.empty(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(own)
    if len(own) <= size:
        return np.array([digest(joined, 42)], np.uint64)
    length = np.fromiter(map(len, own), np.int64, len(own))
    start = np.cumsum(length + 1) - length - 1
    end = (start + length)[size - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(start.tolist(), end, strict=False)), np.uint64, len(end))


def fingerprint(text: bytes | None, size: int = 4) -> int:
    """The SimHash of a text, unsigned."""
    h = shingle_hashes(text, size)
    if not h.size:
        return 0
    parts = h.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + 256 * np.arange(8)
    counts = (np.bincount(parts.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return sum(1 << k for k in np.flatnonzero(2 * counts > h.size).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit integer."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), size) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def segments(n: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of each segment, for n fingerprints: widths near the bits of n."""
    m = min(8, max(2, round(bits / math.log2(max(n, 4)))))
    edges = [bits * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Label of each of n nodes: the least node of its component under links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _cell_links(left: np.ndarray, right: np.ndarray, radius: int, at_once: int = 1 << 21) -> list[np.ndarray]:
    """Spanning edges of the links between left and right fingerprints of one cell."""
    found = []
    step = max(1, at_once // max(1, len(right)))
    for k in range(0, len(left), step):
        near = np.bitwise_count(left[k : k + step, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        found.append(np.stack([left[k + i], right[j]]))
    pairs = np.concatenate(found, axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    if not pairs.size:
        return []
    nodes, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(2, -1)
    label = _spanning(at[0], at[1], len(nodes))
    off = np.flatnonzero(label != np.arange(len(nodes)))
    return [np.stack([nodes[off], nodes[label[off]]])]


def _run_links(run: np.ndarray, role: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """Spanning edges of all cells of a sorted stretch. run: the cell of each row; role: 1 left, 2 right, 3 both."""
    begin = np.flatnonzero(np.diff(run, prepend=run[0] - 1))
    n = np.diff(np.append(begin, len(run)))
    out = []
    small = n <= 64
    # Cells of up to 64 rows, all at once by the distance k between their rows.
    alone = np.repeat(small, n)
    for k in range(1, int(n[small].max(initial=1))):
        i = np.flatnonzero((run[:-k] == run[k:]) & alone[:-k])
        a, b = role[i], role[i + k]
        ok = ((a & 1) & (b >> 1)) | ((a >> 1) & (b & 1))
        i = i[ok.astype(bool)]
        x, y = fp[i], fp[i + k]
        near = (np.bitwise_count(x ^ y) <= radius) & (x != y)
        if near.any():
            out.append(np.stack([x[near], y[near]]))
    for at, size in zip(begin[~small].tolist(), n[~small].tolist(), strict=True):
        r, f = role[at : at + size], fp[at : at + size]
        left, right = f[(r & 1) > 0], f[(r & 2) > 0]
        if left.size and right.size:
            out += _cell_links(left, right, radius)
    return np.concatenate(out, axis=1) if out else np.empty((2, 0), np.uint64)


def _each(flips, own, tagged):
    return F.transform(flips, lambda x: tagged(own.bitwiseXOR(x), 2))


def links(points: DataFrame, radius: int = 4, max_fragment: int = 2048, n: int | None = None) -> DataFrame:
    """(a, b): edges that connect every two of the distinct fingerprints in points(fp) which a path
    of links connects; every edge is a link or a short path of links."""
    cut = segments(points.count() if n is None else n)
    s, a = divmod(radius, len(cut))
    filed = []
    for k, (shift, width) in enumerate(cut):
        reach = s if k <= a else s - 1
        if reach < 0:
            continue
        mask = (1 << width) - 1
        own = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask))
        ball = [sum(1 << b for b in bits) for d in range(1, reach + 1) for bits in combinations(range(width), d)]
        tagged = lambda key, role, k=k: F.struct(
            F.lit(k).cast("byte").alias("seg"), key.alias("key"), F.lit(role).cast("byte").alias("role")
        )
        table = F.array(tagged(own, 3))
        if ball:
            flips = F.array(*[F.lit(x).cast("long") for x in ball])
            table = F.concat(table, _each(flips, own, tagged))
        filed.append(table)
    probes = points.select("fp", F.explode(F.concat(*filed)).alias("p")).select("fp", "p.seg", "p.key", "p.role")
    # Keys with more rows than a fragment holds, by rows to look up and rows filed.
    sizes = (
        probes.groupBy("seg", "key")
        .agg(F.count("*").alias("n_right"), F.count(F.when(F.col("role") == 3, 1)).alias("n_left"))
        .filter((F.col("n_left") > 0) & (F.col("n_right") > max_fragment))
        .select(
            "seg",
            "key",
            F.ceil(F.col("n_left") / max_fragment).cast("int").alias("rows"),
            F.ceil(F.col("n_right") / max_fragment).cast("int").alias("cols"),
        )
    )
    sizes = materialize(sizes, "hot-keys")
    n_hot = sizes.count()
    if n_hot:
        # Broadcast only while the list is small; past that a shuffle join, which AQE can split.
        small = F.broadcast(sizes) if n_hot <= 50_000 else sizes
        probes = probes.join(small, ["seg", "key"], "left")
        i = F.pmod(F.xxhash64("fp"), F.col("rows")).cast("int")
        j = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("cols")).cast("int")
        cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.cast("byte").alias("role"))
        rights = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda x: cell(x, j, F.lit(2)))
        lefts = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda x: cell(i, x, F.lit(1)))
        cells = (
            F.when(F.col("rows").isNull(), F.array(cell(F.lit(0), F.lit(0), F.col("role"))))
            .when(F.col("role") == 3, F.concat(rights, lefts))
            .otherwise(rights)
        )
        probes = probes.select("seg", "key", "fp", F.explode(cells).alias("c")).select("seg", "key", "c.i", "c.j", "c.role", "fp")
    else:
        probes = probes.select("seg", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), "role", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["a", "b"], None

        def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
            new = np.zeros(len(cols[0]), bool)
            new[0] = True
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            e = _run_links(np.cumsum(new), cols[4], cols[5].view(np.uint64), radius).view(np.int64)
            e = np.unique(np.stack([e.max(axis=0), e.min(axis=0)]), axis=1) if e.size else e
            return pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], names=names)

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            other = np.zeros(len(cols[0]), bool)
            for c in cols[:4]:
                other |= c != c[-1]
            done = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if done:
                yield solve([c[:done] for c in cols])
            held = [c[done:] for c in cols]
        if held is not None and len(held[0]):
            yield solve(held)

    return (
        probes.repartition("seg", "key", "i", "j")
        .sortWithinPartitions("seg", "key", "i", "j")
        .mapInArrow(run, "a long, b long")
        .distinct()
    )


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4
) -> DataFrame:
    """Every row: id_col, fingerprint (16 hex digits), component_id (the least id of its group)."""
    own = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    points = materialize(own.groupBy("fp").agg(F.min("id").alias("first")), "points")
    roots = connected_components(links(points.select("fp"), radius))
    grouped = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    grouped = materialize(grouped, "groups")
    named = materialize(with_least(grouped, "root", "first", "component_id", "fp").select("fp", "component_id"), "components")
    return own.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
