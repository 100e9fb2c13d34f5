"""Exact top-k search by distributed histogram selection.

Vectors are quantised to integers, so a score is an integer inner product. Queries and candidates
are packed into blocks of bounded size, and every pair of a query block and a candidate block is
scored in some task. No score is kept: a round scores all pairs and counts each query's scores in
the bins of its current interval; from the summed histogram follows the bin that holds the query's
kth highest score, which is the next round's interval, until it is one score wide. A last pass
filters by the kth value; the scores above it, and the ties at it with the smallest ids, are the
result. Of its histogram a task sends only the bins that hold its k highest scores, since no lower
one can hold the kth highest of all.

Blocks are dealt over a grid of (query group, candidate group), each side repeated for the groups of
the other. The grid has a few cells for each task that runs at once, so a side is repeated about as
often as the root of their number, and more cells only where one would hold over 256 blocks of a side.

Scores are exact for all finite vectors: a pair of blocks is multiplied in doubles while no sum can pass
2**53, else in 64-bit integers. Vectors too long for these (norm over 2**29) are packed apart, as they are;
their pairs are scored in Python's integers, and each block keeps its k best of a query, which join the
histograms' results in one order. Scores beyond 64 bits are ranked exactly and given as the nearest long.

Nulls, empties: rows whose id or vector is null, or whose vector holds a null or non-finite
component, take no part. Only vectors of one length score against each other. A row with a query's
id is the query's own and no candidate; query rows that repeat an id count once (the least vector).
Equal candidate rows each take a place. Fewer than k candidates give as many rows. Empty tables give
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomfield.llm.common import materialize
from loomfield.operators.search import grid_shape

_BLOCKS = "dim int, wide boolean, ids binary, vectors binary, reach double"


def finite(vector: Column) -> Column:
    """vector in doubles; null if a component is null or not finite."""
    x = vector.cast("array<double>")
    return F.when(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), x)


def is_wide(vector: Column, scale: int) -> Column:
    """Whether integer sums over products with a vector of this length may not fit 64 bits."""
    return F.aggregate(vector, F.lit(0.0), lambda a, v: a + (v * scale) * (v * scale)) > float(1 << 58)


def exact(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in Python's integers; doubles from 2**53 on are whole numbers."""
    return np.array([int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale) for v in values.ravel().tolist()], object).reshape(values.shape)


def score_order(digits: Column) -> Column:
    """Strings in the order of the integers that digits write out in decimal."""
    own = F.ltrim(digits, F.lit("-"))
    size = F.length(own)
    up = F.concat(F.lit("1"), F.lpad(size.cast("string"), 5, "0"), own)
    down = F.concat(F.lit("0"), F.lpad((99999 - size).cast("string"), 5, "0"), F.translate(own, "0123456789", "9876543210"))
    return F.when(digits.startswith("-"), down).otherwise(up)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """rows(id, wide, vector) as blocks of up to size vectors of one kind and length: ids and vectors as
    bytes, reach the longest vector's norm."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list] = {}

        def block(kind: tuple[int, bool]) -> pa.RecordBatch:
            ids, vectors = zip(*held.pop(kind), strict=True)
            v = np.array(vectors).reshape(len(ids), kind[0])
            reach = float("inf") if kind[1] else float(np.sqrt((v * v).sum(axis=1)).max(initial=0))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([kind[0]], pa.int32()),
                    pa.array([kind[1]]),
                    pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                    pa.array([v.astype("<f8").tobytes()], pa.binary()),
                    pa.array([reach]),
                ],
                names=["dim", "wide", "ids", "vectors", "reach"],
            )

        for batch in batches:
            values, offsets = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
            for key, wide, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = held.setdefault((b - a, wide), [])
                own.append((key, values[a:b]))
                if len(own) == size:
                    yield block((b - a, wide))
        for kind in list(held):
            yield block(kind)

    return rows.select("id", "wide", "vector").mapInArrow(pack, _BLOCKS)


def exact_topk(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    bins: int = 1024,
    query_block: int = 512,
    candidate_block: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer scores, ties to smaller ids."""
    whole = lambda v: F.transform(v, lambda x: F.floor(x * scale).cast("double"))
    clean = lambda df: (
        df.select(F.col(id_col).cast("long").alias("id"), finite(F.col(vector_col)).alias("vector"))
        .filter("id IS NOT NULL AND vector IS NOT NULL")
        .withColumn("wide", is_wide(F.col("vector"), scale))
    )
    stored = lambda df: df.withColumn("vector", F.when(F.col("wide"), F.col("vector")).otherwise(whole(F.col("vector"))))
    asked = clean(queries).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("wide", is_wide(F.col("vector"), scale))
    asked = materialize(stored(asked), "queries")
    n_queries = asked.count()
    left = materialize(_packed(asked.repartition(max(1, -(-n_queries // query_block)), "id"), query_block), "query-blocks")
    right = materialize(_packed(stored(clean(candidates)), candidate_block), "candidate-blocks")
    told = lambda df: df.agg(F.count("*"), F.max(F.when(~F.col("wide"), F.col("reach"))), F.max("wide")).first()
    (n_left, left_reach, left_wide), (n_right, right_reach, right_wide) = told(left), told(right)
    reach = (left_reach or 0.0) * (right_reach or 0.0)
    # One row of work for each pair of a query block and a candidate block.
    number = lambda df, name: df.withColumn(name, F.monotonically_increasing_id())
    left = materialize(number(left, "qb"), "query-blocks")
    right = materialize(number(right, "cb"), "candidate-blocks")
    rows, cols = grid_shape(n_left, n_right, asked.sparkSession.sparkContext.defaultParallelism)
    grid = lambda df, own, n, m, names: df.withColumn(names[0], F.pmod(F.xxhash64(own), F.lit(n))).withColumn(
        names[1], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    )
    a = grid(left, "qb", rows, cols, ("gq", "gc")).select("gq", "gc", "dim", F.struct("qb", "ids", "vectors", "reach", "wide").alias("q"))
    b = grid(right, "cb", cols, rows, ("gc", "gq")).select("gq", "gc", "dim", F.struct("ids", "vectors", "reach", "wide").alias("c"))
    plain_a, plain_b = a.filter("NOT q.wide"), b.filter("NOT c.wide")

    def work(limits: DataFrame | None) -> DataFrame:
        """Pairs of blocks, with the interval of each query's kth score: qids, lo, width as arrays."""
        if limits is None:
            none = F.lit(None).cast("array<struct<query_id: bigint, lo: bigint, width: bigint, need: bigint>>")
            return plain_a.select("*", none.alias("lim")).join(plain_b, ["gq", "gc", "dim"])
        per = limits.groupBy("qb").agg(F.collect_list(F.struct("query_id", "lo", "width", "need")).alias("lim"))
        return plain_a.withColumn("qb", F.col("q.qb")).join(per, "qb").drop("qb").join(plain_b, ["gq", "gc", "dim"])

    low, span = -int(reach) - 2, 2 * int(reach) + 5

    def opened(row: dict):
        """Ids and vectors of both blocks of a row, and the limits of its queries in block order."""
        qid, cid = (np.frombuffer(row[s]["ids"], "<i8") for s in "qc")
        q, c = (np.frombuffer(row[s]["vectors"], "<f8").reshape(len(i), -1) for s, i in (("q", qid), ("c", cid)))
        if row["q"]["reach"] * row["c"]["reach"] < 2.0**52:
            score = np.rint(q @ c.T).astype(np.int64)
        else:
            score = q.astype(np.int64) @ c.T.astype(np.int64)
        own = qid[:, None] == cid[None, :]
        lo, width, need = np.full(len(qid), low), np.full(len(qid), span), np.full(len(qid), k)
        if row["lim"] is not None:
            told = {x["query_id"]: x for x in row["lim"]}
            take = lambda name, rest: np.array([told[x][name] if x in told else rest for x in qid.tolist()], np.int64)
            lo, width, need = take("lo", 0), take("width", 0), take("need", 0)
        return qid, cid, score, own, lo, width, need

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qid, _, score, own, lo, width, need = opened(row)
                step = np.maximum(1, -(-width // bins))
                at = (score - lo[:, None]) // step[:, None]
                at = np.where(own | (score < lo[:, None]) | (score >= (lo + width)[:, None]), -1, at)
                # The need highest scores of a query in this block; lower bins cannot hold its kth.
                most = min(at.shape[1], max(1, int(need.max(initial=1))))
                top = -np.sort(np.partition(-at, most - 1, axis=1)[:, :most], axis=1)
                keep = (top >= 0) & (np.arange(top.shape[1])[None, :] < need[:, None])
                query = np.broadcast_to(np.arange(len(qid))[:, None], top.shape)[keep]
                pairs, n = np.unique(query * bins + top[keep], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(pairs), row["q"]["qb"], np.int64)),
                        pa.array(qid[pairs // bins]),
                        pa.array((lo + 0)[pairs // bins]),
                        pa.array(step[pairs // bins]),
                        pa.array(pairs % bins),
                        pa.array(n),
                        pa.array(need[pairs // bins]),
                    ],
                    names=["qb", "query_id", "lo", "step", "bin", "n", "need"],
                )

    limits, width = None, span
    while width > 1:
        histogram = (
            work(limits)
            .mapInArrow(count, "qb long, query_id long, lo long, step long, bin long, n long, need long")
            .groupBy("qb", "query_id", "lo", "step", "need", "bin")
            .agg(F.sum("n").alias("n"))
        )
        above = W.partitionBy("qb", "query_id").orderBy(F.col("bin").desc())
        upto = F.sum("n").over(above.rowsBetween(W.unboundedPreceding, 0))
        last = F.lead("bin").over(above).isNull()
        # The bin with the kth highest score, or the lowest one if there are fewer scores.
        hit = (
            histogram.withColumn("upto", upto)
            .withColumn("last", last)
            .filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")) | F.col("last") & (F.col("upto") < F.col("need")))
        )
        limits = materialize(
            hit.select(
                "qb",
                "query_id",
                (F.col("lo") + F.col("bin") * F.col("step")).alias("lo"),
                F.col("step").alias("width"),
                (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"),
            ),
            "limits",
        )
        width = -(-width // bins)

    def above_limit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qid, cid, score, own, lo, width, need = opened(row)
                fine = ~own & (width > 0)[:, None]
                i, j = np.nonzero(fine & (score > lo[:, None]))
                # Of the ties at the kth value, the smallest ids that may still be needed.
                tie = fine & (score == lo[:, None])
                order = np.argsort(cid, kind="stable")
                place = np.empty(tie.shape, np.int64)
                place[:, order] = np.cumsum(tie[:, order], axis=1)
                ti, tj = np.nonzero(tie & (place <= need[:, None]))
                i, j = np.concatenate([i, ti]), np.concatenate([j, tj])
                yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(cid[j]), pa.array(score[i, j])], names=["query_id", "vec_id", "score"])

    found = work(limits).mapInArrow(above_limit, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    if left_wide or right_wide:

        def integers(side: dict, n: int) -> np.ndarray:
            values = np.frombuffer(side["vectors"], "<f8").reshape(n, -1)
            return exact(values, scale) if side["wide"] else values.astype(np.int64).astype(object)

        def best_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    qid, cid = (np.frombuffer(row[s]["ids"], "<i8").tolist() for s in "qc")
                    score = integers(row["q"], len(qid)) @ integers(row["c"], len(cid)).T
                    for i, own in zip(qid, score.tolist(), strict=True):
                        top = heapq.nsmallest(k, ((-x, j) for x, j in zip(own, cid, strict=True) if i != j))
                        out += [(i, j, str(-x)) for x, j in top]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "digits"])

        pairs = a.filter("q.wide").join(b, ["gq", "gc", "dim"]).unionByName(plain_a.join(b.filter("c.wide"), ["gq", "gc", "dim"]))
        far = pairs.select("q", "c").mapInArrow(best_of, "query_id long, vec_id long, digits string")
        both = found.select("query_id", "vec_id", F.col("score").cast("string").alias("digits")).union(far)
        edge = F.when(F.col("digits").startswith("-"), F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1))
        found = both.select("query_id", "vec_id", F.coalesce(F.expr("try_cast(digits AS bigint)"), edge).alias("score"), score_order(F.col("digits")).alias("place"))
        best = W.partitionBy("query_id").orderBy(F.col("place").desc(), "vec_id")
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
