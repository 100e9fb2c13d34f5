"""Sharding by longest-processing-time scheduling of groups that must stay together.

Rows with equal texts form a group, whose size is that of its rows. Groups of one size are alike, so the
schedule needs how many groups there are of each size, and nothing else: from the largest size down, the
groups of a size go one by one to the least-loaded shard, by a heap once each shard has what it gets in
any case. The counts are one row a size on the driver, and sizes are few by arithmetic (their sum is at
most that of all groups, so n distinct ones take n * n / 2 bytes at least). Which groups of a size go
where is by their place in the order of digests, which is counted over ranges of the whole table.

Slots number the rows of a shard without gaps: rows are dealt into bounded chunks within their
shard by a stored row number, numbered there, and moved up by the rows of earlier chunks.

Nulls, empties: a null text has no bytes and forms a group with other null texts, apart from empty
texts. Null ids and repeated rows are kept. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomfield.llm.common import materialize
from loomfield.operators.ranking import numbered


def certain(loads: np.ndarray, size: int, count: int) -> np.ndarray:
    """Items of one size that each shard gets in any case when count of them go to the least-loaded shard
    one by one: those that leave it two sizes under the level to which count items fill the shards."""
    order = np.sort(loads)
    level = (np.cumsum(order) + count * size) // np.arange(1, len(order) + 1)
    over = np.flatnonzero(level[:-1] <= order[1:])
    level = int(level[over[0]] if over.size else level[-1])
    return np.maximum(0, (level - loads) // size - 1)


def longest_first(sizes: list[tuple[int, int]], shards: int) -> np.ndarray:
    """counts[k, shard] for sizes (size, count): items by falling size, each to the shard with the least
    load (ties: the lower shard). Sizes are positive and come in falling order."""
    loads = np.zeros(shards, np.int64)
    out = np.zeros((len(sizes), shards), np.int64)
    for k, (size, count) in enumerate(sizes):
        if count > 4 * shards:
            out[k] = certain(loads, size, count)
            loads += size * out[k]
            count -= int(out[k].sum())
        heap = [(x, s) for s, x in enumerate(loads.tolist())]
        heapq.heapify(heap)
        for _ in range(count):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))
            out[k, shard] += 1
            loads[shard] += size
    return out


def shard_groups(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, chunk_rows: int = 20_000
) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) for every row; equal texts share a shard, and two shards'
    loads differ by at most the last group that the fuller one got."""
    if overhead < 1:
        raise ValueError(f"overhead is {overhead}; rows need a positive size")
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("digest"),
    )
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("load"), F.count("*").alias("n")), "groups")
    listed = groups.groupBy("load").agg(F.count("*").alias("groups"), F.sum("n").alias("n")).toArrow()
    listed = listed.sort_by([("load", "descending")])
    n = sum(listed["n"].to_pylist())
    upto = np.cumsum(longest_first(list(zip(listed["load"].to_pylist(), listed["groups"].to_pylist(), strict=True)), shards), axis=1)
    upto = pa.ListArray.from_arrays(np.arange(0, upto.size + 1, shards, dtype=np.int32), upto.ravel())
    plan = spark.createDataFrame(pa.table({"load": listed["load"].combine_chunks().cast(pa.int64()), "upto": upto}), "load long, upto array<long>")
    # Ranges of places in the order of digests, shard by shard.
    shard = F.size(F.filter("upto", lambda x: x < F.col("place"))).alias("shard")
    named = numbered(groups.select("digest", "load"), [F.col("digest")], "place", ["load"]).join(plan, "load").select("digest", shard)
    placed = rows.join(named, "digest").select(
        "row", "id", "size", "crc", "shard", F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n // chunk_rows)))).alias("chunk")
    )
    placed = materialize(placed, "placed")
    within = F.row_number().over(W.partitionBy("shard", "chunk").orderBy("row")) - 1
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    base = counts.select(
        "shard",
        "chunk",
        (F.sum("n").over(W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"),
    )
    return (
        placed.withColumn("within", within)
        .join(base, ["shard", "chunk"])
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            "shard",
            (F.col("base") + F.col("within")).cast("long").alias("slot"),
        )
    )
