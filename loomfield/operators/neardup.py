"""Exact-complete near-duplicate joins over binary fingerprints, and exact duplicates by content.

A fingerprint is cut into equal blocks. Within a radius r over m blocks, two fingerprints differ by
at most r // m bits in some block, so probing every block value within that distance of a block finds
all pairs. representatives() takes copies out first: pairs are then sought between kinds, and copies
follow by membership: a table of their own, or rows beside the pairs (with_members()).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.operators.ranking import with_least
from loomfield.storage import stored


def neighbours(width: int, radius: int) -> list[int]:
    """All masks of up to radius of width bits."""
    return [sum(1 << b for b in bits) for d in range(radius + 1) for bits in combinations(range(width), d)]


def _cells(n: int, words: int, width: int, cell_rows: int, slots: int) -> int:
    """Leading bits of a block by which fingerprints are dealt: cells of about cell_rows, and a few for each task."""
    most = max(-(-n // cell_rows), -(-4 * slots // words), 1)
    return min(width, (most - 1).bit_length())


def representatives(fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fingerprints(id, orientations) of each kind once, under its least id, and (representative,
    member) of all, where one kind may hold most rows."""
    kinds = fingerprints.groupBy("orientations").agg(F.min("id").alias("representative"))
    dealt = with_least(fingerprints.select("id", "orientations"), "orientations", "id", "representative", "id")
    members = dealt.select("representative", F.col("id").alias("member"))
    return kinds.select(F.col("representative").alias("id"), "orientations"), members


def with_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """near_pairs() of kinds, and (representative, member) of all as pairs at distance 0, marked by same_kind: such a
    right_id has the fingerprints of left_id, and so all its other pairs. No link is left out, and copies are not
    expanded: rows grow with members."""
    o = pairs.schema["left_o"].dataType.simpleString()
    at = F.lit(0).cast(o)  # copies are alike in every orientation
    own = members.filter("representative <> member").select(
        F.col("representative").alias("left_id"), F.col("member").alias("right_id"), F.lit(0).alias("distance"), at.alias("left_o"), at.alias("right_o"), F.lit(True).alias("same_kind")
    )
    return pairs.withColumn("same_kind", F.lit(False)).select(own.columns).union(own)


def near_pairs(fingerprints: DataFrame, words: int, radius: int, width: int = 16, max_fragment: int = 131_072) -> DataFrame:
    """fingerprints(id, orientations array<struct<o, words array<long>>>): `words` blocks of `width`
    bits in each orientation. Returns (left_id, right_id, distance, left_o, right_o), left_id <
    right_id: pairs within radius, the least distance over orientations, and its least witness.
    Fingerprints are dealt by the leading bits of each block, as many as make cells of about max_fragment, and
    sent to the cells within the block's radius; the other bits are probed where they have arrived (_met). So a block
    costs a row for each cell in reach, not one for each value. A cell that holds more is cut into fragments of about
    max_fragment, which what probes it meets one by one."""
    spark, own, per = fingerprints.sparkSession, radius // words, 64 // width
    f = lambda k: F.shiftleft(F.element_at("f.words", k + 1), width * (k % per))
    lanes = [reduce(lambda x, y: x.bitwiseOR(y), [f(k) for k in range(i, min(words, i + per))]).alias(f"w{i // per}") for i in range(0, words, per)]
    long = stored(fingerprints.select("id", F.explode("orientations").alias("f")).select("id", "f.o", *lanes), "fingerprints")
    top = _cells(long.count(), words, width, max_fragment, spark.sparkContext.defaultParallelism)
    low = width - top
    value = lambda k: F.shiftrightunsigned(f"w{k // per}", width * (k % per)).bitwiseAND((1 << width) - 1)
    masks = F.array(*[F.lit(m).cast("long") for m in neighbours(top, own)])
    reached = lambda c: F.transform(masks, lambda m: c.bitwiseXOR(m))
    cell = lambda k: F.shiftrightunsigned(value(k), low) + (k << top)  # noqa: E731  the block, then its leading bits
    right = long.withColumn("cell", F.explode(F.array(*[cell(k) for k in range(words)])))
    left = long.withColumn("cell", F.explode(F.flatten(F.array(*[reached(cell(k)) for k in range(words)]))))
    # How many rows and columns of fragments a cell has; what probes it are all that lie in reach.
    sizes = right.groupBy("cell").agg(F.count("*").alias("n"))
    probing = sizes.select(F.explode(reached(F.col("cell"))).alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("probes"))
    parts = lambda c, most: F.ceil(F.col(c) / most).alias(f"{c}_parts")
    cut = sizes.join(probing, "cell").select("cell", parts("n", 2 * max_fragment), parts("probes", 2 * len(neighbours(top, own)) * max_fragment))
    cut = stored(cut.filter("n_parts > 1 OR probes_parts > 1"), "hot-cells")
    if cut.take(1):
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1))
        part = lambda n: F.pmod(F.xxhash64("id", "o"), F.coalesce(n, F.lit(1)))
        left, right = (df.join(F.broadcast(cut), "cell", "left") for df in (left, right))  # fewer than rows by max_fragment
        left = left.withColumn("row", part(F.col("probes_parts"))).withColumn("col", each(F.col("n_parts"))).drop("n_parts", "probes_parts")
        right = right.withColumn("col", part(F.col("n_parts"))).withColumn("row", each(F.col("probes_parts"))).drop("n_parts", "probes_parts")
    else:
        left, right = (df.withColumns({"row": F.lit(0).cast("long"), "col": F.lit(0).cast("long")}) for df in (left, right))
    columns = ["cell", "row", "col", *long.columns]
    both = left.select(*columns, F.lit(True).alias("probes")).union(right.select(*columns, F.lit(False).alias("probes")))
    kind, o = (long.schema[c].dataType.simpleString() for c in ("id", "o"))
    work = _met(words, radius, width, top)
    found = both.groupBy("cell", "row", "col").applyInArrow(work, f"left_id {kind}, right_id {kind}, distance int, left_o {o}, right_o {o}")
    best = found.groupBy("left_id", "right_id").agg(F.min(F.struct("distance", "left_o", "right_o")).alias("b"))
    return best.select("left_id", "right_id", "b.distance", "b.left_o", "b.right_o")


def _met(words: int, radius: int, width: int, top: int, at_once: int = 1_000_000):
    """Pairs within radius of the rows that probe a cell and of those that lie in it. The latter are put in order of
    their block's other bits; a row probes these at every distance that its leading bits leave of the block's radius."""
    own, per, low = radius // words, 64 // width, width - top

    def work(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        lane, shift, here = (cell >> top) // per, width * ((cell >> top) % per), cell & ((1 << top) - 1)
        asks = table.column("probes").to_numpy()
        sides = []
        for side in (table.filter(pa.array(asks)), table.filter(pa.array(~asks))):
            bits = [side.column(f"w{k}").to_numpy().view(np.uint64) for k in range(-(-words // per))]
            block = (bits[lane] >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
            # Of a row that probes, how far its leading bits are from the cell's; those that are nearest come first.
            order = np.argsort(np.bitwise_count(block >> low ^ here) if side.num_rows and not sides else block, kind="stable")
            sides.append((side.select(["id", "o"]).take(pa.array(order)), [b[order] for b in bits], block[order]))
        (left, a, probe), (right, b, lying) = sides
        left_over = own - np.bitwise_count(probe >> low ^ here).astype(np.int64)
        starts = np.searchsorted(lying & ((1 << low) - 1), np.arange((1 << low) + 1))
        pairs = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))]
        for mask in neighbours(low, own):
            n = int(np.searchsorted(-left_over, -mask.bit_count(), "right"))
            key = probe[:n] & ((1 << low) - 1) ^ mask
            begin, size = starts[key], starts[key + 1] - starts[key]
            upto = np.append(0, np.cumsum(size))
            lo = 0
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + at_once, "right")) - 1)
                i = np.repeat(np.arange(lo, hi), size[lo:hi])
                j = np.arange(upto[hi] - upto[lo]) + np.repeat(begin[lo:hi] - upto[lo:hi] + upto[lo], size[lo:hi])
                d = sum(np.bitwise_count(x[i] ^ y[j]).astype(np.int32) for x, y in zip(a, b, strict=True))
                hit = np.flatnonzero(d <= radius)
                pairs.append((i[hit], j[hit], d[hit]))
                lo = hi
        i, j, d = (np.concatenate(x) for x in zip(*pairs, strict=True))
        one, two = left.take(pa.array(i)), right.take(pa.array(j))
        found = [one.column("id"), two.column("id"), pa.array(d, pa.int32()), one.column("o"), two.column("o")]
        out = pa.table(found, names=["left_id", "right_id", "distance", "left_o", "right_o"])
        return out.filter(pc.less(out.column("left_id"), out.column("right_id")))

    return work


def exact_groups(rows: DataFrame, key: Column, member: str) -> DataFrame:
    """(key, representative, members): content that occurs more than once. Members are a count; the
    rows themselves join by key."""
    return rows.groupBy(key.alias("key")).agg(F.min(member).alias("representative"), F.count("*").alias("members")).filter("members > 1")


def duplicate_summary(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("members"), F.lit(0)).alias("rows"), F.coalesce(F.max("members"), F.lit(0)).alias("largest")
    )


def expanded_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """pairs(left_id, right_id, distance) of representatives as pairs of members(representative,
    member): between the two groups of a pair, for reports on few pairs."""
    one = members.select(F.col("representative").alias("left_id"), F.col("member").alias("a"))
    two = members.select(F.col("representative").alias("right_id"), F.col("member").alias("b"))
    both = pairs.join(one, "left_id").join(two, "right_id")
    return both.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "distance")
