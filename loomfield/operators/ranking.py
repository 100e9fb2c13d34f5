"""Places and running sums over a whole table's order, and minima and joins of hot keys, without a single
task that holds them.

Rows are range-partitioned by the order and stored with their partition's number; within a partition
a window adds up, and a partition's start follows from the sums of those before it, of which there are
as many as partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomfield.storage import stored


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each name in sums, the sum of its expression over this row and all before it.
    The order should be total; ties within it are put in some order."""
    values = {f"_{n}": c for n, c in sums.items()}
    placed = rows.withColumns(values).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    placed = stored(placed, "ranged")
    parts = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_t{c}") for c in values])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("_part", *[F.coalesce(F.sum(f"_t{c}").over(before), F.lit(0)).alias(f"_s{c}") for c in values])
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = placed.withColumns({f"_w{c}": F.sum(c).over(within) for c in values})
    out = {n: F.col(f"_w_{n}") + F.col(f"_s_{n}") for n in sums}
    return summed.join(F.broadcast(starts), "_part").withColumns(out).select(*rows.columns, *sums)  # a row a partition


def numbered(rows: DataFrame, order: list[Column], name: str, by: list[str] | None = None) -> DataFrame:
    """rows with their place from 1 in the order, or in the order of each group of `by`. A group may hold
    most rows: it lies in several ranges then, and what comes before a range of it is joined by (group,
    range), a key that has one range's rows at most. Rows with a null in `by` are left out."""
    if not by:
        return running_sums(rows, order, {name: F.lit(1)})
    whole = rows.dropna(subset=by)
    placed = whole.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id())
    placed = stored(placed, "ranged")
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range of a group
    starts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_c")).withColumn("_s", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    within = placed.withColumn("_w", F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order)))
    joined = within.join(starts.drop("_c"), [*by, "_part"])
    return joined.withColumn(name, F.col("_w") + F.col("_s")).select(*rows.columns, name)


def beside(rows: DataFrame, by: list[str], order: list[Column], step: int, columns: dict[str, str]) -> DataFrame:
    """rows with, for each new name in columns, that column of the row `step` places on in its group's
    order (-1: the one before; null at the ends). Rows meet by group and place, which is a key of one
    row, so a group may hold most of the table. Rows without a group are left out."""
    placed = stored(numbered(rows.dropna(subset=by), order, "_place", by), "placed")
    other = placed.select(*by, (F.col("_place") - step).alias("_place"), *[F.col(c).alias(n) for n, c in columns.items()])
    return placed.join(other, [*by, "_place"], "left").drop("_place")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_least(rows: DataFrame, key: str, value: str, out: str, spread: str, extreme: Callable[[str], Column] = F.min) -> DataFrame:
    """rows with the least value of their key (or the largest: extreme=F.max). A key may hold most rows:
    they are dealt over as many salts as there are shuffle partitions by a hash of `spread`, extremes are
    taken of each (key, salt) and then of each key, and go back to the salts that the key has, so the rows
    of a key are joined in as many parts. Rows with a null key are left out."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(max(32, _parts(rows)))))
    parts = dealt.groupBy(key, "_salt").agg(extreme(value).alias("_m"))
    whole = parts.groupBy(key).agg(extreme("_m").alias(out), F.collect_list("_salt").alias("_salts"))
    return dealt.join(whole.select(key, out, F.explode("_salts").alias("_salt")), [key, "_salt"]).drop("_salt")


def least_of_key(rows: DataFrame, key: str, value: str, out: str, spread: str) -> DataFrame:
    """with_least() for rows that are cheap to read twice: one shuffle of them where no key is hot. Rows are first
    counted in a few buckets of keys for each shuffle partition; only the keys of buckets that hold more than an
    even share of a partition, of which there are fewer than partitions, are dealt over salts, the others meet in a window."""
    n = _parts(rows)
    bucket = F.pmod(F.xxhash64(key), F.lit(16 * n))
    counts = [(r["b"], r["n"]) for r in rows.filter(F.col(key).isNotNull()).groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()]  # 16 a partition
    share = max(256, -(-sum(c for _, c in counts) // n))
    hot = [b for b, c in counts if c > share]
    least = lambda df: df.withColumn(out, F.min(value).over(W.partitionBy(key)))
    if not hot:
        return least(rows.filter(F.col(key).isNotNull()))
    apart = bucket.isin(hot)
    return least(rows.filter(F.col(key).isNotNull() & ~apart)).union(with_least(rows.filter(apart), key, value, out, spread).select(*rows.columns, out))


def salted_join(rows: DataFrame, other: DataFrame, keys: list[str], spread: list[str], how: str = "inner", hint: str | None = None) -> DataFrame:
    """rows joined (inner, left, left_semi or left_anti) with other by equal keys, where a key may hold most
    of rows. Rows of each key are counted first; a key with more than an even share of a shuffle partition
    is dealt over as many salts as it has shares, by a hash of `spread`, and other's rows of it are repeated
    for each. There are fewer such keys than partitions, and they are known by a hash, so the table of them
    that is broadcast is that small; keys that share a hash are dealt alike. AQE cannot do this where a
    side has no exchange of its own (it was just grouped by the key). Null keys match nothing, and are
    dealt in the same way. rows is read twice, its keys alone the first time: store it where it is dear. With
    hint="merge" other is not broadcast, however small Spark takes it to be."""
    spark, n = rows.sparkSession, _parts(rows)
    hashed = lambda df: df.withColumn("_h", F.xxhash64(*keys))
    counts = hashed(rows.select(*keys)).groupBy("_h").agg(F.count("*").alias("n"))
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    share = max(1, -(-total // n))
    hinted = lambda df: df.hint(hint) if hint else df
    if most <= share:
        return rows.join(hinted(other), keys, how)
    hot = [(r["_h"], -(-r["n"] // share)) for r in counts.filter(F.col("n") > share).collect()]  # fewer than n rows
    salts = F.broadcast(spark.createDataFrame(hot, "_h long, _salts long"))
    left = hashed(rows).join(salts, "_h", "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0)))
    right = hashed(other).join(salts, "_h", "left")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
    return left.drop("_h", "_salts").join(hinted(right.drop("_h", "_salts")), [*keys, "_salt"], how).drop("_salt")
