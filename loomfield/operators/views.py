"""Views of results for one reader: blind, labels only, public, by role; nested caches; figure data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("same", "identity", "other", "stratum", "session", "label")


def blind(pairs: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """pairs without the columns that tell, or hint at, the answer."""
    return pairs.select(*[c for c in pairs.columns if c not in labels])


def labels_only(pairs: DataFrame, key: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    return pairs.select(key, *[c for c in pairs.columns if c in labels and c != key])


def public(report: DataFrame, allowed: dict[str, Column]) -> DataFrame:
    """The allowed columns of a report, each by its expression, and nothing else."""
    return report.select(*[c.alias(n) for n, c in allowed.items()])


def admitted(rows: DataFrame, admissions: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys are admitted, with the split that they are admitted to; rows of a known role but
    another dataset are none of these (see the left_anti of the same join)."""
    return rows.join(admissions.select(*keys, "split"), keys)


def nested_cache(rows: DataFrame, by: list[str], order: list[Column], fields: list[str], name: str) -> DataFrame:
    """One row for each `by` with its rows as an array of structs in order, and the digest of the array."""
    keyed = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.struct(*fields).alias("v"))
    grouped = rows.groupBy(*by).agg(F.array_sort(F.collect_list(keyed)).alias("_a"))
    out = grouped.select(*by, F.transform("_a", lambda x: x["v"]).alias(name))
    return out.withColumn("digest", F.sha2(F.to_json(name), 256))


def unnested(cache: DataFrame, by: list[str], name: str) -> DataFrame:
    """The rows of a nested cache again, with their place from 0."""
    return cache.select(*by, F.posexplode(name).alias("place", "v")).select(*by, "place", "v.*")


def figure_series(tables: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """name -> (table, x, ys) as long rows (figure, series, x, y) for drawing."""
    parts = []
    for name, (df, x, ys) in tables.items():
        each = F.explode(F.array(*[F.struct(F.lit(y).alias("series"), F.col(y).cast("double").alias("y")) for y in ys])).alias("s")
        parts.append(df.select(F.lit(name).alias("figure"), F.col(x).cast("string").alias("x"), each).select("figure", "s.series", "x", "s.y"))
    return reduce(DataFrame.union, parts)
