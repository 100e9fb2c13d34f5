"""Sums of doubles without rounding error, whatever the order and the partitions.

A finite double is an integer times a power of two. Integers of one exponent are added as decimals, which is
exact and merges in any order, so partial sums are taken before the shuffle and a group comes to a row
for each exponent (about two thousand at most). Only the last step rounds: once, to the nearest double.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The exponent under which every double is an integer: that of the smallest one.
LOWEST = -1074


def _scaled(x: Column, by: Column) -> Column:
    """x times two to the power of by; in two steps, so that no factor overflows."""
    half = F.floor(by / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), by - half)


def exact_parts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, exponent, units, n): sums of the rows' integers for each exponent; zeros count under a null one, and
    values that are not finite under the null one with their sum in `odd`."""
    x = F.col(value).cast("double")
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    # A logarithm may be one too large or small; one more bit keeps the integer whole, and 55 bits fit.
    exponent = F.greatest(F.floor(F.log2(F.abs(x))) - 53, F.lit(LOWEST))
    live = rows.filter(x.isNotNull()).withColumn("_e", F.when(finite & (x != 0), exponent))
    units = F.when(F.col("_e").isNotNull(), _scaled(x, -F.col("_e"))).cast("long").cast("decimal(38,0)")
    return live.groupBy(*by, F.col("_e").alias("exponent")).agg(
        F.sum(units).alias("units"), F.count("*").alias("n"), F.sum(F.when(~finite, x)).alias("odd")
    )


_SUM = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("error", T.DoubleType())])


@F.pandas_udf(_SUM)
def _rounded(parts: pd.Series) -> pd.DataFrame:
    out = []
    for group in parts:
        units = {int(p["exponent"]): int(p["units"]) for p in group if p["exponent"] is not None}
        least = min(units, default=0)
        whole = Fraction(sum(m << (e - least) for e, m in units.items())) * Fraction(2) ** least
        try:
            value = float(whole)
            out.append((value, float(whole - Fraction(value))))
        except OverflowError:
            out.append((float("inf") if whole > 0 else float("-inf"), None))
    return pd.DataFrame(out, columns=["value", "error"])


def exact_sums(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, value, error): the sum of a group's doubles, rounded once to the nearest (ties to even), and
    what the rounding left. Nulls take no part; a group of them alone is absent, and groups may be null.
    If some value is not finite the sum is what adding such values gives, and error is null."""
    parts = exact_parts(rows, by, value)
    told = F.collect_list(F.struct("exponent", F.col("units").cast("string").alias("units")))
    sums = parts.groupBy(*by).agg(told.alias("parts"), F.sum("n").alias("n"), F.sum("odd").alias("odd"))
    done = sums.withColumn("r", _rounded("parts"))
    whole = F.col("odd").isNull()
    return done.select(*by, "n", F.when(whole, F.col("r.value")).otherwise(F.col("odd")).alias("value"), F.when(whole, F.col("r.error")).alias("error"))
