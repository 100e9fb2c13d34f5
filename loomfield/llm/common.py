"""Stored tables that cut lineage, and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.storage import shared_dir
from loomfield.storage import stored as materialize

__all__ = ["ascii_lower", "bounded_batches", "fresh", "has_repeats", "materialize", "shared_dir"]


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hold Arrow batches to this many rows in the session (they are 10,000 by default, which Java and
    Python each hold several times over). For an application to call on its own session before it runs
    operators on whole texts; operators leave the session as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def has_repeats(df: DataFrame, col: str) -> bool:
    """Whether col holds a null or a value twice; one pre-aggregated pass over that column."""
    return bool(df.groupBy(col).count().filter(F.col(col).isNull() | (F.col("count") > 1)).take(1))


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each behind as many underscores as it takes for df to have no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)
