"""Time series: sample-and-hold coverage, runs, gap audits, integration and interval unions.

What a row needs of its neighbours in a stream (a camera, a device) comes by place, not by a window
over the stream, so one stream may hold most of the rows. Rows without a stream take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.operators.ranking import beside, running_sums
from loomfield.storage import stored


def held(rows: DataFrame, stream: str, time: str, max_hold: int, period: int) -> DataFrame:
    """rows with `held` (how long each observation stands: to the next one, max_hold at most; the last
    one a period) and `gap` (time to the next beyond that). Times are integers, alike in unit."""
    paired = beside(rows, [stream], [F.col(time)], 1, {"_next": time})
    to_next = F.coalesce(F.col("_next") - F.col(time), F.lit(period))
    return paired.withColumn("_to", to_next).drop("_next").withColumn("held", F.least("_to", F.lit(max_hold))).withColumn("gap", F.col("_to") - F.col("held")).drop("_to")


def order_breaches(rows: DataFrame, stream: str, arrival: str, time: str) -> DataFrame:
    """Rows that arrive no later in time than the row before them in their stream."""
    return beside(rows, [stream], [F.col(arrival)], -1, {"before": time}).filter(F.col(time) <= F.col("before"))


def three_valued(conditions: list[Column], inputs: list[Column]) -> Column:
    """All conditions, but null if any input is null (where SQL's AND may say false)."""
    out, missing = conditions[0], inputs[0].isNull()
    for c in conditions[1:]:
        out = out & c
    for x in inputs[1:]:
        missing = missing | x.isNull()
    return F.when(~missing, out)


def durations(rows: DataFrame, conditions: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Held time in all and under each condition (null counts as no)."""
    return rows.groupBy(*(by or [])).agg(
        F.sum("held").alias("observed"),
        F.sum("gap").alias("unobserved"),
        *[F.coalesce(F.sum(F.when(c, F.col("held"))), F.lit(0)).alias(n) for n, c in conditions.items()],
    )


def runs(rows: DataFrame, stream: str, time: str, usable: Column, key: Column, least: int) -> DataFrame:
    """Runs of usable rows of one key: (stream, key, start, rows, duration) of those whose held time is
    at least `least`. A run ends at a row that is not usable or has no key, at another key, and after
    a row with a gap beyond its hold."""
    marked = rows.withColumn("_ok", F.coalesce(usable & key.isNotNull(), F.lit(False))).withColumn("_k", key)
    paired = beside(marked, [stream], [F.col(time)], -1, {"_was_ok": "_ok", "_was_k": "_k", "_was_gap": "gap"})
    goes_on = F.coalesce(F.col("_was_ok"), F.lit(False)) & F.col("_was_k").eqNullSafe(F.col("_k")) & (F.col("_was_gap") == 0)
    # Every stream begins with a new run, so one count over all streams tells runs apart.
    order = [F.col(stream), F.col(time)]
    counted = running_sums(paired, order, {"_run": F.when(goes_on, 0).otherwise(1)})
    return (
        counted.filter("_ok")
        .groupBy(stream, "_run", F.col("_k").alias("key"))
        .agg(F.min(time).alias("start"), F.count("*").alias("rows"), F.sum("held").alias("duration"))
        .filter(F.col("duration") >= least)
        .drop("_run")
    )


def gap_audit(rows: DataFrame, stream: str, arrival: str, time: str, period: int) -> DataFrame:
    """Per stream, in order of arrival: frames, nulls, inversions, duplicates, missing frames (each
    positive gap, rounded to whole periods, less one), largest gap. A null time is skipped."""
    timed = rows.select(stream, arrival, time).filter(F.col(time).isNotNull())
    g = beside(timed, [stream], [F.col(arrival)], -1, {"_before": time}).withColumn("g", F.col(time) - F.col("_before"))
    missed = F.greatest(F.lit(0), F.floor((F.col("g") + period // 2) / period) - 1)
    audit = g.groupBy(stream).agg(
        F.count("*").alias("frames"),
        F.count(F.when(F.col("g") < 0, 1)).alias("inversions"),
        F.count(F.when(F.col("g") == 0, 1)).alias("duplicates"),
        F.coalesce(F.sum(F.when(F.col("g") > 0, missed)), F.lit(0)).cast("long").alias("missing"),
        F.max(F.when(F.col("g") > 0, F.col("g"))).alias("max_gap"),
    )
    nulls = rows.groupBy(stream).agg(F.count(F.when(F.col(time).isNull(), 1)).alias("nulls"))
    return nulls.join(audit, stream, "left").fillna(0, ["frames", "inversions", "duplicates", "missing"])


def integral(rows: DataFrame, stream: str, time: str, value: str) -> DataFrame:
    """Mean, maximum and trapezoid integral of value over time per stream; a step counts only if both
    its ends have a value."""
    paired = beside(rows.select(stream, time, value), [stream], [F.col(time)], -1, {"_t": time, "_v": value})
    step = (F.col(value) + F.col("_v")) / 2 * (F.col(time) - F.col("_t"))
    return paired.withColumn("_s", step).groupBy(stream).agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.coalesce(F.sum("_s"), F.lit(0.0)).alias("integral")
    )


def longest_cover(rows: DataFrame, stream: str, start: str, end: str) -> DataFrame:
    """Length of the longest unbroken stretch of the union of intervals per stream. Starts and ends are
    events in order of time, starts first; a stretch begins where one interval is open after a start, and
    ends where none is, and the two alternate. Rows with a null in the stream or a bound, and those that
    end before they start, are no intervals; a stream of such rows alone is absent."""
    whole = rows.dropna(subset=[stream, start, end]).filter(F.col(start) <= F.col(end))
    of = lambda c, d: whole.select(stream, F.col(c).alias("_t"), F.lit(d).alias("_d"))
    events = of(start, 1).union(of(end, -1))
    opened = running_sums(events, [F.col(stream), F.col("_t"), F.col("_d").desc()], {"_open": F.col("_d")})
    edges = opened.filter(((F.col("_open") == 1) & (F.col("_d") == 1)) | (F.col("_open") == 0))
    paired = beside(edges, [stream], [F.col("_t"), F.col("_d").desc()], 1, {"_stop": "_t"})
    return paired.filter("_d = 1").groupBy(stream).agg(F.max(F.col("_stop") - F.col("_t")).alias("longest"))


def missing_kinds(rows: DataFrame, stream: str, kind: str, required: list[str]) -> DataFrame:
    """(stream, kind) of required kinds that a stream lacks."""
    need = rows.select(stream).distinct().select(stream, F.explode(F.array(*map(F.lit, required))).alias(kind))
    return need.join(rows.select(stream, kind).distinct(), [stream, kind], "left_anti")


def nearest_rank(rows: DataFrame, value: str, by: list[str], levels: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """min, max, mean and nearest-rank percentiles (the ceil(q * n)th value) of each group, from the counts
    of its distinct values; nulls take no part."""
    counts = stored(rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "values")
    summed = running_sums(counts, [*[F.col(c) for c in by], F.col("_v")], {"_all": F.col("_c")})
    base = summed.groupBy(*by).agg(F.min(F.col("_all") - F.col("_c")).alias("_base"), F.sum("_c").alias("n"))
    placed = summed.join(base, by).withColumn("_upto", F.col("_all") - F.col("_base"))
    at = lambda q: F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n"))), F.col("_v")))
    return placed.groupBy(*by).agg(
        F.max("n").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"),
        *[at(q).alias(f"p{round(100 * q)}") for q in levels],
    )
