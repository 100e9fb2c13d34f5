"""Streaming forms, run to the end of what has arrived. Events are written in spans of five days,
every fourth event a span too late, and streamed a span at a time; a last row moves the watermark past all of them, and
the last totals of each stream are the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.plans.registering import query
from loomfield.storage import shared_dir
from loomfield.streaming import ordered as O
from loomfield.streaming.sessions import sessions


DAY = 86_400_000


def _streamed(rows: DataFrame, fold) -> DataFrame:
    """Last totals of fold over rows(stream, time, seq, ...) that arrive out of order."""
    spark, at = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/stream-{uuid.uuid4().hex}"
    slot = F.floor(F.unix_micros("time") / (5000 * DAY)) + (F.pmod(F.xxhash64("seq"), F.lit(4)) == 0).cast("int")
    first, last = rows.agg(F.min(slot), F.max(slot)).first()
    dealt, files = rows.withColumn("slot", slot), max(2, spark.sparkContext.defaultParallelism)
    for k in range(first, last + 1) if first is not None else []:
        own = dealt.filter(F.col("slot") == k).drop("slot").repartition(files, F.xxhash64("seq"))
        own.sortWithinPartitions(F.xxhash64("seq", F.lit(1))).write.mode("append").parquet(f"{at}/in")
    end = rows.agg((F.max("time") + F.expr("INTERVAL 400 DAYS")).alias("time"), F.lit("~").alias("stream"))
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ("stream", "time")]
    end.select("stream", "time", *others).select(*rows.columns).write.mode("append").parquet(f"{at}/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")
    told = O.in_order(arriving, fold, "time", "11 days", 60 * DAY)
    write = told.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{at}/out"))
    with O.rocksdb_state(spark):
        write.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return O.latest_totals(spark.read.schema(told.schema).parquet(f"{at}/out")).filter("stream <> '~'")


def _events(t, *columns):
    return t("events").select(F.col("user_id").cast("string").alias("stream"), F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("seq"), *columns)


@query("""WITH o AS (SELECT CAST(user_id AS VARCHAR) AS stream, value, event_type, epoch_us(ts) AS tus FROM events), g AS (SELECT *, coalesce(lead(tus) OVER (PARTITION BY stream ORDER BY tus) - tus, 0) AS d FROM o
), h AS (SELECT *, least(d, 3600000000) AS held FROM g)
SELECT stream, CAST(sum(held) AS BIGINT) AS observed, CAST(sum(d - held) AS BIGINT) AS unobserved, CAST(coalesce(sum(held) FILTER (value >= 20 AND event_type IS NOT NULL), 0) AS BIGINT) AS usable FROM h GROUP BY 1""")
def stream_coverage(t):
    rows = _events(t, (F.col("value") >= 20).alias("usable"), F.col("event_type").alias("run_key"))
    return _streamed(rows, O.CoverageFold(3_600_000_000, 1_200_000_000)).select("stream", "observed", "unobserved", "usable")


@query("""WITH o AS (SELECT CAST(user_id AS VARCHAR) AS stream, ts, event_id, epoch_us(ts) - event_id % 7 * 3000000000 AS tus FROM events), g AS (SELECT stream, tus - lag(tus) OVER (PARTITION BY stream ORDER BY ts, event_id) AS g FROM o)
SELECT stream, count(*) AS frames, count(*) FILTER (g < 0) AS inversions, count(*) FILTER (g = 0) AS duplicates, CAST(coalesce(sum(greatest(0, (g + 300000000) // 600000000 - 1)) FILTER (g > 0), 0) AS BIGINT) AS missing FROM g GROUP BY 1""")
def stream_audit(t):
    claimed = F.unix_micros(F.col("ts").cast("timestamp")) - F.col("event_id") % 7 * 3_000_000_000
    return _streamed(_events(t, claimed.alias("claimed")), O.AuditFold(600_000_000)).select("stream", "frames", "inversions", "duplicates", "missing")


@query("""WITH g AS (SELECT CAST(user_id AS VARCHAR) AS stream, value, lag(value) OVER w AS v, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS d, CASE WHEN event_id % 9 > 0 THEN value END AS x,
  lag(CASE WHEN event_id % 9 > 0 THEN value END) OVER w AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT stream, count(*) AS samples, count(x) AS valid, round(avg(x), 10) AS mean, max(x) AS peak, round(coalesce(sum((x + y) / 2 * d), 0) / 1e9, 5) AS integral FROM g GROUP BY stream""")
def stream_energy(t):
    """Sampled energy of each stream; every ninth sample has no value."""
    told = _streamed(_events(t, F.when(F.col("event_id") % 9 > 0, F.col("value").cast("double")).alias("value")), O.EnergyFold())
    return told.select("stream", "samples", "valid", F.round(F.col("total") / F.col("valid"), 10).alias("mean"), "peak", F.round(F.col("integral") / 1e9, 5).alias("integral"))


@query("""WITH o AS (SELECT user_id, epoch_us(ts) AS tus FROM events), n AS (SELECT *, CASE WHEN tus - lag(tus) OVER (PARTITION BY user_id ORDER BY tus) < 3600000000 THEN 0 ELSE 1 END AS new FROM o
), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY tus ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT user_id, min(tus) AS start_us, max(tus) + 3600000000 AS end_us, count(*) AS rows FROM s GROUP BY user_id, k""")
def sessions_by_pause(t):
    rows = t("events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    out = sessions(rows, "user_id", "at", "1 hour", "1 day")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "rows")
