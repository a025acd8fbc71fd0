"""Streaming queries: a table replayed in several micro-batches, and its sink read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirrup.session import fresh_path
from chirrup.streaming import detector
from workloads import standins as v
from workloads.detection import COMMANDS, DAY, DECODE_STEPS, HOUR
from workloads.views_sql import sql
from workloads.waveforms import r, recordings

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def replayed(spark, df, slices, build):
    """What `build` makes of `df` as a stream that arrives slice by slice, in order; rows within a slice are not ordered.

    Each slice is written by as many tasks as the table has; then the query
    takes up its checkpoint and runs over the new files, all in one micro-batch.
    """
    source, sink, marks = (fresh_path(spark, name) for name in ("replay", "sink", "offsets"))
    for i, condition in enumerate(slices):
        df.where(condition).write.mode("append" if i else "errorifexists").parquet(source)
        out = build(spark.readStream.schema(df.schema).parquet(source))
        running = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start()
        running.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def thirds(column, low, high):
    c = F.col(column)
    return [c < low, (c >= low) & (c < high), c >= high]


@query("stream_decode_events", sql("SELECT recording_id, window_index, label, time_seconds, confidence, false AS late FROM found", "v_windows", **DECODE_STEPS))
def stream_decode_events(spark, sf_dir):
    parts = thirds("time_seconds", 8 * DAY, 19 * DAY)
    return replayed(spark, v.windows(spark, sf_dir), parts, lambda s: detector.stream_decode_events(s, COMMANDS, 0.2, 2, HOUR, DAY))


@query(
    "stream_sliding_windows",
    sql(
        """SELECT recording_id, k AS window_index, greatest(0, e - 100) / 16000 AS start_seconds, e / 16000 AS end_seconds, greatest(0, 100 - e) / 16000 AS left_padding_seconds,
  round(list_sum(audio[greatest(0, e - 100) + 1 : e]), 5) + 0.0 AS total, false AS late FROM (
  SELECT recording_id, audio, unnest(range(0, len(audio) // 64)) AS k, (k + 1) * 64 AS e FROM (
    SELECT label AS recording_id, flatten(list(samples ORDER BY clip_id)) AS audio FROM v_clips GROUP BY 1))""",
        "v_clips",
    ),
)
def stream_sliding_windows(spark, sf_dir):
    chunks = recordings(spark, sf_dir).withColumn("samples", F.col("samples").cast("array<float>"))
    w = replayed(spark, chunks, thirds("chunk_idx", 15, 40), lambda s: detector.stream_sliding_windows(s, 100, 64, block_seconds=0.04))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return w.select("recording_id", "window_index", "start_seconds", "end_seconds", "left_padding_seconds", r(total, 5).alias("total"), "late")


@query(
    "stream_detection_rate",
    """SELECT event_type AS label, CAST(epoch_us(ts) // 3600000000 * 3600 AS BIGINT) AS period_start, count(*) AS fp, count(*) / 1.0 AS fp_per_hour FROM events
WHERE (epoch_us(ts) // 3600000000 + 1) * 3600000000 <= (SELECT max(epoch_us(ts)) FROM events) - 86400000000 GROUP BY 1, 2""",
)
def stream_detection_rate(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("label"))
    bounds = [F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")]
    rates = replayed(spark, e, thirds("ts", *bounds), lambda s: detector.stream_detection_rate(s, "ts", "1 hour", "1 day", ("label",)))
    return rates.select("label", F.unix_seconds("period_start").alias("period_start"), "fp", "fp_per_hour")
