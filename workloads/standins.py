"""Audio-shaped views derived from the general test tables.

The tables hold no audio, so each operator gets a table with the columns it
needs: documents act as manifest rows, embedding vectors as short clips, and
the event stream as detector windows, annotated regions and key presses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirrup.functions.rand import unit
from chirrup.functions.scan import numbered

DAY = 86400.0
CLOCK_START_US = 1_704_067_200_000_000  # 2024-01-01, where the event stream's recordings begin


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    digest = F.sha2(F.col("text"), 256)
    u = unit(i, "split")
    return d.select(
        i.alias("record_index"),
        F.concat(F.lit("rec_"), F.when(i % 37 == 36, i - 1).otherwise(i)).alias("id"),
        F.concat_ws("/", "lang", "source", F.concat(i, F.lit(".txt"))).alias("path"),
        F.col("lang").alias("label"),
        F.when(u < 0.7, "train").when(u < 0.85, "val").otherwise("test").alias("split"),
        F.col("source").alias("speaker_group"),
        F.when(i % 3 == 0, F.concat(F.lit("p"), F.floor(i / 10))).alias("parent_id"),
        F.when(i % 4 == 1, F.lit("")).when(i % 4 == 2, F.concat(F.lit("g"), F.floor(i / 8))).alias("source_group"),
        F.element_at(
            F.array(*map(F.lit, ("human_recording", "procedural_noise", "source_crop")), F.lit(None).cast("string")),
            (i % 4 + 1).cast("int"),
        ).alias("sample_kind"),
        F.when(i % 3 == 0, "real").when(i % 3 == 1, "tts").alias("engine"),
        F.when(i % 7 == 0, False).when(i % 7 < 4, True).alias("use_for_mixing"),
        digest.alias("sha256"),
        F.when(i % 11 == 0, F.lit("")).when(i % 13 == 0, F.md5("text")).when(i % 5 != 0, digest).alias("declared_sha256"),
        F.col("n_chars").alias("frames"),
    )


def label_map(spark, sf_dir) -> DataFrame:
    """Languages of the documents, numbered alphabetically."""
    names = table(spark, sf_dir, "documents").agg(F.array_sort(F.collect_set("lang")).alias("names"))
    return names.select(F.posexplode("names").alias("label_id", "label")).select(
        "label", F.col("label_id").cast("bigint").alias("label_id")
    )


def clips(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("clip_id"),
        F.col("embedding").cast("array<double>").alias("samples"),
        F.concat(F.lit("class_"), F.col("label")).alias("label"),
        F.col("label").cast("bigint").alias("label_id"),
        F.lit(16000).alias("sample_rate"),
    )


def class_map(spark, sf_dir) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("label_id")).distinct()
    return ids.select(F.concat(F.lit("class_"), F.col("label_id")).alias("label"), "label_id")


def event_log(spark, sf_dir) -> DataFrame:
    """Events on their recording's clock, in seconds."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("recording_id"),
        ((us - F.lit(CLOCK_START_US)) / F.lit(1e6)).alias("time_seconds"),
        F.col("event_type").alias("label"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def windows(spark, sf_dir) -> DataFrame:
    week = F.floor(F.col("time_seconds") / (7 * DAY))
    out = numbered(event_log(spark, sf_dir), ["recording_id"], ["time_seconds", "event_id"], week, "window_index")
    return out.select("recording_id", "window_index", "time_seconds", F.col("label").alias("predicted_label"), "confidence")


def durations(spark, sf_dir) -> DataFrame:
    e = event_log(spark, sf_dir)
    return e.groupBy("recording_id").agg((F.max("time_seconds") + 3600.0).alias("duration_seconds"))


def regions(spark, sf_dir) -> DataFrame:
    """Annotated six-hour spans: the events whose property k is below 33."""
    e = event_log(spark, sf_dir).where("k < 33")
    return e.select(
        "recording_id",
        "event_id",
        "label",
        F.col("time_seconds").alias("start_seconds"),
        (F.col("time_seconds") + 21600.0).alias("end_seconds"),
    )


def detections(spark, sf_dir) -> DataFrame:
    """The other events, read as detector output."""
    e = event_log(spark, sf_dir).where("k >= 33")
    return e.select("recording_id", F.col("event_id").alias("detection_id"), "label", "time_seconds", "confidence")


def history(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    month = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMM").cast("bigint")
    return o.groupBy(F.col("o_orderpriority").alias("run"), month.alias("epoch")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("val_loss")
    )
