"""Annotation files: JSON regions and tab-separated label exports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chirrup.functions.arrays import bounded, seconds_to_frame
from chirrup.operators.regions import annotation_order
from chirrup.sources.manifests import require_none

ANNOTATION = """wav string, sample_rate int, frames bigint, annotation_status string, error string,
regions array<struct<label: string, start_frame: bigint, end_frame: bigint>>"""


def check_annotations(
    documents: DataFrame, recordings: DataFrame, commands: list[str], allow_draft: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(events in seconds, numbered per recording; faults as recording_id and reason).

    A document counts only if it is reviewed (or a draft, when allowed), reports
    no capture error, and names the recording's file, rate and length.  A
    document with any bad region gives no event at all.
    """
    actual = recordings.select("recording_id", "wav", F.col("sample_rate").alias("_rate"), F.col("frames").alias("_frames"))
    statuses = ("reviewed", "draft") if allow_draft else ("reviewed",)

    def bad(r: Column) -> Column:
        s, e = r.start_frame, r.end_frame
        ok = (s >= 0) & (s < e) & (e <= F.col("frames")) & r.label.isin(*commands)
        return ~F.coalesce(ok, F.lit(False))

    reason = (
        F.when(~F.coalesce("annotation_status", F.lit("")).isin(*statuses), "status")
        .when(F.coalesce("error", F.lit("")) != "", "capture_error")
        .when(F.col("_rate").isNull(), "unknown_recording")
        .when(~(F.col("sample_rate").eqNullSafe(F.col("_rate")) & F.col("frames").eqNullSafe(F.col("_frames"))), "clock_mismatch")
        .when(F.col("regions").isNull(), "no_regions")
        .when(F.exists("regions", bad), "bad_region")
    )
    judged = documents.join(actual, "wav", "left").withColumn("reason", reason)
    rate = F.col("sample_rate")
    events = judged.where("reason is null").select("recording_id", "sample_rate", F.inline("regions")).select(
        "recording_id", "label", (F.col("start_frame") / rate).alias("start_seconds"), (F.col("end_frame") / rate).alias("end_seconds")
    )
    return annotation_order(events), judged.where("reason is not null").select("wav", "recording_id", "reason")


def load_annotations(
    spark: SparkSession, path, recordings: DataFrame, commands: list[str], allow_draft: bool = False, strict: bool = True
) -> DataFrame:
    documents = spark.read.schema(ANNOTATION).json(path, multiLine=True)
    events, faults = check_annotations(documents, recordings, commands, allow_draft)
    if strict:
        require_none(faults, "unusable annotations")
    return events


def parse_label_lines(lines: DataFrame, recordings: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regions by start_frame, faulty lines with a reason) from `start TAB end TAB label` lines.

    `lines` has recording_id and value; `recordings` has recording_id,
    sample_rate and frames.
    """
    parts = F.split(F.regexp_replace("value", "^﻿|\r$", ""), "\t")
    rows = lines.where(F.trim("value") != "").withColumn("_f", parts)
    number = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

    def second(i):
        text = F.get("_f", F.lit(i))
        return F.when(text.rlike(number), F.trim(text).cast("double"))

    known = bounded(labels.select("label").distinct().withColumn("_known", F.lit(True)))
    rows = (
        rows.withColumn("label", F.get("_f", F.lit(2))).withColumn("_s", second(0)).withColumn("_e", second(1))
        .join(recordings.select("recording_id", "sample_rate", "frames"), "recording_id", "left")
        .join(known, "label", "left")
        .withColumn("start_frame", seconds_to_frame(F.col("_s"), F.col("sample_rate")))
        .withColumn("end_frame", F.least("frames", seconds_to_frame(F.col("_e"), F.col("sample_rate"))))
    )
    within = (F.col("_s") >= 0) & (F.col("_s") < F.col("_e")) & (F.col("_e") <= F.col("frames") / F.col("sample_rate") + 1e-6)
    reason = (
        F.when(F.size("_f") != 3, "fields")
        .when(~F.coalesce(within, F.lit(False)), "interval")
        .when(F.col("_known").isNull(), "unknown_label")
        .when(F.col("start_frame") >= F.col("end_frame"), "shorter_than_a_frame")
    )
    rows = rows.withColumn("reason", reason)
    return (
        rows.where("reason is null").select("recording_id", "label", "start_frame", "end_frame"),
        rows.where("reason is not null").select("recording_id", "value", "reason"),
    )


def import_labels(spark: SparkSession, path, recordings: DataFrame, labels: DataFrame) -> DataFrame:
    """Regions of label files named <recording_id>.txt; any faulty line stops the job."""
    lines = spark.read.text(path).select("value", F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1).alias("recording_id"))
    regions, faults = parse_label_lines(lines, recordings, labels)
    require_none(faults, "bad label line")
    return regions


def label_line(start_frame: Column, end_frame: Column, rate: Column, label: Column) -> Column:
    """`%.6f TAB %.6f TAB label`, rounding the exact binary value as C does.

    The JVM's format rounds the shortest decimal instead, which differs on the
    half-microsecond ties that 16 kHz frames hit.
    """

    @F.pandas_udf("string")
    def text(start: pd.Series, end: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([f"{s:.6f}\t{e:.6f}\t{n}" for s, e, n in zip(start, end, names)])

    return text(start_frame / rate, end_frame / rate, label)


def export_labels(regions: DataFrame, path: str) -> None:
    """One folder per recording with its label lines in start order."""
    line = label_line(F.col("start_frame"), F.col("end_frame"), F.col("sample_rate"), F.col("label"))
    rows = regions.repartitionByRange("recording_id", "start_frame").sortWithinPartitions("recording_id", "start_frame")
    rows.select("recording_id", line.alias("value")).write.mode("errorifexists").partitionBy("recording_id").text(path)
