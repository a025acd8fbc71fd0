"""Annotated regions from key presses, and their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirrup.functions.scan import numbered, running


def annotation_order(regions: DataFrame, block_seconds: float = 3600.0) -> DataFrame:
    """Adds event_id: regions counted from 0 by (start, end) per recording."""
    block = F.floor(F.col("start_seconds") / block_seconds)
    tie = [c for c in ("label",) if c in regions.columns]
    return numbered(regions, ["recording_id"], ["start_seconds", "end_seconds", *tie], block, "event_id")


def build_regions(
    key_events: DataFrame, commands: dict[str, str], close_key: str, totals: DataFrame, block_frames: int = 16000 * 3600
) -> DataFrame:
    """Regions (recording_id, label, start_frame, end_frame) from key presses.

    A command key closes the open region and opens its own; the close key only
    closes.  An open region ends with its recording, empty regions are dropped.
    `key_events` has recording_id, frame, seq (order within a frame) and key;
    `totals` has recording_id and frames.
    """
    names = F.create_map(*[F.lit(x) for pair in commands.items() for x in pair])
    used = key_events.where(F.col("key").isin(close_key, *commands)).select(
        "recording_id", "frame", "seq", F.try_element_at(names, F.col("key")).alias("label")
    )
    opened = F.struct("frame", "label")
    before = running(used, ["recording_id"], ["frame", "seq"], F.floor(F.col("frame") / block_frames), {"_open": ("last", opened)})
    closed = before.select(
        "recording_id", F.col("_open.label").alias("label"), F.col("_open.frame").alias("start_frame"), F.col("frame").alias("end_frame")
    )
    last = used.groupBy("recording_id").agg(F.max_by(opened, F.struct("frame", "seq")).alias("_open"))
    at_end = last.join(totals, "recording_id").select(
        "recording_id", F.col("_open.label").alias("label"), F.col("_open.frame").alias("start_frame"), F.col("frames").alias("end_frame")
    )
    return closed.unionByName(at_end).where("label is not null and end_frame > start_frame")
