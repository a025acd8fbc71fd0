"""Long recordings to detections and metrics, many recordings per job."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirrup.functions.arrays import downmix, label_names
from chirrup.operators import checks, clips, metrics
from chirrup.operators.events import evaluate_continuous
from chirrup.session import materialize
from chirrup.sources.manifests import require_none
from chirrup.sources.reports import wide_probabilities, write_report


def prepare_audio(chunks: DataFrame, channels: int = 1, mono: str = "error", target: int = 16000, resample: bool = False) -> DataFrame:
    """Mono chunks at the target rate.  Other rates are refused unless `resample` is set."""
    mixed = chunks.withColumn("samples", downmix(F.col("samples"), channels, mono))
    if resample:
        same = mixed.where(F.col("sample_rate") == target).select("recording_id", "sample_rate", "start_frame", F.col("samples").cast("array<float>"))
        return same.unionByName(clips.resample_chunks(mixed.where(F.col("sample_rate") != target), target))
    refused = F.raise_error(F.lit(f"a recording is not at {target} Hz; set resample")).cast("array<float>")
    return mixed.withColumn("samples", F.when(F.col("sample_rate") == target, F.col("samples").cast("array<float>")).otherwise(refused))


def detector_windows(
    chunks: DataFrame, labels: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], durations: DataFrame,
    window_seconds: float = 3.0, hop_seconds: float = 0.1, rate: int = 16000, kind: str = "logits", strict: bool = True,
) -> DataFrame:
    """Scored windows with p, predicted_label and confidence; times end at the recording's own duration."""
    size, hop = round(rate * window_seconds), round(rate * hop_seconds)
    if not 0 < hop <= size:
        raise ValueError("require 0 < hop <= window")
    classes = labels.count()
    # Scoring dominates the cost and several steps read its narrow result: it is stored once.
    scored = materialize(clips.score_windows(chunks, scorer, classes, size, hop, rate))
    if strict:
        require_none(checks.check_scores(scored, classes, kind).where("fault is not null"), "invalid scores")
    ranked = metrics.top_class(metrics.with_probabilities(scored, kind), labels)
    timed = ranked.join(durations.select("recording_id", "duration_seconds"), "recording_id")
    return timed.withColumn("time_seconds", F.least("end_seconds", "duration_seconds")).select(
        "recording_id", "window_index", "start_seconds", "time_seconds", "left_padding_seconds", "predicted_label", "confidence", "p"
    )


def evaluate_recordings(
    chunks: DataFrame, events: DataFrame | None, recordings: DataFrame, labels: DataFrame, scorer: Callable[[np.ndarray], np.ndarray],
    ignored: tuple[str, ...] = ("unknown", "background"), decoder: dict | None = None, early: float = 0.0, late: float = 1.0,
    sidecars: DataFrame | None = None, audio: dict | None = None, **windows,
) -> dict[str, DataFrame]:
    """Windows (with `emitted` where a detection was), detections, matches and metrics of annotated (or, without events, command-free) recordings.

    `recordings` has recording_id and duration_seconds on the original clock.  A
    recording whose sidecar reports a capture error stops the job.
    """
    if sidecars is not None:
        require_none(checks.capture_error_guard(recordings, sidecars).where("not usable"), "a recording has a capture error")
    names = label_names(labels)
    commands = [n for n in names if n not in ignored]
    if not commands:
        raise ValueError("no command class remains")
    scored = detector_windows(prepare_audio(chunks, **(audio or {})), labels, scorer, recordings, **windows)
    found = evaluate_continuous(scored, events, recordings, commands, {"ignored": ignored, **(decoder or {})}, early, late)
    at = found["detections"].select("recording_id", "window_index", F.lit(True).alias("emitted"))
    windows_out = scored.join(at, ["recording_id", "window_index"], "left").withColumn("emitted", F.coalesce("emitted", F.lit(False)))
    return {"windows": windows_out, **found}


def write_recording_report(result: dict[str, DataFrame], labels: DataFrame, path: str) -> None:
    """Windows, events and detections as CSV, metrics as JSON."""
    tables = {**result, "windows": wide_probabilities(result["windows"], label_names(labels))}
    write_report(tables, path)
