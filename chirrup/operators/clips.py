"""Levels, trimming and cleaning of clips, and windows over long recordings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirrup.functions import dsp
from chirrup.functions.arrays import dbfs, energy, peak

#: Clips that a task works on together.
BLOCK = 64
TRIM = "start int, end int, reason string"
CLEAN = """samples array<float>, reason string, original_duration_s double, trimmed_left_s double, trimmed_right_s double,
sample_rate int, duration_s double, peak_limiter_gain double"""


def recording_levels(chunks: DataFrame, full_scale: float = 1.0, clip_at: float = 32760 / 32768) -> DataFrame:
    """Frames, duration, peak and RMS in dBFS (NULL for silence) and clipped share per recording.

    Each chunk is reduced to four numbers before anything is shuffled.
    """
    s = F.col("samples")
    limit = clip_at * full_scale
    parts = chunks.select(
        "recording_id", "sample_rate", F.size(s).alias("_n"), peak(s).alias("_peak"), energy(s).alias("_energy"),
        F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + F.when(F.abs(x) >= limit, 1).otherwise(0)).alias("_clipped"),
    )
    sums = parts.groupBy("recording_id", "sample_rate").agg(
        F.sum("_n").alias("frames"), F.max("_peak").alias("_peak"), F.sum("_energy").alias("_energy"), F.sum("_clipped").alias("_clipped")
    )
    n = F.col("frames")
    rms = F.when(n > 0, F.sqrt(F.col("_energy") / n) / full_scale)
    return sums.select(
        "recording_id", "frames", (n / F.col("sample_rate")).alias("duration_seconds"),
        dbfs(F.col("_peak") / full_scale).alias("peak_dbfs"), dbfs(rms).alias("rms_dbfs"),
        F.coalesce(F.try_divide("_clipped", n), F.lit(0.0)).alias("clipped_fraction"),
    )


def speech_spans(
    waves: list[np.ndarray], labels, rate=dsp.RATE, min_s=0.35, max_s=2.6, margin_ms=150.0, frame=320, hop=160, relative_db=-35.0,
    floor_db=-55.0, exempt=("background",),
) -> pd.DataFrame:
    """start, end and reason of clips: where speech is, with a margin, and why a clip is rejected.

    Speech is where frames rise above a level relative to the clip's loudest
    frame.  All clips are judged together, on one matrix of frame levels.
    """
    levels, _ = dsp.stacked([dsp.frame_rms(x, frame, hop) for x in waves])
    sizes, margin = np.array([len(x) for x in waves], dtype=np.int64), round(margin_ms * rate / 1000)
    quiet = np.maximum(levels.max(axis=1) * 10 ** (relative_db / 20), 10 ** (floor_db / 20))
    loud = levels > quiet[:, None]
    last = levels.shape[1] - 1 - loud[:, ::-1].argmax(axis=1)
    free, spoken = np.isin(np.asarray(labels, dtype=object).astype(str), exempt), loud.any(axis=1)
    spans = pd.DataFrame({
        "start": np.where(free, 0, np.maximum(loud.argmax(axis=1) * hop - margin, 0)),
        "end": np.where(free, sizes, np.minimum(last * hop + frame + margin, sizes)),
    }).astype("Int32")
    seconds = ((spans["end"] - spans["start"]) / rate).to_numpy(np.float64)
    wrong = (seconds < min_s) | (seconds > max_s)
    reasons = np.full(len(waves), None, dtype=object)
    reasons[wrong] = [f"speech_duration_outside_limits:{t:.5f}" for t in seconds[wrong]]
    reasons[~spoken] = "no_speech_activity"
    reasons[free] = None
    spans.loc[~spoken & ~free, ["start", "end"]] = pd.NA
    return spans.assign(reason=reasons)


def in_blocks(f: Callable[..., pd.DataFrame], *columns: pd.Series) -> pd.DataFrame:
    """`f` on blocks of rows, which bound the memory of what it stacks."""
    n = len(columns[0])
    return pd.concat([f(*(c.iloc[at : at + BLOCK].tolist() for c in columns)) for at in range(0, max(n, 1), BLOCK)], ignore_index=True)


def activity_trim(clips: DataFrame, **settings) -> DataFrame:
    """Adds start, end (sample positions of the speech) and reason (NULL when the clip is kept)."""

    @F.pandas_udf(TRIM)
    def spans(samples: pd.Series, labels: pd.Series) -> pd.DataFrame:
        return in_blocks(lambda x, label: speech_spans([*map(dsp.as_wave, x)], label, **settings), samples, labels)

    return clips.withColumn("_t", spans.asNondeterministic()("samples", "label")).select("*", "_t.*").drop("_t")


def clean_block(samples, channels, rates, labels, target=dsp.RATE, ceiling=0.98, **settings) -> pd.DataFrame:
    """Clips through downmix, rate change, trimming and peak limiting: a row of CLEAN for each."""
    raw = [dsp.as_wave(x) for x in samples]
    fine = np.array([bool(len(x)) and r > 0 and bool(np.isfinite(x).all()) for x, r in zip(raw, rates)], dtype=bool)
    mono = [x.reshape(-1, int(c)).mean(axis=1) if ok else np.zeros(0) for x, c, ok in zip(raw, channels, fine)]
    waves = [dsp.resample(x, int(r), target) if ok else x for x, r, ok in zip(mono, rates, fine)]
    spans = speech_spans(waves, labels, target, **settings)
    spans.loc[~fine, "reason"] = "empty_or_nonfinite_audio"
    kept = []
    for i, (start, end, reason) in enumerate(zip(spans["start"].tolist(), spans["end"].tolist(), spans["reason"].tolist())):
        if isinstance(reason, str):
            kept.append((None, reason, *[None] * 6))
            continue
        part = waves[i][start:end]
        gain = ceiling / np.abs(part).max(initial=ceiling)
        cut = (start / target, (len(waves[i]) - end) / target, target, len(part) / target)
        kept.append(((part * gain).astype(np.float32), None, len(mono[i]) / int(rates[i]), *cut, gain))
    names = [part.split()[0] for part in CLEAN.split(",")]
    out = pd.DataFrame({name: pd.Series(column, dtype=object) for name, column in zip(names, zip(*kept) if kept else [()] * len(names))})
    floats = ("original_duration_s", "trimmed_left_s", "trimmed_right_s", "duration_s", "peak_limiter_gain")
    return out.astype({"sample_rate": "Int32", **dict.fromkeys(floats, "Float64")})


def clean_clip(clips: DataFrame, **settings) -> DataFrame:
    """Adds `clean`: the cleaned samples with their trim metadata, or a reason.

    All steps run in one pass, so each clip crosses to Python and back once.
    """

    @F.pandas_udf(CLEAN)
    def clean(samples: pd.Series, channels: pd.Series, rates: pd.Series, labels: pd.Series) -> pd.DataFrame:
        return in_blocks(lambda *block: clean_block(*block, **settings), samples, channels, rates, labels)

    return clips.withColumn("clean", clean.asNondeterministic()("samples", "channels", "sample_rate", "label"))


def blocks_with_context(chunks: DataFrame, span: Column, before: Column, after: Column) -> DataFrame:
    """Chunk pieces by (recording, block): each block of `span` frames with some context on both sides.

    A chunk is cut to what each block needs, so no task ever holds a whole
    recording, however long its chunks are.
    """
    first, last = F.col("start_frame"), F.col("start_frame") + F.size("samples") - 1
    blocks = F.sequence(F.greatest(F.floor((first - after) / span), F.lit(0)), F.floor((last + before) / span))
    others = [c for c in chunks.columns if c not in ("start_frame", "samples")]
    spread = chunks.where(F.size("samples") > 0).select(*others, "start_frame", "samples", F.explode(blocks).alias("block"))
    low = F.greatest(F.col("block") * span - before, first)
    high = F.least((F.col("block") + 1) * span + after, last + 1)
    piece = F.slice("samples", (low - first + 1).cast("int"), (high - low).cast("int"))
    return spread.where(high > low).select(*others, "block", low.alias("start_frame"), piece.alias("samples"))


def _joined(recording, pdf: pd.DataFrame, begin: int) -> tuple[int, np.ndarray]:
    """(first frame, samples) of a block's pieces put together; they must begin at `begin` and leave no gap."""
    pdf = pdf.sort_values("start_frame")
    starts, lengths = pdf["start_frame"].to_numpy(), pdf["samples"].map(len).to_numpy()
    if (starts[1:] != starts[:-1] + lengths[:-1]).any():
        raise ValueError(f"recording {recording}: chunks overlap or leave a gap after frame {starts[0]}")
    if starts[0] != begin:
        raise ValueError(f"recording {recording}: frames {begin} to {starts[0] - 1} are missing")
    return int(starts[0]), np.concatenate([np.asarray(x, dtype=np.float32) for x in pdf["samples"]])


def resample_chunks(chunks: DataFrame, target: int = dsp.RATE, block_seconds: int = 60) -> DataFrame:
    """Recordings at the target rate, as chunks of `block_seconds`.

    `chunks` has recording_id, sample_rate, start_frame and samples.  Each block
    sees enough context for the filter, so the result equals resampling the
    recording whole.
    """
    rate = F.col("sample_rate")
    context = rate * 1
    pieces = blocks_with_context(chunks.select("recording_id", "sample_rate", "start_frame", "samples"), rate * block_seconds, context, context)
    rec = chunks.schema["recording_id"].dataType.simpleString()

    def convert(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        recording, rate, block = key
        origin, x = _joined(recording, pdf, max(0, (block * block_seconds - 1) * int(rate)))
        # One second is a whole number of samples at both rates, so cuts at seconds stay aligned.
        skip = (block * block_seconds - origin // rate) * target
        y = dsp.resample(x.astype(np.float64), int(rate), target)[skip : skip + block_seconds * target].astype(np.float32)
        row = (recording, target, block * block_seconds * target, y)
        rows = [row] if len(y) else []
        return pd.DataFrame(rows, columns=["recording_id", "sample_rate", "start_frame", "samples"]).astype({"recording_id": object, "samples": object})

    return pieces.groupBy("recording_id", "sample_rate", "block").applyInPandas(
        convert, f"recording_id {rec}, sample_rate int, start_frame bigint, samples array<float>"
    )


def map_windows(
    chunks: DataFrame, size: int, hop: int, apply: Callable[[np.ndarray], list], returns: str,
    rate: int = dsp.RATE, block_seconds: float = 60.0, batch: int = 256,
) -> DataFrame:
    """One row per window of every recording: its index and times, and `apply`'s value for it.

    Windows end at hop, 2*hop, ... and at the end of the recording, and hold the
    last `size` samples, zero-padded on the left at the start.  `apply` maps
    [batch, size] to one value per window, inside the task: the windows, many
    times larger than the recording, are never stored.
    """
    span = max(1, int(block_seconds * rate) // hop) * hop
    pieces = blocks_with_context(chunks.select("recording_id", "start_frame", "samples"), F.lit(span), F.lit(size), F.lit(0))
    rec = chunks.schema["recording_id"].dataType.simpleString()
    schema = f"""recording_id {rec}, window_index bigint, start_seconds double, end_seconds double, left_padding_seconds double, value {returns}"""

    def windows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        recording, block = key
        origin, audio = _joined(recording, pdf, max(0, block * span - size))
        stop = origin + len(audio)
        ends = np.arange(block * span + hop, stop + 1, hop)
        if stop > block * span and (ends.size == 0 or ends[-1] != stop):
            ends = np.append(ends, stop)
        view = np.lib.stride_tricks.sliding_window_view(np.pad(audio, (size, 0)), size)
        values = []
        for at in range(0, len(ends), batch):
            values += list(apply(view[ends[at : at + batch] - origin]))
        return pd.DataFrame({
            "recording_id": pd.Series([recording] * len(ends), dtype=object),
            "window_index": -(-ends // hop) - 1,
            "start_seconds": np.maximum(0, ends - size) / rate,
            "end_seconds": ends / rate,
            "left_padding_seconds": np.maximum(0, size - ends) / rate,
            "value": pd.Series(values, dtype=object),
        })

    return pieces.groupBy("recording_id", "block").applyInPandas(windows, schema)


def sliding_windows(chunks: DataFrame, size: int, hop: int, rate: int = dsp.RATE, block_seconds: float = 10.0) -> DataFrame:
    """The windows themselves, for inspection or small data; `score_windows` avoids storing them."""
    out = map_windows(chunks, size, hop, list, "array<float>", rate, block_seconds)
    return out.withColumnRenamed("value", "samples")


def score_windows(
    chunks: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], classes: int, size: int, hop: int,
    rate: int = dsp.RATE, block_seconds: float = 60.0,
) -> DataFrame:
    """Window rows with the model's scores (an array by label id)."""

    def apply(x: np.ndarray) -> list:
        scores = np.asarray(scorer(x), dtype=np.float64)
        if scores.shape != (len(x), classes) or not np.isfinite(scores).all():
            raise ValueError(f"expected finite scores [{len(x)}, {classes}], got {scores.shape}")
        return list(scores)

    return map_windows(chunks, size, hop, apply, "array<double>", rate, block_seconds).withColumnRenamed("value", "scores")


def piece(samples: Column, start: Column, end: Column) -> Column:
    return F.slice(samples, (start + 1).cast("int"), (end - start).cast("int"))
