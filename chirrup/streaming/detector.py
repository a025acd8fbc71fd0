"""The detector on live streams: windows, events and alarm rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EPS = 1e-9
NEVER = float("-inf")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Processors with typed state need a state store with column families; one that the session names already stays."""
    if spark.conf.get(PROVIDER, "").rsplit(".", 1)[-1] in ("", "HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)


def _time_mode(idle_ms: int | None) -> str:
    return "None" if idle_ms is None else "ProcessingTime"


class _Windows(StatefulProcessor):
    """Windows of one block of one recording.  State: the last samples, and where the known audio ends."""

    def __init__(self, size: int, hop: int, rate: int, block: int, idle_ms: int | None):
        self.size, self.hop, self.rate, self.block, self.idle_ms = size, hop, rate, block, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tail", "tail binary, end_frame bigint", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recording, block = key
        chunks = sorted((int(at), own, x) for frame in rows for at, own, x in zip(frame["start_frame"], frame["own"], frame["samples"]))
        if self.state.exists():
            tail, end = self.state.get()
            tail = np.frombuffer(tail, dtype=np.float32)
        else:
            tail, end = np.zeros(0, dtype=np.float32), None
        begin, size, out = max(0, block * self.block - self.size), self.size, []
        for at, own, samples in chunks:
            if end is not None and at < end:
                if own:
                    out.append((recording, at // self.hop, None, None, None, None, True))
                continue
            if at > (begin if end is None else end):
                raise ValueError(f"recording {recording}: audio is missing from frame {begin if end is None else end} to {at}")
            new = np.asarray(samples, dtype=np.float32)
            tail, end = np.concatenate([tail, new])[-size:], at + len(new)
            if own:
                window = np.concatenate([np.zeros(size - min(len(tail), end), dtype=np.float32), tail])[-size:]
                out.append((recording, at // self.hop, max(0, end - size) / self.rate, end / self.rate, max(0, size - end) / self.rate, window, False))
        # A block that is complete keeps only its end, which tells late chunks.
        self.state.update((b"" if end >= (block + 1) * self.block else tail.tobytes(), end))
        names = ["recording_id", "window_index", "start_seconds", "end_seconds", "left_padding_seconds", "samples", "late"]
        yield pd.DataFrame(out, columns=names).astype({"recording_id": object, "samples": object, **dict.fromkeys(names[2:5], "Float64")})

    def close(self) -> None:
        pass


def stream_sliding_windows(
    chunks: DataFrame, size: int, hop: int, rate: int = 16000, block_seconds: float = 60.0, idle_ms: int | None = None
) -> DataFrame:
    """One window per arriving chunk: the last `size` samples, zero-padded on the left at the start.

    `chunks` has recording_id, start_frame (a multiple of `hop`) and samples, one hop; the last may be
    shorter.  A recording is dealt to tasks by blocks; the last chunks before a
    block go there too, so a long or busy recording is no hot key and a task
    sorts at most a block.  The state of a block is its last `size` samples,
    and only its end once it is complete.  A chunk that starts before its
    block's known end is late: it gives a row with `late` and no samples.  One
    that starts after it means lost audio and stops the query.  With `idle_ms`, state that
    no row touched for so long, in processing time, is given up; such a query
    runs on and is not for the trigger availableNow, which would never end it.
    """
    keyed_state(chunks.sparkSession)
    rec = chunks.schema["recording_id"].dataType.simpleString()
    block = max(round(block_seconds * rate) // hop, -(-size // hop), 1) * hop
    output = f"""recording_id {rec}, window_index bigint, start_seconds double, end_seconds double, left_padding_seconds double,
    samples array<float>, late boolean"""
    home = F.floor(F.col("start_frame") / block)
    near = F.col("start_frame") + F.size("samples") > (home + 1) * block - size
    spread = chunks.select(
        "recording_id", "start_frame", "samples", home.alias("_home"), F.explode(F.when(near, F.array(home, home + 1)).otherwise(F.array(home))).alias("block")
    )
    rows = spread.select("recording_id", "block", "start_frame", (F.col("block") == F.col("_home")).alias("own"), "samples")
    return rows.groupBy("recording_id", "block").transformWithStateInPandas(
        _Windows(size, hop, rate, block, idle_ms), output, "append", _time_mode(idle_ms)
    )


class _Decoder(StatefulProcessor):
    """One class of a bucket of recordings.  State of each: the active run, whether it is armed, since when it is inactive, its last emission."""

    FIELDS = {"recording": "string", "run": "int", "armed": "boolean", "since": "double", "last": "double", "newest": "double", "newest_index": "bigint", "touched": "bigint"}

    def __init__(self, consecutive: int, release: float, cooldown: float, idle_ms: int | None):
        self.consecutive, self.release, self.cooldown, self.idle_ms = consecutive, release, cooldown, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"{name} array<{kind}>" for name, kind in self.FIELDS.items())
        self.state = handle.getValueState("class", fields, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        label = key[1]
        columns = ("recording", "time_seconds", "window_index", "hit", "confidence", "reports")
        parts = [[frame[c].to_numpy() for c in columns] for frame in rows]
        recordings, times, indexes, hits, confidences, reports = (np.concatenate(c) for c in zip(*parts))
        now = 0 if self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs()
        known = {}
        if self.state.exists():
            kept = zip(*self.state.get())
            known = {r: one for r, *one in kept if self.idle_ms is None or now - one[-1] < self.idle_ms}
        out = []
        for i in np.lexsort((indexes, times)):
            recording, t, k = recordings[i], float(times[i]), int(indexes[i])
            # `since` is infinite while the class is active or unseen: never long enough to re-arm it.
            run, armed, since, last, newest, index, _ = known.get(recording) or (0, True, float("inf"), NEVER, NEVER, -1, 0)
            if (t, k) <= (newest, index):
                known[recording] = (run, armed, since, last, newest, index, now)
                if reports[i]:
                    out.append((recording, k, None, t, confidences[i], True))
                continue
            if not hits[i]:
                run, since = 0, min(since, t)
                armed = armed or t - since + EPS >= self.release
            else:
                run, since = run + 1, float("inf")
                if armed and run >= self.consecutive and t - last + EPS >= self.cooldown:
                    armed, last = False, t
                    out.append((recording, k, label, t, confidences[i], False))
            known[recording] = (run, armed, since, last, t, k, now)
        self.state.update(tuple(list(c) for c in zip(*((r, *one) for r, one in known.items()))))
        names = ["recording_id", "window_index", "label", "time_seconds", "confidence", "late"]
        yield pd.DataFrame(out, columns=names).astype({"recording_id": object, "label": object})

    def close(self) -> None:
        pass


def stream_decode_events(
    windows: DataFrame,
    commands: list[str],
    threshold: float = 0.5,
    consecutive: int = 2,
    release: float = 0.3,
    cooldown: float = 1.0,
    idle_ms: int | None = None,
    buckets: int = 256,
) -> DataFrame:
    """Detections from a stream of windows, under the rules of `operators.events.decode_events`.

    State is kept per recording and class, so every window goes to each command
    class as a narrow row that says whether it is the class's own.  Recordings
    are dealt into buckets by a hash: a bucket's states of a class are read and
    written together, for a call per recording costs far more than its rows.
    `buckets` stays the same as long as a checkpoint is used.  Rows of a
    micro-batch are taken in the order of time and window; a row not after the
    recording's last one in that order is late: it is put out as a row with
    `late` and no label, whether or not the recording emits anything.
    `idle_ms` as in `stream_sliding_windows`.
    """
    keyed_state(windows.sparkSession)
    rec = windows.schema["recording_id"].dataType
    output = "recording_id string, window_index bigint, label string, time_seconds double, confidence double, late boolean"
    named = F.array(*map(F.lit, commands))
    spread = windows.select("recording_id", "window_index", "time_seconds", "predicted_label", "confidence", F.explode(named).alias("label"))
    own = F.coalesce(F.col("predicted_label") == F.col("label"), F.lit(False))
    spoken = F.coalesce(F.col("predicted_label").isin(*commands), F.lit(False))
    # As a string: pandas would make floats of whole numbers where one is null.
    recording = F.col("recording_id").cast("string")
    rows = spread.select(
        F.pmod(F.xxhash64(recording), F.lit(buckets)).cast("int").alias("bucket"), "label", recording.alias("recording"),
        "time_seconds", "window_index", (own & F.coalesce(F.col("confidence") >= threshold, F.lit(False))).alias("hit"), "confidence",
        (own | (~spoken & (F.col("label") == commands[0]))).alias("reports"),
    )
    found = rows.groupBy("bucket", "label").transformWithStateInPandas(
        _Decoder(consecutive, release, cooldown, idle_ms), output, "append", _time_mode(idle_ms)
    )
    return found.withColumn("recording_id", F.col("recording_id").cast(rec))


def stream_detection_rate(detections: DataFrame, time: str, period: str, watermark: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Detections per period (and per hour) once the watermark has passed the period's end.

    On command-free audio this is the false-alarm rate.
    """
    counted = detections.withWatermark(time, watermark).groupBy(F.window(time, period), *keys).agg(F.count("*").alias("fp"))
    hours = (F.unix_micros("window.end") - F.unix_micros("window.start")) / F.lit(3.6e9)
    return counted.select(
        F.col("window.start").alias("period_start"), F.col("window.end").alias("period_end"), *keys, "fp", (F.col("fp") / hours).alias("fp_per_hour")
    )
