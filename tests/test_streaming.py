"""Stateful operators over micro-batches, with late and shuffled rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirrup.operators import clips, events
from chirrup.streaming import detector


def replay(spark, tmp_path, df, parts, build):
    """Several files a part; each part is one micro-batch of a query that takes up its checkpoint."""
    source = str(tmp_path / "in")
    for part in parts:
        part.repartition(4).write.mode("append").parquet(source)
        out = build(spark.readStream.schema(df.schema).parquet(source))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


def test_stream_decoder_equals_batch_and_drops_late_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for rec in range(6):
        label = "a"
        for i in range(90):
            label = label if rng.random() < 0.7 else rng.choice(["a", "b", "quiet"])
            rows.append((rec, i, (i + 1) * 0.1, label, round(rng.random(), 2)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "recording_id bigint, window_index bigint, time_seconds double, predicted_label string, confidence double")
    t = F.col("time_seconds")
    late = df.where((t > 1) & (t < 2))
    parts = [df.where(t < 3), df.where((t >= 3) & (t < 6)).unionByName(late), df.where(t >= 6)]
    got = replay(spark, tmp_path, df, parts, lambda s: detector.stream_decode_events(s, ["a", "b"], 0.3, 2, 0.3, 1.0)).collect()
    found = [r for r in got if not r.late]
    want = events.decode_events(df, ("quiet",), 0.3, 2, 0.3, 1.0).collect()
    key = lambda r: (r.recording_id, r.window_index, r.label, r.time_seconds, r.confidence)
    assert sorted(map(key, found)) == sorted(map(key, want)) and len(want) > 10
    lates = {(r.recording_id, r.window_index) for r in got if r.late}
    assert lates == {(r.recording_id, r.window_index) for r in late.collect()} and all(r.label is None for r in got if r.late)


def test_lates_of_a_silent_recording_are_put_out(spark, tmp_path):
    df = spark.createDataFrame([(1, i, i * 1.0, "quiet", 0.9) for i in range(8)], "recording_id bigint, window_index bigint, time_seconds double, predicted_label string, confidence double")
    parts = [df.where("window_index >= 4"), df.where("window_index < 4"), df.where("window_index = 7")]
    got = replay(spark, tmp_path, df, parts, lambda s: detector.stream_decode_events(s, ["a", "b"])).collect()
    assert sorted((r.window_index, r.late, r.label) for r in got) == [(i, True, None) for i in (0, 1, 2, 3, 7)]


def test_stream_decoder_keeps_states_by_bucket(spark, tmp_path):
    """Many recordings, one of them null, need no more states than buckets times classes."""
    rng = random.Random(9)
    rows = [(None if rec == 7 else 2**60 + rec, i, i * 0.1, rng.choice("aab"), round(rng.random(), 2)) for rec in range(60) for i in range(20)]
    df = spark.createDataFrame(rows, "recording_id bigint, window_index bigint, time_seconds double, predicted_label string, confidence double")
    source, sink, marks = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for part in (df.where("window_index < 9"), df.where("window_index >= 9")):
        part.write.mode("append").parquet(source)
        out = detector.stream_decode_events(spark.readStream.schema(df.schema).parquet(source), ["a", "b"], 0.2, 2, 0.2, 0.3, buckets=4)
        q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination()
        assert 0 < q.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= 4 * 2
    got = spark.read.schema(out.schema).parquet(sink)
    assert got.schema["recording_id"].dataType == df.schema["recording_id"].dataType and got.where("late").isEmpty()
    want = events.decode_events(df.na.fill(-1, ["recording_id"]), (), 0.2, 2, 0.2, 0.3)
    key = lambda r: (-1 if r.recording_id is None else r.recording_id, r.window_index, r.label)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and want.count() > 60


def test_stream_decoder_gives_up_idle_recordings_of_a_busy_bucket():
    import pandas as pd

    class State:
        value = None

        def getValueState(self, *_):
            return self

        def getCurrentProcessingTimeInMs(self):
            return self.now

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    state, decoder = State(), detector._Decoder(2, 0.3, 1.0, 1000)
    decoder.init(state)

    def step(now, *recordings):
        state.now = now
        frame = pd.DataFrame({"recording": recordings, "time_seconds": 5.0, "window_index": 5, "hit": True, "confidence": 0.5, "reports": True})
        out = pd.concat(decoder.handleInputRows((0, "a"), iter([frame]), state))
        return sorted(out["recording_id"][out["late"].astype(bool)])

    assert step(0, "x", "y") == [] and step(900, "y") == ["y"] and step(1500, "x", "y") == ["y"]


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [(rec, at, [float(rec * 1000 + at + i) for i in range(min(4, 11 - at))]) for rec in range(3) for at in range(0, 11, 4)]
    df = spark.createDataFrame(rows, "recording_id bigint, start_frame bigint, samples array<float>")
    s = F.col("start_frame")
    parts = [df.where(s < 4), df.where(s == 4).unionByName(df.where(s == 0)), df.where(s > 4)]
    got = replay(spark, tmp_path, df, parts, lambda x: detector.stream_sliding_windows(x, 6, 4)).collect()
    want = clips.sliding_windows(df, 6, 4).collect()
    key = lambda r: (r.recording_id, r.window_index, r.start_seconds, r.end_seconds, r.left_padding_seconds, tuple(np.array(r.samples)))
    assert sorted(key(r) for r in got if not r.late) == sorted(map(key, want))
    assert sorted((r.recording_id, r.window_index, r.samples) for r in got if r.late) == [(rec, 0, None) for rec in range(3)]


@pytest.mark.parametrize("block", [8, 12, 40])
def test_stream_windows_cross_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    x = rng.normal(size=102).astype(np.float32)
    rows = [("r", at, [float(v) for v in x[at : at + 4]]) for at in range(0, 102, 4)]
    df = spark.createDataFrame(rows, "recording_id string, start_frame bigint, samples array<float>")
    s = F.col("start_frame")
    parts = [df.where(s < 36), df.where((s >= 36) & (s < 64)), df.where(s >= 64), df.where("start_frame = 40")]
    got = replay(spark, tmp_path, df, parts, lambda d: detector.stream_sliding_windows(d, 7, 4, block_seconds=block / 16000)).collect()
    want = {r.window_index: r.samples for r in clips.sliding_windows(df, 7, 4).collect()}
    assert {r.window_index: r.samples for r in got if not r.late} == want and len(want) == 26
    assert [r.window_index for r in got if r.late] == [10]


def test_stream_windows_stop_on_lost_audio(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, [1.0]), (1, 5, [2.0])], "recording_id bigint, start_frame bigint, samples array<float>")
    with pytest.raises(Exception, match="audio is missing"):
        replay(spark, tmp_path, df, [df], lambda x: detector.stream_sliding_windows(x, 6, 1))
