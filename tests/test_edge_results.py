"""Cases that the registered queries' tables do not hold."""

import pytest
from pyspark.sql import functions as F

from chirrup.operators import clips, curation, events, joins
from chirrup.streaming import detector
from tests.test_streaming import replay


def test_split_leakage_lists_every_split(spark):
    df = spark.createDataFrame([(s, "x") for s in ("a", "m", "z", "m", "q")], "split string, speaker_group string")
    assert [tuple(r.splits) for r in curation.split_leakage(df, ("speaker_group",)).collect()] == [("a", "m", "q", "z")]


def test_heldout_overlap_compares_resolved_paths(spark):
    pool = spark.createDataFrame([("a/b.wav", "")], "path string, source_group string")
    held = spark.createDataFrame([("a/./b.wav", ""), ("c.wav", "")], "path string, source_group string")
    assert [(r.path, r.shared) for r in joins.heldout_overlap(pool, held).collect()] == [("a/./b.wav", "path")]


def test_unknown_label_stops_the_job(spark):
    labels = spark.createDataFrame([("yes", 0)], "label string, label_id bigint")
    rows = spark.createDataFrame([("yes",), ("nope",)], "label string")
    with pytest.raises(Exception, match="unknown label: nope"):
        joins.encode_labels(rows, labels).collect()


def test_absent_first_chunk_is_an_error(spark):
    chunks = spark.createDataFrame([("r", 50, [float(i) for i in range(50)])], "recording_id string, start_frame bigint, samples array<float>")
    with pytest.raises(Exception, match="frames 0 to 49 are missing"):
        clips.sliding_windows(chunks, 20, 10, rate=10, block_seconds=100.0).collect()


def test_stream_takes_windows_of_equal_time(spark, tmp_path):
    rows = [("r", 0, 1.0, "go", 0.9), ("r", 1, 1.0, "go", 0.9), ("r", 2, 1.1, "go", 0.9)]
    df = spark.createDataFrame(rows, "recording_id string, window_index bigint, time_seconds double, predicted_label string, confidence double")
    batch = events.decode_events(df, consecutive=2).collect()
    stream = replay(spark, tmp_path, df, [df], lambda s: detector.stream_decode_events(s, ["go"], consecutive=2)).collect()
    assert len(batch) == len(stream) == 1


def test_a_recording_listed_twice_keeps_its_own_positions(spark):
    rows = spark.createDataFrame([("", "x.wav", "yes", 0), ("", "x.wav", "yes", 1)], "folder string, wav string, label string, record_index bigint")
    full = rows.withColumns({c: F.lit(None).cast("string") for c in ("text", "speaker", "condition")})
    out = curation.session_records(full, "me", "me_", keep=("folder", "record_index")).collect()
    assert sorted(r.record_index for r in out) == [0, 1]
