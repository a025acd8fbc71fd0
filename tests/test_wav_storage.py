"""WAV files read by ranges, written by committed attempts, audited in one pass; datasets and recordings end to end."""

import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirrup.functions import wav
from chirrup.functions.ranges import Store, split_uri
from chirrup.plans import clean, continuous, validate
from chirrup.sources import annotations, audio, manifests, reports, wav_sink, wav_source
from tests.test_audio import build_dataset, loudness, run_clean, tone, write

RNG = np.random.default_rng(5)


def test_paths_of_stores():
    assert split_uri("/a/b") == (None, "/a/b") and split_uri("file:///a") == (None, "/a") and split_uri("file:/a") == (None, "/a")
    assert split_uri("hdfs://n:1/a/b") == ("hdfs://n:1", "/a/b") and split_uri("s3://bucket/k") == ("s3://bucket", "/k")


def test_headers_are_read_without_samples(spark, tmp_path):
    write(tmp_path / "a/long.wav", np.zeros(2_000_000), 8000, 2)
    big = wav.wrap(np.zeros(1_000_000, "<f4").tobytes(), 16000, 1, 32, wav.IEEE_FLOAT)
    note = b"LIST" + struct.pack("<I", 300_000) + bytes(300_000)
    (tmp_path / "noted.wav").write_bytes(big[:12] + note + big[12:])
    wide = b"ds64" + struct.pack("<IQQQI", 28, 0, 4_000_000, 0, 0)
    body = big[12:].replace(b"data" + struct.pack("<I", 4_000_000), b"data" + struct.pack("<I", wav.UNKNOWN))
    (tmp_path / "wide.wav").write_bytes(b"RF64" + struct.pack("<I", wav.UNKNOWN) + b"WAVE" + wide + body)
    (tmp_path / "broken.wav").write_bytes(b"RIFF1234WAVEfmt ")
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(big)
    store = Store()
    assert wav_source.probe(store, f"{tmp_path}/a/long.wav") == (8000, 2, 1_000_000, None)
    assert wav_source.probe(store, f"{tmp_path}/noted.wav")[2] == wav_source.probe(store, f"{tmp_path}/wide.wav")[2] == 1_000_000
    assert store.taken < 2500
    got = {r.path: (r.sample_rate, r.frames, r.fault) for r in wav_source.read_wavs(spark, str(tmp_path), "headers").collect()}
    assert got["a/long.wav"] == (8000, 1_000_000, None) and got["wide.wav"] == (16000, 1_000_000, None) and len(got) == 5
    assert got["broken.wav"] == (None, None, "missing_wav_chunk") and got["empty.wav"] == (None, None, "not_a_wav_file")
    assert wav_source.read_wavs(spark, str(tmp_path), "headers", glob="z*").count() == 0


@pytest.mark.parametrize("bytes_a_task", [700, 4096, 1 << 20])
def test_ranges_give_every_chunk_once(spark, tmp_path, bytes_a_task):
    x = np.round(RNG.uniform(-1, 1, 8000) * 32000) / 32768
    for name, n in (("one", 8000), ("two", 3333), ("none", 0)):
        (tmp_path / f"{name}.wav").write_bytes(wav.wrap(np.rint(x[:n] * 32768).astype("<i2").tobytes(), 1000, 1))
    rows = wav_source.read_wavs(spark, str(tmp_path), rangebytes=bytes_a_task, seconds=0.25)
    got = rows.orderBy("path", "start_frame").collect()
    for name, n in (("one", 8000), ("two", 3333)):
        mine = [r for r in got if r.path == f"{name}.wav"]
        assert [r.start_frame for r in mine] == list(range(0, n, 250)) and {r.frames for r in mine} == {n}
        np.testing.assert_allclose(np.concatenate([r.samples for r in mine]), x[:n], atol=1e-6)
    assert not [r for r in got if r.path == "none.wav"]
    tasks = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 20 if bytes_a_task == 700 else tasks >= 1


def test_a_range_reads_its_own_bytes_only(tmp_path):
    (tmp_path / "x.wav").write_bytes(wav.wrap(bytes(2_000_000), 16000))
    store = Store()
    found = list(wav_source.chunks_of(store, f"{tmp_path}/x.wav", 1_000_000, 1_200_000, 0.5))
    assert [r[3] for r in found] == list(range(504_000, 600_000, 8000)) and store.taken < 2 * 8000 * len(found) + wav.HEAD + 100


def test_audit_in_blocks(spark, tmp_path):
    x = RNG.normal(size=5000).astype("<f4")
    bad = x.copy()
    bad[-1] = np.inf
    made = {"ok": x, "bad": bad}
    for name, values in made.items():
        (tmp_path / f"{name}.wav").write_bytes(wav.wrap(values.tobytes(), 16000, 1, 32, wav.IEEE_FLOAT))
    (tmp_path / "text.wav").write_bytes(b"no sound")
    for block in (7, 1000, 1 << 20):
        for name in made:
            size, rate, channels, frames, finite, digest, fault = wav_source.audit(Store(), f"{tmp_path}/{name}.wav", block)
            assert (rate, channels, frames, finite, fault) == (16000, 1, 5000, name == "ok", None)
            assert digest == hashlib.sha256((tmp_path / f"{name}.wav").read_bytes()).hexdigest() and size == 20044
    paths = spark.createDataFrame([("ok.wav",), ("ok.wav",), ("text.wav",), ("gone.wav",), (None,)], "path string")
    got = {r.path: r for r in wav_source.audit_files(paths, str(tmp_path)).collect()}
    assert set(got) == {"ok.wav", "text.wav"} and got["text.wav"].fault == "not_a_wav_file" and len(got["text.wav"].sha256) == 64


def test_read_clips_opens_only_named_files(spark, tmp_path):
    write(tmp_path / "a.wav", tone(800))
    write(tmp_path / "b.wav", tone(800), 8000)
    (tmp_path / "c.wav").write_bytes(b"junk")
    (tmp_path / "unnamed.wav").write_bytes(b"junk")
    rows = spark.createDataFrame([("a.wav", 1), ("a.wav", 2), ("b.wav", 3), ("c.wav", 4), ("d.wav", 5)], "path string, n int")
    got = {r.n: (r.fault, len(r.samples or [])) for r in wav_source.read_clips(rows, str(tmp_path)).collect()}
    assert got == {1: (None, 800), 2: (None, 800), 3: ("expected_mono_at_rate", 800), 4: ("not_a_wav_file", 0), 5: ("missing_audio", 0)}


def test_files_are_published_once_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = spark.range(40).select(F.concat(F.lit("d/"), "id", F.lit(".bin")).alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    assert wav_sink.write_files(rows.repartition(5), root) == 40
    files = {name: open(f"{root}/{name}", "rb").read() for name, _ in Store().files(root) if name.startswith("d/")}
    assert files == {f"d/{i}.bin": str(i).encode() for i in range(40)} and not (tmp_path / "out/_attempts").exists()
    with pytest.raises(FileExistsError):
        wav_sink.write_files(rows, root)
    with pytest.raises(ValueError, match="several rows"):
        wav_sink.write_files(rows.union(rows), str(tmp_path / "twice"))
    for path, content in (("../up", "x"), ("a", None)):
        bad = rows.union(spark.createDataFrame([(path, content)], "path string, content string").select("path", F.col("content").cast("binary")))
        with pytest.raises(Exception, match="a file needs content"):
            wav_sink.write_files(bad, str(tmp_path / "bad"))
        assert not Store().files(str(tmp_path / "bad"))


def test_publishing_goes_on_after_a_failure_and_ignores_other_attempts(spark, tmp_path):
    root = tmp_path / "out"
    for folder, names in (("0-a", ["x", "y"]), ("1-b", ["z"]), ("1-lost", ["z", "w"])):
        for name in names:
            (root / "_attempts" / folder / "s").mkdir(parents=True, exist_ok=True)
            (root / "_attempts" / folder / "s" / name).write_text(folder)
    (root / "_committed.json").write_text(json.dumps([{"folder": "0-a", "files": 2, "size": 6}, {"folder": "1-b", "files": 1, "size": 3}]))
    (root / "s").mkdir()
    (root / "_attempts/0-a/s/x").rename(root / "s/x")  # as an earlier try left it
    assert wav_sink.publish(spark, str(root)) == 3
    assert {p.name: p.read_text() for p in (root / "s").iterdir()} == {"x": "0-a", "y": "0-a", "z": "1-b"}


def test_cleaned_dataset_is_a_dataset(spark, tmp_path):
    """Clean, write, load and validate: what the cleaner writes is what the loader reads."""
    labels = spark.createDataFrame([("next", 0), ("unknown", 1), ("background", 2)], "label string, label_id bigint")
    rows = build_dataset(tmp_path / "data")
    out = run_clean(spark, tmp_path / "data", labels)
    target = tmp_path / "out"
    reports.write_curated(out["accepted"], out["excluded"], F.col("partition") == "held_out", out["report"], str(target), labels)
    known = manifests.load_labels(spark, f"{target}/labels.json")
    assert sorted(map(tuple, known.collect())) == [("background", 2), ("next", 0), ("unknown", 1)]
    back = manifests.load_manifest(spark, str(target), known).orderBy("split", "record_index").collect()
    assert [(r.split, r.id) for r in back] == [(s, f"{s}_{n}") for s in ("test", "train", "val") for n in ("next", "unknown", "background")]
    assert [r.record_index for r in back] == [0, 1, 2] * 3
    for r in back:
        assert r.path == f"audio/dataset/{r.id}.wav" and r.sha256 == hashlib.sha256((target / r.path).read_bytes()).hexdigest()
    assert {(r.split, r.label, r.n) for r in validate.validate_folder_strict(spark, str(target)).collect()} == {(s, n, 1) for s in rows for n in ("next", "unknown", "background")}
    texts = [p for p in target.rglob("*.json") if p.name.startswith("part-")]
    assert texts and not any("samples" in p.read_text() for p in texts)
    assert len(list(target.glob("audio/session/*.wav"))) == 1
    (target / back[0].path).write_bytes(b"damaged")
    _, faults = validate.validate_folder(spark, str(target))
    assert {r.kind for r in faults.collect()} == {"not_a_wav_file", "checksum_mismatch"}
    (target / back[1].path).unlink()
    with pytest.raises(ValueError, match="dataset validation failed"):
        validate.validate_folder_strict(spark, str(target))


def test_lenient_cleaning_excludes_what_would_stop_it(spark, tmp_path):
    labels = spark.createDataFrame([("next", 0), ("unknown", 1), ("background", 2)], "label string, label_id bigint")
    rows = build_dataset(tmp_path)
    rows["train"][0]["path"] = "../x.wav"
    rows["val"][0]["speaker"] = "Guest"
    for split in ("train", "val"):
        (tmp_path / "splits" / f"{split}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows[split]))
    dataset = manifests.load_manifest(spark, str(tmp_path), labels)
    sessions = manifests.load_session_manifests(spark, str(tmp_path / "sessions"))
    files = audio.read_files(spark, str(tmp_path / "audio")).withColumn("path", F.concat(F.lit("audio/"), "path"))
    out = clean.clean_dataset(dataset, sessions, files, labels, "guest", strict=False)
    found = {r.path: r.reason for r in out["excluded"].collect()}
    assert found["../x.wav"] == "path_outside_root" and found["audio/val_next.wav"] == "held_out_entity_in_training"
    report = out["report"].first()
    assert not report.complete and "train_next" not in {r.id for r in out["accepted"].select("id").collect()}
    assert report.exclusions["path_outside_root"] == 1
    with pytest.raises(ValueError, match="no .*jsonl"):
        manifests.load_session_manifests(spark, str(tmp_path / "audio"))


def test_from_wav_and_annotation_files_to_metrics(spark, tmp_path):
    """A recording of 2 s at 44.1 kHz in stereo, its annotation file, and the metrics of a loudness detector."""
    x = np.zeros(88200)
    x[22050:44100] = tone(22050, 440, 44100, 0.6)
    write(tmp_path / "wavs/take.wav", np.repeat(x, 2), 44100, 2)
    notes = dict(wav="take.wav", sample_rate=44100, frames=88200, annotation_status="reviewed", regions=[dict(label="next", start_frame=22050, end_frame=44100)])
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/take.json").write_text(json.dumps(notes, indent=1))
    labels = spark.createDataFrame([("next", 0), ("unknown", 1)], "label string, label_id bigint")
    recordings, chunks = wav_source.recordings_from(spark, str(tmp_path / "wavs"), seconds=0.3, rangebytes=50_000)
    events = annotations.load_annotations(spark, str(tmp_path / "notes/*.json"), recordings, ["next"])
    assert events.first().asDict() == dict(recording_id="take", event_id=0, label="next", start_seconds=0.5, end_seconds=1.0)
    settings = {"channels": 2, "mono": "mean", "resample": True}
    out = continuous.evaluate_recordings(chunks, events, recordings, labels, loudness(), audio=settings)
    m = out["metrics"].where("label = 'all'").first()
    assert (m.tp, m.fp, m.fn) == (1, 0, 0) and m.median_latency_seconds == pytest.approx(-0.3) and out["windows"].count() == 20
    assert out["windows"].where("emitted").count() == 1
    for change, message in ((dict(annotation_status="draft"), "status"), (dict(error="overflow"), "capture_error"), (dict(frames=1), "clock_mismatch")):
        (tmp_path / "notes/take.json").write_text(json.dumps(notes | change))
        with pytest.raises(ValueError, match=message):
            annotations.load_annotations(spark, str(tmp_path / "notes/*.json"), recordings, ["next"])
    (tmp_path / "notes/take.json").write_text(json.dumps(notes | dict(annotation_status="draft")))
    assert annotations.load_annotations(spark, str(tmp_path / "notes/*.json"), recordings, ["next"], allow_draft=True).count() == 1
    quiet = continuous.evaluate_recordings(chunks, None, recordings, labels, loudness(), audio=settings)["metrics"].collect()
    assert {(r.label, r.true_events, r.detections, r.fp, r.precision, r.recall) for r in quiet} == {("all", 0, 1, 1, 0.0, None), ("next", 0, 1, 1, 0.0, None)}
