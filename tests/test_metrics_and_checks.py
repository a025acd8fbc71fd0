"""Small worked examples of checks and metrics."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirrup.functions import arrays
from chirrup.operators import checks, curation, events, joins, metrics, regions, training
from chirrup.plans import evaluate, validate
from chirrup.sources import annotations, manifests


def labels(spark, *names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "label string, label_id bigint")


def test_confusion_orientation_and_zero_ratios(spark):
    names = labels(spark, "a", "b", "c")
    rows = [(0, 0)] * 2 + [(0, 1)] + [(1, 1)]
    confusion = metrics.confusion_matrix(spark.createDataFrame(rows, "true_id bigint, predicted_id bigint"), names)
    assert confusion.count() == 9
    classes, overall = metrics.classification_metrics(confusion, names)
    got = {r.label: r for r in classes.collect()}
    assert got["a"].recall == pytest.approx(2 / 3) and got["a"].precision == 1.0
    assert got["b"].precision == 0.5 and got["c"].f1 == 0.0 and got["c"].support == 0
    o = overall.first()
    assert (o["count"], o.accuracy) == (4, 0.75)
    supported = metrics.supported_macro_f1(classes).first()[0]
    assert supported == pytest.approx((0.8 + 2 / 3) / 2) and o.macro_f1 == pytest.approx(supported * 2 / 3)
    report = {r.label: r for r in metrics.classification_report(confusion, names).collect()}
    assert report["weighted avg"].recall == pytest.approx(0.75) and report["macro avg"].support == 4


def test_epoch_means_weigh_batches_by_size(spark):
    log = spark.createDataFrame([(1, 1.0, 32, 32), (1, 0.0, 2, 2)], "epoch int, loss double, correct int, size int").withColumn(
        "correct", F.when(F.col("size") == 2, 2).otherwise(F.col("correct") - 2)
    )
    assert training.weighted_epoch_metrics(log, ["epoch"]).first().accuracy == pytest.approx(32 / 34)


def test_early_stop_needs_strict_improvement(spark):
    losses = [3.0, 2.0, 2.0, 2.0, 1.0]
    h = spark.createDataFrame([("r", i + 1, x) for i, x in enumerate(losses)], "run string, epoch int, val_loss double")
    r = training.best_epoch_early_stop(h, 2).first()
    assert (r.best_epoch, r.best_val_loss, r.last_epoch, r.stopped_early) == (2, 2.0, 4, True)
    r = training.best_epoch_early_stop(h, 3).first()
    assert (r.best_epoch, r.last_epoch, r.stopped_early) == (5, 5, False)


def test_length_limit_is_strict_and_spares_exempt_classes(spark):
    rows = [("train", "next", 48000), ("train", "next", 48001), ("train", "unknown", 99999)]
    kept, dropped, counts = checks.filter_long_commands(spark.createDataFrame(rows, "split string, label string, frames bigint"))
    assert sorted(r.frames for r in kept.collect()) == [48000, 99999]
    assert [r.frames for r in dropped.collect()] == [48001] and counts.first().dropped == 1


def test_paths_and_ids(spark):
    cases = {"a/b.wav": True, "../x": False, "a/../..": False, "a/..": False, "": False, "/a": False, "\\a": False, "a\\..\\b": True, "./a": True, "a/../../a/b": False}
    df = checks.path_inside_root(spark.createDataFrame([(k,) for k in cases], "path string"))
    assert {r.path: r.inside_root for r in df.collect()} == cases
    normal = {r.path: r.normal_path for r in df.collect()}
    assert normal["a\\..\\b"] == "b" and normal["a/b.wav"] == "a/b.wav"
    ids = checks.derive_record_id(spark.createDataFrame([("ok_1", "p"), ("", "p"), ("bad id\n", "p"), (None, "p")], "id string, path string")).collect()
    assert [r.safe_id for r in ids] == [True, True, False, True] and len(ids[1].record_id) == 24


def test_label_map_faults(spark):
    def faults(text):
        return manifests.label_faults(manifests.parse_labels(spark.createDataFrame([(text,)], "value string"))).count()

    assert faults('{"a": 0, "b": 1}') == 0
    for bad in ('{"a": 0, "b": 2}', '{"a": 0, "b": 0}', '{"a": 0.5}', "{}", '{"a": 1}'):
        assert faults(bad) == 1, bad


def test_manifest_files_keep_their_order(spark, tmp_path):
    (tmp_path / "splits").mkdir()
    for split in ("train", "val"):
        lines = [f'{{"path": "{split}{i}.wav", "label": "next"}}' for i in range(50)]
        (tmp_path / "splits" / f"{split}.jsonl").write_text("﻿" + "\n\n".join(lines) + "\n", encoding="utf-8")
    rows = manifests.load_manifest(spark, str(tmp_path), labels(spark, "next"), ("train", "val")).collect()
    assert sorted((r.split, r.record_index, r.path) for r in rows) == sorted((s, i, f"{s}{i}.wav") for s in ("train", "val") for i in range(50))
    (tmp_path / "splits" / "val.jsonl").write_text('{"path": "x", "label": "next", "split": "train"}\n')
    with pytest.raises(ValueError, match="wrong_split"):
        manifests.load_manifest(spark, str(tmp_path), labels(spark, "next"), ("train", "val"))
    (tmp_path / "splits" / "val.jsonl").write_text('{"path": "x", "label": "odd"}\n')
    with pytest.raises(ValueError, match="unknown_label"):
        manifests.load_manifest(spark, str(tmp_path), labels(spark, "next"), ("train", "val"))
    (tmp_path / "splits" / "val.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="empty manifest"):
        manifests.load_manifest(spark, str(tmp_path), labels(spark, "next"), ("train", "val"))


def test_leakage_ignores_blanks_and_repeats_inside_a_split(spark):
    rows = [("train", "g", None, ""), ("val", "g", None, ""), ("test", "h", None, "x"), ("test", "h", None, "x"), ("train", "g", "p", "")]
    df = spark.createDataFrame(rows, "split string, speaker_group string, parent_id string, source_group string")
    got = curation.split_leakage(df, curation.GROUP_KINDS).collect()
    assert [(r.kind, r.value, r.splits) for r in got] == [("speaker_group", "g", ["train", "val"])]


def test_mixing_permission_table(spark):
    schema = "name string, use_for_mixing boolean, parent_id string, sample_kind string"
    rows = [
        ("noise", None, None, None), ("allowed", None, "allowed", "source_crop"), ("banned", None, "banned", "source_crop"),
        ("missing", None, "missing", "source_crop"), ("crop_banned", False, "allowed", "source_crop"), ("orphan", None, None, "source_crop"),
        ("procedural", None, "self", "procedural_noise"), ("unflagged", None, "silent", None),
    ]
    sources = spark.createDataFrame([("allowed", True), ("banned", False), ("silent", None)], "id string, use_for_mixing boolean")
    got = checks.mixing_eligibility(spark.createDataFrame(rows, schema), sources).where("eligible").collect()
    assert {r.name for r in got} == {"noise", "allowed", "procedural"}
    with pytest.raises(ValueError, match="duplicate"):
        df = spark.createDataFrame([(*r, "background", "train", r[0], None) for r in rows], schema + ", label string, split string, path string, source_group string")
        validate.build_mixing_pool_strict(df, df.limit(0), sources.union(sources))


def test_scores(spark):
    rows = [([0.5, 0.5],), ([0.5, 0.53],), ([0.51, 0.51],), ([1.2, -0.2],), ([float("nan"), 1.0],), ([1.0],), ([float("inf"), 0.0],)]
    df = spark.createDataFrame(rows, "scores array<double>")
    got = [r.fault for r in checks.check_scores(df, 2, "probabilities").collect()]
    assert got == [None, "sum", None, "range", "nonfinite", "shape", "nonfinite"]
    tie = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>").select(arrays.top1(F.col("p")).alias("i")).first()
    assert tie.i == 0


def test_pairs_and_comparison(spark):
    schema = "record_index bigint, path string, true_label string, predicted_label string, correct int, confidence double"
    old = spark.createDataFrame([(0, "a", "x", "y", 0, 0.6), (1, "b", "x", "x", 1, 0.7)], schema)
    new = spark.createDataFrame([(0, "a", "x", "x", 1, 0.6), (1, "b", "x", "x", 1, 0.7)], schema)
    names = labels(spark, "x", "y")
    got = {r.label: r for r in metrics.paired_comparison(joins.pair_predictions(old, new), names).collect()}
    assert got["all"].improved == 1 and got["all"].delta_accuracy == 0.5 and got["y"]["count"] == 0 and got["y"].old_accuracy is None
    assert joins.alignment_faults(joins.pair_predictions(old, new), 2).count() == 0
    assert joins.alignment_faults(joins.pair_predictions(old, new), 3).count() == 1
    moved = new.withColumn("path", F.lit("z"))
    assert joins.alignment_faults(joins.pair_predictions(old, moved), 2).count() == 1
    with pytest.raises(ValueError, match="identical"):
        evaluate.compare_models_strict(old, new, names, "d", "d", 2)


def event_frames(spark, ev, de):
    return (
        spark.createDataFrame(ev, "recording_id bigint, event_id bigint, label string, start_seconds double, end_seconds double"),
        spark.createDataFrame(de, "recording_id bigint, detection_id bigint, label string, time_seconds double, confidence double"),
    )


def test_event_metrics_worked_example(spark):
    ev, de = event_frames(
        spark,
        [(1, 0, "next", 1.0, 2.0), (1, 1, "next", 4.0, 5.0)],
        [(1, 0, "next", 1.5, 0.8), (1, 1, "next", 2.1, 0.9), (1, 2, "back", 4.5, 0.8)],
    )
    durations = spark.createDataFrame([(1, 10.0), (2, 10.0)], "recording_id bigint, duration_seconds double")
    me, md = events.match_events(ev, de, 0.0, 1.0)
    assert {r.event_id: r.latency_seconds for r in me.collect()} == {0: -0.5, 1: None}
    got = {(r.recording_id, r.label): r for r in events.event_metrics(me, md, ["next", "back", "none"], durations).collect()}
    a = got[1, "all"]
    assert (a.tp, a.fp, a.fn, a.unmatched_detections_per_hour, a.median_latency_seconds) == (1, 2, 1, 720.0, -0.5)
    assert got[1, "back"].precision == 0.0 and got[1, "back"].recall is None
    empty = got[2, "none"]
    assert (empty.tp, empty.precision, empty.recall, empty.f1, empty.median_latency_seconds) == (0, None, None, None, None)


def test_overlapping_events_match_the_one_ending_first(spark):
    ev, de = event_frames(spark, [(1, 0, "next", 0.0, 5.0), (1, 1, "next", 1.0, 2.0)], [(1, 0, "next", 1.5, 0.8), (1, 1, "next", 4.0, 0.8)])
    _, md = events.match_events(ev, de, 0.0, 0.0)
    assert {r.detection_id: r.event_id for r in md.collect()} == {0: 1, 1: 0}


def test_decoder_rearms_only_after_silence(spark):
    times = [(0.1, "next"), (0.2, "next"), (0.8, "next"), (0.9, "unknown"), (1.0, "unknown"), (1.1, "unknown"), (1.2, "next"), (1.3, "next")]
    rows = [(1, i, t, name, 0.9) for i, (t, name) in enumerate(times)]
    df = spark.createDataFrame(rows, "recording_id bigint, window_index bigint, time_seconds double, predicted_label string, confidence double")
    got = events.decode_events(df, ("unknown",), 0.5, 2, 0.2, 0.5)
    assert sorted(r.time_seconds for r in got.collect()) == [0.2, 1.3]


def test_negative_audio_counts_every_detection(spark):
    _, de = event_frames(spark, [(1, 0, "x", 0.0, 1.0)], [(1, 0, "next", 1.0, 0.9)])
    durations = spark.createDataFrame([(1, 2.0), (2, 2.0)], "recording_id bigint, duration_seconds double")
    got = {r.recording_id: r for r in events.negative_audio_rate(de, durations).collect()}
    assert (got[1].fp, got[1].false_positives_per_hour, got[2].fp, got[1].provisional) == (1, 1800.0, 0, True)


def annotation(spark, **changes):
    base = dict(wav="a.wav", sample_rate=44100, frames=88200, annotation_status="reviewed", error=None, regions=[("next", 22050, 44100)])
    row = {**base, **changes}
    return spark.createDataFrame([tuple(row.values())], annotations.ANNOTATION.replace("\n", " "))


def test_annotations_use_the_recordings_clock(spark):
    recordings = spark.createDataFrame([(7, "a.wav", 44100, 88200)], "recording_id bigint, wav string, sample_rate int, frames bigint")
    found, faults = annotations.check_annotations(annotation(spark), recordings, ["next"])
    r = found.first()
    assert (r.recording_id, r.event_id, r.start_seconds, r.end_seconds) == (7, 0, 0.5, 1.0) and faults.count() == 0
    cases = [
        (dict(annotation_status="draft"), "status"), (dict(error="overflow"), "capture_error"), (dict(frames=1), "clock_mismatch"),
        (dict(wav="b.wav"), "unknown_recording"), (dict(regions=None), "no_regions"), (dict(regions=[("odd", 0, 1)]), "bad_region"),
        (dict(regions=[("next", 5, 5)]), "bad_region"), (dict(regions=[("next", 0, 88201)]), "bad_region"), (dict(regions=[("next", None, 3)]), "bad_region"),
    ]
    for change, reason in cases:
        found, faults = annotations.check_annotations(annotation(spark, **change), recordings, ["next"])
        assert [r.reason for r in faults.collect()] == [reason] and found.count() == 0, change
    draft, _ = annotations.check_annotations(annotation(spark, annotation_status="draft"), recordings, ["next"], allow_draft=True)
    assert draft.count() == 1


def test_label_lines(spark, tmp_path):
    recordings = spark.createDataFrame([("a", 16000, 16000)], "recording_id string, sample_rate int, frames bigint")
    names = labels(spark, "next")
    lines = ["0.1\t0.5\tnext", "0\t2\tnext", "nan\t0.5\tnext", "0\t0.5\tbogus", "0.4\t0.2\tnext", "0\t1", " "]
    df = spark.createDataFrame([("a", x) for x in lines], "recording_id string, value string")
    good, bad = annotations.parse_label_lines(df, recordings, names)
    assert [(r.start_frame, r.end_frame) for r in good.collect()] == [(1600, 8000)] and bad.count() == 5
    folder = tmp_path / "labels"
    folder.mkdir()
    (folder / "a.txt").write_text("0.1\t0.5\tnext\n")
    regions_df = annotations.import_labels(spark, str(folder), recordings, names)
    annotations.export_labels(regions_df.withColumn("sample_rate", F.lit(16000)), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["0.100000\t0.500000\tnext"]
    (folder / "a.txt").write_text("0\t2\tnext\n")
    with pytest.raises(ValueError, match="interval"):
        annotations.import_labels(spark, str(folder), recordings, names)


def test_regions_from_keys(spark):
    keys = [(1, 320, 0, "1"), (1, 640, 1, "x"), (1, 960, 2, " "), (1, 1000, 3, "1"), (1, 1000, 4, "2"), (2, 320, 0, "1")]
    totals = spark.createDataFrame([(1, 1280), (2, 816)], "recording_id bigint, frames bigint")
    df = spark.createDataFrame(keys, "recording_id bigint, frame bigint, seq bigint, key string")
    got = regions.build_regions(df, {"1": "next", "2": "back"}, " ", totals, 500)
    want = [(1, "back", 1000, 1280), (1, "next", 320, 960), (2, "next", 320, 816)]
    assert sorted((r.recording_id, r.label, r.start_frame, r.end_frame) for r in got.collect()) == want


def test_validation_report(spark):
    schema = "path string, label string, split string, speaker_group string, parent_id string, source_group string, declared_sha256 string, sha256 string, frames bigint"
    rows = [
        ("a", "next", "train", "g", None, None, "h1", None, None), ("b", "next", "val", "g", None, None, "", None, None),
        ("c", "odd", "test", None, None, None, None, None, None), ("d", "next", "test", None, None, None, "zz", None, None),
        ("e", "next", "test", None, None, None, None, None, None), ("f", "next", "test", None, None, None, None, None, None),
    ]
    files = [("a", 16000, 1, 48001, True, "h1"), ("b", 16000, 1, 48000, True, "h2"), ("c", 8000, 1, 5, True, "h3"), ("d", 16000, 1, 9, False, "h4"), ("e", 16000, 1, 7, True, "h2")]
    counts, faults = validate.validate_dataset(
        spark.createDataFrame(rows, schema), spark.createDataFrame(files, "path string, sample_rate int, channels int, frames bigint, all_finite boolean, sha256 string"), labels(spark, "next")
    )
    got = sorted((r.kind, r.subject or r.split) for r in faults.collect())
    want = [("checksum_mismatch", "d"), ("empty_split", "train"), ("leak_sha256", "h2"), ("leak_speaker_group", "g"), ("missing_audio", "f"), ("nonfinite", "d"), ("sample_rate", "c"), ("unknown_label", "c")]
    assert got == want
    assert {(r.split, r.label, r.n) for r in counts.collect()} == {("val", "next", 1), ("test", "next", 2), ("test", "odd", 1)}


def test_fit_length_examples(spark):
    def fit(n_in, label, **policy):
        x = F.array([F.lit(float(i)) for i in range(n_in)])
        samples, action = arrays.fit_length(x, 10, F.lit(label), **policy)
        r = spark.range(1).select(samples.alias("s"), action.alias("a")).first()
        return r.s, r.a

    assert fit(4, "next") == ([0.0] * 3 + [0.0, 1.0, 2.0, 3.0] + [0.0] * 3, "padded")
    assert fit(4, "next", pad_position="right")[0] == [0.0, 1.0, 2.0, 3.0] + [0.0] * 6
    assert fit(14, "unknown") == ([float(i) for i in range(2, 12)], "cropped")
    assert fit(11, "next", long="skip") == (None, "skipped_long")
    assert fit(11, "next", long="crop")[1] == "cropped" and fit(10, "next")[1] == "unchanged"
    with pytest.raises(Exception, match="exceeds the window"):
        fit(11, "next")


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], T.StructType([T.StructField("s", T.DoubleType())]))
    assert [r[0] for r in df.select(arrays.seconds_to_frame(F.col("s"), 1)).collect()] == [0, 2, 2]
