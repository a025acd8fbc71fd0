"""Signal kernels, audio files, cleaning and whole-recording evaluation on generated sound."""

import hashlib
import json
import math
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirrup.functions import dsp, wav
from chirrup.operators import augment, clips
from chirrup.plans import clean, continuous, evaluate, examples, scoring
from chirrup.sources import audio, manifests, reports

RNG = np.random.default_rng(0)


def tone(n, hz=440.0, rate=16000, level=0.5):
    return level * np.sin(2 * np.pi * hz * np.arange(n) / rate)


def write(path, x, rate=16000, channels=1):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.rint(np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())


def test_wav_kinds():
    x = np.round(RNG.uniform(-1, 1, 100) * 100) / 128
    made = {
        8: wav.wrap((np.rint(x * 128) + 128).astype(np.uint8).tobytes(), 8000, 1, 8),
        16: wav.wrap(np.rint(x * 32768).astype("<i2").tobytes(), 8000, 2),
        32: wav.wrap(np.rint(x * 2147483648).astype("<i4").tobytes(), 8000, 1, 32),
        "f4": wav.wrap(x.astype("<f4").tobytes(), 8000, 1, 32, wav.IEEE_FLOAT),
        "f8": wav.wrap(x.astype("<f8").tobytes(), 8000, 1, 64, wav.IEEE_FLOAT),
    }
    for kind, content in made.items():
        got, h = wav.samples(content)
        np.testing.assert_allclose(got, x, atol=1e-7, err_msg=str(kind))
        assert h["frames"] == (50 if kind == 16 else 100)
    wide = np.rint(x * 8388608).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    extra = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    content = wav.wrap(wide, 8000, 1, 24)
    content = content[:12] + extra + content[12:]
    np.testing.assert_allclose(wav.samples(content)[0], x, atol=1e-7)
    for bad in (b"", b"RIFFxxxxWAVE", made[16][:30], wav.wrap(b"", 8000, 1, 12)):
        with pytest.raises(ValueError):
            wav.header(bad)


def test_resample_keeps_tone_and_length():
    for rate, target in ((44100, 16000), (8000, 16000), (48000, 16000), (110, 100), (90, 100)):
        n = 4000 + rate % 7
        hz = 0.01 * min(rate, target)
        y = dsp.resample(tone(n, hz, rate), rate, target)
        g = math.gcd(rate, target)
        assert len(y) == -(-n * (target // g) // (rate // g))
        inner = slice(len(y) // 4, 3 * len(y) // 4)
        np.testing.assert_allclose(y[inner], tone(len(y), hz, target)[inner], atol=2e-3)


def test_log_mel_shape_and_silence():
    m = dsp.log_mel_matrix(np.zeros(48000))
    assert m.shape == (40, 301) and np.allclose(m, math.log(1e-6))
    x = RNG.normal(size=16000) * 0.1
    whole = dsp.log_mel_matrix(x)
    padded = np.pad(x, 256, mode="reflect")
    frame = padded[160 * 7 : 160 * 7 + 512] * np.pad(np.hanning(481)[:-1], 16)
    k = np.arange(257)
    spectrum = np.array([abs(np.sum(frame * np.exp(-2j * np.pi * b * np.arange(512) / 512))) ** 2 for b in k])
    np.testing.assert_allclose(whole[:, 7], np.log(dsp.mel_bank(16000, 512, 40) @ spectrum + 1e-6), atol=1e-6)


def echo(x, kernel):
    return dsp.echo_rows(*dsp.stacked([x]), [kernel])[0]


def test_reverb_examples(spark):
    x = np.zeros(8)
    x[2] = 0.5
    np.testing.assert_allclose(echo(x, [1.0]), x, atol=1e-9)
    rows = spark.createDataFrame([(0, [0.0, 1.0, 0.0]), (1, [0.1, 1.0, 0.0, 0.5])], "id int, samples array<double>")
    unit, kernel = [r.samples for r in augment.impulse_kernels(rows, "samples", 100).orderBy("id").collect()]
    assert unit == [1.0, 0.0]
    np.testing.assert_allclose(kernel, np.array([1, 0, 0.5]) / math.sqrt(1.25))
    direct = np.convolve(x, kernel)[:8]
    direct *= math.sqrt(np.square(x).sum() / np.square(direct).sum())
    np.testing.assert_allclose(echo(x, kernel), direct, atol=1e-9)
    assert not echo(np.zeros(4), kernel).any()
    # Rows of a block do not touch one another, whatever their lengths.
    both, held = dsp.stacked([x, np.ones(3) * 0.1])
    got = dsp.echo_rows(both, held, [kernel, [0.6, 0.8]])
    np.testing.assert_allclose(got[0], direct, atol=1e-9)
    assert not got[1, 3:].any() and np.square(got[1]).sum() == pytest.approx(0.03)
    silent = spark.createDataFrame([(0, [0.0] * 5)], "id int, samples array<double>")
    with pytest.raises(Exception, match="without energy"):
        augment.impulse_kernels(silent, "samples", 5).collect()


def mixed(x, noise, draw, snr):
    return dsp.mix_rows(*dsp.stacked([x]), [noise], [draw], [snr])[0]


def test_noise_level():
    x, noise = tone(1600, level=0.1), RNG.normal(size=700)
    for n in (noise, RNG.normal(size=5000)):
        y = mixed(x, n, 0.37, 10.0)
        assert 10 * math.log10(np.square(x).mean() / np.square(y - x).mean()) == pytest.approx(10, abs=1e-6)
    assert not mixed(np.zeros(10), noise, 0.1, 10.0).any() and np.array_equal(mixed(x, np.zeros(9), 0.1, 10.0), x)


def test_content_hash_ignores_the_header():
    x = RNG.uniform(-1.2, 1.2, 50)
    want = np.array([round(max(-1.0, min(1.0, v)) * 32767) for v in x], dtype="<i2").tobytes()
    assert dsp.to_pcm16(x) == want


def test_chain_equals_its_steps(spark):
    """The one-pass chain gives what speed, placement, reverb, noise and gain give one after another."""
    n = 400
    rows = [(f"c{i}", ["next", "background"][i % 3 == 0], "train" if i % 5 else "val", [float(v) for v in RNG.normal(size=300 + i) * 0.2]) for i in range(20)]
    pool = spark.createDataFrame([(f"p{i}", [float(v) for v in RNG.normal(size=200 + 100 * i)]) for i in range(3)], "id string, samples array<float>")
    df = spark.createDataFrame(rows, "id string, label string, split string, samples array<float>")
    config = augment.Augmentation(max_rir_seconds=0.01, gain_probability=0.5)
    got = {r.id: (r.speed_rate, r.samples) for r in augment.augment_chain(df, n, config, "id", pool, pool, 7).collect()}
    assert set(got) == {r[0] for r in rows if r[2] == "train"}
    step = augment.random_speed(df.where("split = 'train'"), n, "id", seed=7)
    step = step.withColumn("samples", augment.random_alignment(F.col("samples"), n, F.col("label"), F.col("id"), 7))
    step = augment.random_reverb(step, pool.withColumnRenamed("id", "rir_id"), "id", "rir_id", max_samples=160, seed=7)
    step = augment.background_mix(step, pool.withColumnRenamed("id", "noise_id"), "id", "noise_id", seed=7)
    step = step.withColumn("samples", augment.random_gain(F.col("samples"), F.col("id"), 0.5, seed=7))
    plain = {r.id: (r.speed_rate, r.samples) for r in step.collect()}
    # random_reverb draws with salt rir, the chain likewise; both attach the same pool rows.
    for k, (rate, samples) in got.items():
        assert rate == plain[k][0] and len(samples) == n
        np.testing.assert_allclose(samples, plain[k][1], atol=2e-5)
    again = {r.id: r.samples for r in augment.augment_chain(df.repartition(5), n, config, "id", pool, pool, 7).collect()}
    assert all(again[k] == v[1] for k, v in got.items())
    assert any(again[k] != r.samples for r in augment.augment_chain(df, n, config, "id", pool, pool, 8).collect() for k in [r.id])


def test_commands_are_never_cut(spark):
    df = spark.createDataFrame([("a", "next", [0.1] * 95)], "id string, label string, samples array<float>")
    for seed in range(12):
        r = augment.random_speed(df, 100, "id", 1.0, (0.5, 1.1), seed).first()
        assert len(r.samples) <= 100 and r.speed_rate >= 95
    with pytest.raises(Exception, match="command exceeds"):
        augment.random_speed(df, 90, "id", 1.0, (0.9, 1.1)).collect()
    with pytest.raises(ValueError):
        augment.Augmentation(speed_percent=(100.1, 100.4))


def test_examples(spark):
    rows = [(f"c{i}", ["next", "unknown"][i % 2], ["train", "val"][i % 4 == 0], [float(v) for v in RNG.normal(size=900 + 10 * i) * 0.1]) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, label string, split string, samples array<float>").withColumn("frames", F.size("samples").cast("bigint"))
    labels = spark.createDataFrame([("next", 0), ("unknown", 1)], "label string, label_id bigint")
    config = augment.Augmentation()
    pool = df.select("id", "samples").where("id in ('c1', 'c2', 'c5', 'c9')")
    val = examples.materialize_examples(df, labels, config, "val", window_seconds=0.0625).collect()
    for r in val:
        x = np.array(next(s for i, _, _, s in rows if i == r.id), dtype=np.float32)
        extra = 1000 - len(x)
        centred = np.pad(x, (extra // 2, extra - extra // 2)) if extra >= 0 else x[-extra // 2 :][:1000]
        np.testing.assert_allclose(r.features, dsp.log_mel_matrix(centred), atol=1e-4)
    train = examples.materialize_examples(df, labels, config, "train", rirs=pool, pool=pool, window_seconds=0.0625)
    a, b = ({r.id: r.features for r in x.collect()} for x in (train, train.repartition(2)))
    assert a == b and all(np.array(f).shape == (40, 7) for f in a.values())
    bands_only = augment.Augmentation(time_masks=0)
    masked = examples.materialize_examples(df, labels, bands_only, "train", window_seconds=0.0625, rirs=pool, pool=pool).collect()
    hidden = [(np.array(r.features) == 0).all(axis=1).sum() for r in masked]
    assert max(hidden) > 0 and max(hidden) <= 12


def test_windows(spark):
    x = [float(i) for i in range(11)]
    chunks = spark.createDataFrame([(1, 0, x[:5]), (1, 5, x[5:8]), (1, 8, x[8:])], "recording_id bigint, start_frame bigint, samples array<float>")
    for block in (4 / 16000, 8 / 16000, 60.0):
        got = clips.sliding_windows(chunks, 6, 4, block_seconds=block).orderBy("window_index").collect()
        assert [round(r.end_seconds * 16000) for r in got] == [4, 8, 11]
        assert got[0].samples == [0, 0, 0, 1, 2, 3] and got[2].samples == [5, 6, 7, 8, 9, 10]
        assert [round(r.left_padding_seconds * 16000) for r in got] == [2, 0, 0]
    gap = chunks.where("start_frame <> 5")
    with pytest.raises(Exception, match="leave a gap"):
        clips.sliding_windows(gap, 6, 4).collect()


def test_chunked_resampling_equals_whole(spark):
    for rate in (44100, 8000):
        x = (RNG.normal(size=3 * rate + 123) * 0.1).astype(np.float32)
        cuts = [0, 1000, rate, rate + 7, 2 * rate + 5000, len(x)]
        rows = [(1, rate, a, [float(v) for v in x[a:b]]) for a, b in zip(cuts, cuts[1:])]
        df = spark.createDataFrame(rows, "recording_id bigint, sample_rate int, start_frame bigint, samples array<float>")
        got = clips.resample_chunks(df, 16000, 1).orderBy("start_frame").collect()
        whole = dsp.resample(x.astype(np.float64), rate, 16000)
        y = np.concatenate([r.samples for r in got])
        assert [r.start_frame for r in got] == [i * 16000 for i in range(len(got))]
        np.testing.assert_allclose(y, whole, atol=1e-6)


def speech(seed, seconds=0.7, rate=16000, level=0.3):
    x = np.random.default_rng(seed).normal(size=int(seconds * rate)) * level
    return np.concatenate([np.zeros(rate // 2), x, np.zeros(rate // 2)])


def clean_one(x, channels, rate, label):
    return tuple(clips.clean_block([x], [channels], [rate], [label]).iloc[0])


def test_clean_clip_rules():
    x = speech(1)
    samples, reason, seconds, left, right, rate, kept, gain = clean_one(x, 1, 16000, "next")
    assert reason is None and seconds == pytest.approx(1.7) and rate == 16000
    assert left == pytest.approx(0.35, abs=0.02) and right == pytest.approx(0.35, abs=0.02) and kept == pytest.approx(1.0, abs=0.04)
    assert np.abs(samples).max() <= 0.98 + 1e-6 and gain <= 1
    assert clean_one(np.zeros(16000), 1, 16000, "next")[1] == "no_speech_activity"
    assert clean_one(speech(2, 3.0), 1, 16000, "next")[1].startswith("speech_duration_outside_limits:3.")
    assert clean_one(speech(2, 3.0), 1, 16000, "background")[1] is None
    assert clean_one(np.array([]), 1, 16000, "next")[1] == "empty_or_nonfinite_audio"
    assert clean_one(np.array([np.nan] * 9), 1, 16000, "next")[1] == "empty_or_nonfinite_audio"
    stereo = np.stack([x, x * 0.5], axis=1).ravel()
    assert clean_one(stereo, 2, 16000, "next")[4] == pytest.approx(right)


def build_dataset(root):
    """Three splits of three labels, four bad rows, and a session with one rejected clip."""
    (root / "splits").mkdir(parents=True)
    rows, seed = {s: [] for s in manifests.SPLITS}, 10
    for split in rows:
        for label in ("next", "unknown", "background"):
            seed += 1
            path = f"audio/{split}_{label}.wav"
            write(root / path, speech(seed))
            digest = hashlib.sha256((root / path).read_bytes()).hexdigest()
            rows[split].append(dict(id=f"{split}_{label}", path=path, label=label, speaker_group=f"voice:{split}", sha256=digest))
    (root / "audio/broken.wav").write_bytes(b"not audio")
    write(root / "audio/long.wav", speech(90, 3.1))
    write(root / "audio/sum.wav", speech(91))
    bad = [("missing", None), ("broken", None), ("long", None), ("sum", "0" * 64)]
    rows["train"] += [dict(id=n, path=f"audio/{n}.wav", label="next", speaker_group="voice:train", sha256=h or "") for n, h in bad]
    for split, listed in rows.items():
        (root / "splits" / f"{split}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in listed))
    session = root / "sessions" / "day1"
    write(session / "take.wav", np.repeat(np.interp(np.arange(0, 1.7, 1 / 44100), np.arange(27200) / 16000, speech(95)), 2), 44100, 2)
    takes = [dict(wav="take.wav", label="next", accepted=True, speaker="guest"), dict(wav="no.wav", label="next", accepted=False), dict(note="no recording")]
    (session / "manifest.jsonl").write_text("".join(json.dumps(r) + "\n" for r in takes))
    return rows


def run_clean(spark, root, labels):
    dataset = manifests.load_manifest(spark, str(root), labels)
    sessions = manifests.load_session_manifests(spark, str(root / "sessions"))
    files = audio.read_files(spark, str(root / "audio")).withColumn("path", F.concat(F.lit("audio/"), "path"))
    files = files.unionByName(audio.read_files(spark, str(root / "sessions")))
    return clean.clean_dataset(dataset, sessions, files, labels, "guest")


def test_clean_dataset_from_files(spark, tmp_path):
    labels = spark.createDataFrame([("next", 0), ("unknown", 1), ("background", 2)], "label string, label_id bigint")
    root = tmp_path / "data"
    rows = build_dataset(root)
    out = run_clean(spark, root, labels)
    report = out["report"].first()
    assert (report.accepted, report.dataset_accepted, report.held_out, report.excluded) == (10, 9, 1, 5)
    assert report.exclusions == {"missing_audio": 1, "not_a_wav_file": 1, "speech_duration_outside_limits": 1, "source_sha256_mismatch": 1, "recorder_not_accepted": 1}
    assert report.counts == {f"{s}/{name}": 1 for s in rows for name in ("next", "unknown", "background")}
    held = F.col("partition") == "held_out"
    target = str(tmp_path / "out")
    reports.write_curated(out["accepted"], out["excluded"], held, out["report"], target)
    assert spark.read.json(f"{target}/evaluation/held_out").count() == 1 and spark.read.json(f"{target}/evaluation/synthetic_test").count() == 3
    assert spark.read.parquet(f"{target}/manifest").where("id like 'guest%'").count() == 0
    with pytest.raises(Exception, match="exist"):
        reports.write_curated(out["accepted"], out["excluded"], held, out["report"], target)
    got = out["accepted"].where("id = 'train_next'").first()
    want = clean_one(np.clip(speech(11), -1, 1), 1, 16000, "next")
    np.testing.assert_allclose(got.samples, want[0], atol=1e-4)
    assert got.sha256 == hashlib.sha256(wav.wrap(dsp.to_pcm16(np.array(got.samples)), 16000)).hexdigest()
    assert got.duration_s == want[6] and got.source_path == "audio/train_next.wav"


@pytest.mark.parametrize("change, message", [
    (dict(copy="train_next", to="val_next"), "overlaps another split"),
    (dict(split="val", speaker_group="voice:train"), "group leaks"),
    (dict(split="train", speaker="Guest"), "held_out_entity"),
    (dict(split="train", path="../x.wav"), "path_outside"),
    (dict(split="train", id="a b"), "unsafe_id"),
])
def test_clean_dataset_refuses(spark, tmp_path, change, message):
    labels = spark.createDataFrame([("next", 0), ("unknown", 1), ("background", 2)], "label string, label_id bigint")
    rows = build_dataset(tmp_path)
    if "copy" in change:
        data = (tmp_path / f"audio/{change['copy']}.wav").read_bytes()
        (tmp_path / f"audio/{change['to']}.wav").write_bytes(data)
        rows["val"][0]["sha256"] = ""
        split = "val"
    else:
        split = change.pop("split")
        rows[split][0].update(change)
    (tmp_path / "splits" / f"{split}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows[split]))
    with pytest.raises(ValueError, match=message):
        run_clean(spark, tmp_path, labels)


def test_nonfinite_and_foreign_clips_are_found(spark, tmp_path):
    x = np.zeros(70000, dtype="<f4")
    x[-1] = np.inf
    (tmp_path / "inf.wav").write_bytes(wav.wrap(x.tobytes(), 16000, 1, 32, wav.IEEE_FLOAT))
    write(tmp_path / "ok.wav", tone(1600))
    write(tmp_path / "rate.wav", tone(1600), 8000)
    write(tmp_path / "silent.wav", np.zeros(100))
    files = audio.read_files(spark, str(tmp_path))
    wanted = spark.createDataFrame([(f"{n}.wav",) for n in ("inf", "ok", "rate", "silent")], "path string")
    got = {r.path: r.fault for r in audio.load_clips(wanted, files).collect()}
    assert got == {"inf.wav": "empty_or_nonfinite", "ok.wav": None, "rate.wav": "expected_mono_at_rate", "silent.wav": None}
    pool, faults = audio.rir_pool(files)
    assert [r.path for r in pool.collect()] == ["ok.wav"] and faults.where("path = 'silent.wav'").first().fault == "silent"
    clash = audio.digest_conflicts(pool, pool.withColumn("sha256", F.lit("other")))
    assert clash.count() == 1 and audio.digest_conflicts(pool, pool).count() == 0
    log = str(tmp_path / "log")
    one = reports.fingerprint_files(spark, [str(tmp_path / "ok.wav")], "clips", {"threshold": "0.5"}, log)
    reports.fingerprint_files(spark, [str(tmp_path / "ok.wav")], "clips", {}, log)
    assert one.first().sha256 == hashlib.sha256((tmp_path / "ok.wav").read_bytes()).hexdigest() and spark.read.parquet(log).count() == 2
    assert reports.same_inputs(one, one).count() == 0


def loudness():
    """Logits from the level of the window's last tenth of a second: loud is `next`."""

    def scorer(x):
        level = np.sqrt(np.square(x[:, -1600:].astype(np.float64)).mean(axis=1))
        return np.stack([np.where(level > 0.1, 5.0, -5.0), np.zeros(len(x))], axis=1)

    return scorer


def test_recordings_end_to_end(spark, tmp_path):
    """Two seconds at 44.1 kHz with a sound from 0.5 to 1 s: twenty windows, one match 0.3 s before its end."""
    x = np.zeros(88200, dtype=np.float32)
    x[22050:44100] = tone(22050, 440, 44100, 0.6)
    rows = [(7, 44100, at, [float(v) for v in x[at : at + 10000]]) for at in range(0, 88200, 10000)]
    chunks = spark.createDataFrame(rows, "recording_id bigint, sample_rate int, start_frame bigint, samples array<float>")
    recordings = spark.createDataFrame([(7, 2.0)], "recording_id bigint, duration_seconds double")
    labels = spark.createDataFrame([("next", 0), ("unknown", 1)], "label string, label_id bigint")
    ev = spark.createDataFrame([(7, 0, "next", 0.5, 1.0)], "recording_id bigint, event_id bigint, label string, start_seconds double, end_seconds double")
    out = continuous.evaluate_recordings(chunks, ev, recordings, labels, loudness(), audio={"resample": True})
    assert out["windows"].count() == 20
    m = out["metrics"].where("label = 'all'").first()
    assert (m.tp, m.fp, m.fn) == (1, 0, 0) and m.median_latency_seconds == pytest.approx(-0.3)
    continuous.write_recording_report(out, labels, str(tmp_path / "report"))
    back = spark.read.csv(str(tmp_path / "report/windows"), header=True)
    assert back.count() == 20 and {"p_next", "p_unknown"} <= set(back.columns) and spark.read.json(str(tmp_path / "report/metrics")).count() == 2
    quiet = continuous.evaluate_recordings(chunks, None, recordings, labels, loudness(), audio={"resample": True})
    n = quiet["metrics"].first()
    assert (n.fp, n.false_positives_per_hour, n.provisional) == (1, 1800.0, True)
    with pytest.raises(Exception, match="set resample"):
        continuous.evaluate_recordings(chunks, ev, recordings, labels, loudness())
    sidecar = spark.createDataFrame([(7, "overflow")], "recording_id bigint, error string")
    with pytest.raises(ValueError, match="capture error"):
        continuous.evaluate_recordings(chunks, ev, recordings, labels, loudness(), sidecars=sidecar)


def test_two_models_on_views(spark, tmp_path):
    labels = spark.createDataFrame([("lo", 0), ("hi", 1), ("none", 2)], "label string, label_id bigint")
    rows = [(i, f"{i}.wav", "hi" if i % 2 else "lo", [float(i % 2)] * (6 + i % 3), False) for i in range(8)]
    clips_df = spark.createDataFrame(rows, "record_index bigint, path string, label string, samples array<double>, resampled boolean")

    def model(bias):
        def scorer(x):
            top = x.max(axis=1) + bias
            return np.stack([1 - top, top, np.full(len(x), -9.0)], axis=1)

        return lambda df: scoring.score_clips(df, scorer, 3)

    out = evaluate.compare_on_views({"all": clips_df}, labels, model(0.9), model(0.0), "a", "b", 8)["all"]
    got = {r.label: r for r in out["by_class"].collect()}
    assert (got["all"].old_accuracy, got["all"].new_accuracy, got["all"].improved, got["none"]["count"]) == (0.5, 1.0, 4, 0)
    f1 = {r.model: r.supported_macro_f1 for r in out["supported_macro_f1"].collect()}
    assert f1["new"] == 1.0 and f1["old"] == pytest.approx(1 / 3)
    with pytest.raises(ValueError, match="identical"):
        evaluate.compare_on_views({"all": clips_df}, labels, model(0), model(0), "a", "a", 8)
    result = evaluate.evaluate_clips(clips_df, labels, model(0.0), 7, long="skip", crop_labels=("hi",), strict=True)
    assert {r.action: r.n for r in result["actions"].collect()} == {"padded": 3, "unchanged": 3, "cropped": 1, "skipped_long": 1}
    path = str(tmp_path / "evaluation")
    evaluate.write_evaluation(result, labels, path)
    assert reports.read_skipped(spark, f"{path}/skipped").first().reason == "skipped_long"
    assert reports.read_predictions(spark, f"{path}/predictions", ["lo", "hi", "none"]).count() == 7


def test_scorer_contract(spark):
    df = spark.createDataFrame([([0.1, 0.2],), ([0.1, 0.2, 0.3],)], "samples array<double>")
    good = scoring.score_clips(df, lambda x: np.stack([x.sum(axis=1), x[:, 0]], axis=1), 2).collect()
    assert [round(r.scores[0], 6) for r in good] == [0.3, 0.6]
    for bad in (lambda x: np.zeros((len(x), 3)), lambda x: np.full((len(x), 2), np.nan)):
        with pytest.raises(Exception, match="expected scores|non-finite"):
            scoring.score_clips(df, bad, 2).collect()
    with_mel = scoring.with_features(df, lambda x: x * 2).first()
    assert with_mel.features == [0.2, 0.4]
