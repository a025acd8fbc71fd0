"""Order-dependent operators against plain sequential models on random inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirrup.functions.scan import exact_quantiles, numbered, running
from chirrup.operators import curation, events


def decode_model(rows, ignored, threshold, consecutive, release, cooldown):
    """rows: (t, label, conf) of one recording in order."""
    state, out = {}, []
    names = {label for _, label, _ in rows} - set(ignored)
    for name in names:
        state[name] = {"n": 0, "armed": True, "since": None, "last": -math.inf}
    for i, (t, label, conf) in enumerate(rows):
        active = label if conf >= threshold and label not in ignored else None
        for name, s in state.items():
            if name == active:
                s["since"] = None
                s["n"] += 1
                if s["armed"] and s["n"] >= consecutive and t - s["last"] + 1e-9 >= cooldown:
                    s["armed"], s["last"] = False, t
                    out.append((i, name, t, conf))
            else:
                s["n"] = 0
                s["since"] = t if s["since"] is None else s["since"]
                if t - s["since"] + 1e-9 >= release:
                    s["armed"] = True
    return out


@pytest.mark.parametrize("seed", range(4))
def test_decoder(spark, seed):
    rng = random.Random(seed)
    labels = ["a", "b", "quiet"]
    rows, want = [], set()
    settings = [(1, 0.2, 0.5), (2, 0.3, 1.0), (3, 0.0, 2.0), (2, 0.5, 0.0)][seed]
    for rec in range(40):
        t, label, seq = 0.0, "a", []
        for i in range(rng.randint(1, 160)):
            t = (i + 1) * 0.1 if rng.random() < 0.9 or not seq else seq[-1][0] + rng.choice([0.05, 0.1, 0.7])
            t = max(t, seq[-1][0] + 0.01) if seq else t
            label = label if rng.random() < 0.7 else rng.choice(labels)
            seq.append((t, label, round(rng.random(), 2)))
        rows += [(rec, i, *x) for i, x in enumerate(seq)]
        want |= {(rec, *x) for x in decode_model(seq, ("quiet",), 0.3, *settings)}
    df = spark.createDataFrame(rows, "recording_id bigint, window_index bigint, time_seconds double, predicted_label string, confidence double")
    k, release, cooldown = settings
    for block_windows, block_seconds in ((5, 1.0), (4096, None)):
        got = events.decode_events(df.repartition(3), ("quiet",), 0.3, k, release, cooldown, block_windows, block_seconds)
        found = {(r.recording_id, r.window_index, r.label, r.time_seconds, r.confidence) for r in got.collect()}
        assert found == want


def test_decoder_regular_activity_without_any_pause(spark):
    """A class that never pauses for long: every block depends on the one before."""
    rows = [(0, i, (i + 1) * 0.1, "a" if i % 6 < 3 else "quiet", 0.9) for i in range(3000)]
    df = spark.createDataFrame(rows, "recording_id bigint, window_index bigint, time_seconds double, predicted_label string, confidence double")
    got = events.decode_events(df, ("quiet",), 0.5, 2, 0.2, 1.0, 64, 2.0)
    want = decode_model([(t, label, c) for _, _, t, label, c in rows], ("quiet",), 0.5, 2, 0.2, 1.0)
    assert sorted(r.window_index for r in got.collect()) == [w[0] for w in want]


def match_model(truth, found, early, late):
    used, pairs = set(), {}
    for d, label, t in sorted(found, key=lambda x: (x[2], x[0])):
        options = [(e, i) for i, name, s, e in truth if i not in used and name == label and s - early <= t <= e + late]
        if options:
            e, i = min(options)
            used.add(i)
            pairs[d] = (i, t - e)
    return pairs


@pytest.mark.parametrize("seed", range(3))
def test_matcher(spark, seed):
    rng = random.Random(seed)
    ev, de, want = [], [], {}
    for rec in range(30):
        e = [(i, rng.choice("ab"), s := rng.randint(0, 60) / 2, s + rng.randint(1, 16) / 2) for i in range(rng.randint(0, 14))]
        d = [(i, rng.choice("ab"), rng.randint(0, 140) / 4) for i in range(rng.randint(0, 25))]
        ev += [(rec, *x) for x in e]
        de += [(rec, *x, 0.5) for x in d]
        want |= {(rec, k): v for k, v in match_model(e, d, 0.5, 1.0).items()}
    events_df = spark.createDataFrame(ev, "recording_id bigint, event_id bigint, label string, start_seconds double, end_seconds double")
    found_df = spark.createDataFrame(de, "recording_id bigint, detection_id bigint, label string, time_seconds double, confidence double")
    for block in (3.0, 1000.0):
        me, md = events.match_events(events_df, found_df, 0.5, 1.0, block)
        got = {(r.recording_id, r.detection_id): (r.event_id, r.latency_seconds) for r in md.collect() if r.event_id is not None}
        assert got == want
        back = {(r.recording_id, r.detection_id): (r.event_id, r.latency_seconds) for r in me.collect() if r.detection_id is not None}
        assert back == want and me.count() == len(ev) and md.count() == len(de)


def dedup_model(rows):
    ids, hashes, out = {}, {}, {}
    for o, i, h, p in sorted(rows):
        if i in ids:
            out[o] = "duplicate_id" if ids[i] == p else "id_overlaps_splits"
        elif h in hashes:
            out[o] = "duplicate_audio_in_split" if hashes[h] == p else "audio_overlaps_splits"
        else:
            ids[i] = hashes[h] = p
            out[o] = "accepted"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_first_wins(spark, seed):
    rng = random.Random(seed)
    n = 300
    # A third of the rows share one content.
    rows = [(o, f"i{rng.randint(0, 150)}", "same" if rng.random() < 1 / 3 else f"h{rng.randint(0, 120)}", rng.choice("tv")) for o in range(n)]
    df = spark.createDataFrame(rows, "o bigint, id string, sha256 string, split string")
    got = {r.o: r.decision for r in curation.first_wins_dedup(df, "o").collect()}
    assert got == dedup_model(rows)


def test_running_equals_plain_prefix(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xyz"), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    v = F.col("v")
    got = running(df, ["k"], ["i"], F.floor(F.col("i") / 7), {"s": ("sum", v), "hi": ("max", v), "lo": ("min", v), "prev": ("last", v)})
    for r in got.collect():
        before = [x for k, i, x in rows if k == r.k and i < r.i and x is not None]
        assert (r.s, r.hi, r.lo, r.prev) == ((sum(before), max(before), min(before), before[-1]) if before else (None,) * 4)
    places = numbered(df, ["k"], ["i"], F.floor(F.col("i") / 7), "n").collect()
    assert all(r.n == sum(1 for k, i, _ in rows if k == r.k and i < r.i) for r in places)


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(x)) for k, n in (("a", 1), ("b", 2), ("c", 57), ("d", 400)) for x in np.round(rng.normal(size=n), 1)]
    got = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()
    for r in got:
        values = [v for k, v in rows if k == r.k]
        assert r.p50 == pytest.approx(np.percentile(values, 50)) and r.p95 == pytest.approx(np.percentile(values, 95))
    assert len(got) == 4


@pytest.mark.parametrize("limit, bins", [(20, 3), (1, 2), (500, 1024)])
def test_exact_quantiles_of_many_values_close_in_on_ranks(spark, limit, bins):
    rng = np.random.default_rng(limit)
    crowd = np.concatenate([0.7 + 1e-6 * rng.normal(size=900), np.round(rng.normal(size=300), 1), [1e12, -1e12, 0.0]])
    rows = [("hot", float(x)) for x in crowd] + [("one", 3.5)] * 4 + [("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs, limit, bins).collect()}
    for k, r in got.items():
        values = [v for name, v in rows if name == k]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12), (k, name)
    assert len(got) == 3


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Each row shares its id or its content with the one before: ten thousand decisions in a row."""
    calls = []
    store = curation.materialize
    monkeypatch.setattr(curation, "materialize", lambda df: calls.append(1) or store(df))
    n = 10_000
    df = spark.range(n).select(
        F.col("id").alias("o"), F.floor((F.col("id") + 1) / 2).cast("string").alias("id"), F.floor(F.col("id") / 2).cast("string").alias("sha256"), F.lit("t").alias("split")
    )
    got = {r.o: r.decision for r in curation.first_wins_dedup(df, "o").collect()}
    assert all(got[o] == ("accepted" if o % 2 == 0 else "duplicate_audio_in_split" if o % 4 == 1 or o % 4 == 3 else "?") for o in range(n))
    assert len(calls) < 24


@pytest.mark.parametrize("seed", range(4))
def test_first_wins_on_tangled_chains(spark, seed):
    rng = random.Random(100 + seed)
    rows = [(o, f"i{o // 2 + rng.choice([0, 0, 0, 1, 2])}", f"h{(o + 1) // 2 + rng.choice([0, 0, 0, 1, -3])}", rng.choice("tv")) for o in range(400)]
    df = spark.createDataFrame(rows, "o bigint, id string, sha256 string, split string")
    assert {r.o: r.decision for r in curation.first_wins_dedup(df, "o").collect()} == dedup_model(rows)
    with pytest.raises(ValueError, match="not unique"):
        curation.first_wins_dedup(df.union(df.where("o = 7")), "o")


def test_overlapping_events_are_matched_in_many_tasks(spark):
    """Events overlap from first to last, each with a detection before the next one starts."""
    n = 20_000
    ev = spark.range(n).select(F.lit(1).cast("bigint").alias("recording_id"), F.lit("a").alias("label"), F.col("id").alias("event_id"),
                               F.col("id").cast("double").alias("start_seconds"), (F.col("id") + 1.8).alias("end_seconds"))
    de = spark.range(n).select(F.lit(1).cast("bigint").alias("recording_id"), F.lit("a").alias("label"), F.col("id").alias("detection_id"),
                               (F.col("id") + 0.5).alias("time_seconds"), F.lit(0.9).alias("confidence"))
    got, _ = events.match_events(ev, de, block_seconds=100.0)
    rows = got.select("event_id", "detection_id").collect()
    assert len(rows) == n and all(r.event_id == r.detection_id for r in rows)
    items = ev.select("recording_id", "label", F.col("start_seconds").alias("at"), F.lit(0).alias("kind"), F.col("event_id").alias("id"), (F.col("end_seconds") + 1).alias("until"))
    items = items.unionByName(de.select("recording_id", "label", F.col("time_seconds").alias("at"), F.lit(1).alias("kind"), F.col("detection_id").alias("id")), allowMissingColumns=True)
    parts = events._stretches(items.withColumn("_block", F.floor(F.col("at") / 100)), ["recording_id", "label"], ["at", "kind", "id"])
    assert parts.groupBy("stretch").count().agg(F.max("count"), F.count("*")).first()[:] == (2, n)


def test_decoder_refuses_gaps(spark):
    rows = [(1, i, i * 0.1, "a", 0.9) for i in range(40)]
    df = spark.createDataFrame(rows, "recording_id bigint, window_index bigint, time_seconds double, predicted_label string, confidence double")
    assert events.decode_events(df, block_windows=8).count() == 1
    for bad in (df.where("window_index <> 17"), df.where("window_index <> 16"), df.where("window_index > 0"), df.where("window_index not between 8 and 15"), df.union(df.where("window_index = 9"))):
        with pytest.raises(Exception, match="gap or a repeat"):
            events.decode_events(bad, block_windows=8).count()
