"""File queries: audio decoded from bytes, and tables written to the shared folder and read back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from chirrup.functions import arrays, wav
from chirrup.functions.rand import unit
from chirrup.operators import checks, curation, metrics
from chirrup.plans import clean
from chirrup.session import fresh_path, materialize
from chirrup.sources import audio, manifests, reports, wav_source
from chirrup.sources.wav_sink import write_files
from workloads import clip_metrics as cm
from workloads import standins as v
from workloads import waveforms as wf
from workloads.curation import DEDUP_STEPS, ENTITY
from workloads.views_sql import sql, u

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def r(column, digits=6):
    return F.round(column, digits) + F.lit(0.0)


def wav_files(spark, sf_dir):
    """Each clip as a file: 16, 24 or 32-bit or float samples; some stereo, some truncated, some silent."""

    @F.pandas_udf("binary")
    def encode(samples: pd.Series, ids: pd.Series) -> pd.Series:
        out = []
        for x, i in zip(samples, ids):
            x = np.asarray(x) * (0.0 if i % 17 == 3 else 1.0)
            kind = i % 4
            if kind == 0:
                data = wav.wrap(np.rint(x * 32768).astype("<i2").tobytes(), 16000, 2 if i % 5 == 0 else 1)
            elif kind == 1:
                wide = np.rint(x * 8388608).astype("<i4")
                data = wav.wrap(wide.view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), 8000 if i % 3 == 0 else 16000, 1, 24)
            elif kind == 2:
                data = wav.wrap(np.rint(x * 2147483648).astype("<i4").tobytes(), 16000, 1, 32)
            else:
                data = wav.wrap(x.astype("<f4").tobytes(), 16000, 1, 32, wav.IEEE_FLOAT)
            out.append(data[:20] if i % 19 == 4 else data)
        return pd.Series(out)

    c = v.clips(spark, sf_dir)
    return c.select(F.concat(F.lit("c/"), "clip_id", F.lit(".wav")).alias("path"), encode("samples", "clip_id").alias("content"))


FAULT = "CASE WHEN clip_id % 19 = 4 THEN 'missing_wav_chunk' END"
STEREO = "(clip_id % 4 = 0 AND clip_id % 5 = 0)"


@query(
    "probe_audio_headers",
    sql(
        f"""SELECT 'c/' || CAST(clip_id AS VARCHAR) || '.wav' AS path, CASE WHEN clip_id % 19 <> 4 THEN CASE WHEN clip_id % 4 = 1 AND clip_id % 3 = 0 THEN 8000 ELSE 16000 END END AS sample_rate,
  CASE WHEN clip_id % 19 <> 4 THEN CASE WHEN {STEREO} THEN 2 ELSE 1 END END AS channels,
  CASE WHEN clip_id % 19 <> 4 THEN CAST(CASE WHEN {STEREO} THEN 32 ELSE 64 END AS BIGINT) END AS frames, {FAULT} AS fault FROM v_clips""",
        "v_clips",
    ),
)
def probe_audio_headers(spark, sf_dir):
    """The clips as files on storage, of which only the heads are read."""
    path = fresh_path(spark, "wavs")
    write_files(materialize(wav_files(spark, sf_dir)), path)
    return wav_source.read_wavs(spark, path, "headers").drop("length")


@query(
    "load_clips",
    sql(
        f"""SELECT path, fault, CASE WHEN fault IS NULL OR fault = 'expected_mono_at_rate' THEN round(list_sum(list_transform(range(1, 65), lambda i: i * CAST(CAST(CASE clip_id % 4 WHEN 0 THEN round_even(samples[i] * 32768, 0) / 32768
    WHEN 1 THEN round_even(samples[i] * 8388608, 0) / 8388608 WHEN 2 THEN round_even(samples[i] * 2147483648, 0) / 2147483648 ELSE samples[i] END AS FLOAT) AS DOUBLE)))
    * CASE WHEN clip_id % 17 = 3 THEN 0 ELSE 1 END, 6) + 0.0 END AS checksum FROM (
  SELECT *, 'c/' || CAST(clip_id AS VARCHAR) || '.wav' AS path, CASE WHEN clip_id % 19 = 4 THEN 'missing_wav_chunk'
    WHEN {STEREO} OR (clip_id % 4 = 1 AND clip_id % 3 = 0) THEN 'expected_mono_at_rate' END AS fault FROM v_clips)""",
        "v_clips",
    ),
)
def load_clips(spark, sf_dir):
    path = fresh_path(spark, "wavs")
    write_files(materialize(wav_files(spark, sf_dir)), path)
    out = wav_source.read_clips(v.clips(spark, sf_dir).select(F.concat(F.lit("c/"), "clip_id", F.lit(".wav")).alias("path")), path)
    weighted = F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("path", "fault", r(weighted).alias("checksum"))


@query(
    "load_rir_pool",
    sql(
        f"""SELECT path, fault, frames FROM (SELECT 'c/' || CAST(clip_id AS VARCHAR) || '.wav' AS path, CASE WHEN clip_id % 19 = 4 THEN 'missing_wav_chunk'
    WHEN {STEREO} OR (clip_id % 4 = 1 AND clip_id % 3 = 0) THEN 'expected_mono_at_rate' WHEN clip_id % 17 = 3 THEN 'silent' END AS fault,
    CASE WHEN fault IS NULL THEN CAST(64 AS BIGINT) END AS frames FROM v_clips)""",
        "v_clips",
    ),
)
def load_rir_pool(spark, sf_dir):
    good, bad = audio.rir_pool(wav_files(spark, sf_dir))
    return good.select("path", F.lit(None).cast("string").alias("fault"), "frames").unionByName(bad, allowMissingColumns=True)


@query(
    "fingerprint_files",
    sql("SELECT path, sha256, 'manifest' AS kind, '42' AS seed FROM v_manifest", "v_manifest"),
)
def fingerprint_files(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "lang", "source", F.concat("doc_id", F.lit(".txt")))
    files = d.select(path.alias("path"), F.col("text").cast("binary").alias("content"))
    out = reports.fingerprints(files, "manifest", {"seed": "42"})
    return out.select("path", "sha256", "kind", F.col("settings")["seed"].alias("seed"))


@query(
    "write_clean_audio",
    sql(
        """SELECT clip_id, CAST(list_sum(list_transform(samples, lambda x: round_even(greatest(-1.0, least(1.0, CAST(CAST(x AS FLOAT) AS DOUBLE))) * 32767, 0))) AS BIGINT) AS total, CAST(128 AS INTEGER) AS bytes FROM v_clips""",
        "v_clips",
    ),
)
def write_clean_audio(spark, sf_dir):
    """The clips as 16-bit WAV files, read back in chunks."""
    path = fresh_path(spark, "clips")
    name = F.concat("clip_id", F.lit(".wav"))
    audio.write_wavs(v.clips(spark, sf_dir).select(name.alias("path"), F.col("samples").cast("array<float>").alias("samples")), path)
    back = wav_source.read_wavs(spark, path)
    value = F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, x: a + F.rint(x.cast("double") * 32768).cast("bigint"))
    id = F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("clip_id")
    return back.groupBy(id).agg(F.sum(value).alias("total"), F.sum(F.size("samples") * 2).cast("int").alias("bytes"))


@query(
    "write_dataset",
    sql(
        """SELECT 'split' AS part, id, split FROM v_manifest WHERE NOT (speaker_group = 'src3' AND split = 'test')
UNION ALL SELECT 'excluded', id, NULL FROM v_manifest WHERE frames > 3000
UNION ALL SELECT 'held_out', id, NULL FROM v_manifest WHERE speaker_group = 'src3' AND split = 'test'
UNION ALL SELECT 'synthetic_test', id, NULL FROM v_manifest WHERE split = 'test' AND speaker_group <> 'src3'
  AND sample_kind IS DISTINCT FROM 'human_recording' AND engine IS DISTINCT FROM 'real'""",
        "v_manifest",
    ),
)
def write_dataset(spark, sf_dir):
    m, path = v.manifest(spark, sf_dir), fresh_path(spark, "dataset")
    held = (F.col("speaker_group") == ENTITY) & (F.col("split") == "test")
    excluded = m.where("frames > 3000").withColumn("reason", F.lit("too_long"))
    labels = v.label_map(spark, sf_dir)
    reports.write_curated(m, excluded, held, curation.curation_report(m, excluded, held, {"max_seconds": 2.6}), path, labels)
    back = manifests.load_manifest(spark, path, manifests.load_labels(spark, f"{path}/labels.json"))
    out = back.select(F.lit("split").alias("part"), "id", "split")
    for part, folder in (("excluded", "excluded"), ("held_out", "evaluation/held_out"), ("synthetic_test", "evaluation/synthetic_test")):
        rows = spark.read.schema("id string").json(f"{path}/{folder}")
        out = out.unionByName(rows.select(F.lit(part).alias("part"), "id", F.lit(None).cast("string").alias("split")))
    return out


@query(
    "discover_manifests",
    """SELECT 'speaker=' || role AS folder, CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) || '.wav' AS wav, CASE WHEN length(text) % 2 = 0 THEN true END AS accepted FROM conversations""",
)
def discover_manifests(spark, sf_dir):
    """Session manifests in nested folders, found and read again."""
    path = fresh_path(spark, "sessions")
    c = v.table(spark, sf_dir, "conversations")
    rows = c.select(
        F.col("role").alias("speaker"), F.concat("conv_id", F.lit("_"), "turn", F.lit(".wav")).alias("wav"),
        F.when(F.length("text") % 2 == 0, True).alias("accepted"),
    )
    rows.write.mode("errorifexists").partitionBy("speaker").json(path)
    return manifests.load_session_manifests(spark, path, "*.json").select("folder", "wav", "accepted")


@query(
    "read_predictions",
    sql(
        """SELECT clip_id AS record_index, 'clips/' || CAST(clip_id AS VARCHAR) AS path, 'class_' || CAST(pb AS VARCHAR) AS predicted_label,
  CAST(pb = true_id AS INTEGER) AS correct, round(loss_b, 6) + 0.0 AS loss, round(cb, 6) + 0.0 AS confidence, 10 AS classes FROM pred""",
        "v_clips",
        **cm.SCORES,
    ),
)
def read_predictions(spark, sf_dir):
    path, labels = fresh_path(spark, "predictions"), v.class_map(spark, sf_dir)
    names = arrays.label_names(labels)
    predicted = cm.predicted(spark, sf_dir).drop("true_id", "predicted_id")
    reports.write_report({"predictions": reports.wide_probabilities(predicted, names)}, path)
    back = reports.read_predictions(spark, f"{path}/predictions", names)
    return back.select("record_index", "path", "predicted_label", "correct", r(F.col("loss")).alias("loss"), r(F.col("confidence")).alias("confidence"), F.size("p").alias("classes"))


@query(
    "write_reports",
    sql(
        """SELECT 'class_' || CAST(true_id AS VARCHAR) AS label, CAST(n0 AS BIGINT) AS class_0, CAST(n9 AS BIGINT) AS class_9, NULL AS accuracy FROM (
  SELECT true_id, sum(n) FILTER (predicted_id = 0) AS n0, sum(n) FILTER (predicted_id = 9) AS n9 FROM conf GROUP BY 1)
UNION ALL SELECT NULL, NULL, NULL, round(sum(tp) / sum(support), 6) FROM cls""",
        "v_clips",
        "v_classes",
        **cm.CLASSES,
    ),
)
def write_reports(spark, sf_dir):
    path, labels = fresh_path(spark, "report"), v.class_map(spark, sf_dir)
    confusion = metrics.confusion_matrix(cm.predicted(spark, sf_dir), labels)
    _, overall = metrics.classification_metrics(confusion, labels)
    reports.write_report({"confusion": reports.wide_confusion(confusion, arrays.label_names(labels)), "metrics": overall}, path)
    wide = spark.read.csv(f"{path}/confusion", header=True, schema="label string, " + ", ".join(f"class_{i} bigint" for i in range(10)))
    value = spark.read.json(f"{path}/metrics", schema="accuracy double").select(F.round("accuracy", 6).alias("accuracy"))
    return wide.select("label", "class_0", "class_9").unionByName(value, allowMissingColumns=True)


# Each file as the cleaner hears it: decoded to its sample width, mixed down, brought to 16 kHz.
HEARD = """CAST(CAST(CASE clip_id % 4 WHEN 0 THEN round_even(x * 32768, 0) / 32768 WHEN 1 THEN round_even(x * 8388608, 0) / 8388608
  WHEN 2 THEN round_even(x * 2147483648, 0) / 2147483648 ELSE x END AS FLOAT) AS DOUBLE)"""
CLEAN_SQL = {
    **wf.RESAMPLE_SQL,
    "weights": "SELECT list(hs ORDER BY m) AS ws FROM weight WHERE rate = 8000",
    "decoded": f"SELECT clip_id, label, list_transform(list_transform(samples, lambda x: {HEARD}), lambda v: CASE WHEN clip_id % 17 = 3 THEN 0.0 ELSE v END) AS samples FROM v_clips",
    "heard": f"""SELECT 'dataset' AS kind, clip_id, label, CASE WHEN {STEREO} THEN list_transform(range(1, 33), lambda i: (samples[2 * i - 1] + samples[2 * i]) / 2)
    WHEN clip_id % 4 = 1 AND clip_id % 3 = 0 THEN list_transform(ws, lambda w: list_dot_product(samples, w)) ELSE samples END AS samples FROM decoded, weights
  UNION ALL SELECT 'session', clip_id, label, list_transform(list_reverse(samples), lambda x: CAST(CAST(round_even(x * 32767, 0) / 32768 AS FLOAT) AS DOUBLE)) FROM v_clips""",
    "rms": """SELECT *, list_transform(range(0, (len(samples) - 8) // 4 + 1), lambda i: sqrt(list_sum(list_transform(samples[i * 4 + 1 : i * 4 + 8], lambda x: x * x)) / 8)) AS rms FROM heard""",
    **{k: s for k, s in wf.limits(wf.trim_sql("heard", 0), 0.0012, 0.0038).items() if k != "rms"},
    "told": f"""SELECT *, CASE WHEN kind = 'session' THEN CASE WHEN clip_id % 3 <> 0 THEN 'recorder_not_accepted' ELSE reason END
    WHEN {u('clip_id', 'file')} < 0.03 THEN 'missing_audio' WHEN clip_id % 19 = 4 THEN 'missing_wav_chunk' ELSE reason END AS why,
  CASE WHEN kind = 'session' OR clip_id % 23 = 0 OR {u('clip_id', 'split')} >= 0.85 THEN 'test' WHEN {u('clip_id', 'split')} < 0.7 THEN 'train' ELSE 'val' END AS part FROM trim""",
    "o": """SELECT *, row_number() OVER (ORDER BY kind, CASE part WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, clip_id) AS i FROM (
  SELECT kind, clip_id, part, CASE WHEN kind = 'session' OR clip_id % 23 = 0 THEN 'held_out' ELSE part END AS split,
    CASE WHEN kind = 'session' THEN 'guest_' || CAST(clip_id AS VARCHAR) ELSE 'id_' || CAST(CASE WHEN clip_id % 37 = 36 THEN clip_id - 1 ELSE clip_id END AS VARCHAR) END AS id,
    CASE WHEN kind = 'dataset' AND clip_id % 17 = 3 THEN 'silence' || CAST(len(samples) AS VARCHAR) ELSE kind || CAST(clip_id AS VARCHAR) END AS sha256, i0 AS record_index
  FROM (SELECT *, clip_id * 2 + CASE WHEN kind = 'session' THEN 1 ELSE 0 END AS i0 FROM told WHERE why IS NULL))""",
    "w": DEDUP_STEPS["w"],
    "verdict": "SELECT o.split, w.decision FROM w JOIN o USING (record_index)",
}


@query(
    "clean_dataset",
    sql(
        """SELECT 'accepted' AS part, split AS name, count(*) AS n FROM verdict WHERE decision = 'accepted' GROUP BY 2
UNION ALL SELECT 'excluded', decision, count(*) FROM verdict WHERE decision <> 'accepted' GROUP BY 2
UNION ALL SELECT 'excluded', split_part(why, ':', 1), count(*) FROM told WHERE why IS NOT NULL GROUP BY 2""",
        "v_clips",
        **CLEAN_SQL,
    ),
)
def clean_dataset(spark, sf_dir):
    """The whole cleaning job over the clips as files, with conversations as recorder sessions.

    Clips are 64 samples long, so frames and limits are scaled down with them.
    """
    c = v.clips(spark, sf_dir)
    draw = unit(F.col("clip_id"), "split")
    entity = F.col("clip_id") % 23 == 0
    split = F.when(entity | (draw >= 0.85), "test").when(draw < 0.7, "train").otherwise("val")
    path = F.concat(F.lit("c/"), "clip_id", F.lit(".wav"))
    rows = c.select(
        F.col("clip_id").alias("record_index"), F.concat(F.lit("id_"), F.when(F.col("clip_id") % 37 == 36, F.col("clip_id") - 1).otherwise(F.col("clip_id"))).alias("id"),
        path.alias("path"), "label", split.alias("split"), F.lit("").alias("sha256"), F.lit(None).cast("string").alias("speaker_group"),
        F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("source_group"), F.lit("tts").alias("engine"),
        F.lit(None).cast("string").alias("sample_kind"), F.lit(None).cast("string").alias("evaluation_group"), F.when(entity, "Guest").alias("speaker"),
    )
    sessions = c.select(
        F.lit("s").alias("folder"), F.concat("clip_id", F.lit(".wav")).alias("wav"), "label", F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("string").alias("condition"), (F.col("clip_id") % 3 == 0).alias("accepted"),
        F.lit(None).cast("string").alias("error"), F.col("clip_id").alias("record_index"),
    )
    files = wav_files(spark, sf_dir).where(unit(F.regexp_extract("path", r"(\d+)", 1), "file") >= 0.03)
    again = audio.encode_wav(c.select(F.concat(F.lit("s/"), "clip_id", F.lit(".wav")).alias("path"), F.reverse("samples").alias("samples"))).select("path", "content")
    settings = {"frame": 8, "hop": 4, "relative_db": -3.0, "exempt": ("class_0",)}
    out = clean.clean_dataset(rows, sessions, files.unionByName(again), v.class_map(spark, sf_dir), "guest", strict=False, min_s=0.0012, max_s=0.0038, margin_ms=0.1875, **settings)
    accepted = out["accepted"].groupBy(F.lit("accepted").alias("part"), F.col("partition").alias("name")).agg(F.count("*").alias("n"))
    return accepted.unionByName(curation.exclusion_counts(out["excluded"]).select(F.lit("excluded").alias("part"), F.col("code").alias("name"), "n"))
