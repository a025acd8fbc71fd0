"""From raw clips and sessions to a curated dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirrup.functions import dsp
from chirrup.functions.arrays import bounded
from chirrup.functions.paths import inside_root, record_id, safe_id
from chirrup.operators import checks, clips, curation
from chirrup.session import materialize
from chirrup.sources.audio import decode_wav, file_sha256
from chirrup.sources.manifests import SPLITS, require_none


# Fixed value: what the manifest says was done to a clip.
QC = "local_decode_checksum_trim_duration"


def partition_of(entity: str) -> Column:
    """The split, with the held-out entity as a partition of its own."""
    return F.when(checks.is_entity(entity), F.lit("held_out")).otherwise(F.col("split"))


#: Reasons that stop a strict run before any audio is read.
STOPS = ("invalid_label_or_split", "held_out_entity_in_training", "path_outside_root", "unsafe_id")


def judged(rows: DataFrame, labels: DataFrame, entity: str) -> DataFrame:
    """Adds `stop`: an unknown label or split, a held-out speaker outside test, a bad path or id; else NULL."""
    known = bounded(labels.select("label").distinct().withColumn("_known", F.lit(True)))
    listed = F.col("_known").isNotNull() & F.col("split").isin(*SPLITS)
    reason = (
        F.when(~F.coalesce(listed, F.lit(False)), STOPS[0])
        .when(checks.is_entity(entity) & (F.col("split") != "test"), STOPS[1])
        .when(~inside_root(F.col("path")), STOPS[2])
        .when(~safe_id(F.col("id")), STOPS[3])
    )
    return rows.join(known, "label", "left").withColumn("stop", reason).drop("_known")


def decode_and_clean(rows: DataFrame, files: DataFrame, **settings) -> DataFrame:
    """Rows with `clean` and the first reason to exclude them.

    Checked in order: file present, declared checksum, readable audio, then trimming and duration.

    Present files join their rows by an inner join, so that Spark may broadcast
    the rows and leave the audio where it was read; missing ones come from the
    listing alone.
    """
    missing = rows.join(files.select("path"), "path", "left_anti")
    missing = missing.withColumn("reason", F.concat(F.lit("missing_audio:"), "path"))
    joined = files.select("path", "content").join(rows, "path").withColumn("_sha", F.sha2("content", 256))
    early = F.when((F.col("sha256") != "") & (F.col("sha256") != F.col("_sha")), "source_sha256_mismatch")
    judged = joined.withColumn("_early", early).withColumn(
        "content", F.when(F.col("_early").isNull(), F.col("content")).otherwise(F.lit(b""))
    )
    decoded = decode_wav(judged).withColumn("_early", F.coalesce("_early", "fault"))
    ready = decoded.withColumns({
        "samples": F.coalesce("samples", F.array().cast("array<float>")),
        "channels": F.coalesce("channels", F.lit(1)),
        "sample_rate": F.coalesce("sample_rate", F.lit(0)),
    })
    out = clips.clean_clip(ready, **settings)
    reason = F.coalesce("_early", "clean.reason")
    out = out.withColumn("reason", reason).select(*rows.columns, "clean", "reason")
    return out.unionByName(missing, allowMissingColumns=True)


def clean_dataset(
    dataset_rows: DataFrame, session_rows: DataFrame, files: DataFrame, labels: DataFrame, entity: str,
    strict: bool = True, min_s: float = 0.35, max_s: float = 2.6, margin_ms: float = 150.0, **settings,
) -> dict[str, DataFrame]:
    """Accepted clips (with samples and trim metadata), excluded rows and the report.

    Order decides duplicates: the dataset's splits as train, val, test, each by
    record_index, then the sessions by manifest folder and record_index.
    `dataset_rows` are manifest rows; `session_rows` are recorder rows with
    folder, wav, accepted and error.  Under `strict` the faults in STOPS,
    overlaps across partitions and group leaks stop the job.  Otherwise such
    rows are excluded with their reason and the report is not complete; leaks are only listed.
    """
    if margin_ms < 0 or not 0 < min_s <= max_s <= 3:
        raise ValueError("clips may last 0 to 3 seconds, from min_s to max_s, and margin_ms is not below 0")
    mine = checks.is_entity(entity)
    moved = {"evaluation_group": entity, "engine": "real", "sample_kind": "human_recording", "speaker_group": f"human:{entity}"}
    dataset = dataset_rows.withColumns({k: F.when(mine, F.lit(v)).otherwise(F.col(k)) for k, v in moved.items()})
    dataset = dataset.withColumn("id", record_id(F.col("id"), F.col("path"))).withColumn("folder", F.lit(""))
    offered = checks.recorder_acceptance(session_rows)
    sessions = curation.session_records(offered.where("reason is null"), entity, f"{entity}_", keep=("folder", "record_index"))
    rows = curation.union_sources(dataset, sessions).withColumn("partition", partition_of(entity))
    rows = rows.withColumn("rank", F.when(F.col("kind") == "session", 4).otherwise(curation.split_order(F.col("split"))))
    rows = rows.withColumn("position", F.struct("rank", "folder", "record_index", "path"))
    listed = ("kind", "id", "path", "label", "split")
    rows = judged(rows, labels, entity)
    stopped = rows.where("stop is not null").select(*listed, F.col("stop").alias("reason"))
    rows = rows.where("stop is null").drop("stop")
    if strict:
        require_none(stopped, "the dataset cannot be cleaned")

    # Decoding is the dear step and feeds every later one: it is stored once.
    cleaned = decode_and_clean(rows, files, min_s=min_s, max_s=max_s, margin_ms=margin_ms, **settings)
    wave = F.col("clean.samples")
    cleaned = materialize(cleaned.withColumns({"content_sha256": dsp.pcm16_content_hash(wave), "file_sha256": file_sha256(wave)}))
    valid = cleaned.where("reason is null")
    # Audio stays out of the rounds, and the few losers are taken out of it by their position.
    narrow = valid.select("position", *listed, "content_sha256", "partition", *curation.GROUP_KINDS)
    decided = materialize(curation.first_wins_dedup(narrow, "position", "id", "content_sha256", "partition"))
    rejected = decided.where("decision <> 'accepted'")
    if strict:
        require_none(decided.where(F.col("decision").isin(*curation.ABORTING)), "a record overlaps another split")
    accepted = valid.join(rejected.select("position"), "position", "left_anti")
    leaks = curation.group_leak_after_accept(decided.where("decision = 'accepted'"))
    if strict:
        require_none(leaks, "a group leaks across splits")

    excluded = (
        cleaned.where("reason is not null").select(*listed, "reason")
        .unionByName(rejected.select(*listed, F.col("decision").alias("reason")))
        .unionByName(stopped)
        .unionByName(
            offered.where("reason is not null").select(F.lit("session").alias("kind"), F.col("wav").alias("path"), "reason"),
            allowMissingColumns=True,
        )
    )
    kept = accepted.select(
        *[c for c in rows.columns if c not in ("rank", "folder", "sha256", "path")],
        F.col("path").alias("source_path"), "content_sha256", F.col("file_sha256").alias("sha256"), F.lit(QC).alias("qc"),
        F.concat_ws("/", F.lit("audio"), "kind", F.concat("id", F.lit(".wav"))).alias("path"),
        "clean.samples", *[f"clean.{c}" for c in ("original_duration_s", "trimmed_left_s", "trimmed_right_s", "sample_rate", "duration_s", "peak_limiter_gain")],
    )
    if strict:
        filled = {r.partition for r in decided.where("decision = 'accepted'").select("partition").distinct().collect()}
        if missing := {*SPLITS, "held_out"} - filled:
            raise ValueError(f"no usable record in {sorted(missing)}; see the excluded rows")
    held = F.col("partition") == "held_out"
    policy = {"min_seconds": min_s, "max_seconds": max_s, "margin_ms": margin_ms, "sample_rate": dsp.RATE}
    return {"accepted": kept, "excluded": excluded, "leaks": leaks, "report": curation.curation_report(kept, excluded, held, policy, STOPS + curation.ABORTING)}
