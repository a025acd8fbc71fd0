"""Dataset validation and the background pool: compositions of the row checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirrup.functions.arrays import bounded
from chirrup.operators import checks, curation, joins
from chirrup.session import materialize
from chirrup.sources.manifests import SPLITS, load_labels, load_manifest, require_none
from chirrup.sources.wav_source import audit_files


def validate_dataset(
    manifest: DataFrame,
    files: DataFrame,
    labels: DataFrame,
    window_seconds: float = 3.0,
    declared: str = "declared_sha256",
) -> tuple[DataFrame, DataFrame]:
    """(kept rows per split and label, violations as kind, split and subject).

    `files` has one row per audio file: path, sample_rate, channels, frames, all_finite, sha256;
    and, as `wav_source.audit_files` gives it, the fault of a file that cannot be read.
    """
    unread = F.col("fault") if "fault" in files.columns else F.lit(None).cast("string")
    known = labels.select("label").withColumn("_known", F.lit(True))
    found = files.withColumn("_found", F.lit(True))
    # One pass over manifest and files judges every row.
    rows = manifest.drop("frames", "sha256").join(found, "path", "left").join(bounded(known), "label", "left")
    wrong_split = F.col("declared_split") != F.col("split") if "declared_split" in manifest.columns else F.lit(False)
    rows = materialize(rows)
    here = F.col("_found").isNotNull()
    faults = F.array(
        F.when(F.col("_known").isNull(), "unknown_label").when(~F.col("split").isin(*SPLITS), "unknown_split").when(wrong_split, "wrong_split"),
        F.when(~here, "missing_audio")
        .when(unread.isNotNull(), unread)
        .when(F.col("sample_rate") != 16000, "sample_rate")
        .when(F.col("channels") != 1, "channels")
        .when(F.col("frames") <= 0, "empty")
        .when(~F.col("all_finite"), "nonfinite"),
        F.when(here & (F.col(declared) != "") & (F.col(declared) != F.col("sha256")), "checksum_mismatch"),
    )
    by_row = rows.select(F.explode(F.array_compact(faults)).alias("kind"), "split", F.col("path").alias("subject"))
    long = F.coalesce(checks.too_long(window_seconds, 16000), F.lit(False))
    kept = rows.where(here & unread.isNull()).groupBy("split", "label").agg(F.count_if(~long).alias("n"))
    emptied = kept.groupBy("split").agg(F.sum("n").alias("n")).where("n = 0")
    leaks = curation.split_leakage(rows.where(here))
    none = F.lit(None).cast("string")
    violations = by_row.unionByName(emptied.select(F.lit("empty_split").alias("kind"), "split", none.alias("subject"))).unionByName(
        leaks.select(F.concat(F.lit("leak_"), "kind").alias("kind"), F.array_join("splits", ",").alias("split"), F.col("value").alias("subject"))
    )
    return kept.where("n > 0"), violations


def validate_strict(*args, **kwargs) -> DataFrame:
    counts, violations = validate_dataset(*args, **kwargs)
    require_none(violations, "dataset validation failed")
    return counts


def validate_folder(spark: SparkSession, root: str, window_seconds: float = 3.0, splits=SPLITS) -> tuple[DataFrame, DataFrame]:
    """`validate_dataset` of a folder: its label map, its split manifests and the WAV files that they name.

    Each file is read once, in blocks, where its row is; nothing is listed.
    """
    labels = load_labels(spark, f"{root}/labels.json")
    manifest = load_manifest(spark, root, labels, splits).withColumnRenamed("sha256", "declared_sha256")
    return validate_dataset(manifest, materialize(audit_files(manifest, root)), labels, window_seconds)


def validate_folder_strict(*args, **kwargs) -> DataFrame:
    counts, violations = validate_folder(*args, **kwargs)
    require_none(violations, "dataset validation failed")
    return counts


def build_mixing_pool(
    train: DataFrame, heldout: DataFrame, sources: DataFrame, background: str = "background"
) -> tuple[DataFrame, DataFrame]:
    """(background clips that may be mixed into training, held-out rows they overlap)."""
    crops = train.where((F.col("label") == background) & (F.col("split") == "train"))
    pool = checks.mixing_eligibility(crops, sources).where("eligible")
    return pool, joins.heldout_overlap(pool, heldout)


def build_mixing_pool_strict(train, heldout, sources, background="background") -> DataFrame:
    require_none(checks.duplicate_sources(sources), "duplicate background source")
    pool, overlap = build_mixing_pool(train, heldout, sources, background)
    if pool.isEmpty():
        raise ValueError("no background clip may be mixed")
    require_none(overlap, "the background pool overlaps held-out rows")
    return pool
