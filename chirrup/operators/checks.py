"""Row checks.  Each returns what it found; callers decide whether to stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirrup.functions.arrays import bounded
from chirrup.functions.paths import inside_root, normal_path, record_id, safe_id
from chirrup.sources.manifests import SPLITS

EXEMPT = ("unknown", "background")
MIXABLE_KIND = "procedural_noise"


def path_inside_root(df: DataFrame, path: str = "path") -> DataFrame:
    return df.withColumn("normal_path", normal_path(F.col(path))).withColumn("inside_root", inside_root(F.col(path)))


def derive_record_id(df: DataFrame, id_col: str | None = "id", path_col: str = "path", prefix: str = "") -> DataFrame:
    given = F.col(id_col) if id_col else None
    return df.withColumn("record_id", record_id(given, F.col(path_col), prefix)).withColumn(
        "safe_id", safe_id(F.col("record_id"))
    )


def check_membership(manifest: DataFrame, labels: DataFrame, splits=SPLITS) -> DataFrame:
    """Rows whose label or split is unknown, or whose declared split is not their file's."""
    known = labels.select("label").withColumn("_known", F.lit(True))
    reason = F.when(F.col("_known").isNull(), "unknown_label").when(~F.col("split").isin(*splits), "unknown_split")
    if "declared_split" in manifest.columns:
        reason = reason.when(F.col("declared_split") != F.col("split"), "wrong_split")
    rows = manifest.join(bounded(known), "label", "left").withColumn("reason", reason)
    return rows.where("reason is not null").drop("_known")


def too_long(window_seconds: float, sample_rate: int, exempt=EXEMPT) -> Column:
    return ~F.col("label").isin(*exempt) & (F.col("frames") > round(window_seconds * sample_rate))


def filter_long_commands(
    manifest: DataFrame, window_seconds: float = 3.0, sample_rate: int = 16000, exempt=EXEMPT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept rows, dropped rows and dropped counts: commands longer than the window go."""
    long = too_long(window_seconds, sample_rate, exempt)
    dropped = manifest.where(long).withColumn("duration_s", F.col("frames") / F.lit(sample_rate))
    return manifest.where(~long), dropped, dropped.groupBy("split", "label").agg(F.count("*").alias("dropped"))


def emptied_splits(manifest: DataFrame, window_seconds=3.0, sample_rate=16000, exempt=EXEMPT) -> DataFrame:
    """Splits that lose every row to the length filter."""
    long = too_long(window_seconds, sample_rate, exempt)
    return manifest.groupBy("split").agg(F.count_if(~long).alias("kept")).where("kept = 0")


def finite(samples: Column) -> Column:
    """No NaN and no infinity (Spark orders NaN above infinity, so both need a test)."""
    return F.forall(samples, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def validate_audio_format(clips: DataFrame, sample_rate: int = 16000) -> DataFrame:
    """Adds `fault`: the first format rule that the clip breaks, or NULL."""
    channels = F.col("channels") if "channels" in clips.columns else F.lit(1)
    frames = F.col("frames") if "frames" in clips.columns else F.size("samples")
    fault = (
        F.when(F.col("sample_rate") != sample_rate, "sample_rate")
        .when(channels != 1, "channels")
        .when(frames <= 0, "empty")
        .when(~finite(F.col("samples")), "nonfinite")
    )
    return clips.withColumn("fault", fault)


def verify_checksum(manifest: DataFrame, files: DataFrame, declared: str = "sha256") -> DataFrame:
    """Rows whose declared checksum differs from the file's; no declaration is no fault."""
    actual = files.select("path", F.col("sha256").alias("actual_sha256"))
    wanted = F.col(declared)
    rows = manifest.where(wanted.isNotNull() & (wanted != ""))
    return rows.join(actual, "path").where(wanted != F.col("actual_sha256"))


def is_entity(entity: str) -> Column:
    same_group = F.col("evaluation_group").eqNullSafe(F.lit(entity))
    return same_group | F.lower(F.coalesce("speaker", F.lit(""))).eqNullSafe(F.lit(entity.lower()))


def holdout_entity(manifest: DataFrame, entity: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows kept in their splits, held-out test rows, held-out rows found elsewhere)."""
    mine = is_entity(entity)
    held = manifest.where(mine & (F.col("split") == "test")).withColumns(
        {
            "evaluation_group": F.lit(entity),
            "engine": F.lit("real"),
            "sample_kind": F.lit("human_recording"),
            "speaker_group": F.lit(f"human:{entity}"),
        }
    )
    return manifest.where(~mine), held, manifest.where(mine & ~F.col("split").eqNullSafe("test"))


def recorder_acceptance(sessions: DataFrame) -> DataFrame:
    """Session rows that carry a recording; `reason` is set where it was not accepted."""
    accepted = F.col("accepted").eqNullSafe(True) & (F.coalesce("error", F.lit("")) == "")
    return sessions.where("wav is not null").withColumn("reason", F.when(~accepted, "recorder_not_accepted"))


def is_synthetic_test() -> Column:
    human = F.col("sample_kind").eqNullSafe("human_recording")
    return F.col("split").eqNullSafe("test") & ~human & ~F.col("engine").eqNullSafe("real")


def evaluation_views(accepted: DataFrame, held_out: Column) -> dict[str, DataFrame]:
    """The manifest, the held-out rows (never in it) and its synthetic test part."""
    inside = accepted.where(~F.coalesce(held_out, F.lit(False)))
    return {
        "manifest": inside,
        "held_out": accepted.where(F.coalesce(held_out, F.lit(False))),
        "synthetic_test": inside.where(is_synthetic_test()),
    }


def duplicate_sources(sources: DataFrame) -> DataFrame:
    return sources.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def mixing_eligibility(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds `eligible`: may this background clip be mixed into training speech?

    The first rule that applies decides: the row's own refusal, its source's
    flag, procedural noise, an unknown parent, and last the sample kind.
    """
    flags = sources.select(F.col("id").alias("parent_id"), F.coalesce("use_for_mixing", F.lit(False)).alias("_flag"), F.lit(True).alias("_found"))
    kind = F.coalesce("sample_kind", F.lit(""))
    rule = (
        F.when(~F.coalesce("use_for_mixing", F.lit(True)), False)
        .when(F.col("_found"), F.col("_flag"))
        .when(kind == MIXABLE_KIND, True)
        .when(F.coalesce("parent_id", F.lit("")) != "", False)
        .otherwise(kind != "source_crop")
    )
    return rows.join(flags, "parent_id", "left").withColumn("eligible", rule).drop("_flag", "_found")


def check_scores(scored: DataFrame, classes: int, kind: str = "logits", column: str = "scores") -> DataFrame:
    """Adds `fault` for score vectors that are not what `kind` says."""
    s = F.col(column)
    total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    fault = F.when(F.coalesce(F.size(s), F.lit(-1)) != classes, "shape").when(~finite(s), "nonfinite")
    if kind == "probabilities":
        fault = fault.when(F.exists(s, lambda x: (x < 0) | (x > 1)), "range").when(
            F.abs(total - 1) > 0.02 + 1e-5, "sum"
        )
    return scored.withColumn("fault", fault)


def capture_error_guard(recordings: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Adds `usable`: false where the recording's sidecar reports a capture error."""
    bad = sidecars.where(F.coalesce("error", F.lit("")) != "").select("recording_id").distinct()
    return recordings.join(bad.withColumn("_bad", F.lit(True)), "recording_id", "left").select(
        *recordings.columns, F.col("_bad").isNull().alias("usable")
    )


def level_flags(levels: DataFrame, quiet_dbfs: float = -35.0, clip_fraction: float = 0.001) -> DataFrame:
    return levels.withColumn("too_quiet", F.col("peak_dbfs").isNull() | (F.col("peak_dbfs") < quiet_dbfs)).withColumn(
        "clipping", F.col("clipped_fraction") > clip_fraction
    )
