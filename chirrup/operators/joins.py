"""Lookups, alignments and random pairings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirrup.functions.arrays import bounded
from chirrup.functions.paths import normal_path
from chirrup.functions.rand import unit, uniform_int
from chirrup.functions.scan import numbered


def encode_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their label_id; a label that the map lacks stops the job where its id is read."""
    found = df.drop("label_id").join(bounded(labels.select("label", "label_id")), "label", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("null")))).cast("bigint")
    return found.withColumn("label_id", F.coalesce(F.col("label_id"), unknown))


def missing_audio(manifest: DataFrame, files: DataFrame) -> DataFrame:
    gone = manifest.join(files.select("path"), "path", "left_anti")
    return gone.withColumn("reason", F.concat(F.lit("missing_audio:"), "path"))


def background_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Crops with their source's flag; a crop without a listed source keeps NULLs."""
    listed = sources.select(F.col("id").alias("parent_id"), F.col("use_for_mixing").alias("source_use_for_mixing"))
    return rows.join(listed, "parent_id", "left")


def heldout_overlap(pool: DataFrame, heldout: DataFrame) -> DataFrame:
    """Held-out rows that share a path, however it is spelled, or a source group with the mixing pool."""
    groups = pool.where("source_group <> ''").select("source_group").distinct()
    paths = pool.select(normal_path(F.col("path")).alias("_place"))
    by_path = heldout.join(paths, normal_path(heldout["path"]) == paths["_place"], "left_semi").withColumn("shared", F.lit("path"))
    by_group = heldout.join(groups, "source_group", "left_semi").withColumn("shared", F.lit("source_group"))
    return by_path.unionByName(by_group)


def pair_predictions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two prediction sets side by side; `aligned` is false where one side lacks the row."""
    keys = ["record_index", "path", "true_label"]

    def side(df, name):
        return df.select(
            *keys,
            F.col("predicted_label").alias(f"{name}_prediction"),
            F.col("correct").alias(f"{name}_correct"),
            F.col("confidence").alias(f"{name}_confidence"),
        )

    both = side(old, "old").join(side(new, "new"), keys, "full_outer")
    return both.withColumn("aligned", F.col("old_correct").isNotNull() & F.col("new_correct").isNotNull())


def alignment_faults(paired: DataFrame, expected_rows: int) -> DataFrame:
    """One row when the sets are not the same `expected_rows` records, each once."""
    s = paired.agg(F.count("*").alias("n"), F.count_if("aligned").alias("aligned_rows"))
    return s.where((F.col("n") != expected_rows) | (F.col("aligned_rows") != expected_rows))


def same_clips_guard(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one side has, as often as it has them more: both differences in one shuffle."""
    both = old.withColumn("_n", F.lit(1)).unionByName(new.withColumn("_n", F.lit(-1)))
    extra = both.groupBy(*old.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, "old").otherwise("new")
    return extra.select(*old.columns, F.explode(F.array_repeat(side, F.abs("_n").cast("int"))).alias("side"))


def skipped_set_difference(skipped_a: DataFrame, skipped_b: DataFrame) -> DataFrame:
    return same_clips_guard(skipped_a, skipped_b)


def eligible_pairs(
    detections: DataFrame, events: DataFrame, early: float = 0.0, late: float = 1.0, bucket_seconds: float = 60.0
) -> DataFrame:
    """Detection and event pairs of one recording and class with start-early <= t <= end+late.

    Time buckets turn the range test into an equi join, and spread a long
    recording over many keys.
    """
    low, high = F.col("start_seconds") - early, F.col("end_seconds") + late

    def bucket(x: Column) -> Column:
        return F.floor(x / bucket_seconds)

    spread = events.select(
        "recording_id", "label", "event_id", "start_seconds", "end_seconds",
        F.explode(F.sequence(bucket(low), bucket(high))).alias("_bucket"),
    )
    found = detections.withColumn("_bucket", bucket(F.col("time_seconds")))
    pairs = found.join(spread, ["recording_id", "label", "_bucket"])
    return pairs.where(F.col("time_seconds").between(low, high)).drop("_bucket")


def index_pool(pool: DataFrame, key: str) -> DataFrame:
    """Number the pool's rows 0..n-1 in the order of md5(key), as pool_index."""
    keyed = pool.withColumn("_all", F.lit(0)).withColumn("_digest", F.md5(F.col(key).cast("string")))
    out = numbered(keyed, ["_all"], ["_digest", key], F.substring("_digest", 1, 3), "pool_index")
    return out.drop("_all", "_digest")


BROADCAST_BYTES = 64 << 20


def pool_size(pool: DataFrame, value: str | None = None) -> tuple[int, int]:
    """(rows, bytes of the `value` arrays) of a pool, measured before it is joined."""
    size = F.sum(F.size(value) * 8 + 64) if value else F.count("*") * 64
    rows, weight = pool.agg(F.count("*"), size).first()
    if not rows:
        raise ValueError("the pool is empty")
    return rows, weight


def random_pool_pick(
    clips: DataFrame, key: str, pool: DataFrame, pool_key: str, salt: str, seed: int = 42, spread: int = 512
) -> DataFrame:
    """Each clip with one pool row, chosen uniformly by the clip's key.

    A small pool gives few join keys, so each pool row is copied under several
    salts and the clips spread over them; Spark broadcasts the pool by itself
    when its measured size allows.
    """
    n, _ = pool_size(pool)
    copies = max(1, spread // n)
    salted = index_pool(pool, pool_key).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    pick = uniform_int(unit(F.col(key), salt, seed), F.lit(0), F.lit(n - 1))
    copy = F.pmod(F.xxhash64(key), F.lit(copies)).cast("int")
    picked = clips.withColumn("pool_index", pick).withColumn("_copy", copy)
    return picked.join(salted, ["pool_index", "_copy"]).drop("_copy")
