"""Label maps, split manifests and session manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirrup.functions.scan import numbered

SPLITS = ("train", "val", "test")

MANIFEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("path", "label", "split", "id", "sha256")]
    + [T.StructField(n, T.StringType()) for n in ("speaker_group", "parent_id", "source_group")]
    + [T.StructField(n, T.StringType()) for n in ("sample_kind", "engine", "speaker", "evaluation_group")]
    + [T.StructField("use_for_mixing", T.BooleanType())]
)
SESSION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("wav", "label", "text", "speaker", "condition", "error")]
    + [T.StructField("accepted", T.BooleanType())]
)


def require_none(violations: DataFrame, message: str) -> None:
    """Strict mode: fail on the first row of a violations table."""
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"{message}: {first[0].asDict()}")


def parse_labels(documents: DataFrame) -> DataFrame:
    """JSON objects {name: id} in `value` to (label, label_id); a non-integer id becomes NULL."""
    pairs = F.explode(F.map_entries(F.from_json("value", "map<string,string>")))
    text = F.col("kv.value")
    return documents.select(pairs.alias("kv")).select(
        F.col("kv.key").alias("label"),
        F.when(text.rlike(r"^-?\d+$"), text.cast("bigint")).alias("label_id"),
    )


def label_faults(labels: DataFrame) -> DataFrame:
    """One row when the ids are not the integers 0..n-1, each used once."""
    s = labels.agg(
        F.count("*").alias("n"),
        F.count_distinct("label_id").alias("ids"),
        F.min("label_id").alias("low"),
        F.max("label_id").alias("high"),
    )
    ok = (F.col("n") > 0) & (F.col("ids") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    return s.where(~F.coalesce(ok, F.lit(False)))


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    labels = parse_labels(spark.read.text(path, wholetext=True))
    require_none(label_faults(labels), "label ids must be unique and contiguous from 0")
    return labels


def parse_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON text in `value` to columns.  Blank lines go; unparsable ones keep their text in `corrupt`.

    An absent key and a JSON null both become NULL.
    """
    text = F.regexp_replace("value", "^﻿", "")
    with_corrupt = T.StructType(schema.fields + [T.StructField("corrupt", T.StringType())])
    row = F.from_json(text, with_corrupt, {"columnNameOfCorruptRecord": "corrupt"})
    others = [c for c in lines.columns if c != "value"]
    return lines.where(F.trim(text) != "").select(*others, row.alias("_r")).select(*others, "_r.*")


def parse_manifest(lines: DataFrame) -> DataFrame:
    """Lines with their `file_split` to manifest rows; the split defaults to the file's."""
    rows = parse_lines(lines, MANIFEST)
    return rows.withColumn("declared_split", F.col("split")).withColumn("split", F.col("file_split"))


def manifest_faults(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that are unparsable, lack a field, name an unknown label or another file's split."""
    known = labels.select("label").withColumn("_known", F.lit(True))
    reason = (
        F.when(F.col("corrupt").isNotNull(), "unparsable")
        .when(F.col("path").isNull() | F.col("label").isNull(), "missing_field")
        .when(F.col("_known").isNull(), "unknown_label")
        .when(F.col("declared_split") != F.col("split"), "wrong_split")
    )
    return rows.join(known, "label", "left").withColumn("reason", reason).drop("_known").where("reason is not null")


def _lines(spark: SparkSession, paths, **options) -> DataFrame:
    """Text lines with the file and a value that grows with the position in it.

    A file cut into several reads keeps its order: the cut's offset comes first,
    then the running number that the reading task gives.
    """
    return spark.read.options(**options).text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_offset"),
        F.monotonically_increasing_id().alias("line_order"),
    )


def load_manifest(spark: SparkSession, root: str, labels: DataFrame, splits=SPLITS) -> DataFrame:
    """Rows of splits/<name>.jsonl, each with its record_index (position in its file).

    That may be a folder of parts, which are read in the order of their names.
    """
    lines = _lines(spark, [f"{root.rstrip('/')}/splits/{s}.jsonl" for s in splits])
    lines = lines.where(F.trim("value") != "")
    lines = lines.withColumn("file_split", F.regexp_extract("file_path", r"([^/]+)\.jsonl(?:/[^/]+)?$", 1))
    order = ["file_path", "file_offset", "line_order"]
    lines = numbered(lines, ["file_split"], order, F.struct("file_path", "file_offset"), "record_index")
    rows = parse_manifest(lines.drop("file_offset", "line_order", "file_path"))
    require_none(manifest_faults(rows, labels), "invalid manifest row")
    filled = {r.split for r in rows.select("split").distinct().collect()}
    if missing := set(splits) - filled:
        raise ValueError(f"empty manifest: {sorted(missing)}")
    return rows.drop("corrupt", "file_split")


def load_session_manifests(spark: SparkSession, root: str, pattern: str = "manifest.jsonl") -> DataFrame:
    """Rows of every session manifest below `root`: its folder relative to it, and record_index in its file."""
    lines = _lines(spark, root, recursiveFileLookup=True, pathGlobFilter=pattern)
    if not lines.inputFiles():
        raise ValueError(f"no {pattern} below {root}")
    lines = lines.where(F.trim("value") != "")
    lines = numbered(lines, ["file_path"], ["file_offset", "line_order"], F.col("file_offset"), "record_index")
    below = F.element_at(F.split("file_path", root.rstrip("/").removeprefix("file:") + "/", 2), 2)
    lines = lines.withColumn("folder", F.regexp_replace(below, r"/?[^/]*$", ""))
    return parse_lines(lines.drop("file_offset", "line_order", "file_path"), SESSION)
