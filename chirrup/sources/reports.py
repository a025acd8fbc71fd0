"""Curated datasets, evaluation reports and file fingerprints on storage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chirrup.operators.checks import evaluation_views
from chirrup.sources.audio import encode_wav
from chirrup.sources.manifests import SPLITS
from chirrup.sources.wav_sink import write_files

PREDICTION = """record_index bigint, path string, true_label string, predicted_label string, correct int, loss double,
length_action string, confidence double, true_class_probability double"""
SKIPPED = "record_index bigint, path string, label string, reason string"


def wide_probabilities(predictions: DataFrame, names: list[str], p: str = "p") -> DataFrame:
    """The probability array as one column p_<name> per class."""
    return predictions.select("*", *[F.get(p, F.lit(i)).alias(f"p_{n}") for i, n in enumerate(names)]).drop(p)


def wide_confusion(confusion: DataFrame, names: list[str]) -> DataFrame:
    """One row per true class, one column per predicted class."""
    ids = list(range(len(names)))
    rows = confusion.groupBy("true_id").pivot("predicted_id", ids).agg(F.sum("n"))
    label = F.element_at(F.array(*map(F.lit, names)), (F.col("true_id") + 1).cast("int"))
    return rows.select(label.alias("true / predicted"), *[F.col(str(i)).alias(names[i]) for i in ids])


def no_nan(df: DataFrame) -> DataFrame:
    """Stop the job on a NaN or infinite number: a report may only have numbers and NULLs."""
    def guard(name):
        x = F.col(f"`{name}`")
        odd = F.isnan(x) | (F.abs(x) == float("inf"))
        return F.when(odd, F.raise_error(F.lit(f"non-finite value in {name}")).cast("double")).otherwise(x).alias(name)

    numbers = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*[guard(n) if n in numbers else F.col(f"`{n}`") for n in df.columns])


def write_report(tables: dict[str, DataFrame], path: str, json: tuple[str, ...] = ("metrics",)) -> None:
    """Each table to <path>/<name>: JSON for the named ones, CSV with a header for the rest."""
    for name, df in tables.items():
        writer = no_nan(df).write.mode("errorifexists")
        if name in json:
            writer.json(f"{path}/{name}")
        else:
            writer.option("header", True).csv(f"{path}/{name}")


def read_predictions(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """A predictions CSV; with class names the p_<name> columns come back as one array p."""
    schema = PREDICTION + "".join(f", `p_{n}` double" for n in names or [])
    rows = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    if not names:
        return rows
    return rows.withColumn("p", F.array(*[f"`p_{n}`" for n in names])).drop(*[f"p_{n}" for n in names])


def read_skipped(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SKIPPED).csv(path, header=True, enforceSchema=False)


def write_curated(
    accepted: DataFrame, excluded: DataFrame, held_out: Column, report: DataFrame, path: str, labels: DataFrame | None = None
) -> None:
    """A dataset on storage: audio as WAV files, splits/<name>.jsonl in record order, the manifest, excluded rows, both views, the report.

    Where the rows have samples they become 16-bit files at the rows' paths,
    published only when all are written; no other output holds samples.  With `labels` the label map
    is written too, so that `load_labels` and `load_manifest` read the folder
    again.  A split is a folder of parts in the order of `position` (or
    record_index).  The report comes last: a folder without it is an unfinished write.
    """
    outside = ("samples", "position")
    files = []
    if "samples" in accepted.columns:
        files.append(encode_wav(accepted.select("path", "samples")).select("path", "content"))
    if labels is not None:
        pairs = labels.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "label_id")))).alias("m"))
        files.append(pairs.select(F.lit("labels.json").alias("path"), F.to_json("m").cast("binary").alias("content")))
    if files:
        write_files(reduce(DataFrame.union, files), path)
    views = evaluation_views(accepted, held_out)
    order = "position" if "position" in accepted.columns else "record_index"
    for split in SPLITS:
        rows = views["manifest"].where(F.col("split") == split).repartitionByRange(order).sortWithinPartitions(order)
        rows.drop(*outside).write.mode("errorifexists").json(f"{path}/splits/{split}.jsonl")
    tables = {"manifest": views["manifest"], "excluded": excluded, "evaluation/held_out": views["held_out"], "evaluation/synthetic_test": views["synthetic_test"]}
    for name, rows in tables.items():
        writer = rows.drop(*outside).write.mode("errorifexists")
        writer.parquet(f"{path}/{name}") if name == "manifest" else writer.json(f"{path}/{name}")
    report.write.mode("errorifexists").json(f"{path}/report")


def fingerprints(files: DataFrame, kind: str, settings: dict[str, str]) -> DataFrame:
    """A measurement row per input: its sha256 with the run's kind, time and settings."""
    pairs = [F.lit(str(x)) for item in settings.items() for x in item]
    return files.select(
        F.lit(kind).alias("kind"), F.current_timestamp().alias("created_at"), "path", F.sha2("content", 256).alias("sha256"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("settings"),
    )


def fingerprint_files(spark: SparkSession, paths, kind: str, settings: dict[str, str], log: str | None = None) -> DataFrame:
    """Fingerprint the files; with `log`, append the rows to that parquet table."""
    rows = fingerprints(spark.read.format("binaryFile").load(paths), kind, settings)
    if log:
        rows.write.mode("append").parquet(log)
    return rows


def same_inputs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inputs whose contents differ between two measurements, or that only one has."""
    left, right = a.select("path", F.col("sha256").alias("old")), b.select("path", F.col("sha256").alias("new"))
    return left.join(right, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
