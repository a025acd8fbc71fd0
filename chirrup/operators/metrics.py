"""Clip predictions and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirrup.operators.joins import encode_labels
from chirrup.functions.arrays import bounded, log_softmax, normalized, top1, total
from chirrup.session import materialize


def with_probabilities(scored: DataFrame, kind: str = "logits", column: str = "scores") -> DataFrame:
    """Adds log_p and p (arrays by label id) from logits or from near-normalised probabilities."""
    if kind == "logits":
        return scored.withColumn("log_p", log_softmax(F.col(column))).withColumn("p", F.transform("log_p", F.exp))
    p = scored.withColumn("p", normalized(F.col(column)))
    return p.withColumn("log_p", F.transform("p", lambda x: F.ln(F.greatest(x, F.lit(1e-12)))))


def top_class(scored: DataFrame, labels: DataFrame, p: str = "p") -> DataFrame:
    """Adds predicted_id, predicted_label and confidence."""
    names = bounded(labels.select(F.col("label_id").alias("predicted_id"), F.col("label").alias("predicted_label")))
    ranked = scored.withColumn("predicted_id", top1(F.col(p))).withColumn("confidence", F.array_max(p))
    return ranked.join(names, "predicted_id")


def smoothed_loss(log_p: Column, target: Column, smoothing: float = 0.1) -> Column:
    picked = F.element_at(log_p, (target + 1).cast("int"))
    return -(1 - smoothing) * picked - smoothing * total(log_p) / F.size(log_p)


def predictions(scored: DataFrame, labels: DataFrame, kind: str = "logits", smoothing: float = 0.1) -> DataFrame:
    """One row per clip: true and predicted class, correctness, loss and confidences.

    `scored` has record_index, path, label, scores and, optionally, length_action.
    """
    rows = with_probabilities(encode_labels(scored, labels), kind)
    rows = top_class(rows, labels)
    action = F.col("length_action") if "length_action" in rows.columns else F.lit("unchanged")
    return rows.select(
        "record_index",
        "path",
        F.col("label").alias("true_label"),
        F.col("label_id").alias("true_id"),
        "predicted_label",
        "predicted_id",
        (F.col("label_id") == F.col("predicted_id")).cast("int").alias("correct"),
        smoothed_loss(F.col("log_p"), F.col("label_id"), smoothing).alias("loss"),
        action.alias("length_action"),
        "confidence",
        F.element_at("p", (F.col("label_id") + 1).cast("int")).alias("true_class_probability"),
        "p",
    )


def confusion_matrix(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts per (true_id, predicted_id), zeros included: K*K rows for K label ids."""
    counts = predicted.groupBy("true_id", "predicted_id").agg(F.count("*").alias("n"))
    ids = labels.agg(F.array_sort(F.collect_set("label_id")).alias("ids"))
    grid = ids.select("ids", F.explode("ids").alias("true_id")).select("true_id", F.explode("ids").alias("predicted_id"))
    return grid.join(counts, ["true_id", "predicted_id"], "left").select(
        "true_id", "predicted_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_metrics(confusion: DataFrame, labels: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; a ratio over zero is 0."""
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("true_id") == F.col("predicted_id"), F.col("n")).otherwise(zero)

    def side(label_id, support, predicted, tp):
        return F.struct(label_id.alias("label_id"), support.alias("support"), predicted.alias("predicted"), tp.alias("tp"))

    n = F.col("n")
    sides = F.array(side(F.col("true_id"), n, zero, hit), side(F.col("predicted_id"), zero, n, zero))
    cells = confusion.select(F.inline(sides))
    sums = cells.groupBy("label_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("support", "predicted", "tp")])
    precision, recall = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    out = sums.withColumn("precision", precision).withColumn("recall", recall)
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return labels.join(out.withColumn("f1", f1), "label_id").select("label_id", "label", "precision", "recall", "f1", "support", "tp")


def classification_metrics(confusion: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per-class rows, one overall row: count, accuracy, macro_f1 over all labels)."""
    # A few rows that stand for a pass over all predictions: stored, as both results read them.
    classes = materialize(class_metrics(confusion, labels))
    overall = classes.agg(
        F.sum("support").alias("count"), _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1")
    )
    return classes.drop("tp"), overall


def classification_report(confusion: DataFrame, labels: DataFrame) -> DataFrame:
    """Class rows, and their plain and support-weighted averages."""
    weighted = "weighted avg"
    rows = class_metrics(confusion, labels).withColumn("label", F.explode(F.array("label", F.lit("macro avg"), F.lit(weighted))))

    def mean(name):
        by_support = _ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))
        return F.when(F.col("label") == weighted, by_support).otherwise(F.avg(name)).alias(name)

    return rows.groupBy("label").agg(*map(mean, ("precision", "recall", "f1")), F.sum("support").alias("support"))


def supported_macro_f1(classes: DataFrame) -> DataFrame:
    """Mean F1 of the classes that occur; an evaluation without any stops the job."""
    mean = F.avg(F.when(F.col("support") > 0, F.col("f1")))
    refused = F.raise_error(F.lit("the evaluation has no supported class")).cast("double")
    return classes.agg(F.coalesce(mean, refused).alias("supported_macro_f1"))


def paired_comparison(paired: DataFrame, labels: DataFrame) -> DataFrame:
    """Old against new accuracy for all clips and per class; a class without clips has NULLs."""
    old, new = F.col("old_correct"), F.col("new_correct")
    per = paired.rollup("true_label").agg(
        F.when(F.grouping("true_label") == 1, "all").otherwise(F.col("true_label")).alias("label"),
        F.count("*").alias("count"),
        F.sum(old).alias("old"),
        F.sum(new).alias("new"),
        F.count_if((old == 0) & (new == 1)).alias("improved"),
        F.count_if((old == 1) & (new == 0)).alias("regressed"),
    ).drop("true_label")
    every = labels.select("label").unionByName(labels.agg(F.lit("all").alias("label")))
    rows = every.join(per, "label", "left")
    n = F.coalesce("count", F.lit(0))
    return rows.select(
        "label",
        n.cast("bigint").alias("count"),
        F.try_divide("old", n).alias("old_accuracy"),
        F.try_divide("new", n).alias("new_accuracy"),
        F.try_divide(F.col("new") - F.col("old"), n).alias("delta_accuracy"),
        F.coalesce("improved", F.lit(0)).cast("bigint").alias("improved"),
        F.coalesce("regressed", F.lit(0)).cast("bigint").alias("regressed"),
    )


def length_action_counts(fitted: DataFrame) -> DataFrame:
    """Clips per length action, and how many were resampled on the way."""
    flags = F.array_compact(F.array("length_action", F.when(F.col("resampled"), F.lit("resampled"))))
    return fitted.select(F.explode(flags).alias("action")).groupBy("action").agg(F.count("*").alias("n"))
