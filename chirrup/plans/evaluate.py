"""Whole evaluations: clips, long recordings, and two models side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirrup.functions.arrays import fit_length, label_names
from chirrup.operators import joins, metrics
from chirrup.operators.checks import check_scores
from chirrup.session import materialize
from chirrup.sources.manifests import require_none
from chirrup.sources.reports import wide_confusion, wide_probabilities, write_report

Scorer = Callable[[DataFrame], DataFrame]


def fit_clips(clips: DataFrame, n: int, **policy) -> tuple[DataFrame, DataFrame]:
    """(clips of length n, clips skipped as too long), each with its length_action."""
    samples, action = fit_length(F.col("samples"), n, F.col("label"), **policy)
    skipped = F.col("length_action") == "skipped_long"
    judged = clips.withColumn("length_action", action)
    return judged.where(~skipped).withColumn("samples", samples), judged.where(skipped)


def evaluate_clips(
    clips: DataFrame, labels: DataFrame, scorer: Scorer, n: int, kind: str = "logits", smoothing: float = 0.1,
    strict: bool = False, **policy,
) -> dict[str, DataFrame]:
    """Fit, score and judge clips (record_index, path, label, samples, resampled).

    `scorer` adds a `scores` array to a DataFrame; see plans.scoring.
    """
    kept, skipped = fit_clips(clips, n, **policy)
    scored = scorer(kept)
    if strict:
        require_none(check_scores(scored, labels.count(), kind).where("fault is not null"), "invalid scores")
    # The model runs once; everything below reads its stored, narrow predictions.
    predicted = materialize(metrics.predictions(scored, labels, kind, smoothing))
    confusion = metrics.confusion_matrix(predicted, labels)
    fitted = kept.select("length_action", "resampled").unionByName(skipped.select("length_action", "resampled"))
    return {
        "predictions": predicted,
        "skipped": skipped.select("record_index", "path", "label", F.col("length_action").alias("reason")),
        "confusion": confusion,
        "report": metrics.classification_report(confusion, labels),
        "actions": metrics.length_action_counts(fitted),
        "summary": predicted.agg(
            F.count("*").alias("evaluated"), F.avg("correct").alias("accuracy"), F.avg("loss").alias("loss")
        ),
    }


def compare_models(old: DataFrame, new: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """Predictions of two models on the same clips: pairs, accuracy changes and supported macro-F1."""
    paired = joins.pair_predictions(old, new)
    per_model = {}
    for name, rows in (("old", old), ("new", new)):
        confusion = metrics.confusion_matrix(rows, labels)
        per_model[name] = metrics.supported_macro_f1(metrics.class_metrics(confusion, labels)).withColumn("model", F.lit(name))
    return {
        "paired": paired,
        "by_class": metrics.paired_comparison(paired.where("aligned"), labels),
        "supported_macro_f1": per_model["old"].unionByName(per_model["new"]),
    }


def compare_models_strict(
    old: DataFrame, new: DataFrame, labels: DataFrame, old_digest: str, new_digest: str, expected_rows: int,
    skipped: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """As compare_models, refusing equal models, skipped clips and any misalignment."""
    if old_digest == new_digest:
        raise ValueError("the two models are identical")
    if skipped is not None:
        require_none(skipped, "a model skipped clips")
    out = compare_models(old, new, labels)
    require_none(joins.alignment_faults(out["paired"], expected_rows), "the models did not score the same clips")
    return out


def compare_on_views(
    views: dict[str, DataFrame], labels: DataFrame, old_scorer: Scorer, new_scorer: Scorer, old_digest: str, new_digest: str, n: int, **settings
) -> dict[str, dict[str, DataFrame]]:
    """Two models on several evaluation views, each without skipped clips and without label smoothing."""
    if old_digest == new_digest:
        raise ValueError("the two models are identical")
    out = {}
    for name, clips in views.items():
        known = clips.join(labels.select("label"), "label", "left_anti").where("label is not null")
        require_none(known.select("record_index", "label"), f"{name}: unknown label")
        old, new = (evaluate_clips(clips, labels, s, n, smoothing=0.0, long="error", **settings) for s in (old_scorer, new_scorer))
        rows = clips.count()
        if not rows:
            raise ValueError(f"{name}: the view is empty")
        skipped = joins.skipped_set_difference(old["skipped"], new["skipped"])
        out[name] = compare_models_strict(old["predictions"], new["predictions"], labels, old_digest, new_digest, rows, skipped)
    return out


def write_evaluation(result: dict[str, DataFrame], labels: DataFrame, path: str) -> None:
    """Predictions, skipped rows, confusion, report and actions as CSV, the summary as JSON."""
    names = label_names(labels)
    tables = {
        "predictions": wide_probabilities(result["predictions"].drop("true_id", "predicted_id"), names),
        "skipped": result["skipped"],
        "confusion": wide_confusion(result["confusion"], names),
        "report": result["report"],
        "actions": result["actions"],
        "metrics": result["summary"],
    }
    write_report(tables, path)
