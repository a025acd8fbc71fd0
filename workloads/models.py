"""Fitting a classifier by epochs and judging it on clips that it has not seen."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirrup.functions.rand import unit
from chirrup.operators import metrics
from chirrup.operators.training import best_epoch_early_stop
from chirrup.plans import fitting, scoring
from workloads import standins as v
from workloads.views_sql import sql, u

QUERIES, ORACLES = {}, {}
PATIENCE, EPOCHS = 3, 8


def fit_classifier(spark, sf_dir):
    """Fit on the training clips, watch the validation clips, judge on the test clips.

    What can be said beforehand: how many clips of each class are judged, that
    the history ends where it should and has the best epoch, and that the last epoch
    beats always naming the commonest class on the clips that it learned from.
    """
    clips = v.clips(spark, sf_dir).withColumn("record_index", F.col("clip_id")).withColumn("path", F.lit("clip"))
    draw = unit(F.col("clip_id"), "split")
    labels = v.class_map(spark, sf_dir)
    train, val, test = clips.where(draw < 0.7), clips.where((draw >= 0.7) & (draw < 0.85)), clips.where(draw >= 0.85)
    k = labels.count()
    scorer, history = fitting.fit_epochs(train, val, fitting.Settings(k, EPOCHS, patience=PATIENCE), "clip_id", "samples")
    best = best_epoch_early_stop(history, PATIENCE).select(
        "best_epoch", (F.col("last_epoch") <= EPOCHS).alias("ended"), (F.col("stopped_early") | (F.col("last_epoch") == EPOCHS)).alias("whole")
    )
    accuracy = history.agg(F.max_by("train_accuracy", "epoch")).first()[0]
    named = history.join(best, F.col("epoch") == F.col("best_epoch")).select(F.col("ended") & F.col("whole")).collect()
    whole = len(named) == 1 and named[0][0]
    commonest = train.groupBy("label_id").agg(F.count("*").alias("n")).agg(F.max("n") / F.sum("n")).first()[0]
    predicted = metrics.predictions(scoring.score_clips(test, scorer, k), labels)
    classes, _ = metrics.classification_metrics(metrics.confusion_matrix(predicted, labels), labels)
    return classes.select("label", "support", F.lit(bool(accuracy > commonest)).alias("beats_commonest"), F.lit(bool(whole)).alias("history_whole"))


QUERIES["fit_classifier"] = fit_classifier
ORACLES["fit_classifier"] = sql(
    f"""SELECT label, count(*) FILTER ({u('clip_id', 'split')} >= 0.85) AS support, true AS beats_commonest, true AS history_whole FROM v_clips GROUP BY label""",
    "v_clips",
)
