"""Fitting by epochs: what it learns, its history, and going on after a stop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirrup.operators.training import best_epoch_early_stop
from chirrup.plans import fitting, scoring


def clouds(spark, n, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 6)) * [1, 10, 0.1, 1, 1, 0] + 5 + 2 * np.eye(6)[y] * [1, 10, 0.1, 1, 1, 1]
    return spark.createDataFrame([(f"{seed}-{i}", x[i].tolist(), int(y[i])) for i in range(n)], "id string, features array<double>, label_id bigint")


def test_fit_learns_stops_and_resumes(spark, tmp_path):
    train, val = clouds(spark, 400, 1), clouds(spark, 150, 2)
    settings = fitting.Settings(3, epochs=9, batches=3, rate=0.1, patience=9)
    scorer, history = fitting.fit_epochs(train, val, settings, folder=str(tmp_path / "a"))
    rows = history.orderBy("epoch").collect()
    assert [r.epoch for r in rows] == list(range(1, 10)) and rows[-1].train_loss < rows[0].train_loss and rows[-1].val_accuracy > 0.8
    best = best_epoch_early_stop(history, 9).first()
    assert best.best_val_loss == min(r.val_loss for r in rows)
    scored = scoring.score_clips(val, scorer, 3, "features").select("label_id", "scores").collect()
    hits = np.mean([int(np.argmax(r.scores)) == r.label_id for r in scored])
    assert hits == pytest.approx(rows[best.best_epoch - 1].val_accuracy)
    # Four epochs, a stop, and five more are the nine in one go, on other partitions too.
    half = fitting.Settings(3, epochs=4, batches=3, rate=0.1, patience=9)
    fitting.fit_epochs(train.repartition(5), val, half, folder=str(tmp_path / "b"))
    _, again = fitting.fit_epochs(train.repartition(7), val, settings, folder=str(tmp_path / "b"))
    for a, b in zip(rows, again.orderBy("epoch").collect()):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9)


def test_fit_stops_early_and_halves_the_rate(spark):
    rng = np.random.default_rng(3)
    noise = spark.createDataFrame([(i, rng.normal(size=4).tolist(), int(rng.integers(0, 2))) for i in range(120)], "id long, features array<double>, label_id int")
    settings = fitting.Settings(2, epochs=30, rate=0.5, patience=3, plateau=1)
    _, history = fitting.fit_epochs(noise.where("id < 60"), noise.where("id >= 60"), settings)
    rows = history.orderBy("epoch").collect()
    found = best_epoch_early_stop(history, 3).first()
    assert found.stopped_early and found.last_epoch == len(rows) == found.best_epoch + 3 and rows[-1].next_lr < 0.5


def test_fit_refuses(spark):
    rows = clouds(spark, 30, 4)
    settings = fitting.Settings(3, epochs=1)
    with pytest.raises(ValueError, match="no training"):
        fitting.fit_epochs(rows.where("false"), rows, settings)
    with pytest.raises(ValueError, match="no validation"):
        fitting.fit_epochs(rows, rows.where("false"), settings)
    with pytest.raises(Exception, match="outside the classes"):
        fitting.fit_epochs(rows, rows, fitting.Settings(2, epochs=1))
    with pytest.raises(Exception, match="features|reshape"):
        fitting.fit_epochs(rows.union(rows.select("id", F.slice("features", 1, 2), "label_id")), rows, settings)
    with pytest.raises(ValueError):
        fitting.Settings(1)


def test_spark_ml_model_scores(spark):
    labels = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "label string, label_id bigint")
    names = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("label_id") + 1).cast("int"))
    rows = clouds(spark, 200, 5).select("*", names.alias("label"), F.lit("x").alias("path"), F.monotonically_increasing_id().alias("record_index"))
    model, history = scoring.fit_monitored(rows, rows, labels, regs=(1.0, 1e-2), max_iter=15)
    assert [r.epoch for r in history.orderBy("epoch").collect()] == [1, 2]
    scored = scoring.score_with(model, rows).select("label_id", "scores").collect()
    assert np.mean([int(np.argmax(r.scores)) == r.label_id for r in scored]) > 0.8
