"""Applying and fitting classifiers over tables of clips."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirrup.session import materialize



def score_clips(
    examples: DataFrame,
    scorer: Callable[[np.ndarray], np.ndarray],
    classes: int,
    column: str = "samples",
    batch_size: int = 256,
) -> DataFrame:
    """Adds `scores`, the model's output per clip.

    `scorer` maps a float array [batch, length] to [batch, classes].  A wrong
    shape or a non-finite score stops the job.  Only the input column reaches
    the model, in batches of at most `batch_size` clips of equal length.  The
    function is marked nondeterministic so that a filter on its result never
    makes the optimizer run the model twice.
    """

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            out = np.empty(len(series), dtype=object)
            sizes = series.map(len).to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                for at in range(0, len(rows), batch_size):
                    part = rows[at : at + batch_size]
                    scores = np.asarray(scorer(np.stack(series.iloc[part].tolist())), dtype=np.float64)
                    if scores.shape != (len(part), classes):
                        raise ValueError(f"expected scores [{len(part)}, {classes}], got {scores.shape}")
                    if not np.isfinite(scores).all():
                        raise ValueError("non-finite score")
                    for i, row in zip(part, scores):
                        out[i] = row
            yield pd.Series(out)

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return examples.withColumn("scores", F.pandas_udf(score, T.ArrayType(T.DoubleType())).asNondeterministic()(column))


def fit_centroids(clips: DataFrame, column: str = "samples") -> np.ndarray:
    """Mean vector per label id: the parameters [classes, length] of the built-in scorer.

    Vectors are averaged whole, before the shuffle as far as possible.  Only
    classes * length numbers come back: the size of the model, not of the data.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vectors = clips.select("label_id", array_to_vector(F.col(column).cast("array<double>")).alias("x"))
    means = vectors.groupBy("label_id").agg(vector_to_array(Summarizer.mean(F.col("x"))).alias("mean"))
    means = materialize(means)
    return np.array([r.mean for r in means.orderBy("label_id").collect()])


def centroid_scorer(centroids: np.ndarray, power: int = 2) -> Callable[[np.ndarray], np.ndarray]:
    """Score = negative sum of the distances to the class's mean, each to `power`, over all dimensions."""

    def scorer(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.stack([-(np.abs(x - c) ** power).sum(axis=1) for c in centroids], axis=1)

    return scorer


def with_features(
    examples: DataFrame, frontend: Callable[[np.ndarray], np.ndarray], column: str = "samples", output: str = "features"
) -> DataFrame:
    """Adds a user function's features; `frontend` maps one waveform [1, n] to an array."""

    def apply(series: pd.Series) -> pd.Series:
        return series.map(lambda x: np.asarray(frontend(np.asarray(x)[None, :]), dtype=np.float64).ravel())

    apply.__annotations__ = {"series": pd.Series, "return": pd.Series}
    return examples.withColumn(output, F.pandas_udf(apply, T.ArrayType(T.DoubleType())).asNondeterministic()(column))


def fit_classifier(examples: DataFrame, column: str = "features", reg: float = 1e-3, max_iter: int = 50, seed: int = 42):
    """A multinomial logistic regression on (features array, label_id), fitted by Spark ML."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    train = examples.select(array_to_vector(F.col(column)).alias("features"), F.col("label_id").cast("double").alias("label"))
    return LogisticRegression(regParam=reg, maxIter=max_iter, standardization=True, family="multinomial").fit(train)


def fit_monitored(train: DataFrame, val: DataFrame, labels: DataFrame, column: str = "features", regs=(1e-1, 1e-2, 1e-3), **settings):
    """Fit once per regularisation strength and keep the model with the lowest loss on `val`.

    Returns the model and the history: epoch (position in `regs`), val_loss, val_accuracy.
    """
    from chirrup.operators.metrics import predictions

    best, lowest, rows = None, float("inf"), []
    for epoch, reg in enumerate(regs, 1):
        model = fit_classifier(train, column, reg, **settings)
        judged = predictions(score_with(model, val, column), labels)
        loss, accuracy = judged.agg(F.avg("loss"), F.avg("correct")).first()
        rows.append(("fit", epoch, float(loss), float(accuracy)))
        if loss < lowest:
            best, lowest = model, loss
    return best, train.sparkSession.createDataFrame(rows, "run string, epoch bigint, val_loss double, val_accuracy double")


def score_with(model, examples: DataFrame, column: str = "features") -> DataFrame:
    """Adds the Spark ML model's logits as `scores`."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = examples.withColumn("_features", array_to_vector(F.col(column)))
    model = model.copy().setFeaturesCol("_features").setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("")
    return model.transform(rows).withColumn("scores", vector_to_array("_raw")).drop("_features", "_raw")
