"""Manifest and audio to training examples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirrup.functions import dsp
from chirrup.functions.arrays import fit_length
from chirrup.operators import augment
from chirrup.operators.checks import filter_long_commands
from chirrup.operators.joins import encode_labels

FEATURES = "array<array<float>>"


def featurize(examples: DataFrame, config: augment.Augmentation, key: str, masked: bool, seed, rate: int = dsp.RATE, **frontend) -> DataFrame:
    """Adds log-mel features; with `masked`, random bands and frames of them are set to 0."""
    settings = {"n_fft": 512, "win": 480, "hop": 160, "n_mels": 40, **frontend}
    frames = (1 + F.floor(F.size("samples") / settings["hop"])).cast("int")
    bands, times = augment.mask_spans(F.col(key), settings["n_mels"], frames, config, seed)
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    @F.pandas_udf(FEATURES)
    def features(samples: pd.Series, bands: pd.Series, times: pd.Series) -> pd.Series:
        out = []
        for x, rows, columns in zip(samples, bands, times):
            mel = dsp.log_mel_matrix(x, rate, **settings)
            for s in rows:
                mel[s["start"] : s["stop"]] = 0.0
            for s in columns:
                mel[:, s["start"] : s["stop"]] = 0.0
            out.append(list(mel.astype(np.float32)))
        return pd.Series(out, dtype=object)

    return examples.withColumn("features", features.asNondeterministic()("samples", bands if masked else empty, times if masked else empty))


def materialize_examples(
    manifest: DataFrame, labels: DataFrame, config: augment.Augmentation, split: str, key: str = "id", epoch: int = 0, seed: int = 42,
    rirs: DataFrame | None = None, pool: DataFrame | None = None, window_seconds: float = 3.0, rate: int = dsp.RATE, **frontend,
) -> DataFrame:
    """Examples of one split and epoch: label_id, samples of the window's length, features.

    `manifest` has the key, split, label, frames and samples.  Training rows are
    augmented anew per epoch; the others are centred and never changed.
    """
    n = round(window_seconds * rate)
    draws = F.concat_ws(".", F.lit(str(seed)), F.lit(str(epoch)))
    kept, _, _ = filter_long_commands(manifest.where(F.col("split") == split), window_seconds, rate, config.commands_exempt)
    rows = encode_labels(kept, labels)
    if split == "train":
        rows = augment.augment_chain(rows, n, config, key, rirs, pool, draws, rate)
    else:
        fitted, _ = fit_length(F.col("samples"), n, F.col("label"), crop_labels=config.commands_exempt)
        rows = rows.withColumn("samples", fitted)
    return featurize(rows, config, key, split == "train", draws, rate, **frontend)
