"""Audio files as tables: headers, samples, impulse responses, and clean clips written back."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chirrup.functions import dsp, wav
from chirrup.operators.checks import finite
from chirrup.sources.manifests import require_none
from chirrup.sources.wav_sink import write_files

HEADER = "sample_rate int, channels int, frames bigint, fault string"
DECODED = "samples array<float>, sample_rate int, channels int, frames bigint, fault string"


def read_files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """(path relative to root, content) of every matching file below `root`."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(root)
    below = F.element_at(F.split("path", root.rstrip("/").removeprefix("file:") + "/", 2), 2)
    return files.select(below.alias("path"), "content", "length")


def list_files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """Paths and sizes only: Spark does not open the files for these columns."""
    return read_files(spark, root, pattern).select("path", "length")


def probe_headers(files: DataFrame) -> DataFrame:
    """Adds rate, channels and frames from the header; `fault` says why there are none."""

    @F.pandas_udf(HEADER)
    def probe(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for content in contents:
            try:
                h = wav.header(bytes(content))
                rows.append((h["sample_rate"], h["channels"], h["frames"], None))
            except ValueError as exc:
                rows.append((None, None, None, str(exc)))
        out = pd.DataFrame(rows, columns=["sample_rate", "channels", "frames", "fault"])
        return out.astype({"sample_rate": "Int32", "channels": "Int32", "frames": "Int64", "fault": object})

    return files.withColumn("_h", probe.asNondeterministic()("content")).select("*", "_h.*").drop("_h", "content")


def decode_wav(files: DataFrame) -> DataFrame:
    """Adds interleaved float samples at full scale 1; a file that cannot be read has a fault instead."""

    @F.pandas_udf(DECODED)
    def decode(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for content in contents:
            try:
                x, h = wav.samples(bytes(content))
                rows.append((x, h["sample_rate"], h["channels"], h["frames"], None))
            except ValueError as exc:
                rows.append((None, None, None, None, str(exc)))
        out = pd.DataFrame(rows, columns=["samples", "sample_rate", "channels", "frames", "fault"])
        return out.astype({"samples": object, "sample_rate": "Int32", "channels": "Int32", "frames": "Int64", "fault": object})

    return files.withColumn("_d", decode.asNondeterministic()("content")).select("*", "_d.*").drop("_d", "content")


def clip_fault(sample_rate: int = dsp.RATE):
    return F.coalesce(
        F.col("fault"),
        F.when((F.col("sample_rate") != sample_rate) | (F.col("channels") != 1), "expected_mono_at_rate"),
        F.when((F.col("frames") == 0) | ~finite(F.col("samples")), "empty_or_nonfinite"),
    )


def load_clips(manifest: DataFrame, files: DataFrame, sample_rate: int = dsp.RATE) -> DataFrame:
    """Manifest rows with their mono samples; `fault` is set where the file breaks a rule.

    The join comes first and carries bytes, so only files that the manifest
    names are decoded.  Where the files lie below one folder,
    `wav_source.read_clips` opens just those, without a join.
    """
    return decode_wav(manifest.join(files, "path")).withColumn("fault", clip_fault(sample_rate))


def rir_pool(files: DataFrame, usage: str = "train_augmentation_only") -> tuple[DataFrame, DataFrame]:
    """(impulse responses with samples and sha256; faulty files): mono 16 kHz, finite and not silent."""
    digests = files.withColumn("sha256", F.sha2("content", 256))
    rows = decode_wav(digests).withColumn("fault", clip_fault())
    silent = ~F.exists("samples", lambda x: x != 0)
    rows = rows.withColumn("fault", F.coalesce("fault", F.when(silent, "silent")))
    good = rows.where("fault is null").select("path", "sample_rate", "frames", "sha256", F.lit(usage).alias("usage"), "samples")
    return good, rows.where("fault is not null").select("path", "fault")


def digest_conflicts(pool: DataFrame, existing: DataFrame) -> DataFrame:
    """Names that already exist with other content."""
    old = existing.select("path", F.col("sha256").alias("existing_sha256"))
    return pool.join(old, "path").where("sha256 <> existing_sha256").select("path", "sha256", "existing_sha256")


def load_rirs(spark: SparkSession, root: str) -> DataFrame:
    pool, faults = rir_pool(read_files(spark, root))
    require_none(faults, "unusable impulse response")
    if pool.isEmpty():
        raise ValueError(f"no impulse response below {root}")
    return pool


def encode_wav(clips: DataFrame, samples: str = "samples", rate: int = dsp.RATE) -> DataFrame:
    """Adds content: a mono 16-bit WAVE file."""

    @F.pandas_udf("binary")
    def encode(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: wav.wrap(dsp.to_pcm16(np.asarray(x)), rate))

    return clips.withColumn("content", encode(samples))


def file_sha256(samples: Column, rate: int = dsp.RATE) -> Column:
    """sha256 of the WAVE file that `encode_wav` makes of the samples."""

    @F.pandas_udf("string")
    def digest(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: None if x is None else hashlib.sha256(wav.wrap(dsp.to_pcm16(np.asarray(x)), rate)).hexdigest())

    return digest.asNondeterministic()(samples)


def write_wavs(clips: DataFrame, root: str, rate: int = dsp.RATE) -> int:
    """Clips with path and samples as mono 16-bit WAV files below `root`; gives their number."""
    return write_files(encode_wav(clips.select("path", "samples"), rate=rate), root)


def write_clips(clips: DataFrame, path: str) -> None:
    """Clean clips as parquet: samples, 16-bit bytes and the bytes' sha256."""
    rows = clips.withColumn("pcm16", dsp.pcm16(F.col("samples")))
    rows.withColumn("content_sha256", F.sha2("pcm16", 256)).write.mode("errorifexists").parquet(path)
