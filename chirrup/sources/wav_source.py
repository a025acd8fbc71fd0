"""WAV files by byte ranges: `spark.read.format("wav")`, audits in one pass, and clips read where a manifest names them."""

from __future__ import annotations

import fnmatch
import hashlib
import posixpath
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from chirrup.functions import dsp, wav
from chirrup.functions.ranges import Store

HEADERS = "path string, length long, sample_rate int, channels int, frames long, fault string"
CHUNKS = "path string, sample_rate int, channels int, frames long, start_frame long, samples array<float>"
AUDIT = "path string, length long, sample_rate int, channels int, frames long, all_finite boolean, sha256 string, fault string"
#: Bytes of a range that one task reads, seconds of sound of a chunk, and headers of a task.
RANGE, CHUNK_SECONDS, FILES = 64 << 20, 10.0, 256
#: Bytes of a file that an audit holds at a time.
BLOCK = 1 << 20


@dataclass
class Range(InputPartition):
    """Files of which a task reads the headers, or one file of which it reads the bytes [start, stop)."""

    files: list[tuple[str, int]]
    start: int = 0
    stop: int = 0


class WavSource(DataSource):
    """`spark.read.format("wav").load(folder)`.

    Options: `what` is headers (one row per file, its samples are not read) or chunks
    (one row per `seconds` of sound); `glob` filters file names; `rangebytes`
    bounds what a task reads of a file, so one long recording is read by many tasks.
    `fault` says why a header has no numbers; a faulty file has no chunks.
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return CHUNKS if self.options.get("what", "chunks") == "chunks" else HEADERS

    def reader(self, schema: T.StructType) -> "WavReader":
        return WavReader(self.options, schema)


class WavReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.root = options["path"].rstrip("/")
        self.what, self.glob = options.get("what", "chunks"), options.get("glob", "*.wav")
        if self.what not in ("headers", "chunks"):
            raise ValueError("what is headers or chunks")
        self.range, self.seconds = int(options.get("rangebytes", RANGE)), float(options.get("seconds", CHUNK_SECONDS))
        if self.range < 1 or not self.seconds > 0:
            raise ValueError("rangebytes and seconds must be positive")
        self.arrow = to_arrow_schema(schema)

    def partitions(self) -> list[Range]:
        found = [f for f in Store().files(self.root) if fnmatch.fnmatch(posixpath.basename(f[0]), self.glob)]
        if self.what == "headers":
            return [Range(found[i : i + FILES]) for i in range(0, len(found), FILES)] or [Range([])]
        # Small files share a task, as far as their bytes go.
        out, held = [], 0
        for name, size in found:
            if size <= self.range and out and out[-1].stop == -1 and held + size <= self.range:
                out[-1].files.append((name, size))
                held += size
            elif size <= self.range:
                out.append(Range([(name, size)], 0, -1))
                held = size
            else:
                out += [Range([(name, size)], at, min(at + self.range, size)) for at in range(0, size, self.range)]
        return out or [Range([])]

    def read(self, part: Range):
        store = Store()
        if self.what == "headers":
            rows = [(name, size, *probe(store, f"{self.root}/{name}")) for name, size in part.files]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.arrow)], schema=self.arrow)
            return
        for name, size in part.files:
            stop = size if part.stop == -1 else part.stop
            for row in chunks_of(store, f"{self.root}/{name}", part.start, stop, self.seconds):
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((name, *row), self.arrow)], schema=self.arrow)


def probe(store: Store, path: str) -> tuple:
    """(rate, channels, frames, fault) from the chunk table."""
    try:
        with store.open(path) as f:
            h = wav.scan_header(f.at, f.size)
    except ValueError as fault:
        return None, None, None, str(fault)
    return h["sample_rate"], h["channels"], h["frames"], None


def chunks_of(store: Store, path: str, start: int, stop: int, seconds: float):
    """(rate, channels, frames, first frame, samples) of the chunks whose first byte lies in [start, stop).

    So the ranges of a file give each chunk once, wherever they are cut.
    """
    with store.open(path) as f:
        try:
            h = wav.scan_header(f.at, f.size)
        except ValueError:
            return
        size = max(1, round(seconds * h["sample_rate"]))
        step = size * h["align"]
        first = max(0, -(-(start - h["offset"]) // step))
        for k in range(first, -(-h["frames"] // size)):
            at = h["offset"] + k * step
            if at >= stop:
                break
            count = min(size, h["frames"] - k * size)
            yield h["sample_rate"], h["channels"], h["frames"], k * size, wav.decode(f.at(at, count * h["align"]), h)


def read_wavs(spark: SparkSession, root: str, what: str = "chunks", **options) -> DataFrame:
    """Headers or chunks of the WAV files below `root`, by their paths relative to it."""
    spark.dataSource.register(WavSource)
    return spark.read.format("wav").options(what=what, **{k: str(v) for k, v in options.items()}).load(root)


def recordings_from(spark: SparkSession, root: str, **options) -> tuple[DataFrame, DataFrame]:
    """(recordings, chunks) of long WAV files, as the evaluation of recordings takes them.

    A recording's id is its path without `.wav`.  `recordings` has wav (the
    file's name), sample_rate, channels, frames and duration_seconds on the file's own
    clock; its faults have no numbers.
    """
    id = F.regexp_replace("path", r"\.wav$", "").alias("recording_id")
    heads = read_wavs(spark, root, "headers", **{k: v for k, v in options.items() if k == "glob"})
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("wav")
    recordings = heads.select(id, name, "sample_rate", "channels", "frames", (F.col("frames") / F.col("sample_rate")).alias("duration_seconds"), "fault")
    return recordings, read_wavs(spark, root, **options).select(id, "sample_rate", "channels", "start_frame", "samples")


def audit(store: Store, path: str, block: int = BLOCK) -> tuple | None:
    """(length, rate, channels, frames, all finite, sha256, fault) of a file in one pass, `block` bytes at a time; None if there is none.

    The digest covers all bytes, the finiteness all samples; PCM is always
    finite.  Only the head is read twice.
    """
    try:
        f = store.open(path)
    except FileNotFoundError:
        return None
    with f:
        digest, fault, h = hashlib.sha256(), None, None
        try:
            h = wav.scan_header(f.at, f.size)
        except ValueError as exc:
            fault = str(exc)
        floats = h is not None and h["code"] == wav.IEEE_FLOAT
        finite, rest, width = True, b"", 4
        if floats:
            width, begin, end = h["bits"] // 8, h["offset"], h["offset"] + h["frames"] * h["align"]
        for at, data in f.blocks(0, f.size, block):
            digest.update(data)
            if floats and finite:
                rest += data[max(0, begin - at) : max(0, end - at)]
                whole = len(rest) // width * width
                finite = bool(np.isfinite(np.frombuffer(rest[:whole], f"<f{width}")).all())
                rest = rest[whole:]
        numbers = (h["sample_rate"], h["channels"], h["frames"], finite) if h else (None, None, None, None)
        return f.size, *numbers, digest.hexdigest(), fault


def _over_paths(rows: DataFrame, root: str, ddl: str, make_row, size: int) -> DataFrame:
    """Each row with the columns that `make_row(store, path)` gives of its file, in batches of `size` rows.

    Rows go where the files are read, so no join carries audio; a row whose
    file is missing is dropped where `make_row` gives None.
    """
    found = T.StructType(rows.schema.fields + T.StructType.fromDDL(ddl).fields)
    arrow, at = to_arrow_schema(found), rows.columns.index("path")
    root = root.rstrip("/")

    def put(batch, kept, made):
        left = batch.take(pa.array(kept, pa.int64())).columns
        right = [pa.array(c, arrow.field(len(left) + i).type) for i, c in enumerate(zip(*made))]
        return pa.RecordBatch.from_arrays([*left, *right], schema=arrow)

    def stream(batches):
        store = Store()
        for batch in batches:
            kept, made = [], []
            for i, path in enumerate(batch.column(at).to_pylist()):
                row = make_row(store, f"{root}/{path}") if path is not None else None
                if row is not None:
                    kept.append(i)
                    made.append(row)
                if len(made) == size:
                    yield put(batch, kept, made)
                    kept, made = [], []
            if made:
                yield put(batch, kept, made)

    return rows.mapInArrow(stream, found)


def audit_files(paths: DataFrame, root: str) -> DataFrame:
    """One row per file that `path` names below `root` and that exists: its audit.  Repeated and null paths count once or not at all."""
    rows = paths.select("path").where("path is not null").distinct()
    return _over_paths(rows, root, AUDIT.split(", ", 1)[1], audit, 1024)


def read_clips(manifest: DataFrame, root: str, sample_rate: int = dsp.RATE) -> DataFrame:
    """Manifest rows with their mono samples, decoded from the files that they name below `root`; `fault` says what is wrong.

    Only named files are opened, where their rows are; a missing one has the fault missing_audio.
    """

    def load(store, path):
        try:
            with store.open(path) as f:
                h = wav.scan_header(f.at, f.size)
                x = wav.decode(f.at(h["offset"], h["frames"] * h["align"]), h)
        except FileNotFoundError:
            return None, None, None, None, "missing_audio"
        except ValueError as fault:
            return None, None, None, None, str(fault)
        fault = None
        if h["sample_rate"] != sample_rate or h["channels"] != 1:
            fault = "expected_mono_at_rate"
        elif not len(x) or not np.isfinite(x).all():
            fault = "empty_or_nonfinite"
        return x, h["sample_rate"], h["channels"], h["frames"], fault

    return _over_paths(manifest, root, "samples array<float>, sample_rate int, channels int, frames long, fault string", load, 64)
