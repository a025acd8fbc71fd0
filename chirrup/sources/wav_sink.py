"""A committed sink for files: `df.write.format("files")` publishes what successful attempts wrote, at fixed paths."""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from chirrup.functions.ranges import Store

ATTEMPTS, COMMITTED, DONE = "_attempts", "_committed.json", "_SUCCESS"
#: Files that the driver moves itself.
FEW = 500


@dataclass
class Attempt(WriterCommitMessage):
    """What one successful task attempt wrote: its folder, and the number of files and bytes in it."""

    folder: str
    files: int
    size: int


class FileSink(DataSource):
    """`df.write.format("files").mode("append").save(folder)` for rows of (path, content).

    A task writes to a folder of its attempt; the commit names the folders of
    the attempts that succeeded, in one small file.  `publish` then moves them
    into place.  A failed or repeated attempt leaves nothing that is published.
    """

    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema: T.StructType, overwrite: bool) -> "FileWriter":
        if schema.names != ["path", "content"]:
            raise ValueError("the columns are path and content")
        return FileWriter(self.options["path"].rstrip("/"))


class FileWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, batches) -> Attempt:
        store, files, size = Store(), 0, 0
        context = TaskContext.get()
        folder = f"{context.partitionId() if context else 0}-{uuid.uuid4().hex}"
        at = f"{self.root}/{ATTEMPTS}/{folder}"
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if path is None or not content.is_valid or posixpath.normpath(path).startswith(("..", "/")):
                    raise ValueError(f"a file needs content and a path inside the folder, not {path!r}")
                data = content.as_buffer()
                with store.create(f"{at}/{path}") as out:
                    out.write(data)
                files += 1
                size += data.size
        return Attempt(folder, files, size)

    def commit(self, messages) -> None:
        done = [{"folder": m.folder, "files": m.files, "size": m.size} for m in messages if m is not None and m.files]
        store = Store()
        draft = f"{self.root}/{ATTEMPTS}/{COMMITTED}"
        with store.create(draft) as out:
            out.write(json.dumps(done).encode())
        store.move(draft, f"{self.root}/{COMMITTED}")

    def abort(self, messages) -> None:
        Store().drop_folder(f"{self.root}/{ATTEMPTS}")


def publish(spark, root: str) -> int:
    """Move the committed attempts' files into place, many of them in parallel, and mark the folder; gives their number.

    May be repeated after a failure: a file that is gone from its attempt must
    be in place already.  Attempts that were not committed are deleted.
    """
    store, root = Store(), root.rstrip("/")
    with store.open(f"{root}/{COMMITTED}") as f:
        attempts = json.loads(f.at(0, f.size))

    def move(mine: Store, folder: str) -> None:
        at = f"{root}/{ATTEMPTS}/{folder}"
        for name, _ in mine.files(at):
            mine.move(f"{at}/{name}", f"{root}/{name}")

    def moved(batches):
        mine = Store()
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                move(mine, folder)
            yield pa.RecordBatch.from_pydict({"folders": pa.array([batch.num_rows], pa.int64())})

    if sum(a["files"] for a in attempts) <= FEW:
        for a in attempts:
            move(store, a["folder"])
    else:
        rows = spark.createDataFrame([(a["folder"],) for a in attempts], "folder string").repartition(len(attempts))
        rows.mapInArrow(moved, "folders long").write.format("noop").mode("append").save()
    with store.create(f"{root}/{DONE}") as out:
        out.write(b"")
    store.drop_folder(f"{root}/{ATTEMPTS}")
    return sum(a["files"] for a in attempts)


def write_files(rows: DataFrame, root: str, path: str = "path", content: str = "content") -> int:
    """Write (path, content) rows as files below `root`, which must hold no earlier write; gives the number of files.

    The path is the row's, whatever task writes it.  Two rows of one path are
    an error, since which of them would stay is chance.
    """
    store, root = Store(), root.rstrip("/")
    if store.exists(f"{root}/{COMMITTED}") or store.exists(f"{root}/{DONE}"):
        raise FileExistsError(f"files already exist in {root}")
    doubled = rows.groupBy(F.col(path)).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if doubled:
        raise ValueError(f"several rows have the path {doubled[0][0]}")
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    rows.select(F.col(path).alias("path"), F.col(content).alias("content")).write.format("files").mode("append").save(root)
    return publish(spark, root)
