"""WARC archives: writing pages as records, and reading records as rows of bounded size."""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chirrup.llm.common import map_batches, utf8
from chirrup.session import materialize

CHUNK = 1 << 20
#: Bytes of an archive that one task reads, about.
RUN = 64 << 20
#: A task begins another archive when the present one has this many bytes.
ARCHIVE = 512 << 20
DATE = "2024-01-01T00:00:00Z"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_types(df: DataFrame, least: int, id: str, payload: str) -> DataFrame:
    """The columns of `df` with _kind and _refers.

    Of equal payloads of `least` bytes or more, the row with the largest id is
    the response; of several with that id, one.  Null ids come last.  Digests
    are grouped before anything is joined; the payload moves once, to the row of
    its digest, and a digest of very many rows is split by the skew handling of
    the join.
    """
    hexed = F.sha1(F.coalesce(F.col(payload), F.lit("")).cast("binary"))
    known = df.select(hexed.alias("_sha"), F.col(id).alias("_id")).groupBy("_sha", "_id").agg(F.count("*").alias("_n"))
    last = materialize(known.groupBy("_sha").agg(F.max("_id").alias("_last"), F.max_by("_n", F.struct(F.col("_id").isNotNull(), "_id")).alias("_ties")))
    rows = df.withColumn("_key", hexed).join(last, F.col("_key") == F.col("_sha"))
    size = F.octet_length(F.coalesce(F.col(payload), F.lit("")))
    rows = rows.withColumn("_small", size < least).withColumn("_is_last", F.col(id).eqNullSafe(F.col("_last")))
    plain = rows.where("_small or not _is_last or _ties = 1")
    kind = F.when(F.col("_small") | F.col("_is_last"), "response").otherwise("revisit")
    found = plain.withColumn("_kind", kind)
    if not last.where("_ties > 1").isEmpty():
        tied = rows.where("not _small and _is_last and _ties > 1")
        nth = F.row_number().over(W.partitionBy("_sha").orderBy("_sha"))
        found = found.unionByName(tied.withColumn("_kind", F.when(nth == 1, "response").otherwise("revisit")))
    return found.withColumn("_refers", F.when(F.col("_kind") == "revisit", F.col("_last"))).drop("_key", "_sha", "_last", "_ties", "_small", "_is_last")


def _place(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def write_archives(df: DataFrame, path: str, least: int = 0, id: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """Write one record per row into gzip archives under `path`; gives the index (archive, record_id, page_id, offset, length).

    Payloads are the text in UTF-8 (null: none), fed to the compressor chunk by
    chunk.  A revisit holds only its HTTP head; it names the payload's digest and
    the response it refers to.  Each task writes files of its own name, and only
    those of the attempts whose index rows Spark commits count, so a lost
    executor leaves a stray file at worst.  An empty table writes nothing.
    """
    at = df.select(F.col(id), F.col(payload), F.col(url).cast("string").alias("_url") if url in df.columns else F.lit(None).cast("string").alias("_url"))
    marked = record_types(at, least, id, payload)

    def make():
        import zlib

        state: dict = {}

        def close():
            if state:
                state.pop("file").close()
                state.clear()

        def record(kind, key, refers, address, data):
            running = hashlib.sha1()
            for b in range(0, len(data), CHUNK):
                running.update(data[b : b + CHUNK])
            digest = _base32(running.digest())
            head = HEAD % len(data)
            lines = [
                "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>", f"WARC-Date: {DATE}",
                f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
                f"Content-Length: {len(head) + (len(data) if kind == 'response' else 0)}",
            ]
            if address:
                lines.append("WARC-Target-URI: " + "".join(address.split()))
            if kind == "revisit":
                lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
                lines.append(f"WARC-Refers-To: <urn:page:{'' if refers is None else refers}>")
            squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
            yield squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + head)
            if kind == "response":
                for b in range(0, len(data), CHUNK):
                    yield squeeze.compress(data[b : b + CHUNK])
            yield squeeze.compress(b"\r\n\r\n")
            yield squeeze.flush()

        def step(batch):
            if batch is None:
                close()
                return
            keys, texts, urls, kinds, refers = batch.columns
            data, ends = utf8(texts)
            rows = []
            for i, (key, address, kind, refer) in enumerate(zip(keys.to_pylist(), urls.to_pylist(), kinds.to_pylist(), refers.to_pylist())):
                if not state:
                    name = f"{path.rstrip('/')}/pages-{uuid.uuid4().hex}.warc.gz"
                    system, place = _place(name)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    state.update(file=system.open_output_stream(place, compression=None), name=name, at=0)
                begin = state["at"]
                for part in record(kind, key, refer, address, memoryview(data[ends[i] : ends[i + 1]])):
                    state["file"].write(part)
                    state["at"] += len(part)
                rows.append((state["name"], f"urn:page:{'' if key is None else key}", key, begin, state["at"] - begin))
                if state["at"] >= ARCHIVE:
                    close()
            if rows:
                yield tuple(zip(*rows))

        return step

    kind = df.schema[id].dataType.simpleString()
    index = map_batches(marked.select(id, payload, "_url", "_kind", "_refers"), make, f"archive string, record_id string, page_id {kind}, `offset` bigint, length bigint", finish=True)
    return materialize(index)


def read_archives(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records of all archives that `index` names, as a table of chunks.

    The index is cut into runs of about RUN bytes of an archive, each read by a
    task that seeks to it; records are compressed one by one.

    (record_id, page_id, record_type, refers_to, chunk, data, payload_bytes,
    payload_digest, last): chunk numbers count from 0, `payload_bytes` and
    `payload_digest` cover the payload up to and with the chunk, and the last
    chunk's therefore all of it.  No more than one chunk of a record is held at
    once.  A revisit is one chunk without data whose length and digest are those
    it states.  A payload that does not match its stated digest stops the job.
    Without `payload`, `data` is null.
    """
    run = F.floor(F.col("offset") / RUN)
    runs = index.groupBy("archive", run.alias("run")).agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"))
    # Stored first and dealt row by row: an exchange by name that follows the grouping's would be taken for it, and its small rows put into one task.
    runs = materialize(runs.select("archive", "start", "stop"))
    runs = runs.repartition(max(1, min(runs.count(), 100_000)))

    def make():
        import gzip
        import io

        def heads(file):
            found = {}
            while (line := file.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().partition(":")
                found[name.strip().lower()] = value.strip()
            return found

        def key(urn):
            number = urn.strip("<>").rpartition(":")[2]
            return int(number) if number else None

        class Part(io.RawIOBase):
            """The bytes [start, stop) of an open file."""

            def __init__(self, file, start, stop):
                self.file, self.left = file, stop - start
                file.seek(start)

            def readable(self):
                return True

            def readinto(self, room):
                data = self.file.read(min(len(room), self.left))
                room[: len(data)] = data
                self.left -= len(data)
                return len(data)

        def rows(archive, start, stop):
            system, place = _place(archive)
            with system.open_input_file(place) as whole, io.BufferedReader(Part(whole, start, stop), CHUNK) as raw, gzip.GzipFile(fileobj=raw) as file:
                while first := file.readline():
                    if not first.strip():
                        continue
                    if not first.startswith(b"WARC/"):
                        raise ValueError(f"{archive}: no record at {first[:40]!r}")
                    record = heads(file)
                    file.readline()
                    http = heads(file)
                    size, stated = int(http["content-length"]), record["warc-payload-digest"].rpartition(":")[2]
                    name, kind = record["warc-record-id"].strip("<>"), record["warc-type"]
                    own = (name, key(name), kind, key(record.get("warc-refers-to", "")))
                    if kind == "revisit":
                        yield *own, 0, None, size, stated, True
                        continue
                    running, done, number = hashlib.sha1(), 0, 0
                    while True:
                        data = file.read(min(CHUNK, size - done))
                        if len(data) < min(CHUNK, size - done):
                            raise ValueError(f"{archive}: {name} ends early")
                        running.update(data)
                        done += len(data)
                        digest = _base32(running.copy().digest())
                        if done == size and digest != stated:
                            raise ValueError(f"{archive}: {name} does not match its digest")
                        yield *own, number, data if payload else None, done, digest, done == size
                        if done == size:
                            break
                        number += 1

        def step(batch):
            for where in zip(*(c.to_pylist() for c in batch.columns)):
                held, size = [], 0
                for row in rows(*where):
                    held.append(row)
                    size += 200 + len(row[5] or b"")
                    if size >= 8 * CHUNK:
                        yield tuple(zip(*held))
                        held, size = [], 0
                if held:
                    yield tuple(zip(*held))

        return step

    return map_batches(
        runs, make, "record_id string, page_id bigint, record_type string, refers_to bigint, chunk int, data binary, payload_bytes bigint, payload_digest string, last boolean"
    )
