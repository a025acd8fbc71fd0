"""Byte strings that occur again, across and within texts, and the texts without their later copies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirrup.functions.scan import numbered
from chirrup.llm.common import map_batches, map_groups, slices, utf8
from chirrup.session import materialize

#: The first digit of a suffix: so many bytes at its anchor.
DIGIT = 32
#: Bytes that are hashed at a time; open anchors of one digit beyond which their windows are spread over the cluster.
SEGMENT, HOT = 4 << 20, 20_000
_PLACE = (1 << 24) - 1
_P = 0x9E3779B97F4A7C15


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the `width` bytes at each place, by doubling."""
    table = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
    part, size = table[data], 1
    whole, done = None, 0
    while True:
        if width & size:
            if whole is None:
                whole, done = part, size
            else:
                n = len(data) - done - size + 1
                whole = whole[:n] * np.uint64(pow(_P, size, 1 << 64)) + part[done : done + n]
                done += size
        if size * 2 > width:
            break
        n = len(part) - size
        part, size = part[:n] * np.uint64(pow(_P, size, 1 << 64)) + part[size : size + n], size * 2
    whole = (whole ^ (whole >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return whole ^ (whole >> np.uint64(32))


def _anchors(data: np.ndarray, window: int):
    """(digit hash, anchor, first window, end of windows) of all windows of `data`.

    A window's anchor is the place of the smallest digit hash within it, the
    leftmost of equal ones: equal windows have it at the same place.
    """
    digits = _rolling(data, DIGIT)
    least = (digits & ~np.uint64(_PLACE)) | np.arange(len(digits), dtype=np.uint64)
    span, size = window - DIGIT + 1, 1
    n = len(data) - window + 1
    while size * 2 <= span:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    least = np.minimum(least[:n], least[span - size : span - size + n]) & np.uint64(_PLACE)
    begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    place = least[begin].astype(np.int64)
    return digits[place], place, begin, np.concatenate([begin[1:], [n]])


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Spans of equal length or in order of their ends, with overlapping and adjacent ones joined."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] > end[:-1])
    first = np.flatnonzero(new)
    return doc[first], begin[first], end[np.concatenate([first[1:], [len(doc)]]) - 1 if len(first) else first]


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(h, c, doc, at): an anchor's digit hash, the hash of all its windows' bytes, its text, and its place.

    `at` packs the first window (40 bits), the number of windows and the anchor's
    distance from the first (7 bits each).  Texts are hashed in segments that
    overlap by a window, so memory is bounded.

    Of the anchors of a segment that have equal windows only the earliest is a
    row.  The others are repeats for certain; their spans, joined, are rows
    whose `at` is -1 less the begin, whose `c` is the end, and whose `h` is a
    number of the text.  So a string that most texts hold is no hot digit.
    """

    def make():
        from xxhash import xxh3_64_intdigest

        def one(data, first, out, doc):
            h, place, begin, end = _anchors(data, window)
            raw = memoryview(data)
            c = [xxh3_64_intdigest(raw[b : e + window - 1], p) for b, e, p in zip(begin.tolist(), end.tolist(), (place - begin).tolist())]
            out[0].append(h.view(np.int64))
            out[1].append(np.array(c, np.uint64).view(np.int64))
            out[2].append(np.full(len(h), doc, np.int64))
            out[3].append(((begin + first) << 14) | ((end - begin) << 7) | (place - begin))

        def step(batch):
            docs_, texts = np.asarray(batch.column(0)), batch.column(1)
            data, at = utf8(texts)
            for i, j in slices(np.diff(at).tolist(), SEGMENT):
                out = ([], [], [], [])
                for k in range(i, j):
                    for b in range(at[k], max(at[k], at[k + 1] - window + 1), SEGMENT):
                        one(data[b : min(b + SEGMENT + window - 1, at[k + 1])], b - at[k], out, docs_[k])
                if not out[0]:
                    continue
                h, c, doc, place = (np.concatenate(x) for x in out)
                order = np.lexsort((place, doc, c, h))
                h, c, doc, place = h[order], c[order], doc[order], place[order]
                later = np.zeros(len(h), bool)
                later[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
                begin, end, _ = _unpacked(place[later], window)
                owner, begin, end = _merged(doc[later], begin, end)
                number = (owner.astype(np.uint64) * np.uint64(_P)).view(np.int64)
                parts = ((h[~later], number), (c[~later], end), (doc[~later], owner), (place[~later], -1 - begin))
                yield tuple(pa.array(np.concatenate(x)) for x in parts)

        return step

    return map_batches(docs.select("doc", "text"), make, "h bigint, c bigint, doc bigint, at bigint")


def _unpacked(at, window):
    first, count, shift = at >> 14, (at >> 7) & 127, at & 127
    return first, first + count + window - 1, first + shift


def repeated_anchors(anchors: DataFrame, window: int) -> DataFrame:
    """(doc, begin, end, anchor, h): what the first digits tell.

    Anchors whose digit and whose windows' bytes are equal form a class.  All of
    a class but its earliest are repeats, and `begin` to `end` is covered; their
    anchor is null.  Where a digit has several classes, their earliest anchors
    stay open, with the anchor's place.  A digit with one anchor is dropped: no
    window at it repeats.  The rows of a digit pass in order through a scan
    that keeps one row of it.
    """
    ddl = "doc bigint, begin bigint, end bigint, anchor bigint, h bigint"

    def stream(batches):
        kept, told, several = None, False, False  # the present class's first row, whether it was put out, whether its digit has others
        for batch in batches:
            if not batch.num_rows:
                continue
            h, c, doc, at = (np.asarray(x) for x in batch.columns)
            known = at < 0
            if known.any():
                blank = pa.nulls(int(known.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(doc[known]), pa.array(-1 - at[known]), pa.array(c[known]), blank, blank], names=["doc", "begin", "end", "anchor", "h"])
                h, c, doc, at = h[~known], c[~known], doc[~known], at[~known]
                if not len(h):
                    continue
            if kept is not None:
                h, c, doc, at = (np.concatenate([[k], x]) for k, x in zip(kept, (h, c, doc, at)))
            digit = np.concatenate([[True], h[1:] != h[:-1]])
            first = digit | np.concatenate([[True], c[1:] != c[:-1]])
            of = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
            group = np.cumsum(digit) - 1
            classes = np.bincount(group, first)
            if several:
                classes[0] += 1
            is_open = first & (classes[group] > 1)
            later = ~first & ((doc != doc[of]) | (at != at[of]))
            if told:
                is_open[0] = False
            last = int(of[-1])
            for mask, opened in ((later, False), (is_open, True)):
                begin, end, anchor = _unpacked(at[mask], window)
                if len(begin):
                    blank = np.zeros(len(begin), bool)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc[mask]), pa.array(begin), pa.array(end), pa.array(anchor, mask=blank | (not opened)), pa.array(h[mask], mask=blank | (not opened))],
                        names=["doc", "begin", "end", "anchor", "h"],
                    )
            told = bool(is_open[last]) or (last == 0 and told)
            several = bool(classes[-1] > 1) if group[-1] > 0 or len(classes) == 1 else several
            kept = (h[last], c[last], doc[last], at[last])

    placed = anchors.repartition("h").sortWithinPartitions("h", "c", "doc", "at")
    return placed.mapInArrow(stream, ddl)


def _context_rows(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """(h, doc, begin, bytes) of open anchors: the bytes of their windows, and `shift`, the anchor's place in them."""
    lists = opened.groupBy("doc").agg(F.collect_list(F.struct("h", "begin", "end", "anchor")).alias("open"))
    joined = docs.join(lists, "doc").select("doc", "text", "open")

    def make():
        def step(batch):
            ids = batch.column(0).to_pylist()
            data, at = utf8(batch.column(1))
            spans = batch.column(2)
            for k in range(len(ids)):
                row = data[at[k] : at[k + 1]]
                found = spans[k].values
                h, begin, end, anchor = (found.field(x).to_pylist() for x in ("h", "begin", "end", "anchor"))
                yield h, [ids[k]] * len(h), begin, [a - b for a, b in zip(anchor, begin)], [row[b:e].tobytes() for b, e in zip(begin, end)]

        return step

    return map_batches(joined, make, "h bigint, doc bigint, begin bigint, shift bigint, bytes binary")


def _later_windows(contexts: DataFrame, window: int) -> DataFrame:
    """(doc, begin, end) of the windows of open anchors that occur earlier at the same digit.

    The windows of a digit are sorted most significant digit first, eight bytes
    a pass, and no further than `window` bytes; a window that is alone after a
    pass is done.  The groups left at the end are exactly the repeated windows.
    """

    def make():
        def step(rows, starts):
            docs_, begins, shifts = (np.asarray(rows.column(k)) for k in (1, 2, 3))
            data, at = utf8(rows.column(4))
            sizes = np.diff(np.concatenate([starts, [rows.num_rows]]))
            digit = np.repeat(np.arange(len(starts)), sizes)
            single = np.repeat(sizes < 2, sizes)
            counts = np.where(single, 0, np.diff(at) - window + 1)
            owner = np.repeat(np.arange(rows.num_rows), counts)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = at[owner] + inner
            alive = np.arange(len(owner))
            # Equal windows have the anchor at the same distance: with the digit there, that is the first pass.
            group = (digit[owner] << 7) | (shifts[owner] - inner)
            for depth in range(0, window, 8):
                value = np.zeros(len(alive), np.uint64)
                for k in range(min(8, window - depth)):
                    value = (value << np.uint64(8)) | data[start[alive] + depth + k].astype(np.uint64)
                order = np.lexsort((value, group))
                alive, group, value = alive[order], group[order], value[order]
                new = np.ones(len(alive), bool)
                new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
                group = np.cumsum(new) - 1
                several = np.bincount(group)[group] > 1 if len(group) else new
                alive, group = alive[several], group[several]
            doc, place = docs_[owner[alive]], begins[owner[alive]] + inner[alive]
            order = np.lexsort((place, doc, group))
            doc, place, group = doc[order], place[order], group[order]
            head = np.ones(len(doc), bool)
            head[1:] = group[1:] != group[:-1]
            of = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            later = (doc != doc[of]) | (place != place[of])
            yield tuple(map(pa.array, _merged(doc[later], place[later], place[later] + window)))

        return step

    return map_groups(contexts, ["h"], make, "doc bigint, begin bigint, end bigint")


def _spread_windows(contexts: DataFrame, window: int) -> DataFrame:
    """The same for digits with very many open anchors: every window is a row, and equal ones are grouped over the cluster."""

    def make():
        from xxhash import xxh3_128_digest

        def step(batch):
            docs_, begins = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            data, at = utf8(batch.column(4))
            for k in range(len(docs_)):
                row = data[at[k] : at[k + 1]].tobytes()
                n = len(row) - window + 1
                yield [xxh3_128_digest(row[i : i + window]) for i in range(n)], [docs_[k]] * n, list(range(begins[k], begins[k] + n))

        return step

    rows = map_batches(contexts, make, "w binary, doc bigint, begin bigint")
    first = rows.groupBy("w").agg(F.min(F.struct("doc", "begin")).alias("first"))
    later = rows.join(first, "w").where(F.struct("doc", "begin") != F.col("first"))
    return later.select("doc", "begin", (F.col("begin") + window).alias("end"))


def _numbered_docs(df: DataFrame, id: str, text: str) -> tuple[DataFrame, bool]:
    """(_id, doc, text): `doc` orders the texts; it is the id where ids are unique and not null."""
    ids = df.select(F.col(id).alias("_id"))
    n, known, different = ids.agg(F.count("*"), F.count("_id"), F.countDistinct("_id")).first()
    rows = df.select(F.col(id).alias("_id"), F.col(text).alias("text"))
    if n == known == different:
        return rows.select("_id", F.col("_id").cast("bigint").alias("doc"), "text"), True
    rows = rows.withColumn("_t", F.xxhash64("text"))
    pairs = rows.select("_id", "_t").distinct().withColumn("_last", F.col("_id").isNull())
    ranked = numbered(pairs, [], ["_last", "_id", "_t"], F.coalesce(F.floor(F.col("_id") / 65_536), F.lit((1 << 62))), "doc")
    places = ranked.select(F.col("_id").alias("_i"), F.col("_t").alias("_u"), "doc")
    return materialize(rows.join(places, rows["_id"].eqNullSafe(places["_i"]) & (rows["_t"] == places["_u"])).select("_id", "doc", "text")), False


def remove_repeats(df: DataFrame, window: int = 100, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): texts as UTF-8 bytes, without the bytes of strings that occur earlier.

    A byte goes if it lies in a string of `window` bytes that also starts
    earlier: in a text with a smaller id, or before in the same text.  Strings
    are judged on the input.  Matches do not cross texts; null is empty.  Rows
    with equal id and text are one text, with one result each; of equal ids with
    other texts, and of null ids, which come last, a hash of the text decides
    which is earlier.  Spans are maximal runs of removed bytes.
    """
    if not DIGIT < window < DIGIT + 127:
        raise ValueError(f"window must be over {DIGIT} and under {DIGIT + 127}")
    rows, unique = _numbered_docs(df, id, text)
    source = rows.select("doc", "text") if unique else rows.select("doc", "text").dropDuplicates(["doc"])
    marks = materialize(repeated_anchors(anchor_rows(source, window), window))
    opened = marks.where("anchor is not null")
    spans = marks.where("anchor is null").select("doc", "begin", "end")
    hot = materialize(opened.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h"))
    contexts = _context_rows(source, opened)
    if hot.isEmpty():
        spans = spans.union(_later_windows(contexts, window))
    else:
        spans = spans.union(_later_windows(contexts.join(hot, "h", "left_anti"), window)).union(_spread_windows(contexts.join(hot, "h", "left_semi").select("h", "doc", "begin", "shift", "bytes"), window))
    lists = spans.groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = source.join(lists, "doc", "left").select("doc", "text", "spans") if unique else rows.join(lists, "doc", "left").select("_id", "text", "spans")
    kind = df.schema[id].dataType.simpleString()

    def make():
        def step(batch):
            ids, lists_ = batch.column(0), batch.column(2)
            data, at = utf8(batch.column(1))
            for i, j in slices(np.diff(at).tolist(), SEGMENT):
                removed, runs, kept = [], [], []
                for k in range(i, j):
                    row = data[at[k] : at[k + 1]]
                    found = lists_[k].values
                    if found is None or not len(found):
                        removed.append(0)
                        runs.append(0)
                        kept.append(row.tobytes())
                        continue
                    change = np.zeros(len(row) + 1, np.int32)
                    np.add.at(change, found.field("begin").to_numpy(), 1)
                    np.add.at(change, found.field("end").to_numpy(), -1)
                    gone = np.cumsum(change)[:-1] > 0
                    removed.append(int(gone.sum()))
                    runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    kept.append(row[~gone].tobytes())
                yield ids[i:j], (at[i + 1 : j + 1] - at[i:j]).tolist(), removed, runs, kept

        return step

    return map_batches(joined, make, f"`{id}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
