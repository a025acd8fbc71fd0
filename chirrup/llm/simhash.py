"""SimHash fingerprints, and groups of fingerprints that differ in few bits."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirrup.llm.common import map_batches, slices, utf8
from chirrup.llm.components import components
from chirrup.session import materialize

SEED = 42
#: Fingerprints that one task searches, on average; the sample that shards are cut by at a time, and of it the points of a shard; rows compared all with all.
SHARD, SAMPLE, POINTS, LEAF = 16_384, 65_536, 16, 96
#: Shards that are cut at a time, at most, while the rest wait for the next time; and how many times SHARD a shard may hold.
CROWDED, FULL = 1024, 4


def fingerprints(df: DataFrame, words: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint): 64 bits over all word shingles of the whole text, as a bigint.

    A-Z are lower-cased; shingles count as often as they occur.  A bit is set
    if it is set in more than half of the shingles' XXH64 hashes.  A text with
    fewer words is one shingle; one without words, or null, gives 0.
    """

    def make():
        import re

        from xxhash import xxh64_intdigest

        find = re.compile(rb"[^\x20\x09-\x0D]+").findall
        # A byte's bits spread over the eight bytes of a number: adding 255 of these overflows nothing.
        spread = np.zeros(256, np.uint64)
        for bit in range(8):
            spread |= ((np.arange(256, dtype=np.uint64) >> np.uint64(bit)) & np.uint64(1)) << np.uint64(8 * bit)
        weights = np.uint64(1) << np.arange(64, dtype=np.uint64)

        def one(data: bytes) -> int:
            found = find(data.lower())
            if not found:
                return 0
            if len(found) > words:
                found = map(b" ".join, zip(*(found[i:] for i in range(words))))
            else:
                found = [b" ".join(found)]
            hashes = np.array([xxh64_intdigest(x, SEED) for x in found], np.uint64)
            lanes = spread[hashes.view(np.uint8).reshape(-1, 8)]
            sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
            counts = sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            return int(weights[counts * 2 > len(hashes)].sum())

        def step(batch):
            keys, texts = batch.columns
            data, at = utf8(texts)
            found = np.array([one(data[b:e].tobytes()) for b, e in zip(at[:-1], at[1:])], np.uint64)
            yield keys, pa.array(found.view(np.int64))

        return step

    return map_batches(df.select(id, text), make, f"`{id}` {df.schema[id].dataType.simpleString()}, fingerprint bigint")


def _distance(a, b):
    return np.bitwise_count(a ^ b)


def _split(points: np.ndarray, k: int):
    """The vantage point and radius, of a few tried, whose larger side is smallest; None if no side is smaller."""
    best, found = len(points), None
    for vantage in points[:: max(1, len(points) // 6)][:6]:
        d = _distance(points, vantage)
        for radius in {int(np.median(d)), int(np.median(d)) - 1}:
            larger = max((d <= radius).sum(), (d > radius - k).sum())
            if larger < best:
                best, found = larger, (vantage, radius)
    return found


def _tree(points: np.ndarray, leaves: int, k: int, number=None):
    """A tree whose leaves are shard numbers, cut by a sample; a node is (vantage point, radius, inside, outside).

    Two fingerprints at most `k` bits apart differ by at most k in their
    distance to the vantage point.  So rows in the outer k bits of the inside
    are also sent outside: then every such pair shares a side.
    """
    number = iter(range(1 << 62)) if number is None else number
    cut = _split(points, k) if leaves > 1 and len(points) > 8 else None
    if cut is None:
        return next(number)
    d = _distance(points, cut[0])
    return (*cut, _tree(points[d <= cut[1]], leaves // 2, k, number), _tree(points[d > cut[1]], leaves - leaves // 2, k, number))


def _route(node, points: np.ndarray, rows: np.ndarray, k: int):
    if not isinstance(node, tuple):
        yield node, rows
        return
    vantage, radius, inside, outside = node
    d = _distance(points[rows], vantage)
    for side, mask in ((inside, d <= radius), (outside, d > radius - k)):
        if mask.any():
            yield from _route(side, points, rows[mask], k)


def _forest(points: np.ndarray, k: int) -> set[tuple[int, int]]:
    """Links that connect what is connected by pairs at most k bits apart: a forest per leaf, not all pairs."""
    links: set[tuple[int, int]] = set()
    todo = [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        cut = _split(points[rows], k) if len(rows) > LEAF else None
        if cut is not None:
            d = _distance(points[rows], cut[0])
            todo += [rows[d <= cut[1]], rows[d > cut[1] - k]]
            continue
        if len(rows) < 2:
            continue
        label = np.arange(len(rows))
        while True:
            low = label.copy()
            for b in range(0, len(rows), 1024):  # bounded memory where no cut helps
                near = _distance(points[rows[b : b + 1024], None], points[rows][None, :]) <= k
                low[b : b + 1024] = np.where(near, label[None, :], len(rows)).min(axis=1)
            low = low[low]
            if (low == label).all():
                break
            label = low
        linked = np.flatnonzero(label != np.arange(len(rows)))
        links.update(zip(points[rows[linked]].tolist(), points[rows[label[linked]]].tolist()))
    return links


def _leaves(node):
    return [node] if not isinstance(node, tuple) else _leaves(node[2]) + _leaves(node[3])


def _shards(classes: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """((shard, f) rows, number of shards): fingerprints dealt so that any two that may link share a shard.

    Trees are cut by samples, which decide only how even shards are: the first
    by up to SAMPLE points over all; then, as long as shards hold more than
    FULL times SHARD, one for each of them, so their size does not grow with the
    table.  A shard that no tree makes smaller stays, and is searched in
    bounded memory.  Each cut repeats the rows within `bits` of its boundary:
    random fingerprints are doubled after about four.
    """
    spark = classes.sparkSession
    rows = classes.select(F.lit(0).cast("bigint").alias("shard"), F.col("_f").alias("f"))
    n = rows.count()
    crowded, number, whole, parent = [(0, n)] if n > SHARD else [], itertools.count(1), set(), {}
    while crowded:
        leaves = {s: max(2, min(math.ceil(c / SHARD), SAMPLE // len(crowded) // POINTS)) for s, c in crowded}
        every = {s: max(1, c // (leaves[s] * POINTS)) for s, c in crowded}
        step = F.create_map(*[F.lit(x).cast("bigint") for pair in every.items() for x in pair])
        chosen = rows.where(F.col("shard").isin(list(every))).where(F.pmod(F.xxhash64("f", "shard"), step[F.col("shard")]) == 0)
        points: dict[int, list] = {}
        for r in chosen.collect():
            points.setdefault(r.shard, []).append(r.f)
        trees = {}
        for s, c in crowded:
            tree = _tree(np.array(sorted(points.get(s, [])), np.int64).view(np.uint64), leaves[s], bits, number)
            if isinstance(tree, tuple):
                trees[s] = tree
                parent |= dict.fromkeys(_leaves(tree), c)
            else:
                whole.add(s)
        sent = spark.sparkContext.broadcast(trees)

        def route(sent=sent):
            def deal(batch):
                shard, held = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
                for s in np.unique(shard):
                    mine = np.flatnonzero(shard == s)
                    for leaf, at in _route(sent.value.get(int(s), int(s)), held, mine, bits):
                        yield pa.array(np.full(len(at), leaf, np.int64)), pa.array(held[at].view(np.int64))

            return deal

        cut = F.col("shard").isin(list(every))
        rows = materialize(rows.where(~cut).union(map_batches(rows.where(cut), route, "shard bigint, f bigint")))
        full = rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > FULL * SHARD)
        full = full.where(~F.col("shard").isin(list(whole))) if whole else full
        found = full.orderBy(F.desc("n"), "shard").limit(CROWDED).collect()
        whole |= {r.shard for r in found if r.n > 0.9 * parent.get(r.shard, n)}
        crowded = [(r.shard, r.n) for r in found if r.shard not in whole]
    return rows, rows.select("shard").distinct().count()


def near_groups(marks: DataFrame, bits: int = 2, id: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """The rows of `marks` (id, fingerprint) and component_id: the smallest id reachable over links.

    Fingerprints link if they differ in `bits` bits or fewer.  Equal ones are
    one class from the start.  The classes are cut into shards by
    vantage-point trees (`_shards`); rows near a boundary go to both sides, so
    no pair is lost.  Each shard searches its own vantage-point tree and reports a
    forest, never all pairs of a group.  Null ids stay rows but name no group,
    unless nothing else is in it.  An empty table gives an empty one.
    """
    marks = materialize(marks.select(F.col(id), F.col(fingerprint).alias("_f")))
    classes = materialize(marks.groupBy("_f").agg(F.min(id).alias("_least")))
    routed, shards = _shards(classes, bits)

    def search(shard):
        held = np.unique(shard.column("f").to_numpy().view(np.uint64))
        links = np.array(sorted(_forest(held, bits)), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    # A count of their own, or few bytes would put many shards' searches into one task.
    tasks = max(2 * marks.sparkSession.sparkContext.defaultParallelism, min(shards, 20_000))
    links = routed.repartition(tasks, "shard").groupBy("shard").applyInArrow(search, "a bigint, b bigint")
    parts = components(links)
    rooted = classes.join(parts, classes["_f"] == parts["node"], "left").select("_f", "_least", F.coalesce("component", "_f").alias("_root"))
    rooted = materialize(rooted)
    named = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    found = rooted.join(named, "_root").select("_f", "component_id")
    return marks.join(found, "_f").select(id, F.col("_f").alias(fingerprint), "component_id")
