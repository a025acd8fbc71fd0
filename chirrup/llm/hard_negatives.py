"""Hard negatives of anchors: clusters of anchors share candidate lists in the order of an angular upper bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirrup.llm.common import map_batches, map_groups
from chirrup.session import materialize

#: Anchors that are clustered together at most, about, and members of a cluster, about.
PACK, MEMBERS = 2048, 24
#: Bytes of anchors that are sent to the tasks at a time, about.
SENT = 1 << 23
#: Candidates of a list that are scored at a time, at first and at most.
STEP, WIDEST = 256, 4096
#: Scores up to this are exact in double precision, and up to LONG in 8-byte integers.
EXACT, LONG = 2**53, 2**62
#: Bounds are widened by this part of the lengths, so that rounding ends no walk early.
MARGIN = 1e-9


def _vectors(df: DataFrame, id: str, label: str, vector: str, scale: float, anchor: Column) -> DataFrame:
    """(row, node, label, anchor, dim, size, x) of the rows that take part; x are 8-byte integers, size their length."""

    def make():
        def step(batch):
            kept, dims, sizes, cells = [], [], [], []
            for i, (node, kind, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))):
                if node is None or kind is None or not value.is_valid or value.values is None or value.values.null_count:
                    continue
                c = np.asarray(value.values, np.float64)
                if not np.isfinite(c).all():
                    continue
                x = np.floor(scale * c)
                size = float(np.sqrt((x * x).sum()))
                if size >= LONG**0.5:
                    raise ValueError(f"scores of {node} do not fit into 8-byte integers")
                kept.append(i)
                dims.append(len(x))
                sizes.append(size)
                cells.append(x.astype("<i8").tobytes())
            at = pa.array(kept, pa.int64())
            yield batch.column(0).take(at), batch.column(1).take(at), batch.column(3).take(at), dims, sizes, cells

        return step

    node, kind = (df.schema[c].dataType.simpleString() for c in (id, label))
    chosen = df.select(F.col(id).alias("node"), F.col(label).alias("label"), F.col(vector).alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = map_batches(chosen, make, f"node {node}, label {kind}, anchor boolean, dim int, size double, x binary")
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()))


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dim)


def _units(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    size = np.linalg.norm(y, axis=1, keepdims=True)
    return np.divide(y, size, out=np.zeros_like(y), where=size > 0)


def centres(units: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """The cluster of each unit vector, by rounds of nearest centre of direction from evenly spaced starts."""
    middle = units[np.linspace(0, len(units) - 1, count).astype(int)]
    own = np.zeros(len(units), int)
    for _ in range(rounds):
        own = (units @ middle.T).argmax(axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, own, units)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        middle = np.where(size > 0, sums / np.where(size > 0, size, 1), middle)
    return own


def _clusters(anchors: DataFrame) -> DataFrame:
    """(label, dim, rows, nodes, x, middle, angle): a row per cluster of anchors of one label.

    Anchors of a label are dealt by a hash into packs of about PACK, so a label
    of any size is no hot group; each pack is clustered by itself.
    """
    sizes = anchors.groupBy("label", "dim").agg(F.ceil(F.count("*") / PACK).alias("packs"))
    placed = anchors.join(sizes, ["label", "dim"]).withColumn("pack", F.pmod(F.xxhash64("row"), F.col("packs")))

    def make():
        def step(rows, starts):
            out = []
            for a, b in zip(starts, [*starts[1:], rows.num_rows]):
                part = rows.slice(a, b - a)
                dim = part.column("dim")[0].as_py()
                x = _matrix(part.column("x"), dim)
                units = _units(x)
                own = centres(units, max(1, -(-len(x) // MEMBERS)))
                for c in np.unique(own):
                    mine = np.flatnonzero(own == c)
                    total = units[mine].sum(axis=0)
                    size = np.linalg.norm(total)
                    middle = total / size if size > 0 else total
                    angle = float(np.arccos(np.clip(units[mine] @ middle, -1, 1)).max()) if size > 0 else np.pi
                    ids = part.column("row").to_numpy()[mine]
                    out.append((part.column("label")[0].as_py(), dim, ids.tolist(), x[mine].tobytes(), middle.tobytes(), angle, int(mine.size)))
            if out:
                yield list(zip(*out))

        return step

    kind = anchors.schema["label"].dataType.simpleString()
    ddl = f"label {kind}, dim int, rows array<long>, x binary, middle binary, angle double, members int"
    return map_groups(placed.select("label", "dim", "pack", "row", "x"), ["label", "dim", "pack"], make, ddl)


def _scores(a: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return np.rint(a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a @ x.T


class _Best:
    """The first `count` rows of a want: higher scores first, ties by smaller node, then row; scores within [low, high] only."""

    __slots__ = ("count", "low", "high", "scores", "nodes", "rows")

    def __init__(self, low: int, high: int, count: int):
        self.low, self.high, self.count = low, high, count
        self.scores = self.nodes = self.rows = None

    def add(self, scores, nodes, rows):
        hit = np.flatnonzero((scores >= self.low) & (scores <= self.high))
        if not hit.size:
            return
        scores, nodes, rows = scores[hit], nodes[hit], rows[hit]
        if self.scores is not None:
            scores, nodes, rows = np.concatenate([self.scores, scores]), np.concatenate([self.nodes, nodes]), np.concatenate([self.rows, rows])
        order = np.lexsort((rows, nodes, -scores))[: self.count]
        self.scores, self.nodes, self.rows = scores[order], nodes[order], rows[order]
        if len(order) == self.count:
            self.low = max(self.low, int(self.scores[-1]))


def walk(cluster: dict, wants: list[list[_Best]], x, sizes, nodes, rows, exact: bool) -> int:
    """Offer a cluster's members the candidates in the order of the cluster's bound, until no bound can reach a member's wants.

    A candidate at angle t to the cluster's centre is at t - angle at least to
    any member, so its score is at most the product of lengths and the cosine
    of that.  The list is sorted once; a member leaves it when its own length times the
    next bound is below the lowest score that it can still use.  Gives the number of scores computed.
    """
    units = np.divide(x, sizes[:, None], out=np.zeros(x.shape), where=sizes[:, None] > 0)
    angles = np.arccos(np.clip(units @ cluster["middle"], -1, 1))
    bounds = sizes * (np.cos(np.maximum(angles - cluster["angle"], 0)) + MARGIN)
    order = np.argsort(-bounds, kind="stable")
    bounds = bounds[order]
    members = np.array([i for i, lists in enumerate(wants) if lists], int)
    lengths = cluster["lengths"]
    at, step, done = 0, STEP, 0
    while at < len(order) and members.size:
        need = np.array([min(w.low for w in wants[m]) for m in members], np.float64)
        reach = lengths[members] * bounds[at]
        members = members[reach + MARGIN * np.abs(reach) + MARGIN >= need]
        if not members.size:
            break
        chosen = order[at : at + step]
        found = _scores(cluster["x"][members], x[chosen], exact)
        done += found.size
        for m, line in zip(members, found):
            others = rows[chosen] != cluster["rows"][m]
            for want in wants[m]:
                want.add(line[others], nodes[chosen][others], rows[chosen][others])
        at, step = at + step, min(2 * step, WIDEST)
    return done


LOWEST, HIGHEST = -(2**63) + 1, 2**63 - 1


def _walked(rows: DataFrame, clusters: list, same_label: bool, wants: dict, count: int) -> DataFrame:
    """(anchor, slot, score, node, row): per task, the first `count` candidates of each want of each anchor.

    `wants` gives [(slot, low, high)] of an anchor's row.  Each task goes
    through its candidates once and holds only the clusters and its best rows.
    """
    sent = rows.sparkSession.sparkContext.broadcast((clusters, wants))

    def make():
        listed, wished = sent.value
        groups, lists = [], []
        for c in listed:
            x = np.frombuffer(c["x"], "<i8").reshape(len(c["rows"]), c["dim"])
            groups.append({"x": x, "rows": c["rows"], "middle": np.frombuffer(c["middle"]), "angle": c["angle"], "lengths": np.linalg.norm(x.astype(np.float64), axis=1)})
            lists.append([[(slot, _Best(low, high, count)) for slot, low, high in wished.get(row, ())] for row in c["rows"]])

        def step(batch):
            if batch is None:
                out = []
                for c, own in zip(groups, lists):
                    for row, slots in zip(c["rows"], own):
                        for slot, best in slots:
                            if best.scores is not None:
                                out += [(row, slot, s, n, r) for s, n, r in zip(best.scores.tolist(), best.nodes.tolist(), best.rows.tolist())]
                for at in range(0, len(out), 100_000):
                    yield list(zip(*out[at : at + 100_000]))
                return
            labels, dims = np.array(batch.column(2).to_pylist(), object), np.asarray(batch.column(3))
            ids, nodes, sizes = np.asarray(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False), np.asarray(batch.column(4))
            for dim in np.unique(dims):
                of_dim = np.flatnonzero(dims == dim)
                x = _matrix(batch.column(5).take(pa.array(of_dim)), int(dim))
                for spec, c, own in zip(listed, groups, lists):
                    if spec["dim"] != dim:
                        continue
                    chosen = np.flatnonzero((labels[of_dim] == spec["label"]) == same_label)
                    if not chosen.size:
                        continue
                    at = of_dim[chosen]
                    exact = c["lengths"].max(initial=0) * sizes[at].max() < EXACT
                    walk(c, [[best for _, best in slots] for slots in own], x[chosen], sizes[at], nodes[at], ids[at], exact)

        return step

    kind = rows.schema["node"].dataType.simpleString()
    placed = rows.select("row", "node", "label", "dim", "size", "x")
    return map_batches(placed, make, f"anchor long, slot int, score long, node {kind}, row long", finish=True)


def _first(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "node", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(
    df: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchor` holds.

    Components become integers, floor(scale * c); a score is the inner product
    with the anchor, exact.  An anchor's positives are the first `positives`
    other rows of its label; a positive's negatives the first `negatives` rows
    of other labels with low * p <= 100 * score <= high * p, p the positive's
    score.  Higher scores come first, ties by smaller id.

    Rows with a null id, label or vector, or a null or non-finite component,
    take no part.  Only vectors of equal dimension are compared.  Every row
    counts, repeated ones too, and is not its own positive; an anchor without
    positives, or a positive without negatives, gives nothing, and so does an
    empty table.  Vectors whose scores would not fit into 8 bytes stop the job.

    Anchors are clustered in packs; clusters of about SENT bytes at a time are
    sent to all tasks, each of which walks its candidates' lists.  So
    candidates are read twice per SENT bytes of anchors and never shuffled; a
    task puts out no more than the asked number of rows per anchor and positive.
    """
    rows = _vectors(df, id, label, vector, scale, anchor)
    clusters = materialize(_clusters(rows.where("anchor")))
    total = clusters.agg(F.sum(F.length("x") + F.length("middle"))).first()[0] or 0
    groups = -(-total // SENT)
    key = F.pmod(F.xxhash64("x", "label", "rows"), F.lit(max(groups, 1)))
    out = None
    for g in range(groups):
        chosen = [r.asDict() for r in clusters.where(key == g).collect()]
        if not chosen:
            continue
        anchors = [row for c in chosen for row in c["rows"]]
        near = _first(_walked(rows, chosen, True, {row: [(0, LOWEST, HIGHEST)] for row in anchors}, positives), positives)
        near = materialize(near.select("anchor", F.col("rank").alias("slot"), F.col("score").alias("positive_score"), F.col("node").alias("positive_id")))
        wants: dict = {}
        for r in near.select("anchor", "slot", "positive_score").collect():
            least, most = -(-low * r["positive_score"] // 100), high * r["positive_score"] // 100
            if least <= most:
                wants.setdefault(r["anchor"], []).append((r["slot"], least, most))
        far = _first(_walked(rows, chosen, False, wants, negatives), negatives)
        far = far.select("anchor", "slot", "rank", F.col("score").alias("negative_score"), F.col("node").alias("negative_id"))
        part = materialize(near.join(far, ["anchor", "slot"]))
        out = part if out is None else out.union(part)
    kind = df.schema[id].dataType.simpleString()
    if out is None:
        return df.sparkSession.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long")
    names = rows.where("anchor").select(F.col("row").alias("anchor"), F.col("node").alias("anchor_id"))
    return out.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
