"""Near-duplicate vectors over a neighbour graph that is refined by its neighbours' neighbours."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirrup.llm.common import map_batches, map_groups
from chirrup.llm.components import components
from chirrup.session import materialize

#: Neighbours a list begins with; tables of random planes of a round; vectors the audit compares with all at first; the recall to reach.
LIST, TABLES, AUDIT, RECALL = 8, 4, 2000, 0.99
#: True pairs that an audit needs for a verdict, and the comparisons up to which it asks more vectors to see them.
SEEN, COMPARED = 400, 10**11
#: Bytes of asked vectors that are broadcast, and cosines that a task holds at a time, at most.
SENT, HELD = 1 << 26, 1 << 22
#: Rounds beyond those that the planes call for, before a recall that stays low is an error.
SPARE = 4
#: Rows that are compared all with all at a time, about.
BLOCK = 192
PLANES = 24
#: Angles are compared with this margin, so that rounding links nothing that is below the threshold.
MARGIN = 1e-7


def _matrix(column) -> np.ndarray:
    """A binary column of equally long vectors as a matrix."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(values):
        return np.zeros((0, 0))
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.float64).reshape(len(values), -1)


def unit_vectors(df: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """(node, label, dim, unit): vectors at length 1, in double precision, as bytes.

    Rows that link with nothing are left out: null ids, labels, vectors or
    components, components that are not finite, and zero vectors.
    """

    def make():
        def step(batch):
            nodes, labels, units = [], [], []
            for node, kind, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if node is None or kind is None or not values.is_valid or values.values is None or values.values.null_count:
                    continue
                x = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
                size = np.abs(x).max(initial=0.0)
                if not 0 < size < np.inf:
                    continue
                x = x / size
                nodes.append(node)
                labels.append(kind)
                units.append((x / math.sqrt(float(x @ x))).tobytes())
            yield nodes, labels, [len(u) // 8 for u in units], units

        return step

    kinds = [df.schema[c].dataType.simpleString() for c in (id, label)]
    return map_batches(df.select(id, label, vector), make, f"node {kinds[0]}, label {kinds[1]}, dim int, unit binary")


def _codes(df: DataFrame, tables: list[int], keep: list[str]) -> DataFrame:
    """The columns `keep`, `table` and `code`: on which side of PLANES random planes each vector lies, once per table."""

    def make():
        planes: dict = {}

        def step(batch):
            dims = np.asarray(batch.column(0))
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(rows))
                x = _matrix(part.column(1))
                for t in tables:
                    if (dim, t) not in planes:
                        planes[dim, t] = np.random.default_rng([7, t, int(dim)]).standard_normal((int(dim), PLANES))
                    code = ((x @ planes[dim, t]) > 0) @ (1 << np.arange(PLANES, dtype=np.int64)[::-1])
                    yield *part.columns[2:], pa.array(np.full(len(rows), t, np.int32)), pa.array(code)

        return step

    ddl = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(df.select("dim", "unit", *keep), make, f"{ddl}, `table` int, code bigint")


def _leads(nodes: DataFrame, tables: list[int]) -> tuple[DataFrame, DataFrame]:
    """(node, table, _lead), nodes by their leading code bits, and (_lead, _nodes, _parts), the size of each lead and the blocks it is cut into."""
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.log2(F.greatest(F.count("*") / BLOCK, F.lit(1.0)))).alias("_bits"))
    coded = _codes(nodes, tables, ["node", "label", "dim"]).join(sizes, ["label", "dim"])
    lead = coded.select("node", "table", F.xxhash64("label", "dim", "table", F.expr(f"shiftright(code, greatest({PLANES} - cast(_bits as int), 0))")).alias("_lead"))
    return lead, lead.groupBy("_lead").agg(F.count("*").alias("_nodes"), F.ceil(F.count("*") / (1.5 * BLOCK)).alias("_parts"))


def _blocks(nodes: DataFrame, tables: list[int]) -> DataFrame:
    """(block, node): blocks of about BLOCK nodes of one label whose leading code bits agree, in each table.

    A larger group is cut into as many leading bits as its size asks for; where
    codes are equal throughout, by a hash.  No node is left out.
    """
    lead, counts = _leads(nodes, tables)
    part = F.pmod(F.xxhash64("node", "table"), F.col("_parts"))
    return lead.join(counts.drop("_nodes"), "_lead").select(F.xxhash64("_lead", part).alias("block"), "node")


def _with_vectors(rows: DataFrame, nodes: DataFrame, *more: str) -> DataFrame:
    return rows.join(nodes.select("node", "label", "dim", "unit", *more), "node")


def _parts(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism * 2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def balls(nodes: DataFrame, half: float, rounds: int = 2) -> DataFrame:
    """(node, ball, angle): leaders, and the nodes within the angle `half` of them.

    Any two nodes of a ball are then within twice that angle of each other, so
    a crowd of near copies needs no pairs.  Blocks of each round elect leaders,
    those with most nodes around them first; a ball joins another only whole.
    `angle` is an upper bound of the node's angle to its leader.
    """
    places = nodes.select("node", F.col("node").alias("ball"), F.lit(0.0).alias("angle"))
    leaders = nodes.select("*", F.lit(0.0).alias("radius"))

    def make():
        def step(rows, starts):
            nodes_, labels, dims = (np.asarray(rows.column(k)) for k in (1, 2, 3))
            radii, units = np.asarray(rows.column(5)), rows.column(4)
            out = ([], [], [])
            for b, e in zip(starts, [*starts[1:], rows.num_rows]):
                if e - b < 2 or len({*zip(labels[b:e], dims[b:e])}) > 1:
                    continue  # two labels share a block only if their hashes are equal
                x = _matrix(units.slice(b, e - b))
                reach = np.arccos(np.clip(x @ x.T, -1, 1)) + radii[b:e][None, :]
                near = reach <= half - MARGIN
                np.fill_diagonal(near, True)
                free = np.ones(e - b, bool)
                while True:
                    degree = (near & free[None, :]).sum(axis=1) * free
                    leader = int(degree.argmax())
                    if degree[leader] < 2:
                        break
                    taken = np.flatnonzero(near[leader] & free)
                    free[taken] = False
                    taken = taken[taken != leader]
                    out[0].extend(nodes_[b:e][taken].tolist())
                    out[1].extend([int(nodes_[b + leader])] * len(taken))
                    out[2].extend((reach[leader][taken] - radii[b:e][taken]).tolist())
            yield out

        return step

    for t in range(rounds):
        rows = _with_vectors(_blocks(leaders, [(1 << 20) + t]), leaders, "radius").select("block", "node", "label", "dim", "unit", "radius")
        moves = materialize(map_groups(rows, ["block"], make, "node bigint, into bigint, step double", _parts(nodes)))
        joined = places.join(moves.withColumnRenamed("node", "ball"), "ball", "left")
        places = materialize(joined.select("node", F.coalesce("into", "ball").alias("ball"), F.when(F.col("into").isNull(), F.col("angle")).otherwise(F.col("angle") + F.col("step")).alias("angle")))
        radius = places.groupBy(F.col("ball").alias("node")).agg(F.max("angle").alias("radius"))
        leaders = materialize(nodes.join(radius, "node"))
    return places


def _lists(edges: DataFrame, nodes: DataFrame, theta: float) -> DataFrame:
    """(node, other, cos): of the known edges of a node, all within reach and the best others.

    A list holds LIST neighbours; where they all are within reach it is
    saturated and grows to twice those within reach.
    """
    radius = nodes.select("node", "radius")
    near = edges.join(radius, "node").join(radius.select(F.col("node").alias("other"), F.col("radius").alias("_other")), "other")
    reach = F.acos(F.least("cos", F.lit(1.0))) <= theta + F.col("radius") + F.col("_other") + MARGIN
    grouped = near.groupBy("node", "other").agg(F.max("cos").alias("cos"), F.max(reach).alias("reach"))
    lists = grouped.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("reach", "cos", "other")), asc=False).alias("_list"))
    count = F.size(F.filter("_list", lambda x: x["reach"]))
    kept = F.slice("_list", 1, F.greatest(F.lit(LIST), 2 * count))
    return lists.select("node", F.explode(kept).alias("_e")).select("node", F.col("_e.other").alias("other"), F.col("_e.cos").alias("cos"), F.col("_e.reach").alias("reach"))


def _best_pairs(theta: float):
    """From the members of a block or of a pivot's neighbourhood: each one's best partners there."""

    def make():
        def step(rows, starts):
            nodes, labels, dims, radii = (np.asarray(rows.column(k)) for k in (2, 3, 4, 6))
            units, out = rows.column(5), ([], [], [])
            for b, e in zip(starts, [*starts[1:], rows.num_rows]):
                _, first = np.unique(nodes[b:e], return_index=True)
                if len(first) < 2 or len({*zip(labels[b:e], dims[b:e])}) > 1:
                    continue
                own, r = nodes[b:e][first], radii[b:e][first]
                x = _matrix(units.slice(b, e - b))[first]
                cos = x @ x.T
                np.fill_diagonal(cos, -2)
                k = min(LIST, len(first) - 1)
                best = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                pick = np.zeros(cos.shape, bool)
                np.put_along_axis(pick, best, True, axis=1)
                pick |= (np.arccos(np.clip(cos, -1, 1)) <= theta + r[:, None] + r[None, :] + MARGIN) & (cos > -2)
                i, j = np.nonzero(pick)
                out[0].append(own[i])
                out[1].append(own[j])
                out[2].append(cos[i, j])
            if out[0]:
                yield tuple(pa.array(np.concatenate(c)) for c in out)

        return step

    return make


_EDGE = "node bigint, other bigint, cos double"


def _join_round(lists: DataFrame, nodes: DataFrame, theta: float) -> DataFrame:
    """Edges among the neighbours, forward and backward, of each node.

    A node that very many others list has its backward neighbours dealt to
    parts of bounded size; its forward ones go to each part.
    """
    back = lists.select(F.col("other").alias("pivot"), F.col("node").alias("member"))
    parts = back.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("_parts"))
    dealt = back.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("member"), F.col("_parts")).alias("part"), "member")
    ahead = lists.select(F.col("node").alias("pivot"), F.col("other").alias("member")).union(parts.select("pivot", F.col("pivot").alias("member")))
    ahead = ahead.join(parts, "pivot", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    ahead = ahead.select("pivot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("part"), "member")
    members = dealt.unionByName(ahead).withColumnRenamed("member", "node")
    rows = _with_vectors(members, nodes, "radius").select("pivot", "part", "node", "label", "dim", "unit", "radius")
    return map_groups(rows, ["pivot", "part"], _best_pairs(theta), _EDGE, _parts(nodes))


def _audit(edges: DataFrame, nodes: DataFrame, theta: float) -> float | None:
    """Share of the pairs within reach of some nodes, found by comparing these with all, that the graph has.

    More nodes are asked, as many as the pairs seen so far call for, until SEEN
    true pairs are found or all nodes were asked, which is exact.  None if
    COMPARED comparisons or SENT bytes of vectors do not show that many: then
    the audit tells nothing, and would not after another round.
    """
    (n, wide), asked = nodes.agg(F.count("*"), F.max("dim")).first(), AUDIT
    most = max(AUDIT, min(COMPARED // max(n, 1), SENT // (8 * max(wide or 1, 1))))
    while True:
        true, found = _asked(edges, nodes, theta, asked)
        if true >= SEEN or asked >= n:
            return found / true if true else 1.0
        if asked >= most:
            return None
        asked = min(most, n, max(4 * asked, 2 * asked * SEEN // true) if true else most)


def _asked(edges: DataFrame, nodes: DataFrame, theta: float, n: int) -> tuple[int, int]:
    """How many pairs within reach `n` nodes have with all, and how many of those are in the graph."""
    asked = nodes.select("node", "label", "dim", "unit", "radius").orderBy(F.xxhash64("node")).limit(n).collect()
    groups: dict = {}
    for r in asked:
        groups.setdefault((r["label"], r["dim"]), []).append((r["node"], bytes(r["unit"]), r["radius"]))
    sent = nodes.sparkSession.sparkContext.broadcast(groups)

    def make():
        def step(batch):
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            own, radii = np.asarray(batch.column(2)), np.asarray(batch.column(4))
            for key in set(keys) & set(sent.value):
                every = np.array([i for i, k in enumerate(keys) if k == key])
                nodes_, units, r = zip(*sent.value[key])
                others = np.array([np.frombuffer(u) for u in units]).T
                size = max(HELD // len(nodes_), 1)
                for at in range(0, len(every), size):
                    rows = every[at : at + size]
                    cos = np.clip(_matrix(batch.column(3).take(pa.array(rows))) @ others, -1, 1)
                    i, j = np.nonzero(np.arccos(cos) <= theta + radii[rows][:, None] + np.array(r)[None, :])
                    a, b = np.array(nodes_)[j], own[rows][i]
                    yield pa.array(a[a != b]), pa.array(b[a != b])

        return step

    true = map_batches(nodes.select("label", "dim", "node", "unit", "radius"), make, "node bigint, other bigint")
    known = edges.select("node", "other").withColumn("_known", F.lit(1))
    return tuple(true.join(known, ["node", "other"], "left").agg(F.count("*"), F.count("_known")).first())


def _tables_needed(nodes: DataFrame, theta: float) -> int:
    """Tables of planes after which a pair at the widest reach of its label has shared a block with the chance RECALL.

    Groups that a hash cuts further part a pair as often as a node's group is cut on average.
    """
    cut = _leads(nodes, [0])[1].agg(F.sum(F.col("_nodes") * F.col("_parts")) / F.sum("_nodes")).first()[0] or 1.0
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).where("n > 1")
    bits = F.least(F.ceil(F.log2(F.greatest(F.col("n") / BLOCK, F.lit(1.0)))), F.lit(PLANES))
    shared = F.pow(1 - F.least(theta + 2 * F.col("radius"), F.lit(math.pi / 2)) / math.pi, bits) / cut
    tables = F.when(shared >= RECALL, 1.0).otherwise(F.log(F.lit(1 - RECALL)) / F.log1p(-shared))
    return math.ceil(sizes.agg(F.max(tables)).first()[0] or 1)


def neighbour_graph(nodes: DataFrame, theta: float) -> tuple[DataFrame, float]:
    """Edges (node, other, cos, reach) of all pairs within reach that were found, both ways, and the audited recall.

    `nodes` has (node, label, dim, unit, radius); a pair is within reach if its
    angle is at most theta and both radii.  Random planes begin the lists;
    joins of neighbours with neighbours' neighbours go on, with new planes each
    time, until the audit finds the recall.  Where links are so rare that the
    audit tells nothing, they go on until the planes alone give the recall.  A
    recall that stays low after SPARE rounds more is an error.
    """

    def blocks(k):
        rows = _with_vectors(_blocks(nodes, [TABLES * k + t for t in range(TABLES)]), nodes, "radius")
        rows = rows.select("block", F.lit(0).alias("part"), "node", "label", "dim", "unit", "radius")
        return map_groups(rows, ["block", "part"], _best_pairs(theta), _EDGE, _parts(nodes))

    lists = materialize(_lists(blocks(0), nodes, theta))
    needed = math.ceil(_tables_needed(nodes, theta) / TABLES)
    k, recall = 0, 0.0
    while True:
        more = _join_round(lists, nodes, theta)
        if k:
            more = more.union(blocks(k))
        both = lists.select("node", "other", "cos").union(more).union(more.select("other", "node", "cos"))
        lists = materialize(_lists(both, nodes, theta))
        recall = _audit(lists.where("reach"), nodes, theta) if recall is not None else None
        k += 1
        if recall is None and k >= needed or recall is not None and recall >= RECALL:
            return lists.where("reach"), recall
        if k >= needed + SPARE:
            raise RuntimeError(f"near duplicates: recall {recall} after {k} rounds, {RECALL} asked")


def near_duplicates(df: DataFrame, threshold: float = 0.93, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept, audited_recall): one row per row of `df`.

    Vectors of equal, non-null labels link if their cosine in double precision
    is `threshold` or more.  Vectors that are null, zero, or hold null or
    non-finite components, and those of other lengths, link with nothing.  Equal
    vectors are one class; crowds of close ones become balls (see `balls`).  The
    graph is built over the balls' leaders; balls whose leaders are close enough
    for every pair are linked whole, those too close to tell are compared member
    by member in blocks, and only counts leave a block.  A graph whose audited
    recall stays low is an error, not a result; `audited_recall` is the share of
    the asked leaders' pairs that the graph has, null where links are too rare to tell.  Ids are unique but for
    repeated rows; a null id links with nothing.  An empty table gives an empty one.
    """
    theta = math.acos(threshold)
    ids = df.schema[id].dataType
    df = df.select(F.col(id).cast("bigint").alias(id), label, vector)
    rows = materialize(unit_vectors(df, id, vector, label))
    classes = materialize(rows.groupBy("label", "dim", "unit").agg(F.min("node").alias("_class"), F.count("*").alias("copies")))
    nodes = materialize(classes.select(F.col("_class").alias("node"), "label", "dim", "unit", "copies"))
    places = balls(nodes, theta / 2)
    sizes = places.join(nodes.select("node", "copies"), "node").groupBy(F.col("ball").alias("node")).agg(
        F.max("angle").alias("radius"), F.count("*").alias("members"), F.sum("copies").alias("rows")
    )
    leaders = materialize(nodes.drop("copies").join(sizes, "node"))
    graph, recall = neighbour_graph(leaders, theta)
    about = leaders.select("node", "radius", "members", "rows")
    pairs = graph.where("node < other").join(about, "node")
    pairs = pairs.join(about.select(*[F.col(c).alias({"node": "other"}.get(c, f"o_{c}")) for c in about.columns]), "other")
    angle = F.acos(F.least("cos", F.lit(1.0))) + F.col("radius") + F.col("o_radius")
    single = (F.col("members") == 1) & (F.col("o_members") == 1)
    pairs = materialize(pairs.withColumn("sure", F.when(single, F.col("cos") >= threshold).otherwise(angle <= theta - MARGIN)).withColumn("open", ~single & (angle > theta - MARGIN)))

    sure = pairs.where("sure")
    whole = sure.select("node", F.col("o_rows").alias("n")).union(sure.select("other", "rows")).groupBy("node").agg(F.sum("n").alias("_whole"))

    # Pairs of balls that the bounds leave open, in blocks of both.
    width = 2 * BLOCK
    tasks = pairs.where("open").select("node", "other", F.expr(f"explode(sequence(0L, cast(ceil(members / {width}) as bigint) - 1))").alias("a"), "o_members")
    tasks = tasks.select("node", "other", "a", F.expr(f"explode(sequence(0L, cast(ceil(o_members / {width}) as bigint) - 1))").alias("b"))
    members = places.join(nodes, "node").join(about.select(F.col("node").alias("ball"), "members"), "ball")
    members = members.select("ball", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / width)).alias("piece"), F.col("node").alias("member"), "copies", "unit")
    members = materialize(members)
    one = tasks.join(members, (F.col("node") == F.col("ball")) & (F.col("a") == F.col("piece"))).withColumn("side", F.lit(0))
    two = tasks.join(members, (F.col("other") == F.col("ball")) & (F.col("b") == F.col("piece"))).withColumn("side", F.lit(1))
    sides = one.unionByName(two).select("node", "other", "a", "b", "side", "member", "copies", "unit")

    def make():
        def step(rows, starts):
            first, second, side, member, copies = (np.asarray(rows.column(k)) for k in (0, 1, 4, 5, 6))
            units, out = rows.column(7), ([], [], [], [])
            for b, e in zip(starts, [*starts[1:], rows.num_rows]):
                x, s, m, c = _matrix(units.slice(b, e - b)), side[b:e], member[b:e], copies[b:e]
                linked = x[s == 0] @ x[s == 1].T >= threshold
                for own, counts in ((m[s == 0], linked @ c[s == 1]), (m[s == 1], c[s == 0] @ linked)):
                    out[0].extend(own[counts > 0].tolist())
                    out[1].extend(counts[counts > 0].tolist())
                    out[2].extend([int(first[b])] * int((counts > 0).sum()))
                    out[3].extend([int(second[b])] * int((counts > 0).sum()))
            yield out

        return step

    counted = materialize(map_groups(sides, ["node", "other", "a", "b"], make, "member bigint, n bigint, node bigint, other bigint", _parts(nodes)))
    some = counted.groupBy("member").agg(F.sum("n").alias("_some"))
    edges = sure.select("node", "other").union(counted.select("node", "other").distinct())
    parts = components(edges, "node", "other")
    roots = places.join(parts.select(F.col("node").alias("ball"), "component"), "ball", "left").withColumn("_root", F.coalesce("component", "ball"))
    least = roots.groupBy("_root").agg(F.min("node").alias("component_id"))
    per = roots.join(least, "_root").join(about.select(F.col("node").alias("ball"), "rows"), "ball")
    per = per.join(whole.withColumnRenamed("node", "ball"), "ball", "left").join(some.withColumnRenamed("member", "node"), "node", "left")
    links = F.col("rows") - 1 + F.coalesce("_whole", F.lit(0)) + F.coalesce("_some", F.lit(0))
    per = per.select(F.col("node").alias("_class"), links.alias("n_links"), "component_id")
    named = rows.join(classes.select("label", "dim", "unit", "_class"), ["label", "dim", "unit"]).groupBy("node").agg(F.min("_class").alias("_class")).join(per, "_class")
    out = df.join(named, F.col(id) == F.col("node"), "left")
    component = F.coalesce("component_id", F.col(id))
    return out.select(
        F.col(id).cast(ids).alias(id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col(id), F.lit(True)).alias("kept"),
        F.lit(recall).cast("double").alias("audited_recall"),
    )
