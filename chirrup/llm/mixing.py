"""Mixtures of sources: how often each document is taken so that sources reach their target sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chirrup.functions.scan import numbered
from chirrup.llm.common import packed, unpacked, word_count
from chirrup.session import materialize

#: Rows of one (source, size) that one task numbers, about.
BLOCK = 65_536
#: Newton stops at this relative distance from every target, or after so many steps (bisection alone would be there by then).
TOLERANCE, STEPS = 1e-6, 60


def targets(sizes: DataFrame, weights: tuple[int, ...], ceiling: int) -> DataFrame:
    """(_k, _source, source_size, target) of each source, from rows (_source, _size).

    Sources in code point order, null last, weigh `weights`, repeating, and
    share the size of all.  A target stops at `ceiling` times its source's
    size; what is over is shared again by weight.  There is one row per source;
    one window sorts the sources by the size at which they stop.
    """
    sums = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_k") - 1) % len(weights) + 1).cast("int"))
    rows = sums.select(place.alias("_k"), "_source", "source_size").withColumn("_w", weight)
    rows = rows.withColumn("_stop", F.col("source_size") * ceiling)
    order = W.orderBy(F.col("_stop") / F.col("_w"), "_k")
    sofar, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    # The share of a weight if this source and all that stop later do not stop.
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_stop").over(sofar), F.lit(0))
    rows = rows.withColumn("_left", left).withColumn("_rest", F.sum("_w").over(rest))
    free = F.col("_left") * F.col("_w") <= F.col("_stop") * F.col("_rest")
    first = F.min(F.when(free, F.struct(F.col("_stop") / F.col("_w"), F.col("_k"), "_left", "_rest"))).over(whole)
    rows = rows.withColumn("_first", first).withColumn("_here", F.struct(F.col("_stop") / F.col("_w"), F.col("_k"), "_left", "_rest"))
    share = F.col("_w") * F.col("_first._left") / F.col("_first._rest")
    target = F.when(F.col("_first").isNull() | (F.col("_here") < F.col("_first")), F.col("_stop").cast("double")).otherwise(share)
    return rows.select("_k", "_source", "source_size", target.alias("target"))


def _rate(ceiling: int, tilt: Column) -> Column:
    """Copies per document: exp(tilt) near 1 copy, bent so that it stays below `ceiling`."""
    e = F.exp(F.least(tilt, F.lit(500.0)))
    return ceiling * e / (ceiling - 1 + e)


def tilts(histogram: DataFrame, goals: DataFrame, ceiling: int) -> DataFrame:
    """(_k, _tilt): per source the dual variable whose rates meet the target.

    Of all document rates in [0, ceiling] that meet a source's target size,
    those of least entropy relative to one copy each tilt exponentially in the
    document's size.  The dual is convex in one number per source, so all
    sources take Newton steps at once, each kept inside a bracket that shrinks.
    Sums are exact decimals of rounded terms: the same on any partitioning.
    """
    full = F.col("target") >= F.col("source_size") * (ceiling - 1e-9)
    state = goals.where((F.col("source_size") > 0) & ~full & (F.col("target") > 0)).select("_k", "target")
    state = materialize(state.select("*", F.lit(0.0).alias("_tilt"), F.lit(float("-inf")).alias("_lo"), F.lit(float("inf")).alias("_hi"), F.lit(False).alias("_met")))
    for _ in range(STEPS):
        if state.where("not _met").isEmpty():
            break
        rate = _rate(ceiling, F.col("_tilt") * F.col("_x"))
        here = F.col("_n") * F.col("_size") * rate
        slope = here * F.col("_x") * (1 - rate / ceiling)
        exact = [F.sum(F.round(v * 1024).cast("decimal(38,0)")).alias(n) for n, v in (("_sum", here), ("_slope", slope))]
        sums = histogram.join(state.where("not _met"), "_k").groupBy("_k").agg(*exact)
        step = state.join(sums, "_k", "left")
        gap = F.col("target") - F.col("_sum").cast("double") / 1024
        lo, hi = F.when(gap > 0, F.col("_tilt")).otherwise(F.col("_lo")), F.when(gap > 0, F.col("_hi")).otherwise(F.col("_tilt"))
        step = step.select("_k", "target", "_tilt", gap.alias("_gap"), (F.col("_slope").cast("double") / 1024).alias("_slope"), lo.alias("_lo"), hi.alias("_hi"), "_met")
        near = F.abs("_gap") <= F.greatest(F.col("target") * TOLERANCE, F.lit(0.25))
        newton = F.col("_tilt") + F.col("_gap") / F.greatest("_slope", F.lit(1e-12))
        reach = F.greatest(F.lit(1.0), F.abs("_tilt")) * 2
        newton = F.greatest(F.least(newton, F.col("_tilt") + reach), F.col("_tilt") - reach)
        inside = (newton > F.col("_lo")) & (newton < F.col("_hi"))
        moved = F.when(inside, newton).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        met = F.col("_met") | near
        state = materialize(step.select("_k", "target", F.when(met, F.col("_tilt")).otherwise(moved).alias("_tilt"), "_lo", "_hi", met.alias("_met")))
    return state.select("_k", "_tilt")


def _filled(rounded: DataFrame, ceiling: int) -> DataFrame:
    """Move the rounded totals of few sizes so that each source's sum comes as near its target as its smallest documents allow.

    What is missing (or over) goes, from large to small, to one size of each
    power of two: the one with most room.
    """
    gap = F.first("target") - F.sum(F.col("_m") * F.col("_size"))
    rows = rounded.join(rounded.groupBy("_k").agg(F.round(gap).cast("bigint").alias("_gap")), "_k")
    room = F.when(F.col("_gap") > 0, F.col("_n") * ceiling - F.col("_m")).otherwise(F.col("_m"))
    rows = rows.withColumn("_room", room)
    octave = rows.groupBy("_k", F.floor(F.log2("_size")).alias("_octave")).agg(
        F.max_by(F.struct(F.col("_size").alias("size"), F.col("_room").alias("room")), F.struct("_room", "_size")).alias("_best"), F.first("_gap").alias("_gap")
    )
    sides = octave.groupBy("_k").agg(F.sort_array(F.collect_list("_best"), asc=False).alias("_sizes"), F.first("_gap").alias("_gap"))
    kind = "array<struct<size:bigint,m:bigint>>"

    def give(state, entry):
        m = F.least(entry["room"], F.floor(state["left"] / entry["size"])).cast("bigint")
        pick = F.array(F.struct(entry["size"].alias("size"), m.alias("m")))
        return F.struct((state["left"] - m * entry["size"]).alias("left"), F.concat(state["picks"], pick).alias("picks"))

    begin = F.struct(F.abs("_gap").alias("left"), F.array().cast(kind).alias("picks"))
    picks = sides.select("_k", F.signum("_gap").cast("bigint").alias("_sign"), F.explode(F.aggregate("_sizes", begin, give)["picks"]).alias("_p"))
    moved = picks.select("_k", F.col("_p.size").alias("_size"), (F.col("_p.m") * F.col("_sign")).alias("_more"))
    return rounded.join(moved, ["_k", "_size"], "left").withColumn("_m", F.col("_m") + F.coalesce("_more", F.lit(0))).drop("_more")


def mix(
    df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3, id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken): one row per row of `df`.

    Size is the number of words.  Documents of one source and size have one
    rate; along a source from long to short, running sums of rates are rounded,
    and the copies of one size are dealt evenly to its documents in the order of
    a hash of their ids.  So no document is taken more than `ceiling` times, and
    a source misses its target by less than its small documents' sizes.
    Null and empty texts have size 0 and are taken once, which costs nothing.
    A null source is a source; an empty table gives an empty one.  Rows of equal
    ids are dealt with one by one.  Reruns agree.
    """
    sized = materialize(df.select(F.col(id).alias("_id"), F.col(source).alias("_source"), word_count(F.col(text)).alias("_size")))
    goals = materialize(targets(sized, weights, ceiling))
    keyed = sized.join(F.broadcast(goals) if goals.count() <= 10_000 else goals, sized["_source"].eqNullSafe(goals["_source"])).drop(goals["_source"])
    counts = keyed.where("_size > 0").groupBy("_k", "_size").agg(F.count("*").alias("_n"))
    means = counts.groupBy("_k").agg((F.sum(F.col("_n") * F.col("_size")) / F.sum("_n")).alias("_mean"))
    histogram = materialize(counts.join(means, "_k").select("_k", "_size", "_n", (F.col("_size") / F.col("_mean")).alias("_x")))

    rates = histogram.join(goals.select("_k", "target"), "_k").join(tilts(histogram, goals, ceiling), "_k", "left")
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("_tilt").isNull(), F.lit(float(ceiling))).otherwise(_rate(ceiling, F.col("_tilt") * F.col("_x")))
    due = F.round(rate * F.col("_n"), 6).cast("decimal(38,6)")
    along = W.partitionBy("_k").orderBy(F.desc("_size")).rowsBetween(W.unboundedPreceding, 0)
    upto = F.sum("_due").over(along)
    rounded = rates.withColumn("_due", due).withColumn("_upto", upto)
    total = F.floor(F.col("_upto") + 0.5) - F.floor(F.col("_upto") - F.col("_due") + 0.5)
    rounded = materialize(rounded.select("_k", "_size", "_n", "target", F.least(total.cast("bigint"), F.col("_n") * ceiling).alias("_m")))
    dealt = materialize(_filled(rounded, ceiling).select("_k", "_size", "_n", "_m"))

    rows = keyed.join(dealt, ["_k", "_size"], "left")
    hashed = rows.withColumn("_u", F.shiftrightunsigned(F.xxhash64("_id"), 11) / F.lit(float(1 << 53)))
    block = F.floor(F.col("_u") * F.ceil(F.coalesce("_n", F.lit(1)) / BLOCK))
    ranked = numbered(hashed, ["_k", "_size"], ["_u"], block, "_j")
    share = "cast((cast({} as decimal(20,0)) * _m) div _n as bigint)"
    copies = F.coalesce(F.expr(f"{share.format('_j + 1')} - {share.format('_j')}"), F.lit(1))
    return ranked.withColumn("copies", copies).select(
        F.col("_id").alias(id), F.col("_source").alias(source), F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken")
    )


def apply_mix(df: DataFrame, mixed: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of `df`, each as often as `mixed` takes it.

    Rows that share id, source and size share their copies evenly.
    """
    keys = {"mid": id, "msource": source, "msize": "size"}
    sums = materialize(mixed.groupBy(*[F.col(c).alias(k) for k, c in keys.items()]).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")))
    rows = packed(df, id=F.col(id), source=F.col(source), size=word_count(F.col(text)), mark=F.xxhash64(text))
    # One row per document meets the documents: both sides are shuffled at every size.
    found = rows.join(sums.hint("merge"), F.col("id").eqNullSafe(F.col("mid")) & F.col("source").eqNullSafe(F.col("msource")) & (F.col("size") == F.col("msize")))
    if sums.where("rows > 1").isEmpty():
        return unpacked(found.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
    single = found.where("rows = 1").withColumn("c", F.col("copies"))
    nth = F.row_number().over(W.partitionBy("mid", "msource", "msize").orderBy("mark"))
    shared = found.where("rows > 1").withColumn("c", F.floor(nth * F.col("copies") / F.col("rows")) - F.floor((nth - 1) * F.col("copies") / F.col("rows")))
    both = single.unionByName(shared).where("c > 0")
    return unpacked(both.select("row", F.explode(F.sequence(F.lit(1), F.col("c").cast("int")))))
