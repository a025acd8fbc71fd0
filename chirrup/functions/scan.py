"""Running aggregates over sequences too long for one task.

A plain window function sends every row of a key to one task.  Here the rows of
a key are cut into bounded blocks; each block is scanned on its own, and only
one summary row per block crosses the key-wide window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chirrup.session import materialize

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    aggs: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Add, per entry of `aggs`, the aggregate over all *earlier* rows of the same keys.

    `aggs` maps an output name to (kind, expression); kind is sum, max, min or
    last (the last non-null value).  `block` must grow with `order`, and bounds
    how many rows one task sorts together.  Nothing earlier gives NULL.
    """
    rows = df.withColumn("_block", block)
    for name, (_, expr) in aggs.items():
        rows = rows.withColumn(f"_in_{name}", expr)
    position = F.struct(*order)

    def summarise(name, kind):
        value = F.col(f"_in_{name}")
        if kind == "last":
            return F.max_by(value, F.when(value.isNotNull(), position))
        return _COMBINE[kind](value)

    summary = rows.groupBy(*keys, "_block").agg(
        *[summarise(name, kind).alias(f"_sum_{name}") for name, (kind, _) in aggs.items()]
    )
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)

    def over(kind, col, window):
        if kind == "last":
            return F.last(col, ignorenulls=True).over(window)
        return _COMBINE[kind](col).over(window)

    carry = summary.select(
        *keys,
        "_block",
        *[over(kind, F.col(f"_sum_{name}"), before).alias(f"_carry_{name}") for name, (kind, _) in aggs.items()],
    )
    out = rows.join(carry, [*keys, "_block"])
    for name, (kind, _) in aggs.items():
        local = over(kind, F.col(f"_in_{name}"), inside)
        carried = F.col(f"_carry_{name}")
        if kind == "last":
            value = F.coalesce(local, carried)
        elif kind == "sum":
            value = F.coalesce(local + carried, local, carried)
        else:
            value = (F.greatest if kind == "max" else F.least)(local, carried)
        out = out.withColumn(name, value)
    return out.drop("_block", *[f"_{p}_{name}" for name in aggs for p in ("in", "carry")])


def numbered(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str) -> DataFrame:
    """Position of each row within its keys, counted from 0."""
    out = running(df, keys, order, block, {name: ("sum", F.lit(1).cast("bigint"))})
    return out.withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], limit: int = 65_536, bins: int = 1024
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, without one task sorting a key's values.

    Values are counted first, so repeats cost nothing.  A key of at most
    `limit` different values is ranked by a window over them.  Of a larger one,
    each wanted rank is closed in on: its values are counted in `bins` equal
    parts of the span that holds the rank, the part with the rank becomes the
    span, its ends being values that occur, and so on until it holds `limit` values.
    Only counts per part cross the network, however close together the values lie.
    Finite values only.
    """
    if not 0 < 1 / bins < 1:
        raise ValueError("values are counted in two parts at least")
    held = materialize(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")))
    sizes = materialize(
        held.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.count("*").alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    )
    ranks = [(name, p, side) for name, p in probs.items() for side in ("lo", "hi")]

    def rank(p, side):
        at = F.lit(p) * (F.col("_total") - 1)
        return (F.floor(at) if side == "lo" else F.ceil(at)).cast("bigint")

    listed = F.array(*[F.struct(F.lit(i).alias("_slot"), rank(p, side).alias("_rank")) for i, (_, p, side) in enumerate(ranks)])
    wanted = sizes.select(*keys, "_m", "_low", "_high", F.lit(0).cast("bigint").alias("_below"), F.inline(listed))

    small = held.join(sizes.where(F.col("_m") <= limit).select(*keys, "_total"), keys)
    order = W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    small = small.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    hits = F.filter(listed, lambda r: (F.col("_before") <= r._rank) & (r._rank < F.col("_before") + F.col("_n")))
    found = small.select(*keys, "_v", F.inline(hits)).select(*keys, "_slot", "_v")

    open_, closed = wanted.where(F.col("_m") > limit), []
    if not sizes.where(F.col("_m") > limit).isEmpty():
        while not open_.isEmpty():
            span = F.col("_high") - F.col("_low")
            part = F.least(F.floor((F.col("_v") - F.col("_low")) / span * bins), F.lit(bins - 1))
            inside = held.join(open_, keys).where("_v between _low and _high").withColumn("_part", part)
            counted = inside.groupBy(*keys, "_slot", "_rank", "_below", "_part").agg(
                F.sum("_n").alias("_n"), F.count("*").alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
            )
            earlier = W.partitionBy(*keys, "_slot").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
            counted = counted.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
            chosen = counted.where((F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("_n")))
            chosen = materialize(chosen.select(*keys, "_m", "_low", "_high", "_below", "_slot", "_rank"))
            closed.append(chosen.where(F.col("_m") <= limit))
            open_ = chosen.where(F.col("_m") > limit)
        inside = held.join(reduce(DataFrame.unionByName, closed), keys).where("_v between _low and _high")
        order = W.partitionBy(*keys, "_slot").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
        inside = inside.withColumn("_before", F.col("_below") + F.coalesce(F.sum("_n").over(order), F.lit(0)))
        hit = (F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
        found = found.unionByName(inside.where(hit).select(*keys, "_slot", "_v"))

    picked = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_slot") == i, F.col("_v"))).alias(f"_{side}_{name}") for i, (name, _, side) in enumerate(ranks)])
    out = picked.join(sizes.select(*keys, "_total"), keys)
    for name, p in probs.items():
        at = F.lit(p) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out = out.withColumn(name, lo + (hi - lo) * (at - F.floor(at)))
    return out.select(*keys, *probs)
