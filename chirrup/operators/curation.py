"""Split hygiene: leakage, first-wins duplicates, source unions and their reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirrup.functions.paths import record_id
from chirrup.session import materialize
from chirrup.sources.manifests import SPLITS

GROUP_KINDS = ("speaker_group", "parent_id", "source_group")


def split_label_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split", "label").agg(F.count("*").alias("n"))


def exclusion_counts(excluded: DataFrame) -> DataFrame:
    """Excluded rows by reason code (the text before any detail)."""
    return excluded.groupBy(F.split_part("reason", F.lit(":"), F.lit(1)).alias("code")).agg(F.count("*").alias("n"))


def split_leakage(manifest: DataFrame, kinds=("sha256", *GROUP_KINDS), split: str = "split") -> DataFrame:
    """Every group value that occurs in more than one split, with all of those splits.

    Splits are few, and the set of them is built before the shuffle, so a value
    holding a third of all rows costs no more than any other.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds])
    long = manifest.select(F.inline(pairs), F.col(split).alias("_split")).where("value is not null and value <> ''")
    found = long.groupBy("kind", "value").agg(F.array_sort(F.collect_set("_split")).alias("splits"))
    return found.where(F.size("splits") > 1)


def split_order(split: Column, splits=SPLITS) -> Column:
    return F.array_position(F.array(*map(F.lit, splits)), split)


def _firsts(rows: DataFrame, key: str, name: str = "_o") -> DataFrame:
    return rows.groupBy(key).agg(F.min("_o").alias(name))


def _winners(pending: DataFrame) -> DataFrame:
    """(_o, _id, _h) of pending rows that are accepted for sure.

    A row is blocked by the earlier rows of its id and of its content.  One
    without any is accepted.  One with a single blocker is accepted exactly when
    that is not, so it points to it; pointers are doubled until they end at a
    row without blockers, and the number of steps, odd or even, decides.  Rows
    with several blockers stay open, and so do those whose pointers end there.
    A group's first and second row are all that is looked at: any later one has
    several blockers.  Each row is pointed to by two others at most.
    """
    rows = pending.select("_o", "_id", "_h")
    for key in ("_id", "_h"):
        first = _firsts(rows, key, f"{key}_1")
        rows = rows.join(first, key)
        second = rows.where(F.col("_o") > F.col(f"{key}_1")).groupBy(key).agg(F.min("_o").alias(f"{key}_2"))
        rows = rows.join(second, key, "left")

    def blocker(key):
        mine = F.col("_o")
        one = F.when(mine == F.col(f"{key}_2"), F.col(f"{key}_1"))
        return one, (mine > F.col(f"{key}_1")) & (mine != F.col(f"{key}_2"))

    (by_id, many_id), (by_hash, many_hash) = blocker("_id"), blocker("_h")
    several = many_id | many_hash | (by_id.isNotNull() & by_hash.isNotNull() & (by_id != by_hash))
    # state: 1 accepted, 0 not, NULL open; a row without a pointer stays as it is.
    chain = rows.select(
        "_o", "_id", "_h", F.when(~several, F.coalesce(by_id, by_hash)).alias("_to"), F.lit(1).alias("_steps"),
        F.when(~several & by_id.isNull() & by_hash.isNull(), 1).alias("_state"),
    )
    chain = materialize(chain)
    while not chain.where("_to is not null").isEmpty():
        ends = chain.select(F.col("_o").alias("_to"), F.col("_to").alias("_next"), F.col("_steps").alias("_more"), F.col("_state").alias("_end"))
        on = chain.join(ends, "_to", "left")
        decided = F.when(F.col("_end").isNotNull(), F.pmod(F.col("_end") + F.col("_steps"), F.lit(2)))
        chain = materialize(
            on.select(
                "_o", "_id", "_h", F.col("_next").alias("_to"), F.when(F.col("_next").isNotNull(), F.pmod(F.col("_steps") + F.col("_more"), F.lit(2))).otherwise(F.col("_steps")).alias("_steps"),
                F.coalesce("_state", decided).cast("int").alias("_state"),
            )
        )
    return chain.where("_state = 1").select("_o", "_id", "_h")


def first_wins_dedup(
    rows: DataFrame, order_col: str, id_col: str = "id", hash_col: str = "sha256", partition_col: str = "split"
) -> DataFrame:
    """Adds `decision`: accepted, or why the row loses to an earlier accepted one.

    In `order_col` order a row is accepted when neither its id nor its content
    belongs to an accepted row; a losing row blocks nobody.  Rows that share
    neither with any other are settled at once.  The rest go through rounds: each
    accepts rows and drops the rows those beat; the few that depend on a dropped
    one wait for the next round.  The first round accepts every row that is first
    both for its id and for its content; later ones follow whole chains at once
    (`_winners`), so a chain of any length takes a few.  Only four narrow columns take part.

    Two rows of one order are an error: which of them is first would be chance.
    """
    slim = rows.select(
        F.col(order_col).alias("_o"),
        F.col(id_col).alias("_id"),
        F.col(hash_col).alias("_h"),
        F.col(partition_col).alias("_p"),
    )

    def shared(key: str) -> DataFrame:
        return slim.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.lit(True).alias(f"{key}_shared"))

    repeated = slim.groupBy("_o").agg(F.count("*").alias("_n")).where("_n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"the order {repeated[0][0]} is not unique")
    marked = slim.join(shared("_id"), "_id", "left").join(shared("_h"), "_h", "left")
    contested = materialize(marked.where("_id_shared or _h_shared").select("_o", "_id", "_h", "_p"))

    pending, won = contested, []
    while not pending.isEmpty():
        won.append(_winners(pending) if won else materialize(_firsts(pending, "_id").join(_firsts(pending, "_h"), "_o")))
        beaten_by = won[-1]
        pending = materialize(
            pending.join(beaten_by.select("_id"), "_id", "left_anti").join(beaten_by.select("_h"), "_h", "left_anti")
        )
    if not won:
        return rows.withColumn("decision", F.lit("accepted"))

    owners = reduce(DataFrame.unionByName, won).join(contested.select("_o", "_p"), "_o")
    id_owner = owners.select("_id", F.col("_o").alias("_id_o"), F.col("_p").alias("_id_p"))
    hash_owner = owners.select("_h", F.col("_o").alias("_h_o"), F.col("_p").alias("_h_p"))
    decided = contested.join(id_owner, "_id", "left").join(hash_owner, "_h", "left")
    id_clash, hash_clash = F.col("_id_o") < F.col("_o"), F.col("_h_o") < F.col("_o")
    decision = (
        F.when(id_clash & (F.col("_id_p") != F.col("_p")), "id_overlaps_splits")
        .when(id_clash, "duplicate_id")
        .when(hash_clash & (F.col("_h_p") != F.col("_p")), "audio_overlaps_splits")
        .when(hash_clash, "duplicate_audio_in_split")
        .otherwise("accepted")
    )
    verdict = decided.select(F.col("_o").alias(order_col), decision.alias("decision"))
    return rows.join(verdict, order_col, "left").withColumn("decision", F.coalesce("decision", F.lit("accepted")))


ABORTING = ("id_overlaps_splits", "audio_overlaps_splits")


def group_leak_after_accept(accepted: DataFrame, kinds=GROUP_KINDS, partition: str = "partition") -> DataFrame:
    return split_leakage(accepted, kinds, partition)


def session_records(sessions: DataFrame, entity: str, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Accepted session rows in manifest shape: always test, always the held-out entity; with the columns `keep`."""
    path = F.concat_ws("/", F.nullif("folder", F.lit("")), "wav")
    ident = record_id(None, path, prefix)
    return sessions.select(
        ident.alias("id"),
        path.alias("path"),
        "label",
        "text",
        F.lit("test").alias("split"),
        F.lit("real").alias("engine"),
        F.lit("human_recording").alias("sample_kind"),
        F.lit(entity).alias("evaluation_group"),
        F.lit(f"human:{entity}").alias("speaker_group"),
        ident.alias("parent_id"),
        F.coalesce("speaker", F.lit(entity)).alias("speaker"),
        "condition",
        *keep,
    )


def union_sources(dataset_rows: DataFrame, session_rows: DataFrame) -> DataFrame:
    return dataset_rows.withColumn("kind", F.lit("dataset")).unionByName(
        session_rows.withColumn("kind", F.lit("session")), allowMissingColumns=True
    )


def heldout_disjoint(splits: DataFrame, heldout: DataFrame, column: str = "sha256") -> DataFrame:
    """Values that the splits share with the held-out view; a clean dataset has none."""
    return splits.select(column).intersect(heldout.select(column))


def curation_report(
    accepted: DataFrame, excluded: DataFrame, held_out: Column, policy: dict[str, float], stops: tuple[str, ...] = ()
) -> DataFrame:
    """One row: totals, counts per split and label, exclusions per reason, and the policy.

    `complete` is false when a row was excluded for one of the reasons `stops`, which end a strict run.
    """
    held = F.coalesce(held_out, F.lit(False))
    per = accepted.groupBy(held.alias("_held"), "split", "label").agg(F.count("*").alias("n"))
    inside = ~F.col("_held")
    entry = F.struct(F.concat_ws("/", "split", "label"), "n")

    def total(n):
        return F.coalesce(F.sum(n), F.lit(0))

    totals = per.agg(
        total(F.col("n")).alias("accepted"),
        total(F.when(inside, F.col("n"))).alias("dataset_accepted"),
        total(F.when(~inside, F.col("n"))).alias("held_out"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(inside, entry)))).alias("counts"),
    )
    why = exclusion_counts(excluded)
    reasons = why.agg(
        total(F.col("n")).alias("excluded"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("exclusions"),
    )
    parts = totals.unionByName(reasons, allowMissingColumns=True)
    row = parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in parts.columns])
    settings = [x for k, v in policy.items() for x in (F.lit(k), F.lit(float(v)))]
    ended = F.array(*map(F.lit, stops)).cast("array<string>")
    return row.withColumn("policy", F.create_map(*settings)).withColumn("complete", ~F.coalesce(F.arrays_overlap(F.map_keys("exclusions"), ended), F.lit(False)))
