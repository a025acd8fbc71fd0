"""From detector windows to events, matches and event metrics."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chirrup.functions.arrays import label_names, let
from chirrup.functions.scan import exact_quantiles, numbered, running
from chirrup.functions.sequential import fold_sorted
from chirrup.session import materialize

EPS = 1e-9
NEVER = float("-inf")
MARK = "struct<idx:bigint,t:double,t_before:double,on:boolean,off:boolean,ready:boolean,conf:double>"


def _marks(windows: DataFrame, ignored, threshold: float, consecutive: int, block_windows: int) -> DataFrame:
    """Per class, the windows that can change its state.

    on: the class becomes active; off: the first window after it was active;
    ready: it has been active for `consecutive` windows.  A block borrows the
    few windows before it, so blocks of one recording are read independently.
    """
    candidate = F.when((F.col("confidence") >= threshold) & ~F.col("predicted_label").isin(*ignored), F.col("predicted_label"))
    borrowed = max(consecutive - 1, 1)
    size = max(block_windows, borrowed + 1)
    home = F.floor(F.col("window_index") / size)
    near_end = F.pmod("window_index", F.lit(size)) >= size - borrowed
    spread = windows.select(
        "recording_id", "window_index", "time_seconds", "confidence", candidate.alias("_c"), home.alias("_home"),
        F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))).alias("_b"),
    )
    order = W.partitionBy("recording_id", "_b").orderBy("window_index")
    recent = order.rowsBetween(1 - consecutive, 0)
    c = F.col("_c")
    steady = (F.count(c).over(recent) == consecutive) & (F.min(c).over(recent) == F.max(c).over(recent))
    # A block's first window is known, and each other one follows its predecessor: a gap would pass for silence.
    first = F.greatest(F.lit(0), F.col("_b") * size - borrowed)
    due = F.coalesce(F.lag("window_index").over(order) + 1, first)
    gap = F.raise_error(F.concat(F.lit("window_index has a gap or a repeat at "), F.col("window_index"), F.lit(" of recording "), F.col("recording_id")))
    checked = F.when(F.col("window_index") == due, F.col("time_seconds")).otherwise(gap.cast("double"))
    rows = (
        spread.withColumn("time_seconds", checked)
        .withColumn("_before", F.lag("time_seconds").over(order))
        .withColumn("_last", F.lag("_c").over(order))
        .withColumn("_ready", steady)
        .where("_b = _home")
    )
    switched = ~F.col("_c").eqNullSafe(F.col("_last"))

    def mark(label: Column, on, off, ready) -> Column:
        state = F.struct("window_index", "time_seconds", "_before", on, off, ready, "confidence").cast(MARK)
        return F.struct(label.alias("label"), state.alias("m"))

    no = F.lit(False)
    started = F.when(c.isNotNull() & (switched | F.col("_ready")), mark(c, switched, no, F.col("_ready")))
    ended = F.when(F.col("_last").isNotNull() & switched, mark(F.col("_last"), no, F.lit(True), no))
    return rows.select("recording_id", F.inline(F.array_compact(F.array(started, ended))))


def _step(acc: Column, x: Column, release: float, cooldown: float) -> tuple[Column, Column]:
    """(armed before any emission at x, does x emit)."""
    armed = acc.armed | F.coalesce(x.on & (x.t_before - acc.off + EPS >= release), F.lit(False))
    return armed, x.ready & armed & (x.t - acc.last + EPS >= cooldown)


def _carry(release: float):
    """State of a class at the start of each of its blocks, walked in time order."""

    def step(state, block, first_on, last_off, lasts, out_armed, out_last, out_changed):
        armed, last, off = state.get("s", (True, NEVER, None))
        start = (block, armed, last, off)
        rested = first_on is not None and off is not None and first_on - off + EPS >= release
        at = (0 if armed or rested else len(lasts)) + (lasts.index(last) if last in lasts else 0)
        if out_changed[at]:
            last = out_last[at]
        state["s"] = (out_armed[at], last, off if last_off is None else last_off)
        return (start,)

    return step


def decode_events(
    windows: DataFrame,
    ignored=("unknown", "background"),
    threshold: float = 0.5,
    consecutive: int = 2,
    release: float = 0.3,
    cooldown: float = 1.0,
    block_windows: int = 4096,
    block_seconds: float | None = None,
) -> DataFrame:
    """Detections (recording_id, window_index, label, time_seconds, confidence).

    A window is a candidate when its top class reaches `threshold` and is not
    ignored.  A class emits once it was the candidate for `consecutive` windows,
    is armed, and `cooldown` seconds have passed since it last emitted.  Emitting
    disarms it until it has been inactive for `release` seconds.

    Windows carry window_index, counted from 0 without gaps per recording; a gap or a repeat stops the job.

    One recording may hold most windows, so nothing here needs a whole recording
    in one task.  A time block of a class maps the state it starts with to the
    state it leaves; few starting states differ (armed or not, and the last
    emission if still cooling), so each block is tabulated for all of them in
    parallel.  Only the tables, one row per block, are then walked in order.
    """
    length = max(block_seconds or max(3600.0, 4 * cooldown), cooldown)
    marks = _marks(windows, ignored, threshold, consecutive, block_windows)
    home = F.floor(F.col("m.t") / length)
    lingers = F.col("m.ready") & (F.col("m.t") > (home + 1) * length - cooldown - 1e-6)
    placed = marks.select(
        "recording_id", "label", "m", home.alias("_home"),
        F.explode(F.when(lingers, F.array(home, home + 1)).otherwise(F.array(home))).alias("block"),
    )
    own = F.col("block") == F.col("_home")
    blocks = placed.groupBy("recording_id", "label", "block").agg(
        F.array_sort(F.collect_list(F.when(own, F.col("m")))).alias("rows"),
        F.collect_list(F.when(~own, F.col("m.t"))).alias("past"),
    ).where("size(rows) > 0")

    turns = F.filter("rows", lambda x: x.on | x.off)
    first_ready = F.array_min(F.transform(F.filter("rows", lambda x: x.ready), lambda x: x.t))
    cooling = let(first_ready, lambda t0: F.filter("past", lambda t: t0 - t + EPS < cooldown))
    tables = blocks.select(
        "recording_id", "label", "block", "rows",
        let(turns, lambda ts: F.when((F.size(ts) > 0) & F.get(ts, F.lit(0)).on, F.get(ts, F.lit(0)).t_before)).alias("first_on"),
        F.array_max(F.transform(F.filter("rows", lambda x: x.off), lambda x: x.t)).alias("last_off"),
        F.concat(F.array(F.lit(NEVER)), F.coalesce(F.array_distinct(cooling), F.array().cast("array<double>"))).alias("lasts"),
    )

    def leave(armed: Column, last: Column) -> Column:
        shape = "struct<armed:boolean,last:double,off:double,changed:boolean>"

        def merge(acc, x):
            now, emits = _step(acc, x, release, cooldown)
            return F.struct(
                (now & ~emits).alias("armed"), F.when(emits, x.t).otherwise(acc.last).alias("last"),
                F.when(x.off, x.t).otherwise(acc.off).alias("off"), (acc.changed | emits).alias("changed"),
            ).cast(shape)

        return F.aggregate("rows", F.struct(armed, last, F.lit(None), F.lit(False)).cast(shape), merge)

    outs = F.flatten(
        F.transform(F.array(F.lit(True), F.lit(False)), lambda a: F.transform("lasts", lambda last: leave(a, last)))
    )
    maps = tables.withColumn("outs", outs).select(
        "recording_id", "label", "block", "first_on", "last_off", "lasts",
        F.col("outs.armed").alias("out_armed"), F.col("outs.last").alias("out_last"), F.col("outs.changed").alias("out_changed"),
    )
    starts = fold_sorted(
        maps, ["recording_id", "label"], ["block"], ["block", "first_on", "last_off", "lasts", "out_armed", "out_last", "out_changed"],
        _carry(release), "block bigint, armed boolean, last double, off double",
    )

    emitted = "array<struct<idx:bigint,t:double,conf:double>>"
    shape = f"struct<armed:boolean,last:double,off:double,out:{emitted}>"

    def emit(acc, x):
        now, emits = _step(acc, x, release, cooldown)
        found = F.array(F.struct(x.idx.alias("idx"), x.t.alias("t"), x.conf.alias("conf")))
        return F.struct(
            (now & ~emits).alias("armed"), F.when(emits, x.t).otherwise(acc.last).alias("last"),
            F.when(x.off, x.t).otherwise(acc.off).alias("off"), F.when(emits, F.concat(acc.out, found)).otherwise(acc.out).alias("out"),
        ).cast(shape)

    begin = F.struct("armed", "last", "off", F.array().cast(emitted)).cast(shape)
    done = blocks.select("recording_id", "label", "block", "rows").join(starts, ["recording_id", "label", "block"])
    return done.select("recording_id", "label", F.inline(F.aggregate("rows", begin, emit, lambda acc: acc.out))).select(
        "recording_id", F.col("idx").alias("window_index"), "label", F.col("t").alias("time_seconds"), F.col("conf").alias("confidence")
    )


def number_detections(detections: DataFrame, block_seconds: float = 3600.0) -> DataFrame:
    """Adds detection_id, counted from 0 in time order per recording."""
    block = F.floor(F.col("time_seconds") / block_seconds)
    return numbered(detections, ["recording_id"], ["time_seconds", "window_index"], block, "detection_id")


def _greedy(state, kind, at, ident, end, until):
    """Each detection takes the open, unused event that ends first."""
    waiting = state.setdefault("waiting", [])
    if kind == 0:
        heapq.heappush(waiting, (end, ident, until))
        return ()
    while waiting and waiting[0][2] < at:
        heapq.heappop(waiting)
    if not waiting:
        return ()
    end, event_id, _ = heapq.heappop(waiting)
    return ((event_id, ident, at - end),)


def _stretches(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Items within reach of an event, with `stretch`: the event where their part of the matching starts.

    A stretch starts at an event that no earlier one reaches, or before which no
    event can be open and unused.  The latter is read from a queue that events
    enter and detections leave, and that nothing else leaves: it holds at least
    as many as are really open, so where it is empty none is.  Its length is the running
    sum of +1 and -1 above the sum's running minimum.

    Blocks are scanned on their own.  Of a block the others need only how far
    its events reach, its sum and its lowest prefix, and where its last stretch
    seems to start: by reach it really does when no earlier block reaches that
    far; by the queue, where its prefix is lowest, when that is low enough for
    the queue that the block began with.
    """
    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    step = F.when(F.col("kind") == 0, 1).otherwise(-1).cast("bigint")
    event = F.col("kind") == 0
    rows = items.withColumn("_local", F.max("until").over(earlier)).withColumn("_sum", F.coalesce(F.sum(step).over(earlier), F.lit(0)))
    rows = rows.withColumn("_least", F.min(F.col("_sum") + step).over(earlier))
    alone = event & (F.coalesce("_local", F.lit(NEVER)) < F.col("at"))
    low = event & (F.col("_sum") <= F.least(F.lit(0), F.col("_least")))
    rows = rows.withColumns({"_first": F.when(alone, F.col("at")), "_low": F.when(low, F.col("_sum"))})
    blocks = rows.groupBy(*keys, "_block").agg(
        F.max("until").alias("_top"), F.max("_first").alias("_start"), F.sum(step).alias("_total"), F.min(F.col("_sum") + step).alias("_depth"),
        F.min("_low").alias("_lowest"), F.max(F.when(low, F.col("at"))).alias("_low_at"),
    )
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.withColumn("_carry", F.coalesce(F.max("_top").over(before), F.lit(NEVER)))
    carried = carried.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    floor = F.least(F.lit(0), F.min(F.col("_base") + F.col("_depth")).over(before))
    carried = carried.withColumn("_queue", F.col("_base") - floor)
    by_reach = F.when(F.col("_start") > F.col("_carry"), F.col("_start"))
    by_queue = F.when(F.col("_lowest") + F.col("_queue") <= 0, F.col("_low_at"))
    carried = carried.withColumn("_start", F.greatest(by_reach, by_queue))
    carried = carried.select(*keys, "_block", "_carry", "_queue", F.last("_start", ignorenulls=True).over(before).alias("_open"))
    joined = rows.join(carried, [*keys, "_block"])
    starts = F.greatest(
        F.when(F.col("_first") > F.col("_carry"), F.col("_first")), F.when(F.col("_low") + F.col("_queue") <= 0, F.col("at"))
    )
    so_far = F.last(starts, ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0))
    joined = joined.withColumn("stretch", F.coalesce(so_far, "_open"))
    reached = (F.col("kind") == 0) | (F.greatest("_local", "_carry") >= F.col("at"))
    return joined.where(reached).drop("_block", "_local", "_sum", "_least", "_first", "_low", "_carry", "_queue", "_open")


def match_events(
    events: DataFrame, detections: DataFrame, early: float = 0.0, late: float = 1.0, block_seconds: float = 3600.0
) -> tuple[DataFrame, DataFrame]:
    """(events with detection_id, confidence, latency; detections with event_id, latency).

    In time order each detection takes, among the unmatched events of its
    recording and class with start-early <= t <= end+late, the one that ends
    first.  latency = t - end, negative inside the event.

    Matches never cross a moment that no event covers, or at which every event so
    far is used or over, so a recording falls apart into stretches, which are
    matched independently (`_stretches`).  Where events overlap without a gap
    and far outnumber the detections, a stretch is long and one task walks it, holding its open events.
    """
    at_event = F.col("start_seconds") - early
    items = events.select(
        "recording_id", "label", at_event.alias("at"), F.lit(0).alias("kind"), F.col("event_id").alias("id"),
        "end_seconds", (F.col("end_seconds") + late).alias("until"),
    ).unionByName(
        detections.select(
            "recording_id", "label", F.col("time_seconds").alias("at"), F.lit(1).alias("kind"), F.col("detection_id").alias("id")
        ),
        allowMissingColumns=True,
    )
    keys, order = ["recording_id", "label"], ["at", "kind", "id"]
    stretches = _stretches(items.withColumn("_block", F.floor(F.col("at") / block_seconds)), keys, order)
    pairs = fold_sorted(
        stretches, [*keys, "stretch"], order, ["kind", "at", "id", "end_seconds", "until"], _greedy,
        "event_id bigint, detection_id bigint, latency_seconds double",
    ).drop("stretch", "label")
    # The pairs are few and join to both sides; every reader would repeat the walk.
    pairs = materialize(pairs)
    confidence = detections.select("recording_id", "detection_id", "confidence")
    by_event = pairs.join(confidence, ["recording_id", "detection_id"])
    return (
        events.join(by_event, ["recording_id", "event_id"], "left"),
        detections.join(pairs, ["recording_id", "detection_id"], "left"),
    )


def summarize(events: DataFrame, detections: DataFrame, keys: list[str], durations: DataFrame) -> DataFrame:
    """Event metrics per `keys`, for every row of `durations` (the keys and duration_seconds).

    Undefined ratios and latencies are NULL.
    """
    def flags(df, is_event, hit):
        return df.select(*keys, F.lit(is_event).alias("_e"), F.lit(1 - is_event).alias("_d"), F.lit(hit).cast("int").alias("_tp") if isinstance(hit, int) else hit.cast("int").alias("_tp"))

    matched = F.col("event_id").isNotNull()
    both = flags(events, 1, 0).unionByName(flags(detections, 0, matched))
    sums = both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_e", "_d", "_tp")])
    latency = exact_quantiles(
        detections.where(matched), keys, "latency_seconds", {"median_latency_seconds": 0.5, "p95_latency_seconds": 0.95}
    )
    rows = durations.join(sums, keys, "left").join(latency, keys, "left")
    e, d, tp = (F.coalesce(c, F.lit(0)).cast("bigint") for c in ("_e", "_d", "_tp"))
    fp, fn = d - tp, e - tp
    return rows.select(
        *keys,
        e.alias("true_events"), d.alias("detections"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        F.try_divide(tp, d).alias("precision"),
        F.try_divide(tp, e).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (fp * 3600 / F.col("duration_seconds")).alias("unmatched_detections_per_hour"),
        "median_latency_seconds", "p95_latency_seconds", "duration_seconds",
    )


def event_metrics(events: DataFrame, detections: DataFrame, commands: list[str], durations: DataFrame) -> DataFrame:
    """Metrics per recording: all classes together (label 'all') and each command, also when it has no row."""
    def twice(df):
        return df.withColumn("label", F.explode(F.array(F.col("label"), F.lit("all"))))

    names = F.array(F.lit("all"), *map(F.lit, commands))
    grid = durations.select("recording_id", "duration_seconds", F.explode(names).alias("label"))
    return summarize(twice(events), twice(detections), ["recording_id", "label"], grid)


def latency_percentiles(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Exact median and 95th percentile of the matched latencies, per key."""
    probs = {"median_latency_seconds": 0.5, "p95_latency_seconds": 0.95}
    found = exact_quantiles(detections.where("event_id is not null"), keys, "latency_seconds", probs)
    return detections.select(*keys).distinct().join(found, keys, "left")


def negative_audio_rate(detections: DataFrame, durations: DataFrame) -> DataFrame:
    """False alarms per recording and hour where no command is spoken: every detection is one."""
    fp = detections.groupBy("recording_id").agg(F.count("*").alias("fp"))
    rows = durations.join(fp, "recording_id", "left").withColumn("fp", F.coalesce("fp", F.lit(0)))
    rate = F.col("fp") * 3600 / F.col("duration_seconds")
    return rows.select("recording_id", "fp", rate.alias("false_positives_per_hour"), F.lit(True).alias("provisional"))


def case_summary(events: DataFrame, detections: DataFrame, cases: DataFrame) -> DataFrame:
    """Event metrics per (case, model); `cases` gives each pair's duration_seconds."""
    return summarize(events, detections, ["case", "model"], cases)


def probability_timeline(
    windows: DataFrame, labels: DataFrame, events: DataFrame, detections: DataFrame, block_seconds: float = 3600.0
) -> DataFrame:
    """(recording, class, end, p) with whether an annotated event covers the moment, and the detection there."""
    named = F.array(*map(F.lit, label_names(labels)))
    long = windows.select(
        "recording_id", "window_index", "time_seconds", F.inline(F.arrays_zip(named.alias("label"), F.col("p").alias("p")))
    )
    spans = events.select(
        "recording_id", "label", F.col("start_seconds").alias("at"), F.lit(0).alias("kind"), F.col("event_id").alias("id"), "end_seconds"
    )
    points = long.select(
        "recording_id", "label", F.col("time_seconds").alias("at"), F.lit(1).alias("kind"), F.col("window_index").alias("id"), "p"
    )
    items = spans.unionByName(points, allowMissingColumns=True)
    block = F.floor(F.col("at") / block_seconds)
    seen = running(items, ["recording_id", "label"], ["at", "kind", "id"], block, {"_reach": ("max", F.col("end_seconds"))})
    rows = seen.where("kind = 1").select(
        "recording_id", "label", F.col("id").alias("window_index"), F.col("at").alias("time_seconds"), "p",
        F.coalesce(F.col("_reach") >= F.col("at"), F.lit(False)).alias("in_event"),
    )
    found = detections.select("recording_id", "label", "window_index", F.col("confidence").alias("detection_confidence"))
    return rows.join(found, ["recording_id", "label", "window_index"], "left")


def evaluate_continuous(
    windows: DataFrame, events: DataFrame | None, durations: DataFrame, commands: list[str],
    decoder: dict, early: float = 0.0, late: float = 1.0,
) -> dict[str, DataFrame]:
    """Decode, match and score.  Without annotations every detection is a false alarm, of its class and in all."""
    # The detections are few and feed several branches; the windows are read once.
    found = materialize(number_detections(decode_events(windows, **decoder)))
    if events is None:
        unmatched = found.withColumns({"event_id": F.lit(None).cast("bigint"), "latency_seconds": F.lit(None).cast("double")})
        metrics = event_metrics(found.select("recording_id", "label").where("false"), unmatched, commands, durations)
        rate = F.col("unmatched_detections_per_hour")
        return {"detections": found, "metrics": metrics.withColumns({"false_positives_per_hour": rate, "provisional": F.lit(True)})}
    matched_events, matched_detections = match_events(events, found, early, late)
    return {
        "detections": matched_detections,
        "events": matched_events,
        "metrics": event_metrics(matched_events, matched_detections, commands, durations),
    }
