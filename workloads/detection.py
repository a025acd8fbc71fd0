"""Event decoding, matching, metrics and annotation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirrup.functions.arrays import frame_to_seconds, seconds_to_frame
from chirrup.operators import checks, events, joins, regions
from chirrup.sources import annotations
from workloads import standins as v
from workloads.views_sql import sql

QUERIES, ORACLES = {}, {}
HOUR, DAY = 3600.0, 86400.0
COMMANDS = ["click", "error", "purchase"]
DECODER = {"ignored": ("signup", "view"), "threshold": 0.2, "consecutive": 2, "release": HOUR, "cooldown": DAY}
MATCH = {"early": HOUR, "late": 4 * HOUR, "block_seconds": DAY}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def r(column, digits=6):
    return F.round(column, digits) + F.lit(0.0)


@query(
    "eligible_pairs",
    sql(
        """SELECT d.recording_id, detection_id, event_id FROM v_dets d JOIN v_regions r
ON d.recording_id = r.recording_id AND d.label = r.label AND time_seconds BETWEEN start_seconds AND end_seconds + 3600.0""",
        "v_dets",
        "v_regions",
    ),
)
def eligible_pairs(spark, sf_dir):
    pairs = joins.eligible_pairs(v.detections(spark, sf_dir), v.regions(spark, sf_dir), 0.0, HOUR, DAY)
    return pairs.select("recording_id", "detection_id", "event_id")


# The state machine of one class, stepped window by window.
DECODE_STEPS = {
    "s": """SELECT recording_id, label, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS cnt, true AS armed, CAST(NULL AS DOUBLE) AS off,
  CAST('-Infinity' AS DOUBLE) AS last, CAST(NULL AS DOUBLE) AS t, CAST(NULL AS DOUBLE) AS conf, false AS emits
FROM (SELECT DISTINCT recording_id FROM v_windows), (SELECT unnest(['click', 'error', 'purchase']) AS label)
UNION ALL
SELECT recording_id, label, i, n, CASE WHEN emits THEN false ELSE arm END, noff, CASE WHEN emits THEN t ELSE last END, t, conf, emits FROM (
  SELECT *, active AND arm AND n >= 2 AND t - last + 1e-9 >= 86400.0 AS emits FROM (
    SELECT *, CASE WHEN active THEN cnt + 1 ELSE 0 END AS n, CASE WHEN active THEN NULL ELSE coalesce(off, t) END AS noff,
      armed OR (NOT active AND t - coalesce(off, t) + 1e-9 >= 3600.0) AS arm FROM (
      SELECT s.recording_id, s.label, w.window_index AS i, cnt, armed, off, last, w.time_seconds AS t, w.confidence AS conf,
        w.predicted_label = s.label AND w.confidence >= 0.2 AS active
      FROM s JOIN v_windows w ON w.recording_id = s.recording_id AND w.window_index = s.i + 1)))""",
    "found": """SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY i) - 1 AS detection_id, i AS window_index, label,
  t AS time_seconds, conf AS confidence FROM s WHERE emits""",
}


def detected(spark, sf_dir):
    return events.decode_events(v.windows(spark, sf_dir), **DECODER)


@query("decode_events", sql("SELECT recording_id, detection_id, window_index, label, time_seconds, confidence FROM found", "v_windows", **DECODE_STEPS))
def decode_events(spark, sf_dir):
    return events.number_detections(detected(spark, sf_dir), DAY)


def match_steps(dets, late=14400.0):
    return {
        "cand": f"""SELECT d.recording_id, d.label, d.detection_id, d.confidence, d.time_seconds,
  row_number() OVER (PARTITION BY d.recording_id, d.label ORDER BY d.time_seconds, d.detection_id) AS k,
  list(r.event_id ORDER BY r.end_seconds, r.event_id) FILTER (r.event_id IS NOT NULL) AS options
FROM {dets} d LEFT JOIN v_regions r ON d.recording_id = r.recording_id AND d.label = r.label
  AND d.time_seconds BETWEEN r.start_seconds - 3600.0 AND r.end_seconds + {late} GROUP BY 1, 2, 3, 4, 5""",
        "taken": """SELECT recording_id, label, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS detection_id,
  CAST(NULL AS BIGINT) AS event_id FROM (SELECT DISTINCT recording_id, label FROM cand)
UNION ALL
SELECT recording_id, label, k, CASE WHEN e IS NULL THEN used ELSE list_append(used, e) END, detection_id, e FROM (
  SELECT c.recording_id, c.label, c.k, t.used, c.detection_id, list_filter(c.options, lambda x: NOT list_contains(t.used, x))[1] AS e
  FROM taken t JOIN cand c ON c.recording_id = t.recording_id AND c.label = t.label AND c.k = t.k + 1)""",
        "md": f"""SELECT d.*, t.event_id, d.time_seconds - r.end_seconds AS latency_seconds FROM {dets} d
LEFT JOIN taken t ON t.recording_id = d.recording_id AND t.detection_id = d.detection_id AND t.k > 0
LEFT JOIN v_regions r ON r.recording_id = t.recording_id AND r.event_id = t.event_id""",
        "me": """SELECT r.*, d.detection_id, d.confidence, d.latency_seconds FROM v_regions r
LEFT JOIN md d ON d.recording_id = r.recording_id AND d.event_id = r.event_id""",
    }


def matched(spark, sf_dir, **changes):
    return events.match_events(v.regions(spark, sf_dir), v.detections(spark, sf_dir), **{**MATCH, **changes})


@query(
    "match_events",
    sql(
        """SELECT 'event' AS side, recording_id, event_id, detection_id, round(confidence, 6) AS confidence, round(latency_seconds, 6) + 0.0 AS latency_seconds FROM me
UNION ALL SELECT 'detection', recording_id, event_id, detection_id, round(confidence, 6), round(latency_seconds, 6) + 0.0 FROM md""",
        "v_regions",
        "v_dets",
        **match_steps("v_dets"),
    ),
)
def match_events(spark, sf_dir):
    e, d = matched(spark, sf_dir)
    columns = ("recording_id", "event_id", "detection_id", F.round("confidence", 6).alias("confidence"), r(F.col("latency_seconds")).alias("latency_seconds"))
    return e.select(F.lit("event").alias("side"), *columns).unionByName(d.select(F.lit("detection").alias("side"), *columns))


def metrics_sql(keys, grid, late_dets="md", late_events="me"):
    """Counts and exact quantiles per key over the matched rows."""
    on = " AND ".join(f"x.{k} = g.{k}" for k in keys)
    names = ", ".join(f"g.{k}" for k in keys)
    return f"""SELECT {names}, n AS true_events, m AS detections, tp, m - tp AS fp, n - tp AS fn,
  round(CASE WHEN m > 0 THEN tp / m END, 6) + 0.0 AS precision, round(CASE WHEN n > 0 THEN tp / n END, 6) + 0.0 AS recall,
  round(CASE WHEN n + m > 0 THEN 2 * tp / (n + m) END, 6) + 0.0 AS f1, round((m - tp) * 3600 / duration_seconds, 6) + 0.0 AS per_hour,
  round(q50, 9) + 0.0 AS median_latency_seconds, round(q95, 9) + 0.0 AS p95_latency_seconds
FROM (SELECT {names}, any_value(g.duration_seconds) AS duration_seconds, (SELECT count(*) FROM {late_events} x WHERE {on}) AS n,
  (SELECT count(*) FROM {late_dets} x WHERE {on}) AS m, (SELECT count(event_id) FROM {late_dets} x WHERE {on}) AS tp,
  (SELECT quantile_cont(latency_seconds, 0.5) FROM {late_dets} x WHERE {on}) AS q50,
  (SELECT quantile_cont(latency_seconds, 0.95) FROM {late_dets} x WHERE {on}) AS q95 FROM {grid} g GROUP BY {names}) g"""


def metric_columns(df, keys):
    rounded = {"precision": 6, "recall": 6, "f1": 6, "median_latency_seconds": 9, "p95_latency_seconds": 9}
    return df.select(
        *keys, "true_events", "detections", "tp", "fp", "fn", *[r(F.col(c), n).alias(c) for c, n in rounded.items()],
        r(F.col("unmatched_detections_per_hour")).alias("per_hour"),
    )


ALL_LABELS = ["click", "error", "purchase", "signup", "view"]


def both_levels(source):
    return f"SELECT * FROM {source} UNION ALL SELECT * REPLACE ('all' AS label) FROM {source}"


def grid_sql(names):
    listed = ", ".join(f"'{n}'" for n in ["all", *names])
    return f"SELECT recording_id, duration_seconds, unnest([{listed}]) AS label FROM v_durations"


@query(
    "event_metrics",
    sql(
        metrics_sql(["recording_id", "label"], "grid", "md2", "me2"),
        "v_regions",
        "v_dets",
        "v_durations",
        **match_steps("v_dets"),
        md2=both_levels("md"),
        me2=both_levels("me"),
        grid=grid_sql(ALL_LABELS),
    ),
)
def event_metrics(spark, sf_dir):
    e, d = matched(spark, sf_dir)
    out = events.event_metrics(e, d, ALL_LABELS, v.durations(spark, sf_dir))
    return metric_columns(out, ["recording_id", "label"])


@query(
    "latency_percentiles",
    sql(
        """SELECT label, round(quantile_cont(latency_seconds, 0.5), 9) + 0.0 AS median_latency_seconds,
  round(quantile_cont(latency_seconds, 0.95), 9) + 0.0 AS p95_latency_seconds FROM md GROUP BY 1""",
        "v_regions",
        "v_dets",
        **match_steps("v_dets"),
    ),
)
def latency_percentiles(spark, sf_dir):
    _, d = matched(spark, sf_dir)
    out = events.latency_percentiles(d, ["label"])
    return out.select("label", *[r(F.col(c), 9).alias(c) for c in ("median_latency_seconds", "p95_latency_seconds")])


CASE_STEPS = {
    **match_steps("v_dets"),
    **{k + "0": s.replace(" taken ", " taken0 ").replace(" cand ", " cand0 ").replace("FROM cand)", "FROM cand0)").replace(" md ", " md0 ") for k, s in match_steps("v_dets", 0.0).items()},
    "cd": "SELECT label AS \"case\", 'candidate' AS model, * FROM md UNION ALL SELECT label, 'baseline', * FROM md0",
    "ce": "SELECT label AS \"case\", 'candidate' AS model, * FROM me UNION ALL SELECT label, 'baseline', * FROM me0",
    "cases": """SELECT l.label AS "case", m AS model, sum(duration_seconds) AS duration_seconds FROM v_durations,
  (SELECT DISTINCT label FROM v_log) l, (SELECT unnest(['baseline', 'candidate']) AS m) GROUP BY 1, 2""",
}


@query(
    "case_summary",
    sql(metrics_sql(['"case"', "model"], "cases", "cd", "ce"), "v_log", "v_regions", "v_dets", "v_durations", **CASE_STEPS),
)
def case_summary(spark, sf_dir):
    sides = None
    for model, late in (("candidate", 4 * HOUR), ("baseline", 0.0)):
        part = [x.withColumn("model", F.lit(model)).withColumn("case", F.col("label")) for x in matched(spark, sf_dir, late=late)]
        sides = part if sides is None else [a.unionByName(b) for a, b in zip(sides, part)]
    total = v.durations(spark, sf_dir).agg(F.sum("duration_seconds").alias("duration_seconds"))
    models = F.explode(F.array(F.lit("baseline"), F.lit("candidate")))
    cases = total.select("duration_seconds", F.explode(F.array(*map(F.lit, ALL_LABELS))).alias("case")).select("*", models.alias("model"))
    return metric_columns(events.case_summary(*sides, cases), ["case", "model"])


@query(
    "negative_audio_rate",
    sql(
        """SELECT recording_id, count(d.detection_id) AS fp, round(count(d.detection_id) * 3600 / duration_seconds, 6) AS false_positives_per_hour,
  true AS provisional FROM v_durations LEFT JOIN v_dets d USING (recording_id) GROUP BY recording_id, duration_seconds""",
        "v_durations",
        "v_dets",
    ),
)
def negative_audio_rate(spark, sf_dir):
    out = events.negative_audio_rate(v.detections(spark, sf_dir), v.durations(spark, sf_dir))
    return out.withColumn("false_positives_per_hour", F.round("false_positives_per_hour", 6))


@query(
    "evaluate_continuous",
    sql(
        metrics_sql(["recording_id", "label"], "grid", "md2", "me2"),
        "v_windows",
        "v_regions",
        "v_durations",
        **DECODE_STEPS,
        **match_steps("found"),
        md2=both_levels("md"),
        me2=f"SELECT * FROM ({both_levels('me')}) WHERE label IN ('all', 'click', 'error', 'purchase')",
        grid=grid_sql(COMMANDS),
    ),
)
def evaluate_continuous(spark, sf_dir):
    out = events.evaluate_continuous(
        v.windows(spark, sf_dir), v.regions(spark, sf_dir), v.durations(spark, sf_dir), COMMANDS, DECODER, HOUR, 4 * HOUR
    )
    return metric_columns(out["metrics"], ["recording_id", "label"])


def probabilities(spark, sf_dir):
    """A class vector per window: its confidence for the event type, the rest shared evenly."""
    p = [F.when(F.col("predicted_label") == n, F.col("confidence")).otherwise((1 - F.col("confidence")) / 4) for n in ALL_LABELS]
    return v.windows(spark, sf_dir).withColumn("p", F.array(*p))


@query(
    "probability_timeline",
    sql(
        """SELECT w.recording_id, l.label, w.window_index, round(CASE WHEN predicted_label = l.label THEN w.confidence ELSE (1 - w.confidence) / 4 END, 6) + 0.0 AS p,
  EXISTS (SELECT 1 FROM v_regions r WHERE r.recording_id = w.recording_id AND r.label = l.label AND w.time_seconds BETWEEN r.start_seconds AND r.end_seconds) AS in_event,
  f.confidence AS detection_confidence
FROM v_windows w CROSS JOIN (SELECT DISTINCT label FROM v_log) l
LEFT JOIN found f ON f.recording_id = w.recording_id AND f.label = l.label AND f.window_index = w.window_index""",
        "v_windows",
        "v_regions",
        **DECODE_STEPS,
    ),
)
def probability_timeline(spark, sf_dir):
    names = v.table(spark, sf_dir, "events").select(F.col("event_type").alias("label")).distinct().withColumn("label_id", F.col("label"))
    out = events.probability_timeline(probabilities(spark, sf_dir), names, v.regions(spark, sf_dir), detected(spark, sf_dir), DAY)
    return out.select("recording_id", "label", "window_index", r(F.col("p")).alias("p"), "in_event", "detection_confidence")


@query(
    "annotation_order",
    sql(
        "SELECT recording_id, start_seconds, end_seconds, label, row_number() OVER (PARTITION BY recording_id ORDER BY start_seconds, end_seconds, label) - 1 AS event_id FROM v_regions",
        "v_regions",
    ),
)
def annotation_order(spark, sf_dir):
    return regions.annotation_order(v.regions(spark, sf_dir).drop("event_id"), DAY).select("recording_id", "start_seconds", "end_seconds", "label", "event_id")


REGION_SQL = {
    "keys": """SELECT recording_id, CAST(floor(time_seconds * 16000) AS BIGINT) AS frame, event_id, label AS key FROM v_log WHERE label <> 'error'""",
    "built": """SELECT * FROM (SELECT recording_id, key AS label, frame AS start_frame,
  coalesce(lead(frame) OVER (PARTITION BY recording_id ORDER BY frame, event_id), total) AS end_frame FROM keys JOIN totals USING (recording_id))
WHERE label <> 'view' AND end_frame > start_frame""",
}
TOTALS_SQL = "SELECT recording_id, CAST(max(floor(time_seconds * 16000)) AS BIGINT) + 960000 AS total FROM v_log GROUP BY 1"


def built_regions(spark, sf_dir):
    log = v.event_log(spark, sf_dir).withColumn("frame", F.floor(F.col("time_seconds") * 16000).cast("bigint"))
    totals = log.groupBy("recording_id").agg((F.max("frame") + 960000).alias("frames"))
    keys = log.select("recording_id", "frame", F.col("event_id").alias("seq"), F.col("label").alias("key"))
    commands = {"click": "click", "purchase": "purchase", "signup": "signup"}
    return regions.build_regions(keys, commands, "view", totals, 16000 * 86400), totals


@query("build_regions", sql("SELECT recording_id, label, start_frame, end_frame FROM built", "v_log", totals=TOTALS_SQL, **REGION_SQL))
def build_regions(spark, sf_dir):
    return built_regions(spark, sf_dir)[0]


@query(
    "frame_time",
    sql(
        """SELECT recording_id, start_frame, start_frame / 16000 AS seconds, CAST(round_even(start_frame / 16000 * 8000, 0) AS BIGINT) AS frame_8k FROM built""",
        "v_log",
        totals=TOTALS_SQL,
        **REGION_SQL,
    ),
)
def frame_time(spark, sf_dir):
    built = built_regions(spark, sf_dir)[0]
    seconds = frame_to_seconds(F.col("start_frame"), 16000)
    return built.select("recording_id", "start_frame", seconds.alias("seconds"), seconds_to_frame(seconds, 8000).alias("frame_8k"))


@query(
    "export_label_tsv",
    sql(
        r"SELECT recording_id, printf('%.6f', start_frame / 16000) || chr(9) || printf('%.6f', end_frame / 16000) || chr(9) || label AS line FROM built",
        "v_log",
        totals=TOTALS_SQL,
        **REGION_SQL,
    ),
)
def export_label_tsv(spark, sf_dir):
    built = built_regions(spark, sf_dir)[0]
    line = annotations.label_line(F.col("start_frame"), F.col("end_frame"), F.lit(16000), F.col("label"))
    return built.select("recording_id", line.alias("line"))


LINE_SQL = """SELECT recording_id, event_id, label, CASE WHEN k < 3 THEN time_seconds + 9.0 ELSE time_seconds END AS s,
  time_seconds + k / 20000 AS e, k, CASE WHEN k % 25 = 1 THEN 2 ELSE 3 END AS fields, total FROM v_log JOIN totals USING (recording_id)"""


@query(
    "import_label_tsv",
    sql(
        """SELECT recording_id, label, start_frame, end_frame, reason FROM (
  SELECT recording_id, event_id, label, CASE WHEN fields <> 3 THEN 'fields' WHEN NOT (0 <= s AND s < e AND e <= total / 16000 + 1e-6) THEN 'interval'
    WHEN label = 'error' THEN 'unknown_label' WHEN a >= b THEN 'shorter_than_a_frame' END AS reason,
    CASE WHEN reason IS NULL THEN a END AS start_frame, CASE WHEN reason IS NULL THEN b END AS end_frame FROM (
    SELECT *, CAST(round_even(s * 16000, 0) AS BIGINT) AS a, least(total, CAST(round_even(e * 16000, 0) AS BIGINT)) AS b FROM lines))""",
        "v_log",
        totals=TOTALS_SQL,
        lines=LINE_SQL,
    ),
)
def import_label_tsv(spark, sf_dir):
    log = v.event_log(spark, sf_dir)
    frames = log.groupBy("recording_id").agg((F.max(F.floor(F.col("time_seconds") * 16000)).cast("bigint") + 960000).alias("frames"))
    s = F.when(F.col("k") < 3, F.col("time_seconds") + 9.0).otherwise(F.col("time_seconds"))
    e = F.col("time_seconds") + F.col("k") / 20000
    full = F.concat_ws("\t", s.cast("string"), e.cast("string"), F.col("label"))
    value = F.when(F.col("k") % 25 == 1, F.concat_ws("\t", s.cast("string"), F.col("label"))).otherwise(full)
    names = log.select("label").where("label <> 'error'").distinct()
    lines = log.select("recording_id", "label", value.alias("value"))
    good, bad = annotations.parse_label_lines(lines.drop("label"), frames.withColumn("sample_rate", F.lit(16000)), names)
    no = F.lit(None).cast("bigint")
    kind = F.element_at(F.split("value", "\t"), -1)
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(
        bad.select("recording_id", kind.alias("label"), no.alias("start_frame"), no.alias("end_frame"), "reason")
    )


# One annotation file per recording and week, with some drafts, errors and clock mismatches.
DOC_SQL = {
    "docs": """SELECT recording_id * 1000 + CAST(floor(start_seconds / 604800) AS BIGINT) AS rec, label,
  CAST(floor((start_seconds - floor(start_seconds / 604800) * 604800) * 100) AS BIGINT) AS a, start_seconds FROM v_regions""",
    "judged": """SELECT *, a + 2160000 AS b, CASE WHEN rec % 5 = 1 THEN 'status' WHEN rec % 7 = 2 THEN 'capture_error' WHEN rec % 11 = 3 THEN 'clock_mismatch'
  WHEN bool_or(label = 'view' AND a % 50 = 7) OVER (PARTITION BY rec) THEN 'bad_region' END AS reason FROM docs""",
}


@query(
    "load_annotations",
    sql(
        """SELECT rec AS recording_id, row_number() OVER (PARTITION BY rec ORDER BY a, b, label) - 1 AS event_id, label, a / 100 AS start_seconds, b / 100 AS end_seconds, NULL AS reason
FROM judged WHERE reason IS NULL UNION ALL SELECT DISTINCT rec, NULL, NULL, NULL, NULL, reason FROM judged WHERE reason IS NOT NULL""",
        "v_regions",
        **DOC_SQL,
    ),
)
def load_annotations(spark, sf_dir):
    week = F.floor(F.col("start_seconds") / 604800)
    rec = F.col("recording_id") * 1000 + week
    a = F.floor((F.col("start_seconds") - week * 604800) * 100).cast("bigint")
    rows = v.regions(spark, sf_dir).select(rec.alias("rec"), a.alias("start_frame"), (a + 2160000).alias("end_frame"), "label")
    odd = (F.col("label") == "view") & (F.col("start_frame") % 50 == 7)
    region = F.struct(F.when(odd, "noise").otherwise(F.col("label")).alias("label"), "start_frame", "end_frame")
    text = rows.groupBy("rec").agg(F.collect_list(region).alias("regions")).select(
        F.to_json(F.struct(
            F.concat("rec", F.lit(".wav")).alias("wav"),
            F.lit(100).alias("sample_rate"),
            F.when(F.col("rec") % 11 == 3, 1).otherwise(62640000).alias("frames"),
            F.when(F.col("rec") % 5 == 1, "draft").otherwise("reviewed").alias("annotation_status"),
            F.when(F.col("rec") % 7 == 2, "overflow").alias("error"),
            "regions",
        )).alias("value")
    )
    documents = text.select(F.from_json("value", annotations.ANNOTATION).alias("d")).select("d.*")
    recordings = rows.select("rec").distinct().select(
        F.col("rec").alias("recording_id"), F.concat("rec", F.lit(".wav")).alias("wav"), F.lit(100).alias("sample_rate"), F.lit(62640000).alias("frames")
    )
    found, faults = annotations.check_annotations(documents, recordings, ALL_LABELS)
    return found.select("recording_id", "event_id", "label", "start_seconds", "end_seconds", F.lit(None).cast("string").alias("reason")).unionByName(
        faults.select("recording_id", "reason"), allowMissingColumns=True
    )


@query(
    "capture_error_guard",
    sql(
        "SELECT recording_id, recording_id NOT IN (SELECT recording_id FROM v_log WHERE label = 'error' AND confidence > 0.9) AS usable FROM v_durations",
        "v_log",
        "v_durations",
    ),
)
def capture_error_guard(spark, sf_dir):
    log = v.event_log(spark, sf_dir)
    sidecars = log.select("recording_id", F.when((F.col("label") == "error") & (F.col("confidence") > 0.9), "overflow").alias("error"))
    return checks.capture_error_guard(v.durations(spark, sf_dir).select("recording_id"), sidecars)
