"""Clip scoring, metrics and model comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirrup.functions.arrays import log_softmax, softmax, top1
from chirrup.operators import checks, joins, metrics, training
from chirrup.plans import evaluate, scoring
from workloads import standins as v
from workloads.views_sql import sql

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def r(column, digits=6):
    return F.round(column, digits) + F.lit(0.0)


def scorer(spark, sf_dir, power):
    clips = v.clips(spark, sf_dir)
    model = scoring.centroid_scorer(scoring.fit_centroids(clips), power)
    classes = 10
    return lambda df: scoring.score_clips(df, model, classes)


def scored(spark, sf_dir, power=2):
    """Logits per class: negative distance, squared or plain, to each class's mean vector."""
    rows = v.clips(spark, sf_dir).withColumn("record_index", F.col("clip_id")).withColumn(
        "path", F.concat(F.lit("clips/"), "clip_id")
    )
    return scorer(spark, sf_dir, power)(rows)


def predicted(spark, sf_dir, power=2, smoothing=0.1):
    return metrics.predictions(scored(spark, sf_dir, power), v.class_map(spark, sf_dir), smoothing=smoothing)


SCORES = {
    "elem": "SELECT clip_id, label_id, unnest(samples) AS x, unnest(range(1, len(samples) + 1)) AS pos FROM v_clips",
    "cent": "SELECT label_id AS class_id, pos, avg(x) AS c FROM elem GROUP BY 1, 2",
    "dist": """SELECT clip_id, label_id, class_id, -sum(abs(x - c)) AS a, -sum((x - c) * (x - c)) AS b
FROM elem JOIN cent USING (pos) GROUP BY 1, 2, 3""",
    "prob": """SELECT *, a - max(a) OVER w - ln(sum(exp(a - ma)) OVER w) AS la, b - max(b) OVER w - ln(sum(exp(b - mb)) OVER w) AS lb
FROM (SELECT *, max(a) OVER (PARTITION BY clip_id) AS ma, max(b) OVER (PARTITION BY clip_id) AS mb FROM dist)
WINDOW w AS (PARTITION BY clip_id)""",
    "pred": """SELECT clip_id, label_id AS true_id, arg_max(class_id, la) AS pa, arg_max(class_id, lb) AS pb,
  exp(max(la)) AS ca, exp(max(lb)) AS cb,
  -0.9 * max(la) FILTER (class_id = label_id) - 0.1 * avg(la) AS loss_a,
  -0.9 * max(lb) FILTER (class_id = label_id) - 0.1 * avg(lb) AS loss_b,
  exp(max(lb) FILTER (class_id = label_id)) AS true_b
FROM prob GROUP BY 1, 2""",
}
CONFUSION = {
    **SCORES,
    "conf": """SELECT t.label_id AS true_id, p.label_id AS predicted_id, count(pred.clip_id) AS n
FROM v_classes t CROSS JOIN v_classes p LEFT JOIN pred ON pred.true_id = t.label_id AND pred.pb = p.label_id GROUP BY 1, 2""",
}
CLASSES = {
    **CONFUSION,
    "cls": """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM (
  SELECT label_id, label, tp, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
    CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM (
    SELECT c.label_id, c.label, (SELECT sum(n) FROM conf WHERE true_id = c.label_id AND predicted_id = c.label_id) AS tp,
      (SELECT sum(n) FROM conf WHERE true_id = c.label_id) AS support, (SELECT sum(n) FROM conf WHERE predicted_id = c.label_id) AS predicted
    FROM v_classes c))""",
}


@query(
    "softmax",
    sql("SELECT clip_id, class_id, round(lb, 6) + 0.0 AS log_p, round(exp(lb), 6) + 0.0 AS p FROM prob", "v_clips", **SCORES),
)
def softmax_query(spark, sf_dir):
    s = scored(spark, sf_dir)
    both = s.select("clip_id", F.posexplode(F.arrays_zip(log_softmax(F.col("scores")).alias("l"), softmax(F.col("scores")).alias("p"))).alias("class_id", "z"))
    return both.select("clip_id", F.col("class_id").cast("bigint").alias("class_id"), r(F.col("z.l")).alias("log_p"), r(F.col("z.p")).alias("p"))


@query(
    "top1",
    sql(
        """SELECT clip_id, true_id = pb AS correct, pb AS predicted_id, round(cb, 6) + 0.0 AS confidence FROM pred""",
        "v_clips",
        **SCORES,
    ),
)
def top1_query(spark, sf_dir):
    s = metrics.with_probabilities(scored(spark, sf_dir))
    best = s.withColumn("predicted_id", top1(F.col("p")))
    return best.select("clip_id", (F.col("label_id") == F.col("predicted_id")).alias("correct"), "predicted_id", r(F.array_max("p")).alias("confidence"))


@query(
    "check_scores",
    sql(
        """SELECT clip_id, CASE WHEN min(q) < 0 OR max(q) > 1 THEN 'range' WHEN abs(sum(q) - 1) > 0.02 + 1e-5 THEN 'sum' END AS fault
FROM (SELECT clip_id, class_id, exp(lb) * (1 + (clip_id % 7 - 3) * 0.009) - CASE WHEN clip_id % 19 = 5 THEN 0.2 ELSE 0 END AS q FROM prob)
GROUP BY 1""",
        "v_clips",
        **SCORES,
    ),
)
def check_scores(spark, sf_dir):
    s = metrics.with_probabilities(scored(spark, sf_dir))
    shift = F.when(F.col("clip_id") % 19 == 5, 0.2).otherwise(0.0)
    bent = s.withColumn("q", F.transform("p", lambda x: x * (1 + (F.col("clip_id") % 7 - 3) * 0.009) - shift))
    return checks.check_scores(bent, 10, "probabilities", "q").select("clip_id", "fault")


@query(
    "smoothed_loss",
    sql("SELECT clip_id, round(loss_b, 6) + 0.0 AS loss FROM pred", "v_clips", **SCORES),
)
def smoothed_loss(spark, sf_dir):
    return predicted(spark, sf_dir).select(F.col("record_index").alias("clip_id"), r(F.col("loss")).alias("loss"))


@query("confusion_matrix", sql("SELECT true_id, predicted_id, n FROM conf", "v_clips", "v_classes", **CONFUSION))
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(predicted(spark, sf_dir), v.class_map(spark, sf_dir))


@query(
    "classification_metrics",
    sql(
        """SELECT label, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1,
  CAST(support AS BIGINT) AS support, NULL AS accuracy, NULL AS macro_f1 FROM cls
UNION ALL SELECT NULL, NULL, NULL, NULL, CAST(sum(support) AS BIGINT), round(sum(tp) / sum(support), 6) + 0.0, round(avg(f1), 6) + 0.0 FROM cls""",
        "v_clips",
        "v_classes",
        **CLASSES,
    ),
)
def classification_metrics(spark, sf_dir):
    labels = v.class_map(spark, sf_dir)
    classes, overall = metrics.classification_metrics(metrics.confusion_matrix(predicted(spark, sf_dir), labels), labels)
    rows = classes.select("label", *[r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")
    total = overall.select(F.col("count").alias("support"), *[r(F.col(c)).alias(c) for c in ("accuracy", "macro_f1")])
    return rows.unionByName(total, allowMissingColumns=True)


REPORT_SQL = """SELECT label, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1, CAST(support AS BIGINT) AS support FROM (
  SELECT label, precision, recall, f1, support FROM cls
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM cls
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM cls)"""


@query("classification_report", sql(REPORT_SQL, "v_clips", "v_classes", **CLASSES))
def classification_report(spark, sf_dir):
    labels = v.class_map(spark, sf_dir)
    report = metrics.classification_report(metrics.confusion_matrix(predicted(spark, sf_dir), labels), labels)
    return report.select("label", *[r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "supported_macro_f1",
    sql("SELECT round(avg(f1) FILTER (support > 0), 6) + 0.0 AS supported_macro_f1 FROM cls", "v_clips", "v_classes", **CLASSES),
)
def supported_macro_f1(spark, sf_dir):
    labels = v.class_map(spark, sf_dir)
    classes = metrics.class_metrics(metrics.confusion_matrix(predicted(spark, sf_dir), labels), labels)
    return metrics.supported_macro_f1(classes).select(r(F.col("supported_macro_f1")).alias("supported_macro_f1"))


@query(
    "pair_predictions",
    sql(
        """SELECT clip_id AS record_index, 'clips/' || CAST(clip_id AS VARCHAR) AS path, 'class_' || CAST(true_id AS VARCHAR) AS true_label,
  'class_' || CAST(pa AS VARCHAR) AS old_prediction, 'class_' || CAST(pb AS VARCHAR) AS new_prediction,
  CAST(pa = true_id AS INTEGER) AS old_correct, CAST(pb = true_id AS INTEGER) AS new_correct,
  round(ca, 6) + 0.0 AS old_confidence, round(cb, 6) + 0.0 AS new_confidence, true AS aligned FROM pred""",
        "v_clips",
        **SCORES,
    ),
)
def pair_predictions(spark, sf_dir):
    out = joins.pair_predictions(predicted(spark, sf_dir, 1), predicted(spark, sf_dir))
    return out.withColumns({c: r(F.col(c)) for c in ("old_confidence", "new_confidence")})


COMPARISON_SQL = """SELECT label, count, round(o / count, 6) + 0.0 AS old_accuracy, round(n / count, 6) + 0.0 AS new_accuracy,
  round((n - o) / count, 6) + 0.0 AS delta_accuracy, CAST(improved AS BIGINT) AS improved, CAST(regressed AS BIGINT) AS regressed FROM (
  SELECT coalesce('class_' || CAST(true_id AS VARCHAR), 'all') AS label, count(*) AS count, count(*) FILTER (pa = true_id) AS o,
    count(*) FILTER (pb = true_id) AS n, count(*) FILTER (pa <> true_id AND pb = true_id) AS improved,
    count(*) FILTER (pa = true_id AND pb <> true_id) AS regressed FROM pred GROUP BY GROUPING SETS ((), (true_id)))"""


def rounded_comparison(df):
    return df.select("label", "count", *[r(F.col(c)).alias(c) for c in ("old_accuracy", "new_accuracy", "delta_accuracy")], "improved", "regressed")


@query("paired_comparison", sql(COMPARISON_SQL, "v_clips", **SCORES))
def paired_comparison(spark, sf_dir):
    paired = joins.pair_predictions(predicted(spark, sf_dir, 1), predicted(spark, sf_dir))
    return rounded_comparison(metrics.paired_comparison(paired, v.class_map(spark, sf_dir)))


@query(
    "same_clips_guard",
    sql(
        """SELECT 'old' AS side, clip_id, k FROM (SELECT clip_id, pa AS k FROM pred EXCEPT ALL SELECT clip_id, pb FROM pred)
UNION ALL SELECT 'new', clip_id, k FROM (SELECT clip_id, pb AS k FROM pred EXCEPT ALL SELECT clip_id, pa FROM pred)""",
        "v_clips",
        **SCORES,
    ),
)
def same_clips_guard(spark, sf_dir):
    sides = [
        predicted(spark, sf_dir, power).select(F.col("record_index").alias("clip_id"), F.col("predicted_id").alias("k")) for power in (1, 2)
    ]
    return joins.same_clips_guard(*sides).select("side", "clip_id", "k")


@query(
    "skipped_set_difference",
    """SELECT 'old' AS side, doc_id FROM (SELECT doc_id FROM documents WHERE n_chars > 3000 EXCEPT ALL SELECT doc_id FROM labels WHERE quality = 0)
UNION ALL SELECT 'new', doc_id FROM (SELECT doc_id FROM labels WHERE quality = 0 EXCEPT ALL SELECT doc_id FROM documents WHERE n_chars > 3000)""",
)
def skipped_set_difference(spark, sf_dir):
    long = v.table(spark, sf_dir, "documents").where("n_chars > 3000").select("doc_id")
    poor = v.table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    return joins.skipped_set_difference(long, poor).select("side", "doc_id")


@query(
    "length_action_counts",
    sql(
        """SELECT CASE WHEN frames < 3000 THEN 'padded' WHEN frames = 3000 THEN 'unchanged' WHEN label IN ('fr', 'de') THEN 'cropped' ELSE 'skipped_long' END AS action, count(*) AS n
FROM v_manifest GROUP BY 1 UNION ALL SELECT 'resampled', count(*) FROM v_manifest WHERE engine = 'tts'""",
        "v_manifest",
    ),
)
def length_action_counts(spark, sf_dir):
    m = v.manifest(spark, sf_dir)
    action = (
        F.when(F.col("frames") < 3000, "padded")
        .when(F.col("frames") == 3000, "unchanged")
        .when(F.col("label").isin("fr", "de"), "cropped")
        .otherwise("skipped_long")
    )
    return metrics.length_action_counts(m.select(action.alias("length_action"), F.col("engine").eqNullSafe("tts").alias("resampled")))


@query(
    "weighted_epoch_metrics",
    """SELECT l_returnflag AS run, CAST(l_linenumber AS BIGINT) AS epoch, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS loss,
  round(sum(floor(l_quantity * (1 - l_discount))) / sum(l_quantity), 6) AS accuracy, CAST(sum(l_quantity) AS BIGINT) AS count
FROM lineitem GROUP BY 1, 2""",
)
def weighted_epoch_metrics(spark, sf_dir):
    li = v.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("run"),
        F.col("l_linenumber").cast("bigint").alias("epoch"),
        F.col("l_extendedprice").alias("loss"),
        F.col("l_quantity").alias("size"),
        F.floor(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("correct"),
    )
    out = training.weighted_epoch_metrics(li, ["run", "epoch"])
    return out.select("run", "epoch", F.round("loss", 4).alias("loss"), F.round("accuracy", 6).alias("accuracy"), "count")


BEST_EPOCH_SQL = """SELECT run, max(epoch) FILTER (improved) AS best_epoch, min(val_loss) AS best_val_loss, max(epoch) AS last_epoch,
  max(stop) IS NOT NULL AS stopped_early FROM (
  SELECT *, min(CASE WHEN stale >= 4 THEN i END) OVER (PARTITION BY run) AS stop FROM s) WHERE stop IS NULL OR i <= stop GROUP BY 1"""


@query(
    "best_epoch_early_stop",
    sql(
        BEST_EPOCH_SQL,
        "v_history",
        h="SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM v_history",
        s="""SELECT run, epoch, val_loss, i, val_loss AS best, 0 AS stale, true AS improved FROM h WHERE i = 1
UNION ALL SELECT h.run, h.epoch, h.val_loss, h.i, least(s.best, h.val_loss), CASE WHEN h.val_loss < s.best THEN 0 ELSE s.stale + 1 END,
  h.val_loss < s.best FROM s JOIN h ON h.run = s.run AND h.i = s.i + 1""",
    ),
)
def best_epoch_early_stop(spark, sf_dir):
    return training.best_epoch_early_stop(v.history(spark, sf_dir), 4)


@query(
    "score_clips",
    sql("SELECT clip_id, class_id, round(b, 6) + 0.0 AS score FROM dist", "v_clips", **SCORES),
)
def score_clips(spark, sf_dir):
    s = scored(spark, sf_dir).select("clip_id", F.posexplode("scores").alias("class_id", "score"))
    return s.select("clip_id", F.col("class_id").cast("bigint").alias("class_id"), r(F.col("score")).alias("score"))


@query(
    "evaluate_clips",
    sql(
        f"""SELECT 'report' AS part, label AS name, precision AS a, recall AS b, f1 AS c, support AS n FROM ({REPORT_SQL})
UNION ALL SELECT 'summary', 'evaluated', round(avg(CAST(pb = true_id AS INTEGER)), 6) + 0.0, round(avg(loss_b), 6) + 0.0, NULL, count(*) FROM pred
UNION ALL SELECT 'action', 'unchanged', NULL, NULL, NULL, count(*) FROM v_clips""",
        "v_clips",
        "v_classes",
        **CLASSES,
    ),
)
def evaluate_clips(spark, sf_dir):
    clips = v.clips(spark, sf_dir).select(
        F.col("clip_id").alias("record_index"), F.concat(F.lit("clips/"), "clip_id").alias("path"), "label", "samples", F.lit(False).alias("resampled")
    )
    out = evaluate.evaluate_clips(clips, v.class_map(spark, sf_dir), scorer(spark, sf_dir, 2), 64)
    none = F.lit(None).cast("double")
    report = out["report"].select(
        F.lit("report").alias("part"), F.col("label").alias("name"), r(F.col("precision")).alias("a"), r(F.col("recall")).alias("b"), r(F.col("f1")).alias("c"), F.col("support").alias("n")
    )
    summary = out["summary"].select(F.lit("summary"), F.lit("evaluated"), r(F.col("accuracy")), r(F.col("loss")), none, "evaluated")
    actions = out["actions"].select(F.lit("action"), "action", none, none, none, "n")
    return report.union(summary).union(actions)


@query(
    "compare_models",
    sql(
        f"""SELECT label AS name, count, old_accuracy, new_accuracy, delta_accuracy, improved, regressed FROM ({COMPARISON_SQL})
UNION ALL SELECT 'supported_macro_f1', NULL, round(avg(fa), 6) + 0.0, round(avg(fb), 6) + 0.0, NULL, NULL, NULL FROM (
  SELECT 2.0 * count(*) FILTER (true_id = k AND pa = k) / (count(*) FILTER (true_id = k) + count(*) FILTER (pa = k)) AS fa,
    2.0 * count(*) FILTER (true_id = k AND pb = k) / (count(*) FILTER (true_id = k) + count(*) FILTER (pb = k)) AS fb
  FROM pred, (SELECT DISTINCT label_id AS k FROM v_clips) GROUP BY k)""",
        "v_clips",
        **SCORES,
    ),
)
def compare_models(spark, sf_dir):
    out = evaluate.compare_models(predicted(spark, sf_dir, 1, 0.0), predicted(spark, sf_dir, 2, 0.0), v.class_map(spark, sf_dir))
    by_class = rounded_comparison(out["by_class"]).withColumnRenamed("label", "name")
    f1 = r(F.col("supported_macro_f1"))
    macro = out["supported_macro_f1"].agg(
        F.max(F.when(F.col("model") == "old", f1)).alias("old_accuracy"), F.max(F.when(F.col("model") == "new", f1)).alias("new_accuracy")
    )
    return by_class.unionByName(macro.withColumn("name", F.lit("supported_macro_f1")), allowMissingColumns=True)
