"""Manifest, curation and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirrup.functions.rand import unit
from chirrup.operators import checks, curation, joins, training
from chirrup.plans import validate
from chirrup.sources import manifests
from workloads import standins as v
from workloads.views_sql import sql, u

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def background_list(spark, sf_dir):
    """Background sources: the graded documents, named like the manifest's parents."""
    grades = v.table(spark, sf_dir, "labels")
    return grades.groupBy(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 10)).alias("id")).agg(
        (F.max("toxic") == 0).alias("use_for_mixing")
    )


BACKGROUND_SQL = "SELECT 'p' || CAST(doc_id // 10 AS VARCHAR) AS id, max(toxic) = 0 AS use_for_mixing FROM labels GROUP BY 1"
ENTITY = "src3"


def with_entity(m):
    return m.withColumn("evaluation_group", F.lit(None).cast("string")).withColumn("speaker", F.upper("speaker_group"))


@query("load_labels", sql("SELECT label, CAST(label_id AS BIGINT) AS label_id FROM v_labels", "v_labels"))
def load_labels(spark, sf_dir):
    names = v.label_map(spark, sf_dir)
    text = names.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("label", "label_id")))).alias("value"))
    labels = manifests.parse_labels(text)
    manifests.require_none(manifests.label_faults(labels), "bad label map")
    return labels


def manifest_lines(spark, sf_dir):
    m = v.manifest(spark, sf_dir)
    text = F.to_json(F.struct("path", "label", "split", "id", "sha256", "speaker_group", "parent_id", "use_for_mixing"))
    first = F.col("record_index") == 0
    padded = F.array(F.when(first, F.concat(F.lit("﻿"), text)).otherwise(text), F.lit("  "))
    return m.select(F.col("split").alias("file_split"), F.explode(padded).alias("value"))


@query(
    "load_manifest",
    sql(
        "SELECT path, label, split, id, sha256, speaker_group, parent_id, use_for_mixing FROM v_manifest",
        "v_manifest",
    ),
)
def load_manifest(spark, sf_dir):
    rows = manifests.parse_manifest(manifest_lines(spark, sf_dir))
    return rows.select("path", "label", "split", "id", "sha256", "speaker_group", "parent_id", "use_for_mixing")


PAGE_PATH_SQL = r"""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN '../' || p WHEN 1 THEN 'a/../../' || p WHEN 2 THEN './' || replace(p, '/', chr(92))
  WHEN 3 THEN '/' || p ELSE p || '/..//' || p END AS path
FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?]+/?([^?]*)', 1) AS p FROM pages)"""


@query(
    "path_inside_root",
    sql(
        """SELECT page_id, path,
  NOT starts_with(path, '/') AND len(steps) > 0 AND list_sum(steps) > 0
  AND list_min(list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i]))) >= 0 AS inside_root
FROM s""",
        p=PAGE_PATH_SQL,
        s="""SELECT page_id, path, list_transform(
  list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda x: x <> '' AND x <> '.'),
  lambda x: CASE WHEN x = '..' THEN -1 ELSE 1 END) AS steps FROM p""",
    ),
)
def path_inside_root(spark, sf_dir):
    pages = v.table(spark, sf_dir, "pages")
    p = F.regexp_extract("url", r"^https?://[^/?]+/?([^?]*)", 1)
    i = F.col("page_id") % 5
    path = (
        F.when(i == 0, F.concat(F.lit("../"), p))
        .when(i == 1, F.concat(F.lit("a/../../"), p))
        .when(i == 2, F.concat(F.lit("./"), F.translate(p, "/", "\\")))
        .when(i == 3, F.concat(F.lit("/"), p))
        .otherwise(F.concat(p, F.lit("/..//"), p))
    )
    return checks.path_inside_root(pages.select("page_id", path.alias("path"))).select("page_id", "path", "inside_root")


@query(
    "check_membership",
    sql(
        """SELECT record_index, reason FROM (SELECT record_index, CASE WHEN label NOT IN ('de', 'en', 'fr') THEN 'unknown_label'
  WHEN declared <> split THEN 'wrong_split' END AS reason FROM m) WHERE reason IS NOT NULL""",
        "v_manifest",
        m="SELECT *, CASE WHEN use_for_mixing THEN split WHEN NOT use_for_mixing THEN 'train' END AS declared FROM v_manifest",
    ),
)
def check_membership(spark, sf_dir):
    m = v.manifest(spark, sf_dir)
    declared = F.when(F.col("use_for_mixing"), F.col("split")).when(~F.col("use_for_mixing"), "train")
    known = v.label_map(spark, sf_dir).where("label in ('de', 'en', 'fr')")
    return checks.check_membership(m.withColumn("declared_split", declared), known).select("record_index", "reason")


@query(
    "derive_record_id",
    sql(
        """SELECT record_index, record_id, regexp_full_match(record_id, '[A-Za-z0-9_-]+') AS safe_id FROM (
  SELECT record_index, coalesce(nullif(given, ''), 'voice_' || substr(sha256(path), 1, 24)) AS record_id FROM (
  SELECT *, CASE WHEN source_group = '' THEN '' WHEN parent_id IS NOT NULL THEN id || '/' || parent_id
    WHEN use_for_mixing THEN id END AS given FROM v_manifest))""",
        "v_manifest",
    ),
)
def derive_record_id(spark, sf_dir):
    given = (
        F.when(F.col("source_group") == "", "")
        .when(F.col("parent_id").isNotNull(), F.concat_ws("/", "id", "parent_id"))
        .when(F.col("use_for_mixing"), F.col("id"))
    )
    m = v.manifest(spark, sf_dir).withColumn("given", given)
    return checks.derive_record_id(m, "given", "path", "voice_").select("record_index", "record_id", "safe_id")


WINDOW, RATE, FREE = 0.1875, 16000, ("fr", "de")


@query(
    "filter_long_commands",
    sql(
        """SELECT split, label, count(*) FILTER (NOT long) AS kept, count(*) FILTER (long) AS dropped,
  max(CASE WHEN long THEN frames / 16000 END) AS longest_dropped_s FROM m GROUP BY 1, 2""",
        "v_manifest",
        m="SELECT *, label NOT IN ('fr', 'de') AND frames > 3000 AS long FROM v_manifest",
    ),
)
def filter_long_commands(spark, sf_dir):
    kept, dropped, _ = checks.filter_long_commands(v.manifest(spark, sf_dir), WINDOW, RATE, FREE)
    both = kept.select("split", "label", F.lit(1).alias("k"), F.lit(None).cast("double").alias("s")).unionByName(
        dropped.select("split", "label", F.lit(0).alias("k"), F.col("duration_s").alias("s"))
    )
    return both.groupBy("split", "label").agg(
        F.sum("k").cast("bigint").alias("kept"),
        F.sum(1 - F.col("k")).cast("bigint").alias("dropped"),
        F.max("s").alias("longest_dropped_s"),
    )


@query(
    "verify_checksum",
    sql(
        "SELECT record_index, declared_sha256 FROM v_manifest WHERE declared_sha256 <> '' AND declared_sha256 <> sha256",
        "v_manifest",
    ),
)
def verify_checksum(spark, sf_dir):
    m = v.manifest(spark, sf_dir)
    bad = checks.verify_checksum(m, m.select("path", "sha256"), "declared_sha256")
    return bad.select("record_index", "declared_sha256")


@query(
    "holdout_entity",
    sql(
        """SELECT record_index, CASE WHEN speaker_group <> 'src3' THEN 'dataset' WHEN split = 'test' THEN 'held_out' ELSE 'misplaced' END AS part,
  CASE WHEN speaker_group = 'src3' AND split = 'test' THEN 'human:src3' ELSE speaker_group END AS speaker_group,
  CASE WHEN speaker_group = 'src3' AND split = 'test' THEN 'human_recording' ELSE sample_kind END AS sample_kind
FROM v_manifest""",
        "v_manifest",
    ),
)
def holdout_entity(spark, sf_dir):
    parts = checks.holdout_entity(with_entity(v.manifest(spark, sf_dir)), ENTITY)
    named = [p.withColumn("part", F.lit(n)) for n, p in zip(("dataset", "held_out", "misplaced"), parts)]
    out = named[0].unionByName(named[1]).unionByName(named[2])
    return out.select("record_index", "part", "speaker_group", "sample_kind")


def sessions(spark, sf_dir):
    e = v.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        "event_id",
        F.when(k != 0, F.concat("event_type", F.lit(".wav"))).alias("wav"),
        F.when(k % 4 != 1, k % 4 != 2).alias("accepted"),
        F.when(k > 90, "overflow").when(k > 80, "").alias("error"),
    )


@query(
    "recorder_acceptance",
    """SELECT event_id, CASE WHEN coalesce(k % 4 NOT IN (1, 2), false) AND NOT k > 90 THEN NULL ELSE 'recorder_not_accepted' END AS reason
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k <> 0""",
)
def recorder_acceptance(spark, sf_dir):
    return checks.recorder_acceptance(sessions(spark, sf_dir)).select("event_id", "reason")


@query(
    "evaluation_views",
    sql(
        """SELECT 'manifest' AS view, record_index FROM v_manifest WHERE NOT (speaker_group = 'src3' AND split = 'test')
UNION ALL SELECT 'held_out', record_index FROM v_manifest WHERE speaker_group = 'src3' AND split = 'test'
UNION ALL SELECT 'synthetic_test', record_index FROM v_manifest WHERE split = 'test' AND speaker_group <> 'src3'
  AND sample_kind IS DISTINCT FROM 'human_recording' AND engine IS DISTINCT FROM 'real'""",
        "v_manifest",
    ),
)
def evaluation_views(spark, sf_dir):
    m = v.manifest(spark, sf_dir)
    held = (F.col("speaker_group") == ENTITY) & (F.col("split") == "test")
    out = None
    for name, view in checks.evaluation_views(m, held).items():
        part = view.select(F.lit(name).alias("view"), "record_index")
        out = part if out is None else out.unionByName(part)
    return out


ELIGIBLE_SQL = """SELECT m.*, CASE WHEN NOT coalesce(m.use_for_mixing, true) THEN false WHEN s.id IS NOT NULL THEN s.use_for_mixing
  WHEN sample_kind IS NOT DISTINCT FROM 'procedural_noise' THEN true WHEN coalesce(parent_id, '') <> '' THEN false
  ELSE sample_kind IS DISTINCT FROM 'source_crop' END AS eligible
FROM v_manifest m LEFT JOIN b s ON m.parent_id = s.id"""


@query("mixing_eligibility", sql("SELECT record_index, eligible FROM e", "v_manifest", b=BACKGROUND_SQL, e=ELIGIBLE_SQL))
def mixing_eligibility(spark, sf_dir):
    rows = checks.mixing_eligibility(v.manifest(spark, sf_dir), background_list(spark, sf_dir))
    return rows.select("record_index", "eligible")


@query("encode_labels", sql("SELECT record_index, label_id FROM v_manifest JOIN v_labels USING (label)", "v_manifest", "v_labels"))
def encode_labels(spark, sf_dir):
    return joins.encode_labels(v.manifest(spark, sf_dir), v.label_map(spark, sf_dir)).select("record_index", "label_id")


@query(
    "missing_audio",
    sql(
        """SELECT record_index, 'missing_audio:' || path AS reason FROM v_manifest
WHERE record_index NOT IN (SELECT doc_id FROM labels)""",
        "v_manifest",
    ),
)
def missing_audio(spark, sf_dir):
    m = v.manifest(spark, sf_dir)
    graded = v.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("record_index"))
    files = m.join(graded, "record_index", "left_semi").select("path")
    return joins.missing_audio(m, files).select("record_index", "reason")


@query(
    "background_sources",
    sql(
        """SELECT record_index, parent_id, s.use_for_mixing AS source_use_for_mixing
FROM v_manifest m LEFT JOIN b s ON m.parent_id = s.id""",
        "v_manifest",
        b=BACKGROUND_SQL,
    ),
)
def background_sources(spark, sf_dir):
    rows = joins.background_sources(v.manifest(spark, sf_dir), background_list(spark, sf_dir))
    return rows.select("record_index", "parent_id", "source_use_for_mixing")


POOL_SQL = "SELECT * FROM e WHERE eligible AND label = 'fr' AND split = 'train'"
OVERLAP_SQL = """SELECT record_index, 'source_group' AS shared FROM v_manifest WHERE split <> 'train'
  AND source_group IN (SELECT source_group FROM p WHERE source_group <> '')
UNION ALL SELECT record_index, 'path' FROM v_manifest WHERE split <> 'train' AND path IN (SELECT path FROM p)"""


@query("heldout_overlap", sql(OVERLAP_SQL, "v_manifest", p="SELECT * FROM v_manifest WHERE split = 'train' AND label = 'fr'"))
def heldout_overlap(spark, sf_dir):
    m = v.manifest(spark, sf_dir)
    out = joins.heldout_overlap(m.where("split = 'train' and label = 'fr'"), m.where("split <> 'train'"))
    return out.select("record_index", "shared")


@query(
    "build_mixing_pool",
    sql(
        f"SELECT 'pool' AS part, record_index, NULL AS shared FROM p UNION ALL SELECT 'overlap', record_index, shared FROM ({OVERLAP_SQL})",
        "v_manifest",
        b=BACKGROUND_SQL,
        e=ELIGIBLE_SQL,
        p=POOL_SQL,
    ),
)
def build_mixing_pool(spark, sf_dir):
    m = v.manifest(spark, sf_dir)
    pool, overlap = validate.build_mixing_pool(m, m.where("split <> 'train'"), background_list(spark, sf_dir), "fr")
    a = pool.select(F.lit("pool").alias("part"), "record_index", F.lit(None).cast("string").alias("shared"))
    return a.unionByName(overlap.select(F.lit("overlap").alias("part"), "record_index", "shared"))


@query("split_label_counts", sql("SELECT split, label, count(*) AS n FROM v_manifest GROUP BY 1, 2", "v_manifest"))
def split_label_counts(spark, sf_dir):
    return curation.split_label_counts(v.manifest(spark, sf_dir))


@query(
    "exclusion_counts",
    "SELECT split_part(lang || ':' || source, ':', 1) AS code, count(*) AS n FROM documents GROUP BY 1",
)
def exclusion_counts(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents")
    return curation.exclusion_counts(d.select(F.concat_ws(":", "lang", "source").alias("reason")))


def leak_sql(relation, split, kinds):
    arms = " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS value, {split} AS s FROM {relation}" for k in kinds)
    return f"""SELECT kind, value, string_agg(DISTINCT s, ',' ORDER BY s) AS splits FROM ({arms})
WHERE value <> '' GROUP BY 1, 2 HAVING count(DISTINCT s) > 1"""


@query("split_leakage", sql(leak_sql("v_manifest", "split", ("sha256", *curation.GROUP_KINDS)), "v_manifest"))
def split_leakage(spark, sf_dir):
    return curation.split_leakage(v.manifest(spark, sf_dir)).withColumn("splits", F.array_join("splits", ","))


ORDERED_SQL = """SELECT *, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, record_index) AS i
FROM v_manifest"""
# One recursion step per row in order, with the accepted ids and contents so far.
DEDUP_STEPS = {
    "o": ORDERED_SQL,
    "w": """SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS record_index, CAST(NULL AS VARCHAR) AS decision,
  CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS hashes, CAST([] AS VARCHAR[]) AS parts
UNION ALL
SELECT i, record_index, decision,
  CASE WHEN decision = 'accepted' THEN list_append(ids, id) ELSE ids END,
  CASE WHEN decision = 'accepted' THEN list_append(hashes, sha256) ELSE hashes END,
  CASE WHEN decision = 'accepted' THEN list_append(parts, split) ELSE parts END
FROM (SELECT *, CASE WHEN parts[a] <> split THEN 'id_overlaps_splits' WHEN a > 0 THEN 'duplicate_id'
    WHEN parts[b] <> split THEN 'audio_overlaps_splits' WHEN b > 0 THEN 'duplicate_audio_in_split' ELSE 'accepted' END AS decision
  FROM (SELECT o.*, w.ids, w.hashes, w.parts, list_position(w.ids, o.id) AS a, list_position(w.hashes, o.sha256) AS b FROM w JOIN o ON o.i = w.i + 1))""",
}


def ordered_manifest(spark, sf_dir):
    m = v.manifest(spark, sf_dir)
    rank = curation.split_order(F.col("split")) * F.lit(1 << 48).cast("bigint")
    return m.withColumn("order", rank + F.col("record_index"))


def deduplicated(spark, sf_dir):
    return curation.first_wins_dedup(ordered_manifest(spark, sf_dir), "order")


@query("first_wins_dedup", sql("SELECT record_index, decision FROM w JOIN v_manifest USING (record_index)", "v_manifest", **DEDUP_STEPS))
def first_wins_dedup(spark, sf_dir):
    return deduplicated(spark, sf_dir).select("record_index", "decision")


@query(
    "group_leak_after_accept",
    sql(
        leak_sql("a", "partition", curation.GROUP_KINDS),
        "v_manifest",
        **DEDUP_STEPS,
        a="""SELECT m.*, CASE WHEN speaker_group = 'src3' AND split = 'test' THEN 'held_out' ELSE split END AS partition
FROM w JOIN v_manifest m USING (record_index) WHERE decision = 'accepted'""",
    ),
)
def group_leak_after_accept(spark, sf_dir):
    held = (F.col("speaker_group") == ENTITY) & (F.col("split") == "test")
    accepted = deduplicated(spark, sf_dir).where("decision = 'accepted'")
    accepted = accepted.withColumn("partition", F.when(held, "held_out").otherwise(F.col("split")))
    return curation.group_leak_after_accept(accepted).withColumn("splits", F.array_join("splits", ","))


def session_rows(spark, sf_dir):
    c = v.table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("s"), "conv_id").alias("folder"),
        F.concat("turn", F.lit(".wav")).alias("wav"),
        F.col("role").alias("label"),
        "text",
        F.when(F.col("turn") % 2 == 0, F.col("role")).alias("speaker"),
        F.lit(None).cast("string").alias("condition"),
    )


@query(
    "union_sources",
    sql(
        """SELECT 'dataset' AS kind, id, path, label, split, engine, speaker_group, NULL AS speaker FROM v_manifest
UNION ALL SELECT 'session', 'guest_' || substr(sha256(path), 1, 24), path, role, 'test', 'real', 'human:guest', coalesce(speaker, 'guest')
FROM (SELECT 's' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '.wav' AS path, role,
  CASE WHEN turn % 2 = 0 THEN role END AS speaker FROM conversations)""",
        "v_manifest",
    ),
)
def union_sources(spark, sf_dir):
    records = curation.session_records(session_rows(spark, sf_dir), "guest", "guest_")
    out = curation.union_sources(v.manifest(spark, sf_dir), records)
    return out.select("kind", "id", "path", "label", "split", "engine", "speaker_group", "speaker")


@query(
    "heldout_disjoint",
    sql(
        """SELECT sha256 FROM v_manifest WHERE NOT (speaker_group = 'src3' AND split = 'test')
INTERSECT SELECT sha256 FROM v_manifest WHERE speaker_group = 'src3' AND split = 'test'""",
        "v_manifest",
    ),
)
def heldout_disjoint(spark, sf_dir):
    m = v.manifest(spark, sf_dir)
    held = (F.col("speaker_group") == ENTITY) & (F.col("split") == "test")
    return curation.heldout_disjoint(m.where(~held), m.where(held))


@query(
    "curation_report",
    sql(
        """SELECT count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (decision = 'accepted' AND NOT held) AS dataset_accepted,
  count(*) FILTER (decision = 'accepted' AND held) AS held_out, count(*) FILTER (decision <> 'accepted') AS excluded,
  (SELECT string_agg(k || '=' || CAST(n AS VARCHAR), ';' ORDER BY k) FROM (SELECT split || '/' || label AS k, count(*) AS n FROM d
    WHERE decision = 'accepted' AND NOT held GROUP BY 1)) AS counts,
  (SELECT string_agg(k || '=' || CAST(n AS VARCHAR), ';' ORDER BY k) FROM (SELECT decision AS k, count(*) AS n FROM d
    WHERE decision <> 'accepted' GROUP BY 1)) AS exclusions, true AS complete FROM d""",
        "v_manifest",
        **DEDUP_STEPS,
        d="SELECT m.*, w.decision, (speaker_group = 'src3' AND split = 'test') AS held FROM w JOIN v_manifest m USING (record_index)",
    ),
)
def curation_report(spark, sf_dir):
    d = deduplicated(spark, sf_dir)
    held = (F.col("speaker_group") == ENTITY) & (F.col("split") == "test")
    excluded = d.where("decision <> 'accepted'").withColumn("reason", F.concat(F.col("decision"), F.lit(":x")))
    report = curation.curation_report(
        d.where("decision = 'accepted'"), excluded, held, {"min_seconds": 0.35, "max_seconds": 2.6}
    )

    def text(column):
        pairs = F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e.key, e.value))
        return F.array_join(F.array_sort(pairs), ";").alias(column)

    return report.select("accepted", "dataset_accepted", "held_out", "excluded", text("counts"), text("exclusions"), "complete")


@query(
    "shuffle_train",
    sql(
        "SELECT record_index, row_number() OVER (ORDER BY md5(id || ':' || record_index || ':42:3'), record_index) - 1 AS position FROM v_manifest WHERE split = 'train'",
        "v_manifest",
    ),
)
def shuffle_train(spark, sf_dir):
    m = v.manifest(spark, sf_dir).withColumn("key", F.concat_ws(":", "id", "record_index"))
    return training.number_shuffled(training.shuffle_train(m, "key", seed=42, epoch=3)).select("record_index", "position")


@query(
    "validate_dataset",
    sql(
        f"""SELECT 'kept_' || label AS kind, split, count(*) AS n FROM v_manifest WHERE frames <= 48000 GROUP BY 1, 2
UNION ALL SELECT 'checksum_mismatch', split, count(*) FROM v_manifest WHERE declared_sha256 <> '' AND declared_sha256 <> sha256 GROUP BY 1, 2
UNION ALL SELECT 'leak_' || kind, splits, count(*) FROM ({leak_sql('v_manifest', 'split', ('sha256', *curation.GROUP_KINDS))}) GROUP BY 1, 2""",
        "v_manifest",
    ),
)
def validate_dataset(spark, sf_dir):
    m = v.manifest(spark, sf_dir)
    files = m.select(
        "path", "sha256", "frames", F.lit(16000).alias("sample_rate"), F.lit(1).alias("channels"), F.lit(True).alias("all_finite")
    )
    counts, faults = validate.validate_dataset(m, files, v.label_map(spark, sf_dir))
    kept = counts.select(F.concat(F.lit("kept_"), "label").alias("kind"), "split", "n")
    return kept.unionByName(faults.groupBy("kind", "split").agg(F.count("*").alias("n")))
