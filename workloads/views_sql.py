"""The stand-in views again, as SQL for the independent check."""

from __future__ import annotations


def u(key: str, salt: str, seed: int = 42) -> str:
    return (
        f"(CAST(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}:{seed}'), 1, 13)) AS UBIGINT) AS DOUBLE)"
        " / 4503599627370496.0)"
    )


VIEWS = {
    "v_manifest": f"""
SELECT doc_id AS record_index,
  'rec_' || CAST(CASE WHEN doc_id % 37 = 36 THEN doc_id - 1 ELSE doc_id END AS VARCHAR) AS id,
  lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
  lang AS label,
  CASE WHEN {u('doc_id', 'split')} < 0.7 THEN 'train' WHEN {u('doc_id', 'split')} < 0.85 THEN 'val' ELSE 'test' END AS split,
  source AS speaker_group,
  CASE WHEN doc_id % 3 = 0 THEN 'p' || CAST(doc_id // 10 AS VARCHAR) END AS parent_id,
  CASE WHEN doc_id % 4 = 1 THEN '' WHEN doc_id % 4 = 2 THEN 'g' || CAST(doc_id // 8 AS VARCHAR) END AS source_group,
  CASE doc_id % 4 WHEN 0 THEN 'human_recording' WHEN 1 THEN 'procedural_noise' WHEN 2 THEN 'source_crop' END AS sample_kind,
  CASE doc_id % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'tts' END AS engine,
  CASE WHEN doc_id % 7 = 0 THEN false WHEN doc_id % 7 < 4 THEN true END AS use_for_mixing,
  sha256(text) AS sha256,
  CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN md5(text) WHEN doc_id % 5 <> 0 THEN sha256(text) END AS declared_sha256,
  n_chars AS frames
FROM documents""",
    "v_labels": "SELECT lang AS label, row_number() OVER (ORDER BY lang) - 1 AS label_id FROM (SELECT DISTINCT lang FROM documents)",
    "v_clips": """
SELECT vec_id AS clip_id, CAST(embedding AS DOUBLE[]) AS samples, 'class_' || CAST(label AS VARCHAR) AS label,
  CAST(label AS BIGINT) AS label_id FROM embeddings""",
    "v_classes": "SELECT DISTINCT 'class_' || CAST(label AS VARCHAR) AS label, CAST(label AS BIGINT) AS label_id FROM embeddings",
    "v_log": """
SELECT event_id, user_id AS recording_id, event_type AS label, least(value / 100, 1.0) AS confidence,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  (epoch_us(ts) - 1704067200000000) / 1e6 AS time_seconds
FROM events""",
    "v_windows": """
SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY time_seconds, event_id) - 1 AS window_index,
  time_seconds, label AS predicted_label, confidence FROM v_log""",
    "v_durations": "SELECT recording_id, max(time_seconds) + 3600.0 AS duration_seconds FROM v_log GROUP BY 1",
    "v_regions": """
SELECT recording_id, event_id, label, time_seconds AS start_seconds, time_seconds + 21600.0 AS end_seconds
FROM v_log WHERE k < 33""",
    "v_dets": "SELECT recording_id, event_id AS detection_id, label, time_seconds, confidence FROM v_log WHERE k >= 33",
    "v_history": """
SELECT o_orderpriority AS run, CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS epoch, round(avg(o_totalprice), 4) AS val_loss
FROM orders GROUP BY 1, 2""",
}
_NEEDS = {"v_windows": ["v_log"], "v_durations": ["v_log"], "v_regions": ["v_log"], "v_dets": ["v_log"]}


def sql(body: str, *views: str, **more: str) -> str:
    """Prefix a query with the views it names, then with its own named steps."""
    parts, seen = [], set()
    for view in views:
        for name in [*_NEEDS.get(view, []), view]:
            if name not in seen:
                seen.add(name)
                parts.append(f"{name} AS ({VIEWS[name]})")
    recursive = any("UNION ALL" in step and f" {name} " in step for name, step in more.items())
    parts += [f"{name} AS ({step})" for name, step in more.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
