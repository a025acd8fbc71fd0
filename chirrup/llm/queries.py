"""The operators applied to the given tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirrup.llm import bpe, chat, hard_negatives, mixing, nn_descent, quality, repeats, secrets, simhash, token_counts, toxicity, warc, whitening
from chirrup.llm.common import table
from chirrup.session import fresh_path, materialize


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids, and give both digests."""
    import public_tokenizers

    ranks = _vocabulary("byte_bpe_50k.tiktoken")
    both = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded="decoded")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_embedding_near_dedup(spark, sf_dir):
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_warc(spark, sf_dir):
    """Write all pages to archives, read the archives back; one row per record from its last chunk."""
    index = warc.write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    chunks = warc.read_archives(index, payload=False)
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_repeated_bytes(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash(spark, sf_dir):
    marks = simhash.fingerprints(table(spark, sf_dir, "documents"))
    found = simhash.near_groups(marks)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_secrets(spark, sf_dir):
    found = secrets.summarise_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op9_quality(spark, sf_dir):
    return quality.clean_lines(table(spark, sf_dir, "documents")).drop("cleaned")


def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"), words_apart=False)


def op11_chat_windows(spark, sf_dir):
    """Format all conversations, and one that speaks in marks; digests of what is read back from the windows."""
    import public_tokenizers

    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.when(F.col("id") == 0, "user").otherwise("assistant")
    marks = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), roles.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    windows = materialize(chat.format_windows(talks.unionByName(marks), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    return chat.digest_windows(windows)


def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of the vectors whose id is divisible by 100, with the labels of every seventh moved on by one."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), scale=64.0, offset=1_000_000)


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_embedding_near_dedup, op3_warc, op4_toxicity, op5_repeated_bytes, op6_simhash, op7_mixing, op8_secrets, op9_quality, op10_token_counts,
        op11_chat_windows, op12_hard_negatives, op13_whitening,
    )
}
#: Words of a text; the pattern is spelled for the SQL engine's regular expressions.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP7 = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS ss, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source
),
o AS (
  SELECT *, sum(ss) OVER () - coalesce(sum(3 * ss) OVER (ORDER BY 3 * ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
    sum(w) OVER (ORDER BY 3 * ss / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    row_number() OVER (ORDER BY 3 * ss / w, source) AS k
  FROM s
),
f AS (SELECT min(k) AS k FROM o WHERE room * w <= 3 * ss * rest),
t AS (
  SELECT o.source, o.ss, CASE WHEN o.k < f.k THEN 3.0 * o.ss ELSE o.w * c.room::DOUBLE / c.rest END AS target
  FROM o, f, o AS c WHERE c.k = f.k
)
SELECT doc_id, size::BIGINT AS size, ss AS source_size, round(target, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

#: A line `x` of op9, as furniture or not.
_MARKED = f"(length(x) - length(regexp_replace(x, '[{re.escape(quality.MARKS)}]', '', 'g')))"
_SEPARATED = f"""(length(x) - length(regexp_replace(x, '[{quality.SEPARATORS}]', '', 'g'))
  - least(length(x) - length(replace(x, '«', '')), length(x) - length(replace(x, '»', ''))))"""
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ENDED = f"""right(trim(rtrim(trim(x, {_SPACE}), '{quality.CLOSING.replace("'", "''")}'), {_SPACE}), 1) IN ({", ".join(f"'{e}'" for e in quality.ENDS)})"""
_FURNITURE = f"""(((length(x) < {quality.SHORT} AND NOT {_ENDED}) OR {_MARKED} > length(x) * {quality.MARKED})
    AND NOT ((regexp_matches(x, '{quality.CODE}') AND 3 * {_MARKED} < length(x)) OR regexp_matches(x, '{quality.BRACES}')))
  OR ({_SEPARATED} >= 3 AND len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) < {quality.LINKED} * {_SEPARATED})
  OR (length(x) < {quality.FURNITURE} AND ({" OR ".join(f"contains(lower(x), '{p}')" for p in quality.BOILERPLATE)}))"""

_OP9 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents
),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words,
    length(t) AS size, length(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '[^\\x20\\x09-\\x0D]') OR NOT ({_FURNITURE})), chr(10))) AS cleaned_size
  FROM d LEFT JOIN n USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND cleaned_size >= 0.5 * size AS kept FROM c
"""

_OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {"op9_quality": _OP9, "op12_hard_negatives": _OP12}
#: SQL for some columns of a query's rows, which the tests compare.
PARTIAL: dict[str, str] = {"op7_mixing": _OP7}
