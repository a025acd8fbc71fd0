"""A corpus from raw documents to token ids, in stages that each keep a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirrup.llm import bpe, mixing, secrets, simhash, toxicity
from chirrup.llm.common import packed, unpacked, unused
from chirrup.session import materialize

#: Training and iterative stages have no SQL.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the models, trained on these documents and the given labels, do not find toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, predicted = unused(docs, "score"), unused(docs, "predicted")
    return toxicity.score(docs, model, score=score, predicted=predicted).where(F.col(predicted) == 0).drop(score, predicted)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id; of repeated rows, one.

    Documents without an id are all kept, unless they copy one with an id.
    """
    groups = simhash.near_groups(simhash.fingerprints(docs))
    leaders = materialize(groups.where("doc_id <=> component_id").groupBy(F.col("doc_id").alias("kept")).agg(F.count("*").alias("rows")))
    # Leaders grow with the documents, so both sides are shuffled at every size.
    kept = packed(docs, id=F.col("doc_id")).join(leaders.hint("merge"), F.col("id").eqNullSafe(F.col("kept")))
    if leaders.where("rows > 1").isEmpty():
        return unpacked(kept)
    single = kept.where("rows = 1 or kept is null").select("row", "id")
    return unpacked(single.union(kept.where("rows > 1 and kept is not null").select("row", "id").dropDuplicates(["id"])))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark, and n_chars counted again."""
    out = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): token ids, and the digest of the text that they decode to."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded")
    return both.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("secret scan", redact_secrets),
    ("mixing", mix_sources),
    ("byte-level bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each one's table written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
