"""Tables around a training run: epoch order, batch logs and the best epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chirrup.functions.scan import numbered


def shuffle_train(manifest: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Training rows in an order that the key, seed and epoch fix; other splits are left out."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), F.lit(str(epoch))))
    return manifest.where("split = 'train'").withColumn("shuffle_key", digest).orderBy("shuffle_key", key)


def number_shuffled(shuffled: DataFrame, tie: str = "record_index") -> DataFrame:
    """Adds each row's place in the shuffled order."""
    keyed = shuffled.withColumn("_all", F.lit(0))
    out = numbered(keyed, ["_all"], ["shuffle_key", tie], F.substring("shuffle_key", 1, 3), "position")
    return out.drop("_all")


def weighted_epoch_metrics(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Batch means weighted by batch size."""
    return batches.groupBy(*keys).agg(
        (F.sum(F.col("loss") * F.col("size")) / F.sum("size")).alias("loss"),
        (F.sum("correct") / F.sum("size")).alias("accuracy"),
        F.sum("size").cast("bigint").alias("count"),
    )


def best_epoch_early_stop(history: DataFrame, patience: int) -> DataFrame:
    """Per run: the best epoch, its loss, the last epoch run and whether it stopped early.

    An epoch improves only on a strictly lower loss.  The run stops at the first
    epoch that is `patience` epochs past the last improvement.  A run has at most
    as many rows as epochs, so one task per run is bounded.
    """
    run = W.partitionBy("run").orderBy("epoch")
    before = run.rowsBetween(W.unboundedPreceding, -1)
    h = history.withColumn("_best", F.min("val_loss").over(before)).withColumn("_n", F.row_number().over(run))
    h = h.withColumn("_improved", F.col("_best").isNull() | (F.col("val_loss") < F.col("_best")))
    upto = run.rowsBetween(W.unboundedPreceding, 0)
    h = h.withColumn("_stale", F.col("_n") - F.max(F.when(F.col("_improved"), F.col("_n"))).over(upto))
    stops = F.min(F.when(F.col("_stale") >= patience, F.col("_n"))).over(W.partitionBy("run"))
    h = h.withColumn("_stop", stops).where(F.col("_stop").isNull() | (F.col("_n") <= F.col("_stop")))
    return h.groupBy("run").agg(
        F.max_by("epoch", F.when(F.col("_improved"), F.col("_n"))).alias("best_epoch"),
        F.min("val_loss").alias("best_val_loss"),
        F.max("epoch").alias("last_epoch"),
        F.max("_stop").isNotNull().alias("stopped_early"),
    )
