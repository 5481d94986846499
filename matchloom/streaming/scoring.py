"""Candidates for target records that arrive as a stream: an extension, as batches are the same computation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from matchloom.operators import blocking


def candidate_stream(targets: DataFrame, s1: DataFrame, index: DataFrame) -> DataFrame:
    """Scored pairs of a stream of targets(entity_id, source, name, address, country) with reference records.

    index(s1_id, key) is the capped reference index. A pair may repeat if it shares several keys; see `keep_best`.
    """
    keys = targets.withColumn("key", F.explode(F.array_distinct(F.concat(blocking.K.target_keys(F.col("name"), F.col("address")), blocking.K.address_target_keys(F.col("address"))))))
    right = keys.select(F.col("entity_id").alias("target_id"), F.col("source").alias("target_source"), F.col("name").alias("target_name"), F.col("address").alias("target_address"), F.col("country").alias("target_country"), "key")
    left = s1.select(F.col("entity_id").alias("s1_id"), "name", "address", "country")
    return blocking.scored(right.join(index, "key").drop("key").join(left, "s1_id"))


def keep_best(pairs: DataFrame, path: str, checkpoint: str, k: int = blocking.TOP_K) -> DataStreamWriter:
    """A writer that keeps, per batch, the k best of the batch and of what was kept; each batch writes its own table, so a repeated batch is safe; the last two stay."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.distinct()
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{path}/batch={number - 1}").drop("blocking_rank")).distinct()
        blocking.top_k(rows, k).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number > 1:  # a batch may run again, so the table before it stays
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return pairs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
