"""Running counts over streams of events and walks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, folder: str, table: str, schema: StructType) -> DataFrame:
    """A table's files as a stream: new files are new rows."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, key, n): counts in tumbling windows; rows later than ``late`` behind the newest are dropped."""
    at = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return at.groupBy(F.window("_t", width).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key, "n")


def label_counts(stream: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(label, n): occurrences so far of every label in a stream of walks."""
    return stream.select(F.explode(tokens).alias("label")).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def run_once(counts: DataFrame) -> DataFrame:
    """Everything available now, as a table in the shared folder: for tests and back-fills.

    Every batch writes the whole state anew, so the last one stands.
    """
    from quarry.session import ensure_checkpoint_dir

    spark = counts.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/counts_{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts")

    query = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{folder}/counts")
