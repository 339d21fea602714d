"""Running a stream over what is available, into a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lodestrata.plans.lineage import ensure_checkpoint_dir


def stream_table(spark: SparkSession, root: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The Parquet table ``name`` under ``root`` as a stream of its files."""
    path = f"{root}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a glob, which may also match one file; a plain path must be a folder


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Feed the batches of all that is available to ``each``; progress is kept in ``checkpoint``, by default a new folder of the shared one."""
    where = checkpoint or f"{ensure_checkpoint_dir(stream.sparkSession)}/streams/{uuid.uuid4()}"
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", where).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_per_key(stream: DataFrame, keys: Sequence[str], mode: str = "update") -> DataFrame:
    """The last state of each key after all that is available.

    Batches are appended to a table in the shared folder under their number; a batch that is repeated after a failure replaces itself.
    In ``complete`` mode the last batch is the result.
    """
    spark = stream.sparkSession
    out = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4()}-out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_available(stream, write, mode)
    rows = spark.read.schema(stream.schema.add("batch", "long")).option("basePath", out).parquet(out)
    if mode == "complete":
        return rows.where(F.col("batch") == F.lit(rows.agg(F.max("batch")).first()[0])).drop("batch")
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("_n", newest).where("_n = 1").drop("_n", "batch")


def appended(stream: DataFrame) -> DataFrame:
    """All rows that an append-only stream gives for what is available, as a table in the shared folder."""
    spark = stream.sparkSession
    out = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4()}-out"
    run_available(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
    return spark.read.schema(stream.schema).option("basePath", out).parquet(out)
