"""The progress log of trials as a stream into a table (ST1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lathe.functions.numeric import exact_mean, n_where
from lathe.sources.tables import RECORD

KEYS = ["problem_id", "provider", "model", "condition", "skill_name", "k_value", "repetition"]


def read_progress(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of progress records appended as JSON lines; ``pass`` becomes ``passed``."""
    reader = spark.readStream.schema(RECORD)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).withColumnRenamed("pass", "passed")


def progress_summary(records: DataFrame) -> DataFrame:
    """Per (model, condition): trials, pass rate, mean score and tokens; each trial counts once."""
    return summary_of_trials(records.dropDuplicates(KEYS))


def summary_of_trials(trials: DataFrame) -> DataFrame:
    """``progress_summary`` of records of which each is another trial."""
    return trials.groupBy("model", "condition").agg(
        F.count("*").alias("n_trials"), (n_where(F.col("passed")) / F.count("*")).alias("pass_rate"), exact_mean(F.col("score")).alias("mean_score"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    )


def committed_batches(spark: SparkSession, path: str) -> dict[int, str]:
    """The folders of a progress table whose batches are complete, by batch id."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    marks = hadoop.Path(f"{path}/batch_id=*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or []
    folders = [f.getPath().getParent() for f in found]
    return {int(f.getName().partition("=")[2]): f.toString() for f in folders}


def read_table(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The trials of a progress table's complete batches (those before a batch id), or None if it has none."""
    folders = [f for n, f in committed_batches(spark, path).items() if before is None or n < before]
    return spark.read.option("basePath", path).parquet(*folders) if folders else None


def run_to_table(records: DataFrame, path: str, checkpoint: str, time: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """Add what is new in a stream of progress records to the table at ``path``, each trial once; returns when all is there.

    Every micro-batch is a folder of its own, written whole under its batch id and
    complete with its ``_SUCCESS`` file. After a failure Spark runs a batch again from
    ``checkpoint`` under the same id, so its folder is written anew: nothing is lost
    or counted twice, and readers see complete batches only.

    With a column ``time`` repeats within ``delay`` are dropped by the stream, whose
    state holds that span. Without one the table itself is the state: a batch's new
    trials are those that no earlier batch has, and nothing is kept in memory.
    """
    if time:
        records = records.withWatermark(time, delay).dropDuplicatesWithinWatermark(KEYS)

    def add(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates(KEYS)
        known = None if time else read_table(batch.sparkSession, path, batch_id)
        if known is not None:
            known = known.select([F.col(k).alias(f"_{k}") for k in KEYS])
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
            fresh = fresh.join(known, same, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
