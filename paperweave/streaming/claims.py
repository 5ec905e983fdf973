"""Jobs claimed exactly once, and reviews appended exactly once, by streams that may be killed and run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("worker", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("batch", T.LongType())])


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All claims: job_id, worker, created_at and the batch that made them. Only batches that were written to their end count."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], LEDGER)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    held = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    done = [p for p in (str(f.getPath()) for f in held) if _exists(spark, f"{p}/_SUCCESS")]
    return spark.read.schema(LEDGER).option("basePath", folder).parquet(*done) if done else spark.createDataFrame([], LEDGER)


def claim(jobs: DataFrame, number: int, folder: str, workers: int) -> bool:
    """One micro-batch: its jobs that nobody holds yet go to workers, oldest first within each worker, and into the ledger under the batch's number. Returns False if the batch is there already, as it is when a stream was killed after
    its batch was written and before it was committed; it then claims nothing. A batch that was cut off in the middle has no mark of success and is written again in full. Jobs that come twice, in one batch or in several, are claimed once."""
    spark = jobs.sparkSession
    own = f"{folder}/batch={number}"
    if _exists(spark, f"{own}/_SUCCESS"):
        return False
    waiting = jobs.groupBy("job_id").agg(F.min("created_at").alias("created_at")).join(ledger(spark, folder).select("job_id"), "job_id", "left_anti")
    worker = F.concat(F.lit("worker-"), F.pmod("job_id", F.lit(workers)).cast("string"))
    rows = waiting.select(F.col("job_id").cast("long").alias("job_id"), worker.alias("worker"), F.col("created_at").cast("timestamp").alias("created_at"))
    rows.sortWithinPartitions("worker", "created_at", "job_id").write.mode("overwrite").parquet(own)
    return True


def running(claims: DataFrame) -> DataFrame:
    """Jobs as they stand after a claim: the state that the claimed job starts in."""
    return claims.select("job_id", F.lit("RUNNING").alias("status"), F.col("worker").alias("locked_by"), F.lit("T1").alias("stage"), *(F.lit(0).alias(n) for n in ("stage_done", "stage_total", "percent")), F.lit(None).cast("string").alias("error"))


def new_reviews(reviews: DataFrame, late: str, *identity: str) -> DataFrame:
    """reviews (a stream with created_at) with each told once: repeats within the watermark are dropped, and state older than it goes. Append only; nothing is changed or removed later."""
    return reviews.withWatermark("created_at", late).dropDuplicatesWithinWatermark(list(identity))


def append(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs the stream over all there is, into a table that is only appended to; a batch that is repeated after a crash replaces its own files by the sink's log."""
    stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(folder).awaitTermination()
