"""Tables in the folder that all executors share: where iterations cut their lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; on one machine, where that is unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "/tmp/checkpoints"
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written and read again, so that a lost executor costs one task and a loop's plan does not grow."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


#: Rows of a task, about, where rows in order or in a table are held by it: what it holds does not grow with the input.
TASK_ROWS = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as hold about TASK_ROWS of `rows` rows each, a number that adaptive execution does not merge again; as it is if there are no more than cores."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def dropped(*frames: DataFrame) -> None:
    """Deletes tables made by written(), once all that was made of them is itself written."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
