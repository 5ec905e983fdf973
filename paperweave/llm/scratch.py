"""Written tables that cut lineage, in the folder all executors share, and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.sources.lineage import dropped, written

#: A side of a join is broadcast only if it was counted and has at most so many rows of two longs (3.2 MB).
BROADCAST_ROWS = 200_000


#: A table written in the folder that all executors share and read again: lineage ends there, so a lost executor costs one task, not the plan.
cut = written
#: Tables are deleted as soon as all that depends on them is written, so that a long plan does not hold the disk of all its steps.
drop = dropped


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a cut table of narrow rows, marked for broadcast if it is counted to be small; else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def salt(buckets: int, *columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")
