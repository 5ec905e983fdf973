"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.operators.components import connected


def components(links: DataFrame) -> DataFrame:
    """links (a, b) as doc_id, component_id: the least id reachable. Documents without links to others are left out."""
    return connected(links).select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
