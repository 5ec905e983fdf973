"""A benchmark end to end: pages get their uploads, are voted, and are scored against truth.

pages: file_name, doc_type, page_role, system, action, scan_index and the key fields. uploads: file_name, upload_group_id. truth: file_name, doc_type, page_role, system and the key fields; what truth does not say has a default.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.functions.text import fixed
from paperweave.operators.stitching import voted, voting_runs
from paperweave.sources.lineage import written
from paperweave.sources.tables import KEY_FIELDS, write_records, write_table

# What a page without truth is expected to be, and the types that count as one another.
EXPECTED = {"doc_type": "UNKNOWN", "page_role": "HEADER", "system": "COMMON"}
ALIKE = ("BB_NO_HANG", "BB_TRA_HANG")
VOTED = ("invoice_no", "shipment_id", "po_no")


@dataclass(frozen=True)
class Benchmark:
    """pages: after voting, with what truth says and which of it is right; report: metric, value."""

    pages: DataFrame
    report: DataFrame


def family(system: Column) -> Column:
    """Systems of internal transfers are one family."""
    return F.when(system.startswith("INTERNAL_"), "INTERNAL").otherwise(system)


def with_votes(pages: DataFrame, uploads: DataFrame) -> DataFrame:
    """pages with their upload, cluster and voted keys in place of their own, and whether voting changed any. A page of no known upload is not voted; it is a cluster of its own without a name."""
    grouped = pages.join(uploads, "file_name")
    told = voted(voting_runs(grouped))
    changed = F.lit(False)
    for f in VOTED:
        changed = changed | ~F.col(f).eqNullSafe(F.col(f"voted_{f}"))
    keep = [c for c in pages.columns if c not in VOTED]
    rows = told.select(*keep, "upload_group_id", "cluster_id", "cluster_size", "split_reason", changed.alias("changed"), *(F.col(f"voted_{f}").alias(f) for f in VOTED))
    alone = pages.join(uploads.select("file_name"), "file_name", "left_anti")
    alone = alone.withColumn("cluster_size", F.lit(1).cast("long")).withColumn("split_reason", F.lit("NO_UPLOAD")).withColumn("changed", F.lit(False))
    return rows.unionByName(alone, allowMissingColumns=True)


def scored(pages: DataFrame, truth: DataFrame) -> DataFrame:
    """pages with the expected values (gt_...) and strict, lenient, role, system and family: which of them are right. Every page is kept; truth of no page is not asked for."""
    expected = truth.select("file_name", *(F.col(c).alias(f"gt_{c}") for c in (*EXPECTED, *KEY_FIELDS)))
    rows = pages.join(expected, "file_name", "left").withColumns({f"gt_{c}": F.coalesce(f"gt_{c}", F.lit(d)) for c, d in EXPECTED.items()})
    same = {c: F.coalesce(F.col(c) == F.col(f"gt_{c}"), F.lit(False)) for c in EXPECTED}
    lenient = same["doc_type"] | (F.coalesce(F.col("doc_type").isin(*ALIKE), F.lit(False)) & F.col("gt_doc_type").isin(*ALIKE))
    kin = F.coalesce(family(F.col("system")) == family(F.col("gt_system")), F.lit(False))
    return rows.select("*", same["doc_type"].alias("strict"), lenient.alias("lenient"), same["page_role"].alias("role"), same["system"].alias("system_right"), kin.alias("family"))


def report(rows: DataFrame) -> DataFrame:
    """metric, value: shares of right pages, what of each key was expected, predicted and equal, and how pages are spread over actions and reasons to split. One aggregate for all that is a number, one for what is spread."""
    right = {"doc_type_accuracy_strict": "strict", "doc_type_accuracy_lenient": "lenient", "page_role_accuracy": "role", "system_accuracy": "system_right", "system_accuracy_family": "family"}
    numbers = {"total_documents": F.count("*").cast("double")}
    numbers |= {name: fixed(F.avg(F.col(c).cast("double"))) for name, c in right.items()}
    for f in KEY_FIELDS:
        equal = F.trim(F.col(f)) == F.trim(F.col(f"gt_{f}"))
        numbers |= {f"{f}:gt_present": F.count(f"gt_{f}").cast("double"), f"{f}:pred_present": F.count(f).cast("double"), f"{f}:exact_match": F.count_if(equal).cast("double")}
    numbers |= {"pages_without_group": F.count_if(F.col("upload_group_id").isNull()).cast("double"), "pages_changed_by_voting": F.count_if("changed").cast("double"), "multi_page_clusters": F.count_if((F.col("cluster_size") > 1) & (F.col("split_reason") != "JOINED")).cast("double")}
    one = rows.agg(*(c.alias(f"m{i}") for i, c in enumerate(numbers.values())))
    told = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("value")) for i, n in enumerate(numbers)))).alias("x")).select("x.*")
    kinds = F.array(F.concat(F.lit("action:"), "action"), F.concat(F.lit("split:"), F.split_part("split_reason", F.lit("("), F.lit(1))))
    spread = rows.select(F.explode(kinds).alias("metric")).filter("metric is not null").groupBy("metric").agg(F.count("*").cast("double").alias("value"))
    return told.unionByName(spread)


def run(pages: DataFrame, uploads: DataFrame, truth: DataFrame) -> Benchmark:
    """The whole chain; the scored pages are written once and read by the report and by whoever saves them."""
    rows = written(scored(with_votes(pages, uploads), truth))
    return Benchmark(rows, report(rows))


def save(result: Benchmark, folder: str) -> None:
    """Results as JSON lines by upload, the evaluation as CSV, and the report as JSON, below one folder."""
    own = [c for c in result.pages.columns if not c.startswith("gt_") and c not in ("strict", "lenient", "role", "system_right", "family")]
    write_records(result.pages.select(*own), f"{folder}/results", "upload_group_id")
    write_table(result.pages.select("file_name", "gt_doc_type", "doc_type", "strict", "gt_system", "system", "system_right", "gt_page_role", "page_role", "action", *(c for f in KEY_FIELDS for c in (f, f"gt_{f}"))), f"{folder}/evaluation")
    result.report.coalesce(1).write.mode("overwrite").json(f"{folder}/report")
