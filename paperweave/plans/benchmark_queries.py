"""The benchmark as a query, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperweave.operators import benchmark
from paperweave.plans.document_queries import SQL as DOCUMENT_SQL
from paperweave.plans.document_queries import _pages
from paperweave.plans.fixtures import PAGES, sql_text, view
from paperweave.sources.tables import KEY_FIELDS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NAME = "concat(upload_group_id, '-', scan_index)"
#: Pages whose upload is told apart from them, truth about most of them, and the uploads of most.
SHEETS = f"SELECT {_NAME} AS file_name, scan_index, CASE WHEN scan_index % 9 = 2 THEN 'BB_NO_HANG' ELSE doc_type END AS doc_type, page_role, CASE system WHEN 'GT' THEN 'INTERNAL_B' ELSE system END AS system, action, {', '.join(KEY_FIELDS)} FROM ({PAGES}) AS pages"
UPLOADS = f"SELECT {_NAME} AS file_name, upload_group_id FROM ({PAGES}) AS pages WHERE scan_index % 11 <> 6"
TRUTH = f"""SELECT {_NAME} AS file_name, CASE WHEN scan_index % 9 = 2 THEN 'BB_TRA_HANG' WHEN scan_index % 5 = 0 THEN 'PO' ELSE doc_type END AS doc_type, CASE WHEN scan_index % 2 = 0 THEN page_role END AS page_role,
  CASE WHEN scan_index % 4 = 0 THEN 'INTERNAL_A' WHEN scan_index % 4 = 1 THEN system END AS system, shipment_id, concat('I', scan_index % 2) AS invoice_no, ' ' || po_no AS po_no, transfer_order_no, pxk_no FROM ({PAGES}) AS pages WHERE scan_index % 7 <> 3"""
_votes = DOCUMENT_SQL["vote_fields"]
_voted = _votes.replace(_pages, f"pages_ AS (SELECT * REPLACE (CASE WHEN scan_index % 9 = 2 THEN 'BB_NO_HANG' ELSE doc_type END AS doc_type) FROM ({sql_text(PAGES)}) WHERE scan_index % 11 <> 6)")
_voted = _voted[: _voted.rindex("SELECT upload_group_id")]
_final = _votes[_votes.rindex("SELECT upload_group_id") :].replace("SELECT upload_group_id, scan_index, cluster_id,", f"SELECT {_NAME} AS file_name, upload_group_id, cluster_id, cluster_size, split_reason,")
_rows = f"""{_voted}, vt AS ({_final}), sheets AS ({sql_text(SHEETS)}), truth AS ({sql_text(TRUTH)}),
w AS (SELECT s.* REPLACE (CASE WHEN v.file_name IS NULL THEN s.invoice_no ELSE voted_invoice_no END AS invoice_no, CASE WHEN v.file_name IS NULL THEN s.shipment_id ELSE voted_shipment_id END AS shipment_id, CASE WHEN v.file_name IS NULL THEN s.po_no ELSE voted_po_no END AS po_no),
  v.upload_group_id, coalesce(v.cluster_size, 1) AS cluster_size, coalesce(v.split_reason, 'NO_UPLOAD') AS split_reason, v.file_name IS NOT NULL AND (s.invoice_no IS DISTINCT FROM voted_invoice_no OR s.shipment_id IS DISTINCT FROM voted_shipment_id OR s.po_no IS DISTINCT FROM voted_po_no) AS changed FROM sheets s LEFT JOIN vt v USING (file_name)),
j AS (SELECT w.*, coalesce(t.doc_type, 'UNKNOWN') AS gt_doc_type, coalesce(t.page_role, 'HEADER') AS gt_page_role, coalesce(t.system, 'COMMON') AS gt_system, {', '.join(f't.{f} AS gt_{f}' for f in KEY_FIELDS)} FROM w LEFT JOIN truth t USING (file_name)),
z AS (SELECT *, coalesce(doc_type = gt_doc_type, false) AS strict, coalesce(doc_type = gt_doc_type OR doc_type IN ('BB_NO_HANG', 'BB_TRA_HANG') AND gt_doc_type IN ('BB_NO_HANG', 'BB_TRA_HANG'), false) AS lenient, coalesce(page_role = gt_page_role, false) AS role, coalesce(system = gt_system, false) AS system_right,
  coalesce(CASE WHEN starts_with(system, 'INTERNAL_') THEN 'INTERNAL' ELSE system END = CASE WHEN starts_with(gt_system, 'INTERNAL_') THEN 'INTERNAL' ELSE gt_system END, false) AS family FROM j)"""
_shares = {"doc_type_accuracy_strict": "strict", "doc_type_accuracy_lenient": "lenient", "page_role_accuracy": "role", "system_accuracy": "system_right", "system_accuracy_family": "family"}
_metrics = ["SELECT 'total_documents' AS metric, CAST(count(*) AS DOUBLE) AS value FROM z"]
_metrics += [f"SELECT '{n}', floor(avg({c}::INT) * 10000 + 0.5) / 10000 FROM z" for n, c in _shares.items()]
_metrics += [f"SELECT '{f}:{m}', {c} FROM z" for f in KEY_FIELDS for m, c in (("gt_present", f"count(gt_{f})"), ("pred_present", f"count({f})"), ("exact_match", f"count(*) FILTER (trim({f}) = trim(gt_{f}))"))]
_metrics += ["SELECT 'pages_without_group', count(*) FILTER (upload_group_id IS NULL) FROM z", "SELECT 'pages_changed_by_voting', count(*) FILTER (changed) FROM z", "SELECT 'multi_page_clusters', count(*) FILTER (cluster_size > 1 AND split_reason <> 'JOINED') FROM z"]
_metrics += ["SELECT 'action:' || action, count(*) FROM z GROUP BY 1", "SELECT 'split:' || split_part(split_reason, '(', 1), count(*) FROM z GROUP BY 1"]


def _run(spark: SparkSession, sf_dir: str) -> benchmark.Benchmark:
    return benchmark.run(view(spark, sf_dir, SHEETS), view(spark, sf_dir, UPLOADS), view(spark, sf_dir, TRUTH))


@query(f"{_rows} {' UNION ALL '.join(_metrics)}")
def benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads, votes, scores and report, each on what the last gave."""
    return _run(spark, sf_dir).report


@query(f"{_rows} SELECT file_name, doc_type, gt_doc_type, strict, lenient, role, system_right, family, shipment_id, invoice_no, po_no, changed, cluster_size, split_reason FROM z")
def benchmark_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).pages.select("file_name", "doc_type", "gt_doc_type", "strict", "lenient", "role", "system_right", "family", "shipment_id", "invoice_no", "po_no", "changed", "cluster_size", "split_reason")
