"""Queries on documents, shipments and uploads, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.operators import audit, batching, stitching
from paperweave.plans.fixtures import PAGES, PAPERS, SHIPPED, sql_text, table, view
from paperweave.sources.lineage import written
from paperweave.sources.tables import manifest

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_papers = f"papers AS ({sql_text(PAPERS)})"
_prefixed = "CASE WHEN a.po_no IS NOT NULL AND b.po_no IS NOT NULL THEN CASE WHEN a.po_no = b.po_no THEN 'MATCH' WHEN left(a.po_no, {n}) = left(b.po_no, {n}) THEN 'PARTIAL_MATCH' ELSE 'MISMATCH' END WHEN a.po_no IS NOT NULL THEN 'MISSING_TARGET' WHEN b.po_no IS NOT NULL THEN 'MISSING_SOURCE' ELSE 'NOT_APPLICABLE' END"
_evidence = f"""{_papers}, ev AS (
SELECT a.dossier_id, 'po_no' AS field, a.doc_id AS source_doc, b.doc_id AS target_doc, a.po_no AS source_val, b.po_no AS target_val, {_prefixed.format(n=4)} AS status
  FROM papers a JOIN papers b USING (batch_id) WHERE a.doc_type = 'PO' AND b.doc_type = 'HOA_DON'
UNION ALL SELECT a.dossier_id, 'po_no', a.doc_id, b.doc_id, a.po_no, b.po_no, {_prefixed.format(n=3)} FROM papers a JOIN papers b USING (batch_id) WHERE a.doc_type = 'PO' AND b.doc_type = 'PHIEU_GIAO_HANG'
UNION ALL SELECT a.dossier_id, 'shipment_id', b.doc_id, a.doc_id, b.shipment_id, a.shipment_id, CASE WHEN a.shipment_id = b.shipment_id THEN 'MATCH' ELSE 'MISMATCH' END
  FROM papers a JOIN papers b USING (batch_id) WHERE a.doc_type = 'HOA_DON' AND b.doc_type = 'LOADING_PLAN' AND a.shipment_id IS NOT NULL AND b.shipment_id IS NOT NULL
UNION ALL SELECT a.dossier_id, 'transfer_order_no', b.doc_id, a.doc_id, b.shipment_id, a.transfer_order_no, CASE WHEN a.transfer_order_no = b.shipment_id THEN 'MATCH' ELSE 'MISMATCH' END
  FROM papers a JOIN papers b USING (batch_id) WHERE a.doc_type = 'PXKKVCNB' AND b.doc_type = 'LOADING_PLAN' AND a.transfer_order_no IS NOT NULL AND b.shipment_id IS NOT NULL
UNION ALL SELECT a.dossier_id, 'invoice_no', a.doc_id, b.doc_id, a.invoice_no, b.invoice_no, CASE WHEN a.invoice_no = b.invoice_no THEN 'MATCH' ELSE 'MISMATCH' END
  FROM papers a JOIN papers b USING (batch_id, dossier_id) WHERE a.doc_type = 'HOA_DON' AND b.doc_type = 'HOA_DON' AND a.doc_id < b.doc_id AND a.invoice_no IS NOT NULL AND b.invoice_no IS NOT NULL
UNION ALL SELECT a.dossier_id, 'shipment_id', a.doc_id, b.doc_id, a.shipment_id, b.shipment_id, CASE WHEN a.shipment_id = b.shipment_id THEN 'MATCH' ELSE 'MISMATCH' END
  FROM papers a JOIN papers b USING (batch_id, dossier_id) WHERE a.doc_type = 'HOA_DON' AND b.doc_type = 'HOA_DON' AND a.doc_id < b.doc_id AND a.shipment_id IS NOT NULL AND b.shipment_id IS NOT NULL)"""


@query(f"WITH {_evidence} SELECT * FROM ev")
def reconcile_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.reconciliation(view(spark, sf_dir, PAPERS))


@query(f"""WITH {_evidence}, e AS (SELECT dossier_id, count(*) AS n_evidence, bool_or(status = 'MISMATCH') AS mis, bool_or(status IN ('MATCH', 'PARTIAL_MATCH')) AS mat, bool_or(status LIKE 'MISSING%') AS gone FROM ev GROUP BY 1),
d AS (SELECT dossier_id, count(*) AS n_docs FROM papers GROUP BY 1)
SELECT d.dossier_id, n_docs, coalesce(n_evidence, 0) AS n_evidence, CASE WHEN n_evidence IS NULL THEN CASE WHEN n_docs > 1 THEN 'NO_EVIDENCE' ELSE 'DON_LE' END WHEN mis THEN 'XUNG_DOT' WHEN mat AND NOT gone THEN 'KHOP_HOAN_TOAN' WHEN gone THEN 'KHOP_MOT_PHAN' ELSE 'DON_LE' END AS match_status
FROM d LEFT JOIN e USING (dossier_id)""")
def dossier_match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    # read four times: written once, as its rows are told apart by a shuffle
    return audit.match_status(written(view(spark, sf_dir, PAPERS).select("batch_id", "dossier_id", "doc_type", "po_no", "invoice_no", "shipment_id", "transfer_order_no")))


#: All order lines: lines of six neighbouring orders share an order number, and lines of an order an invoice.
_DOSSIERS = "SELECT DISTINCT concat('B', l_suppkey % 5) AS batch_id, concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS doc_id, CASE WHEN l_linenumber % 3 > 0 THEN concat('P', CAST(floor(l_orderkey / 6) AS BIGINT), '-', l_partkey % 2) END AS po_no, CASE WHEN l_linenumber % 4 > 0 THEN concat('I', l_orderkey) END AS invoice_no, CAST(NULL AS {string}) AS pxk_no FROM {lineitem}"


@query(f"""WITH RECURSIVE p AS ({_DOSSIERS.format(string='VARCHAR', lineitem='lineitem')}), k AS (SELECT batch_id, doc_id, 'p' || po_no AS key FROM p WHERE po_no IS NOT NULL UNION SELECT batch_id, doc_id, 'i' || invoice_no FROM p WHERE invoice_no IS NOT NULL),
e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b USING (batch_id, key)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM p UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
root AS (SELECT node AS doc_id, min(seen) AS root FROM r GROUP BY 1),
g AS (SELECT batch_id, root, count(*) AS n_docs, min(doc_id) AS first_doc, list_sort(list(DISTINCT po_no) FILTER (po_no IS NOT NULL)) AS pos, list_sort(list(DISTINCT invoice_no) FILTER (invoice_no IS NOT NULL)) AS invs FROM p JOIN root USING (doc_id) GROUP BY 1, 2)
SELECT batch_id, concat_ws('_', 'ORDER', batch_id, CASE WHEN pos IS NULL AND invs IS NULL THEN concat('DOC_', first_doc) ELSE concat_ws('_', 'PO_' || pos[1], 'INV_' || invs[1]) END) AS dossier_id, root, n_docs,
  concat_ws(';', CASE WHEN len(pos) > 1 THEN 'po_no=' || array_to_string(pos, ',') END, CASE WHEN len(invs) > 1 THEN 'invoice_no=' || array_to_string(invs, ',') END) AS ambiguous_keys FROM g""")
def order_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _DOSSIERS.format(string="STRING", lineitem="{lineitem}")
    return audit.order_dossiers(spark.sql(text, lineitem=table(spark, sf_dir, "lineitem")))


#: form_code, required type or none, and name of guideline rows.
GUIDELINES = [("0", "PO", "order"), ("0", "HOA_DON", "invoice"), ("1", "HOA_DON", "invoice"), ("1", "PXKKVCNB", "transfer slip"), ("1", None, "stamp sheet"), ("2", None, "gate pass"), ("3", "PHIEU_GIAO_HANG", "delivery note"), ("3", "PHIEU_GIAO_HANG", "second note"), ("*", "LOADING_PLAN", "loading plan")]
_rules = ", ".join(f"({i}, '{f}', '{n}', {repr(t) if t else 'NULL'})" for i, (f, t, n) in enumerate(GUIDELINES))


@query(f"""WITH {_papers}, b AS (SELECT DISTINCT batch_id, CAST(CAST(substr(batch_id, 2) AS BIGINT) % 4 AS VARCHAR) AS order_code FROM papers), rules(rule_ord, form_code, name, canonical_type) AS (VALUES {_rules}),
present AS (SELECT batch_id, doc_type AS canonical_type, count(*) AS n, sum(length(doc_id) % 3 + 1) AS pages FROM papers GROUP BY 1, 2),
x AS (SELECT b.batch_id, r.*, p.n, p.pages FROM b LEFT JOIN rules r ON r.form_code IN (b.order_code, '*') LEFT JOIN present p ON p.batch_id = b.batch_id AND p.canonical_type = r.canonical_type),
g AS (SELECT batch_id, count(*) FILTER (canonical_type IS NOT NULL) AS applicable_rules, count(*) FILTER (rule_ord IS NOT NULL AND canonical_type IS NULL) AS unmapped_rules, count(*) FILTER (canonical_type IS NOT NULL AND n IS NULL) AS n_missing,
  coalesce(string_agg(name, ',' ORDER BY rule_ord) FILTER (canonical_type IS NOT NULL AND n IS NULL), '') AS missing_documents, CAST(coalesce(sum(pages), 0) AS BIGINT) AS matched_pages FROM x GROUP BY 1)
SELECT *, CASE WHEN applicable_rules = 0 THEN 'KHONG_CO_QUY_CHUAN' WHEN n_missing = 0 THEN 'HOAN_HAO' WHEN n_missing = 1 THEN 'CANH_BAO_THIEU' ELSE 'THIEU_CHUNG_TU' END AS overall_status FROM g""")
def checklist_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = view(spark, sf_dir, PAPERS).withColumn("page_count", F.length("doc_id") % 3 + 1)
    batches = papers.select("batch_id").distinct().withColumn("order_code", (F.substring("batch_id", 2, 20).cast("long") % 4).cast("string"))
    rules = spark.createDataFrame([(i, f, n, t) for i, (f, t, n) in enumerate(GUIDELINES)], "rule_ord int, form_code string, doc_type string, canonical_type string")
    return audit.checklist(papers, batches, rules)


_pages = f"pages_ AS ({sql_text(PAGES)})"
_keys = ("shipment_id", "invoice_no", "po_no", "transfer_order_no", "pxk_no")
_n_equal = " + ".join(f"CASE WHEN trim(c.{k}) = trim(h.{k}) THEN 1 ELSE 0 END" for k in _keys)
_stitched = f"""{_pages}, cand AS (SELECT c.upload_group_id, c.scan_index, h.scan_index AS header_index, {_n_equal} AS n_strong, abs(c.scan_index - h.scan_index) AS distance,
  CASE WHEN c.system <> 'COMMON' AND c.system = h.system THEN 30 WHEN h.system <> 'COMMON' THEN 10 ELSE 0 END + CASE WHEN h.scan_index = c.scan_index + 1 THEN 25 WHEN h.scan_index = c.scan_index - 1 THEN 15 ELSE -5 * abs(c.scan_index - h.scan_index) END AS rest
  FROM pages_ c JOIN pages_ h ON c.upload_group_id = h.upload_group_id AND c.doc_type = h.doc_type AND abs(c.scan_index - h.scan_index) <= 5
  WHERE c.page_role = 'CONTINUATION' AND coalesce(h.page_role, '') <> 'CONTINUATION' AND (c.system = 'COMMON' OR h.system = 'COMMON' OR c.system = h.system)
  AND NOT ({" OR ".join(f"coalesce(trim(c.{k}) <> trim(h.{k}), false)" for k in _keys)})),
scored AS (SELECT *, rest + CASE WHEN n_strong > 0 THEN 1000 + 100 * n_strong ELSE 0 END AS score FROM cand),
ranked AS (SELECT *, row_number() OVER (PARTITION BY upload_group_id, scan_index ORDER BY CASE WHEN n_strong > 0 THEN 0 ELSE 1 END, score DESC, distance, header_index) AS rank, count(*) OVER w AS n_candidates, bool_and(header_index < scan_index) OVER w AS all_before FROM scored WINDOW w AS (PARTITION BY upload_group_id, scan_index)),
told AS (SELECT p.upload_group_id, p.scan_index, r.header_index, coalesce(r.n_candidates, 0) AS n_candidates, CASE WHEN r.rank IS NULL THEN 'NO_CANDIDATE' WHEN n_strong > 0 THEN 'SHARED_KEY' WHEN r.n_candidates > 1 AND all_before THEN 'AMBIGUOUS' WHEN distance = 1 AND score >= 30 THEN 'ADJACENT' ELSE 'WEAK' END AS reason
  FROM pages_ p LEFT JOIN ranked r ON p.upload_group_id = r.upload_group_id AND p.scan_index = r.scan_index AND r.rank = 1 WHERE p.page_role = 'CONTINUATION'),
st AS (SELECT upload_group_id, scan_index, CASE WHEN reason IN ('SHARED_KEY', 'ADJACENT') THEN header_index END AS header_index, n_candidates, reason FROM told)"""


@query(f"WITH {_stitched} SELECT * FROM st")
def stitch_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitching.stitched(view(spark, sf_dir, PAGES))


_filled = ", ".join(f"coalesce(h.{k}, min_by(c.{k}, c.scan_index) FILTER (c.{k} IS NOT NULL)) AS {k}" for k in _keys)


@query(f"""WITH {_stitched}, kids AS (SELECT s.header_index, p.* FROM st s JOIN pages_ p ON p.upload_group_id = s.upload_group_id AND p.scan_index = s.scan_index WHERE s.header_index IS NOT NULL)
SELECT h.upload_group_id, h.scan_index, h.doc_type, h.system, count(c.scan_index) + 1 AS page_count, {_filled}
FROM pages_ h LEFT JOIN kids c ON c.upload_group_id = h.upload_group_id AND c.header_index = h.scan_index WHERE coalesce(h.page_role, '') <> 'CONTINUATION'
GROUP BY h.upload_group_id, h.scan_index, h.doc_type, h.system, {", ".join("h." + k for k in _keys)}""")
def stitched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitching.stitched_documents(view(spark, sf_dir, PAGES))


_near = "(length(m.shipment_id) = length(p.shipment_id) AND hamming(m.shipment_id, p.shipment_id) <= 2 OR starts_with(m.shipment_id, p.shipment_id) OR starts_with(p.shipment_id, m.shipment_id))"
_clash = f"CASE WHEN m.po_no <> p.po_no THEN 'po_no' WHEN m.invoice_no <> p.invoice_no THEN 'invoice_no' WHEN m.shipment_id IS NOT NULL AND p.shipment_id IS NOT NULL AND NOT {_near} THEN 'shipment_id' END"
_runs = f"""{_pages}, p AS (SELECT *, row_number() OVER (PARTITION BY upload_group_id ORDER BY scan_index) AS rn, action <> 'YEU_CAU_CHUP_LAI' AS ok, {{'po_no': po_no, 'invoice_no': invoice_no, 'shipment_id': shipment_id}} AS keys FROM pages_),
fold AS (SELECT upload_group_id, rn, scan_index, doc_type, ok, [keys] AS members, 0 AS number, 'START' AS split_reason FROM p WHERE rn = 1
UNION ALL SELECT upload_group_id, rn, scan_index, doc_type, ok, CASE WHEN reason = 'JOINED' THEN list_append(members, keys) ELSE [keys] END, number + CASE WHEN reason = 'JOINED' THEN 0 ELSE 1 END, reason FROM (
  SELECT p.upload_group_id, p.rn, p.scan_index, p.doc_type, p.ok, p.keys, f.members, f.number, CASE WHEN NOT p.ok OR NOT f.ok THEN 'NOT_ELIGIBLE' WHEN p.doc_type <> f.doc_type THEN 'DOC_TYPE_CHANGE' WHEN p.scan_index <> f.scan_index + 1 THEN 'SCAN_INDEX_GAP'
    ELSE coalesce('KEY_FIELD_CONFLICT(' || list_filter(list_transform(f.members, lambda m: {_clash}), lambda x: x IS NOT NULL)[1] || ')', 'JOINED') END AS reason
  FROM fold f JOIN p ON p.upload_group_id = f.upload_group_id AND p.rn = f.rn + 1)),
runs AS (SELECT p.*, concat(p.upload_group_id, '#', f.number) AS cluster_id, f.split_reason, count(*) OVER (PARTITION BY p.upload_group_id, f.number) AS cluster_size FROM p JOIN fold f USING (upload_group_id, rn))"""


@query(f"WITH RECURSIVE {_runs} SELECT upload_group_id, scan_index, cluster_id, split_reason, cluster_size FROM runs")
def upload_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitching.voting_runs(view(spark, sf_dir, PAGES)).select("upload_group_id", "scan_index", "cluster_id", "split_reason", "cluster_size")


def _best(field: str, longer: bool = False) -> str:
    order = f"n DESC, length({field}) DESC, seen" if longer else "n DESC, seen"
    return f"b_{field} AS (SELECT cluster_id, {field} AS best_{field} FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {order}) AS k FROM (SELECT cluster_id, {field}, count(*) AS n, min(scan_index) AS seen FROM runs WHERE {field} IS NOT NULL GROUP BY 1, 2)) WHERE k = 1)"


@query(f"""WITH RECURSIVE {_runs}, {_best('invoice_no')}, {_best('shipment_id', True)}, {_best('po_no')}
SELECT upload_group_id, scan_index, cluster_id, CASE WHEN doc_type = 'HOA_DON' THEN coalesce(invoice_no, best_invoice_no) ELSE invoice_no END AS voted_invoice_no,
  CASE WHEN shipment_id IS NULL THEN CASE WHEN doc_type = 'HOA_DON' THEN best_shipment_id END WHEN shipment_id <> best_shipment_id AND (length(shipment_id) = length(best_shipment_id) AND hamming(shipment_id, best_shipment_id) <= 2 OR length(shipment_id) < length(best_shipment_id) AND starts_with(best_shipment_id, shipment_id)) THEN best_shipment_id ELSE shipment_id END AS voted_shipment_id,
  CASE WHEN doc_type IN ('PO', 'TABLE_CONTINUATION') THEN coalesce(po_no, best_po_no) ELSE po_no END AS voted_po_no
FROM runs LEFT JOIN b_invoice_no USING (cluster_id) LEFT JOIN b_shipment_id USING (cluster_id) LEFT JOIN b_po_no USING (cluster_id)""")
def vote_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = stitching.voting_runs(view(spark, sf_dir, PAGES))
    return stitching.voted(runs).select("upload_group_id", "scan_index", "cluster_id", "voted_invoice_no", "voted_shipment_id", "voted_po_no")


EXCEPTIONS = [(1, "R1", "po_no", "P31", "3.1", [], []), (2, "R2", "invoice_no", "I45", "3.2", ["COOP"], []), (3, "R3", "invoice_no", "I100", "3.3", [], ["I100"]), (4, "R4", "po_no", "P12", "3.4", ["BHX"], ["I10", "I20"])]
_exceptions = ", ".join(f"({o}, '{i}', '{t}', '{v}', '{c}', {s}, {x})" for o, i, t, v, c, s, x in [(*e[:5], e[5] or "CAST([] AS VARCHAR[])", e[6] or "CAST([] AS VARCHAR[])") for e in EXCEPTIONS])


@query(f"""WITH docs AS ({sql_text(SHIPPED)}), ex(rule_ord, rule_id, kt, kv, order_code, xs, xi) AS (VALUES {_exceptions}),
hit AS (SELECT d.doc_id, e.*, row_number() OVER (PARTITION BY d.doc_id ORDER BY rule_ord) AS k FROM docs d JOIN ex e ON (e.kt = 'po_no' AND e.kv = d.po_no OR e.kt = 'invoice_no' AND e.kv = d.invoice_no) WHERE NOT list_contains(xs, d.system) AND NOT coalesce(list_contains(xi, d.invoice_no), false))
SELECT doc_id, rule_id, order_code FROM hit WHERE k = 1""")
def business_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "rule_ord int, rule_id string, key_type string, key_value string, order_code string, excluded_systems array<string>, excluded_invoices array<string>"
    return batching.matched_rules(view(spark, sf_dir, SHIPPED), spark.createDataFrame(EXCEPTIONS, schema))


@query(f"""WITH {_papers}, r AS (SELECT batch_id, doc_id, doc_type FROM papers)
SELECT batch_id, concat('{{"batch_id":"', batch_id, '","n":', count(*), ',"documents":[', string_agg(concat('{{"doc_id":"', doc_id, '","doc_type":"', doc_type, '"}}'), ',' ORDER BY doc_id, doc_type), ']}}') AS manifest FROM r GROUP BY batch_id""")
def batch_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(view(spark, sf_dir, PAPERS), "batch_id", "doc_id", "doc_type")
