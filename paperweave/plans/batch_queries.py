"""Queries on documents in shipment batches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.operators import audit, batching, identity
from paperweave.plans.document_queries import _evidence, _papers
from paperweave.plans.fixtures import SHIPPED, sql_text, view
from paperweave.plans.identity_queries import _rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Orders as documents to be batched, with recalls, general forms, slips that a rule knows, and systems with one, several, shared and no shipments.
ROUTED = """SELECT doc_id, position, CASE position % 41 WHEN 1 THEN 'BB_THU_HOI' WHEN 3 THEN 'BB_NO_HANG' WHEN 5 THEN 'LENH_DIEU_XE' WHEN 7 THEN 'PHIEU_XUAT_HANG' WHEN 9 THEN 'BBBG_HOADON' ELSE doc_type END AS doc_type,
  CASE position % 23 WHEN 4 THEN 'KHO_THUE' WHEN 8 THEN 'LOTTE' WHEN 12 THEN 'MM' WHEN 15 THEN 'AEON' ELSE system END AS system, CASE position % 4 WHEN 0 THEN 'LG/A Đề xuất' WHEN 1 THEN 'lg/b' WHEN 2 THEN 'LG/A LG/B' ELSE 'none' END AS doc_keyword,
  CASE WHEN position % 41 = 1 AND position % 3 = 0 THEN '912' WHEN position % 23 IN (8, 12, 15) THEN CASE WHEN position % 23 = 8 AND position % 5 = 0 THEN '73' WHEN position % 23 = 15 AND position % 5 = 0 THEN CAST(800 + position % 2 AS {string}) END ELSE shipment_id END AS shipment_id,
  CASE WHEN position % 23 NOT IN (8, 12, 15) THEN transfer_order_no END AS transfer_order_no, po_no, invoice_no, pxk_no
FROM (""" + SHIPPED + """) AS shipped"""
EXCEPTIONS = [(1, "E1", "shipment_id", "72", "2.2", "NPP", ["COOP"], ["I7"]), (2, "E2", "shipment_id", "72", "2.1", "GT2", None, None), (3, "E3", "po_no", "P20", "3.1", "BHX", None, ["I15"]), (4, "E5", "invoice_no", "I60", "5.1", "KHO_THUE", None, None)]
ALIASES = [(1, "76", ["77", "82"], "2.4", "COMMON"), (2, "103", ["82", "104"], "5.2", "KHO_THUE")]
TYPE_RULES = [(1, "T1", "BBBG_HOADON", None, "2.2", "E1"), (2, "T2", "PHIEU_XUAT_HANG", "BHX", "5.1", "E9")]
DOMAIN_RULES = [(1, "D1", "PHIEU_XUAT_HANG", "KHO_THUE", None, "E9", None), (2, "D2", "PHIEU_XUAT_HANG", None, "LG/A", "E5", "SLIP_RULE"), (3, "D3", None, "KHO_THUE", "lg/b", "E3", None), (4, "D4", "BB_THU_HOI", "NPP", "LG/A LG", "E1", None)]
VARIANTS = {"BB_THU_HOI": [identity.Variant("4.1", "BATCH_4.1", "4.1", "COOP", ("LG/A",)), identity.Variant("4.2", "BATCH_4.2", "4.2", "NPP", ("LG/B", "đề xuất X"))]}
CODES = {"BHX": "3.2", "COOP": "3.1", "KHO_THUE": "5.1"}
#: ord, form_code, name and canonical type of guideline rows.
GUIDELINES = [(0, "3.1", "order", "PO"), (1, "3.1", "invoice", "HOA_DON"), (2, "3.2", "invoice", "HOA_DON"), (3, "3.2", "transfer slip", "PXKKVCNB"), (4, "CHUNG", "stamp sheet", None), (5, "2.3", "gate pass", None), (6, "3.x", "delivery note", "PHIEU_GIAO_HANG"), (7, "3.x", "second note", "PHIEU_GIAO_HANG"), (8, "*", "loading plan", "LOADING_PLAN")]

_code = "CASE {s} WHEN 'BHX' THEN '3.2' WHEN 'COOP' THEN '3.1' WHEN 'KHO_THUE' THEN '5.1' ELSE {other} END"
_no = "'COMMON', 'GENERAL', 'NPP'"


def _told(batch: str, code: str, system: str, kind: str, value: str, sure: str) -> str:
    return f"{{'b': {batch}, 'c': {code}, 's': {system}, 't': {kind}, 'v': {value}, 'k': {sure}}}"


_named = f"""d AS ({sql_text(ROUTED)}), e(ord, rule_id, key_type, key_value, order_code, system, xs, xi) AS (VALUES {_rows(EXCEPTIONS)}),
al(ord, primary_id, secondary_ids, order_code, system) AS (VALUES {_rows(ALIASES)}), tr(ord, rule_id, doc_type, system, order_code, eid) AS (VALUES {_rows(TYPE_RULES)}), dr(ord, rule_id, doc_type, system, keyword, eid, kind) AS (VALUES {_rows(DOMAIN_RULES)}),
t1 AS (SELECT tr.doc_type, arg_min({_told("'SHIP_' || e.key_value || '_' || e.system", 'tr.order_code', 'e.system', "'DOC_TYPE_RULE'", 'tr.order_code', "'HIGH'")}, tr.ord) AS x FROM tr JOIN e ON e.rule_id = tr.eid GROUP BY 1),
t2 AS (SELECT d.doc_id, arg_min({_told("'SHIP_' || e.key_value || '_' || e.system", 'e.order_code', 'e.system', 'upper(e.key_type)', 'e.key_value', "'HIGH'")}, e.ord) AS x FROM d JOIN e ON e.key_value = CASE e.key_type WHEN 'shipment_id' THEN d.shipment_id WHEN 'po_no' THEN d.po_no WHEN 'invoice_no' THEN d.invoice_no END
  WHERE NOT coalesce(list_contains(e.xs, d.system), false) AND NOT coalesce(list_contains(e.xi, d.invoice_no), false) GROUP BY 1),
t3 AS (SELECT d.doc_id, arg_min({_told("'SHIP_' || primary_id || '_' || al.system", 'al.order_code', 'al.system', "'SHIPMENT_ALIAS'", 'primary_id', "'HIGH'")}, al.ord) AS x FROM d JOIN al ON d.shipment_id = primary_id OR list_contains(secondary_ids, d.shipment_id) OR d.transfer_order_no = primary_id OR list_contains(secondary_ids, d.transfer_order_no) GROUP BY 1),
v AS (SELECT *, CASE WHEN doc_type = 'BB_THU_HOI' THEN contains(doc_keyword, 'LG/A') END AS va, CASE WHEN doc_type = 'BB_THU_HOI' THEN contains(upper(doc_keyword), 'LG/B') END AS vb FROM d),
i AS (SELECT v.*, CASE WHEN v.doc_type = 'BB_THU_HOI' THEN CASE WHEN va AND NOT vb THEN {_told("'BATCH_4.1'", "'4.1'", "'COOP'", "'BUSINESS_DOC'", "'4.1'", "'MEDIUM'")} WHEN vb AND NOT va THEN {_told("'BATCH_4.2'", "'4.2'", "'NPP'", "'BUSINESS_DOC'", "'4.2'", "'MEDIUM'")} END
  WHEN v.doc_type = 'BB_NO_HANG' THEN {_told("'BATCH_6.x_GENERAL'", "'6.x'", "'GENERAL'", "'BUSINESS_DOC'", "'6.x'", "'MEDIUM'")} WHEN v.doc_type = 'LENH_DIEU_XE' THEN {_told("'BATCH_CHUNG_GENERAL'", "'CHUNG'", "'GENERAL'", "'BUSINESS_DOC'", "'CHUNG'", "'LOW'")}
  ELSE coalesce(t1.x, t2.x, t3.x, CASE WHEN transfer_order_no IS NOT NULL THEN {_told("'SHIP_' || transfer_order_no || '_' || v.system", _code.format(s='v.system', other="CASE WHEN contains(v.system, 'KHO') THEN '5.x' ELSE '2.3' END"), 'v.system', "'TRANSFER_ORDER'", 'transfer_order_no', "'HIGH'")} END,
    CASE WHEN shipment_id IS NOT NULL THEN {_told("'SHIP_' || shipment_id || '_' || v.system", _code.format(s='v.system', other="'CHUNG'"), 'v.system', "'SHIPMENT_ID'", 'shipment_id', "'HIGH'")} END) END AS x
  FROM v LEFT JOIN t1 ON t1.doc_type = v.doc_type LEFT JOIN t2 ON t2.doc_id = v.doc_id LEFT JOIN t3 ON t3.doc_id = v.doc_id)"""
_known = f"""{_named},
named AS (SELECT x.b AS batch_id, arg_min(x, position) AS h FROM i WHERE x IS NOT NULL GROUP BY 1),
multi AS (SELECT h.v AS val, list_sort(list(DISTINCT h.s)) AS systems FROM named WHERE h.t IN ('SHIPMENT_ID', 'TRANSFER_ORDER') GROUP BY 1 HAVING count(DISTINCT h.s) > 1)"""
_batches = f"""{_known},
own AS (SELECT batch_id, h, h.t IN ('SHIPMENT_ID', 'TRANSFER_ORDER') AND h.v IN (SELECT val FROM multi) AS shared FROM named),
opened AS (SELECT doc_id, position, {_told(f"'BATCH_' || {_code.format(s='system', other=chr(39) + '3.x' + chr(39))} || '_' || system", _code.format(s='system', other="'3.x'"), 'system', "'BUSINESS_KEY'", 'po_no', "'HIGH'")} AS x
  FROM (SELECT *, row_number() OVER (PARTITION BY system ORDER BY position) AS k FROM i WHERE x IS NULL AND po_no IS NOT NULL AND system IN ('BHX', 'WINMART', 'EMART') AND system NOT IN (SELECT h.s FROM own WHERE NOT shared)) WHERE k = 1),
anchors AS (SELECT doc_id, position, x, 0 AS lvl FROM i WHERE x IS NOT NULL UNION ALL SELECT doc_id, position, x, 1 FROM opened),
lev AS (SELECT d.*, coalesce(a.lvl, 2) AS lvl FROM d LEFT JOIN anchors a USING (doc_id)),
keyed AS (SELECT *, 0 AS kt, po_no AS kv FROM lev WHERE po_no IS NOT NULL UNION ALL SELECT *, 1, invoice_no FROM lev WHERE invoice_no IS NOT NULL),
edges AS (SELECT d.doc_id, a.doc_id AS parent, a.lvl, a.position, min(d.kt) AS kt FROM keyed d JOIN keyed a ON d.kt = a.kt AND d.kv = a.kv WHERE d.lvl = 2 AND d.doc_id <> a.doc_id AND (a.lvl < 2 OR a.position < d.position) AND (d.system = 'COMMON' OR a.system = 'COMMON' OR d.system = a.system) AND coalesce(d.shipment_id = a.shipment_id, true) GROUP BY 1, 2, 3, 4),
reached AS (SELECT doc_id FROM anchors UNION SELECT e.doc_id FROM edges e JOIN reached r ON e.parent = r.doc_id),
parents AS (SELECT doc_id, parent, kt FROM (SELECT e.*, row_number() OVER (PARTITION BY e.doc_id ORDER BY lvl, position) AS k FROM edges e WHERE parent IN (SELECT doc_id FROM reached)) WHERE k = 1),
tree AS (SELECT doc_id, x, 0 AS depth FROM anchors UNION ALL SELECT p.doc_id, {_told('t.x.b', 't.x.c', 't.x.s', "'RELATIONSHIP_PROPAGATION'", 'CASE p.kt WHEN 0 THEN d.po_no ELSE d.invoice_no END', "'HIGH'")}, t.depth + 1 FROM parents p JOIN tree t ON p.parent = t.doc_id JOIN d ON d.doc_id = p.doc_id),
known AS (SELECT batch_id, h, shared FROM own UNION ALL SELECT x.b, x, false FROM opened),
ctx AS (SELECT h.s AS system, count(*) FILTER (NOT shared) AS n_own, count(*) FILTER (shared) AS n_shared, arg_min(h, batch_id) FILTER (NOT shared) AS target FROM known WHERE NOT starts_with(batch_id, 'BATCH_4.') GROUP BY 1),
held AS (SELECT DISTINCT t.x.b AS batch_id, k.doc_type, k.kt, k.kv FROM tree t JOIN keyed k USING (doc_id)),
clash AS (SELECT k.doc_id, min(CASE k.kt WHEN 1 THEN 0 ELSE 1 END) AS f FROM keyed k JOIN ctx c ON c.system = k.system AND c.n_own = 1 WHERE EXISTS (SELECT 1 FROM held h WHERE h.batch_id = c.target.b AND h.doc_type = k.doc_type AND h.kt = k.kt)
  AND NOT EXISTS (SELECT 1 FROM held g WHERE g.batch_id = c.target.b AND g.doc_type = k.doc_type AND g.kt = k.kt AND g.kv = k.kv) GROUP BY 1),
ruled AS (SELECT v.doc_id, arg_min({{'x': {_told("'SHIP_' || e.key_value || '_' || e.system", 'e.order_code', 'e.system', "coalesce(dr.kind, 'DOMAIN_RULE')", 'e.key_value', "'HIGH'")}, 'r': dr.rule_id}}, dr.ord) AS r FROM v JOIN dr ON (dr.doc_type IS NULL OR dr.doc_type = v.doc_type) AND (dr.system IS NULL OR dr.system = v.system) AND (dr.keyword IS NULL OR contains(v.doc_keyword, dr.keyword)) JOIN e ON e.rule_id = dr.eid GROUP BY 1),
bl AS (SELECT v.doc_id, list_sort(list(DISTINCT q.rule_id)) AS blocked FROM v JOIN (SELECT rule_id, doc_type, system, eid FROM tr UNION ALL SELECT rule_id, doc_type, system, eid FROM dr) q ON (q.doc_type IS NULL OR q.doc_type = v.doc_type) AND (q.system IS NULL OR q.system = v.system) WHERE q.eid NOT IN (SELECT rule_id FROM e) GROUP BY 1),
why AS (SELECT v.*, c.target, CASE WHEN v.doc_type = 'BB_THU_HOI' THEN CASE WHEN va OR vb THEN 'FORM_VARIANT_AMBIGUOUS' ELSE 'FORM_VARIANT_UNRESOLVED' END WHEN v.doc_type = 'HOA_DON' AND coalesce(shipment_id, transfer_order_no, po_no, invoice_no, pxk_no) IS NULL THEN 'BLANK_INVOICE_NO_KEY_FIELDS'
  WHEN v.system IN ({_no}) THEN 'SYSTEM_CONTEXT_NOT_APPLICABLE' WHEN n_own = 1 AND shipment_id <> c.target.v THEN 'SHIPMENT_ID_CONFLICT_WITH_SYSTEM_CONTEXT' WHEN n_own = 1 AND clash.f IS NOT NULL THEN 'IDENTIFIER_CONFLICT_WITH_SYSTEM_CONTEXT'
  WHEN n_own = 1 AND v.doc_type NOT IN ('LOADING_PLAN', 'PHIEU_GIAO_HANG', 'PO', 'HOA_DON', 'PHIEU_NHAP_KHO') THEN 'DOC_TYPE_NOT_ELIGIBLE_FOR_SYSTEM_CONTEXT' WHEN n_own = 1 THEN NULL WHEN n_own > 1 THEN 'AMBIGUOUS_SYSTEM_CONTEXT' WHEN n_shared > 0 THEN 'MULTI_SYSTEM_SHIPMENT_CONTEXT' ELSE 'NO_ANCHORED_BATCH_FOR_SYSTEM' END AS reason,
  n_own, n_shared, clash.f, ruled.r, bl.blocked FROM v LEFT JOIN ctx c USING (system) LEFT JOIN clash USING (doc_id) LEFT JOIN ruled USING (doc_id) LEFT JOIN bl USING (doc_id) WHERE v.doc_id NOT IN (SELECT doc_id FROM tree)),
placed AS (SELECT *, CASE WHEN reason IS NULL THEN {_told('target.b', 'target.c', 'system', "'SYSTEM_CONTEXT_PROPAGATION'", 'target.v', "'MEDIUM'")} WHEN r IS NOT NULL THEN r.x ELSE {_told("'UNRESOLVED_' || doc_id", "'CHUNG'", 'system', "'UNRESOLVED'", 'doc_id', "'LOW'")} END AS x, reason IS NOT NULL AND r IS NULL AS isolated FROM why),
told AS (SELECT doc_id, x, CASE depth WHEN 0 THEN '1' ELSE '2' END AS pass, CAST(NULL AS VARCHAR) AS rule_id, CAST(NULL AS VARCHAR) AS warning, CAST(NULL AS VARCHAR) AS isolation_reason, CAST(NULL AS BIGINT) AS n_candidates, CAST(NULL AS VARCHAR) AS conflict_field, CAST(NULL AS VARCHAR[]) AS blocked FROM tree
UNION ALL SELECT doc_id, x, CASE WHEN reason IS NULL THEN '3.2' WHEN r IS NOT NULL THEN '3.3' ELSE '4' END, CASE WHEN reason IS NOT NULL THEN r.r END, CASE WHEN reason IS NULL THEN 'SINGLE_KNOWN_ANCHOR_ASSUMPTION' END, CASE WHEN isolated THEN reason END,
  CASE WHEN isolated THEN CASE reason WHEN 'FORM_VARIANT_AMBIGUOUS' THEN 2 WHEN 'FORM_VARIANT_UNRESOLVED' THEN 2 WHEN 'BLANK_INVOICE_NO_KEY_FIELDS' THEN 0 WHEN 'SYSTEM_CONTEXT_NOT_APPLICABLE' THEN coalesce(n_own + n_shared, 0) WHEN 'AMBIGUOUS_SYSTEM_CONTEXT' THEN n_own WHEN 'MULTI_SYSTEM_SHIPMENT_CONTEXT' THEN n_shared WHEN 'NO_ANCHORED_BATCH_FOR_SYSTEM' THEN 0 ELSE 1 END END,
  CASE WHEN isolated AND reason = 'IDENTIFIER_CONFLICT_WITH_SYSTEM_CONTEXT' THEN CASE f WHEN 0 THEN 'invoice_no' ELSE 'po_no' END END, CASE WHEN isolated THEN blocked END FROM placed)"""


def references(spark: SparkSession) -> batching.References:
    return batching.References(
        spark.createDataFrame(TYPE_RULES, "ord int, rule_id string, doc_type string, system string, order_code string, exception_rule_id string"),
        spark.createDataFrame(EXCEPTIONS, "ord int, rule_id string, key_type string, key_value string, order_code string, system string, excluded_systems array<string>, excluded_invoices array<string>"),
        spark.createDataFrame(ALIASES, "ord int, primary_id string, secondary_ids array<string>, order_code string, system string"),
        spark.createDataFrame(DOMAIN_RULES, "ord int, rule_id string, doc_type string, system string, keyword string, exception_rule_id string, identity_type string"),
        VARIANTS, CODES,
    )


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.assignments(view(spark, sf_dir, ROUTED), references(spark))


@query(f"""WITH RECURSIVE {_batches} SELECT doc_id, x.b AS batch_id, x.c AS order_code, x.s AS batch_system, x.t AS identity_type, x.v AS identity_value, x.k AS confidence, pass, rule_id, warning, isolation_reason, n_candidates, conflict_field, array_to_string(blocked, ',') AS blocked FROM told""")
def batch_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).withColumn("blocked", F.array_join("blocked", ","))


@query(f"WITH RECURSIVE {_batches} SELECT pass, coalesce(isolation_reason, 'ASSIGNED') AS reason, count(*) AS n_docs, count(DISTINCT x.b) AS n_batches FROM told GROUP BY 1, 2")
def isolation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _assigned(spark, sf_dir)
    return rows.groupBy("pass", F.coalesce("isolation_reason", F.lit("ASSIGNED")).alias("reason")).agg(F.count("*").alias("n_docs"), F.count_distinct("batch_id").alias("n_batches"))


def _named_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = references(spark)
    rules, exceptions, aliases, _ = refs.tables(spark)
    named = identity.direct_identity(view(spark, sf_dir, ROUTED), rules.drop("system", "rule_id"), exceptions, aliases, refs.variants, refs.codes)
    return batching.known_batches(named.filter("batch_id is not null"))


@query(f"WITH {_known} SELECT val AS identity_value, array_to_string(systems, ',') AS systems FROM multi")
def multi_system_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.systems_of_identity(_named_batches(spark, sf_dir)).select("identity_value", F.array_join("systems", ",").alias("systems"))


@query(f"WITH {_known} SELECT h.s AS system, batch_id, h.t IN ('SHIPMENT_ID', 'TRANSFER_ORDER') AND h.v IN (SELECT val FROM multi) AS shared FROM named WHERE NOT starts_with(batch_id, 'BATCH_4.')")
def batch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.candidates(_named_batches(spark, sf_dir))


_rules = ", ".join(f"({o}, '{f}', '{n}', {repr(t) if t else 'NULL'})" for o, f, n, t in GUIDELINES)
_papered = f"""WITH RECURSIVE {_batches.replace("d AS (", "d0 AS (", 1).replace("), e(ord", "), d AS (SELECT * FROM d0), e(ord", 1)}, docs AS (SELECT d.*, told.x, told.pass, told.x.b AS batch_id FROM d JOIN told USING (doc_id)),
keys AS (SELECT batch_id, doc_id, 'p' || po_no AS key FROM docs WHERE po_no IS NOT NULL UNION SELECT batch_id, doc_id, 'i' || invoice_no FROM docs WHERE invoice_no IS NOT NULL),
edge AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM keys a JOIN keys b USING (batch_id, key)),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM docs UNION SELECT reach.node, edge.b FROM reach JOIN edge ON edge.a = reach.seen),
papers AS (SELECT docs.*, dossier_id FROM docs JOIN (SELECT node AS doc_id, min(seen) AS dossier_id FROM reach GROUP BY 1) USING (doc_id))"""
_audited = f"""{_papered},
{_evidence[len(_papers) + 2:]},
ec AS (SELECT dossier_id, count(*) AS n_evidence, bool_or(status = 'MISMATCH') AS mis, bool_or(status IN ('MATCH', 'PARTIAL_MATCH')) AS mat, bool_or(status LIKE 'MISSING%') AS gone FROM ev GROUP BY 1),
dos AS (SELECT batch_id, dossier_id, count(*) AS n_docs FROM papers GROUP BY 1, 2),
agg AS (SELECT batch_id, count(*) AS n_dossiers, CAST(sum(coalesce(n_evidence, 0)) AS BIGINT) AS n_evidence, count(*) FILTER (mis) AS n_conflicts, count(*) FILTER (NOT mis AND mat AND NOT gone) AS n_whole FROM dos LEFT JOIN ec USING (dossier_id) GROUP BY 1),
heads AS (SELECT batch_id, count(*) AS n_docs, coalesce(arg_max(x, position) FILTER (x.k = 'HIGH'), arg_min(x, position)) AS x FROM papers GROUP BY 1),
rules(rule_ord, form_code, name, canonical_type) AS (VALUES {_rules}), present AS (SELECT DISTINCT batch_id, doc_type AS canonical_type FROM docs),
chk AS (SELECT b.batch_id, r.*, p.batch_id IS NOT NULL AS there FROM heads b LEFT JOIN rules r ON r.form_code IN (b.x.c, '*') LEFT JOIN present p ON p.batch_id = b.batch_id AND p.canonical_type = r.canonical_type),
g AS (SELECT batch_id, count(*) FILTER (canonical_type IS NOT NULL) AS n_rules, count(*) FILTER (canonical_type IS NOT NULL AND NOT there) AS n_missing, coalesce(string_agg(name, ',' ORDER BY rule_ord) FILTER (canonical_type IS NOT NULL AND NOT there), '') AS missing_documents FROM chk GROUP BY 1)
SELECT h.batch_id, h.n_docs, h.x.c AS order_code, h.x.s AS batch_system, h.x.t AS identity_type, h.x.v AS identity_value, h.x.k AS confidence, agg.* EXCLUDE (batch_id), n_missing, missing_documents, CASE WHEN n_rules = 0 THEN 'KHONG_CO_QUY_CHUAN' WHEN n_missing = 0 THEN 'HOAN_HAO' WHEN n_missing = 1 THEN 'CANH_BAO_THIEU' ELSE 'THIEU_CHUNG_TU' END AS overall_status
FROM heads h JOIN agg USING (batch_id) JOIN g USING (batch_id)"""


def _audit(spark: SparkSession, sf_dir: str) -> audit.Audit:
    guidelines = spark.createDataFrame([(o, f, n, t) for o, f, n, t in GUIDELINES], "rule_ord int, form_code string, doc_type string, canonical_type string")
    return audit.audited(view(spark, sf_dir, ROUTED).withColumn("page_count", F.lit(1)), references(spark), guidelines)


@query(_audited)
def audited_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to batches to dossiers to evidence and checklist, each on what the last gave."""
    return _audit(spark, sf_dir).batches


@query(f"""{_papered} SELECT batch_id, p.doc_id, concat('{{"batch_id":"', batch_id, '","doc_id":"', p.doc_id, '","doc_type":"', doc_type, '","dossier_id":"', dossier_id, '","pass":"', p.pass, '","identity_type":"', p.x.t, '","confidence":"', p.x.k, '"',
  coalesce(',"warning":"' || warning || '"', ''), coalesce(',"isolation_reason":"' || isolation_reason || '"', ''), '}}') AS line FROM papers p JOIN told USING (doc_id)""")
def audit_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.manifest_lines(_audit(spark, sf_dir).documents)
