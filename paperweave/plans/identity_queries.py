"""Queries on the identity of batches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.operators import identity
from paperweave.plans.fixtures import SHIPPED, sql_text, table, view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Orders as documents with forms, transfers and recalls among them.
NAMED = """SELECT doc_id, position, CASE position % 17 WHEN 1 THEN 'BB_THU_HOI' WHEN 3 THEN 'BB_NO_HANG' WHEN 5 THEN 'BBBG_PALLET' WHEN 7 THEN 'LENH_DIEU_XE' WHEN 9 THEN 'BBBG_HOADON' WHEN 11 THEN 'PHIEU_XUAT_HANG' ELSE doc_type END AS doc_type,
  CASE position % 5 WHEN 0 THEN 'KHO_THUE' ELSE system END AS system, CASE position % 4 WHEN 0 THEN 'LG/A Đề xuất' WHEN 1 THEN 'lg/b' WHEN 2 THEN 'LG/A LG/B' ELSE 'none' END AS doc_keyword,
  coalesce(shipment_id, CASE WHEN position % 3 = 0 THEN CAST(70 + position % 50 AS {string}) END) AS shipment_id, coalesce(transfer_order_no, CASE WHEN position % 11 = 0 THEN CAST(100 + position % 9 AS {string}) END) AS transfer_order_no, po_no, invoice_no, pxk_no
FROM (""" + SHIPPED + """) AS shipped"""
EXCEPTIONS = [(1, "E1", "shipment_id", "72", "2.2", "NPP", ["COOP"], ["I7"]), (2, "E2", "shipment_id", "72", "2.1", "GT2", None, None), (3, "E3", "po_no", "P20", "3.1", "BHX", None, ["I15"]), (4, "E5", "invoice_no", "I60", "5.1", "KHO_THUE", None, None)]
ALIASES = [(1, "80", ["81", "82"], "2.4", "COOP"), (2, "103", ["82", "104"], "5.2", "KHO_THUE")]
TYPE_RULES = [(1, "T1", "BBBG_HOADON", None, "2.2", "E1"), (2, "T2", "PHIEU_XUAT_HANG", None, "5.1", "E9"), (3, "T3", "PHIEU_XUAT_HANG", None, "5.3", "E5"), (4, "T4", "PO", "COOP", "9.9", "E8"), (5, "T5", None, "KHO_THUE", "9.8", "E9")]
VARIANTS = {"BB_THU_HOI": [identity.Variant("4.1", "BATCH_4.1", "4.1", "COOP", ("LG/A",)), identity.Variant("4.2", "BATCH_4.2", "4.2", "NPP", ("LG/B", "đề xuất X"))]}
CODES = {"BHX": "3.2", "COOP": "3.1", "KHO_THUE": "5.1"}


def _lit(x) -> str:
    return "NULL" if x is None else f"[{', '.join(map(_lit, x))}]" if isinstance(x, list) else f"'{x}'" if isinstance(x, str) else str(x)


def _rows(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(map(_lit, r))})" for r in rows)


_TABLES = f"""d AS ({sql_text(NAMED)}), e(ord, rule_id, key_type, key_value, order_code, system, xs, xi) AS (VALUES {_rows(EXCEPTIONS)}),
al(ord, primary_id, secondary_ids, order_code, system) AS (VALUES {_rows(ALIASES)}), tr(ord, rule_id, doc_type, system, order_code, eid) AS (VALUES {_rows(TYPE_RULES)})"""
_IDENTITY = f"""{_TABLES},
t AS (SELECT tr.doc_type, arg_min({{'b': 'SHIP_' || e.key_value || '_' || e.system, 'c': tr.order_code, 's': e.system, 't': 'DOC_TYPE_RULE', 'v': tr.order_code, 'k': 'HIGH'}}, tr.ord) AS x FROM tr JOIN e ON e.rule_id = tr.eid WHERE tr.doc_type IS NOT NULL AND tr.system IS NULL GROUP BY 1),
x AS (SELECT d.doc_id, arg_min({{'b': 'SHIP_' || e.key_value || '_' || e.system, 'c': e.order_code, 's': e.system, 't': upper(e.key_type), 'v': e.key_value, 'k': 'HIGH'}}, e.ord) AS x FROM d JOIN e ON e.key_value = CASE e.key_type WHEN 'shipment_id' THEN d.shipment_id WHEN 'po_no' THEN d.po_no WHEN 'invoice_no' THEN d.invoice_no END
  WHERE NOT coalesce(list_contains(e.xs, d.system), false) AND NOT coalesce(list_contains(e.xi, d.invoice_no), false) GROUP BY 1),
l AS (SELECT d.doc_id, arg_min({{'b': 'SHIP_' || primary_id || '_' || al.system, 'c': al.order_code, 's': al.system, 't': 'SHIPMENT_ALIAS', 'v': primary_id, 'k': 'HIGH'}}, al.ord) AS x FROM d JOIN al ON d.shipment_id = primary_id OR list_contains(secondary_ids, d.shipment_id) OR d.transfer_order_no = primary_id OR list_contains(secondary_ids, d.transfer_order_no) GROUP BY 1),
r AS (SELECT d.*, CASE WHEN d.doc_type = 'BB_THU_HOI' THEN CASE WHEN contains(doc_keyword, 'LG/A') AND NOT contains(upper(doc_keyword), 'LG/B') THEN {{'b': 'BATCH_4.1', 'c': '4.1', 's': 'COOP', 't': 'BUSINESS_DOC', 'v': '4.1', 'k': 'MEDIUM'}} WHEN contains(upper(doc_keyword), 'LG/B') AND NOT contains(doc_keyword, 'LG/A') THEN {{'b': 'BATCH_4.2', 'c': '4.2', 's': 'NPP', 't': 'BUSINESS_DOC', 'v': '4.2', 'k': 'MEDIUM'}} END
  WHEN d.doc_type IN ('BB_NO_HANG', 'BB_TRA_HANG') THEN {{'b': 'BATCH_6.x_GENERAL', 'c': '6.x', 's': 'GENERAL', 't': 'BUSINESS_DOC', 'v': '6.x', 'k': 'MEDIUM'}} WHEN d.doc_type = 'BBBG_PALLET' THEN {{'b': 'BATCH_PALLET_GENERAL', 'c': 'PALLET', 's': 'GENERAL', 't': 'BUSINESS_DOC', 'v': 'PALLET', 'k': 'MEDIUM'}}
  WHEN d.doc_type IN ('LENH_DIEU_XE', 'BIEU_DO_NHIET_DO') THEN {{'b': 'BATCH_CHUNG_GENERAL', 'c': 'CHUNG', 's': 'GENERAL', 't': 'BUSINESS_DOC', 'v': 'CHUNG', 'k': 'LOW'}}
  ELSE coalesce(t.x, x.x, l.x, CASE WHEN transfer_order_no IS NOT NULL THEN {{'b': 'SHIP_' || transfer_order_no || '_' || d.system, 'c': CASE d.system WHEN 'BHX' THEN '3.2' WHEN 'COOP' THEN '3.1' WHEN 'KHO_THUE' THEN '5.1' ELSE '2.3' END, 's': d.system, 't': 'TRANSFER_ORDER', 'v': transfer_order_no, 'k': 'HIGH'}} END,
    CASE WHEN shipment_id IS NOT NULL THEN {{'b': 'SHIP_' || shipment_id || '_' || d.system, 'c': CASE d.system WHEN 'BHX' THEN '3.2' WHEN 'COOP' THEN '3.1' WHEN 'KHO_THUE' THEN '5.1' ELSE 'CHUNG' END, 's': d.system, 't': 'SHIPMENT_ID', 'v': shipment_id, 'k': 'HIGH'}} END) END AS i
  FROM d LEFT JOIN t ON t.doc_type = d.doc_type LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id)"""


def _references(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = spark.createDataFrame(EXCEPTIONS, "ord int, rule_id string, key_type string, key_value string, order_code string, system string, excluded_systems array<string>, excluded_invoices array<string>")
    a = spark.createDataFrame(ALIASES, "ord int, primary_id string, secondary_ids array<string>, order_code string, system string")
    t = spark.createDataFrame(TYPE_RULES, "ord int, rule_id string, doc_type string, system string, order_code string, exception_rule_id string")
    return e, a, t


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, a, t = _references(spark)
    rules = t.filter("doc_type is not null and system is null").drop("system", "rule_id")
    return identity.direct_identity(view(spark, sf_dir, NAMED), rules, e, a, VARIANTS, CODES)


@query(f"WITH {_IDENTITY} SELECT doc_id, i.b AS batch_id, i.c AS order_code, i.s AS batch_system, i.t AS identity_type, i.v AS identity_value, i.k AS confidence FROM r")
def direct_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark, sf_dir).select("doc_id", "batch_id", "order_code", "batch_system", "identity_type", "identity_value", "confidence")


@query(f"WITH {_TABLES} SELECT doc_id, string_agg(DISTINCT tr.rule_id, ',' ORDER BY tr.rule_id) AS blocked FROM d JOIN tr ON (tr.doc_type IS NULL OR tr.doc_type = d.doc_type) AND (tr.system IS NULL OR tr.system = d.system) WHERE tr.eid NOT IN (SELECT rule_id FROM e) GROUP BY 1")
def blocked_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _, t = _references(spark)
    return identity.blocked_rules(view(spark, sf_dir, NAMED), t, e).select("doc_id", F.array_join("blocked", ",").alias("blocked"))


@query(f"""WITH {_IDENTITY}, m AS (SELECT i.b AS batch_id, position, doc_id, i FROM r WHERE i IS NOT NULL), last AS (SELECT batch_id, i, row_number() OVER (PARTITION BY batch_id ORDER BY position DESC) AS n FROM m WHERE i.k = 'HIGH'), first AS (SELECT batch_id, i, row_number() OVER (PARTITION BY batch_id ORDER BY position) AS n FROM m),
h AS (SELECT f.batch_id, coalesce(l.i, f.i) AS i FROM first f LEFT JOIN last l ON l.batch_id = f.batch_id AND l.n = 1 WHERE f.n = 1)
SELECT h.batch_id, (SELECT count(*) FROM m WHERE m.batch_id = h.batch_id) AS n_docs, i.c AS order_code, i.s AS batch_system, i.t AS identity_type, i.v AS identity_value, i.k AS confidence FROM h""")
def batch_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.batch_heads(identified(spark, sf_dir).filter("batch_id is not null"))


_labels = ["GT", "MT_BHX", "INTERNAL_TRANSFER", "INTERNAL_KHO_THUE", "COMMON", "INTERNAL_KHO_NOIBO"]


@query(f"SELECT o_orderkey, CASE l WHEN 'GT' THEN 'NPP' WHEN 'INTERNAL_TRANSFER' THEN 'KHO_CHUA_RO' WHEN 'INTERNAL_KHO_THUE' THEN 'KHO_THUE' WHEN 'INTERNAL_KHO_NOIBO' THEN 'KHO_NOIBO' ELSE CASE WHEN starts_with(l, 'MT_') THEN l[4:] ELSE l END END AS system, CASE WHEN starts_with(l, 'INTERNAL') THEN 'INTERNAL' ELSE l END AS family FROM (SELECT o_orderkey, [{', '.join(map(repr, _labels))}][o_custkey % 6 + 1] AS l FROM orders)")
def business_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.get(F.array(*map(F.lit, _labels)), (F.col("o_custkey") % 6).cast("int"))
    family = F.when(label.startswith("INTERNAL"), "INTERNAL").otherwise(label)
    return table(spark, sf_dir, "orders").select("o_orderkey", identity.business_system(label).alias("system"), family.alias("family"))


PATTERNS = [("BRUSHED.*BRAND#1", "HOA_DON"), ("brand#2", "PO"), ("STEEL|TIN", "LOADING_PLAN")]


@query("""WITH g AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Tất cả loại hình' ELSE 'x' END AS transport_type, CASE WHEN p_partkey % 4 < 2 THEN concat(' ', p_size, '.', p_partkey % 7, ' order') END AS order_detail, CASE WHEN p_partkey % 5 = 0 THEN concat('6.', p_size, ' ', p_type) ELSE p_type END AS doc_type, p_brand AS form_sheet FROM part),
c AS (SELECT *, coalesce(nullif(regexp_extract(coalesce(order_detail, ''), '^\\s*([0-9]+\\.[0-9]+)', 1), ''), nullif(regexp_extract(doc_type, '^\\s*([0-9]+\\.[0-9]+)', 1), ''), CASE WHEN contains(upper(strip_accents(transport_type)), 'TAT CA LOAI HINH') THEN '*' END) AS form_code,
  CASE WHEN regexp_matches(doc_type || ' ' || form_sheet, 'BRUSHED.*BRAND#1', 'i') THEN 'HOA_DON' WHEN regexp_matches(doc_type || ' ' || form_sheet, 'brand#2', 'i') THEN 'PO' WHEN regexp_matches(doc_type || ' ' || form_sheet, 'STEEL|TIN', 'i') THEN 'LOADING_PLAN' END AS canonical_type FROM g)
SELECT p_partkey, form_code, canonical_type, CASE WHEN canonical_type IS NULL THEN 'UNMAPPED_GUIDELINE' WHEN form_code IS NULL THEN 'UNMAPPED_FORM_CODE' ELSE 'MAPPED' END AS mapping FROM c""")
def guideline_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(k % 3 == 0, "Tất cả loại hình").otherwise("x").alias("transport_type"),
        F.when(k % 4 < 2, F.concat(F.lit(" "), "p_size", F.lit("."), k % 7, F.lit(" order"))).alias("order_detail"),
        F.when(k % 5 == 0, F.concat(F.lit("6."), "p_size", F.lit(" "), "p_type")).otherwise(F.col("p_type")).alias("doc_type"),
        F.col("p_brand").alias("form_sheet"),
    )
    return identity.guideline_codes(rows, PATTERNS).select("p_partkey", "form_code", "canonical_type", "mapping")


@query(f"WITH {_TABLES}, m AS (SELECT ord, rule_id, order_code, 'rules' AS provenance FROM tr UNION ALL SELECT ord, rule_id, order_code, 'reference' FROM e) SELECT rule_id, order_code, provenance, CAST(row_number() OVER (ORDER BY provenance DESC, ord) AS INT) AS place FROM m")
def merged_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e, _, t = _references(spark)
    merged = identity.with_reference(t.select("ord", "rule_id", "order_code"), e, "reference")
    return merged.select("rule_id", "order_code", "provenance", F.row_number().over(W.orderBy("ord")).alias("place"))
