"""The driver's tables read as audit inputs, in Spark and as SQL for the oracle: only columns are renamed and derived, no row is added or dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Order lines as documents of shipments.
PAPERS = """SELECT DISTINCT concat('B', l_orderkey) AS batch_id, concat('D', l_orderkey, '_', l_linenumber % 2) AS dossier_id,
  concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS doc_id,
  CASE l_linenumber % 5 WHEN 0 THEN 'PXKKVCNB' WHEN 1 THEN 'PO' WHEN 2 THEN 'HOA_DON' WHEN 3 THEN 'PHIEU_GIAO_HANG' ELSE 'LOADING_PLAN' END AS doc_type,
  CASE WHEN l_discount > 0.005 THEN CAST(10000 + l_partkey % 600 AS {string}) END AS po_no,
  CAST(9000 + l_suppkey % 2 AS {string}) AS invoice_no,
  CASE WHEN l_suppkey % 4 > 0 THEN CAST(500 + l_suppkey % 3 AS {string}) END AS shipment_id,
  CAST(500 + l_partkey % 3 AS {string}) AS transfer_order_no
FROM {lineitem}"""

#: Turns of conversations as scanned pages of uploads.
PAGES = """SELECT concat('G', conv_id) AS upload_group_id, CAST(turn + CASE WHEN turn >= 4 THEN 1 ELSE 0 END AS INT) AS scan_index,
  CASE length(text) % 3 WHEN 0 THEN 'HOA_DON' WHEN 1 THEN 'PO' ELSE 'TABLE_CONTINUATION' END AS doc_type,
  CASE WHEN turn % 7 = 5 THEN NULL WHEN turn % 3 = 0 THEN 'HEADER' ELSE 'CONTINUATION' END AS page_role,
  CASE length(text) % 4 WHEN 1 THEN 'MT_BHX' WHEN 3 THEN 'GT' ELSE 'COMMON' END AS system,
  CASE WHEN length(text) % 11 = 0 THEN 'YEU_CAU_CHUP_LAI' ELSE 'PASS' END AS action,
  CASE WHEN length(text) % 6 > 0 THEN CAST(1234560 + length(text) % 4 AS {string}) END AS shipment_id,
  CASE WHEN length(text) % 7 < 3 THEN concat('I', length(text) % 2) END AS invoice_no,
  CASE WHEN length(text) % 5 > 0 THEN concat('P', length(text) % 10 % 2) END AS po_no,
  CAST(NULL AS {string}) AS transfer_order_no, CAST(NULL AS {string}) AS pxk_no
FROM {conversations}"""

#: Orders as documents to be batched.
SHIPPED = """SELECT CAST(o_orderkey AS {string}) AS doc_id, o_orderkey AS position,
  CASE o_custkey % 6 WHEN 1 THEN 'BHX' WHEN 2 THEN 'WINMART' WHEN 3 THEN 'EMART' WHEN 4 THEN 'NPP' WHEN 5 THEN 'COOP' ELSE 'COMMON' END AS system,
  CASE o_orderkey % 6 WHEN 0 THEN 'PO' WHEN 1 THEN 'HOA_DON' WHEN 2 THEN 'PHIEU_GIAO_HANG' WHEN 3 THEN 'LOADING_PLAN' WHEN 4 THEN 'PXKKVCNB' ELSE 'PHIEU_NHAP_KHO' END AS doc_type,
  CASE WHEN o_custkey % 6 IN (0, 2, 4) AND o_orderkey % 40 = 0 THEN CAST(70 + o_orderkey % 7 AS {string}) WHEN o_custkey % 6 = 5 AND o_custkey = 5 THEN '911' END AS shipment_id,
  CASE WHEN o_custkey % 6 = 0 AND o_orderkey % 50 = 1 THEN CAST(75 + o_orderkey % 9 AS {string}) END AS transfer_order_no,
  CASE WHEN o_custkey % 7 < 5 AND o_orderkey % 3 < 2 THEN concat('P', o_custkey) END AS po_no,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('I', o_orderkey % 400) END AS invoice_no,
  CAST(NULL AS {string}) AS pxk_no
FROM {orders}"""

#: Order lines as signature targets.
TARGETS = """SELECT l_orderkey AS doc_id, concat('role', l_linenumber) AS role, l_returnflag <> 'N' OR l_linenumber > 4 AS required, l_linestatus = 'F' AS detected,
  l_discount > 0.095 AS review_required, CASE WHEN l_tax < 0.06 THEN 'TRUE_COLOR' ELSE 'PHOTOCOPY_BW' END AS modality,
  CASE WHEN l_tax > 0.075 AND l_discount > 0.085 THEN 'INPUT_ERROR' ELSE 'OK' END AS status
FROM {lineitem}"""

_SOURCES = ("lineitem", "conversations", "orders")


def sql_text(name: str) -> str:
    return name.format(string="VARCHAR", **{s: s for s in _SOURCES})


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A fixture over the tables in a folder, which come in as arguments of the statement."""
    used = {s: table(spark, sf_dir, s) for s in _SOURCES if "{" + s + "}" in text}
    return spark.sql(text.format(string="STRING", **{s: "{" + s + "}" for s in _SOURCES}), **used)


def text_stats(docs: DataFrame) -> DataFrame:
    """Documents as measured pages: length, lines, share of letters and digits."""
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    return docs.select("doc_id", "source", "lang", F.length("text").alias("n"), (F.length("text") - F.length(F.regexp_replace("text", "\n", "")) + 1).alias("n_lines"), (100.0 * letters / F.greatest(F.length("text"), F.lit(1))).alias("letter_pct"))


TEXT_STATS = """SELECT doc_id, source, lang, length(text) AS n, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines,
  100.0 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(text), 1) AS letter_pct FROM documents"""
