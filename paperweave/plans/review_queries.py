"""Queries on branches of verdicts and on what reviews change, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.operators import review, verdict
from paperweave.plans import verdict_queries as v
from paperweave.plans.fixtures import TARGETS, table, view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SCOPE, FORMS = ["LOADING_PLAN"], ["LENH_DIEU_XE", "BIEU_DO_NHIET_DO"]
_PAGES = """SELECT o_orderkey AS page_id, o_custkey AS dossier_id, CASE o_orderkey % 10 WHEN 0 THEN 'HOA_DON' WHEN 1 THEN 'LENH_DIEU_XE' WHEN 2 THEN 'BIEU_DO_NHIET_DO' WHEN 3 THEN NULL ELSE 'LOADING_PLAN' END AS doc_type,
  CASE WHEN o_orderkey % 53 > 0 THEN 'page.png' END AS image, o_orderkey % 59 > 0 AS readable, CASE WHEN o_orderkey % 4 > 1 THEN 'PAGE_1_NO_SIGNATURES' ELSE 'OK' END AS zone_status, o_orderstatus <> 'F' AS is_color,
  CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_orderkey % 211 = 0 THEN 'RETAIL' WHEN o_custkey % 2 = 0 THEN 'WHOLESALE' ELSE 'EXPORT' END AS channel FROM {orders}"""
_tail = v._dossiers[v._dossiers.index("k AS (SELECT dossier_id") :]
_routed = f"""pp AS ({_PAGES.format(orders='orders')}), {v._targets}, t2 AS (SELECT * FROM t WHERE doc_id % 7 < 6), n2 AS (SELECT doc_id, count(*) AS n_targets FROM t2 GROUP BY 1),
b AS (SELECT pp.*, CASE WHEN coalesce(doc_type, '') NOT IN ('LOADING_PLAN', 'LENH_DIEU_XE', 'BIEU_DO_NHIET_DO') THEN 'OUT_OF_SCOPE' WHEN image IS NULL OR NOT readable THEN 'UNREADABLE' WHEN doc_type <> 'LOADING_PLAN' THEN 'FORM' WHEN zone_status = 'PAGE_1_NO_SIGNATURES' THEN 'FIRST_PAGE' WHEN n_targets IS NULL THEN 'NO_ZONE' ELSE 'SIGNATURES' END AS branch
  FROM pp LEFT JOIN n2 ON doc_id = page_id),
c AS (SELECT doc_id, count(*) FILTER (required) AS n_required, count(*) FILTER (required AND detected) AS n_found, count(*) FILTER (required AND review_required) AS n_review FROM t2 GROUP BY 1),
x AS (SELECT page_id, branch, is_color, CASE WHEN branch IN ('FORM', 'SIGNATURES') THEN coalesce(n_required, 0) ELSE 0 END AS n_required, CASE WHEN branch IN ('FORM', 'SIGNATURES') THEN coalesce(n_found, 0) ELSE 0 END AS n_found, coalesce(n_review, 0) AS n_review FROM b LEFT JOIN c ON doc_id = page_id),
y AS (SELECT page_id, branch, n_required, n_found, CASE branch WHEN 'OUT_OF_SCOPE' THEN 'CHUA_CHUAN_HOA_VUNG_KY' WHEN 'UNREADABLE' THEN 'LOI_DOC_ANH' WHEN 'FIRST_PAGE' THEN 'TRANG_1_CHUA_KY' WHEN 'NO_ZONE' THEN 'CHUA_CHUAN_HOA_VUNG_KY'
    WHEN 'FORM' THEN CASE WHEN n_required = 0 THEN 'KHONG_YEU_CAU' WHEN n_found = n_required THEN CASE WHEN is_color THEN 'DAT_CHUAN_GOC' ELSE 'DAT_CHUAN_PHOTO' END WHEN n_found = 0 THEN 'CHUA_KY_DONG_DAU' ELSE 'THIEU_MOT_SO_CHU_KY' END ELSE {v._status} END AS doc_status,
  CASE branch WHEN 'OUT_OF_SCOPE' THEN 'ABSTAIN' WHEN 'UNREADABLE' THEN 'ABSTAIN' WHEN 'FIRST_PAGE' THEN 'HOP_LE' WHEN 'NO_ZONE' THEN 'ABSTAIN' WHEN 'FORM' THEN CASE WHEN n_required = 0 THEN 'HOP_LE' WHEN n_found = n_required THEN 'DUYET' ELSE 'YEU_CAU_KY_LAI' END ELSE {v._action} END AS action FROM x)"""


def _ways(spark: SparkSession, sf_dir: str) -> tuple[review.Routed, DataFrame]:
    pages = spark.sql(_PAGES.format(orders="{orders}"), orders=table(spark, sf_dir, "orders"))
    targets = view(spark, sf_dir, TARGETS).filter("doc_id % 7 < 6").withColumnRenamed("doc_id", "page_id").withColumn("target", F.col("role"))
    return review.routed(pages, targets, SCOPE, FORMS), targets


@query(f"WITH {_routed} SELECT page_id, branch, doc_status, action, n_required, n_found FROM y")
def page_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    way, targets = _ways(spark, sf_dir)
    return review.page_verdicts(way, targets)


@query(f"""WITH {_routed}, s AS (WITH mem AS (SELECT dossier_id, page_id FROM b WHERE doc_type = 'LOADING_PLAN'), pg AS (SELECT page_id, channel, CASE WHEN branch = 'FIRST_PAGE' THEN 'PAGE_1_NO_SIGNATURES' ELSE 'OK' END AS zone_status, is_color FROM b WHERE branch IN ('FIRST_PAGE', 'NO_ZONE', 'SIGNATURES')),
tt AS (SELECT t2.*, true AS placed FROM t2 JOIN b ON page_id = doc_id WHERE branch = 'SIGNATURES'), roles(channel, role) AS (VALUES {v._roles}), {_tail})
SELECT CAST(dossier_id AS VARCHAR) AS dossier_id, 'PAGES' AS kind, n_pages, doc_status FROM s UNION ALL SELECT concat('TPL:', page_id), 'FORM', 1, doc_status FROM y WHERE branch = 'FORM'""")
def branch_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pages to the verdicts of pages and of dossiers, each page in one branch."""
    way, targets = _ways(spark, sf_dir)
    members = way.pages.filter("doc_type = 'LOADING_PLAN'").select("dossier_id", "page_id")
    return review.dossier_verdicts(way, review.page_verdicts(way, targets), targets, members, _roles(spark))


def _roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, r) for c, rs in v.ROLES.items() for r in rs], "channel string, role string")


_verdicts = f"d AS (SELECT DISTINCT doc_id, doc_id % 2 = 0 AS is_color FROM t), {v._second('{}')}"


@query(f"""WITH {v._effective}, m1 AS (WITH {_verdicts.format('t')} SELECT * FROM v), m2 AS (WITH {_verdicts.format('eff')} SELECT * FROM v),
n AS (SELECT doc_id, count(*) FILTER (d IS NOT NULL) AS n_applied, count(*) FILTER (d IS NOT NULL AND (det0 <> detected OR rev0 <> review_required)) AS n_overridden FROM eff GROUP BY 1)
SELECT doc_id, CASE WHEN n_applied > 0 THEN m2.doc_status ELSE m1.doc_status END AS doc_status, CASE WHEN n_applied > 0 THEN m2.action ELSE m1.action END AS action, n_applied, n_overridden, CASE WHEN n_applied > 0 THEN 'AFTER_REVIEW' ELSE 'MACHINE' END AS source
FROM m1 JOIN m2 USING (doc_id) JOIN n USING (doc_id)""")
def reviewed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    effective = v._effective_rows(spark, sf_dir)
    targets = view(spark, sf_dir, TARGETS)
    pages = targets.select("doc_id").distinct().withColumn("is_color", F.col("doc_id") % 2 == 0)
    return review.pages_after_review(verdict.reviewed_verdict(targets, pages), pages, effective, "doc_id")


_after = v._dossiers.replace("FROM t)", "FROM tr)", 1)


@query(f"""WITH {v._effective}, tr AS (SELECT doc_id, role, required, detected, review_required, CAST(NULL AS VARCHAR) AS modality, CAST(NULL AS VARCHAR) AS status FROM eff),
a AS (WITH {v._dossiers}), z AS (WITH {_after}), held AS (SELECT o_custkey AS dossier_id, o_orderkey AS page_id FROM orders UNION ALL SELECT c_custkey, -c_custkey FROM customer WHERE c_custkey % 50 = 0), hit AS (SELECT DISTINCT dossier_id FROM eff JOIN held ON page_id = doc_id WHERE d IS NOT NULL)
SELECT a.* EXCLUDE (n_found, doc_status), CASE WHEN h.dossier_id IS NULL THEN a.n_found ELSE z.n_found END AS n_found, CASE WHEN h.dossier_id IS NULL THEN a.doc_status ELSE z.doc_status END AS doc_status, CASE WHEN h.dossier_id IS NULL THEN 'MACHINE' ELSE 'AFTER_REVIEW' END AS source
FROM a JOIN z USING (dossier_id) LEFT JOIN hit h USING (dossier_id)""")
def reviewed_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, pages, targets, roles = v.dossier_inputs(spark, sf_dir)
    targets = targets.withColumn("role_key", F.col("role"))
    reviews = v._review_rows(spark, sf_dir).withColumnRenamed("doc_id", "page_id")
    effective = review.applied_reviews(targets, reviews, "page_id", "role_key")
    machine = verdict.dossier_verdict(members, pages, targets, roles)
    return review.dossiers_after_review(machine, members, pages, effective, roles)
