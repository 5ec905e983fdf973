"""Queries on signatures, reviews and attempts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.operators import verdict
from paperweave.plans.fixtures import TARGETS, sql_text, table, view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_targets = f"t AS ({sql_text(TARGETS)})"
_docs = "d AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN 'BIEU_DO_NHIET_DO' WHEN 1 THEN 'HOA_DON' ELSE 'LOADING_PLAN' END AS doc_type, CASE WHEN o_orderkey % 3 = 0 THEN 'UNMAPPED' ELSE 'MAPPED' END AS mapping_status, o_orderstatus <> 'F' AS is_color FROM orders)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("doc_id"),
        F.when(k % 5 == 0, "BIEU_DO_NHIET_DO").when(k % 5 == 1, "HOA_DON").otherwise("LOADING_PLAN").alias("doc_type"),
        F.when(k % 3 == 0, "UNMAPPED").otherwise("MAPPED").alias("mapping_status"),
        (F.col("o_orderstatus") != "F").alias("is_color"),
    )


@query(f"""WITH {_targets}, {_docs}, g AS (SELECT doc_id, count(*) FILTER (required) AS n_required, count(*) FILTER (required AND detected) AS n_found, count(*) FILTER (NOT required) AS n_optional, count(*) FILTER (NOT required AND detected) AS n_optional_found, bool_or(required AND status = 'INPUT_ERROR') AS bad, bool_and(modality = 'TRUE_COLOR') FILTER (required) AS colour FROM t GROUP BY 1)
SELECT d.doc_id, coalesce(n_required, 0) AS n_required, coalesce(n_found, 0) AS n_found, coalesce(n_optional, 0) AS n_optional, coalesce(n_optional_found, 0) AS n_optional_found,
CASE WHEN bad THEN 'LOI_DU_LIEU_ANH' WHEN coalesce(n_required, 0) = 0 AND mapping_status = 'UNMAPPED' AND doc_type <> 'BIEU_DO_NHIET_DO' THEN 'UNMAPPED' WHEN coalesce(n_required, 0) = 0 THEN 'KHONG_YEU_CAU' WHEN n_found = n_required AND colour THEN 'DAT_CHUAN_GOC' WHEN n_found = n_required THEN 'DAT_CHUAN_PHOTO' WHEN n_found > 0 THEN 'THIEU_MOT_SO_CHU_KY' ELSE 'CHUA_KY_DONG_DAU' END AS doc_status
FROM d LEFT JOIN g USING (doc_id)""")
def verdict_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.document_verdict(view(spark, sf_dir, TARGETS), _documents(spark, sf_dir))


_ladder = "WHEN n_required = 0 THEN '{}' WHEN n_review > 0 THEN '{}' WHEN n_found = n_required AND is_color THEN '{}' WHEN n_found = n_required THEN '{}' WHEN n_found = 0 THEN '{}' ELSE '{}' END"
_status = "CASE " + _ladder.format("CHUA_CHUAN_HOA_VUNG_KY", "CAN_KIEM_TRA_TAY", "DAT_CHUAN_GOC", "DAT_CHUAN_PHOTO", "CHUA_KY_DONG_DAU", "THIEU_MOT_SO_CHU_KY")
_action = "CASE " + _ladder.format("ABSTAIN", "REVIEW_REQUIRED", "DUYET", "DUYET", "YEU_CAU_KY_LAI", "CANH_BAO")


def _second(targets: str) -> str:
    return f"""g AS (SELECT doc_id, count(*) FILTER (required) AS n_required, count(*) FILTER (required AND detected) AS n_found, count(*) FILTER (required AND review_required) AS n_review, coalesce(string_agg(role, ',' ORDER BY role) FILTER (required AND NOT detected), '') AS gone FROM {targets} GROUP BY 1),
x AS (SELECT d.doc_id, is_color, coalesce(n_required, 0) AS n_required, coalesce(n_found, 0) AS n_found, coalesce(n_review, 0) AS n_review, coalesce(gone, '') AS gone FROM d LEFT JOIN g USING (doc_id)),
v AS (SELECT doc_id, n_required, n_found, n_review, {_status} AS doc_status, {_action} AS action, gone FROM x)"""


@query(f"WITH {_targets}, {_docs}, {_second('t')} SELECT doc_id, n_required, n_found, n_review, doc_status, action, CASE WHEN doc_status = 'THIEU_MOT_SO_CHU_KY' THEN gone ELSE '' END AS missing_roles FROM v")
def verdict_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.reviewed_verdict(view(spark, sf_dir, TARGETS), _documents(spark, sf_dir))


@query(f"WITH {_targets}, {_docs}, {_second('t')} SELECT doc_status, action, count(*) AS n FROM v GROUP BY 1, 2")
def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verdict.reviewed_verdict(view(spark, sf_dir, TARGETS), _documents(spark, sf_dir))
    return rows.groupBy("doc_status", "action").agg(F.count("*").alias("n"))


#: system -> channel, and the roles that a channel requires; the strictest set under UNRESOLVED.
UNRESOLVED_SYSTEMS, EXACT, PREFIXES = ["", "FURNITURE"], {"BUILDING": "RETAIL", "MACHINERY": "WHOLESALE"}, [("AUTO", "RETAIL"), ("HOUSE", "EXPORT")]
ROLES = {"RETAIL": ["role1", "role2"], "WHOLESALE": ["role1"], "EXPORT": ["role2", "role3"], "UNRESOLVED": ["role1", "role2", "role3"]}
_roles = ", ".join(f"('{c}', '{r}')" for c, rs in ROLES.items() for r in rs)
_channel = "CASE WHEN coalesce(c_mktsegment, '') IN ('', 'FURNITURE') THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'RETAIL' WHEN c_mktsegment = 'MACHINERY' THEN 'WHOLESALE' WHEN starts_with(c_mktsegment, 'AUTO') THEN 'RETAIL' WHEN starts_with(c_mktsegment, 'HOUSE') THEN 'EXPORT' END"


@query(f"SELECT c_custkey, c_mktsegment, coalesce({_channel}, 'UNRESOLVED') AS channel FROM customer")
def channel_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = verdict.channel_of(F.col("c_mktsegment"), UNRESOLVED_SYSTEMS, EXACT, PREFIXES)
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.coalesce(channel, F.lit("UNRESOLVED")).alias("channel"))


_dossiers = f"""{_targets}, mem AS (SELECT o_custkey AS dossier_id, o_orderkey AS page_id FROM orders UNION ALL SELECT c_custkey, -c_custkey FROM customer WHERE c_custkey % 50 = 0),
pg AS (SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 211 = 0 THEN 'RETAIL' ELSE {_channel} END AS channel, CASE WHEN o_orderkey % 97 = 0 THEN 'ABSTAIN' WHEN o_orderkey % 4 > 0 THEN 'PAGE_1_NO_SIGNATURES' ELSE 'OK' END AS zone_status, o_orderstatus <> 'F' AS is_color FROM orders JOIN customer ON c_custkey = o_custkey),
tt AS (SELECT *, doc_id % 4 = 0 AND doc_id % 97 > 0 AS placed FROM t), roles(channel, role) AS (VALUES {_roles}),
k AS (SELECT dossier_id, m.page_id, channel, is_color, p.page_id IS NOT NULL AS there, CASE WHEN p.page_id IS NULL THEN 'MISSING' WHEN n > 0 THEN 'SIGNATURE_BLOCK' WHEN zone_status = 'PAGE_1_NO_SIGNATURES' THEN 'PAGE_1_NO_BLOCK' ELSE 'BLOCK_ABSTAIN' END AS class FROM mem m LEFT JOIN pg p ON m.page_id = p.page_id LEFT JOIN (SELECT doc_id, count(*) FILTER (placed) AS n FROM tt GROUP BY 1) ON doc_id = m.page_id),
shape AS (SELECT dossier_id, count(*) AS n_pages, count(*) FILTER (class = 'SIGNATURE_BLOCK') AS n_blocks, bool_or(class IN ('MISSING', 'BLOCK_ABSTAIN')) AS abstains, CASE WHEN count(DISTINCT channel) = 1 AND bool_and(channel IS NOT NULL OR NOT there) THEN min(channel) ELSE 'UNRESOLVED' END AS policy_channel, coalesce(bool_and(is_color) FILTER (class = 'SIGNATURE_BLOCK'), false) AS is_color FROM k GROUP BY 1),
meas AS (SELECT dossier_id, role, bool_or(detected) AS detected, bool_or(review_required) AS rev FROM k JOIN tt ON tt.doc_id = k.page_id WHERE class = 'SIGNATURE_BLOCK' AND placed GROUP BY 1, 2),
told AS (SELECT s.dossier_id, count(*) AS n_required, count(*) FILTER (detected) AS n_found, count(*) FILTER (rev) AS n_review, count(*) FILTER (m.role IS NULL) AS n_unmeasured FROM shape s JOIN roles r ON r.channel = s.policy_channel LEFT JOIN meas m ON m.dossier_id = s.dossier_id AND m.role = r.role GROUP BY 1)
SELECT dossier_id, n_pages, n_blocks, policy_channel, n_required, n_found, CASE WHEN abstains THEN 'CHUA_CHUAN_HOA_VUNG_KY' WHEN n_blocks = 0 THEN 'KHONG_TIM_THAY_KHOI_KY' WHEN n_unmeasured > 0 THEN 'CHUA_CHUAN_HOA_VUNG_KY' {_ladder.format("CHUA_CHUAN_HOA_VUNG_KY", "CAN_KIEM_TRA_TAY", "DAT_CHUAN_GOC", "DAT_CHUAN_PHOTO", "CHUA_KY_DONG_DAU", "THIEU_MOT_SO_CHU_KY")} AS doc_status FROM shape JOIN told USING (dossier_id)"""


def dossier_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """members, pages, targets and required roles of dossiers of several pages."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    lost = customer.filter("c_custkey % 50 = 0").select(F.col("c_custkey").alias("dossier_id"), (-F.col("c_custkey")).alias("page_id"))
    members = orders.select(F.col("o_custkey").alias("dossier_id"), k.alias("page_id")).unionByName(lost)
    channel = F.when(k % 211 == 0, "RETAIL").otherwise(verdict.channel_of(F.col("c_mktsegment"), UNRESOLVED_SYSTEMS, EXACT, PREFIXES))
    zone = F.when(k % 97 == 0, "ABSTAIN").when(k % 4 > 0, "PAGE_1_NO_SIGNATURES").otherwise("OK")
    pages = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).select(k.alias("page_id"), channel.alias("channel"), zone.alias("zone_status"), (F.col("o_orderstatus") != "F").alias("is_color"))
    targets = view(spark, sf_dir, TARGETS).withColumn("placed", F.expr("doc_id % 4 = 0 and doc_id % 97 > 0")).withColumnRenamed("doc_id", "page_id")
    roles = spark.createDataFrame([(c, r) for c, rs in ROLES.items() for r in rs], "channel string, role string")
    return members, pages, targets, roles


@query(f"WITH {_dossiers}")
def dossier_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.dossier_verdict(*dossier_inputs(spark, sf_dir))


_reviews = """rv AS (SELECT event_id // 3 AS doc_id, concat('role', event_id % 2 + 1) AS role_key, event_id AS review_id, ts AS created_at, CASE WHEN event_id % 17 = 0 THEN 'other' ELSE concat('role', event_id % 2 + 1) END AS role, CASE event_type WHEN 'click' THEN 'SIGNED' WHEN 'view' THEN 'NOT_SIGNED' ELSE 'UNCLEAR' END AS decision FROM events WHERE event_type IN ('click', 'view', 'purchase')),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, role_key ORDER BY created_at DESC, review_id DESC) AS k FROM rv) WHERE k = 1)"""


def _review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view", "purchase"))
    role = F.concat(F.lit("role"), F.col("event_id") % 2 + 1)
    decision = F.when(F.col("event_type") == "click", "SIGNED").when(F.col("event_type") == "view", "NOT_SIGNED").otherwise("UNCLEAR")
    return e.select(F.floor(F.col("event_id") / 3).alias("doc_id"), role.alias("role_key"), F.col("event_id").alias("review_id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 17 == 0, "other").otherwise(role).alias("role"), decision.alias("decision"))


@query(f"WITH {_reviews} SELECT doc_id, role_key, review_id, role, decision, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM last")
def latest_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verdict.latest_reviews(_review_rows(spark, sf_dir), "doc_id", "role_key")
    return rows.select("doc_id", "role_key", "review_id", "role", "decision", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


_effective = f"""{_reviews}, {_targets}, m AS (SELECT doc_id, role AS role_key, role, detected, review_required, required FROM t),
e AS (SELECT m.doc_id, m.role_key, m.role, m.required, m.detected AS machine, CASE WHEN l.role = m.role THEN l.decision END AS d, m.detected AS det0, m.review_required AS rev0 FROM m LEFT JOIN last l USING (doc_id, role_key)),
eff AS (SELECT *, CASE d WHEN 'SIGNED' THEN true WHEN 'NOT_SIGNED' THEN false ELSE det0 END AS detected, CASE WHEN d = 'UNCLEAR' THEN true WHEN d IS NOT NULL THEN false ELSE rev0 END AS review_required FROM e)"""


def _effective_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    machine = view(spark, sf_dir, TARGETS).select("doc_id", F.col("role").alias("role_key"), "role", "detected", "review_required", "required")
    return verdict.effective_targets(machine, verdict.latest_reviews(_review_rows(spark, sf_dir), "doc_id", "role_key"), "doc_id", "role_key")


@query(f"WITH {_effective} SELECT doc_id, role_key, d AS human_decision, CASE WHEN NOT review_required THEN detected END AS effective_detected FROM eff")
def effective_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effective_rows(spark, sf_dir).select("doc_id", "role_key", "human_decision", "effective_detected")


@query(f"""WITH {_effective}, d AS (SELECT DISTINCT doc_id, doc_id % 2 = 0 AS is_color FROM eff), {_second('eff')}, n AS (SELECT doc_id, count(*) FILTER (d IS NOT NULL) AS n_applied, count(*) FILTER (d IS NOT NULL AND (machine <> detected OR rev0 <> review_required)) AS n_overridden FROM eff GROUP BY 1)
SELECT doc_id, doc_status, action, n_applied, n_overridden FROM v JOIN n USING (doc_id)""")
def effective_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _effective_rows(spark, sf_dir)
    documents = rows.select("doc_id").distinct().withColumn("is_color", F.col("doc_id") % 2 == 0)
    told = verdict.reviewed_verdict(rows, documents).join(verdict.overridden(rows, "doc_id"), "doc_id")
    return told.select("doc_id", "doc_status", "action", "n_applied", "n_overridden")


_attempts = "a AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'signup' THEN 'SUCCESS' END AS kind, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec FROM events WHERE event_type IN ('error', 'signup'))"
#: Errors are sparse in the table, so the window is days where an application has minutes.
WINDOW_MINUTES, LOCK_MINUTES, MAX_FAILS = 7 * 1440, 3 * 1440, 3


def _attempt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "signup"))
    return e.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "error", "FAIL").otherwise("SUCCESS").alias("kind"))


_lockout = f"""WITH {_attempts}, r AS (SELECT *, max(sec) FILTER (kind = 'SUCCESS') OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reset FROM a),
f AS (SELECT r.event_id, r.user_id, r.sec, count(b.sec) AS n_fails, max(b.sec) AS last_fail FROM r LEFT JOIN a b ON b.user_id = r.user_id AND b.kind = 'FAIL' AND b.sec BETWEEN r.sec - {60 * WINDOW_MINUTES} AND r.sec AND (r.reset IS NULL OR b.sec > r.reset) GROUP BY 1, 2, 3)
SELECT event_id, user_id, n_fails, CASE WHEN n_fails >= {MAX_FAILS} THEN last_fail + {60 * LOCK_MINUTES} END AS locked_until_sec"""


@query(f"{_lockout}, CASE WHEN n_fails >= {MAX_FAILS} THEN greatest(1, last_fail + {60 * LOCK_MINUTES} - sec) END AS remaining_sec FROM f")
def login_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verdict.attempts_in_window(_attempt_rows(spark, sf_dir), "user_id", WINDOW_MINUTES, LOCK_MINUTES, MAX_FAILS)
    return rows.select("event_id", "user_id", F.col("n_fails").cast("long").alias("n_fails"), "locked_until_sec", F.when(F.col("locked_until_sec").isNotNull(), F.col("remaining_sec")).alias("remaining_sec"))


@query("SELECT user_id, count(*) AS n_kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts")).scalar()
    return events.filter(F.col("ts") >= newest - F.expr("INTERVAL 30 DAYS")).groupBy("user_id").agg(F.count("*").alias("n_kept"))


@query("SELECT user_id, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_fails FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def streamed_fails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fails of each day counted as a stream over the table's files."""
    import uuid

    from paperweave.sources.lineage import shared_folder
    from paperweave.streaming.attempts import collected, read_events, windowed_fails

    schema = table(spark, sf_dir, "events").schema
    events = read_events(spark, sf_dir, schema, "events.parquet").filter("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    told = collected(windowed_fails(events, "user_id", "1 day", "30 days"), f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}")
    return told.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n_fails")


@query(f"{_lockout} FROM f")
def streamed_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lockouts of login_lockout, from a stream over the table's files with state for each account."""
    import uuid

    from paperweave.sources.lineage import shared_folder
    from paperweave.streaming.attempts import collected, read_events, stateful_lockout

    schema = table(spark, sf_dir, "events").schema
    events = read_events(spark, sf_dir, schema, "events.parquet").filter(F.col("event_type").isin("error", "signup"))
    attempts = events.withColumn("kind", F.when(F.col("event_type") == "error", "FAIL").otherwise("SUCCESS"))
    told = stateful_lockout(attempts, "user_id", 60 * WINDOW_MINUTES, 60 * LOCK_MINUTES, MAX_FAILS)
    return collected(told, f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}", "append")
