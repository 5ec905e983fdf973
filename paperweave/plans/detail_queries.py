"""Queries on applied policies, evidence by role, records as they are stored, and facts of symbols, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.operators import measure, policy, records, verdict, views
from paperweave.plans import verdict_queries as v
from paperweave.plans.fixtures import TARGETS, table, view
from paperweave.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Roles of the label dictionary with their keys, those a channel requires, and those that are always optional.
LABELS = [(f"k{i}", f"role{i}") for i in range(1, 6)]
REQUIRED = [("RETAIL", "k1"), ("RETAIL", "k2"), ("EXPORT", "k2"), ("UNRESOLVED", "k1"), ("UNRESOLVED", "k2"), ("UNRESOLVED", "k3")]
OPTIONAL = ["k4"]
_channels = "CASE l_orderkey % 4 WHEN 0 THEN 'RETAIL' WHEN 1 THEN 'EXPORT' WHEN 2 THEN 'UNRESOLVED' END"
_policy_targets = f"SELECT l_orderkey AS page_id, l_linenumber AS target, concat('role', l_linenumber) AS role, l_returnflag = 'A' AS required, {_channels} AS channel, l_partkey, l_suppkey FROM {{lineitem}}"


@query(f"""WITH t AS ({_policy_targets.format(lineitem='lineitem')}), l(key, role) AS (VALUES {', '.join(map(repr, LABELS))}), r(channel, key) AS (VALUES {', '.join(map(repr, REQUIRED))}), x AS (SELECT t.* EXCLUDE (channel), coalesce(t.channel, 'UNRESOLVED') AS ch, l.key FROM t LEFT JOIN l USING (role))
SELECT page_id, target, l_partkey, l_suppkey, x.key AS role_key, x.required AS required_original, x.key IS NULL OR r.key IS NOT NULL AS required,
  CASE WHEN x.key IS NULL THEN 'POLICY_ROLE_UNKNOWN_STRICT:' || role WHEN r.key IS NOT NULL THEN 'POLICY:' || ch || ':REQUIRED' || CASE WHEN ch = 'UNRESOLVED' THEN '[STRICTEST_CHANNEL_UNRESOLVED]' ELSE '' END WHEN x.key = 'k4' THEN 'POLICY:ALWAYS_OPTIONAL(k4)' ELSE 'POLICY:' || ch || ':NOT_REQUIRED' END AS required_source
FROM x LEFT JOIN r ON r.channel = x.ch AND r.key = x.key""")
def applied_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.sql(_policy_targets, lineitem=table(spark, sf_dir, "lineitem"))
    roles = spark.createDataFrame(LABELS, "role_key string, role string")
    required = spark.createDataFrame(REQUIRED, "channel string, role_key string")
    return policy.applied(targets, roles, required, OPTIONAL).select("page_id", "target", "l_partkey", "l_suppkey", "role_key", "required_original", "required", "required_source")


_evidence = f"""{v._targets}, p AS (SELECT o_orderkey AS page_id, o_custkey AS dossier_id FROM orders WHERE o_orderkey % 5 < 4), m AS (SELECT dossier_id, page_id, role, required, detected, review_required FROM t JOIN p ON page_id = doc_id)"""


@query(f"""WITH {_evidence} SELECT dossier_id, role, bool_or(required) AS required, bool_or(detected) AS detected, bool_or(review_required) AS review_required, array_to_string(list_sort(list(DISTINCT page_id) FILTER (detected)), ',') AS pages_detected, array_to_string(list_sort(list(DISTINCT page_id)), ',') AS pages_measured FROM m GROUP BY 1, 2""")
def role_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "orders").filter("o_orderkey % 5 < 4").select(F.col("o_custkey").alias("dossier_id"), F.col("o_orderkey").alias("page_id"))
    rows = verdict.role_evidence(members, view(spark, sf_dir, TARGETS).withColumnRenamed("doc_id", "page_id"))
    return rows.withColumns({c: F.nullif(F.array_join(c, ","), F.lit("")) for c in ("pages_detected", "pages_measured")})


@query("WITH m AS (SELECT l_orderkey AS page_id, l_suppkey % 4 AS dossier_id FROM lineitem) SELECT page_id, count(DISTINCT dossier_id) AS n_dossiers FROM m GROUP BY 1 HAVING count(DISTINCT dossier_id) > 1")
def shared_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.shared_pages(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_suppkey") % 4).alias("dossier_id")))


@query("SELECT DISTINCT l_orderkey AS page_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 6 > 0)")
def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "orders").filter("o_orderkey % 6 > 0").select(F.col("o_custkey").alias("dossier_id"), F.col("o_orderkey").alias("page_id"))
    return verdict.orphan_pages(members, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id")).distinct())


_gated = "SELECT o_custkey AS batch_id, concat('p', o_orderkey) AS file_name, CASE o_orderkey % 7 WHEN 0 THEN 'CHUP_LAI' WHEN 1 THEN 'CANH_BAO' ELSE 'DAT' END AS status FROM {orders}"


@query(f"WITH p AS ({_gated.format(orders='orders')}) SELECT batch_id, file_name, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY file_name) AS INT) AS place FROM p WHERE status = 'CHUP_LAI'")
def retake_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.retake_pages(spark.sql(_gated, orders=table(spark, sf_dir, "orders")), "batch_id", "file_name")


@query(f"""WITH p AS ({_gated.format(orders='orders')}), b AS (SELECT batch_id, max(CASE status WHEN 'CHUP_LAI' THEN 2 WHEN 'CANH_BAO' THEN 1 ELSE 0 END) AS r FROM p GROUP BY 1)
SELECT 'n_pages' AS metric, count(*) AS value FROM p UNION ALL SELECT 'n_batches', count(*) FROM b UNION ALL SELECT 'batches:' || ['DAT', 'CANH_BAO', 'CHUP_LAI'][r + 1], count(*) FROM b GROUP BY r UNION ALL SELECT 'batches_to_retake', count(*) FILTER (r = 2) FROM b""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.sql(_gated, orders=table(spark, sf_dir, "orders"))
    return tables.run_summary(measure.worst_status(pages, "batch_id"))


@query("""SELECT event_id, CASE WHEN event_id % 5 > 1 THEN floor(value * 100 + 0.5) / 100 END AS value, replace(concat('a', event_type, CASE WHEN event_id % 3 = 0 THEN chr(9) ELSE '' END), chr(9), '') AS name, CASE WHEN event_id % 7 > 0 THEN floor(value * 100 + 0.5) / 100 END AS inner_value, event_type AS inner_name FROM events""")
def cleaned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-a-numbers and infinities become null and NULs go, at any depth."""
    k, x = F.col("event_id"), F.floor(F.col("value") * 100 + 0.5) / 100
    odd = F.when(k % 5 == 0, float("nan")).when(k % 5 == 1, float("-inf")).otherwise(x)
    nul = F.when(k % 3 == 0, F.lit("\u0000")).otherwise("")
    inner = F.struct(F.array(F.when(k % 7 == 0, float("inf")).otherwise(x)).alias("v"), F.concat(nul, "event_type", nul).alias("n"))
    raw = table(spark, sf_dir, "events").select("event_id", odd.alias("value"), F.concat(F.lit("a"), nul, "event_type").alias("name"), inner.alias("inner"))
    return tables.cleaned(raw).select("event_id", "value", "name", F.col("inner.v")[0].alias("inner_value"), F.col("inner.n").alias("inner_name"))


@query("SELECT doc_id, concat(printf('%03d', doc_id), '_', substr(sha256(text), 1, 8), '.png') AS stored FROM documents WHERE text IS NOT NULL")
def stored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", tables.stored_name(F.col("doc_id"), F.sha2("text", 256), F.lit("png")).alias("stored"))


_path = "concat('/in/lot ', o_custkey, '/', CASE WHEN o_orderkey % 3 = 0 THEN concat('g', o_custkey % 10, '__') ELSE '' END, 'page', o_orderkey, '.png')"


@query(f"""WITH f AS (SELECT {_path} AS path, o_custkey AS c, o_orderkey AS k FROM orders) SELECT path, 'lot ' || c AS by_folder, CASE WHEN k % 3 = 0 THEN 'g' || c % 10 ELSE 'page' || k END AS by_prefix, 'ALL' AS single FROM f""")
def batch_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.expr(_path).alias("path"))
    path = F.col("path")
    return files.select("path", tables.batch_key(path, "folder").alias("by_folder"), tables.batch_key(path, "prefix").alias("by_prefix"), tables.batch_key(path, "single", "ALL").alias("single"))


@query("""WITH b AS (SELECT p_partkey, p_size / 60.0 AS y0, (p_partkey % 50) / 55.0 AS x0, p_size / 60.0 + 0.02 AS y1, (p_partkey % 50) / 55.0 + CASE WHEN p_partkey % 9 = 0 THEN 0.001 ELSE 0.08 END AS x1 FROM part),
s AS (SELECT p_partkey, greatest(0, trunc(greatest(0.02, y0 - 0.25 * (y1 - y0)) * 1600)::INT) AS ya, trunc(least(0.97, y1 + 0.25 * (y1 - y0)) * 1600)::INT AS yb, greatest(0, trunc(greatest(0.08, x0 - 0.25 * (x1 - x0)) * 1131)::INT) AS xa, trunc(least(0.96, x1 + 0.25 * (x1 - x0)) * 1131)::INT AS xb FROM b)
SELECT p_partkey, CASE WHEN yb - ya >= 8 AND xb - xa >= 8 THEN concat_ws(',', ya, xa, yb, xb) END AS box FROM s""")
def safe_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    y0, x0 = size / 60.0, (k % 50) / 55.0
    box = records.safe_box(y0, x0, y0 + 0.02, x0 + F.when(k % 9 == 0, 0.001).otherwise(0.08), 0.25, 1131, 1600)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(box.cast("array<string>"), ",").alias("box"))


BY_FIRST = {"1": "GTGT", "2": "BAN_HANG", "6": "PXK"}
_symbol = "concat(CASE p_partkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '6' ELSE '3' END, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'K' END, lpad(CAST(p_size % 30 AS {string}), 2, '0'), CASE WHEN p_partkey % 3 = 0 THEN 'M' ELSE 'T' END, 'AB')"


@query(f"""WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 11 > 0 THEN {_symbol.format(string='VARCHAR')} END AS s, CASE p_partkey % 5 WHEN 0 THEN 'GTGT' WHEN 1 THEN 'PXK' ELSE 'BAN_HANG' END AS told FROM part),
x AS (SELECT *, CASE s[1] WHEN '1' THEN 'GTGT' WHEN '2' THEN 'BAN_HANG' WHEN '6' THEN 'PXK' END AS implied FROM s)
SELECT p_partkey, s AS symbol, implied, s[2] = 'C' AS has_code, '20' || s[3:4] AS year, s[5] = 'M' AS from_till, CASE WHEN implied <> told THEN told || ' <> ' || implied || ' (' || s || ')' END AS contradiction FROM x""")
def symbol_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    symbol = F.when(k % 11 > 0, F.expr(_symbol.format(string="STRING")))
    told = F.when(k % 5 == 0, "GTGT").when(k % 5 == 1, "PXK").otherwise("BAN_HANG")
    return table(spark, sf_dir, "part").select("p_partkey", records.symbol_facts(symbol, told, BY_FIRST).alias("f")).select("p_partkey", "f.*")


_STATUS = {"DAT_CHUAN_GOC": ("Original", "good"), "THIEU_MOT_SO_CHU_KY": ("Signatures missing", "bad"), "CAN_KIEM_TRA_TAY": ("To be checked", "open")}
_shown = lambda c, i: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{x[i]}'" for k, x in _STATUS.items()) + (f" ELSE {c} || ' · needs review' END" if i == 0 else " ELSE 'neutral' END")
_machine = f"d AS (SELECT DISTINCT doc_id, doc_id % 2 = 0 AS is_color FROM t), {v._second('t')}"
_later = f"d AS (SELECT DISTINCT doc_id, doc_id % 2 = 0 AS is_color FROM t), {v._second('eff')}"


@query(f"""WITH {v._effective}, m1 AS (WITH {_machine} SELECT * FROM v), m2 AS (WITH {_later} SELECT * FROM v), n AS (SELECT doc_id, count(*) FILTER (d IS NOT NULL) AS n_reviewed FROM eff GROUP BY 1),
ee AS (SELECT doc_id, m1.doc_status AS machine, CASE WHEN n_reviewed > 0 THEN m2.doc_status ELSE m1.doc_status END AS effective, CASE WHEN n_reviewed > 0 THEN m2.action ELSE m1.action END AS action, n_reviewed FROM m1 JOIN m2 USING (doc_id) JOIN n USING (doc_id))
SELECT o_orderkey AS page_id, o_custkey AS group_id, CASE WHEN o_orderkey % 3 > 0 THEN 'LOADING_PLAN' END AS doc_type, machine AS doc_status, effective AS effective_status, action AS effective_action, coalesce(n_reviewed, 0) > 0 AS reviewed, o_orderkey % 3 > 0 AS supported,
  {_shown('effective', 0)} AS status_label, {_shown('effective', 1)} AS status_tone, {_shown('machine', 0)} AS machine_label, effective IS NOT NULL AND effective NOT IN ({', '.join(map(repr, _STATUS))}) AS status_unknown FROM orders LEFT JOIN ee ON doc_id = o_orderkey""")
def page_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a list shows them: the machine's verdict beside the one after review, with labels."""
    from paperweave.operators import review

    targets = view(spark, sf_dir, TARGETS)
    judged = targets.select("doc_id").distinct().withColumn("is_color", F.col("doc_id") % 2 == 0)
    machine = verdict.reviewed_verdict(targets, judged).withColumnRenamed("doc_id", "page_id")
    effective = v._effective_rows(spark, sf_dir).withColumnRenamed("doc_id", "page_id")
    after = review.pages_after_review(machine, judged.withColumnRenamed("doc_id", "page_id"), effective)
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_custkey").alias("group_id"), F.when(F.col("o_orderkey") % 3 > 0, "LOADING_PLAN").alias("doc_type"))
    return views.page_summaries(pages, machine, after, _STATUS, ["LOADING_PLAN"])


@query("SELECT event_type AS stage, count(*) AS n_runs, floor(sum(value) * 100 + 0.5) / 100 AS seconds, count(*) FILTER (value > 90) AS n_slow, count(*) FILTER (value IS NULL) AS n_unmeasured FROM events GROUP BY 1")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.stage_timings(table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds")), slow=90.0)
    return rows.withColumn("seconds", F.floor(F.col("seconds") * 100 + 0.5) / 100)


_files = """SELECT l_orderkey AS upload_group_id, CASE WHEN l_partkey % 40 = 0 THEN -1 WHEN l_partkey % 41 = 0 THEN NULL ELSE l_linenumber END AS scan_index, CAST(l_quantity * 1000 AS BIGINT) AS length, CASE WHEN l_suppkey % 17 > 0 THEN 'PNG' END AS format FROM {lineitem}"""


@query(f"""WITH f AS ({_files.format(lineitem='lineitem')}), g AS (SELECT upload_group_id, [CASE WHEN count(*) > 6 THEN 'TOO_MANY_FILES' END, CASE WHEN max(length) > 48000 THEN 'FILE_TOO_LARGE' END, CASE WHEN bool_or(format IS NULL) THEN 'NOT_AN_IMAGE' END,
  CASE WHEN count(DISTINCT scan_index) < count(*) THEN 'DUPLICATE_SCAN_INDEX' END, CASE WHEN bool_or(scan_index IS NULL OR scan_index < 0) THEN 'BAD_SCAN_INDEX' END] AS r FROM f GROUP BY 1)
SELECT upload_group_id, array_to_string(list_filter(r, lambda x: x IS NOT NULL), ',') AS reasons FROM g WHERE len(list_filter(r, lambda x: x IS NOT NULL)) > 0""")
def rejected_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.sql(_files, lineitem=table(spark, sf_dir, "lineitem"))
    return tables.upload_rejects(files, 6, 48000).withColumn("reasons", F.array_join("reasons", ","))


@query("""WITH r AS (SELECT event_id, user_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS actor FROM events), u AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 > 0)
SELECT event_id, 'REVIEW' AS kind, c_name AS by_whom FROM r JOIN u ON c_custkey = user_id WHERE event_type IN ('click', 'view') UNION ALL SELECT event_id, 'AUDIT', c_name FROM r LEFT JOIN u ON c_custkey = actor WHERE event_type NOT IN ('click', 'view')""")
def acts_with_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with their reviewers, and audit rows with whoever acted, if that is known."""
    users = table(spark, sf_dir, "customer").filter("c_custkey % 4 > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    events = table(spark, sf_dir, "events")
    reviews = events.filter("event_type in ('click', 'view')").select("event_id", "user_id")
    audit = events.filter("event_type not in ('click', 'view')").select("event_id", F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"))
    return views.acts_with_users(reviews, audit, users, "event_id")
