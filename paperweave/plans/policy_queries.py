"""Queries on policies, gates and read paths, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.functions.text import fixed
from paperweave.operators import policy, views
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


#: The policy is derived from nations and regions: a nation is a role, a region a channel that requires its nations.
_POLICY = """roles AS (SELECT n_name AS role, lower(n_name) AS label_role, n_nationkey + CASE WHEN n_nationkey = 3 THEN 1 ELSE 0 END AS label_index FROM nation),
labels AS (SELECT CASE WHEN n_nationkey = 7 THEN 'unheard' ELSE lower(n_name) END AS role, CASE WHEN n_nationkey = 9 THEN 8 ELSE n_nationkey END AS idx FROM nation),
optional AS (SELECT n_name AS role FROM nation WHERE n_nationkey IN (1, 2) UNION ALL SELECT 'NOBODY'),
required AS (SELECT r_name AS channel, n_name AS role FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey < 4 UNION ALL SELECT 'AFRICA', 'STRANGER' UNION ALL SELECT 'UNRESOLVED', n_name FROM nation WHERE n_nationkey <> 5),
channels AS (SELECT r_name AS channel FROM region UNION ALL SELECT 'UNRESOLVED'),
cited AS (SELECT r_name AS channel, CASE WHEN r_regionkey = 1 THEN '' ELSE 'said' END AS quote, 'S' AS sheet, concat('B', r_regionkey) AS cell FROM region WHERE r_regionkey <> 2),
systems AS (SELECT c_mktsegment AS system, CASE WHEN c_mktsegment = 'BUILDING' THEN 'NOWHERE' ELSE 'ASIA' END AS channel FROM customer GROUP BY 1)"""


def _policy(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    some = nation.join(region.filter("r_regionkey < 4"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("channel"), F.col("n_name").alias("role"))
    some = some.unionByName(spark.sql("SELECT 'AFRICA' AS channel, 'STRANGER' AS role")).unionByName(nation.filter("n_nationkey <> 5").select(F.lit("UNRESOLVED").alias("channel"), F.col("n_name").alias("role")))
    required = some.groupBy("channel").agg(F.sort_array(F.collect_list("role")).alias("required_roles"))
    cite = F.array(F.struct(F.when(F.col("r_regionkey") == 1, "").otherwise("said").alias("quote"), F.lit("S").alias("sheet"), F.concat(F.lit("B"), "r_regionkey").alias("cell")))
    channels = region.select(F.col("r_name").alias("channel"), F.when(F.col("r_regionkey") != 2, cite).alias("citations")).unionByName(spark.sql("SELECT 'UNRESOLVED' AS channel"), allowMissingColumns=True)
    return {
        "roles": nation.select(F.col("n_name").alias("role"), F.lower("n_name").alias("label_role"), (k + F.when(k == 3, 1).otherwise(0)).alias("label_index")),
        "labels": nation.select(F.when(k == 7, "unheard").otherwise(F.lower("n_name")).alias("role"), F.when(k == 9, 8).otherwise(k).alias("index")),
        "optional": nation.filter("n_nationkey in (1, 2)").select(F.col("n_name").alias("role")).unionByName(spark.sql("SELECT 'NOBODY' AS role")),
        "channels": channels.join(required, "channel", "left"),
        "systems": table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("system")).distinct().withColumn("channel", F.when(F.col("system") == "BUILDING", "NOWHERE").otherwise("ASIA")),
    }


@query(f"""WITH {_POLICY}
SELECT 'LABEL_UNKNOWN' AS fault, role AS subject FROM roles WHERE label_role NOT IN (SELECT role FROM labels)
UNION ALL SELECT 'LABEL_INDEX_DIFFERS', r.role FROM roles r JOIN labels l ON l.role = r.label_role WHERE l.idx <> r.label_index
UNION ALL SELECT 'LABEL_UNUSED', role FROM labels WHERE role NOT IN (SELECT label_role FROM roles)
UNION ALL SELECT 'LABEL_INDEX_REPEATED', CAST(idx AS VARCHAR) FROM labels GROUP BY idx HAVING count(*) > 1
UNION ALL SELECT 'OPTIONAL_ROLE_UNKNOWN', role FROM optional WHERE role NOT IN (SELECT role FROM roles)
UNION ALL SELECT 'REQUIRED_ROLES_EMPTY', channel FROM channels WHERE channel NOT IN (SELECT channel FROM required)
UNION ALL SELECT 'REQUIRED_ROLE_UNKNOWN', channel || ':' || role FROM required WHERE role NOT IN (SELECT role FROM roles)
UNION ALL SELECT 'REQUIRED_AND_OPTIONAL', channel || ':' || role FROM required WHERE role IN (SELECT role FROM optional)
UNION ALL SELECT 'CITATION_MISSING', channel FROM channels WHERE channel <> 'UNRESOLVED' AND channel NOT IN (SELECT channel FROM cited)
UNION ALL SELECT 'CITATION_INCOMPLETE', channel FROM cited WHERE quote = ''
UNION ALL SELECT DISTINCT 'STRICTEST_NOT_STRICTEST', role FROM required WHERE channel <> 'UNRESOLVED' AND role NOT IN (SELECT role FROM required WHERE channel = 'UNRESOLVED')
UNION ALL SELECT 'SYSTEM_CHANNEL_UNKNOWN', system || ':' || channel FROM systems WHERE channel NOT IN (SELECT channel FROM channels)""")
def policy_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.policy_faults(**_policy(spark, sf_dir))


@query(f"""WITH {_POLICY}, names AS (SELECT channel, string_agg(label_role, ',' ORDER BY required.role) AS n FROM required JOIN roles USING (role) GROUP BY 1), c AS (SELECT c_custkey, c_mktsegment AS s FROM customer),
p AS (SELECT c_custkey, CASE WHEN s = 'BUILDING' THEN ['UNRESOLVED', 'SYSTEM_UNRESOLVED(''BUILDING'')', 'true'] WHEN s = 'MACHINERY' THEN ['ASIA', 'EXACT(MACHINERY)', 'false'] WHEN starts_with(s, 'AUTO') THEN ['AFRICA', 'PREFIX(AUTO)', 'false'] ELSE ['UNRESOLVED', 'SYSTEM_NOT_IN_CONFIG(''' || s || ''')', 'true'] END AS x FROM c)
SELECT c_custkey, x[1] AS channel, x[2] AS reason, x[3] = 'true' AS unresolved, n AS required_names, CASE WHEN cited.cell IS NOT NULL THEN sheet || '!' || cell END AS cells FROM p LEFT JOIN names ON names.channel = x[1] LEFT JOIN cited ON cited.channel = x[1]""")
def policy_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _policy(spark, sf_dir)
    rows = policy.policy_summary(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("c_mktsegment"), p["channels"], p["roles"], ["BUILDING", ""], {"MACHINERY": "ASIA"}, [("AUTO", "AFRICA")])
    return rows.select("c_custkey", "channel", "reason", "unresolved", F.array_join("required_names", ",").alias("required_names"), F.array_join("cells", ",").alias("cells"))


_targets = f"t AS ({sql_text(TARGETS)})"
_templates = f"""{_targets}, o AS (SELECT o_orderkey AS page_id, o_custkey % 2 = 0 AS is_color, CASE o_custkey % 4 WHEN 0 THEN 'PO' WHEN 1 THEN 'BBBG_PALLET' WHEN 2 THEN 'LOADING_PLAN' ELSE 'DRAFT' END AS doc_type FROM orders),
g AS (SELECT doc_id AS page_id, count(*) AS n_targets, count(*) FILTER (required) AS n_required, count(*) FILTER (required AND detected) AS n_found, coalesce(string_agg(role, '; ' ORDER BY role) FILTER (required AND NOT detected), '') AS missing FROM t GROUP BY 1),
v AS (SELECT page_id, doc_type, coalesce(n_targets, 0) AS n_targets, coalesce(n_required, 0) AS n_required, coalesce(n_found, 0) AS n_found, coalesce(missing, '') AS missing, is_color FROM o LEFT JOIN g USING (page_id)),
w AS (SELECT *, CASE WHEN n_required = 0 THEN 'KHONG_YEU_CAU' WHEN n_found = n_required THEN CASE WHEN is_color THEN 'DAT_CHUAN_GOC' ELSE 'DAT_CHUAN_PHOTO' END WHEN n_found = 0 THEN 'CHUA_KY_DONG_DAU' ELSE 'THIEU_MOT_SO_CHU_KY' END AS doc_status, CASE WHEN n_required = 0 THEN 'HOP_LE' WHEN n_found = n_required THEN 'DUYET' ELSE 'YEU_CAU_KY_LAI' END AS action FROM v)"""


def _forms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    targets = view(spark, sf_dir, TARGETS).withColumnRenamed("doc_id", "page_id").withColumn("position", F.col("role"))
    k = F.col("o_custkey") % 4
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), (F.col("o_custkey") % 2 == 0).alias("is_color"), F.when(k == 0, "PO").when(k == 1, "BBBG_PALLET").when(k == 2, "LOADING_PLAN").otherwise("DRAFT").alias("doc_type"))
    return targets, pages, policy.template_verdict(targets, pages)


@query(f"WITH {_templates} SELECT page_id, doc_status, action, n_required, n_found, missing FROM w")
def template_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir)[2]


@query(f"WITH {_templates} SELECT 'TPL:' || page_id AS dossier_id, 'B' || page_id % 9 AS batch_id, doc_type, CASE WHEN n_targets > 0 THEN 'SIGNATURE_BLOCK' ELSE 'PAGE_NO_SIGNATURE_BOX' END AS page_class, 'TEMPLATE_FIXED_REQUIRED' AS policy_reason, doc_status, action FROM w WHERE doc_type IN ('PO', 'BBBG_PALLET')")
def template_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, pages, verdicts = _forms(spark, sf_dir)
    n = targets.groupBy("page_id").agg(F.count("*").alias("n_targets"))
    pages = pages.join(n, "page_id", "left").fillna(0, ["n_targets"]).withColumn("batch_id", F.concat(F.lit("B"), F.col("page_id") % 9))
    forms = policy.usable_forms({"PO": "DA_CHOT", "BBBG_PALLET": "DA_CHOT", "LOADING_PLAN": "DA_CHOT", "DRAFT": "NHAP"})
    return policy.template_dossiers(verdicts, pages, forms)


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'any_stamp' WHEN 1 THEN 'red_stamp' ELSE 'blue' END AS colour, CASE p_partkey % 5 WHEN 0 THEN 'SUPERMARKET_SQUARE' WHEN 1 THEN 'ODD' WHEN 2 THEN '' END AS explicit, CASE p_partkey % 3 WHEN 0 THEN 'Mộc ĐỎ công ty' WHEN 1 THEN 'Bộ phận Tiếp nhận' ELSE 'role' END AS role FROM part)
SELECT p_partkey, CASE WHEN coalesce(explicit, '') <> '' THEN CASE WHEN explicit = 'SUPERMARKET_SQUARE' THEN explicit END WHEN colour = 'any_stamp' THEN 'SUPERMARKET_SQUARE' WHEN colour = 'red_stamp' THEN 'COMPANY_ROUND_RED' END AS stamp,
  CASE WHEN explicit IS NOT NULL THEN explicit WHEN colour = 'any_stamp' OR contains(lower(role), 'tiếp nhận') THEN 'SUPERMARKET_SQUARE' WHEN colour = 'red_stamp' OR contains(lower(role), 'mộc đỏ') THEN 'COMPANY_ROUND_RED' END AS stamp_by_role FROM p""")
def stamp_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    colour = F.when(k % 4 == 0, "any_stamp").when(k % 4 == 1, "red_stamp").otherwise("blue")
    explicit = F.when(k % 5 == 0, "SUPERMARKET_SQUARE").when(k % 5 == 1, "ODD").when(k % 5 == 2, "")
    role = F.when(k % 3 == 0, "Mộc ĐỎ công ty").when(k % 3 == 1, "Bộ phận Tiếp nhận").otherwise("role")
    return table(spark, sf_dir, "part").select("p_partkey", policy.stamp_class(role, colour, explicit).alias("stamp"), policy.stamp_class(role, colour, explicit, by_role=True).alias("stamp_by_role"))


@query(f"""WITH {_templates}, x AS (SELECT page_id, CASE WHEN page_id % 8 = 0 THEN 'CAN_KIEM_TRA_TAY' WHEN page_id % 9 = 0 THEN 'NEW' ELSE doc_status END AS s, CASE WHEN page_id % 6 = 0 THEN 'CANH_BAO' END AS second FROM w),
y AS (SELECT *, CASE WHEN s IN ('DAT_CHUAN_GOC', 'DAT_CHUAN_PHOTO') THEN 'DUYET' WHEN s = 'THIEU_MOT_SO_CHU_KY' THEN 'CANH_BAO' WHEN s = 'CHUA_KY_DONG_DAU' THEN 'YEU_CAU_KY_LAI' WHEN s = 'KHONG_YEU_CAU' THEN 'HOP_LE' ELSE 'REVIEW_REQUIRED' END AS a FROM x)
SELECT page_id, CASE WHEN second <> a THEN 'REVIEW_REQUIRED' ELSE a END AS action, CASE WHEN second <> a THEN 'ACTION_CONTRACT_MISMATCH: ' || s || '=' || a || ' != ' || second END AS reason FROM y""")
def verdict_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    status = F.when(k % 8 == 0, "CAN_KIEM_TRA_TAY").when(k % 9 == 0, "NEW").otherwise(F.col("doc_status"))
    return template_verdicts(spark, sf_dir).select("page_id", policy.action_of(status, F.when(k % 6 == 0, "CANH_BAO")).alias("a")).select("page_id", "a.*")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'CHUA_CHUAN_HOA_VUNG_KY' WHEN o_custkey % 5 = 0 THEN 'IMAGE_NOT_FOUND' WHEN o_custkey % 5 = 1 THEN 'UNREADABLE' END AS zone_status, CASE WHEN o_orderkey % 3 > 0 THEN 'CHUA_CHUAN_HOA_VUNG_KY' WHEN o_custkey % 5 < 2 THEN 'LOI_DOC_ANH' END AS doc_status, CASE WHEN o_orderkey % 3 > 0 OR o_custkey % 5 < 2 THEN 'ABSTAIN' END AS action FROM orders""")
def abstaining_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey") % 5
    doc_type = F.when(F.col("o_orderkey") % 3 == 0, "LOADING_PLAN").when(F.col("o_orderkey") % 3 == 1, "HOA_DON")
    out = policy.in_scope(doc_type, ["LOADING_PLAN", "PO"], F.when(k > 0, "a.png"), F.when(k != 1, True))
    return table(spark, sf_dir, "orders").select("o_orderkey", out.alias("s")).select("o_orderkey", "s.zone_status", "s.doc_status", "s.action")


LIMITS = {"area_most": 0.9, "area_reject": 0.1, "area_warn": 0.2, "margin_reject": 1.0, "margin_warn": 3.0, "angle_min": 60.0, "angle_max": 120.0, "aspect_low": 1.1, "aspect_high": 1.7, "ink_reject": 2.0, "ink_warn": 0.5, "agreement_reject": 0.6, "agreement_warn": 0.8}
_MEASURES = {
    "found": "l_orderkey % 11 > 0",
    "precropped": "l_partkey % 7 = 0",
    "n_cut": "CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END",
    "n_near": "l_suppkey % 3",
    "area": "l_quantity / 50.0",
    "margin": "CASE WHEN l_partkey % 13 > 0 THEN l_quantity / 5.0 - 1 END",
    "n_touching": "l_linenumber % 4 % 3",
    "angle_min": "50.0 + l_partkey % 40",
    "angle_max": "90.0 + l_suppkey % 35",
    "aspect": "1.0 + l_discount * 8",
    "ink_outside": "CASE WHEN l_orderkey % 5 > 0 THEN l_tax * 30 END",
    "agreement": "CASE WHEN l_orderkey % 4 > 0 THEN 0.5 + l_discount * 5 END",
    "mask_fit": "0.8 + l_tax",
    "side_skew": "l_tax * 5",
}


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'A' AS scan, {", ".join(f"{v} AS {k}" for k, v in _MEASURES.items())} FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, scan, found, [CASE WHEN NOT precropped AND n_cut > 0 THEN 'SIDE_CUT' END, CASE WHEN NOT found THEN 'NO_CORNERS' END, CASE WHEN found AND (n_touching >= 2 OR n_touching = 1 AND area > 0.9) THEN 'CORNERS_TOUCH' END, CASE WHEN found AND area < 0.1 THEN 'AREA' END,
  CASE WHEN found AND (angle_min < 60 OR angle_max > 120) THEN 'ANGLE' END, CASE WHEN found AND ink_outside > 2 THEN 'INK_OUTSIDE' END, CASE WHEN found AND agreement < 0.6 THEN 'AGREEMENT' END] AS rejects,
  [CASE WHEN precropped THEN 'PRECROPPED' END, CASE WHEN NOT precropped AND n_cut = 0 AND n_near > 0 THEN 'SIDE_NEAR' END, CASE WHEN found AND n_touching = 1 AND area <= 0.9 THEN 'CORNER_NEAR' END, CASE WHEN found AND margin < 3 THEN 'MARGIN' END, CASE WHEN found AND area >= 0.1 AND area < 0.2 THEN 'AREA' END,
  CASE WHEN found AND NOT aspect BETWEEN 1.1 AND 1.7 THEN 'ASPECT' END, CASE WHEN found AND ink_outside > 0.5 AND ink_outside <= 2 THEN 'INK_OUTSIDE' END, CASE WHEN found AND agreement >= 0.6 AND agreement < 0.8 THEN 'AGREEMENT' END, CASE WHEN found AND mask_fit < 0.85 THEN 'MASK_FIT' END, CASE WHEN found AND side_skew > 0.35 THEN 'SIDE_SKEW' END] AS warns FROM m),
g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, scan, CASE WHEN scan THEN [] ELSE list_filter(rejects, lambda x: x IS NOT NULL) END AS rejects, CASE WHEN scan THEN CASE WHEN found THEN [] ELSE ['NO_OUTLINE'] END ELSE list_filter(warns, lambda x: x IS NOT NULL) END AS warns FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(rejects, ',') AS rejects, array_to_string(warns, ',') AS warns, CASE WHEN len(rejects) > 0 THEN 'CHUP_LAI' WHEN len(warns) > 0 AND scan IS NOT TRUE THEN 'CANH_BAO' ELSE 'DAT' END AS status FROM g""")
def corner_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = policy.corner_gate({k: F.expr(v) for k, v in _MEASURES.items()}, F.col("l_returnflag") == "A", LIMITS)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", gate.alias("g"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("g.rejects", ",").alias("rejects"), F.array_join("g.warns", ",").alias("warns"), "g.status")


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount AS b, l_tax * CASE WHEN l_partkey % 5 = 0 THEN 40 ELSE 0.3 END AS a FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN b > 0.05 AND a < 0.35 * b THEN 'FALLS' WHEN b > 0.02 AND a > 8.0 * b AND a > 1.0 THEN 'RISES' END AS drift FROM x")
def ink_drifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.col("l_tax") * F.when(F.col("l_partkey") % 5 == 0, 40.0).otherwise(0.3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", policy.ink_drift(F.col("l_discount"), after).alias("drift"))


@query("""WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE [p_size * 20.0, CASE WHEN p_partkey % 2 = 0 THEN p_size / 60.0 ELSE p_size * 16.0 END, p_size * 20.0 + p_partkey % 9, CASE WHEN p_partkey % 2 = 0 THEN 0.2 ELSE 900.0 END] END AS b FROM part),
s AS (SELECT p_partkey, least(b[1], b[3]) / ys AS y0, greatest(b[1], b[3]) / ys AS y1, least(b[2], b[4]) / xs AS x0, greatest(b[2], b[4]) / xs AS x1 FROM (SELECT *, CASE WHEN greatest(abs(b[1]), abs(b[3])) > 1.5 THEN 1000.0 ELSE 1.0 END AS ys, CASE WHEN greatest(abs(b[2]), abs(b[4])) > 1.5 THEN 1000.0 ELSE 1.0 END AS xs FROM b)),
u AS (SELECT *, x0 BETWEEN -0.02 AND 1.02 AND x1 BETWEEN -0.02 AND 1.02 AND y0 BETWEEN -0.02 AND 1.02 AND y1 BETWEEN -0.02 AND 1.02 AND x1 - x0 >= 0.01 AND y1 - y0 >= 0.005 AS ok FROM s)
SELECT p_partkey, CASE WHEN ok THEN floor(least(greatest(x0, 0.0), 1.0) * 10000 + 0.5) / 10000 END AS x0, CASE WHEN ok THEN floor(least(greatest(y1, 0.0), 1.0) * 10000 + 0.5) / 10000 END AS y1 FROM u""")
def normal_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    box = F.when(k % 10 != 0, F.array(size * 20.0, F.when(k % 2 == 0, size / 60.0).otherwise(size * 16.0), size * 20.0 + k % 9, F.when(k % 2 == 0, 0.2).otherwise(900.0)))
    out = policy.normal_box(box)
    return table(spark, sf_dir, "part").select("p_partkey", fixed(out[0]).alias("x0"), fixed(out[3]).alias("y1"))


_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"""WITH x AS (SELECT {", ".join(_KEYS)}, l_returnflag = 'R' AS required, l_linestatus = 'F' AS detected, l_tax > 0.07 AS review, CASE l_partkey % 4 WHEN 1 THEN 'SIGNED' WHEN 2 THEN 'UNCLEAR' WHEN 3 THEN 'NOT_SIGNED' END AS decision, CASE l_partkey % 12 WHEN 1 THEN true WHEN 3 THEN false WHEN 5 THEN true END AS effective FROM lineitem)
SELECT {", ".join(_KEYS)}, CASE WHEN review OR coalesce(decision, '') = 'UNCLEAR' OR decision IS NOT NULL AND effective IS NULL THEN 'review' WHEN coalesce(effective, detected) THEN 'signed' WHEN required THEN 'missing_required' ELSE 'missing_optional' END AS state FROM x""")
def target_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    state = views.target_state(
        {
            "required": F.col("l_returnflag") == "R",
            "detected": F.col("l_linestatus") == "F",
            "review_required": F.col("l_tax") > 0.07,
            "decision": F.when(k % 4 == 1, "SIGNED").when(k % 4 == 2, "UNCLEAR").when(k % 4 == 3, "NOT_SIGNED"),
            "effective": F.when(k % 12 == 1, True).when(k % 12 == 3, False).when(k % 12 == 5, True),
        }
    )
    return table(spark, sf_dir, "lineitem").select(*_KEYS, state.alias("state"))


@query("""WITH e AS (SELECT l_partkey AS file, arg_max(l_orderkey, l_orderkey * 10 + l_linenumber) AS b FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce('B' || b, 'BATCH_ISOLATED') AS batch_id FROM orders LEFT JOIN e ON file = o_orderkey""")
def page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file_name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.concat(F.lit("B"), "l_orderkey").alias("batch_id"))
    pages = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("file_name"))
    return views.with_batch(pages, entries).select("o_orderkey", "batch_id")


@query("SELECT o_orderkey AS dossier_id, o_orderstatus AS doc_status, CASE WHEN o_orderkey % 7 > 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'DAT' ELSE o_orderstatus END END AS effective_status, CASE WHEN o_orderkey % 7 = 0 THEN 'EFFECTIVE_DOSSIER_NOT_FOUND' END AS reason FROM orders")
def effective_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dossier_id"), F.array(F.col("o_custkey"), F.lit(-1).cast("long")).alias("pages"), F.col("o_orderstatus").alias("doc_status"), F.lit("x").alias("action"))
    other = rows.select("dossier_id", F.when(F.col("dossier_id") % 7 == 0, F.reverse("pages")).otherwise(F.col("pages")).alias("pages"), F.when(F.col("pages")[0] % 2 == 0, "DAT").otherwise(F.col("doc_status")).alias("doc_status"), "action")
    return views.with_effective(rows, other).select("dossier_id", "doc_status", "effective_status", "reason")


@query("WITH d AS (SELECT CASE l_linenumber WHEN 1 THEN 'PO' WHEN 2 THEN 'HOA_DON' ELSE 'OTHER' END AS doc_type FROM lineitem) SELECT doc_type, CASE WHEN doc_type = 'OTHER' THEN 'UNMAPPED' ELSE 'MAPPED' END AS mapping_status, CASE doc_type WHEN 'PO' THEN 3 WHEN 'HOA_DON' THEN 2 ELSE 0 END AS n_targets, count(*) AS n FROM d GROUP BY 1, 2, 3")
def preset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.when(n == 1, "PO").when(n == 2, "HOA_DON").otherwise("OTHER").alias("doc_type"))
    return views.with_presets(rows, {"PO": 3, "HOA_DON": 2}).groupBy("doc_type", "mapping_status", "n_targets").agg(F.count("*").alias("n"))


@query("SELECT e.event_id, CASE WHEN c.c_custkey IS NULL THEN NULL ELSE concat('G', e.user_id) END AS upload, c.c_custkey IS NULL AS ungrouped FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_custkey % 3 > 0")
def upload_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = table(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("file_name"), F.concat(F.lit("G"), "c_custkey").alias("upload"))
    rows, missing = views.with_uploads(table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("file_name")), uploads)
    return rows.join(missing.distinct().withColumn("ungrouped", F.lit(True)), "file_name", "left").select("event_id", "upload", F.coalesce("ungrouped", F.lit(False)).alias("ungrouped"))


@query("""WITH r AS (SELECT user_id AS page_id, event_id AS review_id, event_id % 6 AS target_index, date_trunc('day', ts) AS created_at, value > 50 AS machine FROM events), t AS (SELECT c_custkey AS page_id, i AS target_index, (c_custkey + i) % 2 = 0 AS detected FROM customer, (SELECT unnest(range(0, 5)) AS i))
SELECT r.page_id, review_id, CAST(row_number() OVER (PARTITION BY r.page_id ORDER BY created_at DESC, r.target_index, review_id) AS INT) AS place, NOT coalesce(detected = machine, false) AS stale FROM r LEFT JOIN t USING (page_id, target_index)""")
def review_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("review_id"), (F.col("event_id") % 6).alias("target_index"), F.date_trunc("day", "ts").alias("created_at"), (F.col("value") > 50).alias("machine_detected"))
    targets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("target_index")).withColumn("detected", (F.col("page_id") + F.col("target_index")) % 2 == 0)
    return views.review_history(reviews, targets).select("page_id", "review_id", "place", "stale")


@query("WITH b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) SELECT o_orderkey AS group_id FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderkey NOT IN (SELECT l_orderkey FROM b)")
def rerunnable_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("RUNNING")
    groups = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group_id"), status.alias("status"))
    jobs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.when(F.col("l_quantity") > 45, "QUEUED").otherwise("DONE").alias("status"))
    return views.may_rerun(groups, jobs).select("group_id")


@query("SELECT c_mktsegment, count(*) FILTER (c_custkey % 4 = 0) AS n_true, count(*) FILTER (c_acctbal > 0 AND c_custkey % 5 = 0 AND c_custkey <> 10) AS n_admins, count(*) AS n FROM customer WHERE c_nationkey = 3 OR c_mktsegment = 'BUILDING' GROUP BY 1")
def guarded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    setting = F.when(k % 4 == 0, " true").when(k % 4 == 1, '"true"').when(k % 4 == 2, "1")
    rows = views.visible_to(table(spark, sf_dir, "customer"), F.lit(3), "c_nationkey", F.col("c_mktsegment") == "BUILDING")
    usable = (F.col("c_acctbal") > 0) & (k % 5 == 0) & (k != 10)
    return rows.groupBy("c_mktsegment").agg(F.count_if(views.strict_flag(setting)).alias("n_true"), F.count_if(usable).alias("n_admins"), F.count("*").alias("n"))


@query("SELECT l_partkey AS file_name, l_returnflag AS doc_type, l_linestatus AS reason, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_partkey, l_returnflag, l_linestatus) AS place FROM lineitem GROUP BY 1, 2, 3")
def isolated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    missed = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file_name"), F.col("l_returnflag").alias("doc_type"), F.col("l_linestatus").alias("reason"))
    return views.isolated_pairs(missed).withColumn("place", F.col("place").cast("long"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 97 * 10.0 AS x0, l_partkey % 97 * 10.0 + l_quantity AS x1, 5.0 + l_suppkey % 4 AS height FROM lineitem), e AS (SELECT l_orderkey, median(height) AS em FROM w GROUP BY 1),
n AS (SELECT w.*, CASE WHEN x0 - max(x1) OVER (PARTITION BY w.l_orderkey ORDER BY x0, x1, l_partkey, l_suppkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1.5 * em THEN 0 ELSE 1 END AS new FROM w JOIN e USING (l_orderkey)),
p AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY x0, x1, l_partkey, l_suppkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS phrase FROM n)
SELECT l_orderkey, CAST(phrase AS INT) AS phrase, count(*) AS n_words, min(x0) AS x0, max(x1) AS x1 FROM p GROUP BY 1, 2""")
def line_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0 = (F.col("l_partkey") % 97) * 10.0
    words = table(spark, sf_dir, "lineitem").select("l_orderkey", x0.alias("x0"), (x0 + F.col("l_quantity")).alias("x1"), (5.0 + F.col("l_suppkey") % 4).alias("height"))
    return views.phrases(words, ["l_orderkey"], 1.5).groupBy("l_orderkey", "phrase").agg(F.count("*").alias("n_words"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


#: A rule's key is a part of an order's number; an evidence names orders, parts and suppliers within longer values.
_RULES = """SELECT o_orderkey AS rule_id, CASE WHEN o_orderkey % 50 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN concat('-', o_custkey % 1000, '-') WHEN o_orderkey % 7 = 1 THEN CAST(o_orderkey % 10 AS {string}) WHEN o_orderkey % 7 = 2 THEN concat('z', o_orderkey) ELSE CAST(o_orderkey AS {string}) END AS key,
  CASE WHEN o_orderkey % 50 = 0 THEN 'invoice_no' ELSE 'po_no' END AS field, CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'R' END AS source_type, CASE WHEN o_custkey % 4 = 0 THEN 'N' END AS target_type, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS expected FROM {orders}"""
_RULED = """SELECT CASE WHEN l_linenumber % 5 = 0 THEN 'invoice_no' ELSE 'po_no' END AS field, CASE WHEN l_linenumber % 6 > 0 THEN l_returnflag END AS source_type, CASE WHEN l_linenumber % 2 = 0 THEN 'N' ELSE 'A' END AS target_type, l_linestatus AS status, l_orderkey * 1000000 + l_suppkey * 10 + l_linenumber AS position,
  concat('PO', l_orderkey) AS v1, CASE WHEN l_linenumber % 4 > 0 THEN concat('x-', l_partkey, '-y') END AS v2, concat('d', l_orderkey, '_', l_linenumber) AS v3, concat('e', l_suppkey) AS v4 FROM {lineitem}"""


@query(f"""WITH r AS ({_RULES.format(string='VARCHAR', orders='orders')}), e AS ({_RULED.format(lineitem='lineitem')}), v AS (SELECT field, source_type AS s, target_type AS t, x, min({{'p': position, 's': status}}) AS f FROM (SELECT *, unnest([v1, v2, v3, v4]) AS x FROM e) WHERE x IS NOT NULL GROUP BY 1, 2, 3, 4),
n AS (SELECT DISTINCT field, length(key) AS n FROM r), u AS (SELECT v.field, s, t, f, substr(x, i, n) AS key FROM (SELECT v.*, n, unnest(range(1, length(x) - n + 2)) AS i FROM v JOIN n USING (field) WHERE n BETWEEN 1 AND length(x)) v),
k AS (SELECT field, key, s, t, min(f) AS f FROM u GROUP BY 1, 2, 3, 4 UNION ALL SELECT field, '', s, t, min(f) FROM v GROUP BY 1, 3, 4),
h AS (SELECT rule_id, min(f) AS f FROM r JOIN k USING (field, key) WHERE (target_type IS NULL OR t IS NULL OR t = target_type OR coalesce(s = target_type, false)) AND (source_type IS NULL OR s IS NULL OR s = source_type OR coalesce(t = source_type, false)) GROUP BY 1)
SELECT rule_id, coalesce(h.f.s, 'NOT_FOUND') AS actual, coalesce(h.f.s, 'NOT_FOUND') = expected AS correct FROM r LEFT JOIN h USING (rule_id)""")
def rule_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(_RULES.format(string="STRING", orders="{orders}"), orders=table(spark, sf_dir, "orders"))
    evidence = spark.sql(_RULED.format(lineitem="{lineitem}"), lineitem=table(spark, sf_dir, "lineitem")).withColumn("values", F.array("v1", "v2", "v3", "v4"))
    return views.rule_accuracy(rules, evidence).select("rule_id", "actual", "correct")


@query("""WITH j AS (SELECT user_id AS group_id, event_id AS job_id, event_type AS status, date_trunc('day', ts) AS created_at FROM events)
SELECT group_id, job_id, status, strftime(created_at, '%Y-%m-%d') AS created FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY created_at DESC, job_id DESC) AS k FROM j) WHERE k = 1""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = [F.lit(None).cast("string").alias(n) for n in ("stage", "message")] + [F.lit(0).alias(n) for n in ("stage_done", "stage_total", "percent")]
    jobs = table(spark, sf_dir, "events").select(F.col("user_id").alias("group_id"), F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), F.date_trunc("day", "ts").alias("created_at"), *none)
    return views.job_state(jobs).select("group_id", "job_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_name) AS place FROM customer")
def users_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.in_order(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name"), "c_acctbal", "c_name").select("c_custkey", F.col("place").cast("long").alias("place"))


@query("SELECT file_name, row_number() OVER (ORDER BY file_name) AS place FROM (SELECT concat('f', o_orderkey) AS file_name FROM orders WHERE o_orderstatus IN ('F', 'P'))")
def in_scope_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), "o_orderkey").alias("file_name"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("doc_type"))
    return views.in_scope_files(pages, ["F", "P"]).select("file_name", F.col("place").cast("long").alias("place"))


@query("SELECT l_linenumber, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_yes FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY 1")
def scorable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.scorable(table(spark, sf_dir, "lineitem"), "l_returnflag", "R", "N")
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_yes"))


@query("""WITH p AS (SELECT o_orderstatus <> 'F' AS a, o_custkey % 7 = 0 AS b, o_orderkey % 10 = 0 AS gone, o_orderpriority IS NOT NULL AS c FROM orders), d AS (SELECT CASE WHEN gone OR b THEN 1 ELSE 0 END AS t1, CASE WHEN gone THEN 2 ELSE CASE WHEN b THEN 1 ELSE 0 END END AS t2 FROM p)
SELECT 'T1' AS stage, count(*) AS n_compared, CAST(sum(t1) AS BIGINT) AS n_diffs, count(*) FILTER (t1 > 0) AS n_files FROM d UNION ALL SELECT 'T2', count(*), CAST(sum(t2) AS BIGINT), count(*) FILTER (t2 > 0) FROM d""")
def parity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("doc_type"), F.col("o_custkey").alias("system"))
    theirs = ours.filter("o_orderkey % 10 > 0").select("o_orderkey", F.when(F.col("system") % 7 > 0, F.col("status")).otherwise("?").alias("status"), "doc_type", F.when(F.col("system") % 7 > 0, F.col("system")).otherwise(-1).alias("system"))
    return views.parity_counts(ours, theirs, "o_orderkey", {"T1": ["status"], "T2": ["doc_type", "system"]})
