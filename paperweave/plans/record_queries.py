"""Queries on records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.functions import text as tx
from paperweave.operators import records
from paperweave.plans.fixtures import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LABELS = {"F": ("finished", "good"), "O": ("open", "warn")}


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus || ' · needs review' END AS label, CASE o_orderstatus WHEN 'F' THEN 'good' WHEN 'O' THEN 'warn' ELSE 'neutral' END AS tone FROM orders")
def status_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.labelled(table(spark, sf_dir, "orders"), "o_orderstatus", LABELS).select("o_orderkey", "label", "tone")


@query("SELECT p_partkey, p_brand, last_value(CASE WHEN p_partkey % 4 = 0 THEN p_type END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS type FROM part")
def filled_guidelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).alias("type"))
    return records.filled_down(rows, "p_brand", "p_partkey", "type")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 2 > 0 THEN 'X' END) AS value, (o_orderkey % 3 = 0 AND o_orderkey % 2 > 0) AS filled FROM orders")
def second_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    value, filled = records.filled_from(F.when(k % 3 > 0, F.col("o_orderstatus")), F.when(k % 2 > 0, "X"))
    return table(spark, sf_dir, "orders").select(k, value.alias("value"), filled.alias("filled"))


@query("WITH f AS (SELECT user_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) >= value AS down FROM events) SELECT user_id, count(*) FILTER (down) AS n_falls, count(*) FILTER (down) = 0 AS monotone FROM f GROUP BY 1")
def order_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.out_of_order(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


@query("SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next, CAST(row_number() OVER w AS INTEGER) AS number FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def page_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.neighbours(table(spark, sf_dir, "conversations"), "conv_id", "turn", "turn")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return records.newest(rows, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


_jobs = "j AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'RUNNING' WHEN event_type = 'error' THEN 'QUEUED' ELSE 'DONE' END AS state, event_id % 5 AS attempts, CAST(floor(value) AS BIGINT) AS heartbeat FROM events)"


def _job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "view", "RUNNING").when(F.col("event_type") == "error", "QUEUED").otherwise("DONE")
    return table(spark, sf_dir, "events").select("event_id", state.alias("state"), (F.col("event_id") % 5).alias("attempts"), F.floor("value").alias("heartbeat"))


@query(f"WITH {_jobs} SELECT event_id, CASE WHEN state = 'RUNNING' AND heartbeat < 60 THEN CASE WHEN attempts + 1 > 3 THEN 'FAILED' ELSE 'QUEUED' END ELSE state END AS state, attempts + CASE WHEN state = 'RUNNING' AND heartbeat < 60 THEN 1 ELSE 0 END AS attempts FROM j")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.requeued(_job_rows(spark, sf_dir), F.lit(100), 40, 3).select("event_id", "state", "attempts")


@query(f"WITH {_jobs} SELECT event_id FROM j WHERE state = 'QUEUED' ORDER BY heartbeat, event_id LIMIT 1")
def next_queued_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.next_job(_job_rows(spark, sf_dir), "heartbeat", "event_id").select("event_id")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def unseeded_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return records.not_seeded(table(spark, sf_dir, "customer").select("c_custkey"), there, "c_custkey")


@query("SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def reviewed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"))
    return table(spark, sf_dir, "events").select("user_id").distinct().join(seen, "user_id", "left_semi")


@query("SELECT conv_id, count(*) AS n, max(turn) = count(*) - 1 AND min(turn) = 0 AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations WHERE NOT (conv_id % 9 = 0 AND turn = 1) GROUP BY 1")
def contiguous_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("not (conv_id % 9 = 0 and turn = 1)")
    return records.contiguous(rows, "conv_id", "turn")


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) WHEN event_id % 3 = 1 THEN 'Supplier#' || user_id ELSE '?' END AS ref FROM events),
s AS (SELECT s_suppkey AS page_id, CAST(s_suppkey AS VARCHAR) AS i, 'Supplier#' || s_suppkey AS n FROM supplier)
SELECT event_id, ref, coalesce(a.page_id, b.page_id) AS page_id FROM r LEFT JOIN s a ON a.i = r.ref LEFT JOIN s b ON b.n = r.ref""")
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id").cast("string")
    refs = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, u).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Supplier#"), u)).otherwise("?").alias("ref"))
    pages = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"), F.col("s_suppkey").alias("i"), F.concat(F.lit("Supplier#"), F.col("s_suppkey")).alias("n"))
    return records.resolved(refs, pages, "ref", ["i", "n"]).select("event_id", "ref", "page_id")


@query("""WITH x AS (SELECT o_orderkey, o_orderstatus AS a, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS b, o_orderkey % 7 = 0 AS extra FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN extra THEN 'note' END, CASE WHEN a <> b THEN 'status' END) AS fields FROM x""")
def record_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    a = F.create_map(F.lit("status"), s, F.lit("time"), F.lit("1"))
    b = F.create_map(F.lit("status"), F.when(k % 5 == 0, "X").otherwise(s), F.lit("time"), F.lit("2"))
    b = F.when(k % 7 == 0, F.map_concat(b, F.create_map(F.lit("note"), F.lit("n")))).otherwise(b)
    return table(spark, sf_dir, "orders").select(k, F.array_join(records.differing_fields(a, b, ["time"]), ",").alias("fields"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 OR regexp_matches(lower(p_name), 'stamp|seal') THEN 'STAMP' ELSE 'SIGNATURE' END AS kind FROM part")
def target_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    colour = F.when(F.col("p_partkey") % 6 == 0, "red_stamp").otherwise("blue")
    return table(spark, sf_dir, "part").select("p_partkey", records.target_kind(F.col("p_name"), colour).alias("kind"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber - 2 AS page, ['a', CASE WHEN l_orderkey % 3 > 0 THEN 'b' END, 'c'] AS files FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN page < 0 OR page >= 3 THEN 'INVALID_PAGE_MAPPING' WHEN files[page + 1] IS NULL THEN 'INPUT_ERROR' ELSE files[page + 1] END AS file FROM t""")
def target_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = F.array(F.lit("a"), F.when(F.col("l_orderkey") % 3 > 0, "b"), F.lit("c"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", records.page_of_target(F.col("l_linenumber") - 2, files).alias("file"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0.0, l_discount - 0.03) AS x0, greatest(0.0, l_tax - 0.03) AS y0, least(1.0, l_discount + 0.93) AS x1, least(1.0, l_tax + 0.93) AS y1 FROM lineitem")
def expanded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = F.col("l_discount"), F.col("l_tax")
    box = records.expanded_box(d, t, d + 0.9, t + 0.9, 0.03)
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(*keys, *(c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)))


_symbols = "CASE p_partkey % 6 WHEN 0 THEN 'IC2STAA' WHEN 1 THEN '1K2(T0B' WHEN 2 THEN 'ZG25TAB' WHEN 3 THEN '?CZ4MDE' WHEN 4 THEN 'AK|51XY' ELSE '9C25TAA' END"


@query(f"""WITH x AS (SELECT p_partkey, unnest(range(1, 3)) AS i, unnest([{_symbols}, CASE WHEN p_partkey % 5 = 0 THEN '6K25MZZ' ELSE 'none' END]) AS raw FROM part),
y AS (SELECT p_partkey, i, raw, translate(raw[1], 'IL|!()OSBZG?DJAT', '1111110582622347') AS a, translate(raw[2], '01582', 'OISBZ') AS b, translate(raw[3:4], 'IL|!()OSBZG?DJAT', '1111110582622347') AS c, translate(raw[5], '01582', 'OISBZ') AS d, raw[6:7] AS e
  FROM x WHERE regexp_full_match(raw, '[0-9A-Z|!(){{}}\\[\\]?][CKG][0-9A-Z?|!]{{2}}[A-Z][0-9A-Z]{{2}}')),
z AS (SELECT p_partkey, i, raw, a || b || c || d || e AS symbol FROM y)
SELECT p.p_partkey, arg_min(z.raw, z.i) AS raw, arg_min(z.symbol, z.i) AS symbol FROM part p LEFT JOIN z ON z.p_partkey = p.p_partkey AND regexp_matches(z.symbol, '^[1-6][CK][0-9]{{2}}[A-Z][A-Z]{{2}}') GROUP BY 1""")
def coerced_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(f"concat('số ', {_symbols}, ' ', if(p_partkey % 5 = 0, '6K25MZZ', 'none'))")
    got = records.invoice_symbol(text)
    return table(spark, sf_dir, "part").select("p_partkey", got["raw"].alias("raw"), got["symbol"].alias("symbol"))


@query("""WITH x AS (SELECT doc_id, contains(text, 'License') AS a, contains(text, 'token') AS b, contains(text, '@') AS c FROM documents), n AS (SELECT *, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) AS k FROM x)
SELECT doc_id, CASE WHEN k = 1 THEN CASE WHEN a THEN 'LICENSE' WHEN b THEN 'TOKEN' ELSE 'MAIL' END END AS variant, CASE WHEN k = 0 THEN 'FORM_VARIANT_UNRESOLVED' WHEN k > 1 THEN 'FORM_VARIANT_AMBIGUOUS' END AS reason FROM n""")
def form_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, reason = records.variant(F.col("text"), {"LICENSE": "License", "TOKEN": "token", "MAIL": "@"})
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("variant"), reason.alias("reason"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' (Sign HERE)  ' || p_brand), '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS role FROM part")
def role_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.role_name(F.concat("p_name", F.lit(" (Sign HERE)  "), "p_brand")).alias("role"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": ?([0-9]+)', 1) AS BIGINT) AS k FROM events")
def parsed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(tx.fenced_json(fenced), "k long")["k"].alias("k"))


@query("SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN true WHEN event_type = 'error' THEN false END AS truth, count(*) AS n FROM events GROUP BY 1, 2")
def form_booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_type") == "click", " Yes").when(F.col("event_type") == "view", "1").when(F.col("event_type") == "error", "OFF ").otherwise("perhaps")
    return table(spark, sf_dir, "events").groupBy("user_id", tx.truth_of(said).alias("truth")).agg(F.count("*").alias("n"))


@query("SELECT page_id, split_part(url, '/', length(url) - length(replace(url, '/', '')) + 1) AS name, sha256(url) AS fingerprint, left(html, 40) AS head FROM pages")
def page_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.base_name(F.col("url")).alias("name"), F.sha2("url", 256).alias("fingerprint"), F.substring("html", 1, 40).alias("head"))


@query("""WITH p AS (SELECT o_custkey AS g, o_orderkey AS i, o_orderpriority AS kind FROM orders), a AS (SELECT g, list_sort(list(i)) AS children FROM p WHERE kind = '1-URGENT' GROUP BY 1), b AS (SELECT g, list_sort(list(i)) AS children FROM p WHERE kind = '1-URGENT' OR i % 40 = 0 GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM a JOIN b USING (g, children)) AS tp)
SELECT tp, na - tp AS fp, nb - tp AS fn, floor(tp / CAST(na AS DOUBLE) * 10000 + 0.5) / 10000 AS precision, floor(tp / CAST(nb AS DOUBLE) * 10000 + 0.5) / 10000 AS recall FROM n""")
def page_group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweave.operators.evaluate import ratio

    o = table(spark, sf_dir, "orders")

    def groups(rows: DataFrame) -> DataFrame:
        return rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("children"))

    a, b = groups(o.filter("o_orderpriority = '1-URGENT'")), groups(o.filter("o_orderpriority = '1-URGENT' or o_orderkey % 40 = 0"))
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["o_custkey", "children"], "full_outer")
    told = both.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("tp"), F.count_if(F.col("b").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    return told.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


@query("SELECT count(*) AS n_targets, count(*) FILTER (l_linenumber = 1) AS n_first, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS n_found, count(DISTINCT l_orderkey) AS n_documents, max(l_linenumber) AS most FROM lineitem")
def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("n_targets"),
        F.count_if(F.col("l_linenumber") == 1).alias("n_first"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("n_found"),
        F.count_distinct("l_orderkey").alias("n_documents"),
        F.max("l_linenumber").alias("most"),
    )


@query("WITH t AS (SELECT p_brand, count(*) AS n, avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END) AS rate FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 8) SELECT p_brand, n, floor(rate * 10000 + 0.5) / 10000 AS rate FROM t")
def most_frequent_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.avg((F.col("p_size") > 25).cast("double")).alias("rate"))
    return t.orderBy(F.desc("n"), "p_brand").limit(8).select("p_brand", "n", tx.fixed(F.col("rate")).alias("rate"))


@query("WITH s AS (SELECT s_suppkey AS cell, s_nationkey, (s_suppkey % 10) / 10.0 AS x0, (s_suppkey % 10) / 10.0 + 0.1 AS x1 FROM supplier) SELECT c_custkey, cell FROM customer JOIN s ON c_nationkey = s_nationkey WHERE (c_custkey % 100) / 100.0 >= x0 AND (c_custkey % 100) / 100.0 < x1")
def boxes_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweave.operators.measure import points_in_cells

    k = (F.col("s_suppkey") % 10) / 10.0
    cells = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("c_nationkey"), k.alias("x0"), (k + 0.1).alias("x1"))
    points = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", ((F.col("c_custkey") % 100) / 100.0).alias("x"))
    return points_in_cells(points, cells, "c_nationkey").select("c_custkey", "cell")
