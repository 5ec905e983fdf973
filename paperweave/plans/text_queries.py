"""Queries on texts, measures and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.functions import text as tx
from paperweave.operators import classify, evaluate, measure
from paperweave.plans.fixtures import TEXT_STATS, table, text_stats

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_norm = "trim(regexp_replace(regexp_replace(replace(upper(replace(strip_accents(coalesce({}, '')), 'ß', 'ss')), 'Đ', 'D'), '[^A-Z0-9\\s:/._#-]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, length({_norm.format('text')}) AS n, md5({_norm.format('text')}) AS digest FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = tx.normalized(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(clean).cast("long").alias("n"), F.md5(clean).alias("digest"))


#: A dictionary of phrases that occur in the texts.
RULES = [("LICENSE", ["ALL RIGHTS RESERVED", "LICENSED UNDER THE APACHE LICENSE"]), ("CREDENTIAL", ["TOKEN", "PASSWORD"]), ("ENGLISH", ["OF THE", "THE AND"]), ("GERMAN", ["UND DER", "DER UND", "LICH DER"]), ("SPANISH", ["DE LA", "DE LOS"]), ("FRENCH", ["DE LES", "LES DE"])]


def _found(rules: list[tuple[str, list[str]]]) -> str:
    rows = []
    for i, (name, phrases) in enumerate(rules):
        rows += [f"({i}, {j}, '{name}', '{p}', {1 + min(len(p) / 100, 0.1)})" for j, p in enumerate(phrases)]
    return f"""d AS (SELECT doc_id, {_norm.format('text')} AS t FROM documents), dict(i, j, type, phrase, raw) AS (VALUES {", ".join(rows)}),
hit AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY raw DESC, j) AS k FROM d JOIN dict ON contains(t, phrase)),
cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY least(raw, 1.0) DESC, length(phrase) DESC, i) AS place FROM hit WHERE k = 1),
top AS (SELECT doc_id, type, phrase, least(raw, 1.0) AS score FROM cand WHERE place = 1),
rival AS (SELECT c.doc_id, max(least(c.raw, 1.0)) AS score FROM cand c JOIN top USING (doc_id) WHERE place > 1 AND NOT contains(top.phrase, c.phrase) GROUP BY 1),
best AS (SELECT d.doc_id, coalesce(top.type, 'UNKNOWN') AS doc_type, CAST(coalesce(top.score, 0) AS DOUBLE) AS doc_score, CAST(coalesce(top.score - coalesce(rival.score, 0), 0) AS DOUBLE) AS margin, top.phrase FROM d LEFT JOIN top USING (doc_id) LEFT JOIN rival USING (doc_id))"""


@query(f"WITH {_found(RULES)} SELECT * FROM best")
def classify_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.normalized(F.col("text")).alias("t"))
    return classify.best_type(docs, F.col("t"), RULES).drop("t")


@query(f"""WITH {_found(RULES)}, g AS (SELECT doc_id, doc_type, floor((0.7 * doc_score + 0.3 * CASE WHEN doc_id % 3 = 0 THEN 0.1 ELSE 0.8 END) * 100 + 0.5) / 100 AS confidence, margin FROM best)
SELECT doc_id, confidence, CASE WHEN doc_type = 'UNKNOWN' THEN 'CHUA_DAT' WHEN confidence >= 0.78 AND margin >= 0.10 THEN 'DAT' WHEN confidence >= 0.5 THEN 'CANH_BAO' ELSE 'CHUA_DAT' END AS status FROM g""")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify_margin(spark, sf_dir)
    system = F.when(F.col("doc_id") % 3 == 0, 0.1)
    confidence, status = measure.confidence_gate(F.col("doc_type"), F.col("doc_score"), F.col("margin"), system)
    return rows.select("doc_id", confidence.alias("confidence"), status.alias("status"))


FUZZY_RULES = [("A", ["INTERNATIONAL", "THE ANOTHER"]), ("B", ["HERETIONTHE", "ANDTHERIN"])]


@query()
def classify_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts against phrases that may be misspelt."""
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.normalized(F.col("text")).alias("t"))
    return classify.best_type(docs, F.col("t"), FUZZY_RULES, fuzzy=True).drop("t")


@query("""SELECT doc_id, coalesce(nullif(regexp_extract(text, '[Tt]oken ?[:=] ?"?([0-9a-f]{8})', 1), ''), nullif(regexp_extract(text, '([0-9]{3}-[0-9]{2,4}-[0-9]{4})', 1), ''), CASE WHEN regexp_full_match(regexp_extract(text, '([A-Za-z0-9._]+)@[a-z]', 1), '[a-z]+[.][a-z]+') THEN regexp_extract(text, '([A-Za-z0-9._]+)@[a-z]', 1) END) AS key FROM documents""")
def extract_key_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = classify.first_match(F.col("text"), [('[Tt]oken ?[:=] ?"?([0-9a-f]{8})', None), ("([0-9]{3}-[0-9]{2,4}-[0-9]{4})", None), ("([A-Za-z0-9._]+)@[a-z]", "[a-z]+[.][a-z]+")])
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("key"))


@query("""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat('I', o_custkey) WHEN 1 THEN concat(' L', o_custkey, ' ') ELSE concat('X', o_custkey) END AS a, CAST(10000 + o_custkey AS VARCHAR) AS b FROM orders),
y AS (SELECT o_orderkey, CASE WHEN regexp_full_match(trim(a), '[IL][0-9]+') THEN '1' || substr(trim(a), 2) ELSE trim(a) END AS a, b FROM x)
SELECT o_orderkey, a AS repaired, CASE WHEN length(a) = length(b) THEN hamming(a, b) <= 2 ELSE starts_with(a, b) OR starts_with(b, a) END AS near FROM y""")
def repair_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("I"), c)).when(k == 1, F.concat(F.lit(" L"), c, F.lit(" "))).otherwise(F.concat(F.lit("X"), c))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", tx.repaired_id(raw).alias("repaired"), (F.col("o_custkey") + 10000).cast("string").alias("b"))
    return rows.select("o_orderkey", "repaired", tx.near_equal(F.col("repaired"), F.col("b")).alias("near"))


LIMITS = [("n", "low", 120.0, 400.0), ("n_lines", "high", 60.0, 25.0), ("letter_pct", "low", 55.0, 70.0)]
_flags = {kind: "[x FOR x IN [" + ", ".join(f"CASE WHEN {c} {'<' if s == 'low' else '>'} {r if kind == 'reject' else w}{'' if kind == 'reject' else f' AND NOT {c} {chr(60) if s == chr(108) + chr(111) + chr(119) else chr(62)} {r}'} THEN '{c}' END" for c, s, r, w in LIMITS) + "] IF x IS NOT NULL]" for kind in ("reject", "warn")}
_gated = f"s AS ({TEXT_STATS}), f AS (SELECT *, {_flags['reject']} AS rejects, {_flags['warn']} AS warns FROM s), g AS (SELECT *, CASE WHEN len(rejects) > 0 THEN 'CHUP_LAI' WHEN len(warns) > 0 THEN 'CANH_BAO' ELSE 'DAT' END AS status FROM f)"


@query(f"WITH {_gated} SELECT doc_id, array_to_string(rejects, ',') AS rejects, array_to_string(warns, ',') AS warns, status, CASE WHEN status = 'CHUP_LAI' THEN 'YEU_CAU_CHUP_LAI' ELSE 'CHUYEN_TANG_2' END AS action FROM g")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measure.gated(text_stats(table(spark, sf_dir, "documents")), LIMITS)
    return rows.select("doc_id", F.array_join("rejects", ",").alias("rejects"), F.array_join("warns", ",").alias("warns"), "status", "action")


@query(f"WITH {_gated} SELECT source, count(*) AS n_pages, count(*) FILTER (status = 'CHUP_LAI') AS n_retake, count(*) FILTER (status = 'CANH_BAO') AS n_warn, CASE max(CASE status WHEN 'CHUP_LAI' THEN 2 WHEN 'CANH_BAO' THEN 1 ELSE 0 END) WHEN 2 THEN 'CHUP_LAI' WHEN 1 THEN 'CANH_BAO' ELSE 'DAT' END AS batch_status FROM g GROUP BY 1")
def worst_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.worst_status(measure.gated(text_stats(table(spark, sf_dir, "documents")), LIMITS), "source")


@query(f"""WITH s AS ({TEXT_STATS}), v AS (SELECT doc_id, unnest([{{'name': 'length', 'vote': CASE WHEN n > 2000 THEN 1.0 ELSE -1.0 END, 'weight': 0.5}}, {{'name': 'lines', 'vote': CASE WHEN n_lines > 12 THEN 1.0 WHEN n_lines < 3 THEN -0.5 ELSE 0.0 END, 'weight': 0.3}}, {{'name': 'letters', 'vote': CASE WHEN letter_pct > 80 THEN -1.0 ELSE 0.25 END, 'weight': 0.4}}, {{'name': 'id', 'vote': (doc_id % 5 - 2) / 2.0, 'weight': 0.25}}]) AS x FROM s),
g AS (SELECT doc_id, sum(x.vote * x.weight) / sum(x.weight) AS score, list({{'k': -abs(x.vote * x.weight), 'name': x.name}} ORDER BY -abs(x.vote * x.weight), x.name) AS top FROM v GROUP BY 1)
SELECT doc_id, floor(score * 10000 + 0.5) / 10000 AS score, CASE WHEN score > 0 THEN 'photo' ELSE 'scan' END AS type, floor(least(1.0, abs(score) / 0.45) * 1000 + 0.5) / 1000 AS confidence, array_to_string([t.name FOR t IN top[1:3]], ',') AS reasons FROM g""")
def vote_source_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text_stats(table(spark, sf_dir, "documents"))

    def vote(name: str, value, weight: float):
        return F.struct(F.lit(name).alias("name"), value.cast("double").alias("vote"), F.lit(weight).alias("weight"))

    votes = F.array(
        vote("length", F.when(F.col("n") > 2000, 1.0).otherwise(-1.0), 0.5),
        vote("lines", F.when(F.col("n_lines") > 12, 1.0).when(F.col("n_lines") < 3, -0.5).otherwise(0.0), 0.3),
        vote("letters", F.when(F.col("letter_pct") > 80, -1.0).otherwise(0.25), 0.4),
        vote("id", (F.col("doc_id") % 5 - 2) / 2.0, 0.25),
    )
    return measure.weighted_votes(s.select("doc_id", F.explode(votes).alias("v")).select("doc_id", "v.*"), "doc_id")


_scored = "x AS (SELECT l.doc_id, l.quality = 1 AS truth, length(d.text) > 1500 AS predicted, d.lang, d.source, l.toxic FROM labels l JOIN documents d USING (doc_id))"
_scores = "floor(tp / nullif(CAST(tp + fp AS DOUBLE), 0) * 10000 + 0.5) / 10000 AS precision, floor(tp / nullif(CAST(tp + fn AS DOUBLE), 0) * 10000 + 0.5) / 10000 AS recall, floor(2.0 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0) * 10000 + 0.5) / 10000 AS f1"


def _scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") > 1500).alias("predicted"), "lang", "source")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", (F.col("quality") == 1).alias("truth"), "predicted", "lang", "source", "toxic")


@query(f"""WITH {_scored}, c AS (SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' WHEN grouping(toxic) = 0 THEN 'toxic' ELSE 'overall' END AS dimension, coalesce(lang, source, CAST(toxic AS VARCHAR), 'all') AS value,
  count(*) FILTER (predicted AND truth) AS tp, count(*) FILTER (predicted AND NOT truth) AS fp, count(*) FILTER (NOT predicted AND truth) AS fn, count(*) FILTER (NOT predicted AND NOT truth) AS tn FROM x GROUP BY GROUPING SETS ((lang), (source), (toxic), ()))
SELECT *, {_scores}, floor((tp + tn) / nullif(CAST(tp + fp + fn + tn AS DOUBLE), 0) * 10000 + 0.5) / 10000 AS accuracy FROM c""")
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_dimension(_scored_rows(spark, sf_dir), F.col("predicted"), F.col("truth"), "lang", "source", "toxic")


@query("""WITH x AS (SELECT CAST(o_orderstatus AS VARCHAR) AS a, CASE WHEN o_custkey % 9 > 0 THEN o_orderstatus END AS a_gt, o_orderpriority AS b, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority ELSE '1-URGENT' END AS b_gt FROM orders),
u AS (SELECT 'status' AS field, a AS p, a_gt AS t FROM x UNION ALL SELECT 'priority', b, b_gt FROM x)
SELECT field, count(t) AS n_truth, count(p) AS n_predicted, count(*) FILTER (p = t) AS n_exact FROM u GROUP BY 1""")
def field_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_custkey") % 9 > 0, F.col("o_orderstatus")).alias("status_gt"),
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).otherwise("1-URGENT").alias("priority_gt"),
    )
    return evaluate.per_field(rows, ["status", "priority"])


@query(f"WITH {_scored} SELECT CASE WHEN predicted AND NOT truth AND toxic = 1 THEN 'TOXIC_OVERRATED' WHEN predicted AND NOT truth THEN 'OVERRATED' WHEN truth AND NOT predicted THEN 'SHORT_BUT_GOOD' ELSE 'RIGHT' END AS kind, count(*) AS n, floor(100.0 * count(*) / (SELECT count(*) FROM x) * 100 + 0.5) / 100 AS pct FROM x GROUP BY 1")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = tx.first_where([(F.col("predicted") & ~F.col("truth") & (F.col("toxic") == 1), "TOXIC_OVERRATED"), (F.col("predicted") & ~F.col("truth"), "OVERRATED"), (F.col("truth") & ~F.col("predicted"), "SHORT_BUT_GOOD")], "RIGHT")
    rows = _scored_rows(spark, sf_dir).select(kind.alias("kind"))
    total = rows.agg(F.count("*")).scalar()
    return rows.groupBy("kind").agg(F.count("*").alias("n")).withColumn("pct", tx.fixed(100.0 * F.col("n") / total, 2))


@query("SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'TOTAL' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN grouping(o_orderpriority) = 1 THEN 'TOTAL' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def crosstab_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cross_tab(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query(f"""WITH x AS (SELECT label AS truth, CAST(floor(embedding[1] * 20) AS BIGINT) AS predicted FROM embeddings), p AS (SELECT (SELECT CAST(sum(n * (n - 1) / 2) AS BIGINT) FROM (SELECT count(*) AS n FROM x GROUP BY truth, predicted)) AS tp, (SELECT CAST(sum(n * (n - 1) / 2) AS BIGINT) FROM (SELECT count(*) AS n FROM x GROUP BY predicted)) AS pp, (SELECT CAST(sum(n * (n - 1) / 2) AS BIGINT) FROM (SELECT count(*) AS n FROM x GROUP BY truth)) AS tt),
q AS (SELECT tp, pp - tp AS fp, tt - tp AS fn FROM p) SELECT *, {_scores} FROM q""")
def pairwise_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("truth"), F.floor(F.get("embedding", F.lit(0)).cast("double") * 20).alias("predicted"))
    return evaluate.pairwise(rows, "vec_id", "truth", "predicted")


_votes = "v AS (SELECT l.doc_id, unnest([CASE WHEN quality = 1 THEN 'GOOD' ELSE 'BAD' END, CASE WHEN length(text) > 900 THEN 'GOOD' ELSE 'BAD' END, CASE WHEN toxic = 1 THEN 'UNCLEAR' WHEN l.doc_id % 7 = 0 THEN 'BAD' ELSE 'GOOD' END]) AS vote FROM labels l JOIN documents USING (doc_id))"


def _vote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    third = F.when(F.col("toxic") == 1, "UNCLEAR").when(F.col("doc_id") % 7 == 0, "BAD").otherwise("GOOD")
    return rows.select("doc_id", F.explode(F.array(F.when(F.col("quality") == 1, "GOOD").otherwise("BAD"), F.when(F.length("text") > 900, "GOOD").otherwise("BAD"), third)).alias("vote"))


@query(f"""WITH {_votes}, c AS (SELECT doc_id, vote, count(*) AS n FROM v GROUP BY 1, 2), i AS (SELECT doc_id, sum(n) AS m, max(n) AS top, sum(n * (n - 1)) AS agreeing, count(*) AS k FROM c GROUP BY 1), s AS (SELECT sum(n * n) / pow(sum(n), 2) AS pe FROM (SELECT vote, count(*) AS n FROM v GROUP BY 1)),
a AS (SELECT count(*) AS n_items, CAST(min(m) AS BIGINT) AS n_annotators, count(*) FILTER (k = 1) AS u, count(*) FILTER (2 * top > m) AS w, sum(agreeing) / CAST(count(*) * min(m) * (min(m) - 1) AS DOUBLE) AS po FROM i)
SELECT n_items, n_annotators, floor(100.0 * u / n_items * 10000 + 0.5) / 10000 AS pct_unanimous, floor(100.0 * w / n_items * 10000 + 0.5) / 10000 AS pct_majority, floor(100 * po * 10000 + 0.5) / 10000 AS pairwise_agreement, floor((po - pe) / (1 - pe) * 10000 + 0.5) / 10000 AS fleiss_kappa FROM a, s""")
def fleiss_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.agreement(_vote_rows(spark, sf_dir), "doc_id", "vote")


@query(f"WITH {_votes}, c AS (SELECT doc_id, vote, count(*) AS n FROM v GROUP BY 1, 2) SELECT doc_id, CAST(sum(n) AS BIGINT) AS votes, max(vote) FILTER (n >= 2) AS majority, count(*) = 1 AS unanimous FROM c GROUP BY 1")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.votes_by_item(_vote_rows(spark, sf_dir), "doc_id", "vote").drop("agreeing")


@query("""WITH a AS (SELECT * FROM orders WHERE o_orderkey % 50 > 0), b AS (SELECT o_orderkey + CASE WHEN o_orderkey % 61 = 0 THEN 100000000 ELSE 0 END AS o_orderkey, CASE WHEN o_orderkey % 37 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice + CASE o_orderkey % 29 WHEN 0 THEN 0.5 WHEN 1 THEN 0.001 ELSE 0 END AS o_totalprice FROM orders),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'LEFT_ONLY' WHEN a.o_orderkey IS NULL THEN 'RIGHT_ONLY' ELSE 'DIFFERENT' END AS kind, concat_ws(',', CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN abs(a.o_totalprice - b.o_totalprice) > 0.01 THEN 'o_totalprice' END) AS fields FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT * FROM j WHERE kind <> 'DIFFERENT' OR fields <> ''""")
def parity_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    other = o.select(
        (k + F.when(k % 61 == 0, 100000000).otherwise(0)).alias("o_orderkey"),
        F.when(k % 37 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        (F.col("o_totalprice") + F.when(k % 29 == 0, 0.5).when(k % 29 == 1, 0.001).otherwise(0.0)).alias("o_totalprice"),
    )
    return evaluate.parity(o.filter(k % 50 > 0), other, ["o_orderkey"], ["o_orderstatus"], {"o_totalprice": 0.01})


_box = "CASE WHEN m <= 0.03 THEN 'STABLE' WHEN m <= 0.05 THEN 'NEAR' ELSE 'DRIFTS' END"


@query(f"WITH b AS (SELECT p_brand AS role, floor((max(p_size / 1000.0) - min(p_size / 1000.0)) * 10000 + 0.5) / 10000 AS dx, floor((max(p_retailprice / 40000.0) - min(p_retailprice / 40000.0)) * 10000 + 0.5) / 10000 AS dy, count(*) AS n FROM part GROUP BY 1), c AS (SELECT *, greatest(dx, dy) AS m FROM b) SELECT role, n, dx, dy, {_box} AS drift FROM c")
def box_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("role"), (F.col("p_size") / 1000.0).alias("x"), (F.col("p_retailprice") / 40000.0).alias("y"))
    return measure.box_drift(boxes, "role")


@query("""WITH o AS (SELECT l_orderkey AS cluster, l_suppkey % 4 AS cell, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), s AS (SELECT cluster, cell, q / sum(q) OVER (PARTITION BY cluster) AS share FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY share DESC, cell DESC) AS k, count(*) OVER (PARTITION BY cluster) AS n_touched FROM s),
g AS (SELECT cluster, max(share) FILTER (k = 1) AS a, coalesce(max(share) FILTER (k = 2), 0) AS b, max(cell) FILTER (k = 1) AS cell, max(n_touched) AS n_touched FROM r GROUP BY 1)
SELECT cluster, CASE WHEN b >= 0.25 THEN 'SHARED' WHEN a >= 0.5 THEN 'OWNED' ELSE 'ORPHAN' END AS ownership, CASE WHEN b < 0.25 AND a >= 0.5 THEN cell END AS owner, n_touched, floor(a * 10000 + 0.5) / 10000 AS best_share FROM g""")
def spatial_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cluster"), (F.col("l_suppkey") % 4).alias("cell")).agg(F.sum("l_quantity").alias("q"))
    return measure.owning_cell(cells.withColumn("share", F.col("q") / F.sum("q").over(W.partitionBy("cluster"))), "cluster", "cell")


@query("SELECT c_nationkey AS g, count(*) AS n, floor(regr_slope(c_acctbal, c_custkey) * 10000 + 0.5) / 10000 AS slope, floor(regr_intercept(c_acctbal, c_custkey) * 10000 + 0.5) / 10000 AS intercept FROM customer GROUP BY 1")
def column_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.fitted(table(spark, sf_dir, "customer").withColumn("g", F.col("c_nationkey")), "g", "c_custkey", "c_acctbal")


_HITS = "SELECT l_orderkey AS page, l_linenumber % 6 AS place, (l_linenumber % 6) * (CASE WHEN l_orderkey % 11 = 0 THEN 0.3 WHEN l_orderkey % 13 = 0 THEN -0.2 ELSE 0.15 END) + l_discount / 9.7 + l_tax / 21.3 AS value FROM {lineitem}"


@query(f"""WITH h AS ({_HITS.format(lineitem='lineitem')}), m AS (SELECT page, place, quantile_cont(value, 0.5) AS m FROM h WHERE place < 5 GROUP BY 1, 2), g AS (SELECT page, count(*) AS n, regr_slope(m, place) AS b, regr_intercept(m, place) AS a FROM m GROUP BY 1),
r AS (SELECT page, bool_and(up) AS up FROM (SELECT page, coalesce(m > lag(m) OVER (PARTITION BY page ORDER BY place), true) AS up FROM m) GROUP BY 1),
c AS (SELECT g.page, i AS place, n, b, up, coalesce(m.m, a + b * i) AS centre, m.m IS NOT NULL AS hit FROM g JOIN r USING (page), (SELECT unnest(range(0, 5)) AS i) LEFT JOIN m ON m.page = g.page AND m.place = i),
w AS (SELECT page, bool_and(up) AS rising FROM (SELECT page, coalesce(centre > lag(centre) OVER (PARTITION BY page ORDER BY place), true) AS up FROM c) GROUP BY 1),
s AS (SELECT c.*, CASE WHEN n < 3 THEN 'COLUMN_DETECTION_FAILED' WHEN NOT up THEN 'COLUMN_ORDER_VIOLATION' WHEN NOT coalesce(b BETWEEN 0.1 AND 0.25, false) THEN 'COLUMN_PITCH_IMPLAUSIBLE' WHEN NOT rising THEN 'COLUMN_ORDER_VIOLATION' ELSE 'COLUMNS_FROM_LABELS' END AS status FROM c JOIN w USING (page))
SELECT page, status, CAST(place AS INT) AS place, CASE WHEN status = 'COLUMNS_FROM_LABELS' THEN floor(centre * 10000 + 0.5) / 10000 END AS centre, CASE WHEN status = 'COLUMNS_FROM_LABELS' THEN CASE WHEN hit THEN 'OCR_LABEL' ELSE 'INTERPOLATED' END END AS source FROM s""")
def filled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.filled_columns(spark.sql(_HITS, lineitem=table(spark, sf_dir, "lineitem")), "page", 5, 3, (0.10, 0.25))


@query("""WITH e AS (SELECT user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec FROM events WHERE event_type = 'error'), n AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec) > 200000 THEN 1 ELSE 0 END AS new FROM e),
c AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY sec ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM n) SELECT user_id, cluster, count(*) AS n, floor(quantile_cont(sec, 0.5) * 10000 + 0.5) / 10000 AS median FROM c GROUP BY 1, 2""")
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", F.col("ts").cast("timestamp").cast("long").alias("sec"))
    return measure.gap_clusters(rows, "user_id", "sec", 200000)


@query("""WITH e AS (SELECT user_id, event_id, value > 20 AS on_, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id, value > 20 ORDER BY event_id) AS b FROM events),
r AS (SELECT user_id, max(n) AS longest FROM (SELECT user_id, a - b AS i, count(*) AS n FROM e WHERE on_ GROUP BY 1, 2) GROUP BY 1), t AS (SELECT user_id, count(*) AS n_rows FROM e GROUP BY 1)
SELECT user_id, n_rows, coalesce(longest, 0) AS longest, floor(coalesce(longest, 0) / CAST(n_rows AS DOUBLE) * 10000 + 0.5) / 10000 AS share FROM t LEFT JOIN r USING (user_id)""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.longest_run(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", F.col("value") > 20)


@query("SELECT s_suppkey, s_name, array_to_string([CASE WHEN regexp_full_match(p, '[0-9]+') THEN lpad(p, 12, '0') ELSE p END FOR p IN regexp_extract_all(lower(s_name), '([0-9]+|[^0-9]+)', 1)], '') AS sort_key FROM supplier")
def natural_sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", tx.natural_key(F.col("s_name")).alias("sort_key"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def topk_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '#00000012') OR contains(lower(c_mktsegment), 'uild')")
def search_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.filter(tx.contains_term(F.col("c_name"), "#00000012") | tx.contains_term(F.col("c_mktsegment"), "UILD")).select("c_custkey", "c_name")


@query("SELECT event_id, user_id, CAST(max(least(70, greatest(10, floor(10 + 60.0 * value / 300)))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS percent FROM events")
def monotone_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "events").withColumn("p", measure.progress(F.col("value"), F.lit(300.0), (10, 70)))
    upto = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return rows.select("event_id", "user_id", F.max("p").over(upto).alias("percent"))


@query("""SELECT vec_id, CAST(len(embedding) >= 4 AND list_bool_and([x >= 0 AND x <= 1 FOR x IN embedding[1:4]]) AND embedding[1] < embedding[3] AND embedding[2] < embedding[4] AS BOOLEAN) AS valid FROM embeddings""")
def valid_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", measure.valid_box(F.slice("embedding", 1, 4)).alias("valid"))


@query("""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'BOTH' AS side, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'LEFT', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'RIGHT', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = o.filter("o_orderstatus = 'F'").select("o_custkey").distinct().withColumn("a", F.lit(True))
    b = o.filter("o_orderpriority = '1-URGENT'").select("o_custkey").distinct().withColumn("b", F.lit(True))
    side = F.when(F.col("b").isNull(), "LEFT").when(F.col("a").isNull(), "RIGHT").otherwise("BOTH")
    return a.join(b, "o_custkey", "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))
