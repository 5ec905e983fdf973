"""Queries on dictionaries and on streams that run once for each row, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.plans.fixtures import table
from paperweave.sources import dictionaries
from paperweave.sources.lineage import shared_folder, written
from paperweave.streaming import claims
from paperweave.streaming.attempts import drained, read_events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Parts as entries of a dictionary: two of its three lists, some without an id, without keywords or with a null among them, some ids twice.
_ENTRIES = """SELECT CASE p_partkey % 2 WHEN 0 THEN 'doc_rules' ELSE 'system_rules' END AS list, CAST(p_partkey AS INT) AS position, CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN ' ' ELSE concat(p_brand, '/', p_size, '/', p_partkey % 5) END AS id,
  CASE WHEN p_partkey % 13 > 0 THEN {array}(p_type, CASE WHEN p_partkey % 11 > 0 THEN p_name END) END AS keywords FROM {part}"""


@query(f"""WITH e AS ({_ENTRIES.format(array='list_value', part='part')})
SELECT list, position, 'ID_MISSING' AS fault FROM e WHERE coalesce(trim(id), '') = '' UNION ALL SELECT list, position, 'KEYWORDS_MISSING' FROM e WHERE keywords IS NULL UNION ALL SELECT list, position, 'KEYWORD_NULL' FROM e WHERE len(list_filter(keywords, lambda k: k IS NULL)) > 0
UNION ALL SELECT list, min(position), 'ID_REPEATED' FROM e WHERE id IS NOT NULL GROUP BY list, id HAVING count(*) > 1 UNION ALL SELECT x, NULL, 'LIST_EMPTY' FROM (SELECT unnest(['doc_rules', 'system_rules', 'internal_subtype_markers']) AS x) WHERE x NOT IN (SELECT list FROM e)""")
def dictionary_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionaries.rule_faults(spark.sql(_ENTRIES.format(array="array", part="{part}"), part=table(spark, sf_dir, "part")))


@query("""WITH s AS (SELECT n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN concat('x', n_nationkey) WHEN 1 THEN NULL WHEN 2 THEN '0.5' ELSE CAST(n_nationkey AS VARCHAR) END AS value FROM nation), r AS (SELECT n_name AS name FROM nation WHERE n_nationkey < 20 UNION ALL SELECT 'NOWHERE')
SELECT name, CASE WHEN value IS NULL THEN 'THRESHOLD_MISSING' ELSE 'THRESHOLD_NOT_A_NUMBER' END AS fault FROM r LEFT JOIN s USING (name) WHERE value IS NULL OR starts_with(value, 'x')""")
def setting_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation")
    settings = nations.select(F.col("n_name").alias("name"), F.when(k % 4 == 0, F.concat(F.lit("x"), k.cast("string"))).when(k % 4 == 2, "0.5").when(k % 4 == 3, k.cast("string")).alias("value"))
    required = [r[0] for r in nations.filter("n_nationkey < 20").select("n_name").collect()]
    return dictionaries.threshold_faults(settings, [*required, "NOWHERE"])


#: Beginnings of nations' names as keywords of a dictionary, by region.
_PHRASES = "SELECT concat('region', n_regionkey) AS list, n_name AS id, {array}(lower(substr(n_name, 1, 3)), substr(n_name, 1, 5)) AS keywords FROM {nation}"


@query(f"WITH r AS ({_PHRASES.format(array='list_value', nation='nation')}), k AS (SELECT list, id, unnest(keywords) AS keyword FROM r) SELECT doc_id, list, id, keyword FROM documents JOIN k ON contains(upper(text), upper(keyword))")
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which keywords of a dictionary table whole texts contain."""
    rules = spark.sql(_PHRASES.format(array="array", nation="{nation}"), nation=table(spark, sf_dir, "nation"))
    return dictionaries.phrase_hits(table(spark, sf_dir, "documents"), rules, F.col("text"), "doc_id")


WORKERS = 3


@query("SELECT event_id AS job_id, concat('worker-', event_id % 3) AS locked_by, 'RUNNING' AS status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created FROM events WHERE event_type IN ('purchase', 'signup')")
def claimed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that a stream delivers, a third of them twice, each claimed by one worker."""
    schema = table(spark, sf_dir, "events").schema
    jobs = read_events(spark, sf_dir, schema, "events.parquet").filter(F.col("event_type").isin("purchase", "signup")).select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"))
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    drained(jobs.union(jobs.filter("job_id % 3 = 1")), f"{folder}_progress", lambda batch, number: claims.claim(batch, number, folder, WORKERS))
    held = claims.ledger(spark, folder)
    return claims.running(held).join(held.select("job_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created")), "job_id").select("job_id", "locked_by", "status", "created")


@query("SELECT event_id AS review_id, user_id AS page_id, event_id % 6 AS target_index, CASE event_type WHEN 'click' THEN 'SIGNED' WHEN 'view' THEN 'NOT_SIGNED' ELSE 'UNCLEAR' END AS decision FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def appended_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that a stream delivers, half of them twice, in a table that is only appended to."""
    schema = table(spark, sf_dir, "events").schema
    events = read_events(spark, sf_dir, schema, "events.parquet").filter(F.col("event_type").isin("click", "view", "purchase"))
    decision = F.when(F.col("event_type") == "click", "SIGNED").when(F.col("event_type") == "view", "NOT_SIGNED").otherwise("UNCLEAR")
    told = events.select(F.col("event_id").alias("review_id"), F.col("user_id").alias("page_id"), (F.col("event_id") % 6).alias("target_index"), decision.alias("decision"), F.col("ts").cast("timestamp").alias("created_at"))
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    claims.append(claims.new_reviews(told.union(told.filter("review_id % 2 = 0")), "3650 days", "review_id"), folder, f"{folder}_progress")
    return written(spark.read.parquet(folder).select("review_id", "page_id", "target_index", "decision"))
