"""Queries on versions against truth and on labels of annotators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.operators import compare
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


_SIDES = {
    "old": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status FROM {orders} WHERE o_orderkey % 13 > 0 UNION ALL SELECT o_orderkey, 'again' FROM {orders} WHERE o_orderkey % 101 = 0",
    "new": "SELECT o_orderkey, CASE WHEN o_orderkey % 14 = 0 THEN 'X' WHEN o_orderkey % 5 = 0 THEN 'Y' ELSE o_orderstatus END AS status FROM {orders} WHERE o_orderkey % 39 > 1 UNION ALL SELECT -o_orderkey, 'stray' FROM {orders} WHERE o_orderkey % 97 = 0",
    "truth": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status FROM {orders} UNION ALL SELECT o_orderkey, 'two' FROM {orders} WHERE o_orderkey % 103 = 0",
}
_sides = ", ".join(f"{s} AS ({t.format(orders='orders')})" for s, t in _SIDES.items())
_grouped = ", ".join(f"g_{s} AS (SELECT o_orderkey, count(*) AS n_{s}, max(status) AS {s} FROM {s} GROUP BY 1)" for s in _SIDES)


@query(f"""WITH {_sides}, {_grouped}, j AS (SELECT coalesce(g_old.o_orderkey, g_new.o_orderkey, g_truth.o_orderkey) AS o_orderkey, coalesce(n_old, 0) AS a, coalesce(n_new, 0) AS b, coalesce(n_truth, 0) AS c, old, new, truth FROM g_old FULL JOIN g_new ON g_old.o_orderkey = g_new.o_orderkey FULL JOIN g_truth ON g_truth.o_orderkey = coalesce(g_old.o_orderkey, g_new.o_orderkey))
SELECT o_orderkey, CASE WHEN a > 1 THEN 'DUPLICATE_OLD' WHEN b > 1 THEN 'DUPLICATE_NEW' WHEN c > 1 THEN 'DUPLICATE_TRUTH' WHEN c = 0 THEN 'NOT_IN_TRUTH' WHEN a = 0 AND b = 0 THEN 'MISSING_BOTH' WHEN a = 0 THEN 'MISSING_OLD' WHEN b = 0 THEN 'MISSING_NEW'
  WHEN old IS NOT DISTINCT FROM truth AND new IS NOT DISTINCT FROM truth THEN 'SAME_RIGHT' WHEN new IS NOT DISTINCT FROM truth THEN 'BETTER' WHEN old IS NOT DISTINCT FROM truth THEN 'WORSE' WHEN old IS NOT DISTINCT FROM new THEN 'SAME_WRONG' ELSE 'BOTH_WRONG' END AS kind, old, new, truth FROM j""")
def versions_against_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    old, new, truth = (spark.sql(t, orders=orders) for t in _SIDES.values())
    return compare.three_way(old, new, truth, ["o_orderkey"], "status")


#: Order lines as labels of items: a line's number is its annotator; some items are not known, some labels are none of the vocabulary.
_LABELS = "SELECT concat('a', l_linenumber) AS annotator, l_orderkey AS item, CASE WHEN l_partkey % 31 = 0 THEN '?' WHEN l_partkey % 37 > 0 THEN l_returnflag END AS vote, l_linestatus AS quality FROM {lineitem}"
_labels = f"l AS ({_LABELS.format(lineitem='lineitem')}), i AS (SELECT o_orderkey AS item FROM orders WHERE o_orderkey % 20 > 0), a AS (SELECT DISTINCT annotator FROM l)"
VOCABULARY = {"vote": {"A", "N", "R"}, "quality": {"F", "O"}}


@query(f"""WITH {_labels}, p AS (SELECT annotator, item, count(*) AS n FROM l GROUP BY 1, 2)
SELECT CASE WHEN vote IS NULL THEN 'FIELD_MISSING' ELSE 'FIELD_NOT_IN_VOCABULARY' END AS fault, annotator, CAST(item AS VARCHAR) AS item, 'vote' AS field FROM l WHERE coalesce(vote, '?') = '?' AND item IN (SELECT item FROM i)
UNION ALL SELECT 'ITEM_UNKNOWN', annotator, CAST(item AS VARCHAR), NULL FROM p WHERE item NOT IN (SELECT item FROM i) UNION ALL SELECT 'ITEM_REPEATED', annotator, CAST(item AS VARCHAR), NULL FROM p WHERE n > 1 AND item IN (SELECT item FROM i)
UNION ALL SELECT 'ITEM_MISSING', a.annotator, CAST(i.item AS VARCHAR), NULL FROM a, i WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.annotator = a.annotator AND p.item = i.item)
UNION ALL SELECT 'TOO_FEW_ANNOTATORS', NULL, NULL, NULL FROM (SELECT count(*) AS n FROM a) WHERE n < 9""")
def label_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.sql(_LABELS, lineitem=table(spark, sf_dir, "lineitem"))
    items = table(spark, sf_dir, "orders").filter("o_orderkey % 20 > 0").select(F.col("o_orderkey").alias("item"))
    return compare.label_faults(labels, items, labels.select("annotator").distinct(), VOCABULARY, least=9)


@query(f"""WITH {_labels}, v AS (SELECT item, 'vote' AS field, vote FROM l UNION ALL SELECT item, 'quality', quality FROM l), c AS (SELECT item, field, vote, count(*) AS n FROM v GROUP BY 1, 2, 3),
g AS (SELECT item, field, CAST(sum(n) AS BIGINT) AS n_votes, max(n) AS top, count(*) AS n_labels, string_agg(concat(coalesce(vote, ''), '=', n), ',' ORDER BY coalesce(vote, '')) AS listed FROM c GROUP BY 1, 2)
SELECT item, field, n_votes, CASE WHEN 2 * top > n_votes THEN (SELECT max(c.vote) FROM c WHERE c.item = g.item AND c.field = g.field AND c.n = g.top) WHEN field = 'vote' THEN 'AMBIGUOUS' END AS label, n_labels = 1 AS unanimous, CASE WHEN 2 * top <= n_votes THEN listed END AS disagreement FROM g""")
def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.merged_labels(spark.sql(_LABELS, lineitem=table(spark, sf_dir, "lineitem")), {"vote": "AMBIGUOUS", "quality": None})
