"""Dictionaries of phrases and other settings as tables: what is malformed comes back as rows, and a file that cannot be read is empty with a warning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.sources.lineage import written

CORRUPT = "_corrupt"
#: The rule lists of a dictionary and what names their entries.
RULE_LISTS = {"doc_rules": "doc_type", "system_rules": "system", "internal_subtype_markers": "subtype"}
#: Rules that a driver takes as literals at most; more have to be joined.
MOST_RULES = 10_000


def read_lenient(spark: SparkSession, path: str | None, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON file by schema, and warnings (path, reason). A file that is not there, or records that do not fit, give no rows but a warning each; nothing is guessed and nothing fails."""
    warnings = T.StructType([T.StructField("path", T.StringType()), T.StructField("reason", T.StringType())])
    empty = spark.createDataFrame([], schema)
    if path is None:
        return empty, spark.createDataFrame([], warnings)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return empty, spark.createDataFrame([(path, "FILE_NOT_FOUND")], warnings)
    own = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(own).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", True).json(path)
    kept = written(rows.select(*schema.fieldNames(), F.input_file_name().alias("path__"), CORRUPT))  # Spark reads the column of corrupt records only beside others
    bad = kept.filter(F.col(CORRUPT).isNotNull()).select(F.col("path__").alias("path"), F.lit("MALFORMED_RECORD").alias("reason"))
    return kept.filter(F.col(CORRUPT).isNull()).select(*schema.fieldNames()), bad


def rule_faults(rules: DataFrame, lists: list[str] | None = None) -> DataFrame:
    """Faults of rule lists as rows (list, position, fault): a list without rules, a rule without an id or keywords, keywords that are null, and ids that repeat. rules: list, position, id, keywords. One pass over the rules and one join
    with the lists that must be there."""
    wanted = rules.sparkSession.createDataFrame([(x,) for x in lists or RULE_LISTS], "list string")
    faults = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "ID_MISSING"),
            F.when(F.col("keywords").isNull(), "KEYWORDS_MISSING"),
            F.when(F.exists("keywords", lambda k: k.isNull()), "KEYWORD_NULL"),
        )
    )
    single = rules.select("list", "position", F.explode(faults).alias("fault"))
    per_id = rules.filter("id is not null").groupBy("list", "id").agg(F.count("*").alias("n"), F.min("position").alias("position")).filter("n > 1")
    empty = wanted.join(rules.select("list").distinct(), "list", "left_anti").select("list", F.lit(None).cast("int").alias("position"), F.lit("LIST_EMPTY").alias("fault"))
    return single.unionByName(per_id.select("list", "position", F.lit("ID_REPEATED").alias("fault"))).unionByName(empty)


def threshold_faults(settings: DataFrame, required: list[str]) -> DataFrame:
    """Thresholds that are missing or not numbers: name, fault. settings: name, value (as it is written)."""
    wanted = settings.sparkSession.createDataFrame([(x,) for x in required], "name string").join(settings.groupBy("name").agg(F.max("value").alias("value")), "name", "left")
    fault = F.when(F.col("value").isNull(), "THRESHOLD_MISSING").when(F.expr("try_cast(value as double)").isNull(), "THRESHOLD_NOT_A_NUMBER")
    return wanted.select("name", fault.alias("fault")).filter("fault is not null")


def label_faults(columns: DataFrame, required: list[str]) -> DataFrame:
    """Faults of a dictionary of column labels (index and the required keys as columns, null where absent): index, fault; fewer than two columns is a fault of its own."""
    lacking = F.array_compact(F.array(*(F.when(F.col(k).isNull(), F.concat(F.lit("KEY_MISSING:"), F.lit(k))) for k in required)))
    rows = columns.select(F.col("index").cast("string").alias("index"), F.explode(lacking).alias("fault"))
    few = columns.agg(F.count("*").alias("n")).filter("n < 2").select(F.lit(None).cast("string").alias("index"), F.lit("FEWER_THAN_TWO_COLUMNS").alias("fault"))
    return rows.unionByName(few)


def phrase_rules(rules: DataFrame, name: str) -> dict[str, list[str]]:
    """One list of a dictionary as phrases by id, in order, for the functions that take literals. It must be sound and no longer than MOST_RULES."""
    rows = rules.filter(F.col("list") == name).select("position", "id", "keywords").orderBy("position").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"{name} has more than {MOST_RULES} rules; join them")
    if not rows or any(not r["id"] or r["keywords"] is None for r in rows) or len({r["id"] for r in rows}) < len(rows):
        raise ValueError(f"{name} is not sound; see rule_faults")
    return {r["id"]: list(r["keywords"]) for r in rows}


def phrase_hits(texts: DataFrame, rules: DataFrame, text: Column, *keys: str) -> DataFrame:
    """keys, list, id and keyword of every keyword of a dictionary table that a text contains, upper-case. Up to MOST_RULES keywords are literals, looked for in one pass of each text; more meet texts by their rarest n-gram."""
    from paperweave.operators.containment import containing

    words = rules.select("list", "id", F.explode("keywords").alias("keyword")).filter("keyword is not null").withColumn("key", F.upper("keyword"))
    known = [r[0] for r in words.filter("key <> ''").select("key").distinct().limit(MOST_RULES + 1).collect()]
    rows = texts.select(*keys, F.upper(text).alias("value"))
    if len(known) > MOST_RULES:
        held = containing(rows, words.select("key")).select(*keys, "key")
    else:
        held = rows.select(*keys, F.explode(F.filter(F.lit(sorted(known)).cast("array<string>"), lambda k: F.contains("value", k))).alias("key"))
    return held.join(words, "key").select(*keys, "list", "id", "keyword")
