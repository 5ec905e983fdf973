"""Reading inputs by explicit schemas, and checking them: what is wrong comes back as rows, not as guesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_FIELDS = ("shipment_id", "invoice_no", "po_no", "transfer_order_no", "pxk_no")

PAGE_RECORD = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("upload_group_id", T.StringType()),
        T.StructField("scan_index", T.IntegerType()),
        T.StructField("doc_type", T.StringType()),
        T.StructField("system", T.StringType()),
        T.StructField("page_role", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("key_fields", T.StructType([T.StructField(k, T.StringType()) for k in KEY_FIELDS])),
        T.StructField("evidence", T.StructType([T.StructField("doc_keyword", T.StringType()), T.StructField("doc_score", T.DoubleType()), T.StructField("sys_keyword", T.StringType()), T.StructField("sys_score", T.DoubleType())])),
    ]
)


def read_json_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON by schema; a malformed record is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_optional(spark: SparkSession, path: str | None, schema: T.StructType, enabled: bool = True) -> tuple[DataFrame, str]:
    """A reference table that may be absent: the rows and LOADED, DISABLED or FILE_NOT_FOUND. A present but malformed one is an error."""
    empty = spark.createDataFrame([], schema)
    if not enabled or path is None:
        return empty, "DISABLED"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return empty, "FILE_NOT_FOUND"
    return read_json_strict(spark, path, schema), "LOADED"


def binary_pages(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """Image files below a folder: path, batch (its folder), true format by the first bytes, sha256 and length. No pixels are decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder)
    head = F.hex(F.substring("content", 1, 4))
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -2).alias("batch"),
        F.when(head.startswith("FFD8FF"), "JPEG").when(head == "89504E47", "PNG").alias("format"),
        F.sha2("content", 256).alias("sha256"),
        "length",
    )


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def unmatched(left: DataFrame, right: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Keys of either side that the other lacks."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti"), b.join(a, list(keys), "left_anti")


def upload_rejects(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Upload groups that break a limit, with the reasons; an upload is taken whole or not at all."""
    bad = F.filter(
        F.array(
            F.when(F.count("*") > max_files, "TOO_MANY_FILES"),
            F.when(F.max("length") > max_bytes, "FILE_TOO_LARGE"),
            F.when(F.bool_or(F.col("format").isNull()), "NOT_AN_IMAGE"),
            F.when(F.count_distinct("scan_index") < F.count("*"), "DUPLICATE_SCAN_INDEX"),
            F.when(F.bool_or(F.col("scan_index").isNull() | (F.col("scan_index") < 0)), "BAD_SCAN_INDEX"),
        ),
        lambda x: x.isNotNull(),
    )
    return files.groupBy("upload_group_id").agg(bad.alias("reasons")).filter(F.size("reasons") > 0)


def stored_name(index: Column, sha256: Column, extension: Column) -> Column:
    return F.format_string("%03d_%s.%s", index, F.substring(sha256, 1, 8), extension)


def complete_record(df: DataFrame, schema: T.StructType, rejects: str | None = None) -> DataFrame:
    """df with exactly the fields of a contract, missing ones null and listed in skipped_steps; with a column of rejects also skipped_reason, which tells where steps were left out what stopped them."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    fields = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    steps = F.array(*map(F.lit, missing)).cast("array<string>")
    reason = [F.when(F.size(steps) > 0, F.concat(F.lit("stopped before these steps: "), F.array_join(F.coalesce(rejects, F.array().cast("array<string>")), " | "))).alias("skipped_reason")] if rejects else []
    return df.select(*(c.alias(f.name) for c, f in zip(fields, schema.fields, strict=True)), steps.alias("skipped_steps"), *reason)


def cleaned(df: DataFrame) -> DataFrame:
    """df as JSON can hold it: numbers that are none are null and NULs are gone from texts, at any depth of structs, arrays and maps."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        if isinstance(kind, T.StringType):
            return F.translate(c, "\u0000", "")
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        if isinstance(kind, T.MapType):
            return F.transform_values(F.transform_keys(c, lambda k, _: clean(k, kind.keyType)), lambda _, x: clean(x, kind.valueType))
        return c

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def batch_key(path: Column, mode: str = "folder", single: str = "BATCH") -> Column:
    """The batch of a file: its folder, what its name says before two underscores (the whole name without its ending if it has none), or one for all."""
    if mode == "single":
        return F.lit(single)
    if mode == "folder":
        return F.element_at(F.split(path, "/"), -2)
    if mode != "prefix":
        raise ValueError("folder, prefix or single")
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")
    return F.split_part(stem, F.lit("__"), F.lit(1))


def run_summary(batches: DataFrame) -> DataFrame:
    """metric, value of a run over batches (n_pages, batch_status): how many there are, and how many of each status."""
    one = batches.agg(F.coalesce(F.sum("n_pages"), F.lit(0)).alias("n_pages"), F.count("*").alias("n_batches"), F.count_if(F.col("batch_status") == "CHUP_LAI").alias("batches_to_retake"))
    told = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in one.columns))).alias("x")).select("x.*")
    return told.unionByName(batches.groupBy(F.concat(F.lit("batches:"), "batch_status").alias("metric")).agg(F.count("*").alias("value")))


def write_run(pages: DataFrame, folder: str, batch: str, page: str) -> None:
    """A run's output below one folder: pages as JSON lines by batch, a manifest line for each page by batch, and the summary. No batch is held in one row."""
    from paperweave.operators.measure import worst_status

    write_records(cleaned(pages), f"{folder}/pages", batch)
    status = worst_status(pages, batch)
    lines = pages.join(status.select(batch, "batch_status"), batch).select(batch, page, "status", "batch_status")
    write_records(lines, f"{folder}/manifests", batch)
    run_summary(status).coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def manifest(batches: DataFrame, batch_id: str, *fields: str) -> DataFrame:
    """One JSON line for each batch, its rows sorted by the fields: the same bytes for the same rows in any order."""
    row = F.struct(*fields)
    return batches.groupBy(batch_id).agg(F.to_json(F.struct(F.col(batch_id).alias("batch_id"), F.count("*").alias("n"), F.array_sort(F.collect_list(row)).alias("documents"))).alias("manifest"))


def write_records(df: DataFrame, path: str, *by: str) -> None:
    """JSON lines below one folder for each value of the given columns."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def write_table(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header; arrays become text joined by semicolons. With a mark every file begins with the byte order mark that spreadsheets look for: it stands before the first name of the header."""
    flat = [F.array_join(n, ";").alias(n) if t.startswith("array<") else F.col(n) for n, t in df.dtypes]
    df.select(*flat).toDF(*[("\ufeff" if mark and i == 0 else "") + n for i, n in enumerate(df.columns)]).write.mode("overwrite").option("header", True).csv(path)


def persisted(results: DataFrame, pages: DataFrame, key: str, widths: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Results cut to the widths of their columns, and what forbids to store them: pages without a result or with several, and results of no page."""
    cut = results.withColumns({c: F.substring(c, 1, n) for c, n in widths.items()})
    lacking, stray = unmatched(pages, results, key)
    wrong = lacking.withColumn("error", F.lit("MISSING_RESULT")).unionByName(stray.withColumn("error", F.lit("NO_SUCH_PAGE")))
    return cut, wrong.unionByName(duplicates(results, key).select(key, F.lit("DUPLICATE_RESULT").alias("error")))
