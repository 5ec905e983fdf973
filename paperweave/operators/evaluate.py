"""Scores of predictions against truth, agreement of annotators, and differences of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.functions.text import fixed


def ratio(a: Column, b: Column) -> Column:
    """a / b to four places; null if b is 0."""
    return fixed(F.try_divide(a.cast("double"), b.cast("double")))


def confusion(predicted: Column, truth: Column) -> list[Column]:
    return [F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"), F.count_if(~predicted & truth).alias("fn"), F.count_if(~predicted & ~truth).alias("tn")]


def with_scores(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return df.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def by_dimension(df: DataFrame, predicted: Column, truth: Column, *dimensions: str) -> DataFrame:
    """Scores overall and for each value of each dimension, from one pass of grouping sets."""
    rows = df.select(*dimensions, predicted.alias("p"), truth.alias("t"))
    sets = [[F.col(d)] for d in dimensions] + [[]]
    told = rows.groupingSets(sets, *map(F.col, dimensions)).agg(F.grouping_id().alias("gid"), *confusion(F.col("p"), F.col("t")))
    width = len(dimensions)
    name = F.lit("overall")
    value = F.lit("all")
    for i, d in enumerate(dimensions):
        mine = F.col("gid") == (1 << width) - 1 - (1 << (width - 1 - i))
        name = F.when(mine, d).otherwise(name)
        value = F.when(mine, F.col(d).cast("string")).otherwise(value)
    return with_scores(told.select(name.alias("dimension"), value.alias("value"), "tp", "fp", "fn", "tn"))


def pairwise(rows: DataFrame, item: str, truth: str, predicted: str) -> DataFrame:
    """Pairs of items together in truth and in prediction, from counts of (truth, predicted) cells; no pair is ever made. A null group is together with nothing."""
    n2 = F.col("n") * (F.col("n") - 1) / 2

    def pairs(*by: str) -> Column:
        some = rows.dropna(subset=list(by)).groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(n2), F.lit(0.0)).cast("long").alias("k"))
        return some.scalar()

    one = rows.sparkSession.range(1).select(pairs(truth, predicted).alias("tp"), pairs(predicted).alias("predicted_pairs"), pairs(truth).alias("truth_pairs"))
    one = one.select("tp", (F.col("predicted_pairs") - F.col("tp")).alias("fp"), (F.col("truth_pairs") - F.col("tp")).alias("fn"))
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return one.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def per_field(rows: DataFrame, fields: list[str], truth_suffix: str = "_gt") -> DataFrame:
    """Of each field: present in truth, predicted, and equal."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("p"), F.col(f + truth_suffix).cast("string").alias("t")) for f in fields))).alias("x")
    x = rows.select(pairs).select("x.*")
    return x.groupBy("field").agg(F.count_if(F.col("t").isNotNull()).alias("n_truth"), F.count_if(F.col("p").isNotNull()).alias("n_predicted"), F.count_if(F.col("p") == F.col("t")).alias("n_exact"))


def votes_by_item(labels: DataFrame, item: str, label: str) -> DataFrame:
    """Of each item: votes, the strict majority label or null, unanimity, and agreeing pairs of annotators."""
    cell = labels.groupBy(item, label).agg(F.count("*").alias("n"))
    per = cell.groupBy(item).agg(F.sum("n").alias("votes"), F.max_by(label, "n").alias("top"), F.max("n").alias("top_n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agreeing"), F.count("*").alias("n_labels"))
    return per.select(item, "votes", F.when(2 * F.col("top_n") > F.col("votes"), F.col("top")).alias("majority"), (F.col("n_labels") == 1).alias("unanimous"), "agreeing")


def agreement(labels: DataFrame, item: str, label: str) -> DataFrame:
    """Unanimity, majority, mean pairwise agreement and Fleiss' kappa; kappa is null if annotators differ in number or all labels are one."""
    per = votes_by_item(labels, item, label).agg(
        F.count("*").alias("n_items"), F.min("votes").alias("lo"), F.max("votes").alias("hi"), F.count_if("unanimous").alias("unanimous"), F.count_if(F.col("majority").isNotNull()).alias("with_majority"), F.sum("agreeing").alias("agreeing")
    )
    share = labels.groupBy(label).agg(F.count("*").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), 2)).alias("pe"))
    # both sides are one row
    row = per.withColumn("one", F.lit(1)).join(share.withColumn("one", F.lit(1)), "one")
    pairs = (F.col("n_items") * F.col("lo") * (F.col("lo") - 1)).cast("double")
    seen = F.try_divide(F.col("agreeing").cast("double"), pairs)
    kappa = F.when((F.col("lo") == F.col("hi")) & (F.col("lo") >= 2) & (F.abs(1 - F.col("pe")) >= 1e-12), fixed((seen - F.col("pe")) / (1 - F.col("pe"))))
    return row.select("n_items", F.col("lo").alias("n_annotators"), ratio(F.col("unanimous") * 100, F.col("n_items")).alias("pct_unanimous"), ratio(F.col("with_majority") * 100, F.col("n_items")).alias("pct_majority"), fixed(100 * seen).alias("pairwise_agreement"), kappa.alias("fleiss_kappa"))


def parity(left: DataFrame, right: DataFrame, keys: list[str], exact: list[str], close: dict[str, float]) -> DataFrame:
    """Differences of two tables: rows that one side lacks, and rows whose fields differ, by more than a tolerance where there is one."""
    a = left.select(*keys, *(F.col(c).alias(f"l_{c}") for c in [*exact, *close]), F.lit(True).alias("in_l"))
    b = right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in [*exact, *close]), F.lit(True).alias("in_r"))
    differ = [F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), c) for c in exact]
    differ += [F.when(F.coalesce(F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) > tol, F.col(f"l_{c}").isNull() != F.col(f"r_{c}").isNull()), c) for c, tol in close.items()]
    rows = a.join(b, keys, "full_outer")
    kind = F.when(F.col("in_r").isNull(), "LEFT_ONLY").when(F.col("in_l").isNull(), "RIGHT_ONLY").when(F.concat_ws(",", *differ) != "", "DIFFERENT")
    return rows.select(*keys, kind.alias("kind"), F.when(kind == "DIFFERENT", F.concat_ws(",", *differ)).otherwise("").alias("fields")).filter("kind is not null")


def cross_tab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of (row, column) with margins, as rows; margins are named TOTAL."""
    told = df.cube(row, column).agg(F.count("*").alias("n"), F.grouping(row).alias("gr"), F.grouping(column).alias("gc"))
    return told.select(F.when(F.col("gr") == 1, "TOTAL").otherwise(F.col(row).cast("string")).alias(row), F.when(F.col("gc") == 1, "TOTAL").otherwise(F.col(column).cast("string")).alias(column), "n")
