"""Two versions of a result against truth, and labels of several annotators merged: what does not fit comes back as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.sources.lineage import written

SIDES = ("old", "new", "truth")


def three_way(old: DataFrame, new: DataFrame, truth: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, kind and the values of the three sides: a full outer comparison in one pass over all rows, grouped by key.

    kind: DUPLICATE_<SIDE> where a side has a key more than once (then nothing is compared), NOT_IN_TRUTH for strays, MISSING_OLD, MISSING_NEW or MISSING_BOTH where truth has what they lack, else SAME_RIGHT,
    SAME_WRONG, BETTER, WORSE, or BOTH_WRONG for two different errors. A null value is a value. Sides are counted, not collected.
    """
    rows = None
    for side, frame in zip(SIDES, (old, new, truth), strict=True):
        own = frame.select(*keys, F.lit(side).alias("side"), F.col(value).cast("string").alias("v"))
        rows = own if rows is None else rows.unionByName(own)
    told = rows.groupBy(*keys).agg(*(F.count_if(F.col("side") == s).alias(f"n_{s}") for s in SIDES), *(F.max(F.when(F.col("side") == s, F.struct("v")))["v"].alias(s) for s in SIDES))
    n_old, n_new, n_truth = (F.col(f"n_{s}") for s in SIDES)
    right_old, right_new = (F.col(s).eqNullSafe(F.col("truth")) for s in ("old", "new"))
    kind = (
        F.when(n_old > 1, "DUPLICATE_OLD").when(n_new > 1, "DUPLICATE_NEW").when(n_truth > 1, "DUPLICATE_TRUTH").when(n_truth == 0, "NOT_IN_TRUTH")
        .when((n_old == 0) & (n_new == 0), "MISSING_BOTH").when(n_old == 0, "MISSING_OLD").when(n_new == 0, "MISSING_NEW")
        .when(right_old & right_new, "SAME_RIGHT").when(right_new, "BETTER").when(right_old, "WORSE").when(F.col("old").eqNullSafe(F.col("new")), "SAME_WRONG").otherwise("BOTH_WRONG")
    )
    return told.select(*keys, kind.alias("kind"), *SIDES)


def label_faults(labels: DataFrame, items: DataFrame, annotators: DataFrame, vocabulary: dict[str, set[str]], least: int = 3) -> DataFrame:
    """What forbids to merge labels, as rows (fault, annotator, item, field): too few annotators, items that are not known, repeated or missing, and fields that are absent or outside their vocabulary.

    labels: annotator, item and a column for each field; items: item; annotators: annotator (all that should have answered).
    """
    none = F.lit(None).cast("string")

    def fault(name: str, rows: DataFrame, annotator: Column, item: Column, field: Column = none) -> DataFrame:
        return rows.select(F.lit(name).alias("fault"), annotator.alias("annotator"), item.cast("string").alias("item"), field.alias("field"))

    a, i = F.col("annotator"), F.col("item")
    bad = [F.when(F.col(f).isNull(), F.struct(F.lit(f).alias("field"), F.lit("FIELD_MISSING").alias("fault"))).when(~F.col(f).isin(sorted(v)), F.struct(F.lit(f).alias("field"), F.lit("FIELD_NOT_IN_VOCABULARY").alias("fault"))) for f, v in vocabulary.items()]
    # most labels have no fault, and for them no list is made
    any_bad = reduce(lambda x, y: x | y, (F.col(f).isNull() | ~F.col(f).isin(sorted(v)) for f, v in vocabulary.items()), F.lit(False))
    fields = labels.filter(any_bad).select("annotator", "item", F.explode(F.array_compact(F.array(*bad))).alias("b")).join(items.select("item"), "item", "left_semi")
    # a row for each item, written once: whether it is known, and who told it how often; all but the fields is read from there without dealing anything again
    told = labels.select("annotator", "item").repartition("item").groupBy("item", "annotator").agg(F.count("*").alias("n")).groupBy("item").agg(F.collect_list(F.struct("annotator", "n")).alias("by"))
    rows = written(told.join(items.select("item").distinct().withColumn("known", F.lit(True)), "item", "full"))
    per = rows.select("item", "known", F.explode("by").alias("b")).select("item", "known", "b.*")
    complete = per.filter("known").groupBy("annotator").agg(F.count("*").alias("n_items"))
    n_items = rows.agg(F.count_if(F.col("known") & F.col("item").isNotNull()).alias("n")).scalar()
    short = annotators.select("annotator").join(complete, "annotator", "left").filter(F.coalesce("n_items", F.lit(0)) < n_items).select("annotator")
    names = short.agg(F.coalesce(F.collect_set("annotator"), F.array().cast("array<string>")).alias("x")).scalar()
    by = F.coalesce(F.transform("by", lambda x: x["annotator"]), F.array().cast("array<string>"))
    missing = rows.filter("known").select("item", F.explode(F.array_except(names, by)).alias("annotator"))
    few = annotators.agg(F.count_distinct("annotator").alias("n")).filter(F.col("n") < least)
    out = fields.select(F.col("b.fault").alias("fault"), a, i.cast("string").alias("item"), F.col("b.field").alias("field"))
    out = out.unionByName(fault("ITEM_UNKNOWN", per.filter("known is null"), a, i)).unionByName(fault("ITEM_REPEATED", per.filter("known and n > 1"), a, i))
    return out.unionByName(fault("ITEM_MISSING", missing, a, i)).unionByName(fault("TOO_FEW_ANNOTATORS", few, none, none))


def merged_labels(labels: DataFrame, fields: dict[str, str | None]) -> DataFrame:
    """item, field, n_votes, label, unanimous, disagreement: each field's label that more than half of the annotators gave, else its fallback (AMBIGUOUS, say, or null). disagreement lists the votes where there is no majority, as
    label=count in order. fields: name -> fallback. Votes are counted before they meet, so an item may have any number of annotators."""
    votes = labels.select("item", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("vote")) for f in fields))).alias("x")).select("item", "x.*")
    cells = votes.groupBy("item", "field", "vote").agg(F.count("*").alias("n"))
    told = cells.groupBy("item", "field").agg(
        F.sum("n").alias("n_votes"), F.max(F.struct("n", "vote")).alias("top"), F.count("*").alias("n_labels"), F.array_sort(F.collect_list(F.struct(F.coalesce("vote", F.lit("")).alias("vote"), "n"))).alias("cells")
    )
    settled = 2 * F.col("top.n") > F.col("n_votes")
    fallback = F.element_at(F.create_map(*(F.lit(x) for f, d in fields.items() for x in (f, d))), F.col("field"))
    listed = F.array_join(F.transform("cells", lambda c: F.concat(c["vote"], F.lit("="), c["n"].cast("string"))), ",")
    return told.select("item", "field", "n_votes", F.when(settled, F.col("top.vote")).otherwise(fallback).alias("label"), (F.col("n_labels") == 1).alias("unanimous"), F.when(~settled, listed).alias("disagreement"))
