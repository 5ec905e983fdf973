"""Pages into documents, and fields voted over an upload.

pages: upload_group_id, scan_index, doc_type, page_role, system and the key fields as nullable strings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperweave.functions.text import near_equal, repaired_id
from paperweave.sources.lineage import written
from paperweave.sources.tables import KEY_FIELDS

EXACT_FIELDS = ("po_no", "invoice_no", "transfer_order_no", "pxk_no")


def parent_candidates(pages: DataFrame, reach: int = 5) -> DataFrame:
    """(continuation, header) pairs of one upload and type at most `reach` scans apart that no key and no system forbids, with their evidence.

    The range is met by an equality: a page meets the bucket of its scan and the ones beside it."""
    role = F.coalesce("page_role", F.lit(""))
    keep = ["upload_group_id", "doc_type", "scan_index", "system", *KEY_FIELDS]
    bucket = F.floor(F.col("scan_index") / (reach + 1))
    c = pages.filter(role == "CONTINUATION").select(*keep).withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1))).alias("c")
    h = pages.filter(role != "CONTINUATION").select(*keep).withColumn("bucket", bucket).alias("h")
    on = [F.col(f"c.{k}") == F.col(f"h.{k}") for k in ("upload_group_id", "doc_type", "bucket")]
    distance = F.abs(F.col("c.scan_index") - F.col("h.scan_index"))
    differ = [F.coalesce(F.trim(F.col(f"c.{k}")) != F.trim(F.col(f"h.{k}")), F.lit(False)) for k in KEY_FIELDS]
    equal = [F.coalesce(F.trim(F.col(f"c.{k}")) == F.trim(F.col(f"h.{k}")), F.lit(False)).cast("int") for k in KEY_FIELDS]
    cs, hs = F.col("c.system"), F.col("h.system")
    pairs = c.join(h, on).filter((distance <= reach) & ~reduce(Column.__or__, differ) & ((cs == "COMMON") | (hs == "COMMON") | (cs == hs)))
    strong = reduce(Column.__add__, equal)
    score = (
        F.when(strong > 0, 1000 + 100 * strong).otherwise(0)
        + F.when((cs != "COMMON") & (cs == hs), 30).when(hs != "COMMON", 10).otherwise(0)
        + F.when(F.col("h.scan_index") == F.col("c.scan_index") + 1, 25).when(F.col("h.scan_index") == F.col("c.scan_index") - 1, 15).otherwise(-5 * distance)
    )
    return pairs.select(F.col("c.upload_group_id").alias("upload_group_id"), F.col("c.scan_index").alias("scan_index"), F.col("h.scan_index").alias("header_index"), strong.alias("n_strong"), score.alias("score"), distance.alias("distance"))


def stitched(pages: DataFrame) -> DataFrame:
    """Each continuation page with its header, or null and why: the best candidate if it shares a key, or stands next to the page with score 30 or more
    and is not one of several that all precede it."""
    mine = W.partitionBy("upload_group_id", "scan_index")
    order = mine.orderBy((F.col("n_strong") > 0).cast("int").desc(), F.desc("score"), "distance", "header_index")
    best = (
        parent_candidates(pages)
        .withColumn("rank", F.row_number().over(order))
        .withColumn("n_candidates", F.count("*").over(mine))
        .withColumn("all_before", F.min((F.col("header_index") < F.col("scan_index")).cast("int")).over(mine) == 1)
        .filter("rank = 1")
    )
    why = (
        F.when(F.col("n_candidates").isNull(), "NO_CANDIDATE")
        .when(F.col("n_strong") > 0, "SHARED_KEY")
        .when((F.col("n_candidates") > 1) & F.col("all_before"), "AMBIGUOUS")
        .when((F.col("distance") == 1) & (F.col("score") >= 30), "ADJACENT")
        .otherwise("WEAK")
    )
    rows = pages.filter(F.coalesce("page_role", F.lit("")) == "CONTINUATION").select("upload_group_id", "scan_index")
    rows = rows.join(best, ["upload_group_id", "scan_index"], "left").withColumn("reason", why)
    return rows.select("upload_group_id", "scan_index", F.when(F.col("reason").isin("SHARED_KEY", "ADJACENT"), F.col("header_index")).alias("header_index"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), "reason")


def stitched_documents(pages: DataFrame) -> DataFrame:
    """Header pages as documents: pages counted, empty keys filled from the first continuation that has one."""
    role = F.coalesce("page_role", F.lit(""))
    children = pages.filter(role == "CONTINUATION").join(stitched(pages).filter("header_index is not null"), ["upload_group_id", "scan_index"])
    first = [F.min(F.when(F.col(k).isNotNull(), F.struct("scan_index", F.col(k).alias("v"))))["v"].alias(f"child_{k}") for k in KEY_FIELDS]
    merged = children.groupBy("upload_group_id", F.col("header_index").alias("scan_index")).agg(F.count("*").alias("n"), *first)
    rows = pages.filter(role != "CONTINUATION").join(merged, ["upload_group_id", "scan_index"], "left")
    return rows.select("upload_group_id", "scan_index", "doc_type", "system", (F.coalesce("n", F.lit(0)) + 1).alias("page_count"), *(F.coalesce(k, f"child_{k}").alias(k) for k in KEY_FIELDS))


def voting_runs(pages: DataFrame) -> DataFrame:
    """pages with cluster_id, cluster_size and split_reason: runs of consecutive eligible scans of one type, none of whose keys contradicts any page of
    its run.

    What a page tells beside the one before it (eligibility, type, gap) cuts an upload into stretches by windows, which spill; only within a stretch are keys folded in scan order, as near-equal shipments are not
    transitive. The fold holds a run's first value of each exact key and its distinct shipments, each with the place of its first page, not its pages.
    """
    keys = [*(F.col(k).alias(k) for k in EXACT_FIELDS), repaired_id(F.col("shipment_id")).alias("shipment_id")]
    rows = pages.select("upload_group_id", "scan_index", "doc_type", F.coalesce("action", F.lit("")).alias("action"), *keys)
    order = ["scan_index", "doc_type", "action", *EXACT_FIELDS, "shipment_id"]
    along = W.partitionBy("upload_group_id").orderBy(*order)
    eligible = F.col("doc_type").isNotNull() & (F.col("doc_type") != "UNKNOWN") & (F.col("action") != "YEU_CAU_CHUP_LAI")
    rows = rows.withColumn("ok", F.coalesce(eligible, F.lit(False)))
    before = lambda c: F.lag(c).over(along)
    broken = (
        F.when(before("scan_index").isNull(), "START")
        .when(~F.col("ok") | ~before("ok"), "NOT_ELIGIBLE")
        .when(F.col("doc_type") != before("doc_type"), "DOC_TYPE_CHANGE")
        .when(F.col("scan_index") != before("scan_index") + 1, "SCAN_INDEX_GAP")
    )
    rows = rows.withColumn("broken", broken)
    rows = rows.withColumn("stretch", F.count("broken").over(along.rowsBetween(W.unboundedPreceding, 0)))
    row = F.struct(*order, "broken")
    stretches = rows.groupBy("upload_group_id", "stretch").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    first_of = "struct<value:string,place:int>"

    def step(state: Column, r: Column) -> Column:
        clashes = [F.when(state[k]["value"].isNotNull() & r[k].isNotNull() & (F.trim(state[k]["value"]) != F.trim(r[k])), F.struct(state[k]["place"].alias("place"), F.lit(i).alias("ord"), F.lit(k).alias("name"))) for i, k in enumerate(EXACT_FIELDS)]
        apart = F.filter(state["ships"], lambda m: r["shipment_id"].isNotNull() & ~near_equal(m["value"], r["shipment_id"]))
        clashes.append(F.when(F.size(apart) > 0, F.struct(F.get(apart, F.lit(0))["place"].alias("place"), F.lit(len(EXACT_FIELDS)).alias("ord"), F.lit("shipment_id").alias("name"))))
        clash = F.array_min(F.array_compact(F.array(*clashes)))["name"]
        reason = F.coalesce(r["broken"], F.when(clash.isNotNull(), F.concat(F.lit("KEY_FIELD_CONFLICT("), clash, F.lit(")"))), F.lit("JOINED"))
        joined = reason == "JOINED"
        place = F.when(joined, state["size"]).otherwise(0)
        mine = lambda k: F.when(r[k].isNotNull(), F.struct(r[k].alias("value"), place.alias("place")))
        known = F.exists(state["ships"], lambda m: m["value"] == r["shipment_id"])
        ship = F.when(r["shipment_id"].isNotNull() & ~(joined & F.coalesce(known, F.lit(False))), F.array(F.struct(r["shipment_id"].alias("value"), place.alias("place")))).otherwise(F.array().cast(f"array<{first_of}>"))
        return F.struct(
            (place + 1).alias("size"),
            *(F.when(joined, F.coalesce(state[k], mine(k))).otherwise(mine(k)).alias(k) for k in EXACT_FIELDS),
            F.concat(F.when(joined, state["ships"]).otherwise(F.array().cast(f"array<{first_of}>")), ship).alias("ships"),
            F.concat(state["out"], F.array(F.struct(r["scan_index"].alias("scan_index"), reason.alias("split_reason")))).alias("out"),
        )

    index = dict(pages.dtypes)["scan_index"]
    start = F.struct(F.lit(0).alias("size"), *(F.lit(None).cast(first_of).alias(k) for k in EXACT_FIELDS), F.array().cast(f"array<{first_of}>").alias("ships"), F.array().cast(f"array<struct<scan_index:{index},split_reason:string>>").alias("out"))
    told = stretches.select("upload_group_id", F.posexplode(F.aggregate("rows", start, step)["out"]).alias("at", "o"), "stretch").select("upload_group_id", "stretch", "at", "o.*")
    upto = W.partitionBy("upload_group_id").orderBy("stretch", "at").rowsBetween(W.unboundedPreceding, 0)
    number = F.count(F.when(F.col("split_reason") != "JOINED", 1)).over(upto) - 1
    told = written(told.select("upload_group_id", "scan_index", F.concat_ws("#", "upload_group_id", number.cast("string")).alias("cluster_id"), "split_reason"))  # folded once, though votes read it for each field
    size = told.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    return pages.join(told.join(size, "cluster_id"), ["upload_group_id", "scan_index"])


def _winner(rows: DataFrame, field: str, value: Column, by_length: bool = False) -> DataFrame:
    """A cluster's most frequent value; ties go to the longer one if asked, then to the one seen first."""
    counted = rows.select("cluster_id", "scan_index", value.alias(field)).filter(F.col(field).isNotNull()).groupBy("cluster_id", field).agg(F.count("*").alias("n"), F.min("scan_index").alias("seen"))
    rank = F.struct("n", F.length(field) if by_length else F.lit(0), -F.col("seen"))
    return counted.groupBy("cluster_id").agg(F.max_by(field, rank).alias(f"best_{field}"))


def voted(runs: DataFrame) -> DataFrame:
    """Runs with their keys voted: each field's winner is taken from the originals, then fills what is empty on pages of the types that carry the field;
    a shipment that differs from the winner in at most two characters, or is cut short, is repaired."""
    mine = repaired_id(F.col("shipment_id"))
    out = runs
    for field, value, longer in (("invoice_no", F.col("invoice_no"), False), ("shipment_id", mine, True), ("po_no", F.col("po_no"), False)):
        out = out.join(_winner(runs, field, value, longer), "cluster_id", "left")
    best = F.col("best_shipment_id")
    close = F.when(F.length(mine) == F.length(best), near_equal(mine, best)).otherwise((F.length(mine) < F.length(best)) & best.startswith(mine))
    shipment = F.when(mine.isNull(), F.when(F.col("doc_type").isin("HOA_DON", "LOADING_PLAN", "PXKKVCNB"), best).otherwise(F.col("shipment_id"))).when((mine != best) & close, best).otherwise(F.col("shipment_id"))
    return (
        out.withColumn("voted_shipment_id", shipment)
        .withColumn("voted_invoice_no", F.when(F.col("doc_type") == "HOA_DON", F.coalesce("invoice_no", "best_invoice_no")).otherwise(F.col("invoice_no")))
        .withColumn("voted_po_no", F.when(F.col("doc_type").isin("PO", "TABLE_CONTINUATION"), F.coalesce("po_no", "best_po_no")).otherwise(F.col("po_no")))
    )
