"""Reconciliation, order dossiers and checklists of shipments.

documents: batch_id, dossier_id, doc_id, doc_type and the key fields as nullable strings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperweave.operators.batching import References, assignments
from paperweave.operators.components import with_parts
from paperweave.operators.identity import batch_heads
from paperweave.sources.lineage import written

ORDER_KEYS = ("po_no", "invoice_no", "pxk_no")


def compared(a: Column, b: Column, prefix: int | None = None) -> Column:
    """The status of a pair of values. With a prefix length, equal beginnings are a partial match and missing values are told apart; else they give none."""
    same = F.when(a == b, "MATCH")
    if prefix is None:
        return F.when(a.isNotNull() & b.isNotNull(), same.otherwise("MISMATCH"))
    partial = same.when(F.substring(a, 1, prefix) == F.substring(b, 1, prefix), "PARTIAL_MATCH").otherwise("MISMATCH")
    return F.when(a.isNotNull() & b.isNotNull(), partial).when(a.isNotNull(), "MISSING_TARGET").when(b.isNotNull(), "MISSING_SOURCE").otherwise("NOT_APPLICABLE")


#: Of each rule: the types that meet, the field of the evidence, the value of either side, the length of the beginning that makes a partial match, and whether the second side is the source.
_RULES = [
    ("PO", "HOA_DON", "po_no", "po_no", "po_no", 4, False),
    ("PO", "PHIEU_GIAO_HANG", "po_no", "po_no", "po_no", 3, False),
    ("HOA_DON", "LOADING_PLAN", "shipment_id", "shipment_id", "shipment_id", None, True),
    ("PXKKVCNB", "LOADING_PLAN", "transfer_order_no", "transfer_order_no", "shipment_id", None, True),
    ("HOA_DON", "HOA_DON", "invoice_no", "invoice_no", "invoice_no", None, False),
    ("HOA_DON", "HOA_DON", "shipment_id", "shipment_id", "shipment_id", None, False),
]


def reconciliation(documents: DataFrame) -> DataFrame:
    """Evidence rows: orders against all invoices (4 characters make a partial match) and delivery notes (3) of the batch, invoices and
    transfer slips against its loading plans, and invoices of one dossier against each other. All pairs come from one join by batch and
    rule (and dossier, where a rule stays inside it), to which a document sends, for each rule, the one value that is compared; without a value only where that is told."""
    inside = F.col("kind") > 3

    def taking_part(side: int) -> DataFrame:
        # the rules of a type are a literal, so that no list is made for each document
        kinds = F.lit(None).cast("array<int>")
        for t in sorted({r[side] for r in _RULES}):
            kinds = F.when(F.col("doc_type") == t, F.array(*(F.lit(i) for i, r in enumerate(_RULES) if r[side] == t))).otherwise(kinds)
        rows = documents.withColumn("kind", F.explode(kinds))
        value = F.lit(None).cast("string")
        for i, r in enumerate(_RULES):
            value = F.when(F.col("kind") == i, F.col(r[3 + side])).otherwise(value)
        partial = F.col("kind").isin([i for i, r in enumerate(_RULES) if r[5]])
        rows = rows.select("batch_id", "dossier_id", "doc_id", "kind", value.alias("value")).filter(partial | F.col("value").isNotNull())
        return rows.withColumn("within", F.when(inside, F.col("dossier_id")).otherwise(""))

    b = taking_part(1).select("batch_id", "kind", "within", F.col("doc_id").alias("b_doc"), F.col("value").alias("b_value"))
    pairs = taking_part(0).join(b, ["batch_id", "kind", "within"]).filter(~inside | (F.col("doc_id") < F.col("b_doc")))
    x, y = F.col("value"), F.col("b_value")
    status, turned = compared(x, y), F.col("kind").isin([i for i, r in enumerate(_RULES) if r[6]])
    for i, r in enumerate(_RULES):
        if r[5]:
            status = F.when(F.col("kind") == i, compared(x, y, r[5])).otherwise(status)
    sides = [("source_doc", "b_doc", "doc_id"), ("target_doc", "doc_id", "b_doc"), ("source_val", "b_value", "value"), ("target_val", "value", "b_value")]
    return pairs.select("dossier_id", F.get(F.lit([r[2] for r in _RULES]), F.col("kind")).alias("field"), *(F.when(turned, F.col(t)).otherwise(F.col(u)).alias(n) for n, t, u in sides), status.alias("status"))


#: Of each rule but the last two: the type and field that a dossier gives, those of the batch it is held against, and the length of the beginning that makes a partial match.
_AGAINST_BATCH = [
    ("PO", "po_no", "HOA_DON", "po_no", 4),
    ("PO", "po_no", "PHIEU_GIAO_HANG", "po_no", 3),
    ("HOA_DON", "shipment_id", "LOADING_PLAN", "shipment_id", None),
    ("PXKKVCNB", "transfer_order_no", "LOADING_PLAN", "shipment_id", None),
]
_TWINS = ("invoice_no", "shipment_id")


def evidence_counts(documents: DataFrame) -> DataFrame:
    """What reconciliation() would list, counted: dossier_id, n_evidence, n_match (partial ones too), n_mismatch, n_missing.

    No pair is made. Of each rule the values of either side are counted by batch and by what must agree (the value, or its beginning); a dossier's value then has as many matches as its count in the batch,
    and as many mismatches as there are other values. A batch of any size is spread over its values.
    """
    def sides(of: int) -> DataFrame:
        told = [
            F.when(F.col("doc_type") == r[2 * of], F.struct(F.lit(i).alias("rule"), (F.substring(r[2 * of + 1], 1, r[4]) if r[4] else F.col(r[2 * of + 1])).alias("agrees"), F.lit(r[4] is not None).alias("counts_missing")))
            for i, r in enumerate(_AGAINST_BATCH)
        ]
        return documents.select("batch_id", "dossier_id", F.explode(F.array_compact(F.array(*told))).alias("r")).select("batch_id", "dossier_id", "r.*")

    target = sides(1).groupBy("batch_id", "rule", "agrees").agg(F.count("*").alias("n"))
    whole = target.groupBy("batch_id", "rule").agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col("agrees").isNotNull(), F.col("n")).otherwise(0)).alias("n_there"))
    source = sides(0).groupBy("batch_id", "dossier_id", "rule", "agrees", "counts_missing").agg(F.count("*").alias("n_own"))
    met = source.join(whole, ["batch_id", "rule"]).join(target, ["batch_id", "rule", "agrees"], "left")
    own, same, there, every = F.col("n_own"), F.coalesce("n", F.lit(0)), F.col("n_there"), F.col("n_all")
    given = F.col("agrees").isNotNull()
    counted = met.select(
        "dossier_id",
        (own * F.when(F.col("counts_missing"), every).when(given, there).otherwise(0)).alias("n_evidence"),
        (own * F.when(given, same).otherwise(0)).alias("n_match"),
        (own * F.when(given, there - same).otherwise(0)).alias("n_mismatch"),
        (own * F.when(F.col("counts_missing"), F.when(given, every - there).otherwise(there)).otherwise(0)).alias("n_missing"),
    )
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in _TWINS))).alias("f")
    twins = documents.filter("doc_type = 'HOA_DON'").select("dossier_id", fields).filter("f.value is not null").groupBy("dossier_id", "f").agg(F.count("*").alias("n"))
    pairs = lambda n: F.expr(f"({n}) * (({n}) - 1) div 2")
    twins = twins.groupBy("dossier_id", F.col("f.field").alias("field")).agg(F.sum("n").alias("n"), F.sum(pairs("n")).alias("n_match"))
    twins = twins.select("dossier_id", pairs("n").alias("n_evidence"), "n_match", (pairs("n") - F.col("n_match")).alias("n_mismatch"), F.lit(0).cast("long").alias("n_missing"))
    totals = [F.sum(c).alias(c) for c in ("n_evidence", "n_match", "n_mismatch", "n_missing")]
    return counted.unionByName(twins).groupBy("dossier_id").agg(*totals)


def match_status(documents: DataFrame) -> DataFrame:
    """Of each dossier: number of documents and evidence rows, and one status. A mismatch outweighs all; missing values make a match partial;
    without evidence a single document stands alone."""
    rows = documents.groupBy("dossier_id").agg(F.count("*").alias("n_docs")).join(evidence_counts(documents), "dossier_id", "left").fillna(0, ["n_evidence", "n_match", "n_mismatch", "n_missing"])
    status = (
        F.when(F.col("n_evidence") == 0, F.when(F.col("n_docs") > 1, "NO_EVIDENCE").otherwise("DON_LE"))
        .when(F.col("n_mismatch") > 0, "XUNG_DOT")
        .when((F.col("n_match") > 0) & (F.col("n_missing") == 0), "KHOP_HOAN_TOAN")
        .when(F.col("n_missing") > 0, "KHOP_MOT_PHAN")
        .otherwise("DON_LE")
    )
    return rows.select("dossier_id", "n_docs", "n_evidence", status.alias("match_status"))


def _inside_batch() -> list[Column]:
    """Order keys under their batch: those of different batches never meet."""
    return [F.when(F.col(k).isNotNull(), F.concat_ws("\u0001", "batch_id", k)) for k in ORDER_KEYS]


def order_dossiers(documents: DataFrame) -> DataFrame:
    """Documents of one batch that share an order key, directly or through others, as one dossier: its name from the least key of each kind, and the
    keys of which it holds several."""
    rows = with_parts(written(documents.select("batch_id", "doc_id", *ORDER_KEYS)), "doc_id", *_inside_batch()).filter("doc_id is not null")
    values = [F.array_sort(F.collect_set(k)).alias(k) for k in ORDER_KEYS]
    # one exchange serves both: documents of a part are dealt by it, not combined before, as their sets are no smaller
    rows = rows.repartition("part").groupBy("batch_id", "part").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), *values)
    rows = rows.withColumn("root", F.min("first_doc").over(W.partitionBy("part")))
    named = [F.when(F.size(k) > 0, F.concat(F.lit(p), F.get(k, F.lit(0)))) for k, p in zip(ORDER_KEYS, ("PO_", "INV_", "PXK_"), strict=True)]
    name = F.coalesce(F.nullif(F.concat_ws("_", *named), F.lit("")), F.concat(F.lit("DOC_"), "first_doc"))
    ambiguous = F.concat_ws(";", *(F.when(F.size(k) > 1, F.concat(F.lit(f"{k}="), F.array_join(k, ","))) for k in ORDER_KEYS))
    return rows.select("batch_id", F.concat_ws("_", F.lit("ORDER"), "batch_id", name).alias("dossier_id"), "root", "n_docs", ambiguous.alias("ambiguous_keys"))


def checklist(documents: DataFrame, batches: DataFrame, guidelines: DataFrame) -> DataFrame:
    """Of each batch: applicable rules, missing documents and one status. guidelines: rule_ord, form_code ("*" for all), doc_type, canonical_type (null if
    not mapped). A type may meet several rules; rules are counted, not types. Without mapped rules there is no verdict."""
    rules = guidelines.select("rule_ord", F.col("form_code").alias("code"), "canonical_type", F.col("doc_type").alias("name"))
    codes = batches.select("batch_id", F.explode(F.array_distinct(F.array("order_code", F.lit("*")))).alias("code"))
    present = documents.groupBy("batch_id", F.col("doc_type").alias("canonical_type")).agg(F.count("*").alias("n"), F.sum("page_count").alias("pages"))
    rows = codes.join(rules, "code").join(present, ["batch_id", "canonical_type"], "left")
    mapped = F.col("canonical_type").isNotNull()
    gone = mapped & F.col("n").isNull()
    out = rows.groupBy("batch_id").agg(
        F.count_if(mapped).alias("applicable_rules"),
        F.count_if(~mapped).alias("unmapped_rules"),
        F.count_if(gone).alias("n_missing"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(gone, F.struct("rule_ord", "name")))), lambda x: x["name"]), ",").alias("missing_documents"),
        F.coalesce(F.sum(F.when(mapped, F.col("pages"))), F.lit(0)).alias("matched_pages"),
    )
    status = F.when(F.col("applicable_rules") == 0, "KHONG_CO_QUY_CHUAN").when(F.col("n_missing") == 0, "HOAN_HAO").when(F.col("n_missing") == 1, "CANH_BAO_THIEU").otherwise("THIEU_CHUNG_TU")
    out = batches.select("batch_id").join(out, "batch_id", "left").fillna(0, ["applicable_rules", "unmapped_rules", "n_missing", "matched_pages"]).fillna("", ["missing_documents"])
    return out.withColumn("overall_status", status)


@dataclass(frozen=True)
class Audit:
    """documents: with batch, dossier, pass and method; batches: a row each, with what dossiers and checklist say of it."""

    documents: DataFrame
    batches: DataFrame


def audited(documents: DataFrame, references: References, guidelines: DataFrame) -> Audit:
    """The whole audit: documents are assigned, a batch is what its members tell, its documents fall into order dossiers, dossiers are reconciled against the batch, and guidelines of its order code are checked.
    documents: as in batching, with page_count. What more than one step reads is written once; no batch or dossier is held in one row."""
    placed = written(assignments(documents, references))
    rows = written(documents.join(placed, "doc_id"))
    rows = with_parts(rows, "doc_id", *_inside_batch())
    rows = written(rows.join(rows.groupBy("part").agg(F.min("doc_id").alias("dossier_id")), "part").drop("part"))
    heads = written(batch_heads(rows))
    status = match_status(rows).join(rows.select("dossier_id", "batch_id").distinct(), "dossier_id")
    dossiers = status.groupBy("batch_id").agg(
        F.count("*").alias("n_dossiers"),
        F.sum("n_evidence").alias("n_evidence"),
        F.count_if(F.col("match_status") == "XUNG_DOT").alias("n_conflicts"),
        F.count_if(F.col("match_status") == "KHOP_HOAN_TOAN").alias("n_whole"),
    )
    checks = checklist(rows, heads.select("batch_id", "order_code"), guidelines).select("batch_id", "n_missing", "missing_documents", "overall_status")
    return Audit(rows, heads.join(dossiers, "batch_id").join(checks, "batch_id"))


def manifest_lines(documents: DataFrame) -> DataFrame:
    """batch_id, doc_id, line: the manifest of audited documents, a JSON line for each, so that a batch of any size is written by many tasks."""
    told = ("doc_id", "doc_type", "dossier_id", "pass", "identity_type", "confidence", "warning", "isolation_reason")
    return documents.select("batch_id", "doc_id", F.to_json(F.struct("batch_id", *told)).alias("line"))
