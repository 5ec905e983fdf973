"""Verdicts on signatures: of documents, of dossiers by channel policy, and after human review.

targets: doc_id, role, required, detected, review_required, modality, status. A verdict is never drawn from an empty set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperweave.functions.text import first_where

ALWAYS_REVIEW = ("CAN_KIEM_TRA_TAY", "REVIEW_REQUIRED")


def _counts() -> list[Column]:
    required = F.coalesce("required", F.lit(True))
    found = F.coalesce("detected", F.lit(False))
    return [
        F.count_if(required).alias("n_required"),
        F.count_if(required & found).alias("n_found"),
        F.count_if(~required).alias("n_optional"),
        F.count_if(~required & found).alias("n_optional_found"),
    ]


def document_verdict(targets: DataFrame, documents: DataFrame) -> DataFrame:
    """The first verdict: unreadable input outranks all; nothing required is no requirement, or unmapped if the document's
    layout is; all found is the original if every required mark is in colour, else a photocopy. documents: doc_id, doc_type, mapping_status."""
    required = F.coalesce("required", F.lit(True))
    told = targets.groupBy("doc_id").agg(
        *_counts(),
        F.bool_or(required & (F.col("status") == "INPUT_ERROR")).alias("unreadable"),
        F.bool_and(F.when(required, F.coalesce("modality", F.lit("PHOTOCOPY_BW")) == "TRUE_COLOR")).alias("colour"),
    )
    rows = documents.join(told, "doc_id", "left").fillna(0, ["n_required", "n_found", "n_optional", "n_optional_found"])
    verdict = first_where(
        [
            (F.coalesce("unreadable", F.lit(False)), "LOI_DU_LIEU_ANH"),
            ((F.col("n_required") == 0) & (F.col("mapping_status") == "UNMAPPED") & (F.col("doc_type") != "BIEU_DO_NHIET_DO"), "UNMAPPED"),
            (F.col("n_required") == 0, "KHONG_YEU_CAU"),
            ((F.col("n_found") == F.col("n_required")) & F.col("colour"), "DAT_CHUAN_GOC"),
            (F.col("n_found") == F.col("n_required"), "DAT_CHUAN_PHOTO"),
            (F.col("n_found") > 0, "THIEU_MOT_SO_CHU_KY"),
        ],
        "CHUA_KY_DONG_DAU",
    )
    return rows.select("doc_id", "n_required", "n_found", "n_optional", "n_optional_found", verdict.alias("doc_status"))


def _cascade(colour: Column) -> tuple[Column, Column]:
    """Status and action from n_required, n_review and n_found."""
    ladder = [
        (F.col("n_required") == 0, "CHUA_CHUAN_HOA_VUNG_KY", "ABSTAIN"),
        (F.col("n_review") > 0, *ALWAYS_REVIEW),
        ((F.col("n_found") == F.col("n_required")) & colour, "DAT_CHUAN_GOC", "DUYET"),
        (F.col("n_found") == F.col("n_required"), "DAT_CHUAN_PHOTO", "DUYET"),
        (F.col("n_found") == 0, "CHUA_KY_DONG_DAU", "YEU_CAU_KY_LAI"),
    ]
    return first_where([(c, s) for c, s, _ in ladder], "THIEU_MOT_SO_CHU_KY"), first_where([(c, a) for c, _, a in ladder], "CANH_BAO")


def reviewed_verdict(targets: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The second verdict: no required target or an unproven one leads to abstention or review, never to a finding. documents: key, is_color."""
    required = F.coalesce("required", F.lit(True))
    gone = F.array_join(F.array_sort(F.collect_list(F.when(required & ~F.coalesce("detected", F.lit(False)), F.col("role")))), ",").alias("missing_roles")
    told = targets.groupBy(key).agg(*_counts()[:2], F.count_if(required & F.coalesce("review_required", F.lit(False))).alias("n_review"), gone)
    rows = documents.select(key, "is_color").join(told, key, "left").fillna(0, ["n_required", "n_found", "n_review"]).fillna("", ["missing_roles"])
    status, action = _cascade(F.coalesce("is_color", F.lit(False)))
    return rows.select(key, "n_required", "n_found", "n_review", status.alias("doc_status"), action.alias("action"), F.when(status == "THIEU_MOT_SO_CHU_KY", F.col("missing_roles")).otherwise("").alias("missing_roles"))


def channel_of(system: Column, unresolved: list[str], exact: dict[str, str], prefixes: list[tuple[str, str]]) -> Column:
    """The channel of a system: listed as unresolved, exact, first fitting prefix; null where nothing fits."""
    return first_where(
        [(F.coalesce(system, F.lit("")).isin(unresolved), F.lit(None).cast("string"))]
        + [(system == k, v) for k, v in exact.items()]
        + [(system.startswith(p), v) for p, v in prefixes],
        F.lit(None).cast("string"),
    )


def page_class(zone_status: Column, n_targets: Column, exists: Column) -> Column:
    return F.when(~exists, "MISSING").when(n_targets > 0, "SIGNATURE_BLOCK").when(zone_status == "PAGE_1_NO_SIGNATURES", "PAGE_1_NO_BLOCK").otherwise("BLOCK_ABSTAIN")


def dossier_verdict(members: DataFrame, pages: DataFrame, targets: DataFrame, required_roles: DataFrame) -> DataFrame:
    """Verdicts of dossiers that span pages.

    members: dossier_id, page_id. pages: page_id, channel (null if unresolved), zone_status, is_color. targets: page_id, role, detected, review_required and, optionally,
    placed: a target for which the page has no box is none.
    required_roles: channel, role, with the strictest set under channel UNRESOLVED; Spark broadcasts it by its size. Roles count as found if
    one page has them; a required role that no page measures, a missing or an abstaining page end in abstention; pages that disagree on the channel get the strictest set.
    """
    if "placed" in targets.columns:
        targets = targets.filter("placed")
    n = targets.groupBy("page_id").agg(F.count("*").alias("n_targets"))
    known = members.join(pages.withColumn("there", F.lit(True)), "page_id", "left").join(n, "page_id", "left")
    known = known.withColumn("class", page_class(F.col("zone_status"), F.coalesce("n_targets", F.lit(0)), F.coalesce("there", F.lit(False))))
    shape = known.groupBy("dossier_id").agg(
        F.count("*").alias("n_pages"),
        F.count_if(F.col("class") == "SIGNATURE_BLOCK").alias("n_blocks"),
        F.bool_or(F.col("class").isin("MISSING", "BLOCK_ABSTAIN")).alias("abstains"),
        F.when((F.count_distinct("channel") == 1) & F.bool_and(F.col("channel").isNotNull() | F.col("there").isNull()), F.min("channel")).otherwise("UNRESOLVED").alias("policy_channel"),
        F.coalesce(F.bool_and(F.when(F.col("class") == "SIGNATURE_BLOCK", F.col("is_color"))), F.lit(False)).alias("colour"),
    )
    measured = known.filter(F.col("class") == "SIGNATURE_BLOCK").join(targets, "page_id").groupBy("dossier_id", "role").agg(F.bool_or("detected").alias("detected"), F.bool_or("review_required").alias("review_required"))
    wanted = shape.select("dossier_id", F.col("policy_channel").alias("channel")).join(required_roles, "channel").select("dossier_id", "role", F.lit(True).alias("wanted"))
    roles = wanted.join(measured.withColumn("measured", F.lit(True)), ["dossier_id", "role"], "left")
    told = roles.groupBy("dossier_id").agg(
        F.count("*").alias("n_required"), F.count_if("detected").alias("n_found"), F.count_if("review_required").alias("n_review"), F.count_if(F.col("measured").isNull()).alias("n_unmeasured")
    )
    rows = shape.join(told, "dossier_id", "left").fillna(0, ["n_required", "n_found", "n_review", "n_unmeasured"])
    status, _ = _cascade(F.col("colour"))
    status = F.when(F.col("abstains"), "CHUA_CHUAN_HOA_VUNG_KY").when(F.col("n_blocks") == 0, "KHONG_TIM_THAY_KHOI_KY").when(F.col("n_unmeasured") > 0, "CHUA_CHUAN_HOA_VUNG_KY").otherwise(status)
    return rows.select("dossier_id", "n_pages", "n_blocks", "policy_channel", "n_required", "n_found", status.alias("doc_status"))


def shared_pages(members: DataFrame) -> DataFrame:
    """Pages that more than one dossier claims: a breach of contract."""
    return members.groupBy("page_id").agg(F.count_distinct("dossier_id").alias("n_dossiers")).filter("n_dossiers > 1")


def orphan_pages(members: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that no dossier claims."""
    return pages.join(members.select("page_id"), "page_id", "left_anti")


def role_evidence(members: DataFrame, targets: DataFrame) -> DataFrame:
    """What the pages of a dossier say of each role: required, detected and review_required if one page says so, and the pages that detected and that measured it, in order. Lists are as long as a dossier has pages with the role."""
    rows = members.join(targets, "page_id")
    told = [F.bool_or(c).alias(c) for c in ("required", "detected", "review_required")]
    pages = [F.array_sort(F.collect_set(F.when(F.col("detected"), F.col("page_id")))).alias("pages_detected"), F.array_sort(F.collect_set("page_id")).alias("pages_measured")]
    return rows.groupBy("dossier_id", "role").agg(*told, *pages)


def latest_reviews(reviews: DataFrame, *keys: str) -> DataFrame:
    """The newest review of each target, ties to the greater review_id; combined before the shuffle, unlike a row number."""
    rest = [c for c in reviews.columns if c not in keys]
    return reviews.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("created_at", "review_id")).alias("r")).select(*keys, "r.*")


def effective_targets(targets: DataFrame, latest: DataFrame, *keys: str) -> DataFrame:
    """Targets as they stand after review. A review of another role is stale and changes nothing; a decision outside the vocabulary is an error."""
    r = latest.select(*keys, F.col("role").alias("review_role"), "decision")
    rows = targets.join(r, list(keys), "left")
    live = F.col("decision").isNotNull() & F.col("role").eqNullSafe(F.col("review_role"))
    d = F.when(live, F.when(F.col("decision").isin("SIGNED", "NOT_SIGNED", "UNCLEAR"), F.col("decision")).otherwise(F.raise_error(F.concat(F.lit("unknown decision "), F.col("decision")))))
    detected = F.when(d == "SIGNED", True).when(d == "NOT_SIGNED", False).otherwise(F.col("detected"))
    review = F.when(d == "UNCLEAR", True).when(d.isNotNull(), False).otherwise(F.col("review_required"))
    rows = rows.withColumn("human_decision", d)
    rows = rows.withColumn("machine_detected", F.col("detected")).withColumn("machine_review", F.col("review_required")).withColumn("detected", detected).withColumn("review_required", review)
    state = F.when(F.col("review_required"), None).otherwise(F.coalesce("detected", F.lit(False)))
    return rows.withColumn("effective_detected", state).drop("review_role", "decision")


def overridden(effective: DataFrame, key: str) -> DataFrame:
    """How many reviews were applied, and how many changed what the machine had found or whether it asked for a review; null counts as no."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    applied = F.col("human_decision").isNotNull()
    changed = (yes("machine_detected") != yes("detected")) | (yes("machine_review") != yes("review_required"))
    return effective.groupBy(key).agg(F.count_if(applied).alias("n_applied"), F.count_if(applied & changed).alias("n_overridden"))


def attempts_in_window(attempts: DataFrame, account: str, window_minutes: int, lock_minutes: int, max_fails: int) -> DataFrame:
    """attempts (account, ts, kind of FAIL, SUCCESS, RESET or LOCKED) with the fails in the window up to each row since the last success or reset, and if and
    until when the account is locked there. Locked attempts do not count."""
    seconds = F.col("ts").cast("timestamp").cast("long")
    upto = W.partitionBy(account).orderBy("sec")
    reset = F.max(F.when(F.col("kind").isin("SUCCESS", "RESET"), F.col("sec"))).over(upto.rangeBetween(W.unboundedPreceding, 0))
    rows = attempts.withColumn("sec", seconds).withColumn("reset_sec", reset)
    # attempts between two resets are a partition of their own, in which the window counts and keeps no list
    window = W.partitionBy(account, "reset_sec").orderBy("sec").rangeBetween(-60 * window_minutes, 0)
    fail = F.when((F.col("kind") == "FAIL") & F.coalesce(F.col("sec") > F.col("reset_sec"), F.lit(True)), F.col("sec"))
    rows = rows.withColumn("n_fails", F.count(fail).over(window).cast("int")).withColumn("last_fail", F.max(fail).over(window))
    until = F.when(F.col("n_fails") >= max_fails, F.col("last_fail") + 60 * lock_minutes)
    return rows.withColumn("locked_until_sec", until).withColumn("remaining_sec", F.greatest(F.lit(1), until - F.col("sec"))).drop("last_fail", "reset_sec")
