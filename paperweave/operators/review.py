"""Verdicts of pages and dossiers by branch, and what reviews change of them: only what a review touches is computed anew.

pages: page_id, doc_type, image and readable, zone_status, is_color, channel. targets: page_id, target (its place on the page), role, required, detected, review_required.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from paperweave.functions.text import first_where
from paperweave.operators import policy, verdict
from paperweave.sources.lineage import written

BRANCHES = ("OUT_OF_SCOPE", "UNREADABLE", "FORM", "FIRST_PAGE", "NO_ZONE", "SIGNATURES")
_MEASURED = ("n_required", "n_found")


@dataclass(frozen=True)
class Routed:
    """Pages with the branch of their verdict, written once, and how many each branch has."""

    pages: DataFrame
    counts: dict[str, int]


def branch_of(scope: list[str], forms: list[str], n_targets: Column) -> Column:
    """Each page is in one branch: the first that holds."""
    return first_where(
        [
            (~F.coalesce(F.col("doc_type").isin([*scope, *forms]), F.lit(False)), "OUT_OF_SCOPE"),
            ((F.coalesce("image", F.lit("")) == "") | ~F.coalesce("readable", F.lit(False)), "UNREADABLE"),
            (F.col("doc_type").isin(forms), "FORM"),
            (F.coalesce(F.col("zone_status") == "PAGE_1_NO_SIGNATURES", F.lit(False)), "FIRST_PAGE"),
            (F.coalesce(n_targets, F.lit(0)) == 0, "NO_ZONE"),
        ],
        "SIGNATURES",
    )


def routed(pages: DataFrame, targets: DataFrame, scope: list[str], forms: list[str]) -> Routed:
    """Pages fanned out to the branches. The counts are observed while the pages are written, so that no scan is taken for them and empty branches are not planned."""
    n = targets.groupBy("page_id").agg(F.count("*").alias("n_targets"))
    told = pages.join(n, "page_id", "left").withColumn("branch", branch_of(scope, forms, F.col("n_targets")))
    seen = Observation()
    told = told.observe(seen, *(F.count_if(F.col("branch") == b).alias(b) for b in BRANCHES))
    rows = written(told)
    return Routed(rows, {b: int(seen.get[b]) for b in BRANCHES})


def page_verdicts(way: Routed, targets: DataFrame) -> DataFrame:
    """page_id, branch, doc_status, action, n_required, n_found: each page by its branch. Pages that are not looked at abstain; first pages of long lists are valid as they are; forms and signature blocks are
    judged by their targets."""
    fixed = {"OUT_OF_SCOPE": ("CHUA_CHUAN_HOA_VUNG_KY", "ABSTAIN"), "UNREADABLE": ("LOI_DOC_ANH", "ABSTAIN"), "FIRST_PAGE": ("TRANG_1_CHUA_KY", "HOP_LE"), "NO_ZONE": ("CHUA_CHUAN_HOA_VUNG_KY", "ABSTAIN")}
    columns = ["page_id", "branch", "doc_status", "action", *_MEASURED]
    zero = F.lit(0).cast("long")
    plain = way.pages.filter(F.col("branch").isin(list(fixed)))
    status, action = (first_where([(F.col("branch") == b, v[i]) for b, v in fixed.items()], F.lit(None).cast("string")) for i in (0, 1))
    parts = [plain.select("page_id", "branch", status.alias("doc_status"), action.alias("action"), *(zero.alias(c) for c in _MEASURED))]
    if way.counts["FORM"]:
        own = way.pages.filter("branch = 'FORM'")
        judged = policy.template_verdict(targets.join(own.select("page_id"), "page_id", "left_semi").withColumn("position", F.col("target")), own)
        parts.append(judged.withColumn("branch", F.lit("FORM")).select(*columns))
    if way.counts["SIGNATURES"]:
        own = way.pages.filter("branch = 'SIGNATURES'")
        judged = verdict.reviewed_verdict(targets.join(own.select("page_id"), "page_id", "left_semi"), own, "page_id")
        parts.append(judged.withColumn("branch", F.lit("SIGNATURES")).select(*columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dossier_verdicts(way: Routed, verdicts: DataFrame, targets: DataFrame, members: DataFrame, required_roles: DataFrame) -> DataFrame:
    """dossier_id, kind, n_pages, doc_status: the dossiers of several pages, whose pages are those of the signature branches, and one for each page that is a form. members: dossier_id, page_id."""
    own = way.pages.filter(F.col("branch").isin("FIRST_PAGE", "NO_ZONE", "SIGNATURES"))
    zones = own.withColumn("zone_status", F.when(F.col("branch") == "FIRST_PAGE", "PAGE_1_NO_SIGNATURES").otherwise(F.lit("OK")))
    seen = targets.join(own.filter("branch = 'SIGNATURES'").select("page_id"), "page_id", "left_semi")
    several = verdict.dossier_verdict(members, zones.select("page_id", "channel", "zone_status", "is_color"), seen, required_roles)
    forms = verdicts.filter("branch = 'FORM'").select(F.concat(F.lit("TPL:"), "page_id").alias("dossier_id"), F.lit("FORM").alias("kind"), F.lit(1).cast("long").alias("n_pages"), "doc_status")
    return several.select(F.col("dossier_id").cast("string").alias("dossier_id"), F.lit("PAGES").alias("kind"), "n_pages", "doc_status").unionByName(forms)


def applied_reviews(targets: DataFrame, reviews: DataFrame, *keys: str) -> DataFrame:
    """Targets as they stand after their newest reviews; see verdict.effective_targets."""
    return verdict.effective_targets(targets, verdict.latest_reviews(reviews, *keys), *keys)


def touched(effective: DataFrame, page: str) -> DataFrame:
    """Of pages with a review that counts: how many reviews were applied, and how many changed a target. Other pages are not there."""
    return verdict.overridden(effective, page).filter("n_applied > 0")


def pages_after_review(machine: DataFrame, pages: DataFrame, effective: DataFrame, page: str = "page_id") -> DataFrame:
    """machine (page, doc_status, action) with the pages that a review touches judged again, and source MACHINE or AFTER_REVIEW; all other rows are the machine's own. pages: page, is_color."""
    hit = touched(effective, page)
    own = effective.join(hit.select(page), page, "left_semi")
    again = verdict.reviewed_verdict(own, pages.join(hit.select(page), page, "left_semi"), page).join(hit, page)
    again = again.select(page, "doc_status", "action", "n_applied", "n_overridden", F.lit("AFTER_REVIEW").alias("source"))
    zero = F.lit(0).cast("long")
    kept = machine.join(hit.select(page), page, "left_anti").select(page, "doc_status", "action", zero.alias("n_applied"), zero.alias("n_overridden"), F.lit("MACHINE").alias("source"))
    return kept.unionByName(again)


def dossiers_after_review(machine: DataFrame, members: DataFrame, pages: DataFrame, effective: DataFrame, required_roles: DataFrame) -> DataFrame:
    """machine dossiers with those that hold a touched page judged again on the targets as they stand, and their source. Of members, pages and targets only the touched dossiers' rows are read further; all
    other dossiers keep the machine's row as it is. Reviews that arrive later touch their own dossiers only, so the work follows the reviews and not the table."""
    hit = touched(effective, "page_id").select("page_id")
    dossiers = written(members.join(hit, "page_id", "left_semi").select("dossier_id").distinct())
    own = members.join(dossiers, "dossier_id", "left_semi")
    near = written(own.select("page_id").distinct())
    again = verdict.dossier_verdict(own, pages.join(near, "page_id", "left_semi"), effective.join(near, "page_id", "left_semi"), required_roles)
    kept = machine.join(dossiers, "dossier_id", "left_anti").withColumn("source", F.lit("MACHINE"))
    return kept.unionByName(again.withColumn("source", F.lit("AFTER_REVIEW")))
