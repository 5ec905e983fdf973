"""What is read of the operational tables: projections, owners' rows, orders of lists, and counts that guard a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperweave.functions.text import first_where
from paperweave.operators.containment import least_of_holders
from paperweave.sources.lineage import dropped, spread, written

#: Kinds of evidence that a table has columns for at a time.
KINDS = 32


def visible_to(rows: DataFrame, user: Column, owner: str = "owner", admin: Column | None = None) -> DataFrame:
    """Rows of their owner, or all for an administrator; others are not there at all."""
    return rows.filter((F.col(owner) == user) | (admin if admin is not None else F.lit(False)))


def target_state(target: dict[str, Column]) -> Column:
    """How a target is shown: review, signed, missing_required or missing_optional. target: review_required, decision (null without a review), effective, detected, required."""
    sure = F.coalesce(target["effective"], F.when(target["decision"].isNull(), target["detected"]))
    return first_where(
        [
            (F.coalesce(target["review_required"], F.lit(False)) | F.coalesce(target["decision"] == "UNCLEAR", F.lit(False)), "review"),
            (target["decision"].isNotNull() & target["effective"].isNull(), "review"),
            (F.coalesce(sure, F.lit(False)), "signed"),
            (F.coalesce(target["required"], F.lit(True)), "missing_required"),
        ],
        "missing_optional",
    )


def with_batch(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """pages (file_name) with the batch of the last manifest entry (position, file_name, batch_id) for their file; without one BATCH_ISOLATED."""
    last = entries.groupBy("file_name").agg(F.max_by("batch_id", "position").alias("batch_id"))
    return pages.join(last, "file_name", "left").withColumn("batch_id", F.coalesce("batch_id", F.lit("BATCH_ISOLATED")))


def with_effective(machine: DataFrame, effective: DataFrame) -> DataFrame:
    """Machine dossiers beside their effective ones by id and pages; one that is not found says so. Both: dossier_id, pages (array), doc_status, action."""
    other = effective.select("dossier_id", "pages", F.col("doc_status").alias("effective_status"), F.col("action").alias("effective_action"), F.lit(True).alias("there"))
    rows = machine.join(other, ["dossier_id", "pages"], "left")
    return rows.withColumn("reason", F.when(F.col("there").isNull(), "EFFECTIVE_DOSSIER_NOT_FOUND")).drop("there")


def with_presets(documents: DataFrame, presets: dict[str, int]) -> DataFrame:
    """documents with the number of preset targets of their type and whether it is mapped."""
    n = F.element_at(F.create_map(*(F.lit(x) for pair in presets.items() for x in pair)), F.col("doc_type"))
    rows = documents.withColumn("n_targets", F.coalesce(n, F.lit(0)))
    return rows.withColumn("mapping_status", F.when(n.isNotNull(), "MAPPED").otherwise("UNMAPPED")).withColumn("preset_source", F.when(n.isNotNull(), "PRESETS"))


def with_uploads(results: DataFrame, uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results with their upload group by file name, ungrouped where none is known; and the files of which none is."""
    return results.join(uploads, "file_name", "left"), results.join(uploads, "file_name", "left_anti").select("file_name")


def review_history(reviews: DataFrame, targets: DataFrame) -> DataFrame:
    """Each page's reviews newest first, of one time by target, and whether the machine has since changed its mind or lost the target. reviews: page_id, review_id,
    target_index, created_at, machine_detected; targets: page_id, target_index, detected. Both sides are dealt by page, which serves the join and the order alike, to tasks whose rows do not grow with the table."""
    n = reviews.count()
    rows = spread(reviews, n, "page_id").join(spread(targets, n, "page_id"), ["page_id", "target_index"], "left")
    place = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("created_at"), "target_index", "review_id"))
    return rows.withColumn("place", place).withColumn("stale", ~F.coalesce(F.col("detected") == F.col("machine_detected"), F.lit(False)))


def may_rerun(groups: DataFrame, jobs: DataFrame) -> DataFrame:
    """Groups that are finished and have no job waiting or running."""
    return groups.filter(F.col("status").isin("DONE", "FAILED")).join(jobs.filter(F.col("status").isin("QUEUED", "RUNNING")).select("group_id"), "group_id", "left_anti")


def page_summaries(pages: DataFrame, machine: DataFrame, after: DataFrame, labels: dict[str, tuple[str, str]], supported: list[str]) -> DataFrame:
    """Pages as a list shows them: page_id, group_id, doc_type, the machine's status, the one after review with its action, label and tone, and whether it was reviewed, is supported and is a status that no label is known for. Pages that were not
    judged have no status. machine: page_id, doc_status; after: page_id, doc_status, action, n_applied; labels: status -> label, tone."""
    def shown(status: Column, i: int, other: Column) -> Column:
        return F.when(status.isNotNull(), F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, told in labels.items() for x in (k, told[i]))), status), other))

    rows = pages.join(machine.select("page_id", "doc_status"), "page_id", "left")
    rows = rows.join(after.select("page_id", F.col("doc_status").alias("effective_status"), F.col("action").alias("effective_action"), "n_applied"), "page_id", "left")
    status, own = F.col("effective_status"), F.col("doc_status")
    unknown = lambda c: F.concat(c, F.lit(" · needs review"))
    return rows.select(
        *pages.columns, "doc_status", "effective_status", "effective_action", (F.coalesce("n_applied", F.lit(0)) > 0).alias("reviewed"), F.coalesce(F.col("doc_type").isin(supported), F.lit(False)).alias("supported"),
        shown(status, 0, unknown(status)).alias("status_label"), F.coalesce(shown(status, 1, F.lit("neutral")), F.lit("neutral")).alias("status_tone"), shown(own, 0, unknown(own)).alias("machine_label"),
        (status.isNotNull() & ~F.coalesce(status.isin(list(labels)), F.lit(False))).alias("status_unknown"),
    )


def acts_with_users(reviews: DataFrame, audit: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """key, kind, by_whom: reviews of known users, and all audit rows, whose actor may be unknown or gone. reviews, audit: key, user_id; users: user_id, name."""
    told = reviews.join(users, "user_id").select(key, F.lit("REVIEW").alias("kind"), F.col("name").alias("by_whom"))
    return told.unionByName(audit.join(users, "user_id", "left").select(key, F.lit("AUDIT").alias("kind"), F.col("name").alias("by_whom")))


def stage_timings(runs: DataFrame, slow: float) -> DataFrame:
    """stage, n_runs, seconds, n_slow and n_unmeasured of runs (stage, seconds)."""
    return runs.groupBy("stage").agg(F.count("*").alias("n_runs"), F.sum("seconds").alias("seconds"), F.count_if(F.col("seconds") > slow).alias("n_slow"), F.count_if(F.col("seconds").isNull()).alias("n_unmeasured"))


def strict_flag(value: Column) -> Column:
    """A setting kept as JSON: true only if it is the boolean true."""
    return F.coalesce(F.trim(value) == "true", F.lit(False))


def isolated_pairs(missed: DataFrame) -> DataFrame:
    """Missed pairs counted by the isolated document that they hang on, most first, then by its key; places come from ranges of the order."""
    n = missed.groupBy("file_name", "doc_type", "reason").agg(F.count("*").alias("n"))
    return in_order(n.withColumn("down", -F.col("n")), "down", "file_name", "doc_type", "reason").drop("down")


def phrases(words: DataFrame, line: list[str], gap: float) -> DataFrame:
    """Words of text lines (x0, x1, height) grouped into phrases: a new one begins where the gap to all before is over `gap` median heights."""
    w = W.partitionBy(*line).orderBy("x0", "x1")
    rows = words.filter(" and ".join(f"`{c}` is not null" for c in line)).withColumn("before", F.max("x1").over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("em", F.percentile("height", F.lit(0.5)).over(W.partitionBy(*line)))
    rows = rows.withColumn("new", F.coalesce(F.col("x0") - F.col("before") > gap * F.col("em"), F.lit(True)).cast("int"))
    return rows.withColumn("phrase", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("em", "before", "new")


def rule_accuracy(rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rules of a truth table with the status of the first evidence that fits, NOT_FOUND counted as wrong. rules: rule_id, field, key, source_type, target_type, expected.
    evidence: position, field, status, source_type, target_type, values (strings; a rule's key must be contained in one of them, an empty key is in all). Evidence without a position comes last; rules that share a rule_id share the first evidence of any.

    Types that either side does not name fit. Of each kind (types and status, few) a key needs its least position only, KINDS kinds at a time; a rule then chooses among the kinds."""
    kinds = sorted((tuple(r) for r in evidence.select("source_type", "target_type", "status", F.col("position").isNull()).distinct().collect()), key=repr)
    place, found, tables = evidence.schema["position"].dataType, rules.withColumn("first__", F.lit(None)), []
    fields = [r[0] for r in rules.filter("key <> ''").select("field").distinct().limit(KINDS + 1).collect()]
    for at in range(0, len(kinds), KINDS):
        some = dict(enumerate(kinds[at : at + KINDS]))
        kind = F.coalesce(*(F.when(F.col("source_type").eqNullSafe(F.lit(s)) & F.col("target_type").eqNullSafe(F.lit(t)) & F.col("status").eqNullSafe(F.lit(v)) & (F.col("position").isNull() == F.lit(late)), i) for i, (s, t, v, late) in some.items()))
        told = evidence.select("field", "values", "position", kind.alias("kind__")).filter("kind__ is not null")
        measures = {f"least__{i}": F.when(F.col("kind__") == i, F.lit(True) if late else F.col("position")) for i, (_, _, _, late) in some.items()}
        whole = told.groupBy("field").agg(F.lit("").alias("key"), *(F.min(m).alias(name) for name, m in measures.items()))
        held = least_of_holders(told.filter(F.col("field").isin(fields)) if len(fields) <= KINDS else told, rules, measures, "field")
        tables += held
        for frame in held:
            whole = whole.unionByName(frame)
        choices = [F.when(F.col(f"least__{i}").isNotNull() & _fit("target_type", t, s) & _fit("source_type", s, t), F.struct(F.lit(late).alias("late"), (F.lit(None).cast(place) if late else F.col(f"least__{i}")).alias("position"), F.lit(v is None).alias("none"), F.lit(v).cast("string").alias("status"))) for i, (s, t, v, late) in some.items()]
        least = F.array_min(F.array(*choices, *([F.col("first__")] if at else [])))
        found = found.join(whole, ["field", "key"], "left").select(*(F.col(c) for c in rules.columns), least.alias("first__"))
    if not kinds:
        return rules.withColumn("actual", F.lit("NOT_FOUND")).withColumn("correct", F.col("actual") == F.col("expected"))
    found = written(found)
    dropped(*tables)
    actual = F.when(F.col("rule_id").isNotNull(), F.min("first__").over(W.partitionBy("rule_id"))["status"])
    rows = found.select(*rules.columns, F.coalesce(actual, F.lit("NOT_FOUND")).alias("actual"))
    return rows.withColumn("correct", F.col("actual") == F.col("expected"))


def _fit(wanted: str, own: str | None, other: str | None) -> Column:
    """Whether a rule's type fits evidence of these types."""
    return F.lit(True) if own is None else F.col(wanted).isNull() | F.coalesce(F.col(wanted).isin([x for x in (own, other) if x is not None]), F.lit(False))


def job_state(jobs: DataFrame) -> DataFrame:
    """The newest job of each group as the status page shows it; ties go to the greater id. jobs: group_id, job_id, status, stage, stage_done, stage_total, percent, message, created_at."""
    shown = F.struct("job_id", "status", "stage", "stage_done", "stage_total", "percent", "message", "created_at")
    return jobs.groupBy("group_id").agg(F.max_by(shown, F.struct("created_at", "job_id")).alias("job")).select("group_id", "job.*")


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """rows with their place in a total order, from range-partitioned counts: no task sees more than its range.

    The place of a row is its place in its range and the rows of the ranges before; ranges are written, so both reads see the same rows."""
    ranged = written(rows.repartitionByRange(*order).withColumn("range__", F.spark_partition_id()))
    counts = ranged.groupBy("range__").agg(F.count("*").alias("n"))
    upto = W.orderBy("range__").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("range__", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("range__").orderBy(*order)) + F.col("before")
    return ranged.join(starts, "range__").withColumn("place", place).drop("range__", "before")


def in_scope_files(pages: DataFrame, scope: list[str]) -> DataFrame:
    """Files of the types in scope, in order."""
    return in_order(pages.filter(F.coalesce("doc_type", F.lit("UNKNOWN")).isin(scope)).select("file_name"), "file_name")


def scorable(rows: DataFrame, label: str, yes: str = "YES", no: str = "NO") -> DataFrame:
    """Rows that can be scored: those whose label is one of the two; ambiguous and unknown ones are left out, and nothing is guessed for them."""
    return rows.filter(F.col(label).isin(yes, no))


def parity_counts(ours: DataFrame, theirs: DataFrame, key: str, stages: dict[str, list[str]]) -> DataFrame:
    """For each stage: rows compared, fields that differ and files with a difference. stages: name -> fields; a file that the other side lacks differs in all fields that are not null."""
    other = theirs.select(key, *(F.col(f).alias(f"their_{f}") for fs in stages.values() for f in fs))
    rows = ours.join(other, key, "left")
    differ = [F.struct(F.lit(s).alias("stage"), sum((~F.col(f).eqNullSafe(F.col(f"their_{f}"))).cast("int") for f in fs).alias("n")) for s, fs in stages.items()]
    told = rows.select(F.explode(F.array(*differ)).alias("d")).select("d.*")
    return told.groupBy("stage").agg(F.count("*").alias("n_compared"), F.sum("n").alias("n_diffs"), F.count_if(F.col("n") > 0).alias("n_files"))
