"""Small operators on records: labels, actions, gates on what was extracted, ordered fills, queues and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperweave.functions import text as tx

from paperweave.functions.text import first_where


def labelled(df: DataFrame, code: str, labels: dict[str, tuple[str, str]]) -> DataFrame:
    """A code's label and tone; one that is not listed keeps its name, needs review and is neutral. The list is a literal map, so no join is planned."""
    names = F.create_map(*[F.lit(x) for k, (label, _) in labels.items() for x in (k, label)])
    tones = F.create_map(*[F.lit(x) for k, (_, tone) in labels.items() for x in (k, tone)])
    return df.withColumn("label", F.coalesce(names[F.col(code)], F.concat(F.col(code), F.lit(" · needs review")))).withColumn("tone", F.coalesce(tones[F.col(code)], F.lit("neutral")))


def filled_down(df: DataFrame, group: str, order: str, *columns: str) -> DataFrame:
    """Empty cells take the last value above them."""
    upto = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})


def filled_from(first: Column, second: Column) -> tuple[Column, Column]:
    """A second reading fills what the first lacks; and whether it did."""
    return F.coalesce(first, second), first.isNull() & second.isNotNull()


def out_of_order(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Groups whose values do not rise with their order, and how often they fall."""
    falls = F.lag(value).over(W.partitionBy(group).orderBy(order)) >= F.col(value)
    return df.withColumn("falls", falls).groupBy(group).agg(F.count_if("falls").alias("n_falls"), (F.count_if("falls") == 0).alias("monotone"))


def neighbours(df: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """The rows before and after each one, and its number among those of its group."""
    w = W.partitionBy(group).orderBy(order)
    return df.select(group, key, F.lag(key).over(w).alias("previous"), F.lead(key).over(w).alias("next"), F.row_number().over(w).alias("number"))


def newest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key, ties to the greater id."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r")).select(*keys, "r.*")


def requeued(jobs: DataFrame, now: Column, stale_seconds: int, max_attempts: int) -> DataFrame:
    """Running jobs without a sign of life go back to the queue with one more attempt, or fail after too many."""
    stale = (F.col("state") == "RUNNING") & (F.col("heartbeat") < now - stale_seconds)
    attempts = F.when(stale, F.col("attempts") + 1).otherwise(F.col("attempts"))
    state = F.when(stale, F.when(attempts > max_attempts, "FAILED").otherwise("QUEUED")).otherwise(F.col("state"))
    return jobs.withColumns({"state": state, "attempts": attempts})


def next_job(jobs: DataFrame, order: str, tie: str) -> DataFrame:
    return jobs.filter("state = 'QUEUED'").orderBy(order, tie).limit(1)


def not_seeded(new: DataFrame, there: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not there yet: adding them twice changes nothing."""
    return new.dropDuplicates(list(keys)).join(there, list(keys), "left_anti")


def contiguous(df: DataFrame, group: str, index: str) -> DataFrame:
    """Whether a group's indexes are 0 to n - 1, each once."""
    return df.groupBy(group).agg(F.count("*").alias("n"), ((F.max(index) == F.count("*") - 1) & (F.min(index) == 0) & (F.count_distinct(index) == F.count("*"))).alias("contiguous"))


def resolved(refs: DataFrame, pages: DataFrame, ref: str, by: list[str]) -> DataFrame:
    """References by the first of several keys under which a page is known."""
    out = refs
    for i, key in enumerate(by):
        side = pages.select(F.col(key).cast("string").alias(ref), F.col("page_id").alias(f"hit{i}")).dropDuplicates([ref])
        out = out.join(side, ref, "left")
    return out.select(*refs.columns, F.coalesce(*(f"hit{i}" for i in range(len(by)))).alias("page_id"))


def differing_fields(a: Column, b: Column, ignored: list[str]) -> Column:
    """Keys of two maps whose values differ or that only one has, but for the ignored ones; sorted."""
    keys = F.array_except(F.array_union(F.map_keys(a), F.map_keys(b)), F.array(*map(F.lit, ignored)))
    return F.array_sort(F.filter(keys, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k))))


def target_kind(role: Column, colour: Column) -> Column:
    return F.when((colour == "red_stamp") | F.lower(role).rlike("stamp|seal"), "STAMP").otherwise("SIGNATURE")


def page_of_target(page: Column, files: Column) -> Column:
    """The file of a target, or why there is none: a number outside the document, or a file that is missing. Nothing is clamped."""
    return first_where([((page < 0) | (page >= F.size(files)), "INVALID_PAGE_MAPPING"), (F.get(files, page).isNull(), "INPUT_ERROR")], F.get(files, page))


def expanded_box(x0: Column, y0: Column, x1: Column, y1: Column, margin: float) -> list[Column]:
    """A box widened by a margin and kept within the page."""
    return [F.greatest(F.lit(0.0), x0 - margin), F.greatest(F.lit(0.0), y0 - margin), F.least(F.lit(1.0), x1 + margin), F.least(F.lit(1.0), y1 + margin)]


#: The bands of a page in which a box may lie, down and across, and the least side in pixels.
SAFE_Y, SAFE_X, LEAST_SIDE = (0.02, 0.97), (0.08, 0.96), 8


def safe_box(y0: Column, x0: Column, y1: Column, x1: Column, margin: float, width: int, height: int) -> Column:
    """[y0, x0, y1, x1] in whole pixels of a box widened by a share of its own sides and kept within the safe bands; null if a side is left too short. Fractions are cut off."""
    dy, dx = (y1 - y0) * margin, (x1 - x0) * margin
    low = lambda c, band, size: F.greatest(F.lit(0), (F.greatest(F.lit(band), c) * size).cast("int"))
    high = lambda c, band, size: (F.least(F.lit(band), c) * size).cast("int")
    a, b = low(y0 - dy, SAFE_Y[0], height), low(x0 - dx, SAFE_X[0], width)
    c, d = high(y1 + dy, SAFE_Y[1], height), high(x1 + dx, SAFE_X[1], width)
    return F.when((c - a >= LEAST_SIDE) & (d - b >= LEAST_SIDE), F.array(a, b, c, d))


# What is read for a digit, and the digit; digits that are read for a letter, and the letter.
READ_AS_DIGIT = ("IL|!()OSBZG?DJAT", "1111110582622347")
READ_AS_LETTER = ("01582", "OISBZ")
#: The places of digits and letters in an invoice symbol (others stay), how a raw one looks, and a well-formed one.
SYMBOL_KINDS = "DLDDL--"
RAW_SYMBOL = "(?<![0-9A-Z])([0-9A-ZD|!(){}\\[\\]?][CKG][0-9A-ZD?|!]{2}[A-Z][0-9A-Z]{2})(?![0-9A-Z])"
SYMBOL = "^[1-6][CK][0-9]{2}[A-Z][A-Z]{2}"


def coerced(c: Column, kinds: str = SYMBOL_KINDS) -> Column:
    """Characters set right place by place, in upper case: kinds has D for a digit, L for a letter, anything else for a place left alone."""
    upper = F.upper(c)
    tables = {"D": READ_AS_DIGIT, "L": READ_AS_LETTER}
    places = [F.substring(upper, i + 1, 1) for i in range(len(kinds))]
    return F.concat(*(F.translate(x, *tables[k]) if k in tables else x for x, k in zip(places, kinds, strict=True)), F.substring(upper, len(kinds) + 1, 1 << 30))


def invoice_symbol(text: Column, template: str = SYMBOL) -> Column:
    """The first raw symbol of a text that fits the template once coerced, as a struct (raw, symbol); null if there is none."""
    found = F.transform(F.regexp_extract_all(tx.marker(text), F.lit(RAW_SYMBOL), F.lit(1)), lambda r: F.struct(r.alias("raw"), coerced(r).alias("symbol")))
    return F.get(F.filter(found, lambda x: x["symbol"].rlike(template)), F.lit(0))


def symbol_facts(symbol: Column, told: Column, by_first: dict[str, str]) -> Column:
    """struct(symbol, implied, has_code, year, from_till, contradiction) of a well-formed invoice symbol: the sub-type that its first character stands for, and what its others say; contradiction tells if the print says another
    sub-type. It is evidence against a reading, never a reading of its own. A null symbol has no facts."""
    at = lambda i: F.substring(symbol, i, 1)
    implied = F.element_at(F.create_map(*(F.lit(x) for pair in by_first.items() for x in pair)), at(1))
    clash = F.when(implied != told, F.concat(told, F.lit(" <> "), implied, F.lit(" ("), symbol, F.lit(")")))
    return F.struct(symbol.alias("symbol"), implied.alias("implied"), (at(2) == "C").alias("has_code"), F.concat(F.lit("20"), F.substring(symbol, 3, 2)).alias("year"), (at(5) == "M").alias("from_till"), clash.alias("contradiction"))


def converted(text: Column, phrases: list[str], least: float = 90.0) -> Column:
    """The first phrase that says a print was converted from an electronic document, exact or nearly so; null if none does."""
    from paperweave.functions.fuzzy import bounded_ratio

    plain = tx.marker(text)
    return F.coalesce(*(F.when(F.contains(plain, F.lit(p)) | (bounded_ratio(p, plain, least, F.contains(plain, F.lit(p))) >= least), F.lit(p)) for p in phrases))


def variant(text: Column, markers: dict[str, str]) -> tuple[Column, Column]:
    """The variant whose marker is in the text if just one is, else why not."""
    hits = F.array_compact(F.array(*(F.when(F.contains(text, F.lit(m)), k) for k, m in markers.items())))
    n = F.size(hits)
    return F.when(n == 1, F.get(hits, F.lit(0))), F.when(n == 0, "FORM_VARIANT_UNRESOLVED").when(n > 1, "FORM_VARIANT_AMBIGUOUS")
