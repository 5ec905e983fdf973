"""Keyword scores of texts against a small ordered dictionary, the best type and its margin, and key fields.

A dictionary is a list of (type, [phrases]); its order breaks ties. Rules are literals of the plan: phrases found in one pass of each text, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.functions.fuzzy import bounded_ratio
from paperweave.functions.text import blank_to_null

Rules = list[tuple[str, list[str]]]


def checked(rules: Rules) -> Rules:
    """The rules, if no type is empty or told twice."""
    names = [t for t, _ in rules]
    if len(set(names)) < len(names) or not all(t and phrases and all(phrases) for t, phrases in rules):
        raise ValueError("a dictionary has each type once, with phrases")
    return rules


def candidates(text: Column, rules: Rules, fuzzy: bool = False, threshold: float = 0.78, never_fuzzy: tuple[str, ...] = ()) -> Column:
    """Types found in a normalised text as structs (score, n, ord, type, phrase, exact), best first. An exact phrase scores 1 and a little
    for its length; with fuzzy, phrases of 8 and more letters that are not there, and hold none of `never_fuzzy`, may score by their best window, from the threshold on."""
    out = []
    for i, (name, phrases) in enumerate(checked(rules)):
        found = []
        for j, phrase in enumerate(phrases):
            exact = F.contains(text, F.lit(phrase))
            score = F.when(exact, F.lit(1 + min(len(phrase) / 100, 0.1)))
            if fuzzy and len(phrase) >= 8 and not any(x in phrase for x in never_fuzzy):
                near = bounded_ratio(phrase, text, 100 * threshold, exact) / 100
                score = score.when(near >= threshold, near)
            found.append(F.when(score.isNotNull(), F.struct(score.alias("raw"), F.lit(-j).alias("o"), F.lit(phrase).alias("phrase"), exact.alias("exact"))))
        best = F.array_max(F.array_compact(F.array(*found)))
        out.append(F.when(best.isNotNull(), F.struct(F.least(best["raw"], F.lit(1.0)).alias("score"), F.length(best["phrase"]).alias("n"), F.lit(-i).alias("ord"), F.lit(name).alias("type"), best["phrase"].alias("phrase"), best["exact"].alias("exact"))))
    return F.sort_array(F.array_compact(F.array(*out)), asc=False)


def best_type(df: DataFrame, text: Column, rules: Rules, fuzzy: bool = False) -> DataFrame:
    """df with doc_type, doc_score, margin and phrase. Rivals whose phrase is part of the winner's, and fuzzy rivals of an exact winner, do not narrow the margin."""
    rows = df.withColumn("found", candidates(text, rules, fuzzy))
    top = F.get("found", F.lit(0))
    rivals = F.filter(F.slice("found", 2, len(rules)), lambda c: ~F.contains(top["phrase"], c["phrase"]) & ~(top["exact"] & ~c["exact"]))
    margin = top["score"] - F.coalesce(F.get(rivals, F.lit(0))["score"], F.lit(0.0))
    return rows.withColumn("doc_type", F.coalesce(top["type"], F.lit("UNKNOWN"))).withColumn("doc_score", F.coalesce(top["score"], F.lit(0.0))).withColumn("margin", F.coalesce(margin, F.lit(0.0))).withColumn("phrase", top["phrase"]).drop("found")


def first_match(text: Column, patterns: list[tuple[str, str | None]]) -> Column:
    """The first group of the first pattern whose match passes its filter (a pattern to match in full, or None)."""
    out = []
    for pattern, wanted in patterns:
        got = blank_to_null(F.regexp_extract(text, pattern, 1))
        out.append(got if wanted is None else F.when(got.rlike(f"^(?:{wanted})$"), got))
    return F.coalesce(*out)
