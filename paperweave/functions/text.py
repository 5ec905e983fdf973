"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def _unmarked() -> tuple[str, str, str]:
    """By the rule of canonical decomposition: letters that are one letter with marks, those letters, and the marks that stand alone."""
    letters, plain, marks = [], [], []
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]):
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(bare) == 1 and bare != c:
            letters.append(c)
            plain.append(bare)
    return "".join(letters), "".join(plain), "".join(marks)


_LETTERS, _PLAIN, _MARKS = _unmarked()
#: White space by Unicode's property, but for the space itself.
_SPACES = "\t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def unmarked(c: Column, *more: tuple[str, str]) -> Column:
    """Decomposed, without combining marks: one translate, which deletes what has no counterpart. D with stroke does not decompose; more: (letters, their counterparts)."""
    return F.translate(c, _LETTERS + "".join(a for a, _ in more) + _MARKS, _PLAIN + "".join(b for _, b in more))


def normalized(c: Column, keep: str = "A-Z0-9\\s:/._#-") -> Column:
    """Marks dropped, upper case, then D with stroke as D, each run of space and of other characters than `keep` (a class of ASCII characters) as one space. Null gives an empty string.

    One translate does it for all characters that give one or none; texts with others, or beyond the basic plane, are done by pattern."""
    text = F.replace(F.coalesce(c, F.lit("")), F.lit("\u00df"), F.lit("SS"))
    upper = F.translate(F.upper(unmarked(text)), "\u0110", "D")
    slow = F.regexp_replace(upper, f"[\\s[^{keep}]]", " ")
    return F.trim(_single_spaced(bound(F.translate(text, *_whole_map(keep)), lambda p: F.when(F.octet_length(p) > F.length(p), slow).otherwise(p))))


@lru_cache
def _whole_map(keep: str) -> tuple[str, str]:
    """Characters and what normalized() makes of them: those that give none are last."""
    kept = re.compile(f"[{keep}]", re.A)
    plain = dict(zip(_LETTERS, _PLAIN, strict=True)) | dict.fromkeys(_MARKS, "")
    told, gone = [], []
    for x in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]):
        own = [z if kept.match(z) and not z.isspace() else " " for z in plain.get(x, x).upper().replace("\u0110", "D")]
        if not own:
            gone.append(x)
        elif len(set(own)) == 1 and (len(own) == 1 or own[0] == " ") and own[0] != x:
            told.append((x, own[0]))
    return "".join(x for x, _ in told) + "".join(gone), "".join(z for _, z in told)


def _single_spaced(c: Column) -> Column:
    """Runs of spaces as one: halved as often as most texts need, longer runs by pattern."""
    for run in (32, 2, 2, 2, 2, 2, 2):
        c = F.replace(c, F.lit(" " * run), F.lit(" "))
    return bound(c, lambda p: F.when(F.contains(p, F.lit("  ")), F.regexp_replace(p, " +", " ")).otherwise(p))


def marker(c: Column) -> Column:
    """For markers of forms: D with stroke first, marks dropped, upper case, spaces collapsed; all other characters stay."""
    plain = F.upper(unmarked(F.coalesce(c, F.lit("")), ("\u0111\u0110", "dD")))
    return F.trim(_single_spaced(F.translate(plain, _SPACES, " " * len(_SPACES))))


def plain_upper(c: Column, stroke: bool = False) -> Column:
    """Marks dropped and upper case, nothing else; D with stroke stays unless asked for."""
    return F.upper(unmarked(F.coalesce(c, F.lit("")), *[("\u0111\u0110", "dD")] * stroke))


def orientation_text(c: Column) -> Column:
    """Marks dropped, upper case, all but letters, digits and space as spaces, one for one."""
    return F.regexp_replace(plain_upper(c), "[^A-Z0-9\\s]", " ")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def repaired_id(c: Column, known: dict[str, str] | None = None) -> Column:
    """A leading I or L before digits only is a misread 1; then a table of known misreadings, if there is one. Blank is null."""
    plain = F.regexp_replace(blank_to_null(c), "^[IL](?=\\d+$)", "1")
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), plain), plain) if known else plain


def contains_any(c: Column, *phrases: str) -> Column:
    return reduce(Column.__or__, (F.contains(c, F.lit(p)) for p in phrases))


def mentioned(c: Column, phrases: Iterable[str]) -> Column:
    """The phrases that a text contains, a line each: it contains one of them just where the text does, so that a long text is searched once for each, however often it is asked.

    Phrases that share four letters are looked for only where these are."""
    left, found = set(phrases), []
    while left:
        shared = Counter(x for p in left for x in {p[i : i + 4] for i in range(max(1, len(p) - 3))})
        part = min(shared, key=lambda x: (-shared[x], x))
        some = sorted(p for p in left if part in p)
        left.difference_update(some)
        found.append(F.when(F.contains(c, F.lit(part)), F.array_join(F.filter(F.array(*(F.lit(p) for p in some)), lambda p: F.contains(c, p)), "\n")))
    return F.concat_ws("\n", *found)


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed once however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    """Places at which strings of one length differ."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.lit(0), lambda n, i: n + (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))


def near_equal(a: Column, b: Column) -> Column:
    """Equal, of one length with at most two other characters, or one a beginning of the other."""
    return F.when(F.length(a) == F.length(b), (a == b) | (hamming(a, b) <= 2)).otherwise(a.startswith(b) | b.startswith(a))


def natural_key(c: Column) -> Column:
    """Sorts like the text with its numbers by value: digit runs padded to twelve places."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit("(\\d+|\\D+)"), F.lit(1)), lambda p: F.when(p.rlike("^\\d+$"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), F.greatest(F.length(p), F.lit(12)), "0")).otherwise(p)), "")


def contains_term(c: Column, term: str) -> Column:
    """Case-blind search for a literal term, its wildcards escaped."""
    return c.ilike("%" + term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%")


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "[/\\\\]"), -1)


def role_name(c: Column) -> Column:
    """Lower case, instructions in parentheses dropped, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "\\([^)]*\\)", " "), "\\s+", " "))


def truth_of(c: Column) -> Column:
    """A form value as boolean; anything outside the vocabulary is null for the caller to reject."""
    v = F.lower(F.trim(c))
    return F.when(v.isin("1", "true", "yes", "on"), True).when(v.isin("0", "false", "no", "off", ""), False)


def truth_or_error(c: Column) -> Column:
    """A form value as boolean; one outside the vocabulary is an error that names it. Null stays null."""
    told = truth_of(c)
    return F.when(c.isNotNull() & told.isNull(), F.raise_error(F.concat(F.lit("no boolean: "), c)).cast("boolean")).otherwise(told)


def fenced_json(c: Column) -> Column:
    """From the first brace to the last, or null."""
    return F.nullif(F.regexp_extract(c, "(?s)\\{.*\\}", 0), F.lit(""))


def fixed(c: Column, places: int = 4) -> Column:
    """Half-up at so many places by plain arithmetic, equal on every engine."""
    return F.floor(c * 10**places + F.lit(0.5)).cast("double") / F.lit(float(10**places))


def first_where(condition_and_value: list[tuple[Column, Column | str | None]], otherwise: Column | str | None = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in condition_and_value:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))
