"""What a page is: its document type, channel, role, key fields and sub-type, decided from normalised text by ordered rules.

Every decision is a column expression over one row, so a table of any size is judged without a shuffle. Dictionaries are
parameters; phrases that belong to a rule itself stand beside it as fixed values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.functions.fuzzy import bounded_ratio
from paperweave.functions.text import bound, contains_any, first_where, mentioned, repaired_id
from paperweave.operators.classify import Rules, candidates

# The phrases of the ordered rules.
DISPATCH_SLIP = ("XUAT KHO KIEM VAN CHUYEN", "PXKKVCNB", "KIEM VAN CHUYEN NOI BO", "PHIEU XUAT KHO KIEM")
ORDER_TITLES = ("DON DAT HANG", "PURCHASE ORDER", "STORE ORDER", "BON DAT HANG", "QUY CACH DAT HANG")
OWED_GOODS = ("TRUONG HOP NO HANG", "TRUONG HOP NO HONG", "AP DUNG CHO CAC TRUONG HOP NO", "AP DUNG CHO COC TRUONG HOP NO")
INVOICE_ENCLOSED = "(?:KEM\\s*THEO|GIAO\\s*HANG\\s*KEM\\s*THEO)[^.\\n]{0,40}HOA\\s*DON\\s*GTGT"
PLAN_TITLES = ("LOADING PLAN", "BANG KE GIAO HANG", "LE NH XUAT HANG", "LENH XUAT HANG")
COMMON_FORMS = ("LENH_DIEU_XE", "BIEU_DO_NHIET_DO", "BBBG_PALLET", "BIEN_BAN_NO_HANG", "BIEN_BAN_TRA_HANG", "BB_NO_HANG", "BB_TRA_HANG")
BUSINESS_BUYER = ("CONG TY", "TNHH", "DOANH NGHIEP", "DNTN", "KHACH HANG", "KHACH HING")


def _kind(name: str | Column, score: float | Column, margin: float | Column, phrase: str | Column) -> Column:
    lit = [x if isinstance(x, Column) else F.lit(x) for x in (name, score, margin, phrase)]
    return F.struct(lit[0].alias("doc_type"), lit[1].cast("double").alias("score"), lit[2].cast("double").alias("margin"), lit[3].alias("phrase"))


#: Words of goods that only tables of goods hold; a user adds the names of their own.
GOODS = ("KEM",)


def decided(df: DataFrame, text: str, rules: Rules, systems: Rules, sides: Rules, fuzzy: bool = True) -> DataFrame:
    """df with kind (document_type()) and channel (channel()) of its normalised text. Candidates are columns first, so that a fuzzy score is computed once; the phrases of all rules are looked for once in each text."""
    t, m = F.col(text), F.col("mentioned__")
    exact = lambda rs: [p for _, ps in rs for p in ps]
    rows = df.withColumn("mentioned__", mentioned(t, [*RULE_PHRASES, *GOODS, "GTGT", *exact(rules), *exact(systems), *exact(sides)]))
    if not fuzzy:
        rows = rows.withColumn("clean__", F.when(_may_enclose(m), mentioned(F.regexp_replace(t, INVOICE_ENCLOSED, ""), exact(rules))).otherwise(m))
    rows = rows.withColumn("phrases__", phrases_of(t, rules) if fuzzy else candidates(F.col("clean__"), rules)).withColumn("systems__", systems_of(t if fuzzy else m, systems, fuzzy))
    rows = rows.withColumn("kind", document_type(t, F.col("phrases__"), found_in=m))
    return rows.withColumn("channel", channel(t, F.col("kind.doc_type"), F.col("systems__"), sides, found_in=m)).drop("mentioned__", "clean__", "phrases__", "systems__")


def is_continuation(t: Column, goods: tuple[str, ...] = GOODS) -> Column:
    """A page of a table that began on the page before."""
    has = lambda *p: contains_any(t, *p)
    return ~has(*ORDER_TITLES) & (
        has("TRANG 2")
        | (has("MA VACH", "BARCODE") & has("DON GIA"))
        | (has("LAYOUT") & has("STT") & ~has("DON DAT HANG") & ~has("PO"))
        | (has("MA SAN PHAM", "MA SP") & has(*goods) & ~has("HOA DON GIA TRI GIA TANG"))
    )


#: All phrases that document_type() and channel() look for beside their dictionaries.
RULE_PHRASES = (
    *DISPATCH_SLIP, *ORDER_TITLES, *OWED_GOODS, *BUSINESS_BUYER, "AEON", "TRANG 2", "MA VACH", "BARCODE", "DON GIA", "LAYOUT", "STT", "PO", "MA SAN PHAM", "MA SP", "HOA DON GIA TRI GIA TANG",
    "DUNG XE", "XE DANG CHAY", "DATALOGGER", "PALLET", "SO KG", "SO KHOI", "TRUONG BP KHO", "PHIEU GIAO HANG", "PGH", "PHIEU GIAO NHAN", "BIEN NHAN HANG", "GOLD COAST", "LENH DIEU XE", "LENH DIEU DONG XE",
    "DIEU DONG XE", "XE LANH", "GS25", "DOI TRA", "DOI, TRA", "NO HANG", "BIEN BAN NO", "TRUONG HOP NO",
)


def _fallbacks(t: Column, brands: tuple[str, ...], found_in: Column) -> list[tuple[Column, Column]]:
    has = lambda *p: contains_any(found_in, *p)
    return [
        (t.rlike("-\\d{1,2}\\.\\d") | has("DUNG XE", "XE DANG CHAY", "DATALOGGER"), _kind("BIEU_DO_NHIET_DO", 0.9, 0.3, "GPS/Datalogger log")),
        ((has("PALLET") & has("SO KG")) | has("SO KHOI", "TRUONG BP KHO"), _kind("LOADING_PLAN", 0.85, 0.25, "Loading plan totals")),
        (has("PHIEU GIAO HANG", "PGH", "PHIEU GIAO NHAN", "BIEN NHAN HANG", "GOLD COAST"), _kind("PHIEU_GIAO_HANG", 0.85, 0.25, "Phieu giao hang")),
        (has("LENH DIEU XE", "LENH DIEU DONG XE", "DIEU DONG XE", "XE LANH"), _kind("LENH_DIEU_XE", 0.85, 0.25, "Lenh dieu xe")),
        (has("BON DAT HANG", "STORE ORDER", "GS25", "PURCHASE ORDER", "QUY CACH DAT HANG"), _kind("PO", 0.85, 0.25, "Don dat hang sieu thi")),
        (has("DOI TRA", "DOI, TRA"), _kind("BB_TRA_HANG", 0.85, 0.25, "Bien ban doi tra")),
        (has("NO HANG", "BIEN BAN NO", "TRUONG HOP NO"), _kind("BB_NO_HANG", 0.85, 0.25, "Bien ban no hang")),
        (has("MA SAN PHAM", "BARCODE", "DON GIA", *brands), _kind("TABLE_CONTINUATION", 0.75, 0.2, "Bang hang hoa phu")),
    ]


def phrases_of(text: Column, rules: Rules, fuzzy: bool = True) -> Column:
    """The dictionary's candidates for document_type(), in the text without mentions of enclosed invoices."""
    return candidates(without_enclosed(text), rules, fuzzy)


def without_enclosed(text: Column) -> Column:
    """A normalised text without mentions of enclosed invoices."""
    return F.when(_may_enclose(text), F.regexp_replace(text, INVOICE_ENCLOSED, "")).otherwise(text)


def _may_enclose(text: Column) -> Column:
    return F.contains(text, F.lit("GTGT")) & F.contains(text, F.lit("KEM"))


def document_type(text: Column, found: Column, goods: tuple[str, ...] = GOODS, brands: tuple[str, ...] = (), found_in: Column | None = None) -> Column:
    """struct(doc_type, score, margin, phrase) of a normalised text: the protected type, continued tables, owed goods, the best of the dictionary's
    candidates (phrases_of(), as a column of their own), then the fallbacks; else UNKNOWN. goods mark a continued table, brands the last fallback. found_in: mentioned() of RULE_PHRASES, goods and brands, if it is there."""
    plain = text if found_in is None else found_in
    top = F.get(found, F.lit(0))
    rivals = F.filter(F.slice(found, F.lit(2), F.greatest(F.size(found), F.lit(1))), lambda c: ~F.contains(top["phrase"], c["phrase"]) & ~(top["exact"] & ~c["exact"]))
    margin = F.round(top["score"] - F.coalesce(F.get(rivals, F.lit(0))["score"], F.lit(0.0)), 2)
    return first_where(
        [
            (contains_any(plain, *DISPATCH_SLIP), _kind("PXKKVCNB", 1.0, 0.4, "PHIEU XUAT KHO KIEM VAN CHUYEN NOI BO")),
            (is_continuation(plain, goods), _kind("TABLE_CONTINUATION", 0.9, 0.4, "Bang hang hoa (Trang tiep)")),
            (contains_any(plain, *OWED_GOODS), _kind("BB_NO_HANG", 1.0, 0.4, "BIEN BAN NO HANG")),
            (F.size(found) > 0, _kind(top["type"], top["score"], margin, top["phrase"])),
            *_fallbacks(text, brands, plain),
        ],
        _kind("UNKNOWN", 0.0, 0.0, ""),
    )


def _word(text: Column, word: str, found_in: Column) -> Column:
    return F.contains(found_in, F.lit(word)) & text.rlike(f"\\b{_quoted(word)}\\b")


def transfer_side(text: Column, sides: Rules, found_in: Column | None = None) -> Column:
    """struct(system, marker): the side of a transfer whose markers, as whole words, are there while the other's are not; else the parent, unguessed."""
    first = [F.coalesce(*(F.when(_word(text, m, text if found_in is None else found_in), m) for m in markers)) for _, markers in sides]
    hits = F.array_compact(F.array(*(F.when(m.isNotNull(), F.struct(F.lit(name).alias("system"), m.alias("marker"))) for (name, _), m in zip(sides, first, strict=True))))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).otherwise(F.struct(F.lit("INTERNAL_TRANSFER").alias("system"), F.lit("").alias("marker")))


def _quoted(phrase: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in phrase)


def systems_of(text: Column, rules: Rules, fuzzy: bool = True) -> Column:
    """The dictionary's candidates for channel(); names of countries are never fuzzy."""
    return candidates(text, rules, fuzzy, 0.9, ("VIET NAM", "VIETNAM"))


def channel(text: Column, doc_type: Column, found: Column, sides: Rules, whole_word: tuple[str, str] = ("AEON", "MT_AEON"), found_in: Column | None = None) -> Column:
    """struct(system, score, phrase): form defaults, transfers and recalls by type, one chain by whole word only, the dictionary, then a business buyer on an invoice; else COMMON. found_in: mentioned() of all their phrases, if it is there."""
    plain = text if found_in is None else found_in
    side = transfer_side(text, sides, found_in)
    top = F.get(found, F.lit(0))

    def told(system: str | Column, score: float | Column, phrase: str | Column) -> Column:
        lit = [x if isinstance(x, Column) else F.lit(x) for x in (system, score, phrase)]
        return F.struct(lit[0].alias("system"), lit[1].cast("double").alias("score"), lit[2].alias("phrase"))

    sub = F.when(side["marker"] != "", F.concat(F.lit("|SUB:"), side["marker"])).otherwise("")
    refined = (top["type"] == "INTERNAL_TRANSFER") & (side["marker"] != "")
    return first_where(
        [
            (doc_type.isin(*COMMON_FORMS), told("COMMON", 1.0, F.concat(F.lit("FORM_DEFAULT_"), doc_type))),
            (doc_type == "PHIEU_XUAT_HANG", told(side["system"], 1.0, F.concat(F.lit("SOP_PHIEU_XUAT_HANG"), sub))),
            (doc_type == "BB_THU_HOI", told("GT", 1.0, "SOP_THU_HOI_TU_NPP")),
            (_word(text, whole_word[0], plain), told(whole_word[1], 1.0, whole_word[0])),
            ((F.size(found) > 0) & refined, told(side["system"], top["score"], F.concat(top["phrase"], sub))),
            (F.size(found) > 0, told(top["type"], top["score"], top["phrase"])),
            ((doc_type == "HOA_DON") & contains_any(plain, *BUSINESS_BUYER), told("GT", 0.85, "HOA_DON_DOANH_NGHIEP_GT")),
        ],
        told("COMMON", 0.8, ""),
    )


# The patterns of key fields in normalised text.
TRANSFER_ORDER = ("(?:LENH\\s*DIEU\\s*DONG|DIEU\\s*DONG\\s*SO|CAN\\s*CU\\s*LENH\\s*DIEU\\s*DONG)[\\s:_#-]*([0-9]{10,16})", "(?:DIEU\\s*DONG)[^0-9\\n]{0,20}([0-9]{10,16})")
SHIPMENT = (
    "(?:SHIPMENT(?:\\s*(?:ID|NO|SO|:))?|SHIPMES|STIPMEEN|STIPM|SMPMENL|SMPMEN|SHP(?:MENT|MEN)?|SO\\s*CHUYEN|MA\\s*CHUYEN|CHUYEN\\s*XE)[\\s:_#\\-\\._]*([0-9A-Z]{5,10})",
    "(?:LENH\\s*DIEU\\s*DONG|LENH\\s*DIEU\\s*XE)[\\s:_#\\-\\._]*([0-9]{5,10})",
)
SHIPMENT_ON_INVOICE = "(?:GIAO\\s*HANG|XUAT\\s*KHO|SAP|REF|CHUYEN|VAN\\s*DON|SHP|SMPMEN|SHIPMENT|LENH)[^0-9\\n]{0,25}\\b(1[123]\\d{4,5}|21001\\d{5})\\b"
SHIPMENT_ON_PLAN = "\\b(12[0-9]{4}|13[0-9]{4})\\b"
INVOICE = ("(?:HOA\\s*DON|SO\\s*HOA\\s*DON|SO\\s*HD)[\\s:_#-]*([0-9A-Z]{5,9})", "(?:KY\\s*HIEU|MAU\\s*SO)[^0-9]*([0-9A-Z]{5,9})", "\\b(00[0-9A-Z]{4,7})\\b")
RELEASE_SLIP = "\\d{0,2}(00\\d{5})"
ORDER = (
    "\\b(P-[0-9]{8,10})\\b",
    "\\b([0-9]{5}PO[0-9]{9,12})\\b",
    "(?:POM|OM|O)?([0-9]{3}P[0-9]{6,8})\\b",
    "(\\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\\d|3[01])[0-9]{10})",
    "\\b(417[0-9]{7})\\b",
    "\\b(450[0-9]{7})\\b",
    "\\b(W[EH][0-9]{10,18})\\b",
    "\\b(1002[0-9]{10})\\b",
    "\\b(?:PO|DON\\s*DAT\\s*HANG|ORDER(?:\\s*NO)?)\\b[\\s:_#-]*([0-9A-Z_-]{4,20})",
    "\\b(?:STORE\\s*ORDER|ORD\\s*SHEET)\\b[\\s:_#-]*([0-9A-Z_-]{4,20})",
)


#: Of a pattern: strings of which every match holds one, so that texts without any are not searched by it.
NEEDED = {
    SHIPMENT[0]: ("SHIPM", "STIPM", "SMPM", "SHP", "CHUYEN"),
    SHIPMENT[1]: ("DIEU",),
    INVOICE[0]: ("HOA", "HD"),
    INVOICE[1]: ("HIEU", "MAU"),
    INVOICE[2]: ("00",),
    RELEASE_SLIP: ("00",),
    SHIPMENT_ON_PLAN: ("12", "13"),
    **{p: ("DIEU",) for p in TRANSFER_ORDER},
    **dict(zip(ORDER, [("P-",), ("PO",), None, None, ("417",), ("450",), ("WE", "WH"), ("1002",), ("PO", "DAT", "ORDER"), ("ORDER", "ORD")], strict=True)),
}


def _group(text: Column, pattern: str) -> Column:
    got = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    needed = NEEDED.get(pattern)
    return F.when(contains_any(text, *needed), got) if needed else got


def key_fields(text: Column, doc_type: Column, known: dict[str, str] | None = None) -> Column:
    """struct(shipment_id, invoice_no, po_no, transfer_order_no, pxk_no) of a normalised text, each from the first pattern whose match passes its check, and only for types
    that carry it; a null doc_type stands for any. known: misread shipment ids and what they are."""
    transfer = F.coalesce(*(_group(text, p) for p in TRANSFER_ORDER))

    def shipment(p: str) -> Column:
        return bound(repaired_id(_group(text, p), known), lambda got: F.when(got.rlike("^[0-9]{5,}$"), got))

    context = [
        F.when(doc_type == "PXKKVCNB", transfer),
        F.when(doc_type == "HOA_DON", repaired_id(_group(text, SHIPMENT_ON_INVOICE), known)),
        F.when(doc_type == "LOADING_PLAN", repaired_id(_group(text, SHIPMENT_ON_PLAN), known)),
    ]
    ship = F.when(doc_type.isNull() | doc_type.isin("HOA_DON", "LOADING_PLAN", "PXKKVCNB", "LENH_DIEU_XE"), F.coalesce(*map(shipment, SHIPMENT), *context))

    def number(p: str) -> Column:
        return bound(_group(text, p), padded_number)

    def padded_number(got: Column) -> Column:
        got = F.when(got.rlike("^00[0-9]+S$"), F.regexp_replace(got, "S$", "5")).otherwise(got)
        padded = F.when(got.rlike("^0[0-9]{4,6}$"), F.lpad(got, 8, "0")).otherwise(got)
        return F.when(got.rlike("^[0-9]+$") & ~got.rlike("^(19|20)[0-9]{2}") & (F.length(padded) == 8), padded)

    invoice = F.coalesce(*map(number, INVOICE))
    slip = F.when(doc_type == "PXKKVCNB", invoice).when(doc_type == "PHIEU_XUAT_HANG", F.coalesce(_group(text, RELEASE_SLIP), invoice))

    def order(p: str) -> Column:
        return bound(_group(text, p), order_number)

    def order_number(got: Column) -> Column:
        got = F.when(got.rlike("^[0-9]{3}P[0-9]{6,8}$"), F.concat(F.lit("O"), got)).otherwise(got)
        return F.when(got.rlike("[0-9]") & ~got.rlike("[ILHF]{3,}") & ~got.startswith("893") & (F.length(got) >= 4), got)

    po = F.when(doc_type.isNull() | doc_type.isin("PO", "PHIEU_GIAO_HANG", "TABLE_CONTINUATION"), F.coalesce(*map(order, ORDER)))
    return F.struct(ship.alias("shipment_id"), F.when(doc_type == "HOA_DON", invoice).alias("invoice_no"), po.alias("po_no"), transfer.alias("transfer_order_no"), slip.alias("pxk_no"))


def page_role(text: Column, doc_type: Column) -> tuple[Column, Column]:
    """(role, the type to go on with): continued tables belong to orders, plans without a title continue one."""
    continued = (doc_type == "TABLE_CONTINUATION") | ((doc_type == "LOADING_PLAN") & ~contains_any(text, *PLAN_TITLES))
    return F.when(continued, "CONTINUATION").otherwise("HEADER"), F.when(doc_type == "TABLE_CONTINUATION", "PO").otherwise(doc_type)


def rejected(action: Column) -> Column:
    """The fixed record of a page that the gate sent back, else null."""
    empty = F.struct(*(F.lit(None).cast("string").alias(k) for k in ("shipment_id", "invoice_no", "po_no", "transfer_order_no", "pxk_no")))
    fixed = {"doc_type": "UNKNOWN", "system": "COMMON", "form_id": "UNKNOWN_COMMON", "page_role": "HEADER", "confidence": 0.0, "doc_margin": 0.0, "status": "CHUA_DAT", "action": "YEU_CAU_CHUP_LAI"}
    return F.when(action == "YEU_CAU_CHUP_LAI", F.struct(*(F.lit(v).alias(k) for k, v in fixed.items()), empty.alias("key_fields")))


def needs_second_scan(doc_type: Column, fields: Column, system: Column) -> Column:
    """Is a key field that the type should have still missing, or the side of a transfer?"""
    missing = lambda k: fields[k].isNull()
    return F.coalesce(
        ((doc_type == "HOA_DON") & (missing("invoice_no") | missing("shipment_id")))
        | ((doc_type == "PO") & missing("po_no"))
        | (doc_type.isin("LOADING_PLAN", "PXKKVCNB") & missing("shipment_id"))
        | (system == "INTERNAL_TRANSFER"),
        F.lit(False),
    )


def sub_type(text: Column, rules: list[tuple[str, float, list[str]]], default: str, least: int = 90, head: float = 0.35, fuzzy: bool = True) -> Column:
    """struct(subtype, confidence, phrase, match, in_head) of a marker text. rules: (sub-type, points, phrases). Of each rule the first phrase that
    matches counts, with six points more in the head of the text and little more than half of them outside; the first of the best rules wins."""
    head_of = lambda t: F.substring(t, F.lit(1), F.greatest(F.lit(400), F.floor(F.length(t) * head).cast("int")))
    return _once(fuzzy)(text, lambda t: _once(fuzzy)(head_of(t), lambda top: _sub_type(t, top, rules, default, least, fuzzy)))


def _once(fuzzy: bool) -> Callable[[Column, Callable[[Column], Column]], Column]:
    """bound(), but for fuzzy scores, which a lambda cannot hold."""
    return (lambda c, use: use(c)) if fuzzy else bound


def _sub_type(text: Column, top: Column, rules: list[tuple[str, float, list[str]]], default: str, least: int, fuzzy: bool) -> Column:
    def match(phrase: str, where: Column) -> Column:
        near = F.floor(bounded_ratio(phrase, where, least, F.contains(where, F.lit(phrase)))).cast("int") if fuzzy else F.lit(0)
        return F.when(F.contains(where, F.lit(phrase)), 100).otherwise(near)

    def scored(i: int, name: str, points: float) -> Callable[[Column], Column]:
        def told(first: Column) -> Column:
            score = F.when(first["in_head"], F.lit(float(points + 6))).otherwise(F.lit(points * 0.55))
            return F.when(first.isNotNull(), F.struct(score.alias("score"), F.lit(-i).alias("ord"), F.lit(name).alias("subtype"), first["phrase"].alias("phrase"), first["match"].alias("match"), first["in_head"].alias("in_head")))

        return told

    found = []
    for i, (name, points, phrases) in enumerate(rules):
        hit = lambda p: lambda m: F.when(m >= least, F.struct(F.lit(p).alias("phrase"), m.alias("match"), (match(p, top) >= least).alias("in_head")))
        first = F.coalesce(*(_once(fuzzy)(match(p, text), hit(p)) for p in phrases))
        found.append(_once(fuzzy)(first, scored(i, name, points)))

    def told(best: Column) -> Column:
        sure = F.round(F.least(F.when(best["in_head"], 1.0).otherwise(0.6), best["score"] / 106.0), 3)
        return F.struct(F.coalesce(best["subtype"], F.lit(default)).alias("subtype"), F.when(best.isNotNull(), sure).otherwise(0.0).alias("confidence"), best["phrase"].alias("phrase"), best["match"].alias("match"), F.coalesce(best["in_head"], F.lit(False)).alias("in_head"))

    return _once(fuzzy)(F.array_max(F.array_compact(F.array(*found))), told)


def contradicts(subtype: Column, symbol: Column, by_first: dict[str, str]) -> Column:
    """Does the first character of an invoice symbol stand for another sub-type than the print?"""
    implied = F.element_at(F.create_map(*(F.lit(x) for pair in by_first.items() for x in pair)), F.substring(symbol, 1, 1))
    return F.coalesce(implied != subtype, F.lit(False))


def typed_name(line: Column, labels: list[str], least_words: int = 2, least_letters: int = 6, near: float = 80.0, fuzzy: bool = True) -> Column:
    """The words of a line that may be a printed name: no label of the form, not even misread, no digit, words and letters enough; else null."""
    from paperweave.functions.text import plain_upper

    plain = plain_upper(F.trim(line), stroke=True)
    label = contains_any(plain, *labels)
    if fuzzy:
        label = label | (F.greatest(*(bounded_ratio(x, plain, near, label) for x in labels), F.lit(0.0)) >= near)
    words = F.filter(F.split(F.trim(line), "[^A-Za-zÀ-ỹ]+"), lambda w: F.length(w) >= 2)
    enough = (F.size(words) >= least_words) & (F.length(F.array_join(words, "")) >= least_letters)
    return F.when((plain != "") & ~label & ~F.trim(line).rlike("\\d") & enough, F.array_join(words, " "))
