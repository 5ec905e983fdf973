"""Queries on decided pages, with their SQL: documents as recognised pages that begin with a line of a form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.functions import text as tx
from paperweave.operators import decisions
from paperweave.plans.fixtures import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LINES = [
    "Phiếu xuất kho kiêm vận chuyển nội bộ số 0001234S Căn cứ lệnh điều động: 20250612345 CLK",
    "HÓA ĐƠN GIÁ TRỊ GIA TĂNG Số hóa đơn: 0123456 khách hàng: Công ty TNHH Shipment ID: I34567",
    "Đơn đặt hàng P-000105230 GS25",
    "LOADING PLAN SO CHUYEN 1234567 kho nội bộ Bắc Ninh",
    "Số khối 12 xe chạy 121234",
    "Biên bản đổi, trả hàng",
    "Áp dụng cho các trường hợp nợ hàng",
    "Phiếu giao hàng O343P1071694 co.op",
    "Mã vạch 8931234 đơn giá 5000 trang",
    "Nhiệt độ -18.5 dừng xe",
    "Giao hàng kèm theo hóa đơn GTGT",
    "Phiếu xuất hàng 120000005 ANPHA",
    "Store order AEON Việt Nam 10021234567890",
    "Hóa đơn GTGT giao hàng 131234 mẫu số 1C25 doanh nghiệp",
    "Lệnh điều xe 55555 nội bộ",
    "PO: 893123456 ORDER NO 2506260100600123 kho thuê kho nội bộ",
    "Đề xuất thu hồi",
    "",
]
_case = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LINES))
#: Pages: a line of a form, then the whole text.
SCANNED = f"SELECT doc_id, concat(CASE doc_id % {len(LINES)} {_case} END, ' . ', text) AS text FROM documents"

RULES = [
    ("LENH_DIEU_XE", ["LENH DIEU XE", "XE LANH"]),
    ("BB_THU_HOI", ["DE XUAT THU HOI", "THU HOI"]),
    ("BB_TRA_HANG", ["BIEN BAN DOI, TRA", "DOI TRA HANG"]),
    ("PHIEU_XUAT_HANG", ["PHIEU XUAT HANG"]),
    ("PHIEU_GIAO_HANG", ["PHIEU GIAO HANG", "PHIEU GIAO"]),
    ("LOADING_PLAN", ["LOADING PLAN", "LOADING"]),
    ("PO", ["DON DAT HANG", "STORE ORDER"]),
    ("HOA_DON", ["HOA DON GIA TRI GIA TANG", "HOA DON GTGT", "SO HOA DON"]),
]
SYSTEMS = [("MT_COOP", ["CO.OP"]), ("MT_GS25", ["GS25", "GS 25"]), ("INTERNAL_TRANSFER", ["DIEU DONG", "NOI BO"]), ("GT", ["NHA PHAN PHOI", "NPP"])]
SIDES = [("INTERNAL_KHO_THUE", ["KHO THUE", "ANPHA", "CLK"]), ("INTERNAL_KHO_NOIBO", ["KHO NOI BO", "BAC NINH"])]

_plain = "upper(replace(strip_accents(coalesce({}, '')), 'ß', 'ss'))"
_norm = "trim(regexp_replace(regexp_replace(replace(" + _plain + ", 'Đ', 'D'), '[^A-Z0-9\\s:/._#-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.lit("")
    for i, x in enumerate(LINES):
        line = F.when(F.col("doc_id") % len(LINES) == i, F.lit(x)).otherwise(line)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(line, F.lit(" . "), "text").alias("text"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(spark, sf_dir).select("doc_id", tx.normalized(F.col("text")).alias("t"))
    return decisions.decided(rows, "t", RULES, SYSTEMS, SIDES, fuzzy=False).withColumnRenamed("kind", "k")


def _values(rules: list[tuple[str, list[str]]]) -> str:
    return ", ".join(f"({i}, {j}, '{name}', '{p}', {1 + min(len(p) / 100, 0.1)})" for i, (name, phrases) in enumerate(rules) for j, p in enumerate(phrases))


def _any(column: str, *phrases: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


_D = f"""p AS ({SCANNED}), d AS (SELECT doc_id, {_norm.format('text')} AS t FROM p),
c AS (SELECT doc_id, t, regexp_replace(t, '(KEM\\s*THEO|GIAO\\s*HANG\\s*KEM\\s*THEO)[^.\\n]{{0,40}}HOA\\s*DON\\s*GTGT', '', 'g') AS clean FROM d),
dict(i, j, type, phrase, raw) AS (VALUES {_values(RULES)}),
hit AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY raw DESC, j) AS k FROM c JOIN dict ON contains(clean, phrase)),
cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY least(raw, 1.0) DESC, length(phrase) DESC, i) AS place FROM hit WHERE k = 1),
top AS (SELECT doc_id, type, phrase, least(raw, 1.0) AS score FROM cand WHERE place = 1),
rival AS (SELECT x.doc_id, max(least(x.raw, 1.0)) AS score FROM cand x JOIN top USING (doc_id) WHERE place > 1 AND NOT contains(top.phrase, x.phrase) GROUP BY 1),
k AS (SELECT d.doc_id, d.t, CASE
  WHEN {_any('t', 'XUAT KHO KIEM VAN CHUYEN', 'PXKKVCNB', 'KIEM VAN CHUYEN NOI BO', 'PHIEU XUAT KHO KIEM')} THEN {{'a': 'PXKKVCNB', 'b': 1.0, 'c': 0.4, 'd': 'PHIEU XUAT KHO KIEM VAN CHUYEN NOI BO'}}
  WHEN NOT {_any('t', 'DON DAT HANG', 'PURCHASE ORDER', 'STORE ORDER', 'BON DAT HANG', 'QUY CACH DAT HANG')} AND (contains(t, 'TRANG 2') OR contains(t, 'MA VACH') AND contains(t, 'DON GIA') OR contains(t, 'BARCODE') AND contains(t, 'DON GIA')
    OR contains(t, 'LAYOUT') AND contains(t, 'STT') AND NOT contains(t, 'PO') OR {_any('t', 'MA SAN PHAM', 'MA SP')} AND contains(t, 'KEM') AND NOT contains(t, 'HOA DON GIA TRI GIA TANG')) THEN {{'a': 'TABLE_CONTINUATION', 'b': 0.9, 'c': 0.4, 'd': 'Bang hang hoa (Trang tiep)'}}
  WHEN {_any('t', 'TRUONG HOP NO HANG', 'TRUONG HOP NO HONG', 'AP DUNG CHO CAC TRUONG HOP NO', 'AP DUNG CHO COC TRUONG HOP NO')} THEN {{'a': 'BB_NO_HANG', 'b': 1.0, 'c': 0.4, 'd': 'BIEN BAN NO HANG'}}
  WHEN top.type IS NOT NULL THEN {{'a': top.type, 'b': top.score, 'c': round(top.score - coalesce(rival.score, 0), 2), 'd': top.phrase}}
  WHEN regexp_matches(t, '-[0-9]{{1,2}}\\.[0-9]') OR {_any('t', 'DUNG XE', 'XE DANG CHAY', 'DATALOGGER')} THEN {{'a': 'BIEU_DO_NHIET_DO', 'b': 0.9, 'c': 0.3, 'd': 'GPS/Datalogger log'}}
  WHEN contains(t, 'PALLET') AND contains(t, 'SO KG') OR {_any('t', 'SO KHOI', 'TRUONG BP KHO')} THEN {{'a': 'LOADING_PLAN', 'b': 0.85, 'c': 0.25, 'd': 'Loading plan totals'}}
  WHEN {_any('t', 'PHIEU GIAO HANG', 'PGH', 'PHIEU GIAO NHAN', 'BIEN NHAN HANG', 'GOLD COAST')} THEN {{'a': 'PHIEU_GIAO_HANG', 'b': 0.85, 'c': 0.25, 'd': 'Phieu giao hang'}}
  WHEN {_any('t', 'LENH DIEU XE', 'LENH DIEU DONG XE', 'DIEU DONG XE', 'XE LANH')} THEN {{'a': 'LENH_DIEU_XE', 'b': 0.85, 'c': 0.25, 'd': 'Lenh dieu xe'}}
  WHEN {_any('t', 'BON DAT HANG', 'STORE ORDER', 'GS25', 'PURCHASE ORDER', 'QUY CACH DAT HANG')} THEN {{'a': 'PO', 'b': 0.85, 'c': 0.25, 'd': 'Don dat hang sieu thi'}}
  WHEN {_any('t', 'DOI TRA', 'DOI, TRA')} THEN {{'a': 'BB_TRA_HANG', 'b': 0.85, 'c': 0.25, 'd': 'Bien ban doi tra'}}
  WHEN {_any('t', 'NO HANG', 'BIEN BAN NO', 'TRUONG HOP NO')} THEN {{'a': 'BB_NO_HANG', 'b': 0.85, 'c': 0.25, 'd': 'Bien ban no hang'}}
  WHEN {_any('t', 'MA SAN PHAM', 'BARCODE', 'DON GIA')} THEN {{'a': 'TABLE_CONTINUATION', 'b': 0.75, 'c': 0.2, 'd': 'Bang hang hoa phu'}}
  ELSE {{'a': 'UNKNOWN', 'b': 0.0, 'c': 0.0, 'd': ''}} END AS k FROM d LEFT JOIN top USING (doc_id) LEFT JOIN rival USING (doc_id)),
kinds AS (SELECT doc_id, t, k.a AS doc_type, CAST(k.b AS DOUBLE) AS score, CAST(k.c AS DOUBLE) AS margin, k.d AS phrase FROM k)"""


@query(f"WITH {_D} SELECT doc_id, doc_type, score, margin, phrase FROM kinds")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("doc_id", "k.*")


def _side_sql() -> str:
    hits = [f"CASE {' '.join(f'WHEN regexp_matches(t, {chr(39)}{chr(92)}b{m}{chr(92)}b{chr(39)}) THEN {chr(39)}{m}{chr(39)}' for m in ms)} END" for _, ms in SIDES]
    return f"side AS (SELECT *, {hits[0]} AS h0, {hits[1]} AS h1 FROM kinds), sided AS (SELECT *, CASE WHEN h0 IS NOT NULL AND h1 IS NULL THEN '{SIDES[0][0]}' WHEN h1 IS NOT NULL AND h0 IS NULL THEN '{SIDES[1][0]}' ELSE 'INTERNAL_TRANSFER' END AS side, CASE WHEN h0 IS NULL OR h1 IS NULL THEN coalesce(h0, h1, '') ELSE '' END AS marker FROM side)"


_CHANNEL = f"""{_D}, {_side_sql()}, sdict(i, j, sys, kw, raw) AS (VALUES {_values(SYSTEMS)}),
shit AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY raw DESC, j) AS n FROM sided JOIN sdict ON contains(t, kw)),
stop AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY least(raw, 1.0) DESC, length(kw) DESC, i) AS place FROM shit WHERE n = 1),
ch AS (SELECT s.doc_id, s.t, s.doc_type, CASE
  WHEN s.doc_type IN ('LENH_DIEU_XE', 'BIEU_DO_NHIET_DO', 'BBBG_PALLET', 'BIEN_BAN_NO_HANG', 'BIEN_BAN_TRA_HANG', 'BB_NO_HANG', 'BB_TRA_HANG') THEN {{'a': 'COMMON', 'b': 1.0, 'c': 'FORM_DEFAULT_' || s.doc_type}}
  WHEN s.doc_type = 'PHIEU_XUAT_HANG' THEN {{'a': s.side, 'b': 1.0, 'c': 'SOP_PHIEU_XUAT_HANG' || CASE WHEN s.marker <> '' THEN '|SUB:' || s.marker ELSE '' END}}
  WHEN s.doc_type = 'BB_THU_HOI' THEN {{'a': 'GT', 'b': 1.0, 'c': 'SOP_THU_HOI_TU_NPP'}}
  WHEN regexp_matches(s.t, '\\bAEON\\b') THEN {{'a': 'MT_AEON', 'b': 1.0, 'c': 'AEON'}}
  WHEN stop.sys = 'INTERNAL_TRANSFER' AND s.marker <> '' THEN {{'a': s.side, 'b': 1.0, 'c': kw || '|SUB:' || s.marker}}
  WHEN stop.sys IS NOT NULL THEN {{'a': stop.sys, 'b': 1.0, 'c': kw}}
  WHEN s.doc_type = 'HOA_DON' AND {_any('s.t', 'CONG TY', 'TNHH', 'DOANH NGHIEP', 'DNTN', 'KHACH HANG', 'KHACH HING')} THEN {{'a': 'GT', 'b': 0.85, 'c': 'HOA_DON_DOANH_NGHIEP_GT'}}
  ELSE {{'a': 'COMMON', 'b': 0.8, 'c': ''}} END AS ch FROM sided s LEFT JOIN stop ON stop.doc_id = s.doc_id AND stop.place = 1)"""


@query(f"WITH {_CHANNEL} SELECT doc_id, ch.a AS system, CAST(ch.b AS DOUBLE) AS score, ch.c AS phrase FROM ch")
def page_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("doc_id", "channel.*")


MISREAD = {"55555": "55558"}


def _re(pattern: str) -> str:
    return f"nullif(regexp_extract(t, '{pattern}', 1), '')"


def _fields_sql() -> str:
    t1, t2 = map(_re, ("(?:LENH\\s*DIEU\\s*DONG|DIEU\\s*DONG\\s*SO|CAN\\s*CU\\s*LENH\\s*DIEU\\s*DONG)[\\s:_#-]*([0-9]{10,16})", "(?:DIEU\\s*DONG)[^0-9\\n]{0,20}([0-9]{10,16})"))
    raw = {
        "s1": _re("(?:SHIPMENT(?:\\s*(?:ID|NO|SO|:))?|SHIPMES|STIPMEEN|STIPM|SMPMENL|SMPMEN|SHP(?:MENT|MEN)?|SO\\s*CHUYEN|MA\\s*CHUYEN|CHUYEN\\s*XE)[\\s:_#\\-\\._]*([0-9A-Z]{5,10})"),
        "s2": _re("(?:LENH\\s*DIEU\\s*DONG|LENH\\s*DIEU\\s*XE)[\\s:_#\\-\\._]*([0-9]{5,10})"),
        "s3": _re("(?:GIAO\\s*HANG|XUAT\\s*KHO|SAP|REF|CHUYEN|VAN\\s*DON|SHP|SMPMEN|SHIPMENT|LENH)[^0-9\\n]{0,25}\\b(1[123][0-9]{4,5}|21001[0-9]{5})\\b"),
        "s4": _re("\\b(12[0-9]{4}|13[0-9]{4})\\b"),
        "i1": _re("(?:HOA\\s*DON|SO\\s*HOA\\s*DON|SO\\s*HD)[\\s:_#-]*([0-9A-Z]{5,9})"),
        "i2": _re("(?:KY\\s*HIEU|MAU\\s*SO)[^0-9]*([0-9A-Z]{5,9})"),
        "i3": _re("\\b(00[0-9A-Z]{4,7})\\b"),
        "slip": _re("[0-9]{0,2}(00[0-9]{5})"),
    }
    orders = ["\\b(P-[0-9]{8,10})\\b", "\\b([0-9]{5}PO[0-9]{9,12})\\b", "(?:POM|OM|O)?([0-9]{3}P[0-9]{6,8})\\b", "([0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{10})", "\\b(417[0-9]{7})\\b", "\\b(450[0-9]{7})\\b", "\\b(W[EH][0-9]{10,18})\\b", "\\b(1002[0-9]{10})\\b", "\\b(?:PO|DON\\s*DAT\\s*HANG|ORDER(?:\\s*NO)?)\\b[\\s:_#-]*([0-9A-Z_-]{4,20})", "\\b(?:STORE\\s*ORDER|ORD\\s*SHEET)\\b[\\s:_#-]*([0-9A-Z_-]{4,20})"]
    raw |= {f"o{i}": _re(p) for i, p in enumerate(orders)}
    fixed = lambda x: f"CASE {x} WHEN '55555' THEN '55558' ELSE {x} END"
    one = lambda x: fixed(f"(CASE WHEN regexp_full_match({x}, '[IL][0-9]+') THEN '1' || substr({x}, 2) ELSE {x} END)")
    ship = lambda x: f"CASE WHEN regexp_full_match({one(x)}, '[0-9]{{5,}}') THEN {one(x)} END"
    five = lambda x: f"(CASE WHEN regexp_full_match({x}, '00[0-9]+S') THEN left({x}, length({x}) - 1) || '5' ELSE {x} END)"
    number = lambda x: f"CASE WHEN regexp_full_match({five(x)}, '[0-9]+') AND NOT regexp_matches({five(x)}, '^(19|20)[0-9]{{2}}') THEN CASE WHEN length({five(x)}) = 8 THEN {five(x)} WHEN length({five(x)}) BETWEEN 5 AND 7 AND starts_with({five(x)}, '0') THEN lpad({five(x)}, 8, '0') END END"
    coop = lambda x: f"(CASE WHEN regexp_full_match({x}, '[0-9]{{3}}P[0-9]{{6,8}}') THEN 'O' || {x} ELSE {x} END)"
    order = lambda x: f"CASE WHEN regexp_matches({coop(x)}, '[0-9]') AND NOT regexp_matches({coop(x)}, '[ILHF]{{3,}}') AND NOT starts_with({coop(x)}, '893') AND length({coop(x)}) >= 4 THEN {coop(x)} END"
    return f"""{_D}, m AS (SELECT doc_id, doc_type, coalesce({t1}, {t2}) AS transfer_order_no, {", ".join(f"{v} AS {k}" for k, v in raw.items())} FROM kinds),
n AS (SELECT *, coalesce({", ".join(number(x) for x in ("i1", "i2", "i3"))}) AS inv FROM m),
fields AS (SELECT doc_id, CASE WHEN doc_type IN ('HOA_DON', 'LOADING_PLAN', 'PXKKVCNB', 'LENH_DIEU_XE') THEN coalesce({ship("s1")}, {ship("s2")}, CASE doc_type WHEN 'PXKKVCNB' THEN transfer_order_no WHEN 'HOA_DON' THEN {one("s3")} WHEN 'LOADING_PLAN' THEN {one("s4")} END) END AS shipment_id,
  CASE WHEN doc_type = 'HOA_DON' THEN inv END AS invoice_no, CASE WHEN doc_type IN ('PO', 'PHIEU_GIAO_HANG', 'TABLE_CONTINUATION') THEN coalesce({", ".join(order(f"o{i}") for i in range(len(orders)))}) END AS po_no,
  transfer_order_no, CASE doc_type WHEN 'PXKKVCNB' THEN inv WHEN 'PHIEU_XUAT_HANG' THEN coalesce(slip, inv) END AS pxk_no FROM n)"""


_FIELDS = _fields_sql()


@query(f"WITH {_FIELDS} SELECT * FROM fields")
def page_key_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("doc_id", decisions.key_fields(F.col("t"), F.col("k.doc_type"), MISREAD).alias("f")).select("doc_id", "f.*")


@query(f"""WITH {_FIELDS}, {_CHANNEL.split(", ", 1)[0] and _CHANNEL[len(_D) + 2:]},
r AS (SELECT ch.doc_id, ch.doc_type, ch.ch.a AS system, ch.doc_type = 'TABLE_CONTINUATION' OR ch.doc_type = 'LOADING_PLAN' AND NOT {_any('t', 'LOADING PLAN', 'BANG KE GIAO HANG', 'LE NH XUAT HANG', 'LENH XUAT HANG')} AS cont, f.* EXCLUDE (doc_id) FROM ch JOIN fields f USING (doc_id))
SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'HEADER' WHEN cont THEN 'CONTINUATION' ELSE 'HEADER' END AS page_role, CASE WHEN doc_id % 13 = 0 THEN 'UNKNOWN' WHEN doc_type = 'TABLE_CONTINUATION' THEN 'PO' ELSE doc_type END AS doc_type,
  CASE WHEN doc_id % 13 = 0 THEN 'YEU_CAU_CHUP_LAI' END AS action,
  doc_id % 13 > 0 AND (doc_type = 'HOA_DON' AND (invoice_no IS NULL OR shipment_id IS NULL) OR doc_type IN ('PO', 'TABLE_CONTINUATION') AND po_no IS NULL OR doc_type IN ('LOADING_PLAN', 'PXKKVCNB') AND shipment_id IS NULL OR system = 'INTERNAL_TRANSFER') AS second_scan FROM r""")
def page_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided(spark, sf_dir).select("doc_id", "t", F.col("k.doc_type").alias("kind"), F.col("channel").alias("c"))
    rows = rows.withColumn("f", decisions.key_fields(F.col("t"), F.col("kind"), MISREAD))
    role, doc_type = decisions.page_role(F.col("t"), F.col("kind"))
    back = decisions.rejected(F.when(F.col("doc_id") % 13 == 0, "YEU_CAU_CHUP_LAI").otherwise("PASS"))
    scan = decisions.needs_second_scan(doc_type, F.col("f"), F.col("c.system"))
    return rows.select("doc_id", F.coalesce(back["page_role"], role).alias("page_role"), F.coalesce(back["doc_type"], doc_type).alias("doc_type"), back["action"].alias("action"), (back.isNull() & scan).alias("second_scan"))


SUBTYPES = [("BAN_HANG", 80.0, ["HÓA ĐƠN BÁN HÀNG", "LICENSED UNDER"]), ("GTGT", 100.0, ["HOA DON GIA TRI GIA TANG", "HOA DON GTGT", "GTGT"]), ("TOKEN", 100.0, ["TOKEN", "PASSWORD"])]
_marker = "trim(regexp_replace(upper(replace(strip_accents(replace(replace(coalesce({}, ''), 'đ', 'd'), 'Đ', 'D')), 'ß', 'ss')), '\\s+', ' ', 'g'))"


@query(f"""WITH p AS ({SCANNED}), m AS (SELECT doc_id, trim(regexp_replace({_marker.format('text')}, '[\\x1c-\\x1f\\x85\\xa0]+', ' ', 'g')) AS t FROM p),
dict(i, j, name, points, phrase) AS (VALUES {", ".join(f"({i}, {j}, '{n}', {pts}, '{ph}')" for i, (n, pts, phs) in enumerate(SUBTYPES) for j, ph in enumerate(phs))}),
hit AS (SELECT *, contains(left(t, greatest(400, CAST(floor(length(t) * 0.35) AS INT))), phrase) AS in_head, row_number() OVER (PARTITION BY doc_id, i ORDER BY j) AS n FROM m JOIN dict ON contains(t, phrase)),
best AS (SELECT doc_id, name, phrase, in_head, CASE WHEN in_head THEN points + 6 ELSE points * 0.55 END AS score, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN in_head THEN points + 6 ELSE points * 0.55 END DESC, i) AS place FROM hit WHERE n = 1)
SELECT m.doc_id, coalesce(name, 'KHAC') AS subtype, CAST(CASE WHEN name IS NULL THEN 0 ELSE round(least(CASE WHEN in_head THEN 1.0 ELSE 0.6 END, score / 106.0), 3) END AS DOUBLE) AS confidence, phrase, coalesce(in_head, false) AS in_head, coalesce(CASE doc_id % 3 WHEN 0 THEN 'GTGT' WHEN 1 THEN 'BAN_HANG' END <> coalesce(name, 'KHAC'), false) AS contradiction FROM m LEFT JOIN best ON best.doc_id = m.doc_id AND place = 1""".replace("doc_id % 3 WHEN", "m.doc_id % 3 WHEN"))
def invoice_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(spark, sf_dir).select("doc_id", decisions.sub_type(tx.marker(F.col("text")), SUBTYPES, "KHAC", fuzzy=False).alias("s"))
    symbol = F.when(F.col("doc_id") % 3 == 0, "1C25TAA").when(F.col("doc_id") % 3 == 1, "2K25TAA").otherwise("9C25TAA")
    wrong = decisions.contradicts(F.col("s.subtype"), symbol, {"1": "GTGT", "2": "BAN_HANG"})
    return rows.select("doc_id", "s.subtype", "s.confidence", "s.phrase", "s.in_head", wrong.alias("contradiction"))


LABELS = ["QUY DOI", "CLERK", "SIGNATURE"]


@query(f"""WITH x AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Nguyễn Văn  An' WHEN 1 THEN 'Quy đổi: thùng' WHEN 2 THEN 'ab cd' WHEN 3 THEN c_name ELSE c_mktsegment || ' of Clerks' END AS line FROM customer),
w AS (SELECT *, list_filter(regexp_split_to_array(trim(line), '[^A-Za-zÀ-ỹ]+'), lambda p: length(p) >= 2) AS words FROM x)
SELECT c_custkey, CASE WHEN NOT {_any("upper(strip_accents(replace(replace(line, 'đ', 'd'), 'Đ', 'D')))", *LABELS)} AND NOT regexp_matches(line, '[0-9]') AND len(words) >= 2 AND length(array_to_string(words, '')) >= 6 THEN array_to_string(words, ' ') END AS name FROM w""")
def typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    line = F.when(k == 0, "Nguyễn Văn  An").when(k == 1, "Quy đổi: thùng").when(k == 2, "ab cd").when(k == 3, F.col("c_name")).otherwise(F.concat("c_mktsegment", F.lit(" of Clerks")))
    return table(spark, sf_dir, "customer").select("c_custkey", decisions.typed_name(line, LABELS, fuzzy=False).alias("name"))


@query(f"""WITH p AS ({SCANNED}) SELECT doc_id, md5({_plain.format("replace(replace(text, 'đ', 'd'), 'Đ', 'D')")}) AS upper_digest, md5({_plain.format("text")}) AS kept_stroke, md5(regexp_replace({_plain.format("text")}, '[^A-Z0-9\\s]', ' ', 'g')) AS orientation FROM p""")
def marker_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return scanned(spark, sf_dir).select("doc_id", F.md5(tx.plain_upper(t, stroke=True)).alias("upper_digest"), F.md5(tx.plain_upper(t)).alias("kept_stroke"), F.md5(tx.orientation_text(t)).alias("orientation"))
