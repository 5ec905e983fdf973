"""Workbooks, dictionaries, claims and appends against plain versions."""

import json
import os
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.sources import dictionaries, lineage, workbooks
from paperweave.streaming import claims


def _letters(i):
    return (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)


def write_book(path, sheets):
    """A made-up workbook: strings shared and inline, numbers, booleans, cells left out."""
    texts = []

    def cell(r, c, v):
        at = f'r="{_letters(c)}{r}"'
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c {at}><v>{v}</v></c>"
        if v.startswith("!"):
            return f'<c {at} t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        if v not in texts:
            texts.append(v)
        return f'<c {at} t="s"><v>{texts.index(v)}</v></c>'

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as book:
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="x{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f"<workbook {main}><sheets>{names}</sheets></workbook>")
        links = "".join(f'<Relationship Id="x{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(cells) if v is not None)}</row>' for r, cells in rows.items())
            book.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>" if rows != {0: []} else "<broken")
        book.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si><r><t>{escape(t[:1])}</t></r><r><t>{escape(t[1:])}</t></r></si>' for t in texts)}</sst>")


GUIDES = {1: ["title"], 3: [None, "Nội bộ", "5.1 Kho", "Phiếu <A>", 2, True, "x", " says ", "'Form 1'!A1"], 4: [None, None, None, "Phiếu B", 1.5, None, None, None, None], 5: [None, None, "5.2", None], 6: [None, "Ngoài", None, "!inline", None, False]}


def test_rows_of_a_workbook(spark, tmp_path):
    write_book(tmp_path / "a.xlsx", {"Guideline": GUIDES, "Other & more": {2: ["x"] * 30, 9: [None] * 27 + [7]}})
    write_book(tmp_path / "b.xlsx", {"Guideline": {3: [None, "T", None, "D"]}, "Broken": {0: []}})
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    (tmp_path / "d.txt").write_bytes(b"ignored")
    rows, warned = workbooks.read_sheets(workbooks.workbook_files(spark, str(tmp_path)))
    told = {(os.path.basename(r["path"]), r["sheet"], r["row"]): r["cells"] for r in rows.collect()}

    def plain(v):
        return None if v is None else str(v).lower() if isinstance(v, bool) else str(v)

    want = {("a.xlsx", "Guideline", n): [plain(v) for v in cells] for n, cells in GUIDES.items()}
    want |= {("a.xlsx", "Other & more", 2): ["x"] * 30, ("a.xlsx", "Other & more", 9): [None] * 27 + ["7"], ("b.xlsx", "Guideline", 3): [None, "T", None, "D"]}

    def bare(cells):
        while cells and cells[-1] is None:
            cells = cells[:-1]
        return cells

    assert {k: bare(v) for k, v in told.items()} == {k: bare(v) for k, v in want.items()}
    assert {(os.path.basename(r["path"]), r["sheet"], r["error"].split(":")[0]) for r in warned.collect()} == {("b.xlsx", "Broken", "UNREADABLE_SHEET"), ("c.xlsx", None, "UNREADABLE_WORKBOOK")}
    some, _ = workbooks.read_sheets(workbooks.workbook_files(spark, str(tmp_path)), F.col("sheet") != "Guideline")
    assert {r["sheet"] for r in some.filter("path like '%a.xlsx'").collect()} == {"Other & more"}


def test_guidelines_are_filled_down(spark, tmp_path):
    write_book(tmp_path / "a.xlsx", {"Guideline": GUIDES, "Form 1": {}})
    rows, _ = workbooks.read_sheets(workbooks.workbook_files(spark, str(tmp_path)))
    told = {r["row"]: r for r in workbooks.guidelines(rows).collect()}
    assert sorted(told) == [3, 4, 6]
    assert [(told[n]["transport_type"], told[n]["order_detail"], told[n]["doc_type"]) for n in (3, 4, 6)] == [("Nội bộ", "5.1 Kho", "Phiếu <A>"), ("Nội bộ", "5.1 Kho", "Phiếu B"), ("Ngoài", "5.2", "!inline")]
    assert told[3]["form_sheet"] == "Form 1" and told[3]["dien_giai"] == "says" and told[4]["form_sheet"] == ""
    assert workbooks.read_sheets(workbooks.workbook_files(spark, str(tmp_path)).limit(0))[0].count() == 0


def test_large_sheets_leave_in_batches(monkeypatch, tmp_path):
    write_book(tmp_path / "a.xlsx", {"S": {n: [n, f"t{n % 7}"] for n in range(1, 300)}})
    content = (tmp_path / "a.xlsx").read_bytes()
    (name, part), *_ = workbooks.sheets_of(content)
    assert name == "S" and list(workbooks.rows_of(content, part)) == [(n, [str(n), f"t{n % 7}"]) for n in range(1, 300)]


RULES = T.StructType([T.StructField("list", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType()))])


def test_unreadable_is_empty_with_a_warning(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"list": "doc_rules", "position": 0, "id": "PO", "keywords": ["order", "đơn"]}]))
    bad.write_text('[{"list": "doc_rules", "position": ')
    rows, warned = dictionaries.read_lenient(spark, str(good), RULES)
    assert rows.count() == 1 and warned.count() == 0 and dictionaries.phrase_rules(rows, "doc_rules") == {"PO": ["order", "đơn"]}
    rows, warned = dictionaries.read_lenient(spark, str(bad), RULES)
    assert rows.count() == 0 and [r["reason"] for r in warned.collect()] == ["MALFORMED_RECORD"]
    rows, warned = dictionaries.read_lenient(spark, str(tmp_path / "none.json"), RULES)
    assert rows.count() == 0 and [r["reason"] for r in warned.collect()] == ["FILE_NOT_FOUND"]
    assert dictionaries.read_lenient(spark, None, RULES)[1].count() == 0


def test_faults_of_a_dictionary(spark):
    rules = spark.createDataFrame([("doc_rules", 0, "A", ["x"]), ("doc_rules", 1, "A", [None]), ("doc_rules", 2, " ", None), ("system_rules", 0, "S", [])], RULES)
    assert {tuple(r) for r in dictionaries.rule_faults(rules).collect()} == {("doc_rules", 0, "ID_REPEATED"), ("doc_rules", 1, "KEYWORD_NULL"), ("doc_rules", 2, "ID_MISSING"), ("doc_rules", 2, "KEYWORDS_MISSING"), ("internal_subtype_markers", None, "LIST_EMPTY")}
    with pytest.raises(ValueError, match="not sound"):
        dictionaries.phrase_rules(rules, "doc_rules")
    labels = spark.createDataFrame([(0, "r", None)], "index int, role string, description string")
    assert {tuple(r) for r in dictionaries.label_faults(labels, ["role", "description"]).collect()} == {("0", "KEY_MISSING:description"), (None, "FEWER_THAN_TWO_COLUMNS")}
    hits = dictionaries.phrase_hits(spark.createDataFrame([(1, "an Order of x"), (2, None), (3, "")], "k long, t string"), spark.createDataFrame([("l", "a", ["ORDER", "of", "zz"]), ("l", "b", ["x", "order"])], "list string, id string, keywords array<string>"), F.col("t"), "k")
    assert {tuple(r) for r in hits.collect()} == {(1, "l", "a", "ORDER"), (1, "l", "a", "of"), (1, "l", "b", "x"), (1, "l", "b", "order")}


class Killed(Exception):
    pass


def _arrive(spark, folder, rows):
    spark.createDataFrame(rows, "job_id long, created_at timestamp_ntz").coalesce(1).write.mode("append").parquet(str(folder))


@pytest.mark.parametrize("moment", ["after the write", "within the write"])
def test_a_killed_stream_claims_nothing_twice(spark, tmp_path, moment, monkeypatch):
    from datetime import datetime

    from paperweave.streaming.attempts import drained

    jobs, ledger, progress = tmp_path / "jobs", str(tmp_path / "ledger"), str(tmp_path / "progress")
    at = datetime(2026, 1, 1)
    _arrive(spark, jobs, [(i, at) for i in range(10)] + [(3, at)])
    schema = spark.read.parquet(str(jobs)).schema
    numbers = []

    def stream():
        return spark.readStream.schema(schema).parquet(str(jobs))

    def dying(batch, number):
        if moment == "after the write":
            claims.claim(batch, number, ledger, 3)
        else:
            batch.select("job_id", F.lit("worker-0").alias("worker"), F.col("created_at").cast("timestamp").alias("created_at")).write.parquet(f"{ledger}/batch={number}")
            os.remove(f"{ledger}/batch={number}/_SUCCESS")
        numbers.append(number)
        raise Killed

    with pytest.raises(Exception, match="Killed"):
        drained(stream(), progress, dying)
    first = {r["job_id"]: tuple(r) for r in claims.ledger(spark, ledger).collect()}
    assert len(first) == (10 if moment == "after the write" else 0)
    told = []
    drained(stream(), progress, lambda batch, number: told.append((number, claims.claim(batch, number, ledger, 3))))
    assert numbers[0] == 0 and told[0] == (0, moment == "within the write")
    _arrive(spark, jobs, [(i, at) for i in range(5, 15)])
    drained(stream(), progress, lambda batch, number: claims.claim(batch, number, ledger, 3))
    rows = claims.ledger(spark, ledger).collect()
    assert sorted(r["job_id"] for r in rows) == list(range(15))
    assert {r["batch"] for r in rows if r["job_id"] >= 10} == {1} and all(tuple(r) == first[r["job_id"]] for r in rows if r["job_id"] in first)
    state = claims.running(claims.ledger(spark, ledger)).collect()
    assert {r["status"] for r in state} == {"RUNNING"} and {r["locked_by"] for r in state} == {"worker-0", "worker-1", "worker-2"}


def test_late_and_repeated_reviews_are_appended_once(spark, tmp_path):
    from datetime import datetime, timedelta

    folder, out, progress = tmp_path / "reviews", str(tmp_path / "out"), str(tmp_path / "progress")
    start = datetime(2026, 1, 1)
    batches = [[(1, 0), (2, 1), (1, 0)], [(3, 60), (2, 1)], [(4, 62), (3, 60), (1, 0)], [(5, 61), (4, 62)]]  # minutes; review 1 comes again long after
    schema = "review_id long, created_at timestamp"
    for rows in batches:
        spark.createDataFrame([(i, start + timedelta(minutes=m)) for i, m in rows], schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(schema).parquet(str(folder))
        claims.append(claims.new_reviews(stream, "120 minutes", "review_id"), out, progress)
    assert sorted(r["review_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5]


def test_tables_are_refused_without_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="shared|share"):
        lineage.shared_folder(Elsewhere)


def test_records_are_cleaned_completed_and_written(spark, tmp_path):
    from paperweave.sources import tables

    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([("B1", "p1", "CHUP_LAI", nan, {"a\u0000": [1.0, inf]}, ("x\u0000y", nan)), ("B1", "p2", "DAT", 1.5, None, None), ("B2", "p3", "CANH_BAO", -inf, {}, ("z", 2.0))], "batch string, page string, status string, n double, m map<string, array<double>>, s struct<t: string, d: double>")
    clean = {r["page"]: r for r in tables.cleaned(rows).collect()}
    assert clean["p1"]["n"] is None and clean["p1"]["m"] == {"a": [1.0, None]} and tuple(clean["p1"]["s"]) == ("xy", None)
    assert clean["p2"]["n"] == 1.5 and clean["p2"]["s"] is None and clean["p3"]["n"] is None
    tables.write_run(rows, str(tmp_path / "run"), "batch", "page")
    assert spark.read.json(str(tmp_path / "run/pages")).count() == 3 and sorted(os.listdir(tmp_path / "run/pages"))[-2:] == ["batch=B1", "batch=B2"]
    assert {(r["page"], r["batch_status"]) for r in spark.read.json(str(tmp_path / "run/manifests")).collect()} == {("p1", "CHUP_LAI"), ("p2", "CHUP_LAI"), ("p3", "CANH_BAO")}
    assert {r["metric"]: r["value"] for r in spark.read.json(str(tmp_path / "run/summary")).collect()} == {"n_pages": 3, "n_batches": 2, "batches_to_retake": 1, "batches:CHUP_LAI": 1, "batches:CANH_BAO": 1}
    one = tables.complete_record(spark.createDataFrame([("f", ["SIDE_CUT", "AREA"])], "file_name string, rejects array<string>"), tables.PAGE_RECORD, "rejects").first()
    assert one["skipped_reason"].endswith("SIDE_CUT | AREA") and "doc_type" in one["skipped_steps"]


def test_benchmark_is_saved(spark, tmp_path):
    from paperweave.operators import benchmark

    pages = spark.createDataFrame([("a", 0, "PO", "HEADER", "COMMON", "PASS", None, None, "P1", None, None), ("b", 1, "PO", None, "INTERNAL_X", "PASS", None, None, None, None, None), ("c", 0, "BB_NO_HANG", "HEADER", "COMMON", "PASS", None, "I", None, None, None)], "file_name string, scan_index int, doc_type string, page_role string, system string, action string, shipment_id string, invoice_no string, po_no string, transfer_order_no string, pxk_no string")
    uploads = spark.createDataFrame([("a", "u"), ("b", "u")], "file_name string, upload_group_id string")
    truth = spark.createDataFrame([("a", "PO", "HEADER", "COMMON", None, None, "P1 ", None, None), ("c", "BB_TRA_HANG", None, None, None, "I", None, None, None), ("zz", "PO", None, None, None, None, None, None, None), ("b", "PO", None, "INTERNAL_Y", None, None, "P1", None, None)], "file_name string, doc_type string, page_role string, system string, shipment_id string, invoice_no string, po_no string, transfer_order_no string, pxk_no string")
    result = benchmark.run(pages, uploads, truth)
    told = {r["metric"]: r["value"] for r in result.report.collect()}
    assert told["total_documents"] == 3 and told["doc_type_accuracy_strict"] == 0.6667 and told["doc_type_accuracy_lenient"] == 1.0
    assert told["system_accuracy"] == 0.6667 and told["system_accuracy_family"] == 1.0 and told["pages_changed_by_voting"] == 1 and told["po_no:exact_match"] == 2
    assert told["pages_without_group"] == 1 and told["multi_page_clusters"] == 1 and told["split:JOINED"] == 1
    benchmark.save(result, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/results")).count() == 3 and spark.read.option("header", True).csv(str(tmp_path / "out/evaluation")).count() == 3
    assert spark.read.json(str(tmp_path / "out/report")).count() == len(told)


def test_converted_prints_and_batch_keys(spark):
    from paperweave.operators import records
    from paperweave.sources import tables

    rows = spark.createDataFrame([("Hóa đơn chuyển đổi từ hóa đơn điện tử",), ("HOA DON CHUYEN D0I TU HOA DON DIEN TU",), ("plain",), (None,)], "t string")
    told = [r[0] for r in rows.select(records.converted(F.col("t"), ["CHUYEN DOI TU HOA DON DIEN TU"])).collect()]
    assert told == ["CHUYEN DOI TU HOA DON DIEN TU"] * 2 + [None, None]
    paths = spark.createDataFrame([("/x/y/a__b__c.png",), ("/x/y/a.b.png",)], "p string")
    assert [tuple(r) for r in paths.select(tables.batch_key(F.col("p")), tables.batch_key(F.col("p"), "prefix"), tables.batch_key(F.col("p"), "single")).collect()] == [("y", "a", "BATCH"), ("y", "a.b", "BATCH")]
    with pytest.raises(ValueError, match="folder"):
        tables.batch_key(F.col("p"), "other")


def test_state_of_idle_accounts_goes(spark, tmp_path):
    from datetime import datetime, timedelta

    from paperweave.streaming.attempts import stateful_lockout

    start, folder = datetime(2026, 1, 1), str(tmp_path / "events")
    schema = "event_id long, user_id long, ts timestamp, kind string"
    told, kept = [], []
    for n, (day, users) in enumerate([(0, range(20)), (1, range(20)), (400, range(3)), (401, range(3))]):
        spark.createDataFrame([(100 * n + u, u, start + timedelta(days=day), "FAIL") for u in users], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = stateful_lockout(spark.readStream.schema(schema).parquet(folder), "user_id", 5 * 86400, 86400, 2, "2 days")
        query = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "progress")).foreachBatch(lambda batch, _: told.extend(batch.collect())).start()
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert kept[1] == 20 and kept[-1] == 3
    by_event = {r["event_id"]: (r["n_fails"], r["locked_until_sec"] is not None) for r in told}
    assert len(by_event) == 46 and by_event[5] == (1, False) and by_event[105] == (2, True) and by_event[202] == (1, False) and by_event[302] == (2, True)


def test_attempts_judged_in_one_pass():
    import random
    import time

    from paperweave.streaming.attempts import judged

    def plain(rows, fails, reset):
        out, fails = [], list(fails)
        for sec in sorted({r[0] for r in rows}):
            same = [r for r in rows if r[0] == sec]
            if any(r[2] in ("SUCCESS", "RESET") for r in same):
                reset, fails = max(reset, sec), [f for f in fails if f > sec]
            elif sec > reset:
                fails += [sec for r in same if r[2] == "FAIL"]
            fails = [f for f in fails if f >= sec - 9]
            recent = [f for f in fails if f <= sec]
            out += [(r[1], len(recent), max(recent) + 5 if len(recent) >= 3 else None) for r in same]
        return sorted(out), (sorted(fails), reset)

    draw = random.Random(8)
    for _ in range(200):
        ours = theirs = ([], -1)
        for batch in range(3):  # later batches may hold earlier times
            rows = [(draw.randrange(40), 100 * batch + i, draw.choice(["FAIL", "FAIL", "FAIL", "LOCKED", "SUCCESS", "RESET"] if draw.random() < 0.3 else ["FAIL", "LOCKED"])) for i in range(draw.randrange(1, 25))]
            told, ours = judged(*map(list, zip(*rows)), *ours, 9, 5, 3)
            expected, theirs = plain(rows, *theirs)
            assert sorted(told) == expected and (sorted(ours[0]), ours[1]) == theirs
    began = time.perf_counter()
    n = 100_000
    told, (fails, _) = judged(list(range(n)), list(range(n)), ["FAIL"] * n, [], -1, n, 5, 3)
    assert told[-1] == (n - 1, n, n + 4) and len(fails) == n and time.perf_counter() - began < 20


def test_tables_with_a_byte_order_mark(spark, tmp_path):
    import glob

    from paperweave.sources import tables

    tables.write_table(spark.createDataFrame([("é", ["a", "b"])], "name string, list array<string>").coalesce(1), str(tmp_path / "t"), mark=True)
    (part,) = glob.glob(str(tmp_path / "t/*.csv"))
    with open(part, "rb") as f:
        assert f.read() == "﻿name,list\né,a;b\n".encode()


def test_form_values_outside_the_vocabulary_are_errors(spark):
    from paperweave.functions.text import truth_or_error

    rows = spark.createDataFrame([(" Yes",), ("off",), ("",), (None,)], "v string")
    assert [r[0] for r in rows.select(truth_or_error(F.col("v"))).collect()] == [True, False, False, None]
    with pytest.raises(Exception, match="no boolean: maybe"):
        spark.createDataFrame([("maybe",)], "v string").select(truth_or_error(F.col("v"))).collect()
