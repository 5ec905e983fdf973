"""Branches, recomputation after review, comparison of versions, labels and containment against plain versions."""

import itertools
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from paperweave.operators import compare, containment, measure, policy, review, stitching, verdict, views
from paperweave.plans import policy_queries

TARGET = "page_id long, target string, role string, required boolean, detected boolean, review_required boolean"


def _targets(spark, rows):
    return spark.createDataFrame(rows, TARGET)


def test_each_page_is_in_one_branch_and_counts_are_observed(spark):
    pages = spark.createDataFrame(
        [(1, "HOA_DON", "a", True, "OK", True, "X"), (2, "PO", None, True, "OK", True, "X"), (3, "LP", None, True, "OK", True, "X"), (4, "LP", "a", False, "OK", True, "X"), (5, "FORM", "a", True, "OK", True, None), (6, "LP", "a", True, "PAGE_1_NO_SIGNATURES", True, "X"), (7, "LP", "a", True, "OK", True, "X"), (8, "LP", "a", True, "OK", False, "X"), (9, None, "a", True, "OK", False, None)],
        "page_id long, doc_type string, image string, readable boolean, zone_status string, is_color boolean, channel string",
    )
    targets = _targets(spark, [(5, "0", "r", True, True, False), (8, "0", "r", True, True, False), (8, "1", "s", False, False, False), (6, "0", "r", True, True, False), (1, "0", "r", True, True, False)])
    way = review.routed(pages, targets, ["LP"], ["FORM"])
    told = {r["page_id"]: (r["branch"], r["doc_status"], r["action"]) for r in review.page_verdicts(way, targets).collect()}
    assert way.counts == {"OUT_OF_SCOPE": 3, "UNREADABLE": 2, "FORM": 1, "FIRST_PAGE": 1, "NO_ZONE": 1, "SIGNATURES": 1} and len(told) == 9
    assert told[1] == ("OUT_OF_SCOPE", "CHUA_CHUAN_HOA_VUNG_KY", "ABSTAIN") and told[3] == told[4] == ("UNREADABLE", "LOI_DOC_ANH", "ABSTAIN")
    assert told[5] == ("FORM", "DAT_CHUAN_GOC", "DUYET") and told[6] == ("FIRST_PAGE", "TRANG_1_CHUA_KY", "HOP_LE")
    assert told[7][0] == "NO_ZONE" and told[8] == ("SIGNATURES", "DAT_CHUAN_PHOTO", "DUYET")
    none = review.routed(pages.filter("page_id = 1"), targets, ["LP"], ["FORM"])
    assert none.counts["SIGNATURES"] == 0 and "Aggregate" not in review.page_verdicts(none, targets)._jdf.queryExecution().optimizedPlan().toString()
    assert review.page_verdicts(review.routed(pages.limit(0), targets, ["LP"], ["FORM"]), targets).count() == 0


def _reviewed(spark, n=60):
    draw = random.Random(6)
    members = [(d, p) for d in range(n // 3) for p in range(3 * d, 3 * d + 3)]
    pages = spark.createDataFrame([(p, "A", "OK", p % 2 == 0) for p in range(n)], "page_id long, channel string, zone_status string, is_color boolean")
    targets = _targets(spark, [(p, r, r, True, draw.random() < 0.5, draw.random() < 0.2) for p in range(n) for r in ("r1", "r2")])
    roles = spark.createDataFrame([("A", "r1"), ("A", "r2"), ("UNRESOLVED", "r1"), ("UNRESOLVED", "r2")], "channel string, role string")
    return spark.createDataFrame(members, "dossier_id long, page_id long"), pages, targets, roles


def test_only_touched_dossiers_are_judged_again(spark):
    members, pages, targets, roles = _reviewed(spark)
    machine = verdict.dossier_verdict(members, pages, targets, roles)
    before = {r["dossier_id"]: tuple(r) for r in machine.collect()}
    reviews = spark.createDataFrame(
        [(4, "r1", 1, 10, "r1", "SIGNED"), (4, "r1", 2, 20, "r1", "NOT_SIGNED"), (7, "r2", 3, 5, "other", "SIGNED"), (13, "r1", 4, 5, "r1", "UNCLEAR"), (99, "r1", 5, 5, "r1", "SIGNED")],
        "page_id long, target string, review_id long, created_at long, role string, decision string",
    )
    effective = review.applied_reviews(targets, reviews, "page_id", "target")
    assert {r["page_id"] for r in review.touched(effective, "page_id").collect()} == {4, 13}  # a review of another role, or of no page, is none
    after = {r["dossier_id"]: tuple(r) for r in review.dossiers_after_review(machine, members, pages, effective, roles).collect()}
    whole = {r["dossier_id"]: tuple(r) for r in verdict.dossier_verdict(members, pages, effective, roles).collect()}
    for d, row in after.items():
        assert row == ((*whole[d], "AFTER_REVIEW") if d in (1, 4) else (*before[d], "MACHINE"))
    # the others keep the machine's row even where that is not what would be computed now
    marked = machine.withColumn("doc_status", F.concat(F.lit("old "), "doc_status"))
    kept = {r["dossier_id"]: r["doc_status"] for r in review.dossiers_after_review(marked, members, pages, effective, roles).collect()}
    assert all(s.startswith("old ") == (d not in (1, 4)) for d, s in kept.items()) and len(kept) == 20
    none = review.dossiers_after_review(machine, members, pages, review.applied_reviews(targets, reviews.limit(0), "page_id", "target"), roles)
    assert {r["dossier_id"]: tuple(r)[:-1] for r in none.collect()} == before


def test_overrides_count_what_changes_for_a_reviewer(spark):
    rows = [(i, "t", "r", True, d, q) for i, (d, q) in enumerate([(True, True), (True, False), (False, True), (False, False), (None, None), (True, True)])]
    decisions = ["SIGNED", "SIGNED", "UNCLEAR", "UNCLEAR", "NOT_SIGNED", None]
    reviews = spark.createDataFrame([(i, "t", i, 1, "r", d) for i, d in enumerate(decisions) if d], "page_id long, target string, review_id long, created_at long, role string, decision string")
    told = {r["page_id"]: (r["n_applied"], r["n_overridden"]) for r in verdict.overridden(review.applied_reviews(_targets(spark, rows), reviews, "page_id", "target"), "page_id").collect()}
    assert told == {0: (1, 1), 1: (1, 0), 2: (1, 0), 3: (1, 1), 4: (1, 0), 5: (0, 0)}


def test_three_way_comparison(spark):
    values = [None, "a", "b"]
    sides = {"old": [], "new": [], "truth": []}
    want = {}
    for k, (o, n, t) in enumerate(itertools.product([*values, "gone", "twice"], repeat=3)):
        for side, v in zip(sides, (o, n, t), strict=True):
            sides[side] += [] if v == "gone" else [(k, "a"), (k, "b")] if v == "twice" else [(k, v)]
        if (o, n, t) == ("gone",) * 3:
            continue
        twice = [s for s, v in zip(("OLD", "NEW", "TRUTH"), (o, n, t), strict=True) if v == "twice"]
        want[k] = (
            f"DUPLICATE_{twice[0]}" if twice else "NOT_IN_TRUTH" if t == "gone" else "MISSING_BOTH" if o == n == "gone" else "MISSING_OLD" if o == "gone" else "MISSING_NEW" if n == "gone"
            else "SAME_RIGHT" if o == n == t else "BETTER" if n == t else "WORSE" if o == t else "SAME_WRONG" if o == n else "BOTH_WRONG"
        )
    frames = [spark.createDataFrame(rows, "k long, v string") for rows in sides.values()]
    got = compare.three_way(*frames, ["k"], "v")
    assert {r["k"]: r["kind"] for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_labels_are_checked_and_merged(spark):
    schema = "annotator string, item long, vote string, place string"
    labels = [("x", 1, "YES", "GOOD"), ("y", 1, "YES", "BAD"), ("z", 1, "NO", None), ("x", 2, "NO", "GOOD"), ("y", 2, "YES", "GOOD"), ("x", 9, "YES", "GOOD"), ("z", 2, "maybe", "GOOD"), ("z", 2, "NO", "GOOD")]
    frame = spark.createDataFrame(labels, schema)
    items = spark.createDataFrame([(1,), (2,), (3,)], "item long")
    who = spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], "annotator string")
    faults = {tuple(r) for r in compare.label_faults(frame, items, who, {"vote": {"YES", "NO"}, "place": {"GOOD", "BAD"}}, least=5).collect()}
    assert faults == {
        ("FIELD_MISSING", "z", "1", "place"), ("FIELD_NOT_IN_VOCABULARY", "z", "2", "vote"), ("ITEM_UNKNOWN", "x", "9", None), ("ITEM_REPEATED", "z", "2", None), ("TOO_FEW_ANNOTATORS", None, None, None),
        ("ITEM_MISSING", "x", "3", None), ("ITEM_MISSING", "y", "3", None), ("ITEM_MISSING", "z", "3", None), ("ITEM_MISSING", "w", "1", None), ("ITEM_MISSING", "w", "2", None), ("ITEM_MISSING", "w", "3", None),
    }
    told = {(r["item"], r["field"]): (r["n_votes"], r["label"], r["unanimous"], r["disagreement"]) for r in compare.merged_labels(frame, {"vote": "AMBIGUOUS", "place": None}).collect()}
    assert told[1, "vote"] == (3, "YES", False, None) and told[1, "place"] == (3, None, False, "=1,BAD=1,GOOD=1")
    assert told[2, "vote"] == (4, "AMBIGUOUS", False, "NO=2,YES=1,maybe=1") and told[9, "place"] == (1, "GOOD", True, None)
    clean = compare.label_faults(frame.filter("item < 2 and annotator < 'z'"), items.filter("item = 1"), who.filter("annotator in ('x', 'y')"), {"vote": {"YES", "NO"}}, least=2)
    assert clean.count() == 0


def test_containment_equals_a_plain_search(spark):
    draw = random.Random(2)
    word = lambda n: "".join(draw.choices("abé", k=n))
    values = sorted({(g, word(draw.randint(0, 12))) for g in "xy" for _ in range(120)})
    keys = sorted({(g, word(draw.randint(0, 6))) for g in "xyz" for _ in range(80)} | {("x", "zzz"), ("y", "abz")})
    got = containment.containing(spark.createDataFrame(values, "g string, value string"), spark.createDataFrame(keys + keys[:9], "g string, key string"), "g")
    assert sorted((r["g"], r["value"], r["key"]) for r in got.collect()) == sorted((g, v, k) for g, v in values for h, k in keys if g == h and k and k in v)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert containment.containing(spark.createDataFrame(values, "g string, value string"), spark.createDataFrame([("x", "")], "g string, key string"), "g").count() == 0


def test_rules_are_met_by_the_first_evidence_that_holds_the_key(spark):
    rules = [(1, "po", "123", None, "B", "OK"), (2, "po", "123", "C", None, "OK"), (3, "po", "", None, None, "NO"), (4, "iv", "9", None, None, "OK"), (5, "po", "12345", "A", "B", "NO"), (6, "po", "777", None, None, "OK"), (7, "po", "doc", None, "Z", "OK")]
    evidence = [(5, "po", "OK", "A", "B", ["x123y", None]), (2, "po", "NO", "A", "B", ["12345", "doc2"]), (9, "po", "OK", "C", None, ["0123", "doc9"]), (1, "iv", "OK", None, None, ["8"])]
    got = views.rule_accuracy(spark.createDataFrame(rules, "rule_id long, field string, key string, source_type string, target_type string, expected string"), spark.createDataFrame(evidence, "position long, field string, status string, source_type string, target_type string, values array<string>"))
    told = {r["rule_id"]: (r["actual"], r["correct"]) for r in got.collect()}
    assert told == {1: ("NO", False), 2: ("OK", True), 3: ("NO", True), 4: ("NOT_FOUND", False), 5: ("NO", True), 6: ("NOT_FOUND", False), 7: ("OK", True)}


def test_the_least_holder_of_a_key_without_pairs(spark):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choices("0123", k=n))
    rows = [(draw.choice("xy"), i, [f"PO{word(draw.randint(0, 9))}", None, f"d{word(4)}_{word(1)}"], draw.randint(0, 2)) for i in range(300)]
    keys = sorted({(g, word(draw.choice([0, 1, 3, 4, 7]))) for g in "xyz" for _ in range(60)} | {("x", "z1"), ("y", "-")})
    tables = containment.least_of_holders(spark.createDataFrame(rows, "g string, n int, values array<string>, kind int"), spark.createDataFrame(keys + keys[:9], "g string, key string"), {f"k{i}": F.when(F.col("kind") == i, F.col("n")) for i in range(3)}, "g")
    told = [r for t in tables for r in t.collect()]
    got = {(r["g"], r["key"]): (r["k0"], r["k1"], r["k2"]) for r in told if (r["g"], r["key"]) in keys}
    want = {(g, k): tuple(min((n for h, n, vs, kind in rows if h == g and kind == i and any(k in v for v in vs if v)), default=None) for i in range(3)) for g, k in keys if k}
    assert got == {k: v for k, v in want.items() if any(x is not None for x in v)}
    parts = {(g, v[i : i + n]) for g, _, vs, _ in rows for v in vs if v for n in (1, 2, 3, 4, 7) for i in range(len(v) - n + 1)}
    assert len(told) == len({(r["g"], r["key"]) for r in told}) <= len(parts)
    assert containment.least_of_holders(spark.createDataFrame(rows, "g string, n int, values array<string>, kind int"), spark.createDataFrame([("x", "")], "g string, key string"), {"k": F.col("n")}, "g") == []


def test_evidence_without_a_position_comes_last_and_rules_of_one_id_share_the_first(spark):
    rules = [(1, "po", "12", None, None, "OK"), (1, "po", "55", None, None, "OK"), (2, "po", "77", None, None, "NO"), (None, "po", "12", None, None, "OK"), (3, None, "12", None, None, "OK"), (4, "po", None, None, None, "OK")]
    evidence = [(None, "po", "NO", None, None, ["a12", "77"]), (9, "po", "NO", None, None, ["12"]), (4, "po", "OK", None, None, ["0550"]), (4, "po", "NO", None, None, ["5"])]
    rules, evidence = spark.createDataFrame(rules, "rule_id long, field string, key string, source_type string, target_type string, expected string"), spark.createDataFrame(evidence, "position long, field string, status string, source_type string, target_type string, values array<string>")
    told = sorted(((r["rule_id"] or 0, r["key"] or "", r["actual"]) for r in views.rule_accuracy(rules, evidence).collect()))
    assert told == [(0, "12", "NOT_FOUND"), (1, "12", "OK"), (1, "55", "OK"), (2, "77", "NO"), (3, "12", "NOT_FOUND"), (4, "", "NOT_FOUND")]
    late = views.rule_accuracy(rules.filter("key = '12' and rule_id = 1"), evidence).collect()
    assert [r["actual"] for r in late] == ["NO"]


def test_points_of_a_crowded_place_are_dealt_to_many_tasks(spark, monkeypatch):
    draw = random.Random(8)
    points = [(i, draw.choice("ab") if i < 90 else "a", draw.choice([0.0, 0.1, 0.35, 0.3, 0.99, None])) for i in range(400)]
    cells = [(i, draw.choice("abc"), x := draw.choice([0.0, 0.1, 0.3, 0.9]), x + draw.choice([0.1, 0.25])) for i in range(60)]
    a, b = spark.createDataFrame(points, "p long, page string, x double"), spark.createDataFrame(cells, "cell long, page string, x0 double, x1 double")
    want = sorted((p, c) for p, g, x in points for c, h, x0, x1 in cells if g == h and x is not None and x0 <= x < x1)
    for limit in (4_000_000, 300):
        monkeypatch.setattr(measure, "PAIRS_OF_A_TASK", limit)
        got = measure.points_in_cells(a, b, "page").select("p", "cell", F.spark_partition_id().alias("task")).collect()
        assert sorted((r["p"], r["cell"]) for r in got) == want
    tasks = Counter(r["task"] for r in got)
    assert len(tasks) > 8 and max(tasks.values()) < len(want) / 3


@pytest.mark.parametrize(("scan", "found", "status", "warns"), [(True, False, "DAT", ["NO_OUTLINE"]), (True, True, "DAT", []), (False, False, "CHUP_LAI", [])])
def test_a_scan_is_accepted_without_an_outline(spark, scan, found, status, warns):
    limits = {k: 0.5 for k in ("area_most", "area_reject", "area_warn", "margin_reject", "margin_warn", "angle_min", "angle_max", "aspect_low", "aspect_high", "ink_reject", "ink_warn", "agreement_reject", "agreement_warn")}
    none = {m: F.lit(None).cast("double") for m in ("n_cut", "n_near", "area", "margin", "n_touching", "angle_min", "angle_max", "aspect", "ink_outside", "agreement", "mask_fit", "side_skew")}
    gate = spark.range(1).select(policy.corner_gate({"found": F.lit(found), "precropped": F.lit(False), **none}, F.lit(scan), limits).alias("g")).first()["g"]
    assert (gate["status"], gate["warns"]) == (status, warns)


@pytest.mark.parametrize(("scan", "status", "warns"), [(None, "CANH_BAO", ["PRECROPPED"]), (False, "CANH_BAO", ["PRECROPPED"]), (True, "DAT", [])])
def test_a_page_of_unknown_source_keeps_its_warnings(spark, scan, status, warns):
    none = {m: F.lit(None).cast("double") for m in ("n_cut", "n_near", "area", "margin", "n_touching", "angle_min", "angle_max", "aspect", "ink_outside", "agreement", "mask_fit", "side_skew")}
    gate = spark.range(1).select(policy.corner_gate({"found": F.lit(True), "precropped": F.lit(True), **none}, F.lit(scan).cast("boolean"), policy_queries.LIMITS).alias("g")).first()["g"]
    assert (gate["status"], gate["warns"], gate["rejects"]) == (status, warns, [])


def test_corner_gates_warn_of_lines_without_a_flag(spark, sf_dir, tmp_path):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_returnflag", F.expr("CASE WHEN l_orderkey % 2 = 0 THEN l_returnflag END"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    rows = [tuple(r) for r in policy_queries.corner_gates(spark, str(tmp_path)).collect()]
    assert Counter(rows) == Counter(duck.sql(policy_queries.SQL["corner_gates"]).fetchall()) and len(rows) == lines.count()
    told = Counter((warns != "", status) for order, *_, rejects, warns, status in rows if order % 2 == 1 and rejects == "")
    assert set(told) <= {(True, "CANH_BAO"), (False, "DAT")} and told[True, "CANH_BAO"] > 0


def test_explicit_stamp_classes(spark):
    rows = spark.createDataFrame([("ODD", "any_stamp"), ("", "any_stamp"), (None, "any_stamp"), ("COMPANY_ROUND_RED", None)], "explicit string, colour string")
    told = rows.select(policy.stamp_class(F.lit("r"), F.col("colour"), F.col("explicit")).alias("a"), policy.stamp_class(F.lit("r"), F.col("colour"), F.col("explicit"), by_role=True).alias("b")).collect()
    assert [tuple(r) for r in told] == [(None, "ODD"), ("SUPERMARKET_SQUARE", ""), ("SUPERMARKET_SQUARE", "SUPERMARKET_SQUARE"), ("COMPANY_ROUND_RED", "COMPANY_ROUND_RED")]


def test_columns_that_were_not_hit_lie_on_the_line(spark):
    hits = [("a", 0, 0.1), ("a", 0, 0.3), ("a", 0, 0.12), ("a", 2, 0.42), ("a", 3, 0.57), ("b", 0, 0.1), ("b", 1, 0.2), ("c", 0, 0.5), ("c", 1, 0.4), ("c", 2, 0.9), ("d", 0, 0.1), ("d", 1, 0.11), ("d", 2, 0.12), ("a", 7, 9.0)]
    rows = measure.filled_columns(spark.createDataFrame(hits, "g string, place int, value double"), "g", 5, 3, (0.1, 0.25)).collect()
    told = {(r["g"], r["place"]): (r["centre"], r["source"]) for r in rows}
    assert {r["g"]: r["status"] for r in rows} == {"a": "COLUMNS_FROM_LABELS", "b": "COLUMN_DETECTION_FAILED", "c": "COLUMN_ORDER_VIOLATION", "d": "COLUMN_PITCH_IMPLAUSIBLE"}
    assert told["a", 0] == (0.12, "OCR_LABEL") and told["a", 1] == (0.27, "INTERPOLATED") and told["a", 4] == (0.72, "INTERPOLATED") and told["b", 1] == (None, None)


def test_columns_are_filled_after_one_exchange(spark):
    hits = spark.range(3000).select((F.col("id") % 500).alias("g"), (F.col("id") % 6).cast("int").alias("place"), (F.col("id") % 6 * 0.15).alias("value"))
    rows = measure.filled_columns(hits, "g", 5, 3, (0.1, 0.25))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "ObjectHashAggregate" not in plan and "lambda" not in plan


def test_phrases_of_lines_need_one_exchange(spark):
    words = spark.createDataFrame([("a", 0.0, 1.0, 2.0), ("a", 2.0, 3.0, 2.0), ("a", 9.0, 9.5, 4.0), (None, 0.0, 1.0, 2.0)], "line string, x0 double, x1 double, height double")
    rows = views.phrases(words, ["line"], 1.5)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    assert sorted((r["x0"], r["phrase"]) for r in rows.collect()) == [(0.0, 1), (2.0, 1), (9.0, 2)]


PAGE = "upload_group_id string, scan_index int, doc_type string, page_role string, system string, action string, shipment_id string, invoice_no string, po_no string, transfer_order_no string, pxk_no string"


def _plain_runs(pages):
    """Each page against all of its run, one upload after the other."""
    out = {}
    near = lambda a, b: a.startswith(b) or b.startswith(a) or len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= 2
    fields = ("po_no", "invoice_no", "transfer_order_no", "pxk_no")
    for upload in {p["upload_group_id"] for p in pages}:
        run, number = [], -1
        for p in sorted((p for p in pages if p["upload_group_id"] == upload), key=lambda p: p["scan_index"]):
            ok = lambda q: q["doc_type"] not in (None, "UNKNOWN") and q["action"] != "YEU_CAU_CHUP_LAI"
            clash = next((f for m in run for f in (*fields, "shipment_id") if m[f] and p[f] and (not near(m[f], p[f]) if f == "shipment_id" else m[f].strip() != p[f].strip())), None)
            reason = "START" if not run else "NOT_ELIGIBLE" if not (ok(p) and ok(run[-1])) else "DOC_TYPE_CHANGE" if p["doc_type"] != run[-1]["doc_type"] else "SCAN_INDEX_GAP" if p["scan_index"] != run[-1]["scan_index"] + 1 else f"KEY_FIELD_CONFLICT({clash})" if clash else "JOINED"
            run, number = ([*run, p], number) if reason == "JOINED" else ([p], number + 1)
            out[upload, p["scan_index"]] = (f"{upload}#{number}", reason)
    return out


def test_runs_equal_a_fold_over_all_pages(spark):
    draw = random.Random(12)
    some = lambda share, *xs: draw.choice(xs) if draw.random() < share else None
    pages = []
    for u in range(12):
        at = 0
        for _ in range(40):
            at += 1 + (draw.random() < 0.05)
            pages.append({"upload_group_id": f"u{u}", "scan_index": at, "doc_type": some(0.97, *["PO"] * 9, "HOA_DON", "UNKNOWN"), "page_role": None, "system": "COMMON", "action": some(0.9, *["PASS"] * 20, "YEU_CAU_CHUP_LAI"), "shipment_id": some(0.4, "123456", "123457", "123466", "1234", "777777"), "invoice_no": some(0.2, "I1", " I1", "I2"), "po_no": some(0.2, "P1", "P1 "), "transfer_order_no": some(0.05, "T1", "T2"), "pxk_no": None})
    frame = spark.createDataFrame([tuple(p[c.split()[0]] for c in PAGE.split(", ")) for p in pages], PAGE).repartition(5)
    got = {(r["upload_group_id"], r["scan_index"]): (r["cluster_id"], r["split_reason"]) for r in stitching.voting_runs(frame).collect()}
    want = _plain_runs(pages)
    assert got == want
    sizes = Counter(c for c, _ in want.values())
    assert all(r["cluster_size"] == sizes[r["cluster_id"]] for r in stitching.voting_runs(frame).collect())


def test_a_long_upload_is_folded_in_linear_time(spark):
    n = 4000
    pages = spark.range(n).select(F.lit("u").alias("upload_group_id"), F.col("id").cast("int").alias("scan_index"), F.lit("PO").alias("doc_type"), F.lit("PASS").alias("action"), F.lit("P1").alias("po_no"), *(F.lit(None).cast("string").alias(c) for c in ("page_role", "system", "invoice_no", "transfer_order_no", "pxk_no")), F.lit("123456").alias("shipment_id"))
    runs = stitching.voting_runs(pages)
    assert runs.agg(F.max("cluster_size")).first()[0] == n


def test_tasks_of_review_histories_follow_the_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from paperweave.operators import views
    from paperweave.sources import lineage

    rows = spark.range(600).select((F.col("id") % 50).alias("page_id"), F.col("id").alias("review_id"), (F.col("id") % 3).alias("target_index"), (F.col("id") % 7).alias("created_at"), (F.col("id") % 2 == 0).alias("machine_detected"))
    targets = spark.range(50).select(F.col("id").alias("page_id"), (F.col("id") % 3).alias("target_index"), F.lit(True).alias("detected"))
    told = views.review_history(rows, targets)
    plain = sorted(map(tuple, told.collect()))
    monkeypatch.setattr(lineage, "TASK_ROWS", 20)
    many = views.review_history(rows, targets)
    assert sorted(map(tuple, many.collect())) == plain
    assert many.rdd.getNumPartitions() == 30 and many.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200


def test_label_faults_deal_labels_once(spark, sf_dir):
    import re

    from paperweave.plans import catalog

    plan = catalog.QUERIES["label_faults"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[[^\]]*item", plan)
