"""Near copies, repeats, packing, toxicity, nearest vectors and the pipeline against plain versions."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import empty_documents, jaccard_components, shingle_set, small_documents, table_texts, without_repeats
from pyspark.sql import functions as F

from paperweave.llm import knn, ngram_join, packing, queries, repeats, toxicity
from paperweave.llm.components import components

P = pytest.importorskip("public_tokenizers")


def test_jaccard_join(spark, sf_dir):
    want = jaccard_components(table_texts(sf_dir), 4, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op1_ngram_join(spark, sf_dir).collect()}
    assert got == want


def test_jaccard_join_of_awkward_rows(spark):
    docs = small_documents(spark)
    want = jaccard_components({r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}, 5, 80)
    rows = ngram_join.join_components(docs).collect()
    assert len(rows) == 22
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want
    assert want[2][1] == want[3][1] == want[4][1] == 1 and want[9] == (0, 9)
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None]
    assert ngram_join.join_components(empty_documents(spark)).count() == 0


def test_jaccard_join_of_a_chain_of_near_copies(spark):
    # each text differs a little more from the first: neighbours link, the ends do not
    draw = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(60):
        texts[i] = " ".join(base)
        base[draw.randrange(200)] = f"z{i}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(docs, 4, 85).collect()}
    assert got == jaccard_components(texts, 4, 85)


def test_trie_finds_all_links():
    draw = random.Random(2)
    sets = [np.array(sorted(draw.sample(range(1, 60), draw.randint(5, 40))), np.uint64) for _ in range(150)]
    base = np.arange(100, 400, dtype=np.uint64)
    sets += [np.delete(base, draw.sample(range(300), draw.randint(0, 60))) for _ in range(40)]  # long shared beginnings
    sets.sort(key=lambda s: s.astype(">u8").tobytes())
    for percent in (30, 60, 80, 90):
        some = list(range(0, len(sets), 7))
        want = {(i, k) for i, s in enumerate(sets) for k, x in enumerate(some) if 100 * len(np.intersect1d(s, sets[x])) >= percent * len(np.union1d(s, sets[x]))}
        assert {(i, int(k)) for i, linked in ngram_join.walk_trie(sets, [sets[x] for x in some], percent) for k in linked} == want


@pytest.mark.parametrize("percent", [10, 60, 80])
def test_large_lists_and_clusters_are_split_into_cells(spark, monkeypatch, percent):
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 5)
    monkeypatch.setattr(ngram_join, "TREE_BLOCK", 300)
    draw = random.Random(7)
    texts = {}
    for i in range(160):
        words = [f"w{k}" for k in range(60 + i % 3 * 30)]
        for _ in range(draw.randint(0, 14)):
            words[draw.randrange(len(words))] = f"x{i}-{draw.random()}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(docs, 2, percent).collect()}
    assert got == jaccard_components(texts, 2, percent)


def test_members_grow_in_proportion_just_under_the_similarity(spark):
    draw = random.Random(3)
    rows = {}
    for size in (400, 800, 1600):
        texts = []
        for i in range(size):
            words = [f"w{k}" for k in range(300)]
            for at in draw.sample(range(0, 300, 6), 4):
                words[at] = f"x{i}-{at}"
            texts.append((i, " ".join(words)))
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        frequent = ngram_join.frequent_slots(docs, 5)
        classes = ngram_join.nodes(docs, 5, 80, frequent).withColumn("comp", F.col("doc_id"))
        rows[size] = ngram_join._clustered(classes, 80).count()
    assert rows[400] <= 8 * 400 and rows[800] <= 8 * 800 and rows[1600] <= 8 * 1600


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r[0]: r[1] for r in components(links).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_split_lists_lose_nothing(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 2)
    monkeypatch.setattr(ngram_join, "SPLIT_BLOCKS", 1)
    monkeypatch.setattr(ngram_join, "_stars", lambda classes, percent: ngram_join.cut(classes.select(F.col("doc_id").alias("leader"), "doc_id", F.col("doc_id").alias("comp"), F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("h"), F.lit(False).alias("whole"), F.lit(True).alias("side")).limit(0)))
    monkeypatch.setattr(ngram_join, "RARE_SHARE", 1.0)
    draw = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(60):
        words = [w if draw.random() > 0.03 * (i % 3) else f"x{draw.randrange(200)}" for w in base[: 20 + i % 40]]
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for percent in (50, 60, 85):
        want = jaccard_components(texts, 2, percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(docs, n=2, percent=percent).collect()}
        assert got == want


def test_rows_of_a_split_list_grow_with_the_list(spark, monkeypatch):
    """One shingle in n sets of as many components, each with a second one that a few others share: copies are counted."""
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "SPLIT_BLOCKS", 4)
    copied = []
    for n in (1000, 2000, 4000):
        classes = spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").alias("comp"), F.lit(20).cast("long").alias("n_shingles"), F.array(F.lit(7).cast("long"), 100 + F.floor(F.col("id") / 3), 10**6 + F.col("id")).alias("all_prefix"))
        lists = ngram_join.cut(classes.select("doc_id", "comp", "n_shingles", F.lit(7).cast("long").alias("token"), F.lit(0).cast("long").alias("pos")))
        split = ngram_join._split_lists(lists, classes, 85)
        assert {frozenset(r[1]) for r in split.groupBy("token").agg(F.collect_set("doc_id")).collect()} == {frozenset(range(i, min(i + 3, n))) for i in range(0, n, 3) if i + 1 < n}
        copied.append(ngram_join._cells(split, "token", ngram_join.LIST_BLOCK, F.lit(1)).count())
    assert copied == [999, 2000, 3999] or max(copied) <= 4000 and copied[2] <= 4.1 * copied[0]


def test_repeats(spark, sf_dir):
    want = without_repeats(table_texts(sf_dir), 13)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op4_repeats(spark, sf_dir).collect()}
    assert got == want


def test_repeats_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_LEAST", 50)  # so that prefixes are split further
    docs = small_documents(spark)
    want = without_repeats({r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}, 13)
    rows = repeats.remove_repeats(docs, words=13).collect()
    assert len(rows) == 22 and rows[0].asDict().keys() >= {"lang", "score", "kept", "text"}
    assert all(r["bucket"] == 99 for r in rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows if r["doc_id"] is not None} == want
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] is None)
    for r in rows:
        if r["n_removed"]:
            assert hashlib.sha256(b" ".join(r["kept"].encode().split())).hexdigest() == r["kept_sha256"]
        else:
            assert r["kept"] == r["text"]
    assert repeats.remove_repeats(empty_documents(spark)).count() == 0


def test_packing(spark, sf_dir):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)  # as it is loaded: what looks like an added token is one
    tables = [(queries.op5_packing(spark, sf_dir).collect(), table_texts(sf_dir).items())]
    marked = [(30, "<|endoftext|> x"), (31, "a<|endoftext|>é中<|ENDOFTEXT|>"), (32, "<|endoftext"), (33, "<|endoftext|>" * 700)]
    small = small_documents(spark).unionByName(spark.createDataFrame(marked, "doc_id long, text string"), allowMissingColumns=True)
    tables.append((packing.pack_documents(small, path, buckets=3).collect(), [(r["doc_id"], r["text"]) for r in small.collect()]))
    for rows, texts in tables:
        pieces = Counter()
        total = 0
        for doc_id, text in texts:
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
            total += len(ids)
            first = len(ids) % 2048 or 2048
            cuts = [0, *range(first, len(ids) + 1, 2048)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                pieces[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
        ends = {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == ends.get(r["sequence_id"], 0)
            ends[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(ends.values()) <= 2048
        assert len(ends) <= 1.02 * math.ceil(total / 2048) + 1
    assert packing.pack_documents(empty_documents(spark), path).count() == 0


def test_plan_uses_every_piece_once():
    draw = random.Random(4)
    for capacity in (10, 64, 2048):
        histogram = Counter(draw.randint(1, capacity) for _ in range(3000))
        runs = packing.plan(histogram, capacity)
        used = Counter()
        for lengths, times in runs:
            assert sum(lengths) <= capacity
            for x in lengths:
                used[x] += times
        assert used == histogram
    assert packing.plan({3: 4, 7: 4}, 10) == [((7, 3), 4)]
    assert packing.plan({2: 1, 3: 1, 1: 1, 4: 1}, 10) == [((4, 3, 2, 1), 1)]
    assert packing.plan({}, 10) == []


def test_exact_triples_are_found_among_all_lengths():
    pieces = {**dict.fromkeys((1000, 500, 348, 200), 10**6), **dict.fromkeys(range(354, 419), 1)}
    runs = packing.plan(pieces, 2048)
    used = Counter()
    for lengths, n in runs:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += n
    assert used == Counter(pieces)
    assert sum(n for _, n in runs) <= 1_000_100
    draw = random.Random(3)
    for _ in range(300):
        counts = np.zeros(151, np.int64)
        for x in draw.sample(range(1, 150), draw.randint(3, 100)):
            counts[x] = draw.randint(1, 3)
        length = int(np.flatnonzero(counts)[-1])
        gap, have = 150 - length, {int(x): int(counts[x]) for x in np.flatnonzero(counts)}
        sets = [p for k in (1, 2, 3) for p in itertools.combinations_with_replacement([x for x in have if x <= gap], k) if sum(p) == gap]
        fits = {p for p in sets if all(have[x] >= n for x, n in Counter((length, *p)).items())}
        got = packing.Sums(counts, 150).fill(length, gap)
        assert tuple(sorted(got)) in fits if fits else got is None


def test_tokens_of_special_text_equal_the_library():
    worker = packing._Worker(P.path("byte_bpe_50k.json"))
    texts = ["", "<|endoftext|> x", "a  b\n\n c\t\x1c\x85 d", "naïve ²½ ÿ", "中文 😀", "don't   'll"]
    assert worker.fast is not None
    for text, ids in zip(texts, worker.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == worker.tokenizer.encode(text, add_special_tokens=False).ids


def test_toxicity(spark):
    draw = random.Random(6)
    plain = ["the", "river", "runs", "over", "stones", "while", "people", "walk", "along", "banks", "and", "talk"]

    def text(toxic):
        w = [draw.choice(plain) for _ in range(40)]
        if toxic:
            w[draw.randrange(40)] = draw.choice(["moron", "scumbag", "worthless"])
        return " ".join(w)

    rows = [(i, text(i % 5 == 1), int(i % 5 == 1)) for i in range(600)]
    extra = [(1000, "such a mor-on you are", None), (1001, "m o r o n", None), (1002, None, None), (1003, "", None), (1004, "scum.bag here", None), (None, "people walk", None), (1005, "the river runs", None)]
    docs = spark.createDataFrame([(i, t, 7.0) for i, t, _ in rows + extra], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == 607
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"] and i is not None and i < 1000} == set(held)
    assert all(got[i]["predicted"] == y for i, _, y in rows if i in set(held))
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, 1005)] == [1, 1, 0, 0, 1, 0]
    none = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert len(none) == 607 and {r["predicted"] for r in none} == {0}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_bounds_hold():
    marks = toxicity.Landmarks(["moron", "worthless", "écœurant"])
    for w in ("moron", "m.o.r.o.n", "mooron", "worthles", "éco", "abcdefghijklmnopqrstuvwx"):
        assert marks.word(w).max() <= marks.bounds([w], list(marks.most))[0] <= marks.bounds([w])[0]


def _plain_kernel(a, b):
    """Shared 3-letter subsequences of two words by definition."""

    def weights(word):
        word = word + "$$" * (len(word) < 3)
        out = Counter()
        for at in itertools.combinations(range(len(word)), 3):
            stretch = at[2] - at[0] + 1
            if stretch <= toxicity.STRETCH:
                out["".join(word[i] for i in at)] += toxicity.LAMBDA**stretch
        return out

    x, y = weights(a), weights(b)
    return sum(v * y[u] for u, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_likeness_equals_the_kernel_by_definition():
    names = ["moron", "worthless", "ab", "river", "aaaa"]
    marks = toxicity.Landmarks(names)
    for w in ("moron", "mxoxron", "mo", "ab", "worthlessness", "riverbed", "aaaaaa", "zzz", "wortless"):
        want = [_plain_kernel(w, m) for m in names]
        assert np.allclose(marks.word(w), want, atol=1e-6), w


def test_words_with_two_inserted_letters_are_alike():
    marks = toxicity.Landmarks(["trash", "stupid", "the", "river"])
    words = {"txrxash", "stxupxid", "trash", "tr.ash", "stupidity", "stone", "banana", "people", "rivulet"}
    marks.texts([" ".join(words)])
    assert {"txrxash", "stxupxid"} <= set(marks.alike)
    assert set(marks.alike) == {w for w in words if max(marks.word(s).max() for s in toxicity.segments(w)) >= toxicity.LIKENESS}


def _plain_nearest(vectors, k=5):
    usable = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in usable:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in usable if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_nearest(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = _plain_nearest([(r["vec_id"], r["embedding"]) for r in frame.collect()])
    assert sorted(map(tuple, queries.op9_knn(spark, sf_dir).collect())) == want


def test_nearest_of_awkward_rows(spark):
    draw = random.Random(8)
    rows = [(i, [draw.choice([-1.0, 0.0, 0.5]) for _ in range(3)], "x") for i in range(300)]
    rows += [(300, None, "x"), (350, [1.0, None, 0.0], "x"), (400, [float("nan"), 1.0, 1.0], "x"), (450, [float("inf"), 1.0, 1.0], "x"), (500, [], "x"), (550, [9e5, -9e5], "x"), (None, [1.0, 1.0, 1.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = sorted(map(tuple, knn.nearest(frame, F.col("vec_id") % 50 == 0).collect()))
    assert got == _plain_nearest([r[:2] for r in rows])
    assert knn.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert knn.nearest(frame.filter("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_of_split_cells_with_repeats(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 8)
    monkeypatch.setattr(knn, "PART_BLOCKS", 2)
    draw = random.Random(9)
    rows = [(i, [draw.choice([-1.0, 0.0, 1.0]) for _ in range(2)]) for i in range(1000)]  # far more ties than k
    frame = spark.createDataFrame(rows + [(i, x) for i, x in rows if i % 7 == 1 and i % 50], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, knn.nearest(frame, F.col("vec_id") % 50 == 0).collect()))
    assert got == _plain_nearest(rows + [(i, x) for i, x in rows if i % 7 == 1 and i % 50])


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp
    from paperweave.llm.scratch import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = cut(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        seen[name] = (before, {r["doc_id"]: r["text"] for r in docs.collect()})
    before, after = seen["toxicity"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).collect()
    assert set(after) == {r["doc_id"] for r in scored if r["predicted"] == 0} and all(before[d] == t for d, t in after.items())
    before, after = seen["near_copies"]
    want = {d for d, (_, c) in jaccard_components(before, 5, 80).items() if c == d}
    assert set(after) == want and all(before[d] == t for d, t in after.items())
    before, after = seen["repeats"]
    told = without_repeats(before, cp.PASSAGE_WORDS)
    assert set(after) == {d for d, (n, r, _) in told.items() if n == 0 or r < n}
    assert all(hashlib.sha256(b" ".join(after[d].encode().split())).hexdigest() == told[d][2] for d in after)
    before, after = seen["secrets"]
    assert set(after) == set(before)
    packed = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == len(after)
    assert not any(a != b and shingle_set(x, 5) == shingle_set(y, 5) and shingle_set(x, 5) for (a, x), (b, y) in zip(list(seen["near_copies"][1].items())[:50], list(seen["near_copies"][1].items())[1:51], strict=False))


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline as cp
    from paperweave.llm.scratch import cut

    spark.createDataFrame([(5, 0), (6, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs, n in ((small_documents(spark), 22), (empty_documents(spark), 0)):
        docs = docs.withColumnRenamed("score", "predicted").withColumn("kept", F.lit(1)).withColumn("component_id", F.lit("c"))
        columns = docs.columns
        for name, stage in cp.STAGES[:-1]:
            docs = cut(stage(spark, docs, str(tmp_path)))
            assert docs.columns == columns, name
            rows = docs.collect()
            assert all((r["bucket"], r["predicted"], r["kept"], r["n_words"], r["component_id"]) == (99, 0.5, 1, "mine", "c") for r in rows), name
            if name == "toxicity":
                assert len(rows) == n
            if n:
                assert sum(r["doc_id"] is None for r in rows) == 2 and {8, 9, 10} <= {r["doc_id"] for r in rows}
        pieces = cp.STAGES[-1][1](spark, docs, str(tmp_path))
        assert (pieces.count() > 0) == (n > 0)


def test_held_out_quality_of_toxicity(spark, sf_dir):
    table = sf_dir.replace("sf0.001", "sf0.1")  # the small one has one held-out toxic document
    scored = {r["doc_id"]: r for r in queries.op6_toxicity(spark, table).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{table}/labels.parquet").collect()}
    held = [(scored[d]["score"], y) for d, y in truth.items() if scored[d]["held_out"]]
    up, down = ([s for s, y in held if y == k] for k in (1, 0))
    assert len(up) > 50 and len(down) > 500
    assert sum((a > b) + (a == b) / 2 for a in up for b in down) >= 0.9 * len(up) * len(down)
    assert sum(s >= 0.5 for s in up) >= 0.6 * len(up) and sum(s >= 0.5 for s in down) <= 0.03 * len(down)


def test_gathered_leaves_are_let_go_while_they_are_ordered():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from paperweave.llm import repeats

    class Held:
        def filter(self, _):
            return self

        def mapInArrow(self, run, _):
            return run

    n = 1 << 20
    texts = [" ".join(map(str, range(i, i + 1000))) for i in range(0, n, 1000)]
    run = repeats._leaves(Held(), 13, _dealt(repeats.PrefixPlan(), np), 7)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    rows = sum(len(c) for out in run(iter([batch])) for c in out.column("counts").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 90 * n, peak


def _dealt(plan, np):
    plan.deal(np.ones(len(plan.bits), np.int64), 4096)
    return plan


def test_gathered_leaves_are_narrow_and_sent_in_parts(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from paperweave.llm import repeats

    class Held:
        def filter(self, _):
            return self

        def mapInArrow(self, run, _):
            return run

    n = 1 << 20
    texts = [" ".join(map(str, range(i, i + 1000))) for i in range(0, n, 1000)]
    run = repeats._leaves(Held(), 13, _dealt(repeats.PrefixPlan(), np), 7)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    list(run(iter([batch.slice(0, 2)])))  # tables of powers are made once
    tracemalloc.start()
    most = max(out.nbytes for out in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * n and peak < 60 * n, (most, peak)


def test_leaves_do_not_depend_on_where_a_task_cuts_what_it_gathers(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from paperweave.llm import repeats

    class Held:
        def filter(self, _):
            return self

        def mapInArrow(self, run, _):
            return run

    texts = [" ".join(str((i * 7 + j) % 50) for j in range(30)) for i in range(40)]
    ids = [(i * 17) % 40 - 20 for i in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 11]), pa.array(texts[i : i + 11])], ["doc_id", "text"]) for i in range(0, 40, 11)]

    def told(sent):
        out = []
        for b in run(iter(batches)):
            assert sent >= 1 << 17 or b.num_rows
            for d, c, h in zip(*(b.column(x).to_pylist() for x in ("doc_ids", "counts", "hashes")), strict=True):
                out += zip(np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.uint32)).tolist(), np.frombuffer(h, np.uint64).tolist())
        return set(out)

    run = repeats._leaves(Held(), 13, _dealt(repeats.PrefixPlan(), np), 7)
    whole = told(1 << 17)
    monkeypatch.setattr(repeats, "SENT_LEAVES", 5)
    assert told(5) == whole
    # cut within batches, every leaf of a document is still told under its own id
    monkeypatch.setattr(repeats, "GATHER_BYTES", 1)
    monkeypatch.setattr(repeats, "blocks", lambda some: ((i, some[i : i + 2]) for i in range(0, len(some), 2)))
    every = told(5)
    plain = {(i, h) for i, t in zip(ids, texts, strict=True) for h in repeats.grams(repeats.word_table([t.encode()])[0], 13).tolist()}
    assert whole <= every == plain or whole <= every <= plain
