"""Languages, whitening and the audit of filters against plain versions."""

import math
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from cases import empty_documents, small_documents
from pyspark.sql import functions as F

from paperweave.llm import filter_audit, language, queries, whitening


def _marginals(model, scores):
    """Forward-backward word by word, in logarithms."""
    n, many = scores.shape
    add = np.logaddexp.reduce
    ahead, back = np.zeros((n, many)), np.zeros((n, many))
    ahead[0] = model.start + scores[0]
    for t in range(1, n):
        ahead[t] = [add(ahead[t - 1] + model.transitions[:, j]) + scores[t, j] for j in range(many)]
    for t in reversed(range(n - 1)):
        back[t] = [add(model.transitions[i] + scores[t + 1] + back[t + 1]) for i in range(many)]
    both = ahead + back
    return np.exp(both - add(both, axis=1, keepdims=True))


def test_forward_backward_equals_the_plain_recursion():
    draw = np.random.default_rng(0)
    model = language.Model(list("abc"), np.zeros(0, np.uint64), np.zeros((0, 3)), np.zeros((0, 3)), draw.normal(size=(3, 3)), draw.normal(size=3))
    sizes = [70, 3, 0, 40, 1, 0, 32, 64, 65, 2000]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    scores = 4 * draw.normal(size=(begins[-1], 3))
    got = model.probabilities(scores, begins)
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        if b > a:
            assert np.abs(_marginals(model, scores[a:b]) - got[a:b]).max() < 1e-9


def test_features_of_words_are_their_own_and_blocks_do_not_matter():
    words = language.Words.of(["Été, l'été! x2y", "", "中文 Straße"])
    spelled = ["".join(map(chr, words.codes[a:b])) for a, b in zip(words.first, words.end, strict=True)]
    assert spelled == ["été", "l", "été", "x", "y", "中文", "straße"] and words.begins.tolist() == [0, 5, 5, 7]
    ids, begins = language.grams(words.codes, words.first, words.end)
    # a word of c letters has c + 2 places, whose runs of 1 to 4 are counted without the two lone marks
    for i, w in enumerate(spelled):
        assert begins[i + 1] - begins[i] == sum(max(0, len(w) + 2 - k + 1) for k in range(1, 5)) - 2
    assert ids[begins[0] : begins[1]].tolist() == ids[begins[2] : begins[3]].tolist()
    again = language.Words.of(["zz yy été"])
    key = language.hashes(again.codes, again.first, again.end)[2]
    assert key == language.hashes(words.codes, words.first, words.end)[0]
    draw = np.random.default_rng(1)
    many = 2
    model = language.Model(["a", "b"], np.array([key]), np.array([[1.0, 0.0]]), draw.normal(size=(language.BUCKETS + many + 1, many)), np.zeros((2, 2)), np.zeros(2))
    plain = np.array([model.weights[ids[begins[i] : begins[i + 1]]].sum(axis=0) + (model.weights[language.BUCKETS] if w == "été" else model.weights[-1]) for i, w in enumerate(spelled)])
    assert np.abs(model.scores(words) - plain).max() < 1e-4
    before, language.CHARS_AT_ONCE = language.CHARS_AT_ONCE, 4
    assert np.abs(model.scores(words) - plain).max() < 1e-4
    language.CHARS_AT_ONCE = before


def test_gradient_and_switches():
    draw = np.random.default_rng(5)
    tongues = {"p": "ba da ga bada gaba dada".split(), "q": "ok uk ik okuk ikok ukuk".split()}
    windows, labels = [], []
    for i in range(80):
        lang = "pq"[i % 2]
        windows.append(" ".join(draw.choice(tongues[lang], 12)))
        labels.append(i % 2)
    model = language.fit(windows, labels, ["p", "q"])
    assert model.transitions[0, 0] > model.transitions[0, 1] and model.transitions[1, 1] > model.transitions[1, 0]
    words, probable = model.texts(["bada dada gaba ba okuk uk ik ikok gaba da"])
    assert probable.argmax(axis=1).tolist() == [0, 0, 0, 0, 1, 1, 1, 1, 0, 0]

    # the optimiser, on a quadratic that it must solve
    a = np.diag(np.arange(1.0, 21.0))
    x = language.minimised(lambda v: (float(v @ a @ v / 2 - v.sum()), a @ v - 1), np.zeros(20), steps=200)
    assert np.abs(x - 1 / np.arange(1.0, 21.0)).max() < 1e-2


def test_languages_of_held_out_documents(spark, sf_dir):
    found = queries.op11_language(spark, sf_dir).collect()
    known = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf_dir}/documents.parquet'").fetchall())
    assert len(found) == len(known)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    tested = [r for r in found if r["held_out"]]
    assert sum(known[r["doc_id"]] == r["lang_pred"] for r in tested) >= 0.97 * len(tested)


def test_languages_of_awkward_rows(spark, sf_dir):
    docs = small_documents(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").when(F.col("doc_id") > 4, "xx"))
    told = language.predict_languages(docs, keep_runs=True)
    assert told.columns == [*(c for c in docs.columns if c != "score"), "held_out", "lang_pred", "score", "runs"]
    rows = told.collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (r["score"] > 0) == letters and bool(r["runs"]) == letters
        if r["runs"]:
            assert all(r["text"][x["start"]].isalpha() and r["text"][x["end"] - 1].isalpha() and x["lang"] in ("en", "xx") for x in r["runs"])
            assert all(x["end"] <= y["start"] and x["lang"] != y["lang"] for x, y in zip(r["runs"], r["runs"][1:], strict=False))
        if r["doc_id"] is None:
            assert not r["held_out"]
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"], (r["lang_pred"], r["score"])) == (r["lang_pred"], r["score"])
    unknown = language.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in unknown] == [("und", 0.0)]
    assert language.predict_languages(empty_documents(spark)).count() == 0


def _plain_whitening(vectors, k=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    centred = x - x.mean(axis=0)
    values, basis = np.linalg.eigh(centred.T @ centred / len(x))
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    n = len(x)
    deviations = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(axis=0), strict=True)) for row in x]
    return centred @ basis / np.sqrt(values), values / centred.var(axis=0).sum(), deviations


def test_whitening_equals_eigenvectors(spark, sf_dir):
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet' ORDER BY vec_id").fetchall()
    plain, shares, deviations = _plain_whitening([e for _, e in table])
    got = queries.op12_whitening(spark, sf_dir).toPandas()
    many = plain.shape[1]
    assert len(got) == len(table) * many
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    for j in range(many):
        assert min(np.abs(wide[:, j] - plain[:, j]).max(), np.abs(wide[:, j] + plain[:, j]).max()) < 1e-6
    assert np.abs(got[got.vec_id == table[0][0]].sort_values("component").explained.to_numpy() / shares - 1).max() < 1e-9
    assert got[got.component == 1].set_index("vec_id").deviation.loc[[i for i, _ in table]].tolist() == deviations
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-8 and (got.n == len(table)).all()


def test_whitening_of_awkward_rows(spark):
    draw = np.random.default_rng(3)
    low = (draw.normal(size=(40, 2)) @ draw.normal(size=(2, 6))).tolist()  # two directions in six dimensions: a breakdown, and little beyond
    rows = [(i, v, "x") for i, v in enumerate(low)] + [(7, low[7], "again"), (None, low[3], "x"), (90, None, "x"), (91, [], "x"), (92, [1.0] * 5 + [None], "x"), (93, [1.0] * 5 + [math.nan], "x"), (94, [1.0] * 5 + [math.inf], "x"), (95, [1.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")
    got = whitening.whiten(frame).collect()
    plain, shares, deviations = _plain_whitening([*low, low[7], low[3]])
    assert {r["n"] for r in got} == {42} and {r["vec_id"] for r in got} == {None, *range(40)}
    assert Counter(r["component"] for r in got if r["vec_id"] == 7) == {c: 2 for c in range(1, 7)}
    for r in got:
        if r["vec_id"] is not None and r["component"] <= 2:
            assert abs(abs(r["whitened"]) - abs(plain[r["vec_id"], r["component"] - 1])) < 1e-6 and r["deviation"] == deviations[r["vec_id"]]
    same = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(1)).count() == 0 and whitening.whiten(same.limit(0)).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert huge and all(r["deviation"] is None for r in huge if r["vec_id"] < 3)


@pytest.mark.parametrize("kind", ["plain", "twins", "low", "zero"])
def test_block_lanczos(kind):
    draw = np.random.default_rng(2)
    d = 120
    q, _ = np.linalg.qr(draw.normal(size=(d, d)))
    values = {"plain": np.linspace(9, 0.1, d) ** 2, "twins": np.repeat([5.0, 4.0, 1.0], d // 3), "low": np.r_[3.0, 2.0, np.zeros(d - 2)], "zero": np.zeros(d)}[kind]
    a = (q * values) @ q.T
    calls = []

    def product(block):
        calls.append(block.shape[1])
        return a @ block

    got, vectors, passes = whitening.block_lanczos(product, d, 10, block=8)
    assert np.abs(got - np.sort(values)[::-1][:10]).max() < 1e-9 and passes == len(calls) <= d // 8
    assert np.abs(vectors.T @ vectors - np.eye(10)).max() < 1e-12 and np.linalg.norm(a @ vectors - vectors * got, axis=0).max() < 1e-9


def _plain_audit(docs, labels):
    """Each order applied step by step to the documents themselves."""
    first, fails, parts, out = {}, [], {}, []
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for n, (i, t, s) in enumerate(docs):
        t = t or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails.append({
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i,
        })
        parts.setdefault(s or "", []).append(n)
    for part, members in parts.items():
        totals = Counter()
        steps = []
        for order in permutations("ABCDE"):
            left = set(members)
            for k, f in enumerate(order, 1):
                hit = {n for n in left if fails[n][f]}
                totals[f] += len(hit)
                gone = [n for n in members if n not in left and fails[n][f]]
                alone = [n for n in members if fails[n][f] and sum(fails[n].values()) == 1]
                left -= hit
                steps.append((part, "".join(order), k, len(left), len(hit), len(gone), len(alone), sum(bool(labels.get(docs[n][0], (0, 0))[0]) for n in hit), sum(bool(labels.get(docs[n][0], (0, 0))[1]) for n in hit), f))
        out += [(*s[:-1], totals[s[-1]]) for s in steps]
    return sorted(out)


def test_audit_equals_orders_applied_one_by_one(spark):
    long = " ".join(f"w{i}" for i in range(230))
    texts = [long, long, long + " #", "Ab " * 150, None, "", "\x0b\t", "é" * 60 + "A", "é" * 40 + "A", long.upper(), "x " * 250, "x " * 250, "$ " * 5]
    docs = [(i, t, ["s", "t", None, ""][i % 4]) for i, t in enumerate(texts)] + [(50, long, "t"), (50, long, "t"), (None, long, "t"), (None, "q", "only"), (-3, "$ " * 5, "s"), (-3, "$ " * 5, "u"), (60, "word " * 100_000, "s")]
    labels = [(0, 1, 0), (0, 0, 1), (1, 1, None), (3, 0, 0), (50, 1, 1), (None, 1, 1), (10, 1, 0), (11, 1, 1), (12, 0, 1), (-3, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, source string, n int, mask string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    either = {}
    for i, q, t in labels:
        if i is not None:
            q0, t0 = either.get(i, (False, False))
            either[i] = (q0 or q == 1, t0 or t == 1)
    got = filter_audit.audit_filters(frame, known)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == _plain_audit(docs, either)
    assert filter_audit.audit_filters(frame.limit(0), known).count() == 0
    assert sum(r["good_lost"] for r in filter_audit.audit_filters(frame, known.limit(0)).collect()) == 0
