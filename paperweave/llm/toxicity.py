"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine.

Two words are as alike as the 3-letter subsequences they share, each weighted by LAMBDA to the power of the stretch it takes, so that
gaps and inserted characters weaken a likeness without ending it. Landmarks are words that tell labelled toxic
documents from others, and some ordinary ones. A text is described by its greatest likeness to each landmark over all its words and
spelled-out runs of single letters; the Nystroem map of the landmarks' kernel makes that a vector for a linear machine with squared
hinge loss, whose decision is turned into a probability by a logistic curve.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.llm.arrow import map_rows, pieces, strings_of
from paperweave.llm.scratch import cut

#: Labelled documents of either class that are learned from at most.
SAMPLE_TOXIC, SAMPLE_OTHER = 3000, 5000
LANDMARKS_TELLING, LANDMARKS_ORDINARY = 72, 24
LEAST_DOCUMENTS = 4
LAMBDA = 0.7
STRETCH = 6
LONGEST = 24
#: A word less alike than this to every landmark counts as unlike all.
LIKENESS = 0.35
#: Landmarks that share a bound.
GROUP = 8
#: Tokens that a worker remembers.
WORDS_KEPT = 300_000
_EDGE = ".,;:!?\"'()[]{}<>*_#&-"
_SPELLED = re.compile(r"\b\w (?:\w )+\w\b")
_WEIGHT = {n: LAMBDA**n for n in range(3, STRETCH + 1)}


def subsequences(word: str) -> dict[str, float]:
    """The word's 3-letter subsequences within STRETCH characters, with their weights, scaled to length 1. A word of fewer letters is padded."""
    word = f"{word}$$" if len(word) < 3 else word
    out: dict[str, float] = defaultdict(float)
    for i in range(len(word) - 2):
        first = word[i]
        for j, k in combinations(range(i + 1, min(len(word), i + STRETCH)), 2):
            out[first + word[j] + word[k]] += _WEIGHT[k - i + 1]
    norm = sum(v * v for v in out.values()) ** 0.5
    return {u: v / norm for u, v in out.items()}


def segments(token: str) -> list[str]:
    """A token without punctuation at its edges, and, if signs are left inside it, without those too; one longer than LONGEST as overlapping parts."""
    token = token.strip(_EDGE)
    if not token:
        return []
    forms = [token] if token.isalnum() else [token, *filter(None, ["".join(filter(str.isalnum, token))])]
    return [f[i : i + LONGEST] for f in forms for i in range(0, max(1, len(f) - LONGEST // 2), LONGEST // 2 if len(f) > LONGEST else LONGEST)]


def tokens(text: str) -> set[str]:
    text = text.lower()
    return {*text.split(), *(m.replace(" ", "") for m in _SPELLED.findall(text))}


def _codes() -> np.ndarray:
    """Bytes of Latin-1 as 6-bit codes: letters and marked letters have their own, digits share one, as do all others; a line end is 0."""
    out = np.full(256, 63, np.uint32)
    out[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = np.arange(1, 27)
    out[range(0xDF, 0x100)] = np.arange(27, 60)
    out[[ord(c) for c in "0123456789"]] = 62
    out[10] = 0
    return out


_CODES = _codes()
_PATTERNS = [(j, k) for j in range(1, STRETCH - 1) for k in range(j + 1, STRETCH)]
#: Of a word's length: the least norm that its subsequences can have, which is reached if all differ.
_NORMS = np.array([max(1e-9, sum(_WEIGHT[k + 1] ** 2 for i in range(n) for _, k in _PATTERNS if i + k < n) ** 0.5) for n in range(LONGEST + 1)])


class Landmarks:
    """Likeness of words to landmark words, by an index of the landmarks' subsequences; remembers words met lately, so many and no more."""

    def __init__(self, words: list[str]):
        self.words = words
        self.index: dict[str, list[tuple[int, float]]] = defaultdict(list)
        # the most that a landmark of each group gives a subsequence; in alphabetic order words of one stem share a group
        self.most = np.zeros((1 + len(words) // GROUP, 1 << 18), np.float32)
        for k, (w, i) in enumerate(sorted((w, i) for i, w in enumerate(words))):
            for u, v in subsequences(w).items():
                self.index[u].append((i, v))
                x, y, z = (int(_CODES[c]) for c in u.encode("latin-1", "replace"))
                at = k // GROUP, x << 12 | y << 6 | z
                self.most[at] = max(v, self.most[at])
        self.most_of_all = self.most.max(axis=0)
        self.alike: dict[str, np.ndarray] = {}
        self.unlike: set[str] = set()

    def word(self, word: str) -> np.ndarray:
        out = np.zeros(len(self.words), np.float32)
        for u, v in subsequences(word).items():
            for i, w in self.index.get(u, ()):
                out[i] += v * w
        return out

    def bounds(self, words: list[str], tables: list[np.ndarray] | None = None) -> np.ndarray:
        """What the words' likenesses to any landmark cannot exceed: every subsequence counted with the most that any landmark, of one group
        for each table, gives it."""
        gap = "\n" * STRETCH
        codes = _CODES[np.frombuffer((gap.join(words) + gap).encode("latin-1", "replace"), np.uint8)]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n = len(codes) - STRETCH + 1
        starts = np.concatenate([[0], np.cumsum(lengths + STRETCH)[:-1]])
        places = [codes[:n] << 12 | codes[j : n + j] << 6 | codes[k : n + k] for j, k in _PATTERNS]
        best = np.zeros(len(words), np.float32)
        for table in tables or [self.most_of_all]:
            total = np.zeros(n, np.float32)
            for at, (_, k) in zip(places, _PATTERNS, strict=True):
                total += table[at] * np.float32(_WEIGHT[k + 1])
            np.maximum(best, np.add.reduceat(total, starts), out=best)
        return best / _NORMS[lengths] + 1e-4

    def may_be_alike(self, words: list[str]) -> np.ndarray:
        """Which words no bound rules out: first the loose one over all landmarks, then, for those left, the closer ones of the groups. Very short words stay."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        may = (self.bounds(words) >= LIKENESS) & (lengths >= 3)
        left = np.flatnonzero(may)
        if len(left):
            may[left] = self.bounds([words[i] for i in left.tolist()], list(self.most)) >= LIKENESS
        return may | (lengths < 3)

    def meet(self, found: set[str]) -> None:
        """Compares tokens not remembered. Most words are ruled out by their bound, all at once; the others are compared one by one."""
        if len(self.alike) > WORDS_KEPT // 8 or len(self.unlike) > WORDS_KEPT:
            self.alike.clear()
            self.unlike.clear()
        new = [t for t in found - self.unlike if t not in self.alike]
        parts = [(t, s) for t in new for s in segments(t)]
        if parts and self.words:
            for (t, s), m in zip(parts, self.may_be_alike([s for _, s in parts]).tolist(), strict=True):
                if m:
                    v = self.word(s)
                    if v.max() >= LIKENESS:
                        self.alike[t] = np.maximum(v, self.alike[t]) if t in self.alike else v
        self.unlike.update(t for t in new if t not in self.alike)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's greatest likeness to each landmark."""
        found = [tokens(t) for t in texts]
        self.meet(set().union(*found))
        none = np.zeros(len(self.words), np.float32)
        return [np.max([self.alike[t] for t in hits], axis=0) if (hits := f & self.alike.keys()) else none for f in found]


@dataclass(frozen=True)
class Model:
    landmarks: list[str]
    weights: np.ndarray  # of the pooled likenesses: the machine's weights through the Nystroem map
    slope: float
    offset: float

    def score(self, pooled: np.ndarray) -> float:
        z = self.slope * float(pooled @ self.weights) + self.offset if len(self.landmarks) else self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text is divisible by 5."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of at most SAMPLE_TOXIC + SAMPLE_OTHER labelled rows that are not held out, those of least hash; written once."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic")
    parts = [usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_OTHER))]
    chosen = parts[0].unionByName(parts[1])
    return cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")))


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias) by Newton steps; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = ridge * np.eye(x.shape[1])
    reg[-1, -1] = 1e-9
    for _ in range(50):
        inside = y * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        new = np.linalg.solve(reg + a.T @ x[inside], a.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope and offset of the curve from decisions to probabilities, with the usual smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([f, np.ones_like(f)], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - t) + 1e-6 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Tasks count words and pool likenesses of the sample; the driver gets a few hundred words and one short vector for each sampled document."""
    sample = labelled_sample(docs, labels)
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").agg(F.count("*")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        share = 1e-6 if not sizes.get(1) else 1 - 1e-6
        return Model([], np.zeros(0), 0.0, float(np.log(share / (1 - share))))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            found = [(w, y) for text, y in zip(strings_of(batch), batch.column("toxic").to_pylist(), strict=True) for w in {s for t in tokens(text) for s in segments(t)}]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found]), pa.array([y for _, y in found], pa.int32())], ["word", "toxic"])

    seen = sample.mapInArrow(words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("up"), F.count("*").alias("n"))
    up, down = F.col("up") / F.lit(sizes[1]), (F.col("n") - F.col("up")) / F.lit(sizes[0])
    telling = F.sqrt("up") * F.log((up + 1e-4) / (down + 1e-4))
    best = seen.filter(F.col("up") >= LEAST_DOCUMENTS).select("word", telling.alias("z")).filter("z > 0").orderBy(F.desc("z"), "word").limit(8 * LANDMARKS_TELLING).collect()
    common = seen.select("word", "n").orderBy(F.desc("n"), "word").limit(LANDMARKS_ORDINARY).collect()

    chosen: list[str] = []
    vectors: list[dict[str, float]] = []
    for w in [r["word"] for r in best]:
        if len(chosen) == LANDMARKS_TELLING:
            break
        v = subsequences(w)
        if all(sum(x * o.get(u, 0) for u, x in v.items()) < 0.8 for o in vectors):
            chosen.append(w)
            vectors.append(v)
    chosen += [r["word"] for r in common if r["word"] not in chosen]

    def pool(batch: pa.RecordBatch) -> dict[str, object]:
        marks = Landmarks(chosen)
        return {"toxic": batch.column("toxic"), "pooled": pa.array(marks.texts(strings_of(batch)), pa.list_(pa.float32()))}

    rows = map_rows(sample, pool, "toxic int, pooled array<float>").collect()
    x = np.array([r["pooled"] for r in rows], np.float64)
    y = np.array([2 * r["toxic"] - 1 for r in rows], np.float64)
    marks = Landmarks(chosen)
    kernel = np.array([marks.word(w) for w in chosen], np.float64)
    values, basis = np.linalg.eigh((kernel + kernel.T) / 2)
    nystroem = basis @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ basis.T
    weight = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w = _squared_hinge(x @ nystroem, y, weight)
    through = nystroem @ w[:-1]
    slope, offset = _logistic(x @ through + w[-1], y)
    return Model(chosen, through, slope, slope * float(w[-1]) + offset)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with columns held_out, score and predicted, which replace columns of those names.

    labels: doc_id, toxic. Only the text goes into a score, and the whole of it. Rows are independent once the model is trained: no shuffle. Null and empty texts get the
    score of a text unlike all landmarks; without labels of both classes all rows get the same score; repeated rows score alike; very long texts are pooled a word at a time; rows with a null
    doc_id count as not held out; an empty table gives no rows.
    """
    model = train(docs, labels)
    docs = docs.select(*(c for c in docs.columns if c not in ("held_out", "score", "predicted")))
    scores = _scorer(model)
    out = docs.withColumn("held_out", held_out()).withColumn("score", scores(F.coalesce("text", F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


_kept: dict[str, Landmarks] = {}


def _scorer(model: Model):
    name = "\n".join(model.landmarks)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        from paperweave.llm import toxicity

        marks = toxicity._kept.get(name)
        if marks is None:
            toxicity._kept.clear()
            marks = toxicity._kept[name] = Landmarks(model.landmarks)
        scores = []
        for at in range(0, len(texts), 256):
            scores += [model.score(x) for x in marks.texts(texts.slice(at, 256).to_pylist())]
        return pa.array(scores, pa.float64())

    return scores
