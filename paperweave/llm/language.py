"""Languages of words and texts by a linear-chain conditional random field.

A word is a run of letters. Its features are affixes and n-grams (all runs of one to four characters of the lower-cased word between edge marks; those at an edge are its
affixes) and, from a lexicon of each language's frequent words, the languages that have it. Feature weights and transitions between languages of neighbouring words are
learned together, by maximum likelihood, on a bounded sample of labelled windows, half of them spliced from windows of several languages, so that the field has seen text that
switches. Forward-backward over a whole text gives each word's probability of each language; a text's language is the one with the greatest mean of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from paperweave.llm.arrow import pieces, strings_of
from paperweave.llm.scratch import cut
from paperweave.llm.words import _power, mix

#: Labelled documents of each language that are learned from, about; windows of each, and words of a window at most.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS, WINDOW_WORDS = 400, 4, 24
#: Frequent words of each language in the lexicon, from at least so many windows.
LEXICON_WORDS, LEAST_WINDOWS = 400, 3
#: n-grams share so many weights for each language.
BUCKETS = 1 << 17
LONGEST_GRAM = 4
PENALTY = 0.1
STEPS = 40
#: Words whose messages are passed in one vector operation; code points whose n-grams are made at once.
SEGMENT = 32
CHARS_AT_ONCE = 1 << 20
UNDETERMINED = "und"
_EDGE = 1
_tables: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: is it a letter, and its lower case (itself where that is longer than one)."""
    if not _tables:
        every = [chr(i) for i in range(0x110000)]
        _tables["letter"] = np.fromiter((c.isalpha() for c in every), bool, len(every))
        lower = np.arange(len(every), dtype=np.uint32)
        for i in np.flatnonzero(_tables["letter"]).tolist():
            if len(low := every[i].lower()) == 1:
                lower[i] = ord(low)
        _tables["lower"] = lower
    return _tables["letter"], _tables["lower"]


@dataclass
class Words:
    """Words of texts in a row: code points, where each word starts and ends, and where each text's words begin (one entry more than texts)."""

    codes: np.ndarray
    first: np.ndarray
    end: np.ndarray
    begins: np.ndarray
    offsets: np.ndarray  # of the texts in codes

    @staticmethod
    def of(texts: list[str]) -> Words:
        letter, lower = _letters()
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = letter[codes]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([np.zeros(1, edge.dtype), edge])
        first, end = edge[::2], edge[1::2]
        offsets = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
        return Words(lower[codes], first, end, np.searchsorted(first, offsets), offsets)


def hashes(codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal words have equal 64-bit hashes, wherever they stand."""
    base = int(first[0]) if len(first) else 0
    some = codes[base : int(end[-1]) if len(end) else 0]
    up, down = _power(len(some) + 1)
    total = np.zeros(len(some) + 1, np.uint64)
    np.cumsum(mix(some.astype(np.uint64) + np.uint64(3)) * up[: len(some)], out=total[1:])
    return mix((total[end - base] - total[first - base]) * down[first - base])


def grams(codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words between edge marks, word by word, and where each word's begin."""
    sizes = (end - first + 2).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    line = np.full(starts[-1] + LONGEST_GRAM, _EDGE, np.uint64)
    place = np.arange(starts[-1]) - np.repeat(starts[:-1], sizes)
    inner = (place > 0) & (place < np.repeat(sizes, sizes) - 1)
    line[: starts[-1]][inner] = codes[(np.repeat(first, sizes) + place - 1)[inner]]
    left = np.repeat(sizes, sizes) - place  # characters from here to the word's end, both marks included
    n = starts[-1]
    rolled, made, there = np.zeros(n, np.uint64), [], []
    for k in range(1, LONGEST_GRAM + 1):
        rolled = rolled * np.uint64(0x100000001B3) + line[k - 1 : n + k - 1]
        made.append((mix(rolled + np.uint64(k << 58)) % np.uint64(BUCKETS)).astype(np.int32))
        there.append(left >= k)
    grid, kept = np.stack(made, axis=1), np.stack(there, axis=1)
    kept[:, 0] &= line[:n] != _EDGE  # an edge mark alone says nothing
    return grid[kept], np.concatenate([[0], np.cumsum(kept.sum(axis=1))])[starts]


@dataclass
class Model:
    languages: list[str]
    lexicon: np.ndarray  # hashes, ascending
    member: np.ndarray  # of each: which languages have it, as numbers
    weights: np.ndarray  # n-gram buckets, then one row for each language's lexicon, then one for no lexicon
    transitions: np.ndarray
    start: np.ndarray

    def lexical(self, words: np.ndarray) -> np.ndarray:
        """Which lexicons have each word, by its hash; the last column tells that none has."""
        out = np.zeros((len(words), len(self.languages) + 1), self.weights.dtype)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, words), len(self.lexicon) - 1)
            out[:, :-1] = self.member[at] * (self.lexicon[at] == words)[:, None]
        out[:, -1] = out[:, :-1].sum(axis=1) == 0
        return out

    def scores(self, words: Words) -> np.ndarray:
        """The weight sum of every word's features for each language, some words at a time; equal words are looked up once."""
        out = np.zeros((len(words.first), len(self.languages)), np.float32)
        total = np.cumsum(words.end - words.first)
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHARS_AT_ONCE)))
            first, end = words.first[at:to], words.end[at:to]
            kinds, sample, which = np.unique(hashes(words.codes, first, end), return_index=True, return_inverse=True)
            ids, begins = grams(words.codes, first[sample], end[sample])
            own = np.add.reduceat(self.weights[ids], begins[:-1], axis=0) + self.lexical(kinds) @ self.weights[BUCKETS:]
            out[at:to] = own[which]
            at = to
        return out

    def probabilities(self, scores: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Forward-backward: each word's probability of each language, given all words of its text.

        Texts are cut into segments, whose transfer matrices are made side by side; messages pass from segment to segment of a text, then into all segments at once. That is exact,
        and a very long text takes little longer than many short ones with as many words."""
        n, many = scores.shape
        if not n:
            return np.zeros((0, many))
        local = np.exp((scores - scores.max(axis=1, keepdims=True)).astype(np.float64)) + 1e-30
        step = np.exp(self.transitions - self.transitions.max())
        begin = np.exp(self.start - self.start.max())
        parts = -(-np.diff(begins) // SEGMENT)
        text = np.repeat(np.arange(len(parts)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = begins[:-1][text] + nth * SEGMENT
        length = np.minimum(SEGMENT, begins[1:][text] - at)
        order = np.argsort(-length, kind="stable")
        at, length, text, nth = at[order], length[order], text[order], nth[order]
        active = [c for i in range(SEGMENT) if (c := int(np.searchsorted(-length, -i, side="left")))]  # segments longer than i stand in front
        opens = (nth == 0)[:, None]
        # transfer matrices, from the message that enters a segment to the one that leaves it; the first word of a text takes the start for a step
        move = np.where(opens[:, :, None], begin[None, None, :], step[None]) * local[at][:, None, :]
        for i, c in enumerate(active[1:], 1):
            some = (move[:c].reshape(-1, many) @ step).reshape(c, many, many) * local[at[:c] + i][:, None, :]
            move[:c] = some / some.sum(axis=(1, 2), keepdims=True)
        in_turn = np.split(np.argsort(nth, kind="stable"), np.cumsum(np.bincount(nth))[:-1])
        enter, leave = np.empty((len(at), many)), np.empty((len(at), many))
        message = np.full((len(parts), many), 1 / many)
        for some in in_turn:
            enter[some] = message[text[some]]
            message[text[some]] = _scaled(np.einsum("ni,nij->nj", enter[some], move[some]))
        message = np.full((len(parts), many), 1 / many)
        for some in reversed(in_turn):
            leave[some] = message[text[some]]
            message[text[some]] = _scaled(np.einsum("nij,nj->ni", move[some], leave[some]))
        out = np.empty((n, many))
        for i, c in enumerate(active):
            stepped = np.where(opens[:c], begin, enter[:c] @ step) if i == 0 else enter[:c] @ step
            enter[:c] = out[at[:c] + i] = _scaled(stepped * local[at[:c] + i])
        for i, c in reversed(list(enumerate(active))):
            out[at[:c] + i] = _scaled(out[at[:c] + i] * leave[:c])
            leave[:c] = _scaled((leave[:c] * local[at[:c] + i]) @ step.T)
        return out

    def texts(self, texts: list[str]) -> tuple[Words, np.ndarray]:
        words = Words.of(texts)
        return words, self.probabilities(self.scores(words), words.begins)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def held_out() -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_windows(docs: DataFrame) -> tuple[list[str], DataFrame]:
    """The languages, and (lang, window) of about SAMPLE_DOCUMENTS documents of each that are not held out: up to SAMPLE_WINDOWS runs of WINDOW_WORDS words each, spread over the whole text."""
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    counts = {r[0]: r[1] for r in known.groupBy("lang").agg(F.count("*")).collect()}
    if not counts:
        return [], docs.sparkSession.createDataFrame([], "lang string, window string")
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(1_000_000))
    shares = {k: min(1_000_000, 1 + 1_500_000 * SAMPLE_DOCUMENTS // n) for k, n in counts.items()}
    share = F.element_at(F.create_map(*(F.lit(x) for kv in shares.items() for x in kv)), F.col("lang"))
    drawn = known.filter(draw < share).select("lang", "text", "doc_id", draw.alias("draw"))
    chosen = drawn.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id"))).filter(F.col("nth") <= SAMPLE_DOCUMENTS)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 16):
            out = []
            for lang, text in zip(batch.column("lang").to_pylist(), strings_of(batch), strict=True):
                words = Words.of([text])
                n = len(words.first)
                many = min(SAMPLE_WINDOWS, -(-n // WINDOW_WORDS))
                for at in {(n - WINDOW_WORDS) * i // (many - 1) if many > 1 else 0 for i in range(many)}:
                    spans = zip(words.first[at : at + WINDOW_WORDS].tolist(), words.end[at : at + WINDOW_WORDS].tolist(), strict=True)
                    out.append((lang, " ".join(text[a:b] for a, b in spans)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([x for _, x in out])], ["lang", "window"])

    return sorted(counts), cut(chosen.select("lang", "text").mapInArrow(windows, "lang string, window string").distinct())


def train(docs: DataFrame) -> Model:
    """The driver gets the sampled windows, at most SAMPLE_DOCUMENTS * SAMPLE_WINDOWS * WINDOW_WORDS words of each language."""
    languages, sample = labelled_windows(docs)
    rows = sorted((r["lang"], r["window"]) for r in sample.collect())
    return fit([w for _, w in rows], [languages.index(x) for x, _ in rows], languages)


def fit(windows: list[str], labels: list[int], languages: list[str], seed: int = 11) -> Model:
    many = len(languages)
    words = Words.of(windows)
    count = np.diff(words.begins)
    label = np.repeat(np.array(labels, np.int64), count) if windows else np.zeros(0, np.int64)
    kinds, sample, which = np.unique(hashes(words.codes, words.first, words.end), return_index=True, return_inverse=True)
    ids, begins = grams(words.codes, words.first[sample], words.end[sample]) if len(kinds) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
    model = Model(languages, *_lexicon(kinds, which, np.repeat(np.arange(len(windows)), count), label, many), np.zeros((BUCKETS + many + 1, many)), np.zeros((many, many)), np.zeros(many))
    if not len(kinds) or many < 2:
        return model
    lexical = model.lexical(kinds)
    chain, gold = _spliced(words.begins, label, np.random.default_rng(seed))
    there = chain >= 0
    sizes = np.diff(begins)
    shapes = [model.weights.shape, model.transitions.shape, model.start.shape]
    edges = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
    one = np.eye(many)
    kind = np.where(there, which[chain], 0)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, transitions, start = (x[a:b].reshape(s) for a, b, s in zip(edges[:-1], edges[1:], shapes, strict=True))
        own = np.add.reduceat(weights[ids], begins[:-1], axis=0) + lexical @ weights[BUCKETS:]
        scores = own[kind]
        top = scores.max(axis=2, keepdims=True)
        local, step = np.exp(scores - top), np.exp(transitions)
        length = chain.shape[1]
        ahead, scale = np.zeros_like(local), np.ones(chain.shape)
        for t in range(length):
            now = (np.exp(start) if t == 0 else ahead[:, t - 1] @ step) * local[:, t]
            now = np.where(there[:, t, None], now, ahead[:, t - 1] if t else 1.0)
            scale[:, t] = np.where(there[:, t], now.sum(axis=1), 1.0)
            ahead[:, t] = now / scale[:, t, None]
        log_all = (np.log(scale) + top[:, :, 0])[there].sum()
        log_gold = np.take_along_axis(scores, gold[:, :, None], 2)[:, :, 0][there].sum()
        d_step = np.zeros((many, many))
        back = np.ones((len(chain), many))
        expected = np.zeros_like(local)
        for t in reversed(range(length)):
            on = there[:, t, None]
            expected[:, t] = np.where(on, _scaled(ahead[:, t] * back), 0)
            if t:
                right = local[:, t] * back
                pair = ahead[:, t - 1][:, :, None] * step * right[:, None, :]
                d_step += (pair / pair.sum(axis=(1, 2), keepdims=True) * on[:, :, None]).sum(axis=0)
                back = np.where(on, _scaled(right @ step.T), back)
        both = there[:, 1:]
        log_gold += transitions[gold[:, :-1][both], gold[:, 1:][both]].sum() + start[gold[:, 0]].sum()
        np.subtract.at(d_step, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        d_start = expected[:, 0].sum(axis=0) - np.bincount(gold[:, 0], minlength=many)
        off = (expected - one[gold])[there]
        d_own = np.stack([np.bincount(kind[there], off[:, j], len(kinds)) for j in range(many)], axis=1)
        d_weights = np.empty_like(weights)
        for j in range(many):
            d_weights[:BUCKETS, j] = np.bincount(ids, np.repeat(d_own[:, j], sizes), BUCKETS)
        d_weights[BUCKETS:] = lexical.T @ d_own
        gradient = np.concatenate([d_weights.ravel(), d_step.ravel(), d_start]) + PENALTY * x
        return float(log_all - log_gold + PENALTY / 2 * (x @ x)), gradient

    x = minimised(loss, np.zeros(edges[-1]))
    model.weights, model.transitions, model.start = (x[a:b].reshape(s) for a, b, s in zip(edges[:-1], edges[1:], shapes, strict=True))
    model.weights = model.weights.astype(np.float32)
    return model


def _lexicon(kinds: np.ndarray, which: np.ndarray, window: np.ndarray, label: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that are among the most frequent of a language, counted in windows, and of which languages."""
    seen = np.unique(np.stack([which, window], axis=1), axis=0, return_index=True)[1]
    counts = np.zeros((len(kinds), many), np.int64)
    np.add.at(counts, (which[seen], label[seen]), 1)
    member = np.zeros((len(kinds), many), np.float32)
    for j in range(many):
        best = np.lexsort((kinds, -counts[:, j]))[:LEXICON_WORDS]
        best = best[counts[best, j] >= LEAST_WINDOWS]
        member[best, j] = 1
    held = member.any(axis=1)
    return kinds[held], member[held]


def _spliced(begins: np.ndarray, label: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Rows of word numbers (-1 behind the end) and their languages: half of the windows as they are, the others in runs cut out of two or three of them."""
    order = draw.permutation(np.flatnonzero(np.diff(begins) > 0))
    whole, mixed = order[: len(order) // 2], order[len(order) // 2 :].tolist()
    rows = [np.arange(begins[i], begins[i + 1]) for i in whole]
    while mixed:
        some = [mixed.pop() for _ in range(min(len(mixed), int(draw.integers(2, 4))))]
        runs = []
        for i in some:
            n = int(begins[i + 1] - begins[i])
            size = int(draw.integers(min(2, n), n + 1))
            at = int(begins[i] + draw.integers(0, n - size + 1))
            runs.append(np.arange(at, at + size))
        rows.append(np.concatenate(runs))
    chain = np.full((len(rows), max(map(len, rows))), -1, np.int64)
    for r, words in enumerate(rows):
        chain[r, : len(words)] = words
    return chain, np.where(chain >= 0, label[chain], 0)


def minimised(loss, x: np.ndarray, steps: int = STEPS, kept: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps with a halving line search."""
    value, slope = loss(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way = -slope
        alphas = []
        for s, y, r in reversed(moves):
            alphas.append(r * (s @ way))
            way = way - alphas[-1] * y
        if moves:
            s, y, r = moves[-1]
            way = way / (r * (y @ y))
        for (s, y, r), a in zip(moves, reversed(alphas), strict=True):
            way = way + (a - r * (y @ way)) * s
        size, down = (1.0 if moves else min(1.0, 1 / max(np.abs(slope).sum(), 1e-12) * 10)), slope @ way
        while True:
            new, new_slope = loss(x + size * way)
            if new <= value + 1e-4 * size * down or size < 1e-10:
                break
            size /= 2
        s, y = size * way, new_slope - slope
        if new > value:
            break
        done = value - new < 1e-6 * abs(value)
        x, value, slope = x + s, new, new_slope
        if done:
            break
        if s @ y > 1e-12:
            moves = [*moves[1 - kept :], (s, y, 1 / (s @ y))]
    return x


_KINDS = {False: "struct<lang: string, score: double>", True: "struct<lang: string, score: double, runs: array<struct<start: int, end: int, lang: string>>>"}


def predict_languages(docs: DataFrame, keep_runs: bool = False) -> DataFrame:
    """docs with columns held_out, lang_pred and score, which replace columns of those names; with keep_runs also runs, the text's stretches of words (code points, end exclusive) by their likeliest language.

    docs: doc_id, text, lang; the model learns from the lang of rows that are not held out. Only the text goes into a prediction, and the whole of it, in one chain; rows are independent once the model
    is trained: no shuffle. The score is the mean probability of the predicted language over the text's words; of equal ones the first in alphabetical order is predicted. Null and empty texts and texts without a letter are `und` with score 0 and no runs; so is every text
    if no lang is known. Rows with a null doc_id count as not held out but are not learned from; repeated rows are predicted alike; very long texts are read some words at a time; an empty table gives no rows.
    """
    model = train(docs)
    own = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score", *(["runs"] if keep_runs else []))]
    told = _predictor(model, keep_runs)(F.coalesce("text", F.lit("")))
    out = docs.select(*own, held_out().alias("held_out"), told.alias("_told"))
    return out.select(*own, "held_out", F.col("_told.lang").alias("lang_pred"), F.col("_told.score").alias("score"), *([F.col("_told.runs").alias("runs")] if keep_runs else []))


def _runs(model: Model, words: Words, text: int, likely: np.ndarray) -> list[dict[str, object]]:
    a, b = int(words.begins[text]), int(words.begins[text + 1])
    own = likely[a:b]
    cuts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [b - a]])
    at = int(words.offsets[text])
    return [{"start": int(words.first[a + x]) - at, "end": int(words.end[a + y - 1]) - at, "lang": model.languages[own[x]]} for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if y > x]


def _predictor(model: Model, keep_runs: bool):
    def some(texts: list[str]) -> list[dict[str, object]]:
        if not model.languages:
            return [{"lang": UNDETERMINED, "score": 0.0, **({"runs": []} if keep_runs else {})} for _ in texts]
        words, probable = model.texts(texts)
        count = np.diff(words.begins)
        sums = np.zeros((len(texts), len(model.languages)))
        if len(probable):
            full = count > 0
            sums[full] = np.add.reduceat(probable, words.begins[:-1][full], axis=0)
        mean = sums / np.maximum(count, 1)[:, None]
        best = mean.argmax(axis=1)
        likely = probable.argmax(axis=1)
        out = []
        for i, n in enumerate(count.tolist()):
            told = {"lang": model.languages[best[i]], "score": float(min(1.0, max(0.0, mean[i, best[i]])))} if n else {"lang": UNDETERMINED, "score": 0.0}
            out.append(told | ({"runs": _runs(model, words, i, likely)} if keep_runs else {}))
        return out

    @F.arrow_udf(_KINDS[keep_runs])
    def told(texts: pa.Array) -> pa.Array:
        from paperweave.llm.language import in_blocks

        out = []
        for block in in_blocks(texts.to_pylist()):
            out += some(block)
        return pa.array(out, pa.struct([("lang", pa.string()), ("score", pa.float64()), *([("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))] if keep_runs else [])]))

    return told


def in_blocks(texts: list[str]) -> Iterator[list[str]]:
    """Texts in groups of about CHARS_AT_ONCE code points; a longer one is a group of its own."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > CHARS_AT_ONCE:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text) + 1
    if some:
        yield some
