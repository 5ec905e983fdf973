"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Some models describe random strings, one for each alphabet that keys are written in; three describe ordinary tokens: the prose of the documents,
identifiers (joined, cased, numbered words and paths), and words of no language met yet. All are tables of how often a character follows the one or two before it, learned from labelled samples, the prose from all
documents. A token's ratio is the best random log-likelihood less the best ordinary one, summed over its characters, so that length counts as evidence and no length is left out (of short strings of small letters and digits, those with hardly a digit are missed: they look like names). The threshold is fitted on
held-out labelled tokens.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.llm.arrow import map_rows, pieces, strings_of
from paperweave.llm.scratch import cut, drop

#: Labelled strings of each random alphabet, and labelled identifiers; the vocabulary that identifiers are made of: so many words, those that most of all texts have.
RANDOM_STRINGS, IDENTIFIERS, CORPUS_WORDS = 1500, 12_000, 4000
#: Different words that a task holds before it hands them on.
WORDS_AT_ONCE = 100_000
SHORTEST, LONGEST = 8, 44
#: The threshold passes at most this share of held-out ordinary tokens, and is no less than the log odds against a token being a secret.
PASSED, LEAST_ODDS = 0.0005, 9.2
CHARS_AT_ONCE = 1 << 19
KINDS = ("assign", "access", "hex", "markov")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORD = re.compile("[A-Za-z]+")
_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = {c: i for i, c in enumerate(_CHARS)}
_OTHER = len(_CHARS)
_START = _OTHER + 1
_SIDE = _START + 1
_BYTE_CODES = np.array([_CODE.get(chr(b), _OTHER) for b in range(256)], np.int32)
_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", _CHARS[26:62], _CHARS[:26] + _CHARS[52:62], _CHARS[:62], _CHARS[:52], _CHARS[:64], _CHARS[:62] + "-_")
# Words that programs name things with, beside those of the corpus.
_PROGRAM_WORDS = """abstract access account action active adapter address admin agent alert alias amount api app archive array async audit auth author available backup balance base batch bean body boolean
buffer build builder button byte cache call callback cancel case category change channel char check child class client clock close code collection color column command common config connection console constant
container content context control controller convert copy count country create current custom customer data database date default delete delta description detail device dialog document domain download edit element
email enable end engine entity entry enum error event example exception execute export extend factory false field file filter final find first flag float folder font format frame function gateway generate get global group
handler hash header height hidden host icon identifier image import index info init input insert instance integer interface internal invalid item iterator java job json key label language last layer layout length level library line
link list listener load local location lock log login long loop main manager map master max media member memory menu message meta method min mode model module monitor month name network next node null number object offset open operation option
order output owner package page panel param parent parse password path pattern payment pool port position post prefix price print private process product profile progress project property provider proxy public query queue random range read
record reference region register release remote remove rename render report repository request reset resource response result return role root route row rule runtime sample schedule schema scope score script search second section secure select
send server service session set setting shared show simple singleton size socket sort source start state static status step storage store stream string style submit success summary switch sync system table tag target task template test text theme thread
time title token tool total trace transaction transfer tree trigger type unique unit update upload url user util valid value variable vector version view visible web widget width window word worker write xml year zone""".split()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of the fixed patterns, sorted. A match too short for its kind is dropped but still uses up its characters."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]  # a run of 32 and more is what a run is that passes
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def _places(token: str) -> list[int]:
    """Of each character: the number of itself and the two before it."""
    codes = [_START, _START, *(_CODE.get(c, _OTHER) for c in token)]
    return [(a * _SIDE + b) * _SIDE + c for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)]


def random_sample(alphabet: str, n: int = RANDOM_STRINGS, seed: int = 7) -> list[str]:
    """Strings labelled random."""
    draw = random.Random(f"{seed} {alphabet}")
    return ["".join(draw.choices(alphabet, k=draw.randint(SHORTEST, LONGEST))) for _ in range(n)]


def identifier_sample(words: list[str], n: int = IDENTIFIERS, seed: int = 7) -> list[str]:
    """Tokens labelled ordinary: words joined in the ways of programs, paths and settings, numbers and dates, rules of one sign."""
    draw = random.Random(seed)
    vocabulary = [w.lower() for w in words if 1 < len(w) <= 14] or _PROGRAM_WORDS

    def some(least: int, most: int) -> list[str]:
        return [draw.choice(_PROGRAM_WORDS if draw.random() < 0.6 else vocabulary) for _ in range(draw.randint(least, most))]

    def number() -> str:
        return "".join(draw.choices("0123456789", k=draw.choice((1, 1, 2, 2, 3, 4, 4, 5, 6))))

    styles = (
        lambda: "".join(w.capitalize() for w in some(2, 6)),
        lambda: "".join([some(1, 1)[0], *(w.capitalize() for w in some(1, 5))]),
        lambda: "_".join(some(2, 6)),
        lambda: "_".join(some(2, 6)).upper(),
        lambda: "-".join(some(2, 6)),
        lambda: "/".join(some(2, 7)),
        lambda: "".join(some(1, 4)),
        lambda: "".join(some(1, 2)).upper(),
        lambda: "=".join(some(2, 2)) + draw.choice(("", number())),
        lambda: "".join(w.capitalize() for w in some(1, 3)) + number(),
        lambda: "_".join([*some(1, 3), number()]),
        lambda: "-".join([*some(1, 3), f"v{number()}"]),
        lambda: "-".join([*some(1, 2), number()]),
        lambda: "".join(draw.choices("0123456789", k=draw.randint(1, 20))),
        lambda: f"{draw.randint(1900, 2099)}-{draw.randint(1, 12):02d}-{draw.randint(1, 31):02d}",
        lambda: "-".join(number() for _ in range(draw.randint(2, 5))),
        lambda: draw.choice("-=_+/") * draw.randint(1, 60),
    )
    return [draw.choice(styles)() for _ in range(n)]


def unknown_words(n: int = RANDOM_STRINGS, seed: int = 7) -> list[str]:
    """Lower-case letters, some with a capital before them: words of no language met yet are ordinary, so letters of one case are no evidence."""
    draw = random.Random(seed)
    words = ["".join(draw.choices(_CHARS[26:52], k=draw.randint(1, LONGEST))) for _ in range(n)]
    return [w.capitalize() if draw.random() < 0.3 else w for w in words]


def _counted(tokens: list[str]) -> Counter:
    out: Counter = Counter()
    for t in tokens:
        out.update(_places(t))
    return out


def _tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of bytes that begin and end outside a token: codes, where tokens start and end, and the place of each character of them, token after token."""
    codes = _BYTE_CODES[np.frombuffer(data, np.uint8)]
    inside = codes != _OTHER
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    at = np.flatnonzero(inside)
    first = codes[at - 1] == _OTHER
    one = np.where(first, _START, codes[at - 1])
    second = np.concatenate([[False], first[:-1]])
    two = np.where(first | second, _START, codes[at - 2])
    return codes, starts, ends, (two * _SIDE + one) * _SIDE + codes[at]


def _bare(text: str) -> str:
    for start, end, _ in reversed(base_spans(text)):
        text = f"{text[:start]} {text[end:]}"
    return text


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > CHARS_AT_ONCE:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


@dataclass(frozen=True)
class Models:
    """Log-likelihoods of a character after the two before it, a column for each model; the first `randoms` columns are of random strings."""

    table: np.ndarray
    randoms: int
    threshold: float

    def ratio(self, token: str) -> float:
        return float(self._ratios(self.table[_places(token)].sum(axis=0, dtype=np.float64)[None])[0])

    def _ratios(self, sums: np.ndarray) -> np.ndarray:
        return sums[:, : self.randoms].max(axis=1) - sums[:, self.randoms :].max(axis=1)

    def found(self, texts: list[str]) -> Iterator[list[tuple[int, int]]]:
        """Where the tokens over the threshold are in each text, in code points."""
        for some in _blocks(texts):
            data = b"\n" + b"\n".join(t.encode("ascii", "replace") for t in some) + b"\n"
            begins = np.cumsum([1, *(len(t) + 1 for t in some)])
            _, starts, ends, places = _tokens(data)
            hits = np.zeros(0, np.int64)
            if len(starts):
                lengths = ends - starts
                offsets = np.cumsum(lengths) - lengths
                ratios = np.empty(len(starts))
                for a in range(0, len(starts), 1 << 15):  # a million numbers or so at a time, but for very long tokens
                    part = slice(a, min(len(starts), a + (1 << 15)))
                    low, high = offsets[part][0], offsets[part][-1] + lengths[part][-1]
                    ratios[part] = self._ratios(np.add.reduceat(self.table[places[low:high]], offsets[part] - low, axis=0))
                hits = np.flatnonzero(ratios > self.threshold)
            text = np.searchsorted(begins, starts[hits], "right") - 1
            out: list[list[tuple[int, int]]] = [[] for _ in some]
            for i, s, e in zip(text.tolist(), starts[hits].tolist(), ends[hits].tolist(), strict=True):
                out[i].append((s - int(begins[i]), e - int(begins[i])))
            yield from out


def _logs(counts: Counter, order: int, unseen: float = 0.5) -> np.ndarray:
    """Log-likelihoods by place. Two characters back are trusted as far as they were seen; one back is smoothed by a part of a count."""
    seen = np.zeros(_SIDE**3)
    seen[list(counts)] = list(counts.values())
    seen = seen.reshape(_SIDE, _SIDE, _SIDE)
    near = seen.sum(axis=0) + unseen
    near[:, _START] = 0
    near /= near.sum(axis=1, keepdims=True)
    if order == 1:
        out = np.broadcast_to(near, seen.shape)
    else:
        weight = 4.0
        out = (seen + weight * near) / (seen.sum(axis=2, keepdims=True) + weight)
    return np.log(np.maximum(out, 1e-9)).reshape(-1).astype(np.float32)


def train(docs: DataFrame) -> Models:
    """The models and their threshold. Tasks count the characters of all documents' tokens outside base spans, and the texts that each word is in; at most 69^3 sums and the CORPUS_WORDS words that most texts have come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIDE**3, np.int64)
        words: Counter = Counter()
        for batch in pieces(batches, 256):
            for some in _blocks([_bare(t) for t in strings_of(batch)]):
                total += np.bincount(_tokens(b"\n" + b"\n".join(t.encode("ascii", "replace") for t in some) + b"\n")[3], minlength=_SIDE**3)
                for text in some:
                    words.update(set(_WORD.findall(text)))
            if len(words) > WORDS_AT_ONCE:
                yield counted_words(words)
                words.clear()
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.nulls(len(found), pa.string()), pa.array(total[found], pa.int64())], ["place", "word", "n"])
        yield counted_words(words)

    def counted_words(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int32()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["place", "word", "n"])

    counted = cut(docs.select("text").mapInArrow(count, "place int, word string, n long").groupBy("place", "word").agg(F.sum("n").alias("n")))
    prose = Counter(dict(map(tuple, counted.filter("place is not null").select("place", "n").collect())))
    words = sorted(r["word"] for r in counted.filter("word is not null").orderBy(F.desc("n"), "word").limit(CORPUS_WORDS).collect())
    drop(counted)
    return models(prose, words)


def models(prose: Counter, words: list[str]) -> Models:
    """Words of the corpus are dealt to training and fitting; the threshold is the ratio that PASSED of the held-out ordinary tokens exceed."""
    draw = random.Random(3)
    words = draw.sample(words, len(words))
    half = len(words) // 2
    table = np.stack([*(_logs(_counted(random_sample(a)), 1) for a in _ALPHABETS), _logs(prose, 2), _logs(_counted(identifier_sample(words[:half])), 2), _logs(_counted(unknown_words()), 1, 0.01)], axis=1)
    unfitted = Models(table, len(_ALPHABETS), 0.0)
    held_out = [*identifier_sample(words[half:], seed=8), *words[half:]]
    ratios = np.sort([unfitted.ratio(t) for t in held_out])
    return Models(table, len(_ALPHABETS), max(LEAST_ODDS, float(ratios[int((1 - PASSED) * (len(ratios) - 1))])))


def spans_of(texts: list[str], model: Models, threshold: float | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Base spans and, of the tokens that meet none of them, those that the models take for random; sorted, for each text."""
    model = model if threshold is None else replace(model, threshold=threshold)
    for text, found in zip(texts, model.found(texts), strict=True):
        base = base_spans(text)
        more = found
        if base and found:
            starts = np.array([s for s, _, _ in base])
            reach = np.maximum.accumulate([e for _, e, _ in base])
            before = np.searchsorted(starts, [e for _, e in found]) - 1
            more = [f for f, i in zip(found, before.tolist(), strict=True) if i < 0 or reach[i] <= f[0]]
        yield sorted(base + [(s, e, 3) for s, e in more], key=lambda s: (s[0], s[2], s[1])) if more else base


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame, threshold: float | None = None) -> DataFrame:
    """Rows of docs (doc_id, text; other columns are ignored) as doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    spans lists kind:start:end in code points. Rows are independent once the models are trained: no shuffle. A null text is an
    empty one and has no spans; an empty table gives no rows; null doc_ids stay; repeated rows are judged one by one; very long texts are scanned whole; a ratio equal to the
    threshold is no secret. Without a threshold the fitted one holds.
    """
    model = train(docs)

    def make(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")}
        for spans in spans_of(strings_of(batch), model, threshold):
            kinds = Counter(k for _, _, k in spans)
            base = _joined([s for s in spans if s[2] < 3])
            for name, value in zip(out, (kinds[0], kinds[1], kinds[2], hashlib.sha256(base.encode()).hexdigest(), _joined(spans), kinds[3]), strict=True):
                out[name].append(value)
        return {"doc_id": batch.column("doc_id"), **out}

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"
    return map_rows(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, schema, rows=256)


def redact(docs: DataFrame, mark: str = "[secret]", threshold: float | None = None) -> DataFrame:
    """docs with every secret of the text replaced by a mark, and n_chars, if there, counted anew. Of overlapping spans the union is replaced. Null and empty texts stay as they are;
    all rows and other columns stay, whatever their names; very long texts are scanned whole; an empty table gives no rows."""
    model = train(docs)

    def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for start, end, _ in spans:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 256):
            some = texts.slice(at, 256).to_pylist()
            told = [t or "" for t in some]
            out += [None if t is None else clean(t, spans) for t, spans in zip(some, spans_of(told, model, threshold), strict=True)]
        return pa.array(out, pa.string())

    out = docs.withColumn("text", cleaned("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
