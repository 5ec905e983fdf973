"""Best-fit packing of token sequences by exact complements.

Documents become pieces of at most `capacity` tokens. Only how many pieces have each length matters for the
packing, so the plan is made on that histogram of at most `capacity` rows, whatever the input: for each length,
longest first, the gap it leaves is looked up in an index of single, pair and triple sums, and combinations that fill
the gap exactly are consumed as long as their counts last; what remains is packed best-fit, longest first, still by counts.
The plan is a list of runs (lengths of one sequence, how many such sequences). Spark numbers the pieces of
each length and looks up, by length and number, the sequence and offset.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperweave.llm.arrow import pieces as arrow_pieces
from paperweave.llm.arrow import strings_of
from paperweave.llm.scratch import cut, salt

CAPACITY = 2048
#: Groups, at least, in which the pieces of one length are numbered, and how many of them a group has, about, where there are more.
BUCKETS, BUCKET_ROWS = 256, 50_000
#: Segments of the plan that are broadcast at most (4 MB); more are joined by a shuffle on the length.
BROADCAST_SEGMENTS = 100_000


class _Worker:
    """The tokenizer of a tokenizers file, as loaded. Where its vocabulary is a plain byte-level one whose ids are the order of merges, as is checked
    here, texts up to U+00FF that hold none of its added tokens are encoded from the same vocabulary by tiktoken, which gives equal ids several times as fast."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"] if t["content"]]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I)  # a tokenizer may look for them in normalized text
        self.fast = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, split = told["model"], told.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or told.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            return None
        special = {t["content"] for t in told["added_tokens"]}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in merges]
        if order != sorted(order) or len(order) + 256 != len(ranks):
            return None
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        for text in texts:
            fast = self.fast
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                fast = None
            if self.added.search(text):
                fast = None
            ids = fast(text) if fast else self.tokenizer.encode(text, add_special_tokens=False).ids
            yield np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def _worker(path: str) -> _Worker:
    return _Worker(path)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Rows of docs as doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary): each document's
    ids and the end id; if longer than capacity, in pieces of that length, of which the first may be shorter. A null text is an empty one."""
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * keep_ids
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        worker = _worker(tokenizer_path)
        for batch in arrow_pieces(batches, 128):
            rows: list[list] = [[] for _ in range(5 + keep_ids)]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), worker.ids(strings_of(batch)), strict=True):
                ids += end
                n = len(ids) // 4
                first = n % capacity or capacity
                at = 0
                for k, stop in enumerate(range(first, n + 1, capacity)):
                    part = ids[4 * at : 4 * stop]
                    for column, value in zip(rows, (doc_id, k, at, stop - at, zlib.crc32(part), part), strict=False):
                        column.append(value)
                    at = stop
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=False)], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


class Sums:
    """An index of the lengths at hand: their single, pair and triple sums up to `most`, each kind the bits of one number. Lengths that run out leave
    it at once; sums of two and three are made anew when a tenth of the lengths is gone, and till then may be of a gone one, which the counts tell."""

    def __init__(self, counts: np.ndarray, most: int):
        self.counts, self.most = counts, most
        self.lengths = [int(x) for x in np.flatnonzero(counts[: most + 1]) if x]
        self.single = sum(1 << x for x in self.lengths)
        # bit y of `mirrored` >> (most - s) stands for the length s - y
        self.mirrored = sum(1 << (most - x) for x in self.lengths)
        self._combine()

    def _combine(self) -> None:
        self.combined = len(self.lengths)
        within = (1 << (self.most + 1)) - 1
        self.pair = self.triple = 0
        for x in self.lengths:
            self.pair |= self.single << x & within
        for x in self.lengths:
            self.triple |= self.pair << x & within

    def refresh(self, *lengths: int) -> None:
        """Takes out those of the lengths that have run out."""
        for x in lengths:
            if not self.counts[x] and self.single >> x & 1:
                self.lengths.remove(x)
                self.single ^= 1 << x
                self.mirrored ^= 1 << (self.most - x)
        if 10 * len(self.lengths) <= 9 * self.combined:
            self._combine()

    def pairs(self, total: int, low: int, high: int) -> Iterator[tuple[int, int]]:
        """Lengths y and total - y, for low <= y <= high, rising."""
        if not self.pair >> total & 1:
            return
        both = (self.single & self.mirrored >> (self.most - total) & ((1 << (high + 1)) - 1)) >> low << low
        while both:
            y = (both & -both).bit_length() - 1
            yield y, total - y
            both &= both - 1

    def fill(self, length: int, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that sum to the gap beside `length`, as far as counts allow it once. The most
        even sums come first: short pieces fit nearly anywhere and are kept for gaps that nothing else fills."""

        def enough(*parts: int) -> bool:
            return all(self.counts[x] >= n for x, n in Counter((length, *parts)).items())

        if self.single >> gap & 1 and enough(gap):
            return (gap,)
        for x, y in self.pairs(gap, (gap + 1) // 2, gap - 1):
            if enough(x, y):
                return x, y
        if self.triple >> gap & 1:
            for x in self.lengths:
                if gap <= 3 * x and x < gap - 1 and self.pair >> (gap - x) & 1:
                    rest = gap - x
                    for y, z in self.pairs(rest, (rest + 1) // 2, min(x, rest - 1)):
                        if enough(x, y, z):
                            return x, y, z
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths in one sequence, longest first; number of sequences) that use every piece once."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    runs: list[tuple[tuple[int, ...], int]] = []
    if counts[capacity]:
        runs.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    residual: list[tuple[int, int]] = []
    sums = Sums(counts, capacity)
    for length in range(capacity - 1, 0, -1):
        while counts[length]:
            parts = sums.fill(length, capacity - length)
            if parts is None:
                residual.append((length, int(counts[length])))
                counts[length] = 0
                sums.refresh(length)
                break
            need = Counter((length, *parts))
            times = min(int(counts[x]) // n for x, n in need.items())  # uses up one length, so there are at most `capacity` runs
            for x, n in need.items():
                counts[x] -= n * times
            sums.refresh(*need)
            runs.append(((length, *parts), times))
    open_bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(Counter)
    for length, n in residual:
        while n:
            gap = min((g for g in open_bins if g >= length), default=0)
            if not gap:
                each = capacity // length
                for size, times in ((each, n // each), (n % each, 1)):
                    if size and times:
                        open_bins[capacity - size * length][(length,) * size] += times
                break
            lengths, have = next(iter(open_bins[gap].items()))
            times = min(n, have)
            open_bins[gap][lengths] -= times
            if have == times:
                del open_bins[gap][lengths]
                if not open_bins[gap]:
                    del open_bins[gap]
            open_bins[gap - length][(*lengths, length)] += times
            n -= times
    return runs + [(lengths, n) for bins in open_bins.values() for lengths, n in bins.items()]


def segments(runs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, end number, first sequence, offset): where the pieces of a length with those numbers go."""
    out, used, sequence = [], Counter(), 0
    for lengths, times in runs:
        offset = 0
        for length in lengths:
            out.append((length, used[length], used[length] + times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, buckets: int = BUCKETS, keep_ids: bool = False) -> DataFrame:
    """Rows of docs (doc_id, text; other columns are ignored) as pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Pieces are written once. To the driver comes the histogram of lengths (at most `capacity` rows); back goes the plan.
    Pieces of one length are numbered in `buckets` groups or more, as their number demands, from counts of (length, bucket).
    Null and empty texts are pieces of the end id alone; repeated rows are packed one by one; pieces of one length are alike, so ties between them are settled by their ids; very
    long texts are encoded whole and cut; null doc_ids stay; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = cut(tokenized_pieces(docs, tokenizer_path, capacity, end_id, keep_ids))
    histogram = {r[0]: r[1] for r in rows.groupBy("length").agg(F.count("*")).collect()}
    buckets = max(buckets, max(histogram.values(), default=0) // BUCKET_ROWS)
    rows = rows.withColumn("bucket", salt(buckets, "doc_id", "piece", "ids_crc32"))
    where = segments(plan(histogram, capacity))
    places = spark.createDataFrame(where, "length int, first long, end long, sequence long, offset long")
    if len(where) <= BROADCAST_SEGMENTS:
        places = F.broadcast(places)
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    inside = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"])
    numbered = numbered.withColumn("number", F.col("from") + F.col("at"))
    at = (numbered["length"] == places["length"]) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("end"))
    return numbered.join(places, at).select(
        "doc_id", "piece", "start", numbered["length"].cast("long").alias("length"), "ids_crc32", (F.col("sequence") + F.col("number") - F.col("first")).alias("sequence_id"), "offset", *["ids"] * keep_ids
    )
