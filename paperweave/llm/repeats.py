"""Substring dedup by prefix-partitioned suffix trees over words.

The suffixes of all documents, from each word on, are split into groups that fit memory by prefixes of variable length: how many
suffixes begin with the same two words is counted by hash slot, slots with too many are
split by one more word, and small slots share a group. Within a group the tree is kept only to the depth that matters: a suffix is a leaf named by the hash of its
first `words` words, so equal names are the leaves below one internal node of at least that depth, which is a repeat; what lies deeper decides nothing. The least
doc_id below a node keeps the passage, and the covered words of all later documents go; overlapping
windows of one long repeat add up to the maximal repeat.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.llm.arrow import pieces, texts_of
from paperweave.llm.words import _STEP, BLOCK_BYTES, blocks, grams, mix, word_table

SLOTS = 1 << 16
#: Leaves of one group at most, but for those that even their whole window does not split: about 100 MB while they are sorted.
GROUP_LEAVES = 1_000_000
GROUP_LEAST = 20_000
#: Groups, about, beyond which groups grow instead: a plan of some 80 MB, whatever the input.
MOST_GROUPS = 1 << 20
#: Bytes of text whose leaves a task gathers before it sends them on.
GATHER_BYTES = 8 * BLOCK_BYTES
#: Leaves, about, of one Arrow batch of them.
SENT_LEAVES = 1 << 17
TEXT_BUCKET_BYTES = 8 << 20


class PrefixPlan:
    """A forest over hashed prefixes: SLOTS nodes for the first two words, and below each node with too many suffixes 2**bits nodes, by the hash of the
    prefix that is one word longer. Nodes are numbers; `child` is the first of a node's children, `group` the group of a leaf. As a
    split node has more than `limit` suffixes, there are at most SLOTS + 4 * suffixes / limit nodes a level."""

    def __init__(self) -> None:
        self.bits = np.zeros(SLOTS, np.uint8)
        self.child = np.zeros(SLOTS, np.int64)
        self.group = np.zeros(SLOTS, np.int64)
        self.depth = 2
        self.done = False

    def find(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The node of each suffix that begins at words[at]."""
        prefix = words[at] * _STEP + words[at + 1]
        node = (mix(prefix) & np.uint64(SLOTS - 1)).astype(np.int64)
        deeper = np.arange(len(at))
        for depth in range(2, self.depth):
            deeper = deeper[self.bits[node[deeper]] > 0]
            if not len(deeper):
                break
            prefix[deeper] = prefix[deeper] * _STEP + words[at[deeper] + depth]
            above = node[deeper]
            mask = (np.uint64(1) << self.bits[above].astype(np.uint64)) - np.uint64(1)
            node[deeper] = self.child[above] + (mix(prefix[deeper]) & mask).astype(np.int64)
        return node

    def extend(self, first: int, counts: np.ndarray, limit: int, deepest: int) -> None:
        """Splits those of the nodes from `first` on that have too many suffixes; without such nodes, or at full depth, leaves are dealt to groups."""
        over = np.flatnonzero(counts > limit) if self.depth < deepest else []
        if not len(over):
            self.done = True
            return
        bits = np.ceil(np.log2(2 * counts[over] / limit)).astype(np.int64)
        self.bits[first + over] = bits
        self.child[first + over] = len(self.bits) + np.cumsum(1 << bits) - (1 << bits)
        new = int((1 << bits).sum())
        self.bits, self.child, self.group = (np.concatenate([x, np.zeros(new, x.dtype)]) for x in (self.bits, self.child, self.group))
        self.depth += 1

    def deal(self, counts: np.ndarray, limit: int) -> None:
        """Consecutive leaves share a group until it is full."""
        leaves = np.flatnonzero(self.bits == 0)
        share = (np.cumsum(counts[leaves]) - counts[leaves]) // limit
        self.group[leaves] = np.unique(share, return_inverse=True)[1]


def _windows(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: word hashes, where each text's words begin, the places where a whole window begins, and the text of each."""
    hashes, begins, _, _ = word_table(texts)
    n = np.maximum(np.diff(begins) - words + 1, 0)
    text = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins[:-1], n)
    return hashes, begins, at, text


def plan_groups(docs: DataFrame, words: int) -> PrefixPlan:
    """Counts of all documents' suffixes by prefix, and the groups. Each round counts, in every task, the nodes that the last one made;
    the driver gets their sums, of which there are at most 4 * MOST_GROUPS."""
    plan = PrefixPlan()
    limit, first = None, 0
    known = np.zeros(SLOTS, np.int64)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while not plan.done:

        def count(batches: Iterator[pa.RecordBatch], plan: PrefixPlan = plan, first: int = first) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(plan.bits) - first, np.int64)
            for batch in pieces(batches):
                for _, texts in blocks(texts_of(batch)):
                    hashes, _, at, _ = _windows(texts, words)
                    node = plan.find(hashes, at)
                    total += np.bincount(node[node >= first] - first, minlength=len(total))
            found = np.flatnonzero(total)
            for i in range(0, len(found), 1 << 16):
                some = found[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(first + some), pa.array(total[some])], ["node", "n"])

        rows = docs.select("text").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).toPandas()
        known[rows["node"].to_numpy()] = rows["n"].to_numpy()
        if limit is None:
            limit = max(min(GROUP_LEAVES, max(GROUP_LEAST, int(known.sum()) // (2 * partitions))), int(known.sum()) // MOST_GROUPS)
        made = len(plan.bits)
        plan.extend(first, known[first:], limit, words)
        first = made
        known = np.concatenate([known, np.zeros(len(plan.bits) - made, np.int64)])
    plan.deal(known, limit)
    return plan


def _leaves(docs: DataFrame, words: int, plan: PrefixPlan, buckets: int) -> DataFrame:
    """Blocks of leaves: grp, doc_ids, counts (of leaves of each) and hashes. Of the leaves that a task gathers under one node only those of the least doc_id go to
    the node's group; the others are repeats already and come as blocks with a negative grp, -1 - the bucket of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        groups: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = rows = 0

        def send() -> Iterator[pa.RecordBatch]:
            # what was gathered is let go as it is ordered: an executor's tasks hold this many times over
            h = np.concatenate(names)
            names.clear()
            order = np.argsort(h)
            h = h[order]
            # documents are told by the places of their ids in order, which compare like the ids
            known, place = np.unique(np.concatenate(held), return_inverse=True)
            held.clear()
            d = place.astype(np.int32)[np.concatenate(owners)[order]]
            owners.clear()
            g = np.concatenate(groups)[order]
            groups.clear()
            del order
            first = np.concatenate([[True], h[1:] != h[:-1]])
            begins = np.flatnonzero(first)
            late = d > np.repeat(np.minimum.reduceat(d, begins), np.diff(np.concatenate([begins, [len(h)]])))
            del begins
            # of several leaves of the least document any one will do
            keep = np.flatnonzero(late | first | np.concatenate([[True], late[:-1]]))
            del first
            h, d, g, late = h[keep], d[keep], g[keep], late[keep]
            del keep
            g[late] = (-1 - _bucket(known, buckets)).astype(np.int32)[d[late]]
            del late
            # a document's leaves of one group are neighbours, so its id is sent once for all of them
            both = (g.astype(np.int64) << 32) | d
            del g, d
            order = np.argsort(both)
            h, both = h[order], both[order]
            del order
            runs = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            counts = np.diff(np.concatenate([runs, [len(h)]])).astype(np.uint32)
            g, d = both[runs] >> 32, known[both[runs] & 0xFFFFFFFF]
            del both
            runs = np.concatenate([runs, [len(h)]])
            at = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
            # some groups at a time, so that neither side holds all that was gathered once more
            cuts = np.searchsorted(runs[at], np.arange(SENT_LEAVES, len(h), SENT_LEAVES))
            for lo, hi in itertools.pairwise(np.unique(np.concatenate([[0], cuts, [len(at) - 1]])).tolist()):
                spans = list(itertools.pairwise(at[lo : hi + 1].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(g[at[lo:hi]]),
                        pa.array([d[i:j].tobytes() for i, j in spans], pa.binary()),
                        pa.array([counts[i:j].tobytes() for i, j in spans], pa.binary()),
                        pa.array([h[runs[i] : runs[j]].tobytes() for i, j in spans], pa.binary()),
                    ],
                    ["grp", "doc_ids", "counts", "hashes"],
                )

        for batch in pieces(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            held.append(ids)
            for start, texts in blocks(texts_of(batch)):
                hashes, _, at, text = _windows(texts, words)
                size += sum(map(len, texts))
                if len(at):
                    names.append(grams(hashes, words)[at])
                    owners.append((rows + start + text).astype(np.int32))
                    groups.append(plan.group[plan.find(hashes, at)].astype(np.int32))
                del hashes, at, text
                if size >= GATHER_BYTES and names:
                    yield from send()
                    held.append(ids)
                    size = rows = 0
            rows += len(ids)
        if names:
            yield from send()

    return docs.filter("doc_id is not null").mapInArrow(run, "grp long, doc_ids binary, counts binary, hashes binary")


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _late(leaves: DataFrame, buckets: int) -> DataFrame:
    """bucket, doc_ids, counts, hashes: every window of a document that also begins in one with a smaller doc_id."""

    def run(table: pa.Table) -> pa.Table:
        h = _joined(table["hashes"], np.uint64)
        d = np.repeat(_joined(table["doc_ids"], np.int64), _joined(table["counts"], np.uint32))
        if table["grp"][0].as_py() >= 0:
            order = np.argsort(h)
            h = h[order]
            d = d[order]
            del order
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            late = d > np.repeat(np.minimum.reduceat(d, first), np.diff(np.concatenate([first, [len(h)]])))
            h, d = h[late], d[late]
            del first, late
        # one row for each bucket of documents, in which an id is told once for all its windows
        bucket = _bucket(d, buckets)
        order = np.lexsort((d, bucket))
        h, d, bucket = h[order], d[order], bucket[order]
        new = np.concatenate([[True], d[1:] != d[:-1]])[: len(d)]
        runs = np.flatnonzero(new)
        counts = np.diff(np.concatenate([runs, [len(d)]])).astype(np.uint32)
        begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(d)])
        edges = np.concatenate([begins, [len(d)]])
        at = np.searchsorted(runs, edges)
        spans = range(len(begins))
        return pa.table(
            {
                "bucket": pa.array(bucket[begins], pa.int64()),
                "doc_ids": pa.array([d[runs[at[i] : at[i + 1]]].tobytes() for i in spans], pa.binary()),
                "counts": pa.array([counts[at[i] : at[i + 1]].tobytes() for i in spans], pa.binary()),
                "hashes": pa.array([h[edges[i] : edges[i + 1]].tobytes() for i in spans], pa.binary()),
            }
        )

    return leaves.groupBy("grp").applyInArrow(run, "bucket long, doc_ids binary, counts binary, hashes binary")


def _bucket(doc_id: np.ndarray, buckets: int) -> np.ndarray:
    u = doc_id.view(np.uint64)
    return np.mod((u ^ (u >> np.uint64(15))).view(np.int64), buckets)


def _bucket_column(buckets: int) -> Column:
    """The same as an expression; rows without an id go by their text."""
    c = F.col("doc_id").cast("long")
    return F.coalesce(F.pmod(c.bitwiseXOR(F.shiftrightunsigned(c, 15)), F.lit(buckets)), F.pmod(F.xxhash64("text"), F.lit(buckets)))


def remove_repeats(docs: DataFrame, words: int = 13, keep_text: bool = True) -> DataFrame:
    """docs with columns n_words, n_removed, kept_sha256 and kept, which replace columns of those names. Without keep_text, text and kept are left out.

    A window is `words` consecutive words (runs of bytes other than white space, unchanged) of one document. Every word
    covered by a window that also starts in a document with a smaller doc_id is removed; windows are judged on the input. kept is the
    text itself if nothing is removed, else the kept words, each with the white space before it; kept_sha256 is of the kept words joined by one space. A null text has
    no words and stays null. Rows with a null doc_id neither lose nor cause anything; rows that share a doc_id are one document and
    do not remove each other's words. A very long text is hashed a block at a time and may be a bucket of its own. An empty table gives no rows.
    """
    if words < 2:
        raise ValueError("a window has at least two words")
    docs = docs.select(*(c for c in docs.columns if c not in ("n_words", "n_removed", "kept_sha256", "kept")))
    home = "bucket"
    while home in docs.columns:
        home += "_"
    plan = plan_groups(docs, words)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    buckets = max(2 * partitions, size // TEXT_BUCKET_BYTES) | 1
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    late = _late(_leaves(ids, words, plan, buckets), buckets)
    own = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    more = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    out = T.StructType(own + more + [T.StructField("kept", T.StringType())] * keep_text)

    def cut_out(rows: pa.Table, found: pa.Table) -> pa.Table:
        d = np.repeat(_joined(found["doc_ids"], np.int64), _joined(found["counts"], np.uint32))
        h = _joined(found["hashes"], np.uint64)
        order = np.argsort(d, kind="stable")
        d, h = d[order], h[order]
        n_words, n_removed, digests, kept = [], [], [], []
        for batch in rows.combine_chunks().to_batches(max_chunksize=256):
            texts = texts_of(batch)
            nulls = batch.column("text").is_null().to_pylist()
            for i, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), texts, strict=True)):
                lo, hi = (np.searchsorted(d, doc_id), np.searchsorted(d, doc_id, "right")) if doc_id is not None else (0, 0)
                parts = text.split()
                n_words.append(len(parts))
                if lo == hi:
                    n_removed.append(0)
                    digests.append(hashlib.sha256(b" ".join(parts)).hexdigest())
                    kept.append(None if nulls[i] else text)
                    continue
                hashes, _, first, end = word_table([text])
                gone = np.flatnonzero(np.isin(grams(hashes, words), h[lo:hi]))
                edge = np.zeros(len(parts) + 1, np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + words, -1)
                covered = np.cumsum(edge[:-1]) > 0
                left = [w for w, c in zip(parts, covered.tolist(), strict=True) if not c]
                n_removed.append(int(covered.sum()))
                digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
                # the stretches of kept words, each with the white space before it
                turns = np.flatnonzero(np.diff(np.concatenate([[True], covered, [True]]).astype(np.int8)))
                kept.append(b"".join(text[(end[a - 1] if a else 0) : end[b - 1]] for a, b in zip(turns[::2], turns[1::2], strict=True)))
        columns = [*(rows[f.name] for f in own), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
        return pa.Table.from_arrays(columns + [pa.array(kept, pa.binary()).cast(pa.string())] * keep_text, names=out.names)

    keyed = docs.withColumn(home, _bucket_column(buckets))
    return keyed.groupBy(home).cogroup(late.groupBy("bucket")).applyInArrow(cut_out, out)
