"""N-gram Jaccard self-join by prefix trees.

A document is the set of its n-word shingles, each a 63-bit hash behind one bit that says if the shingle is
frequent; numeric order is the global order, rare shingles first. With similarity p/100 or more two sets share one of the
first (100 - p)/100 of their shingles. The steps:

1. Equal sets are one class, represented by its least doc_id.
2. Star round: classes with equal min-hashes meet the least of them in a trie, which joins most of each group of near copies
   without looking at all its pairs.
3. Of the prefix shingles, only those met in classes of more than one component so far can still link anything. Within their
   lists, classes that sizes, places in the prefix and signatures do not rule out are gathered into clusters;
   what leaves a task is one row for each class and cluster, never a pair.
4. Tree round: the classes of a cluster meet in a trie, and a spanning forest of the links found there is kept.
5. Components of all links.

The tries of steps 2 and 4 hold sets in the global order and are walked depth first, with the counts of many probing sets
at once: what partners share at their beginning is counted once, and a subtree is left by each probe whose
overlap so far plus the shorter of both remaining lengths cannot reach the similarity with a set of any length below. Large lists and
clusters are split into cells. In each, the largest component is dealt out once and only the others are repeated, as classes
of one component need not meet. A list too large for that is split by a second shingle, as sets that reach the similarity share two of their prefixes with one shingle more;
a row is then copied as often as its own prefix is long, and however long the list is.

No link is lost: a pair that step 2 does not join and whose components differ meets in step 3, in the list of its first common
shingle, and so in one cluster.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.llm.arrow import pieces, texts_of
from paperweave.llm.components import components
from paperweave.llm.scratch import BROADCAST_ROWS, cut, drop, small
from paperweave.llm.words import mix, word_sets

SKETCH_SLOTS = 1 << 21
_CHUNK = 1 << 15
#: Share of all shingle occurrences that lie in the slots counted as rare.
RARE_SHARE = 0.35
#: Bits of the filter for shingles that can still link (8 MB, whatever the input).
FILTER_BITS = 1 << 26
MIN_HASHES = 4
#: Rows of one block of a list, with signatures, and shingles of one block of a cluster (4 MB). A task holds two blocks.
LIST_BLOCK = 2048
TREE_BLOCK = 1 << 19
#: Shingles of a trie's edge between two looks at the bounds; probes that walk it at once, and their shingles.
EDGE = 32
PROBES = 64
PROBE_SHINGLES = 1 << 15
#: Bits of a signature for each shingle at least, and of all at most.
SIGNATURE_BITS = 2
#: Blocks of a list beyond which it is split by a second shingle.
SPLIT_BLOCKS = 32
MAX_BITS = 1 << 12
_FREQUENT = np.uint64(1 << 63)


def frequent_slots(docs: DataFrame, n: int) -> np.ndarray:
    """A bit for each of SKETCH_SLOTS hash slots: do so many shingles of all documents fall into it that they come last
    in the order? The order changes cost, not results. Each task counts in an array of fixed size, and so does the driver (16 MB)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH_SLOTS, np.int64)
        for batch in pieces(batches):
            sets = list(word_sets(texts_of(batch), n))
            total += np.bincount((np.concatenate(sets) >> np.uint64(1)).astype(np.int64) & (SKETCH_SLOTS - 1), minlength=SKETCH_SLOTS) if sets else 0
        if total.any():
            parts = total.astype(np.uint32).reshape(-1, _CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts])], ["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64) for x in table["counts"].to_pylist())
        return pa.table({"chunk": table["chunk"][:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)])})

    counts = np.zeros(SKETCH_SLOTS, np.int64)
    for chunk, raw in docs.select("text").mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        counts[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(zlib.decompress(raw), np.int64)
    ordered = np.sort(counts)
    least = ordered[min(SKETCH_SLOTS - 1, int(np.searchsorted(np.cumsum(ordered), RARE_SHARE * ordered.sum())))]
    return np.packbits(counts > least)


def _bits(chunks: DataFrame, bits: int) -> np.ndarray:
    """Rows (chunk, bits) of _CHUNK bits each as one packed array; absent chunks are zero."""
    out = np.zeros(bits // 8, np.uint8)
    for chunk, raw in chunks.collect():
        out[chunk * (_CHUNK // 8) : (chunk + 1) * (_CHUNK // 8)] = np.frombuffer(raw, np.uint8)
    return out


def _filter_of(tokens: DataFrame) -> np.ndarray:
    """A bit for each of FILTER_BITS slots into which a token falls. It drops no token; with very many it drops nothing."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FILTER_BITS, bool)
        for b in batches:
            seen[_slot(b.column("token").to_numpy())] = True
        for chunk in np.unique(np.flatnonzero(seen) // _CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(np.packbits(seen[chunk * _CHUNK : (chunk + 1) * _CHUNK]).tobytes(), 1)])], ["chunk", "bits"])

    def either(table: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint8) for x in table["bits"].to_pylist()])
        return pa.table({"chunk": table["chunk"][:1], "bits": pa.array([out.tobytes()])})

    schema = "chunk int, bits binary"
    return _bits(tokens.select("token").mapInArrow(mark, schema).groupBy("chunk").applyInArrow(either, schema), FILTER_BITS)


def _slot(token: np.ndarray) -> np.ndarray:
    return (mix(token.view(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _ordered_sets(texts: list[bytes], n: int, frequent: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's shingles in the global order."""
    flags = np.unpackbits(frequent).astype(bool)
    for s in word_sets(texts, n):
        codes = s >> np.uint64(1)
        heavy = flags[(codes & np.uint64(SKETCH_SLOTS - 1)).astype(np.int64)]
        codes = np.unique(codes) if not heavy.any() else np.unique(np.where(heavy, codes | _FREQUENT, codes))
        yield codes


def _bits_for(n: int) -> int:
    return min(MAX_BITS, max(64, 1 << (SIGNATURE_BITS * int(n) - 1).bit_length()))


def _signature(codes: np.ndarray, bits: int) -> bytes:
    """Bit i: the parity of how many shingles hash to i. Sets differ in at least as many shingles as these differ in bits."""
    at = (mix(codes) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def prefix_length(n: int, percent: int) -> int:
    """So many of its first shingles a set shares one of with any set that it is similar to; with one more, two of them, if at least two must be shared."""
    return n - -(-percent * n // 100) + 1


def nodes(docs: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, set_hash, keys (min-hashes), prefix (shingles), signature of each document; for sets without shingles the last four are null."""
    schema = "doc_id long, n_shingles long, set_hash binary, keys array<long>, prefix array<long>, signature binary"
    turns = [mix(np.uint64([i + 1]))[0] for i in range(MIN_HASHES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 512):
            sizes, hashes, keys, prefixes, signatures = [], [], [], [], []
            for codes in _ordered_sets(texts_of(batch), n, frequent):
                k = len(codes)
                sizes.append(k)
                if not k:
                    for column in (hashes, keys, prefixes, signatures):
                        column.append(None)
                    continue
                hashes.append(hashlib.blake2b(codes.tobytes(), digest_size=16).digest())
                keys.append([int(mix(codes ^ t).min().view(np.int64)) for t in turns])
                prefixes.append(codes[: prefix_length(k, percent) + 1].view(np.int64))
                signatures.append(_signature(codes, _bits_for(k)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "set_hash", "keys", "prefix", "signature"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def walk_trie(partners: list[np.ndarray], probes: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(a partner, the probes whose sets have the similarity with it), by their numbers. Sets are ascending in the global order, partners sorted as
    sequences, so that those of one subtree are neighbours. The path to the partner looked at is held as the probes still alive
    and their overlaps after each edge of EDGE shingles."""
    sizes = np.array([len(y) for y in partners], np.int64)
    shared = np.zeros(len(partners) + 1, np.int64)
    for k in range(1, len(partners)):
        m = min(sizes[k - 1], sizes[k])
        differ = partners[k][:m] != partners[k - 1][:m]
        shared[k] = int(differ.argmax()) if differ.any() else m
    n = np.array([len(x) for x in probes], np.int64)
    universe, at = np.unique(np.concatenate(probes), return_inverse=True)
    holds = np.zeros((len(universe), len(probes)), np.uint8)
    holds[at, np.repeat(np.arange(len(probes)), n)] = 1
    upto = np.zeros((len(universe) + 1, len(probes)), np.int32)
    np.cumsum(holds, axis=0, out=upto[1:])
    path = [(0, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
    left = None  # the depth of a subtree that no probe entered
    for k, y in enumerate(partners):
        if left is not None and shared[k] >= left:
            continue
        left = None
        while path[-1][0] > shared[k]:
            path.pop()
        depth, alive, both = path[-1]
        tail = y[depth:]
        slot = np.searchsorted(universe, tail)
        hit = universe[np.minimum(slot, len(universe) - 1)] == tail
        start = depth
        while depth < len(y):
            end = min(depth + EDGE, len(y))
            rows = slot[depth - start : end - start][hit[depth - start : end - start]]
            if len(rows):
                both = both + holds[np.ix_(rows, alive)].sum(axis=0, dtype=np.int64)
            rest = n[alive] - upto[slot[end - start - 1] + hit[end - start - 1], alive]
            least = most = sizes[k]
            if shared[k + 1] >= end:
                below = k + 1 + int(np.argmax(shared[k + 1 :] < end))
                least, most = sizes[k:below].min(), sizes[k:below].max()
            fitting = np.clip(end + rest, least, most)
            may = (100 + percent) * (both + np.minimum(rest, fitting - end)) >= percent * (n[alive] + fitting)
            depth = end
            if not may.all():
                alive, both = alive[may], both[may]
                if not len(alive):
                    left = depth
                    break
            path.append((depth, alive, both))
        if left is None:
            yield k, alive[(100 + percent) * both >= percent * (n[alive] + sizes[k])]


class Forest:
    """Which of some rows are joined already."""

    def __init__(self, groups: np.ndarray):
        _, first, at = np.unique(groups, return_index=True, return_inverse=True)
        self.parent = first[at]

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """False if they were joined before."""
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up


def cell_links(sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray, whole: bool, percent: int) -> list[tuple[int, int]]:
    """A spanning forest, over the components given, of the links between rows of different sides of a cell, or of all rows of a whole one."""
    forest = Forest(comp)
    if whole:
        names, counts = np.unique(comp, return_counts=True)
        partners, probes = np.arange(len(sets)), np.flatnonzero(comp != names[counts.argmax()])
    else:
        partners, probes = sorted((np.flatnonzero(side), np.flatnonzero(~side)), key=len, reverse=True)
    partners = partners[sorted(range(len(partners)), key=lambda i: sets[partners[i]].astype(">u8").tobytes())]
    found = []
    size = np.array([len(sets[i]) for i in probes])
    first = 0
    while first < len(probes):
        room = int(np.searchsorted(np.cumsum(size[first : first + PROBES]), PROBE_SHINGLES, "right"))
        some = probes[first : first + max(1, room)]
        first += len(some)
        for k, linked in walk_trie([sets[i] for i in partners], [sets[i] for i in some], percent):
            found += [(int(partners[k]), int(i)) for i in some[linked] if forest.join(int(partners[k]), int(i))]
    return found


def _cells(rows: DataFrame, key: str, block: int, weight: Column) -> DataFrame:
    """rows (key, doc_id, comp, ...) with the cells (g, h, whole, side) in which they meet all rows of the key that are of other components. A key of
    weight `block` is one cell. Of a larger one, blocks of the largest component meet blocks of the others once, and blocks of the others each other."""
    large = cut(rows.groupBy(key).agg(F.sum(weight).alias("c")).filter(F.col("c") > block).select(key))
    one = (F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("h"), F.lit(True).alias("whole"), F.lit(False).alias("side"))
    if not large.limit(1).count():
        return rows.select("*", *one)
    comps = rows.join(small(large), key, "left_semi").groupBy(key, "comp").agg(F.sum(weight).alias("c"))
    plan = comps.groupBy(key).agg(F.max(F.struct("c", "comp")).alias("major"), F.sum("c").alias("all")).filter("major.c < all")
    plan = cut(plan.select(key, F.col("major.comp").alias("major"), F.ceil(F.col("major.c") / block).alias("blocks"), F.ceil((F.col("all") - F.col("major.c")) / block).alias("others")))
    few = rows.join(small(large), key, "left_anti").select("*", *one)
    rest = rows.join(small(plan), key)
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("comp") == F.col("major"), F.col("blocks")).otherwise(F.col("others")))
    rest = rest.withColumn("own", own)
    cells = F.expr("""if(comp = major, transform(sequence(0L, others - 1), j -> struct(own as g, -1 - j as h, false as whole, false as side)),
        concat(transform(sequence(0L, others - 1), k -> struct(least(own, k) as g, greatest(own, k) as h, own = k as whole, own > k as side)),
               transform(sequence(0L, blocks - 1), i -> struct(i as g, -1 - own as h, false as whole, true as side))))""")
    return few.unionByName(rest.select(*rows.columns, F.explode(cells).alias("cell")).select(*rows.columns, "cell.*"))


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], gather: int) -> Iterator[pa.Table]:
    """Rows sorted by the columns `names`, in tables of about `gather` rows or more that end where a group ends."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= gather:
            table = pa.Table.from_batches(held)
            keys = [table[c].to_numpy() for c in names]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            first = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
            if first:
                yield table.slice(0, first)
            held, rows = table.slice(first).to_batches(), table.num_rows - first
    if rows:
        yield pa.Table.from_batches(held)


def _numbers(table: pa.Table, names: list[str]) -> np.ndarray:
    """The number of each row's group in a sorted table."""
    new = np.logical_or.reduce([k[1:] != k[:-1] for k in (table[c].to_numpy() for c in names)])
    return np.concatenate([[0], np.cumsum(new)])


def tree_links(docs: DataFrame, members: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Links (a, b), a spanning forest for each cell, of members: a cut table of leader, doc_id, comp, g, h, whole, side. Sets are made where
    the texts are and sent to the cells of their document."""
    cells = ["leader", "g", "h"]
    wanted = members.groupBy("doc_id").agg(F.collect_list(F.struct("leader", "comp", "g", "h", "whole", "side")).alias("cells"))
    chosen = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(wanted) if _few(members) else wanted, "doc_id")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            column = batch.column("cells")
            row = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            flat = column.flatten()
            sets = pa.array([c.tobytes() for c in _ordered_sets(texts_of(batch), n, frequent)], pa.binary())
            for at in range(0, len(row), 512):
                some = pa.array(row[at : at + 512])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(some), sets.take(some), *(flat.field(i).slice(at, 512) for i in range(6))], ["doc_id", "set", "leader", "comp", "g", "h", "whole", "side"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(pieces(batches, 256), cells, 1):
            ids, number = table["doc_id"].to_numpy(), _numbers(table, cells)
            comp, side, whole = (table[c].to_numpy() for c in ("comp", "side", "whole"))
            raw = table["set"].to_pylist()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(ids)]])
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    out += [(ids[a + i], ids[a + j]) for i, j in cell_links([np.frombuffer(x, np.uint64) for x in raw[a:b]], comp[a:b], side[a:b].astype(bool), bool(whole[a]), percent)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*out, strict=True)], ["a", "b"])

    rows = chosen.mapInArrow(send, "doc_id long, set binary, leader long, comp long, g long, h long, whole boolean, side boolean")
    return cut(rows.repartition(*cells).sortWithinPartitions(*cells).mapInArrow(link, "a long, b long"))


def _few(table: DataFrame) -> bool:
    return table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _stars(classes: DataFrame, percent: int) -> DataFrame:
    """Members of a star round: the least class with an equal min-hash on one side, the others of fitting size on the other."""
    keyed = classes.select("doc_id", "n_shingles", F.posexplode("keys").alias("i", "key"))
    hub = cut(keyed.groupBy("i", "key").agg(F.min(F.struct("doc_id", "n_shingles")).alias("hub"), F.count("*").alias("c")).filter("c > 1").select("i", "key", "hub"))
    fits = F.lit(100) * F.least("n_shingles", "hub.n_shingles") >= F.lit(percent) * F.greatest("n_shingles", "hub.n_shingles")
    pairs = keyed.join(small(hub), ["i", "key"]).filter("doc_id <> hub.doc_id").filter(fits)
    rays = cut(pairs.select(F.col("hub.doc_id").alias("leader"), "doc_id", "n_shingles").distinct())
    blocks = rays.groupBy("leader").agg(F.ceil(F.sum("n_shingles") / TREE_BLOCK).alias("blocks"))
    rows = rays.join(blocks, "leader").select("leader", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("g"), F.lit(True).alias("side"))
    hubs = blocks.select("leader", F.col("leader").alias("doc_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("g"), F.lit(False).alias("side"))
    out = cut(rows.unionByName(hubs).select("leader", "doc_id", F.col("doc_id").alias("comp"), "g", F.lit(0).cast("long").alias("h"), F.lit(False).alias("whole"), "side"))
    drop(hub, rays)
    return out


def gather_clusters(t: dict[str, np.ndarray], signatures: list[bytes], percent: int) -> np.ndarray:
    """The cluster, as the number of one of its rows, of each row of sorted cells (columns group, whole, side, comp, n_shingles, pos). Rows that may have the similarity are in one
    cluster; which pairs were met does not leave this function."""
    rows = len(signatures)
    width = np.fromiter((8 * len(x) for x in signatures), np.int64, rows)
    at, words = {}, {}
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        bits = np.frombuffer(b"".join(signatures[i] for i in own), np.uint8).reshape(len(own), -1)
        for x, b in ((w, bits), (w // 2, bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :])):
            if x >= 64:
                at.setdefault(x, np.zeros(rows, np.int64))[own] = sum(map(len, words.get(x, []))) + np.arange(len(own))
                words.setdefault(x, []).append(np.ascontiguousarray(b).view(np.uint64))
    words = {w: np.concatenate(b) for w, b in words.items()}
    group, n, comp, rest = t["group"], t["n_shingles"], t["comp"], t["n_shingles"] - t["pos"]
    forest = Forest(np.arange(rows))
    label = forest.roots()
    active, step = np.arange(rows), 1
    while True:
        active = active[active + step < rows]
        active = active[group[active] == group[active + step]]
        if not len(active):
            return forest.roots()
        i, j = active, active + step
        both = n[i] + n[j]
        # the first common shingle of a linked pair has room for the overlap behind it in both sets
        ok = (comp[i] != comp[j]) & (label[i] != label[j]) & (t["whole"][i] | (t["side"][i] != t["side"][j]))
        ok &= ((100 + percent) * np.minimum(rest[i], rest[j]) >= percent * both) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j, both = i[ok], j[ok], both[ok]
        if len(i):
            narrow, may = np.minimum(width[i], width[j]), np.zeros(len(i), bool)
            for w in np.unique(narrow):
                some = np.flatnonzero(narrow == w)
                for k in range(0, len(some), 16384):
                    s = some[k : k + 16384]
                    far = np.maximum(width[i[s]], width[j[s]]) > 2 * w  # signatures that cannot be compared rule nothing out
                    differ = np.bitwise_count(words[w][at[w][i[s]]] ^ words[w][at[w][j[s]]]).sum(axis=1, dtype=np.int64)
                    may[s] = far | ((100 + percent) * differ <= (100 - percent) * both[s])
            joined = [forest.join(a, b) for a, b in zip(i[may].tolist(), j[may].tolist(), strict=True)]
            if any(joined):
                label = forest.roots()
        step += 1


def _prefix_column(percent: int) -> Column:
    n = F.col("n_shingles")
    return (n - F.ceil(n * percent / 100) + 1).cast("int")


def _split_lists(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """lists (a written table) with those of more than SPLIT_BLOCKS blocks split by a second shingle of the longer prefixes: a list (token, other) for each that is in rows of more than one component. From a similarity
    over one half on, a set that may share a single shingle with another is equal to it, and equal sets are one class; below, nothing is split."""
    if percent <= 50:
        return lists
    long = cut(lists.groupBy("token").agg(F.count("*").alias("c")).filter(F.col("c") > SPLIT_BLOCKS * LIST_BLOCK).select("token"))
    if long.isEmpty():
        drop(long)
        return lists
    hot = lists.join(small(long), "token", "left_semi").join(classes.select("doc_id", "all_prefix"), "doc_id")
    hot = hot.select("doc_id", "comp", "n_shingles", "token", "pos", F.explode("all_prefix").alias("other")).filter("other <> token")
    hot = cut(hot.withColumn("pair", F.xxhash64("token", "other")).drop("other"))
    shared = hot.groupBy("token", "pair").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token", "pair")
    kept = hot.join(shared, ["token", "pair"], "left_semi").select("doc_id", "comp", "n_shingles", F.col("pair").alias("token"), "pos")
    out = cut(lists.join(small(long), "token", "left_anti").select("doc_id", "comp", "n_shingles", "token", "pos").unionByName(kept))
    drop(lists, hot, long)
    return out


def _clustered(classes: DataFrame, percent: int) -> DataFrame:
    """Members of a tree round: clusters of classes of different components that share a prefix shingle and may have the similarity. classes: with comp."""
    first = F.slice("prefix", F.lit(1), F.least(F.size("prefix"), _prefix_column(percent)))
    classes = classes.withColumn("all_prefix", F.col("prefix")).withColumn("prefix", first)
    rows = classes.select("comp", F.explode("prefix").alias("token"))
    # combined before the shuffle, so a shingle of very many near copies is a few rows
    mixed = cut(rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token"))
    may_link = classes.sparkSession.sparkContext.broadcast(_filter_of(mixed))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            prefix = batch.column("prefix")
            token = prefix.flatten().to_numpy()
            slot = _slot(token)
            keep = np.flatnonzero((may_link.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
            counts = np.diff(prefix.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), counts)
            pos = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
            some = [batch.column(c).take(pa.array(row[keep])) for c in ("doc_id", "comp", "n_shingles")]
            yield pa.RecordBatch.from_arrays([*some, pa.array(token[keep]), pa.array(pos[keep])], ["doc_id", "comp", "n_shingles", "token", "pos"])

    tokens = classes.select("doc_id", "comp", "n_shingles", "prefix").mapInArrow(passing, "doc_id long, comp long, n_shingles long, token long, pos long")
    lists = _split_lists(cut(tokens.join(small(mixed), "token", "left_semi")), classes, percent)
    dealt = _cells(lists, "token", LIST_BLOCK, F.lit(1)).join(classes.select("doc_id", "signature"), "doc_id")
    cells = ["token", "g", "h"]
    dealt = dealt.select(*cells, "whole", "side", "doc_id", "comp", "n_shingles", "pos", "signature").repartition(*cells).sortWithinPartitions(*cells)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(pieces(batches, 4096), cells, 4096):
            t = {c: table[c].to_numpy() for c in ("whole", "side", "comp", "n_shingles", "pos", "doc_id")}
            label = gather_clusters(t | {"group": _numbers(table, cells)}, table["signature"].to_pylist(), percent)
            order = np.lexsort((t["doc_id"], label))
            lead = np.concatenate([[True], label[order][1:] != label[order][:-1]])
            size = np.diff(np.concatenate([np.flatnonzero(lead), [len(order)]]))
            some = np.repeat(size, size) > 1
            leader = np.repeat(t["doc_id"][order][lead], size)[some]
            found = np.unique(np.stack([leader, *(t[c][order][some] for c in ("doc_id", "comp", "n_shingles"))], axis=1), axis=0)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], ["leader", "doc_id", "comp", "n_shingles"])

    clusters = cut(dealt.mapInArrow(gather, "leader long, doc_id long, comp long, n_shingles long").distinct())
    out = cut(_cells(clusters, "leader", TREE_BLOCK, F.col("n_shingles")))
    drop(mixed, lists, clusters)
    return out


def join_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs (doc_id, text; other columns are ignored, whatever their names) as doc_id, n_shingles, component_id, set_id.

    Words are runs of bytes other than white space, A-Z lower-cased. Two documents link when 100 * shared shingles >= percent * all of both;
    component_id is the least doc_id reachable, set_id the least with an equal set. Null, empty and blank texts have no
    shingles and are their own component, as are rows with a null doc_id, whose component is null. Rows that repeat a doc_id are
    one document with a link wherever one of its texts has one. Very long texts count whole; their signatures have at most MAX_BITS bits, which only
    rules out less. Of equally small ids or sizes there is one least, so ties do not change the result. An empty table gives no rows.
    """
    if not 1 <= percent <= 100:
        raise ValueError("a similarity of 1 to 100 percent")
    docs = docs.select("doc_id", "text")
    frequent = frequent_slots(docs, n)
    all_nodes = cut(nodes(docs, n, percent, frequent))
    live = all_nodes.filter("doc_id is not null and n_shingles > 0")
    sets = live.groupBy("set_hash").agg(F.min("doc_id").alias("set_id"))
    named = cut(all_nodes.select("doc_id", "n_shingles", "set_hash").join(sets, "set_hash", "left"))
    copies = cut(named.filter("doc_id is not null and doc_id <> set_id").select("doc_id", "set_hash", "set_id"))
    classes = live.join(small(copies), ["doc_id", "set_hash"], "left_anti").select("doc_id", "n_shingles", "keys", "prefix", "signature")
    stars = _stars(classes, percent)
    near = tree_links(docs, stars, n, percent, frequent)
    known = cut(components(near))
    labelled = classes.join(small(known), "doc_id", "left").select("doc_id", "n_shingles", "prefix", "signature", F.coalesce("component_id", "doc_id").alias("comp"))
    clusters = _clustered(labelled, percent)
    more = tree_links(docs, clusters, n, percent, frequent)
    # texts that share a doc_id but not their set are joined by it
    twice = copies.select(F.col("set_id").alias("a"), F.col("doc_id").alias("b"))
    repeated = twice.join(classes.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")
    final = cut(components(known.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).unionByName(more).unionByName(repeated)))
    out = named.join(small(final.withColumnRenamed("doc_id", "set_id")), "set_id", "left")
    is_named = F.col("doc_id").isNotNull()
    told = cut(out.select("doc_id", "n_shingles", F.when(is_named, F.coalesce("component_id", "set_id", "doc_id")).alias("component_id"), F.when(is_named, F.coalesce("set_id", "doc_id")).alias("set_id")))
    drop(all_nodes, named, copies, stars, near, known, clusters, more, final)
    return told
