"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string, one token can be last in the prefix's encoding. A token ending at
byte i is that one if the last token of the prefix before it may stand to its left, which holds when encoding the two
together gives just the two. The table of last tokens so gives the encoding of every prefix: appending bytes
only adds entries, and after an edit entries are made anew only from the first changed byte
to where the table falls in step with the old one again.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from paperweave.llm.arrow import map_rows, strings_of
from paperweave.llm.memo import Memo

#: Pieces that a worker remembers, in each of two generations, and pairs of tokens of which it knows if they fit.
PIECES_KEPT = 300_000
PAIRS_KEPT = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[int, bool] = {}
        self.tokens = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.tokens.add_word(token.decode("latin-1"), (i, len(token)))
        self.tokens.make_automaton()

    def merged(self, data: bytes) -> list[int]:
        """The encoding by merges of least rank, leftmost first: the definition, for the short strings of the pair test."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, left: int, token: int) -> bool:
        """May the token stand after left, or first if left is -1? A token that merging its own bytes does not make may never."""
        ids = [left, token] if left >= 0 else [token]
        fits = self.merged(self.decode(ids)) == ids
        if len(self._pairs) >= PAIRS_KEPT:
            self._pairs.clear()
        self._pairs[left << 32 | token] = fits
        return fits

    def extend(self, data: bytes, table: list[int], since: int = 0) -> None:
        """Adds the entries that the table lacks. since: where to begin looking for tokens, at least `longest` before the first of them."""
        known, fits, n = self._pairs.get, self._fits, len(table)
        # at each end the automaton tells the longest token first; just one of them fits
        for end, (token, size) in self.tokens.iter(data[since:].decode("latin-1")):
            end += since
            if end < n:
                continue
            left = table[end - size] if end >= size else -1
            fit = known(left << 32 | token)
            if fit is None:
                fit = fits(left, token)
            if fit:
                table.append(token)
                n += 1
        if n < len(data):
            raise ValueError("a byte has no token")

    def append(self, data: bytes, table: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """data + more and its table, of which only the new entries are made."""
        data, table = data + more, list(table)
        self.extend(data, table, max(0, len(table) - self.longest))
        return data, table

    def table(self, data: bytes) -> list[int]:
        """table[i]: the last token of data[: i + 1]."""
        table: list[int] = []
        self.extend(data, table)
        return table

    def edit(self, data: bytes, table: list[int], begin: int, end: int, new: bytes) -> tuple[bytes, list[int], int]:
        """data with data[begin:end] replaced, its table, and how many entries were made anew. Behind the edit, once as many
        entries in a row as the longest token has bytes agree with the old ones, all later ones do."""
        changed = data[:begin] + new + data[end:]
        shift = len(new) - (end - begin)
        out = table[:begin]
        stop = begin + len(new)
        while len(out) < len(changed):
            stop = min(len(changed), stop + 2 * self.longest)
            self.extend(changed[:stop], out, max(0, len(out) - self.longest))
            tail = stop - self.longest
            if tail >= begin + len(new) and out[tail:stop] == table[tail - shift : stop - shift]:
                return changed, out + table[stop - shift :], stop - begin
        return changed, out, len(changed) - begin

    def read_back(self, table: list[int]) -> list[int]:
        ids, at = [], len(table)
        while at:
            ids.append(table[at - 1])
            at -= len(self.bytes_of[ids[-1]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """One match of the splitting pattern; a piece that is itself a token stays whole."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.read_back(self.table(piece))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Worker:
    """What one worker keeps: pieces met lately with their ids, joined by commas."""

    def __init__(self, path: str, pattern: str):
        self.bpe = PrefixBPE(load_ranks(path))
        self.split = regex.compile(pattern).findall
        self.bytes_of = {str(i): b for i, b in self.bpe.bytes_of.items()}
        self.pieces = Memo(lambda piece: ",".join(map(str, self.bpe.encode_piece(piece.encode()))), PIECES_KEPT)

    def ids(self, text: str) -> str:
        return ",".join(map(self.pieces.__getitem__, self.split(text)))


@lru_cache(maxsize=2)
def _worker(path: str, pattern: str) -> _Worker:
    return _Worker(path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Rows of docs (doc_id, text; other columns are ignored) as doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int).

    ids_sha256 is of the decimal ids joined by commas; decoded_sha256 is of the bytes that the ids decode to. The file of ranks is
    read on each worker. Rows are independent: no shuffle. A null text is an empty one, with no tokens;
    an empty table gives no rows; null doc_ids stay; repeated rows are encoded one by one and alike; a very long text is encoded whole, match by match of the pattern, and its ids are held once as text and once as a list.
    """

    def make(batch) -> dict[str, object]:
        worker = _worker(ranks_path, pattern)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for text in strings_of(batch):
            joined = worker.ids(text)
            ids = joined.split(",") if joined else []
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join(map(worker.bytes_of.__getitem__, ids))).hexdigest())
            if keep_ids:
                out["ids"].append(list(map(int, ids)))
        return {"doc_id": batch.column("doc_id"), **out, "ids": pa.array(out["ids"], pa.list_(pa.int32()))}

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_rows(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, schema, rows=256)
