"""Byte-level BPE encoding and decoding with numpy.

Texts split by a pattern into pieces. Distinct pieces that are not known yet
are laid out as padded matrices, one per length bucket, a row per piece and a
column per byte. Every round looks up the ranks of all adjacent pairs in a hash
table, merges in each row the leftmost pair of minimum rank, closes the gap,
and drops rows that have no pair left. A round costs a row its width, so a piece of
n bytes costs n squared: pieces beyond the widest bucket, which no written word
reaches, take the stated exit, a heap that merges in the same order in n log n (a test
holds it equal to the matrices and to the library). Nothing is trained here: ranks come
from a vocabulary file.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import spread
from .runtime import kept_in_worker, take_over

#: Widths of the padded matrices, in bytes.
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512)
#: Bytes in one matrix, and pieces that a worker remembers.
CELLS, REMEMBERED = 1 << 21, 200_000
_WIDTH_OF = [min(w for w in WIDTHS if w >= n) for n in range(WIDTHS[-1] + 1)]
_NONE = np.int32(2**31 - 1)
_HASH = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """(left id, right id) -> rank of the joined token, in an open-addressed hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs, joined = array("Q"), array("i")
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left = ranks.get(token[:k])
                if left is not None:
                    right = ranks.get(token[k:])
                    if right is not None:
                        pairs.append(left << 32 | right)
                        joined.append(rank)
        keys = np.array(pairs, dtype=np.uint64)
        values = np.array(joined, dtype=np.int32)
        self.log = max(4, int(np.ceil(np.log2(4 * max(1, len(pairs))))))
        size = 1 << self.log
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.values = np.full(size, _NONE)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):  # each free slot takes one of the keys that want it
            s = slot[todo]
            free = self.values[s] == _NONE
            taken, which = np.unique(s[free], return_index=True)
            winners = todo[free][which]
            self.keys[taken], self.values[taken] = keys[winners], values[winners]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _HASH) >> np.uint64(64 - self.log)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; negative ids and unknown pairs get the largest value."""
        known = (left >= 0) & (right >= 0)
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(left.shape, _NONE)
        todo = np.flatnonzero(known)
        keys = keys.ravel()[todo]
        slot, flat = self._slot(keys), out.ravel()
        while len(todo):
            found = self.keys[slot] == keys
            flat[todo[found]] = self.values[slot[found]]
            on = ~found & (self.values[slot] != _NONE)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & (len(self.keys) - 1)
        return flat.reshape(left.shape)


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.table = PairTable(self.ranks)
        self.single = np.full(256, -1, dtype=np.int32)
        for b in range(256):
            self.single[b] = self.ranks[bytes([b])]
        # the decimals of each known piece's ids, joined by commas
        self.known: dict[str, str] = {}

    def _heap(self, piece: bytes) -> tuple[int, ...]:
        """The same merge order for one long piece."""
        ids = [int(x) for x in self.single[np.frombuffer(piece, dtype=np.uint8)]]
        n = len(ids)
        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        at = np.concatenate([[0], np.cumsum(size)])[:-1].tolist()
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                j = after[i]
                width = size[i] + size[j]
                rank = self.ranks.get(piece[at[i] : at[i] + width])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, width))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, width = heapq.heappop(heap)
            if size[i] == 0 or after[i] >= n or size[i] + size[after[i]] != width:
                continue
            j = after[i]
            ids[i], size[i], size[j], after[i] = rank, width, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return tuple(ids[i] for i in range(n) if size[i])

    def _matrix(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        rows = len(pieces)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=rows)
        ids = np.full((rows, width + 1), -1, dtype=np.int32)
        ids[:, :width][np.arange(width) < size[:, None]] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        rank = self.table.rank(ids[:, :-1], ids[:, 1:])
        out: list[tuple[int, ...]] = [()] * rows
        place, columns = np.arange(rows), np.arange(width)

        def finish(done: np.ndarray) -> None:
            for k, row, n in zip(place[done].tolist(), ids[done].tolist(), size[done].tolist(), strict=True):
                out[k] = tuple(row[:n])

        while len(place):
            best = rank.argmin(axis=1)
            lowest = rank[np.arange(len(place)), best]
            done = lowest == _NONE
            if done.any():
                finish(done)
                place, ids, rank, size, best, lowest = (x[~done] for x in (place, ids, rank, size, best, lowest))
                if not len(place):
                    break
            r = np.arange(len(place))
            ids[r, best] = lowest
            gap = columns >= best[:, None] + 1
            ids[:, :width] = np.where(gap, ids[:, 1:], ids[:, :width])
            ids[:, width] = -1
            rank[:, :-1] = np.where(gap[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NONE
            size -= 1
            rank[r, best] = self.table.rank(ids[r, best], ids[r, best + 1])
            has = best > 0
            rank[r[has], best[has] - 1] = self.table.rank(ids[r[has], best[has] - 1], ids[r[has], best[has]])
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces that are not known yet."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set(pieces).difference(self.known)
        groups: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in new:
            body = piece.encode("utf-8")
            if body in self.ranks:
                self._keep(piece, (self.ranks[body],))
            elif len(body) > WIDTHS[-1]:
                self._keep(piece, self._heap(body))
            else:
                names, bodies = groups.setdefault(_WIDTH_OF[len(body)], ([], []))
                names.append(piece)
                bodies.append(body)
        for width, (names, bodies) in groups.items():
            step = max(1, CELLS // width)
            for k in range(0, len(names), step):
                for piece, ids in zip(names[k : k + step], self._matrix(bodies[k : k + step], width), strict=True):
                    self._keep(piece, ids)

    def _keep(self, piece: str, ids: tuple[int, ...]) -> None:
        self.known[piece] = ",".join(map(str, ids))

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        self.learn(pieces)
        return [int(x) for piece in pieces for x in self.known[piece].split(",")]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def loaded(path: str, pattern: str) -> ByteBPE:
    """One encoder per worker process."""
    return kept_in_worker((path, pattern), lambda: ByteBPE(path, pattern))


#: Characters whose pieces are split and looked up together.
GROUP_CHARS = 1 << 19


def _digests(path: str | None, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        key = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
        take_over(key)
        bpe = loaded(*key)
        for batch in batches:
            counts, ids_sha, back_sha = [], [], []
            held: list[list[str]] = []
            chars = 0

            def flush() -> None:
                bpe.learn(chain.from_iterable(held))
                for pieces in held:
                    joined = ",".join(map(bpe.known.__getitem__, pieces))
                    ids = joined.split(",") if joined else []
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    back_sha.append(hashlib.sha256(bpe.decode(map(int, ids))).hexdigest())
                held.clear()

            for value in batch.column(1):
                text = value.as_py() or ""
                held.append(bpe.split(text))
                chars += len(text)
                if chars >= GROUP_CHARS:
                    flush()
                    chars = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the comma-joined ids and of the bytes decoded from them, for each row.

    Each match of the pattern is encoded alone, without special tokens. A null
    text counts as empty: no tokens, digests of nothing. A very long text is encoded
    whole. Pairs of equal rank in a piece merge from the left. Repeated rows give
    repeated rows, an empty table none; other columns are ignored. ``path`` is a
    rank file on the executors (default: the installed multilingual one).
    """
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(
        _digests(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
