"""Byte-level BPE: encoding by ranks, and decoding.

A text is split by the tokenizer's pattern, and each distinct piece of a slice is merged once.
Pieces of like length are merged side by side: over the byte positions of a piece stands a
segment tree whose leaf j holds the rank of the pair that begins at j (then j itself, so that
the root is the leftmost least rank). A merge takes the root, rewrites the pair's first
position, and updates three leaves (the merged pair, its live left neighbour and the position
that died), each in a logarithmic number of steps. Dead positions are skipped through links.

Nulls: a null text is the empty text and has no ids. Rows are independent, so repeated rows
are each encoded. Only `doc_id` and `text` are read. A piece of any length is merged whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citedspark.llm.arrays import slices, whole_text

#: Pieces in a generation of a worker's memory. Two are kept, and a piece that is in neither is
#: merged again, so the limit bounds memory and never a result.
REMEMBERED = 100_000
#: Tree nodes merged side by side.
_AT_ONCE = 1 << 17
_NONE = np.int64(2**62)


class ByteBpe:
    """Ranks of a tokenizer file of lines `base64 rank`, which are the ids as well."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.width = max(self.tokens) + 1
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = np.fromiter(
            (
                (left * self.width + right, rank)
                for token, rank in self.ranks.items()
                for cut in range(1, len(token))
                if (left := self.ranks.get(token[:cut])) is not None
                and (right := self.ranks.get(token[cut:])) is not None
            ),
            np.dtype((np.int64, 2)),
        )
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pair_keys, self.pair_ranks = pairs.T.copy()

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def _merged(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids of pieces of at most `size` bytes (a power of two), merged side by side."""
        count, shift = len(pieces), size.bit_length() - 1
        lengths = np.fromiter(map(len, pieces), np.int64, count)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        places = np.arange(size)
        inside = places[None, :] < lengths[:, None]
        ids = np.zeros((count, size), np.int64)
        ids[inside] = self.of_byte[flat]
        after = np.where(places[None, :] + 1 < lengths[:, None], places + 1, size)
        before = np.broadcast_to(places - 1, (count, size)).copy()
        tree = np.full((count, 2 * size), _NONE)
        rank = self._pair_ranks(ids[:, :-1], ids[:, 1:])
        rank[~inside[:, 1:]] = -1
        tree[:, size : 2 * size - 1] = np.where(rank >= 0, rank * size + places[:-1], _NONE)
        level = size
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        alive = inside.copy()
        # Flat views: position j of piece i is i * size + j, node t of its tree i * 2 * size + t.
        ids_, after_, before_, alive_, tree_ = (x.reshape(-1) for x in (ids, after, before, alive, tree))
        row = np.flatnonzero(tree[:, 1] < _NONE)
        root = tree[row, 1]
        while len(row):
            j = root & (size - 1)
            base = row * size
            top = base * 2
            at = base + j
            k = after_[at]
            follower = after_[base + k]
            merged = root >> shift
            ids_[at] = merged
            after_[at] = follower
            alive_[base + k] = False
            has = np.flatnonzero(follower < size)
            before_[base[has] + follower[has]] = j[has]
            left = before_[at]
            some = np.flatnonzero(left >= 0)
            rank = self._pair_ranks(
                np.concatenate([merged[has], ids_[base[some] + left[some]]]),
                np.concatenate([ids_[base[has] + follower[has]], merged[some]]),
            )
            place = np.concatenate([j[has], left[some]])
            fresh = np.where(rank >= 0, rank * size + place, _NONE)
            tree_[top + size + k] = _NONE
            tree_[top + size + j] = _NONE
            both = np.concatenate([top[has], top[some]])
            tree_[both + size + place] = fresh
            tops = np.concatenate([top, top, top[some]])
            node = np.concatenate([j, k, left[some]]) + size
            for _ in range(shift):
                node >>= 1
                child = tops + 2 * node
                tree_[tops + node] = np.minimum(tree_[child], tree_[child + 1])
            root = tree_[top + 1]
            on = np.flatnonzero(root < _NONE)
            row, root = row[on], root[on]
        found = ids[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(axis=1)) * 4
        return [found[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        raw = [piece.encode() for piece in pieces]
        out: list[bytes] = [b""] * len(raw)
        by_size: dict[int, list[int]] = {}
        for at, piece in enumerate(raw):
            known = self.ranks.get(piece)
            if known is not None:  # a piece that is a token is that token
                out[at] = known.to_bytes(4, "little")
            else:
                by_size.setdefault(1 << (len(piece) - 1).bit_length(), []).append(at)
        for size, members in by_size.items():
            step = max(1, _AT_ONCE // (2 * size))
            for first in range(0, len(members), step):
                part = members[first : first + step]
                for at, found in zip(part, self._merged([raw[i] for i in part], size), strict=True):
                    out[at] = found
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; an id that no token has raises KeyError."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Memory:
    """Ids of the pieces seen lately."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, bpe: ByteBpe, texts: list[list[str]]) -> list[bytes]:
        fresh = []
        for piece in set().union(*texts):
            if piece not in self.new:
                known = self.old.get(piece)
                if known is None:
                    fresh.append(piece)
                else:
                    self.new[piece] = known
        self.new.update(zip(fresh, bpe.encode_pieces(fresh), strict=True))
        found = [b"".join(map(self.new.__getitem__, pieces)) for pieces in texts]
        if len(self.new) > REMEMBERED:
            self.new, self.old = {}, self.new
        return found


@lru_cache(maxsize=4)
def _loaded(path: str) -> tuple[ByteBpe, _Memory]:
    return ByteBpe(path), _Memory()


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids: binary of little-endian unsigned 32-bit ids, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bpe, memory), split = _loaded(path), regex.compile(pattern).findall
        for batch in slices(batches, 1):
            ids = memory.ids(bpe, [split(text) for text in batch.column(1).to_pylist()])
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return documents.select("doc_id", whole_text(documents).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded: the bytes of the ids, for every row of `encode`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = _loaded(path)
        for batch in slices(batches, 1, 4 << 20):
            found = [bpe.decode(ids or b"") for ids in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "ids", "decoded"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def coded(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded of every row: `encode` and `decode` in one pass and one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bpe, memory), split = _loaded(path), regex.compile(pattern).findall
        for batch in slices(batches, 1):
            ids = memory.ids(bpe, [split(text) for text in batch.column(1).to_pylist()])
            decoded = [bpe.decode(each) for each in ids]
            yield pa.record_batch(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                names=["doc_id", "ids", "decoded"],
            )

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(documents).alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids binary, decoded binary")
