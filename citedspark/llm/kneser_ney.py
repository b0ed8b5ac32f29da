"""Interpolated modified Kneser-Ney model of any order, counted in Spark and mapped by workers.

Counting. Words are 64-bit hashes; each task sends the distinct words, then the distinct n-grams
of the order, of its texts as packed arrays with counts, dealt to ranges of the hash of their
shortest beginning that holds a word of no great frequency: mostly the first word. A word with
more than a quarter of a share of all tokens is frequent, so no range gathers the
followers of frequent words. A range sorts and sums its arrays and writes them as sorted hash
arrays to the shared folder: n-grams with their counts, and their contexts with the sum of the
counts and the numbers of followers seen once, twice or more. It sends on the n-grams without
their first word, each with its number of left neighbours, as the counts of the order below; an
n-gram at the beginning of a text has no left neighbour and keeps its own count there. A range has as
many tokens as its part of the table, and so is worked on in shares of its hashes, RANGE_TOKENS each: what it was
sent is dealt to the shares and stays packed until a share is its turn, so memory does not follow the size of a range.

Sizes. N-grams are sent as numbers in a list of their own distinct words, in order, by byte planes
and compressed. A range's hashes are written in order, BLOCK to a block: of each block the first in
full, of the others the low 40 bits, which the first word does not fix. A hash is thus found
by its block and those bits. What was seen once is written without values; other
values take a byte, larger ones stand in a list beside them. Below the highest order nearly
every n-gram is a context of the order above, which lies in the same range: its count is written
beside that context, without a hash of its own, and one lookup finds both.

Scoring. Workers map the arrays into memory and look up each token, n-gram and context of a text
by binary search. With a, A and D the counts of an order, their sum over a context and discounts,

    p(v)     = (N(v) - D(N(v))) / sum N + lambda / (V + 1)
    p(v | h) = (a(hv) - D(a(hv))) / A(h) + gamma(h) p(v | h without its first word)

where a is the count in the highest order, and the number of left neighbours N below it. A token
near the beginning of its text has as much context as there is.

The arrays grow with the corpus; what reaches the driver is a few numbers a range and the
frequent words (at most OFTEN a range).

Nulls, ties, repeats: a null or blank text has one token, its end. Rows without doc_id are
scored and train; rows that repeat a doc_id are each scored and each train. Without training
rows every count is 0 and p is the uniform share. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citedspark.llm import shards
from citedspark.llm.arrays import NOT_BLANK, Words, mixed, slices, whole_text
from citedspark.session import scratch_path

#: Hashes of the end of a text, and of the place before its first word.
END, START = np.uint64(0xE5D0E5D0E5D0E5D0), np.uint64(0x57A757A757A757A7)
#: Tokens that a task counts together before it hands them on.
HELD = 1_500_000
#: Tokens of a range, by the mean of all, that are counted together.
RANGE_TOKENS = 4_000_000
#: Most frequent words that a range reports.
OFTEN = 256
#: Hashes that are written together.
BLOCK = 16
_TOP = np.uint64(0xFFFFFF0000000000)
_SHORT = np.uint64(16)


def _range_of(values: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a hash, by its top 24 bits."""
    return ((values >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end after each row, first token of each row and the total)."""
    words = Words(batch.column(1), NOT_BLANK)
    first = words.first + np.arange(len(words.first))
    tokens = np.full(first[-1], END)
    tokens[np.arange(len(words.hashes)) + words.row] = words.hashes
    return tokens, first


def _grams(tokens: np.ndarray, first: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(words of the n-gram that ends at each place that has one, those places)."""
    inside = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    places = np.flatnonzero(inside >= size - 2)
    words = [tokens[np.maximum(places - back, 0)] for back in range(size - 1, -1, -1)]
    words[0] = np.where(inside[places] == size - 2, START, words[0])
    return [word >> _SHORT for word in words], places


def _is_in(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _keys(words: list[np.ndarray], frequent: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sortable hashes of each beginning of n-grams, and whether all words but the last are frequent.

    Words are given by 48 bits. The top bits of a hash place it: they are those of the shortest
    beginning that holds a word that is not frequent, or of the whole if all words are.
    """
    chain, top = mixed(words[0]), words[0] << _SHORT
    keys = [(top & _TOP) | (chain & ~_TOP)]
    often, spread = _is_in(frequent, words[0]), np.zeros(len(words[0]), bool)
    for word in words[1:]:
        chain = mixed(chain * np.uint64(0xD6E8FEB86659FD93) + mixed(word))
        spread = often
        top = np.where(spread, mixed(chain), top)
        keys.append((top & _TOP) | (chain & ~_TOP))
        often = spread & _is_in(frequent, word)
    return keys, spread


def _squeezed(values: np.ndarray) -> bytes:
    """An array, compressed by byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd").compress(planes, asbytes=True)


def _restored(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return np.frombuffer(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.tobytes(), kind)


def _steps(values: np.ndarray) -> np.ndarray:
    """The first value and the steps from each to the next, modulo 2^64."""
    return np.diff(values, prepend=np.uint64(0))


def _numbered(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, the n-grams as numbers in that list, their order before they were sorted)."""
    known, ids, times = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
    often = np.argsort(-times, kind="stable")  # small numbers for what is frequent
    number = np.empty(len(known), np.uint32)
    number[often] = np.arange(len(known), dtype=np.uint32)
    ids = number[ids].reshape(len(words), -1)
    order = np.lexsort(ids[::-1])
    return known[often], ids[:, order], order


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, sums, a place of each key)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts[order], new) if len(new) else np.zeros(0, np.int64)
    return ordered[new], sums, order[new]


def _dealt(ranges: int, words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Compressed words, which are in order, and their counts for each range."""
    edges = np.searchsorted(_range_of(words, ranges), np.arange(ranges + 1))
    parts = np.flatnonzero(np.diff(edges)).tolist()
    packed = [[_squeezed(_steps(words[edges[p] : edges[p + 1]])) for p in parts], [_squeezed(counts[edges[p] : edges[p + 1]]) for p in parts]]
    return pa.record_batch([pa.array(parts, pa.int64()), *[pa.array(each, pa.binary()) for each in packed]], names=["part", "words", "counts"])


def _words_sent(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            held.clear()
            tokens.sort()
            new = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            counts = np.diff(np.append(new, len(tokens))).astype(np.uint32)
            return _dealt(ranges, tokens[new], counts)

        for batch in slices(batches, 1):
            tokens, first = _tokens(batch)
            held += [tokens, np.full(len(first) - 1, START)]
            if sum(map(len, held)) >= HELD:
                yield flush()
        if held:
            yield flush()

    return run


def _joined(table: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return [np.zeros(0, kind), *(_restored(data, kind) for data in table.column(name).to_pylist())]


def _words_kept(folder: str, ranges: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        sent = np.concatenate([np.cumsum(steps, dtype=np.uint64) for steps in _joined(table, "words", np.uint64)])
        words, counts, _ = _summed(sent, np.concatenate(_joined(table, "counts", np.uint32)).astype(np.int64))
        shards.write(folder, f"words-{part}", words)
        _write_values(folder, "counts", part, counts)
        real = words != START
        top = np.argsort(-counts, kind="stable")[:OFTEN]
        return pa.table(
            {
                "part": [part], "distinct": [int(real.sum())], "tokens": [int(counts[real].sum())],
                "often": pa.array([words[top].view(np.int64).tolist()], pa.list_(pa.int64())),
                "times": pa.array([counts[top].tolist()], pa.list_(pa.int64())),
            }
        )

    return run


#: A row is: n-grams of `level` words with counts n; or contexts of that many words with their
#: stats; or, with part -1, what a range has `seen` of the level.
_GRAM_SCHEMA = "level int, part long, words binary, grams binary, n binary, stats binary, seen array<long>"
_GRAM_TYPES = pa.schema(
    [
        ("level", pa.int32()), ("part", pa.int64()), ("words", pa.binary()), ("grams", pa.binary()), ("n", pa.binary()),
        ("stats", pa.binary()), ("seen", pa.list_(pa.int64())),
    ]
)


def _rows(ranges: int, words: list[np.ndarray], keys: np.ndarray, n: np.ndarray, stats: np.ndarray | None = None) -> pa.Table:
    """Rows for the ranges of the keys, which are in order."""
    edges = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))
    parts = np.flatnonzero(np.diff(edges)).tolist()
    packed = []
    for part in parts:
        own = slice(edges[part], edges[part + 1])
        known, ids, order = _numbered([word[own] for word in words])
        filled = b"" if stats is None else stats[own][order].tobytes()
        packed.append((_squeezed(_steps(known)), _squeezed(ids.reshape(-1)), _squeezed(n[own][order].astype(np.uint32)), filled))
    columns = [[len(words)] * len(parts), parts, *([row[k] for row in packed] for k in range(4)), [None] * len(parts)]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _GRAM_TYPES.types, strict=True)], schema=_GRAM_TYPES)


def _seen_row(level: int, counts: np.ndarray) -> pa.Table:
    seen = [int((counts == step).sum()) for step in (1, 2, 3, 4)] + [int((counts > 0).sum())]
    return pa.Table.from_pylist(
        [{"level": level, "part": -1, "words": b"", "grams": b"", "n": b"", "stats": b"", "seen": seen}], _GRAM_TYPES
    )


def _words_of(packed: Iterable[tuple], level: int) -> list[np.ndarray]:
    """The words of packed n-grams (words, grams and more)."""
    rows = (np.cumsum(_restored(words, np.uint64), dtype=np.uint64)[_restored(grams, np.uint32)].reshape(level, -1) for words, grams, *_ in packed)
    sides = list(zip(*rows, strict=True)) or [()] * level
    return [np.concatenate([np.zeros(0, np.uint64), *side]) for side in sides]


def _unpacked(table: pa.Table, level: int) -> list[np.ndarray]:
    """The words of a table's rows."""
    return _words_of(zip(table.column("words").to_pylist(), table.column("grams").to_pylist(), strict=True), level)


def _by_share(packed: tuple, level: int, ranges: int, shares: int, frequent: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """A row's n-grams (words, grams, n, stats) by the share of their range that they lie in, packed again with the row's words."""
    words, grams, n, stats = packed
    if shares == 1 or not grams:
        yield 0, packed
        return
    ids, times = _restored(grams, np.uint32).reshape(level, -1), _restored(n, np.uint32)
    keys, _ = _keys(_words_of([packed], level), frequent)
    share = _range_of(keys[-1], ranges * shares) % shares
    filled = np.frombuffer(stats, np.int64).reshape(-1, 4)
    for each in np.unique(share).tolist():
        own = share == each
        yield each, (words, _squeezed(ids[:, own].reshape(-1)), _squeezed(times[own]), filled[own].tobytes() if stats else b"")


def _whole_numbers(values: np.ndarray) -> list[np.ndarray]:
    """Numbers from 0 as places and values of those from 255 on, and all as bytes."""
    flat = values.reshape(-1)
    large = np.flatnonzero(flat >= 255)
    return [large, flat[large].astype(np.int64), np.minimum(flat, 255).astype(np.uint8)]


def _write_parts(folder: str, name: str, part: int, arrays: list[np.ndarray]) -> None:
    """Arrays in one file, after their sizes in bytes; those with wider items first."""
    sizes = np.array([len(arrays), *(array.nbytes for array in arrays)], np.int64)
    shards.write(folder, f"{name}-{part}", np.frombuffer(b"".join(array.tobytes() for array in (sizes, *arrays)), np.uint8))


def _parts(folder: str, name: str, part: int, kinds: tuple[str, ...]) -> list[np.ndarray]:
    whole = shards.kept(folder, f"{name}-{part}", "u1")
    at = 8 * (1 + len(kinds))
    found = []
    for size, kind in zip(whole[8:at].view("<i8").tolist(), kinds, strict=True):
        found.append(whole[at : at + size].view(kind))
        at += size
    return found


def _write_values(folder: str, name: str, part: int, values: np.ndarray) -> None:
    _write_parts(folder, name, part, _whole_numbers(values))


def _values_at(places: np.ndarray, width: int, large: np.ndarray, largest: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Rows of `width` numbers as `_whole_numbers` made them."""
    flat = places[:, None] * width + np.arange(width)
    found = small[flat].astype(np.int64)
    over = found == 255
    found[over] = largest[np.searchsorted(large, flat[over])]
    return found


class _Numbers:
    """Whole numbers taken in pieces."""

    def __init__(self) -> None:
        self.size, self.pieces = 0, ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)])

    def add(self, values: np.ndarray) -> None:
        large, largest, small = _whole_numbers(values)
        for pieces, piece in zip(self.pieces, (large + self.size, largest, small), strict=True):
            pieces.append(piece)
        self.size += len(small)

    def arrays(self) -> list[np.ndarray]:
        return [np.concatenate(pieces) for pieces in self.pieces]


class _Blocks:
    """Keys in order, taken in pieces, in blocks."""

    def __init__(self) -> None:
        self.count, self.rest = 0, np.zeros(0, np.uint64)
        self.pieces = ([self.rest], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint8)])

    def _cut(self, keys: np.ndarray) -> None:
        sides = keys[::BLOCK].copy(), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), (keys >> np.uint64(32) & np.uint64(0xFF)).astype(np.uint8)
        for pieces, piece in zip(self.pieces, sides, strict=True):
            pieces.append(piece)

    def add(self, keys: np.ndarray) -> None:
        self.count += len(keys)
        keys = np.concatenate([self.rest, keys])
        whole = len(keys) // BLOCK * BLOCK
        self._cut(keys[:whole])
        self.rest = keys[whole:].copy()

    def arrays(self) -> list[np.ndarray]:
        self._cut(np.pad(self.rest, (0, -len(self.rest) % BLOCK)))
        return [np.array([self.count], np.int64), *[np.concatenate(pieces) for pieces in self.pieces]]


class _Known:
    """Keys in order with their rows of values, taken in pieces and written together; those with the values `once` without them."""

    def __init__(self, once: tuple[int, ...]) -> None:
        self.once, self.sides = np.array(once), {kind: (_Blocks(), _Numbers()) for kind in ("once", "more")}

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        bare = (values == self.once).all(axis=1)
        self.sides["once"][0].add(keys[bare])
        self.sides["more"][0].add(keys[~bare])
        self.sides["more"][1].add(values[~bare])

    def write(self, folder: str, name: str, part: int) -> None:
        for kind, (blocks, numbers) in self.sides.items():
            (count, heads, low, high), (large, largest, small) = blocks.arrays(), numbers.arrays()
            _write_parts(folder, f"{name}-{kind}", part, [count, heads, large, largest, low, high, small])


def _write_known(folder: str, name: str, part: int, keys: np.ndarray, values: np.ndarray, once: tuple[int, ...]) -> None:
    """Write keys in order with their rows of values; those with the values `once` without them."""
    known = _Known(once)
    known.add(keys, values)
    known.write(folder, name, part)


_KNOWN = ("<i8", "<u8", "<i8", "<i8", "<u4", "u1", "u1")


def _looked_up(keys: np.ndarray, count: int, heads: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the keys are known, their places)."""
    block = np.searchsorted(heads, keys, side="right") - 1
    asked = np.flatnonzero(block >= 0)
    block = block[asked]
    sides = (keys[asked] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (keys[asked] >> np.uint64(32) & np.uint64(0xFF)).astype(np.uint8)
    which, inside = np.nonzero(low.reshape(-1, BLOCK)[block] == sides[0][:, None])
    place = block[which] * BLOCK + inside
    own = (place < count) & (high[place] == sides[1][which])
    return asked[which[own]], place[own]


def _grams_sent(ranges: int, order: int, frequent: np.ndarray):
    """The n-grams of the order; and shorter ones at the beginning of a text, which have no left neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {size: [] for size in range(2, order + 1)}

        def flush() -> Iterator[pa.RecordBatch]:
            for size, parts in held.items():
                words = [np.concatenate(side) for side in zip(*parts, strict=True)]
                parts.clear()
                keys, counts, at = _summed(_keys(words, frequent)[0][-1], np.ones(len(words[0]), np.int64))
                yield from _rows(ranges, [word[at] for word in words], keys, counts).to_batches()

        total = 0
        for batch in slices(batches, 1):
            tokens, first = _tokens(batch)
            for size in held:
                words, _ = _grams(tokens, first, size)
                if size < order:
                    begins = words[0] == START >> _SHORT
                    words = [word[begins] for word in words]
                held[size].append(words)
            total += len(tokens)
            if total >= HELD:
                yield from flush()
                total = 0
        if total:
            yield from flush()

    return run


class _Range:
    """What a range keeps of a level, share by share.

    N-grams' counts are written beside the contexts of the level above, if there is one (`above`), and else with keys.
    """

    def __init__(self, folder: str, level: int, part: int, above: bool) -> None:
        self.folder, self.level, self.part = folder, level, part
        self.grams, self.contexts = _Known((1,)), _Known((1, 1, 0, 0))
        self.spread: tuple[list[np.ndarray], list[np.ndarray]] = ([np.zeros(0, np.uint64)], [np.zeros((0, 4), np.int64)])
        self.beside = {kind: np.zeros(int(self._above(kind)[0][0]), np.uint32) for kind in (("once", "more") if above else ())}

    def _above(self, kind: str) -> list[np.ndarray]:
        return _parts(self.folder, f"contexts{self.level + 1}-{kind}", self.part, _KNOWN)

    def add_grams(self, keys: np.ndarray, counts: np.ndarray) -> None:
        rest = np.ones(len(keys), bool)
        for kind, filled in self.beside.items():
            _, heads, _, _, low, high, _ = self._above(kind)
            own, place = _looked_up(keys, len(filled), heads, low, high)
            filled[place] = counts[own]
            rest[own] = False
        self.grams.add(keys[rest], counts[rest, None])

    def add_spread(self, keys: np.ndarray, stats: np.ndarray) -> None:
        """Contexts of frequent words only, whose n-grams lie in several ranges: their stats summed."""
        for pieces, piece in zip(self.spread, _spread(keys, stats), strict=True):
            pieces.append(piece)

    def write(self) -> None:
        folder, level, part = self.folder, self.level, self.part
        for kind, filled in self.beside.items():
            _write_values(folder, f"beside{level}-{kind}", part, filled)
        self.grams.write(folder, f"grams{level}", part)
        self.contexts.write(folder, f"contexts{level}", part)
        _write_spread(folder, level + 1, part, *[np.concatenate(pieces) for pieces in self.spread])


def _grams_kept(folder: str, ranges: int, frequent: np.ndarray, level: int, above: bool = False, shares: int = 1):
    """Write a range's n-grams of a level and their contexts, share by share; send on what the lower levels count.

    `above` says that the contexts of the level above are written.
    """

    def counted(kept: _Range, rows: list[tuple]) -> Iterator[pa.Table]:
        spread_rows = [row for row in rows if row[3]]
        stats = np.frombuffer(b"".join(row[3] for row in spread_rows), np.int64).reshape(-1, 4)
        kept.add_spread(_keys(_words_of(spread_rows, level), frequent)[0][-1], stats)
        rows = [row for row in rows if not row[3]]
        words, n = _words_of(rows, level), np.concatenate([np.zeros(0, np.uint32), *(_restored(row[2], np.uint32) for row in rows)]).astype(np.int64)
        del rows
        keys, spread = _keys(words, frequent)
        context = keys[-2]
        known, counts, at = _summed(keys[-1], n)
        del keys, n
        words, context, spread = [word[at] for word in words], context[at], spread[at]
        kept.add_grams(known, counts)
        yield _seen_row(level, counts)
        for own in (~spread, spread):
            at_context, place, of_context = np.unique(context[own], return_index=True, return_inverse=True)
            found = np.zeros((len(at_context), 4), np.int64)
            np.add.at(found[:, 0], of_context, counts[own])
            np.add.at(found, (of_context, np.minimum(counts[own], 3)), 1)
            if own is spread:
                first = [word[own][place] for word in words[:-1]]
                yield _rows(ranges, first, at_context, np.zeros(len(at_context)), found)
            else:
                kept.contexts.add(at_context, found)
        shorter = words[1:]
        suffix, lefts, at = _summed(_keys(shorter, frequent)[0][-1], np.ones(len(known), np.int64))
        yield _rows(ranges, [word[at] for word in shorter], suffix, lefts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in range(shares)]
        part = -1
        for batch in batches:
            part = batch.column("part")[0].as_py()
            passed = pa.Table.from_batches([batch]) if part < 0 else pa.Table.from_batches([batch.filter(pc.less(batch.column("level"), level))])
            if passed.num_rows:
                yield from passed.cast(_GRAM_TYPES).to_batches()
            if part < 0:
                continue
            own = batch.filter(pc.equal(batch.column("level"), level))
            for packed in zip(*[own.column(name) for name in ("words", "grams", "n", "stats")], strict=True):
                for share, piece in _by_share(tuple(value.as_py() for value in packed), level, ranges, shares, frequent):
                    held[share].append(piece)
        if part < 0:
            return
        kept = _Range(folder, level, part, above)
        for share in range(shares):
            rows, held[share] = held[share], []
            for table in counted(kept, rows):
                yield from table.to_batches()
        kept.write()

    return run


def _spread(keys: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, their stats summed)."""
    known, of_key = np.unique(keys, return_inverse=True)
    found = np.zeros((len(known), 4), np.int64)
    np.add.at(found, of_key, stats)
    return known, found


def _write_spread(folder: str, level: int, part: int, keys: np.ndarray, found: np.ndarray) -> None:
    shards.write(folder, f"spread{level}-{part}", keys)
    shards.write(folder, f"spreadvalues{level}-{part}", found)


def _words_left(folder: str, frequent: np.ndarray):
    """Write how many left neighbours each word has."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part < 0:
            return table.cast(_GRAM_TYPES)
        stats = np.frombuffer(b"".join(table.column("stats").to_pylist()), np.int64).reshape(-1, 4)
        filled = np.array([len(value) > 0 for value in table.column("stats").to_pylist()], bool)
        _write_spread(folder, 2, part, *_spread(_keys(_unpacked(table.filter(pa.array(filled)), 1), frequent)[0][-1], stats))
        table = table.filter(pa.array(~filled))
        words = shards.mapped(folder, f"words-{part}", "<u8") >> _SHORT
        place = np.searchsorted(words, _unpacked(table, 1)[0])
        lefts = np.bincount(place, weights=np.concatenate(_joined(table, "n", np.uint32)), minlength=len(words)).astype(np.int64)
        _write_values(folder, "lefts", part, lefts)
        return _seen_row(1, lefts)

    return run


def discounts(seen: list[int]) -> np.ndarray:
    """D(0) to D(3 and more) from how many counts are 1, 2, 3 and 4."""
    n = [float(value) for value in seen[:4]]
    if n[0] == 0 or n[1] == 0 or n[2] == 0:  # too few counts for the estimate
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(value, 0.05), k) for k, value in enumerate(found, 1))])


class Model:
    """Where the arrays are, and the few numbers that hold for all of them."""

    def __init__(self, folder: str, ranges: int, frequent: np.ndarray, tokens: int, distinct: int, seen: list[list[int]]) -> None:
        self.folder, self.ranges, self.tokens, self.distinct, self.frequent = folder, ranges, tokens, distinct, frequent
        #: Of the orders 1, 2 and so on.
        self.discounts = [discounts(own) for own in seen]
        self.order, of_lefts, discount = len(seen), seen[0], self.discounts[0]
        self.pairs = seen[1][4]
        spent = discount[1] * of_lefts[0] + discount[2] * of_lefts[1] + discount[3] * (of_lefts[4] - of_lefts[0] - of_lefts[1])
        self.uniform = (spent / self.pairs if self.pairs else 1.0) / (distinct + 1)


class Scorer:
    """Lookups in the mapped arrays."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def _found(self, keys: np.ndarray, width: int, lookup: Callable[[int, np.ndarray], Iterator[tuple]]) -> np.ndarray:
        """A row of values for each key, from the lookup in a range (which of the keys, columns, values); else zeros."""
        distinct, which = np.unique(keys, return_inverse=True)
        out = np.zeros((len(distinct), width), np.int64)
        part = _range_of(distinct, self.model.ranges)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for own, columns, values in lookup(int(part[a]), distinct[a:b]):
                out[a + own, columns] = values
        return out[which]

    def _in_order(self, name: str, part: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = shards.kept(self.model.folder, f"{name}-{part}", "<u8")
        if not len(known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        own = np.flatnonzero(known[place] == keys)
        return own, place[own]

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Counts and numbers of left neighbours."""

        def lookup(part: int, keys: np.ndarray) -> Iterator[tuple[np.ndarray, object]]:
            own, place = self._in_order("words", part, keys)
            sides = [_values_at(place, 1, *_parts(self.model.folder, name, part, ("<i8", "<i8", "u1"))) for name in ("counts", "lefts")]
            yield own, slice(None), np.concatenate(sides, axis=1)

        return self._found(hashes, 2, lookup)

    def _grams_of(self, part: int, level: int, keys: np.ndarray, which: np.ndarray) -> Iterator[tuple]:
        """Counts of those of the keys (their places) that are written with keys."""
        for kind in ("more", "once"):
            own, place, values = self._table(f"grams{level}-{kind}", part, keys[which])
            yield which[own], slice(0, 1), 1 if kind == "once" else values(1)
            which = np.delete(which, own)

    def _contexts_of(self, part: int, level: int, keys: np.ndarray, beside: bool) -> Iterator[tuple]:
        """Stats of keys as contexts of the level, and their counts `beside` them or, for the others, with keys."""
        folder, rest = self.model.folder, np.arange(len(keys))
        for kind in ("more", "once"):
            own, place, values = self._table(f"contexts{level}-{kind}", part, keys[rest])
            yield rest[own], slice(1, 5), (1, 1, 0, 0) if kind == "once" else values(4)
            if beside:
                yield rest[own], slice(0, 1), _values_at(place, 1, *_parts(folder, f"beside{level - 1}-{kind}", part, ("<i8", "<i8", "u1")))
            rest = np.delete(rest, own)
        own, place = self._in_order(f"spread{level}", part, keys[rest])  # contexts of frequent words
        yield rest[own], slice(1, 5), shards.kept(folder, f"spreadvalues{level}-{part}", "<i8").reshape(-1, 4)[place]
        if beside:
            yield from self._grams_of(part, level - 1, keys, rest)

    def _table(self, name: str, part: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[int], np.ndarray]]:
        count, heads, large, largest, low, high, small = _parts(self.model.folder, name, part, _KNOWN)
        own, place = _looked_up(keys, int(count[0]), heads, low, high)
        return own, place, lambda width: _values_at(place, width, large, largest, small)

    def grams(self, level: int, keys: np.ndarray) -> np.ndarray:
        """Counts of n-grams and, below the highest order, their stats as contexts of the order above."""
        if level < self.model.order:
            return self._found(keys, 5, lambda part, own: self._contexts_of(part, level + 1, own, True))
        return self._found(keys, 1, lambda part, own: self._grams_of(part, level, own, np.arange(len(own))))

    def words_before(self, keys: np.ndarray) -> np.ndarray:
        """Stats of single words as contexts."""
        return self._found(keys, 5, lambda part, own: self._contexts_of(part, 2, own, False))[:, 1:]

    def scored(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, log10 probability) of each row."""
        model, rows = self.model, len(first) - 1
        distinct, which = np.unique(tokens, return_inverse=True)
        found = self.words(distinct)
        base = np.log10((found[:, 0] + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
        lefts = found[:, 1]
        lower = model.uniform + np.maximum(lefts - model.discounts[0][np.minimum(lefts, 3)], 0.0) / max(1, model.pairs)
        share, shorter = lower[which], np.zeros((0, 4), np.int64)
        for level in range(2, model.order + 1):
            discount = model.discounts[level - 1]
            words, places = _grams(tokens, first, level)
            keys, _ = _keys(words, model.frequent)
            own = self.grams(level, keys[-1])
            times = own[:, 0]
            # A context is the n-gram of the order below that ends a place before.
            stats = self.words_before(keys[-2]) if level == 2 else shorter[places - 1]
            shorter = np.zeros((len(tokens), 4), np.int64)
            shorter[places] = own[:, 1:] if level < model.order else 0
            gamma = stats[:, 1:] @ discount[1:] / np.maximum(stats[:, 0], 1)
            gamma[stats[:, 0] == 0] = 1.0
            top = np.maximum(times - discount[np.minimum(times, 3)], 0.0) / np.maximum(stats[:, 0], 1)
            share[places] = top + gamma * share[places]
        score = np.log10(share)
        row = np.repeat(np.arange(rows), np.diff(first))
        sums = [np.bincount(row, weights=values, minlength=rows) for values in (found[which, 0] > 0, base[which], score)]
        return sums[0].astype(np.int64), sums[1], sums[2]


def _with_every_range(dealt: DataFrame, ranges: int, names: list[str]) -> DataFrame:
    """The rows and an empty one for each range, so that every range writes its arrays."""
    empty = dealt.sparkSession.range(ranges).select(
        F.col("id").alias("part"), *[F.lit(b"").alias(name) for name in names]
    )
    return dealt.select("part", *names).union(empty)


def _with_empty_grams(dealt: DataFrame, ranges: int, level: int) -> DataFrame:
    empty = dealt.sparkSession.range(ranges).select(
        F.lit(level).alias("level"), F.col("id").alias("part"), *[F.lit(b"").alias(name) for name in ("words", "grams", "n", "stats")],
        F.lit(None).cast("array<long>").alias("seen"),
    )
    return dealt.union(empty)


def trained(documents: DataFrame, folder: str, order: int = 2) -> Model:
    """Count the texts and write the arrays of a model of the order, two or more, below `folder`."""
    if order < 2:
        raise ValueError("the order is two or more")
    texts = documents.select("doc_id", whole_text(documents).alias("text"))
    ranges = max(1, documents.rdd.getNumPartitions())
    words = texts.mapInArrow(_words_sent(ranges), "part long, words binary, counts binary")
    kept = (
        _with_every_range(words, ranges, ["words", "counts"]).groupBy("part")
        .applyInArrow(_words_kept(folder, ranges), "part long, distinct long, tokens long, often array<long>, times array<long>")
        .collect()
    )
    tokens, distinct = sum(row["tokens"] for row in kept), sum(row["distinct"] for row in kept)
    shares = max(1, -(-tokens // (ranges * RANGE_TOKENS)))
    limit = max(1, tokens // (4 * ranges * shares))
    often = [word for row in kept for word, n in zip(row["often"], row["times"], strict=True) if n > limit]
    frequent = np.unique(np.array(often, np.int64).view(np.uint64) >> _SHORT)
    grams = texts.mapInArrow(_grams_sent(ranges, order, frequent), _GRAM_SCHEMA)
    for level in range(order, 0, -1):
        keep = _grams_kept(folder, ranges, frequent, level, level < order, shares) if level > 1 else _words_left(folder, frequent)
        grams = _with_empty_grams(grams, ranges, level).groupBy("part").applyInArrow(keep, _GRAM_SCHEMA)
    seen = np.zeros((order, 5), np.int64)
    for row in grams.select("level", "seen").collect():
        seen[row["level"] - 1] += row["seen"]
    return Model(folder, ranges, frequent, tokens, distinct, seen.tolist())


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, 1):
            tokens, first = _tokens(batch)
            known, base, score = scorer.scored(tokens, first)
            yield pa.record_batch(
                [
                    batch.column(0), pa.array(np.diff(first)), pa.array(known),
                    pa.array(np.full(len(known), model.tokens)), pa.array(base), pa.array(score),
                ],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def scored(documents: DataFrame, training: Column, order: int = 2) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score, for every row.

    The model of the order learns from the rows where `training` holds; perplexity is 10 ** (-score / n_tokens).
    """
    folder = scratch_path(documents.sparkSession, "kneser-ney")
    model = trained(documents.where(training), folder, order)
    texts = documents.select("doc_id", whole_text(documents).alias("text"))
    return texts.mapInArrow(
        _scored(model),
        "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
