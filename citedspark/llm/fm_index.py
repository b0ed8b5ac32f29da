"""Benchmark decontamination with an FM-index of each training shard.

A shard is a slice of documents inside a task. Its words are reduced to the vocabulary of the
test phrases; every other word ends a run. Runs shorter than the shortest phrase cannot hold
one and are left out, all others are indexed: suffix order by prefix doubling, the
Burrows-Wheeler transform, a wavelet tree (in matrix form) for ranks, and every eighth text
position as a sample. All phrases are searched backwards side by side; occurrences are found by
walking to the next sample, and merged to spans of words to remove.

The phrases go to the tasks as a broadcast of at most PHRASE_BYTES of benchmark text; a larger
benchmark is dealt to as many blocks as it needs, each searched in the documents as they pass,
and the spans of the blocks are merged.

Nulls, ties, repeats: null and blank texts have no words, no spans and n_words 0; a benchmark
row without words has no phrases, one without item_id is searched and not named. Items that share a
phrase are all named.
Rows that repeat a doc_id are each returned. Only `doc_id`, `item_id` and `text` are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citedspark.llm.arrays import LETTERS, Words, carried, slices

WIDTH = 13
PHRASE_BYTES = 4 << 20
#: Text bytes of a shard; every SAMPLE-th position of its suffix array is kept.
SHARD_BYTES, SAMPLE = 1 << 20, 8


class WaveletTree:
    """Ranks of symbols in a sequence, level by level from the highest bit."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.bits = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        current = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (current >> level) & 1
            ones = np.zeros(len(bit) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(bit) - int(ones[-1]))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbols: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low = np.zeros(len(before), np.int64)
        high = before
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            bit = (symbols >> level) & 1 == 1
            low = np.where(bit, zeros + ones[low], low - ones[low])
            high = np.where(bit, zeros + ones[high], high - ones[high])
        return high - low


class FmIndex:
    """Index of a sequence of symbols 1.. in which 0 ends each run."""

    def __init__(self, text: np.ndarray, size: int) -> None:
        self.text_size = len(text)
        ends = np.flatnonzero(text == 0)
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))  # each end is its own symbol, so no suffixes are equal
        order, step = np.argsort(rank, kind="stable"), 1
        while True:
            sorted_rank = rank[order]
            new = np.concatenate([[0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])])
            dense = np.empty(len(rank), np.int64)
            dense[order] = new
            if new[-1] == len(rank) - 1:
                break
            after = np.zeros(len(rank), np.int64)
            after[:-step] = dense[step:] + 1
            rank = dense * (len(rank) + 1) + after
            order = np.argsort(rank)
            step *= 2
        self.last = text[order - 1]  # position 0 is preceded by the end of the last run
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.tree = WaveletTree(self.last, size)
        # The first position of each run is a sample too, so a walk never crosses an end.
        self.sampled = (order % SAMPLE == 0) | (self.last == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def _step(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.before[symbols] + self.tree.rank(symbols, rows)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, last row) of the phrases (rows of equal length) that occur."""
        found = np.arange(len(phrases))
        symbols = phrases[:, -1]
        low, high = self.before[symbols], self.before[symbols + 1]
        for place in range(phrases.shape[1] - 2, -1, -1):
            on = np.flatnonzero(low < high)
            found, symbols = found[on], phrases[found[on], place]
            low, high = self._step(symbols, low[on]), self._step(symbols, high[on])
        on = low < high
        return found[on], low[on], high[on]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled position and count the steps."""
        where = np.empty(len(rows), np.int64)
        walking = np.arange(len(rows))
        rows, steps = rows.copy(), 0
        while len(walking):
            here = self.sampled[rows]
            where[walking[here]] = self.samples[self.sample_rank[rows[here]]] + steps
            walking, rows = walking[~here], rows[~here]
            symbols = self.last[rows]
            rows = self._step(symbols, rows)
            steps += 1
        return where


class Windows:
    """Distinct windows of one length, as rows of word numbers, and the items that each belongs to."""

    def __init__(self, windows: np.ndarray, items: np.ndarray) -> None:
        keys = np.ascontiguousarray(windows).view(np.dtype((np.void, windows.dtype.itemsize * windows.shape[1]))).ravel()
        _, firsts, number = np.unique(keys, return_index=True, return_inverse=True)
        self.rows = windows[firsts]
        named = items >= 0
        owned = np.unique(np.stack([number[named], items[named]]), axis=1)
        self.items = owned[1]
        self.first = np.searchsorted(owned[0], np.arange(len(firsts) + 1))

    def owners(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `windows`, item) of every item of every given window."""
        counts = self.first[windows + 1] - self.first[windows]
        place = np.repeat(np.arange(len(windows)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return place, self.items[self.first[windows][place] + within]


class Phrases:
    """The windows of benchmark items, by length, all in arrays; items without a name own none."""

    def __init__(self, items: list[tuple[str | None, str]], width: int) -> None:
        words = Words(pa.array([text for _, text in items], pa.string()), LETTERS)
        self.vocabulary, ids = np.unique(words.hashes, return_inverse=True)
        ids = ids.astype(np.int32) + 1
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: at for at, name in enumerate(self.names)}
        item = np.array([number.get(name, -1) for name, _ in items], np.int32)
        counts = np.diff(words.first)
        sizes = np.minimum(counts, width)
        self.by_size: dict[int, Windows] = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == size)
            number_of = counts[rows] - size + 1
            within = np.arange(number_of.sum()) - np.repeat(np.cumsum(number_of) - number_of, number_of)
            starts = np.repeat(words.first[rows], number_of) + within
            self.by_size[size] = Windows(ids[starts[:, None] + np.arange(size)], np.repeat(item[rows], number_of))


#: The phrases a worker used last, by key: its tasks share them.
_LAST: dict[tuple[str, int], Phrases] = {}


def _phrases(key: str, items: list[tuple[str | None, str]], width: int) -> Phrases:
    if (key, width) not in _LAST:
        _LAST.clear()
        _LAST[key, width] = Phrases(items, width)
    return _LAST[key, width]


def _shard(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(text, word of each text position) of the runs long enough to hold a phrase."""
    vocabulary = phrases.vocabulary
    at = np.minimum(np.searchsorted(vocabulary, words.hashes), len(vocabulary) - 1)
    symbols = np.where(vocabulary[at] == words.hashes, at + 1, 0)
    known = np.flatnonzero(symbols)
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.ones(len(known), bool)
    begins[1:] = (np.diff(known) > 1) | (np.diff(words.row[known]) > 0)
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, len(known)))
    long = lengths >= min(phrases.by_size)
    keep = np.repeat(long, lengths)
    kept, lengths = known[keep], lengths[long]
    # One end after each run.
    place = np.arange(len(kept)) + np.repeat(np.arange(len(lengths)), lengths)
    text = np.zeros(len(kept) + len(lengths), np.int64)
    word = np.full(len(text), -1, np.int64)
    text[place], word[place] = symbols[kept], kept
    return text, word


def _hits(words: Words, phrases: Phrases) -> tuple[np.ndarray, dict[int, list[str]]]:
    """(a mark for each word inside an occurrence, sorted items of each row)."""
    marks = np.zeros(len(words.hashes) + 1, np.int64)
    pairs = [np.zeros((2, 0), np.int64)]
    text, word = _shard(words, phrases) if phrases.by_size else (np.zeros(0), np.zeros(0))
    if len(text):
        index = FmIndex(text, len(phrases.vocabulary) + 1)
        for size, windows in phrases.by_size.items():
            found, low, high = index.search(windows.rows)
            rows = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)] or [np.zeros(0, np.int64)])
            start = word[index.locate(rows)]
            np.add.at(marks, start, 1)
            np.add.at(marks, start + size, -1)
            at = np.unique(np.stack([words.row[start], np.repeat(found, high - low)]), axis=1)
            place, item = windows.owners(at[1])
            pairs.append(np.stack([at[0][place], item]))
    items: dict[int, list[str]] = {}
    for row, item in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist():
        items.setdefault(row, []).append(phrases.names[item])
    return np.cumsum(marks)[:-1] > 0, items


_SPANS = "array<struct<start:bigint,end:bigint>>"


def _searched(items: list[tuple[str | None, str]], width: int):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _phrases(key, items, width)
        for batch in slices(batches, 1, SHARD_BYTES):
            words = Words(batch.column(1), LETTERS)
            hit, found = _hits(words, phrases)
            count = batch.num_rows
            edge = hit.copy()
            edge[1:] &= ~hit[:-1] | (words.row[1:] != words.row[:-1])
            starts = np.flatnonzero(edge)
            close = hit.copy()
            close[:-1] &= ~hit[1:] | (words.row[1:] != words.row[:-1])
            ends = np.flatnonzero(close) + 1
            row = words.row[starts]
            base = words.first[row]
            offsets = np.searchsorted(row, np.arange(count + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(
                pa.array(offsets),
                pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], names=["start", "end"]),
            )
            named = pa.array([found.get(at, []) for at in range(count)], pa.list_(pa.string()))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(np.diff(words.first)), spans, named],
                names=["row", "text", "n_words", "spans", "items"],
            )

    return run


def _searched_in(rows: DataFrame, items: list[tuple[str | None, str]], width: int) -> DataFrame:
    added = f"n_words bigint, spans {_SPANS}, items array<string>"
    schema = StructType([*rows.select("row", "text").schema, *StructType.fromDDL(added)])
    return rows.select("row", "text").mapInArrow(_searched(items, width), schema)


def searched_rows(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each row of `documents` (as `carried` has it) with n_words, spans and items.

    Every block of the benchmark is searched in the rows as they pass. The words of items without
    item_id are in the spans as well; such items are not named.
    """
    asked = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropna(subset=["text"])
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // PHRASE_BYTES) or 1
    rows = carried(documents)
    for block in range(blocks):
        part = asked.where(F.expr(f"pmod(xxhash64(item_id, text), {blocks}) = {block}")) if blocks > 1 else asked
        items = [tuple(row) for row in part.distinct().collect()]
        if block:  # what earlier blocks found travels with the row
            rows = rows.select(F.struct("row", "spans", "items").alias("row"), "text")
        rows = _searched_in(rows, items, width)
        if block:
            rows = rows.select(
                F.col("row.row").alias("row"), "text", "n_words",
                F.concat("row.spans", "spans").alias("spans"), F.array_union("row.items", "items").alias("items"),
            )
    if blocks == 1:
        return rows
    # Overlapping spans of different blocks become one.
    joined = F.expr(f"""aggregate(array_sort(spans), cast(array() as {_SPANS}), (done, span) ->
        case when size(done) > 0 and element_at(done, -1).end >= span.start
             then concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start,
                  'end', greatest(element_at(done, -1).end, span.end))))
             else concat(done, array(span)) end)""")
    return rows.select("row", "text", "n_words", joined.alias("spans"), F.array_sort("items").alias("items"))


def removal_spans(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, spans of words inside a test phrase (merged), and items, for every row.

    A phrase is `width` consecutive words of an item, or a whole shorter item.
    """
    return searched_rows(documents, benchmark, width).select("row.doc_id", "n_words", "spans", "items")


def hit_words() -> Column:
    """How many words the spans cover."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])


def contaminated() -> Column:
    """The verdict on a row: a word is hit, and a twentieth of the words or more."""
    return (hit_words() > 0) & (F.lit(20) * hit_words() >= F.col("n_words"))
