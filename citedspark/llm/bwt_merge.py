"""Repeated passages by merging Burrows-Wheeler transforms of shards.

Where a repeat can be. Every string of LENGTH bytes has an anchor, the leftmost least hash of
its GRAM-byte strings, and equal strings have equal anchors at equal places. A segment is a run
of neighbouring strings with one anchor. Segments whose anchor stands once in the corpus hold no
repeat; all others are gathered by their anchor, each distinct content once and with its count.

Where very many contents share an anchor, as around a passage that many documents quote, their
segments are cut further: to STEPS strings at a time, told apart by the bytes that those strings
have in common, and where that is still too many, to single strings. So no gathering holds more
than HOT contents of one anchor, and equal strings still meet.

What is repeated. The segments of an anchor range are cut into shards. A shard's suffixes, taken
in blocks of BLOCK bytes as symbols, are sorted, which gives its transform: before each suffix,
the symbol that precedes it. The transforms are merged by refining their interleave: from the
order by h symbols, placing each suffix's predecessor under its preceding symbol gives the order
by h + 1, and no suffix is sorted again. Suffixes that share LENGTH bytes are the intervals that
LENGTH / BLOCK refinements leave together; an interval that stands for two places or more is a
repeat, and the places go back to the documents.

Arrays that tasks share (anchors and contents to gather, repeats to remove) are sorted hash
arrays in the shared folder, mapped by the tasks that look them up.

Nulls, ties, repeats: a null text is the empty text. Strings are judged on the input; copies in
one document count, also overlapping ones. Rows that repeat a doc_id are documents of their own.
Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citedspark.llm import shards
from citedspark.llm.arrays import gram_hashes, mixed, prefix_sums, range_hashes, slices, text_bytes, whole_text
from citedspark.session import scratch_path

LENGTH, GRAM, BLOCK = 200, 24, 40
_WINDOW = LENGTH - GRAM + 1
#: Entries, or bytes of content, that a task holds before it hands them on.
HELD, HELD_BYTES = 400_000, 8 << 20
#: Bytes of segments merged together, of a shard, and of text that is cut to segments at a time.
CHUNK, SHARD, SLICE = 1 << 19, 1 << 17, 1 << 19
#: Contents of an anchor beyond which its segments are cut, and strings of a cut, level by level.
HOT, STEPS = 1000, (16, 1)
#: Ranges of anchors for each partition of the input.
RANGES = 4


class Segments:
    """Segments of a slice: first and last string start, anchor hash and content hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.sums = prefix_sums(data)
        size = len(data)
        lengths = np.diff(offsets)
        if size < LENGTH or lengths.max(initial=0) < LENGTH:
            self.first = self.last = self.at = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, np.uint64)
            return
        grams = gram_hashes(self.sums, GRAM)
        ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        # Least of every _WINDOW neighbours, from least-so-far runs in both directions of blocks.
        blocks = -(-len(ranked) // _WINDOW)
        padded = np.full(blocks * _WINDOW, np.uint64(2**64 - 1))
        padded[: len(ranked)] = ranked
        padded = padded.reshape(blocks, _WINDOW)
        ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        strings = len(ranked) - _WINDOW + 1
        at = np.minimum(behind[:strings], ahead[_WINDOW - 1 : _WINDOW - 1 + strings])
        at &= np.uint64(0xFFFFFFFF)
        at = at.view(np.int64)
        # Strings that lie inside one document.
        valid = np.ones(strings, bool)
        for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            valid[max(start, end - LENGTH + 1) : end] = False
        changes = np.flatnonzero((at[1:] != at[:-1]) | (valid[1:] != valid[:-1])) + 1
        starts = np.concatenate([[0], changes])
        stops = np.append(changes, strings) - 1
        inside = valid[starts]
        self.first, self.last = starts[inside], stops[inside]
        self.at = at[self.first]
        self.anchor = mixed(grams[self.at])  # least hashes are small; mixed again they fill all ranges
        self.content = range_hashes(self.sums, self.first, self.last + LENGTH)

    def cut(self, which: np.ndarray, step: int) -> Segments:
        """The given segments cut to `step` strings; a cut's anchor tells apart what its strings share."""
        first, last, at = self.first[which], self.last[which], self.at[which]
        high, low = (at - first) // step, (at - last) // step  # a cut is told by its distance from the anchor
        count = high - low + 1
        origin = np.repeat(np.arange(len(first)), count)
        block = high[origin] - (np.arange(len(origin)) - np.repeat(np.cumsum(count) - count, count))
        out = object.__new__(Segments)
        out.sums, out.at = self.sums, at[origin]
        latest = out.at - step * block
        out.first = np.maximum(first[origin], latest - step + 1)
        out.last = np.minimum(last[origin], latest)
        shared = range_hashes(self.sums, latest, latest - step + 1 + LENGTH)
        out.anchor = mixed(self.anchor[which][origin] + shared + block.astype(np.uint64))
        out.content = range_hashes(self.sums, out.first, out.last + LENGTH)
        return out


def _range_of(values: np.ndarray, ranges: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _tags(batch: pa.RecordBatch, offsets: np.ndarray, segments: Segments) -> np.ndarray:
    """A number for each segment's place, the same whenever the place is read."""
    ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    row = np.searchsorted(offsets, segments.first, side="right") - 1
    place = (segments.first - offsets[row]).astype(np.uint64)
    return (mixed(ids[row] * np.uint64(0xD6E8FEB86659FD93) + place) >> np.uint64(32)).astype(np.uint32)


def _dealt(ranges: int, of: np.ndarray, arrays: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    edges = np.searchsorted(of, np.arange(ranges + 1))
    parts = np.flatnonzero(np.diff(edges))
    packed = [[array[edges[p] : edges[p + 1]].tobytes() for p in parts.tolist()] for array in arrays]
    return pa.record_batch([pa.array(parts), *[pa.array(each, pa.binary()) for each in packed]], names=["part", *names])


def _grouped(anchor: np.ndarray, content: np.ndarray, n: np.ndarray, tag: np.ndarray):
    """Distinct (anchor, content) in order, with summed counts and the least tag."""
    order = np.lexsort((content, anchor))
    anchor, content, n, tag = anchor[order], content[order], n[order], tag[order]
    if not len(anchor):
        return anchor, content, n, tag
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]))
    return anchor[new], content[new], np.add.reduceat(n, new), np.minimum.reduceat(tag, new)


_SEEN = ["anchors", "contents", "n", "tags"]


def _at_level(found: Segments, folder: str, ranges: int, level: int) -> Segments:
    """The segments that are compared at a level: at first all, then cuts of what was too many."""
    for below in range(level):
        hot = [entry for _, entry, _ in _looked_up(folder, ranges, f"hot-{below}", found.anchor, found.anchor)]
        found = found.cut(np.sort(np.concatenate([np.zeros(0, np.int64), *hot])), STEPS[below])
    return found


def _seen(folder: str, ranges: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            anchor, content, n, tag = _grouped(*(np.concatenate(each) for each in zip(*held, strict=True)))
            held.clear()
            return _dealt(ranges, _range_of(anchor, ranges), [anchor, content, n.astype(np.uint32), tag], _SEEN)

        for batch in slices(batches, 1, SLICE):
            data, offsets = text_bytes(batch.column(1))
            found = _at_level(Segments(data, offsets), folder, ranges, level)
            if len(found.first):
                held.append((found.anchor, found.content, np.ones(len(found.first), np.int64), _tags(batch, offsets, found)))
            if sum(len(each[0]) for each in held) >= HELD:
                yield flush()
        if held:
            yield flush()

    return run


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _kept(folder: str, level: int, most: int):
    """Write the contents of anchors that stand twice or more, with counts and places to read them.

    Anchors of too many contents are written by themselves, for the next level.
    """

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        anchor, content, n, tag = _grouped(
            _joined(table, "anchors", np.uint64), _joined(table, "contents", np.uint64),
            _joined(table, "n", np.uint32).astype(np.int64), _joined(table, "tags", np.uint32),
        )
        if len(anchor):
            new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            contents = np.diff(np.append(new, len(anchor)))
            many = (contents > most) & (level < len(STEPS))
            hot = anchor[new[many]]
            twice = np.repeat((np.add.reduceat(n, new) >= 2) & ~many, contents)
            content, n, tag = content[twice], n[twice], tag[twice]
            order = np.argsort(content)
            content, n, tag = content[order], n[order], tag[order]
        else:
            hot = anchor
        shards.write(folder, f"hot-{level}-{part}", hot)
        shards.write(folder, f"content-{level}-{part}", content)
        shards.write(folder, f"n-{level}-{part}", np.minimum(n, 2).astype(np.uint8))
        shards.write(folder, f"tag-{level}-{part}", tag)
        return pa.table({"part": [part], "hot": [len(hot)]})

    return run


def _looked_up(folder: str, ranges: int, table: str, anchor: np.ndarray, content: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(range, entries, their places in the range's table) of the contents that it holds."""
    of = _range_of(anchor, ranges)
    order = np.lexsort((content, of))
    edges = np.searchsorted(of[order], np.arange(ranges + 1))
    for part in np.flatnonzero(np.diff(edges)).tolist():
        known = shards.kept(folder, f"{table}-{part}", "<u8")
        own = order[edges[part] : edges[part + 1]]
        if len(known):
            place = np.minimum(np.searchsorted(known, content[own]), len(known) - 1)
            hit = known[place] == content[own]
            yield part, own[hit], place[hit]


_GATHERED = ["anchors", "contents", "sizes", "bytes"]


def _gathered(folder: str, ranges: int, level: int):
    """Each content to be compared, read at one of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            parts = sorted({each[0] for each in held})
            packed = [
                [b"".join(each[k].tobytes() if k < 4 else each[4] for each in held if each[0] == part) for part in parts]
                for k in (1, 2, 3, 4)
            ]
            held.clear()
            return pa.record_batch(
                [pa.array(parts), *[pa.array(each, pa.binary()) for each in packed]], names=["part", *_GATHERED]
            )

        for batch in slices(batches, 1, SLICE):
            data, offsets = text_bytes(batch.column(1))
            found = _at_level(Segments(data, offsets), folder, ranges, level)
            tags = _tags(batch, offsets, found)
            for part, entry, place in _looked_up(folder, ranges, f"content-{level}", found.anchor, found.content):
                entry = entry[shards.kept(folder, f"tag-{level}-{part}", "<u4")[place] == tags[entry]]
                if not len(entry):
                    continue
                first, end = found.first[entry], found.last[entry] + LENGTH
                raw = b"".join([data[a:b].tobytes() for a, b in zip(first.tolist(), end.tolist(), strict=True)])
                held.append((part, found.anchor[entry], found.content[entry], (end - first).astype(np.uint16), raw))
                size += len(raw)
            if size >= HELD_BYTES:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _order(symbol: np.ndarray, has: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of one shard in the order of their suffixes, to a depth of LENGTH bytes."""
    place = np.zeros(rows[-1] + 1 if len(rows) else 0, np.uint64)
    ends, inner = rows[~has[rows]], rows[has[rows]]
    order = np.concatenate([ends, inner])
    for _ in range(LENGTH // BLOCK):
        place[order] = np.arange(len(order), dtype=np.uint64)
        keys = (symbol[inner] << np.uint64(32)) | place[inner + BLOCK]
        keys.sort()
        order = np.concatenate([ends, order[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)] - BLOCK])
    return order


def merged_intervals(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, interval) of the suffixes that have LENGTH bytes; equal intervals share those bytes.

    Rows number the places start..end of every segment in turn (the place behind it included).
    """
    sizes = ends - starts + 1
    base = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    segment = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(total) - base[segment]
    place = starts[segment] + within
    has = place + BLOCK <= ends[segment]
    sums = prefix_sums(data)
    hashes = range_hashes(sums, place[has], place[has] + BLOCK)
    order = np.argsort(hashes)
    ordered = hashes[order]
    number = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)])).astype(np.uint64)
    symbol = np.zeros(total, np.uint64)
    symbol[np.flatnonzero(has)[order]] = number
    # Transforms of the shards: whole segments, about SHARD bytes each.
    cuts = np.unique(np.searchsorted(base, np.arange(0, total, SHARD)))
    edges = np.append(base[cuts[cuts < len(base)]], total)
    edges[0] = 0
    orders = [
        _order(symbol[a:b], has[a:b], np.arange(b - a)) + a for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
    ]
    rows = np.concatenate(orders)  # every shard's suffixes in order, shard after shard
    shard = np.repeat(np.arange(len(orders), dtype=np.uint16), [len(each) for each in orders])
    before = within[rows] >= BLOCK  # whether a symbol precedes
    preceding = np.where(before, symbol[np.where(before, rows - BLOCK, 0)], np.uint64(0))
    is_end = ~has[rows]
    end_shards = shard[is_end]
    interleave = shard.copy()
    group = np.zeros(total, np.int64)
    for _ in range(LENGTH // BLOCK):
        # The interleave says from which shard the next suffix comes; inside a shard the order stands.
        taken = np.empty(total, np.int64)
        taken[np.argsort(interleave, kind="stable")] = np.arange(total)
        symbols = preceding[taken]
        keys = (symbols[symbols > 0] << np.uint64(32)) | np.flatnonzero(symbols > 0).astype(np.uint64)
        keys.sort()
        source = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        above = keys >> np.uint64(32)
        new = np.ones(len(source), bool)
        new[1:] = (above[1:] != above[:-1]) | (group[source][1:] != group[source][:-1])
        interleave = np.concatenate([end_shards, interleave[source]])
        group = np.concatenate([np.zeros(len(end_shards), np.int64), np.cumsum(new)])
    taken = np.empty(total, np.int64)
    taken[np.argsort(interleave, kind="stable")] = np.arange(total)
    row = rows[taken]
    long = place[row] + LENGTH <= ends[segment[row]]
    return row[long], group[long]


def _compared(folder: str, level: int):
    """Write, for each content of a range, the runs of its strings that stand elsewhere too."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        anchor, content = _joined(table, "anchors", np.uint64), _joined(table, "contents", np.uint64)
        sizes = _joined(table, "sizes", np.uint16).astype(np.int64)
        data = _joined(table, "bytes", np.uint8)
        known, times = shards.kept(folder, f"content-{level}-{part}", "<u8"), shards.kept(folder, f"n-{level}-{part}", "<u1")
        begin = np.cumsum(sizes) - sizes
        order = np.lexsort((content, anchor))
        if len(order):  # a content that two places sent
            same = (content[order][1:] == content[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])
            order = order[np.concatenate([[True], ~same])]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        first = 0
        while first < len(order):
            filled = np.cumsum(sizes[order[first:]])
            last = first + max(1, int(np.searchsorted(filled, CHUNK)))
            while last < len(order) and anchor[order[last]] == anchor[order[last - 1]]:
                last += 1
            own = order[first:last]
            first = last
            # The chunk's own bytes, so that hashing follows the chunk and not the range.
            ends = np.cumsum(sizes[own])
            local = np.repeat(begin[own] - (ends - sizes[own]), sizes[own]) + np.arange(ends[-1])
            row, group = merged_intervals(data[local], ends - sizes[own], ends)
            width = sizes[own] + 1
            base = np.cumsum(width) - width
            segment = np.searchsorted(base, row, side="right") - 1
            weight = times[np.searchsorted(known, content[own])].astype(np.int64)
            repeated = np.bincount(group, weights=weight[segment])[group] >= 2
            row = np.sort(row[repeated])
            segment = np.searchsorted(base, row, side="right") - 1
            new = np.ones(len(row), bool)
            new[1:] = (np.diff(row) > 1) | (np.diff(segment) > 0)
            starts = np.flatnonzero(new)
            stops = np.append(starts[1:], len(row))[: len(starts)] - 1
            at = segment[starts]
            found.append((content[own][at], row[starts] - base[at], row[stops] - base[at]))
        nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        key, start, stop = (np.concatenate(each) for each in zip(nothing, *found, strict=True))
        order = np.lexsort((start, key))
        shards.write(folder, f"repeat-{level}-{part}", key[order])
        shards.write(folder, f"start-{level}-{part}", start[order].astype(np.uint16))
        shards.write(folder, f"stop-{level}-{part}", stop[order].astype(np.uint16))
        return pa.table({"part": [part], "runs": [len(key)]})

    return run


_SCHEMA = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _removed(folder: str, ranges: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE):
            data, offsets = text_bytes(batch.column(1))
            found = Segments(data, offsets)
            depth = np.zeros(len(data) + 1, np.int64)
            for level in range(levels):
                own = _at_level(found, folder, ranges, level)
                for part, entry, place in _looked_up(folder, ranges, f"repeat-{level}", own.anchor, own.content):
                    keys = shards.kept(folder, f"repeat-{level}-{part}", "<u8")
                    # `place` is the first run of the content; the others follow it.
                    count = np.searchsorted(keys, own.content[entry], side="right") - place
                    runs = np.arange(int(count.sum())) + np.repeat(place - (np.cumsum(count) - count), count)
                    origin = np.repeat(own.first[entry], count)
                    np.add.at(depth, origin + shards.kept(folder, f"start-{level}-{part}", "<u2")[runs], 1)
                    np.add.at(depth, origin + shards.kept(folder, f"stop-{level}-{part}", "<u2")[runs] + LENGTH, -1)
            covered = np.cumsum(depth[:-1]) > 0
            begins, closes = covered.copy(), covered.copy()
            begins[1:] &= ~covered[:-1]
            edge = offsets[:-1][np.diff(offsets) > 0]
            begins[edge] = covered[edge]
            closes[:-1] &= ~covered[1:]
            edge = offsets[1:][np.diff(offsets) > 0] - 1
            closes[edge] = covered[edge]
            starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
            bounds = np.searchsorted(starts, offsets)
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            spans = pa.ListArray.from_arrays(
                pa.array(bounds.astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(starts - offsets[row]), pa.array(ends - offsets[row])], names=["start", "end"]),
            )
            rest = data[~covered].tobytes()
            edges = np.concatenate([[0], np.cumsum(~covered)])[offsets].tolist()
            kept = [rest[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(offsets)), spans, pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return run


def _with_every_range(dealt: DataFrame, ranges: int, names: list[str]) -> DataFrame:
    """The rows and an empty one for each range, so that every range writes its arrays."""
    empty = dealt.sparkSession.range(ranges).select(F.col("id").alias("part"), *[F.lit(b"").alias(name) for name in names])
    return dealt.select("part", *names).union(empty)


def _binaries(names: list[str]) -> str:
    return "part long, " + ", ".join(f"{name} binary" for name in names)


def repeats_removed(documents: DataFrame, hot_contents: int = HOT) -> DataFrame:
    """doc_id, n_bytes, the removed spans (bytes, merged) and the bytes kept, for every row.

    An anchor of more than `hot_contents` contents is cut; the result does not depend on it.
    """
    folder = scratch_path(documents.sparkSession, "bwt-merge")
    texts = documents.select("doc_id", whole_text(documents).alias("text"))
    ranges = RANGES * max(1, documents.rdd.getNumPartitions())
    levels = len(STEPS) + 1
    for level in range(levels):
        seen = texts.mapInArrow(_seen(folder, ranges, level), _binaries(_SEEN))
        kept = _with_every_range(seen, ranges, _SEEN).groupBy("part").applyInArrow(
            _kept(folder, level, hot_contents), "part long, hot long"
        )
        hot = kept.agg(F.sum("hot")).first()[0]
        gathered = texts.mapInArrow(_gathered(folder, ranges, level), _binaries(_GATHERED))
        _with_every_range(gathered, ranges, _GATHERED).groupBy("part").applyInArrow(
            _compared(folder, level), "part long, runs long"
        ).agg(F.sum("runs")).collect()
        if not hot:
            levels = level + 1
            break
    return texts.mapInArrow(_removed(folder, ranges, levels), _SCHEMA)
