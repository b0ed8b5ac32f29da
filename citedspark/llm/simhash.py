"""Near-duplicate groups by SimHash fingerprints that are compared in bit planes.

Fingerprint. Every run of `width` words, repeats included, is hashed (XXH64); a bit of the
fingerprint is set where it is set in more than half of the hashes.

Candidates. A fingerprint is cut into `parts` runs of bits. Two that differ in at most `radius`
bits agree in `parts - radius` of the runs at least, so every such choice of runs is a table of
buckets and each link shares a bucket in one of them: the search is exact. Buckets of more than
BLOCK fingerprints are dealt out as pairs of blocks, so that no bucket is one task.

Comparison. The fingerprints of a block are stored vertically, one bit plane a position, 64 of
them to a word. Many distances are counted at once: the planes of a query and of the block are
added two at a time into a counter of bit planes by carry-save steps, and a block is left as
soon as all its distances exceed the radius. Small buckets are laid side by side and compared
with themselves, shifted by one place, two places and so on. What leaves a task are links of a
spanning forest, never all pairs of a group; components are grown from them.

Nulls, ties, repeats: a null or blank text has fingerprint zero, which links like any other. A row
without doc_id gets its fingerprint, takes no part in linking and has component_id null. Rows that
repeat a doc_id are each returned, each with the class of its own text. Only `doc_id` and `text`
are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citedspark.llm.arrays import LOWER, slices, text_bytes, whole_text
from citedspark.llm.components import components
from citedspark.session import staged, tasks

BITS, SEED = 64, 42
#: Fingerprints of a block; queries at a time; buckets up to SIDE are compared side by side, so many rows at a time.
BLOCK, QUERIES, SIDE, ROWS = 8192, 128, 64, 16_384
#: Hashes that are counted at a time.
HASHES = 1 << 15
_LOWER = bytes(LOWER)
_FULL = ~np.uint64(0)


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of `width` words of a lower-cased text, space-joined, some at a time."""
    words = text.split()  # the ASCII blanks \x20 and \x09-\x0D
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(width, len(words))
    starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    digest = xxhash.xxh64_intdigest
    for first in range(0, len(starts), HASHES):
        part = slice(first, first + HASHES)
        places = zip(starts[part].tolist(), ends[part].tolist(), strict=True)
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in places), np.uint64, len(starts[part]))


def _bits(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 bits for each value, the lowest first."""
    return np.unpackbits(np.ascontiguousarray(hashes).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _fingerprints(texts: pa.Array, width: int) -> np.ndarray:
    raw, offsets = text_bytes(texts)
    whole = raw.tobytes()
    counts, totals = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    rows: list[int] = []

    def counted() -> None:
        if held:
            sizes = [len(part) for part in held]
            starts = np.cumsum([0, *sizes[:-1]])
            np.add.at(counts, rows, np.add.reduceat(_bits(np.concatenate(held)), starts, axis=0, dtype=np.int64))
            np.add.at(totals, rows, sizes)
            held.clear()
            rows.clear()

    waiting = 0
    for row in range(len(texts)):
        for hashes in shingle_hashes(whole[offsets[row] : offsets[row + 1]].translate(_LOWER), width):
            held.append(hashes)
            rows.append(row)
            waiting += len(hashes)
            if waiting >= HASHES:
                counted()
                waiting = 0
    counted()
    set_ = (2 * counts > totals[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(documents: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (its 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = _fingerprints(batch.column(1), width).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(found)], names=["doc_id", "fingerprint"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(documents).alias("text"))
    return texts.mapInArrow(run, "doc_id long, fingerprint long")


def hexadecimal(fingerprint: Column) -> Column:
    """A fingerprint's 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


class Counter:
    """Distances of many lanes as bit planes, saturating: planes 1, 2, 4 and one for more than 7."""

    def __init__(self, shape: tuple[int, ...]) -> None:
        self.ones, self.twos, self.fours, self.more = (np.zeros(shape, np.uint64) for _ in range(4))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Add two planes of differing bits by one carry-save step and the carries it makes."""
        half = self.ones ^ a
        carry = (self.ones & a) | (half & b)
        self.ones = half ^ b
        next_carry = self.twos & carry
        self.twos ^= carry
        self.more |= self.fours & next_carry
        self.fours ^= next_carry

    def beyond(self, radius: int) -> np.ndarray:
        """The lanes whose distance exceeds the radius, which is below 8."""
        over, equal = self.more.copy(), ~self.more
        for bit, plane in ((4, self.fours), (2, self.twos), (1, self.ones)):
            if radius & bit:
                equal &= plane
            else:
                over |= equal & plane
                equal &= ~plane
        return over


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: 64 rows of words, lane i being bit i % 64 of word i // 64."""
    lanes = -(-len(values) // 64) * 64
    padded = np.zeros(lanes, np.uint64)
    padded[: len(values)] = values
    packed = np.packbits(_bits(padded).T, axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")


def _lanes(words: np.ndarray, count: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")[..., :count].view(bool)


def near_lanes(queries: np.ndarray, vertical: np.ndarray, count: int, radius: int) -> np.ndarray:
    """For each query the lanes (of `count`) within the radius."""
    counter = Counter((len(queries), vertical.shape[1]))
    flip = np.where(_bits(queries).T[:, :, None].astype(bool), _FULL, np.uint64(0))
    for bit in range(0, BITS, 2):
        counter.add(vertical[bit] ^ flip[bit], vertical[bit + 1] ^ flip[bit + 1])
        if bit % 16 == 14 and (counter.beyond(radius) == _FULL).all():
            return np.zeros((len(queries), count), bool)
    return _lanes(~counter.beyond(radius), count)


def _shifted(words: np.ndarray, by: int) -> np.ndarray:
    """Planes whose lane i is lane i + by of `words`; zero past the end."""
    whole, part = divmod(by, 64)
    out = np.zeros_like(words)
    keep = words.shape[1] - whole
    out[:, :keep] = words[:, whole:] >> np.uint64(part)
    if part and keep > 1:
        out[:, : keep - 1] |= words[:, whole + 1 :] << np.uint64(64 - part)
    return out


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the labels of both ends of every pair; a label is the least row of its group."""
    while True:
        of_a, of_b = labels[a], labels[b]
        apart = of_a != of_b
        if not apart.any():
            return
        np.minimum.at(labels, np.maximum(of_a, of_b)[apart], np.minimum(of_a, of_b)[apart])
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels[:] = up


def side_by_side(values: np.ndarray, groups: np.ndarray, radius: int) -> np.ndarray:
    """The least row linked with each row, of rows of equal groups (contiguous, at most SIDE each)."""
    labels, vertical = np.arange(len(values)), planes(values)
    firsts, seconds = [], []
    for by in range(1, len(values)):
        together = np.flatnonzero(groups[by:] == groups[:-by])
        if not len(together):
            break
        wanted = np.zeros(vertical.shape[1] * 64, np.uint8)
        wanted[together] = 1
        apart = ~np.packbits(wanted, bitorder="little").view("<u8")
        counter, other = Counter((vertical.shape[1],)), _shifted(vertical, by)
        for bit in range(0, BITS, 2):
            counter.add(vertical[bit] ^ other[bit], vertical[bit + 1] ^ other[bit + 1])
            if bit % 16 == 14 and ((counter.beyond(radius) | apart) == _FULL).all():
                break
        else:
            near = np.flatnonzero(_lanes(~(counter.beyond(radius) | apart), len(values)))
            firsts.append(near)
            seconds.append(near + by)
    if firsts:
        _joined(labels, np.concatenate(firsts), np.concatenate(seconds))
    return labels


def in_blocks(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside `left`, or between `left` and `right`: (values, labels)."""
    values = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    labels, vertical = np.arange(len(values)), planes(values[shift:])
    for first in range(0, len(left), QUERIES):
        queries = left[first : first + QUERIES]
        query, lane = np.nonzero(near_lanes(queries, vertical, len(values) - shift, radius))
        _joined(labels, query + first, lane + shift)
    return values, labels


def _compared(radius: int):
    """Links of groups of rows (group, i, j, left, fingerprint), sorted so that groups are whole."""

    def links(values: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return values[moved], values[labels[moved]]

    def of(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        group, i, j, left, values = rows
        new = np.flatnonzero((np.diff(group) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        edges = np.concatenate([[0], new, [len(group)]])
        sizes = np.diff(edges)
        small = np.repeat((sizes <= SIDE) & (i[edges[:-1]] == j[edges[:-1]]), sizes)
        number = np.repeat(np.arange(len(sizes)), sizes)
        few, of_group = values[small], number[small]
        first = 0
        while first < len(few):  # cut between groups
            last = min(first + ROWS, len(few))
            if last < len(few):
                last = int(np.searchsorted(of_group, of_group[last - 1]))
                last = last if last > first else int(np.searchsorted(of_group, of_group[first], side="right"))
            yield links(few[first:last], side_by_side(few[first:last], of_group[first:last], radius))
            first = last
        for at in np.flatnonzero(~small[edges[:-1]]):
            part = slice(edges[at], edges[at + 1])
            if i[part][0] == j[part][0]:
                yield links(*in_blocks(values[part], None, radius))
            else:
                yield links(*in_blocks(values[part][left[part]], values[part][~left[part]], radius))

    def out(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a, b in of(rows):
            if len(a):
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            fresh = [batch.column(at).to_numpy(zero_copy_only=False) for at in range(5)]
            fresh[4] = fresh[4].view(np.uint64)
            held = fresh if held is None else [np.concatenate(both) for both in zip(held, fresh, strict=True)]
            if len(held[0]) < ROWS:
                continue
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from out([part[:cut] for part in held])
                held = [part[cut:] for part in held]
        if held is not None and len(held[0]):
            yield from out(held)

    return run


def _buckets(radius: int, parts: int) -> list[tuple[int, int]]:
    """(table, mask of the bits that choose its buckets) of every choice of parts - radius runs of bits."""
    edges = np.linspace(0, BITS, parts + 1).astype(int)
    masks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    chosen = [sum(each) for each in combinations(masks, parts - radius)]
    return [(number, mask - (1 << BITS) if mask >> (BITS - 1) else mask) for number, mask in enumerate(chosen)]


def linked(values: DataFrame, radius: int = 4, parts: int = 6) -> DataFrame:
    """a, b: links of a spanning forest of the distinct fingerprints within the radius of each other."""
    if not 0 <= radius < 8 or parts <= radius:
        raise ValueError("the radius must be below 8 and below the number of parts")
    tables = F.array(*[
        F.struct(F.lit(number).alias("number"), F.col("fingerprint").bitwiseAND(F.lit(mask).cast("long")).alias("key"))
        for number, mask in _buckets(radius, parts)
    ])
    placed = values.select("fingerprint", F.explode(tables).alias("of")).select(
        F.xxhash64("of.number", "of.key").alias("bucket"), "fingerprint"
    )
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    zero, one, blocks = F.lit(0).cast("long"), F.lit(1).cast("long"), F.ceil(F.col("n") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("fingerprint", "bucket"), F.col("blocks"))
    # A block meets every later one: as the left side of (own, j) and as the right side of (i, own).
    pairs = F.concat(
        F.transform(F.sequence(F.col("own"), F.col("blocks") - one), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("left"))),
        F.when(F.col("own") > 0, F.transform(F.sequence(zero, F.col("own") - one), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(False).alias("left"))))
        .otherwise(F.array().cast("array<struct<i:bigint,j:bigint,left:boolean>>")),
    )
    dealt = (
        placed.join(sizes.select("bucket", blocks.alias("blocks")), "bucket")
        .withColumn("own", own).select("bucket", "fingerprint", F.explode(pairs).alias("at"))
        .select("bucket", "at.i", "at.j", "at.left", "fingerprint")
        .repartition(tasks(values), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    )
    return dealt.mapInArrow(_compared(radius), "a long, b long")


def near_duplicates(documents: DataFrame, width: int = 4, radius: int = 4, parts: int = 6) -> DataFrame:
    """doc_id, fingerprint (a long), component_id of every row.

    component_id is the smallest doc_id that links of at most `radius` differing bits reach.
    """
    signed = staged(fingerprints(documents, width))
    values = signed.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    links = staged(linked(values.select("fingerprint"), radius, parts).distinct())
    roots = components(links, "a", "b").withColumnRenamed("node", "fingerprint")
    grouped = values.join(roots, "fingerprint").select("fingerprint", "least", "root")
    named = grouped.groupBy("root").agg(F.min("least").alias("component"))
    known = grouped.join(named, "root").select("fingerprint", "component")
    every = values.join(known, "fingerprint", "left").select("fingerprint", F.coalesce("component", "least").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")
    return signed.join(every, "fingerprint", "left").select("doc_id", "fingerprint", component)
