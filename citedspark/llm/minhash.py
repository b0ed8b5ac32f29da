"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

Signature. Each distinct shingle draws a random permutation of the slots; the shingle at
step j offers the value j + r (r uniform) to its j-th slot, and a slot keeps its smallest
offer. Steps are taken for all shingles of a slice together and stop for a document as soon
as each of its slots is filled, because a later step cannot offer less.

Rows of equal shingle sets form one class; classes are banded, every member of a bucket is
compared with one member chosen by a hash that differs from band to band and turn to turn, links
are confirmed on full sets, and components are grown by union-find inside tasks and star rounds
between them. Pairs that share a bucket and still lie in different components after those turns
are compared as well, so that no candidate of a bucket is left out.

Nulls, ties, repeats: a null or blank text has the empty set and links with nothing. A row
without doc_id takes no part in linking (component_id null, kept false). Rows that repeat a
doc_id are each returned. Only the columns `doc_id` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citedspark.llm.arrays import NOT_BLANK, Words, carried, distinct_by_row, mixed, shingle_hashes, slices, whole_text
from citedspark.llm.components import components
from citedspark.session import staged

#: Bands and rows of a band: a pair at 0.8 shares none of the 40 with chance 1.2e-7.
BANDS, ROWS = 40, 5
#: Turns in which bucket members meet a centre before the pairs that are left are compared.
ROUNDS = 2
#: Members of a block, and hash values of their sets that are compared at a time.
BLOCK, COLUMNS = 2048, 1024


def super_minhash(rows: np.ndarray, elements: np.ndarray, documents: int, slots: int) -> np.ndarray:
    """Signatures (documents x slots) of distinct elements sorted by row; empty rows hold infinity."""
    best = np.full(documents * slots, np.inf)
    filled = np.zeros(documents, np.int64)
    live = np.arange(len(elements))
    drawn: list[np.ndarray] = []
    for step in range(slots):
        if not len(live):
            break
        random = mixed(elements[live] + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        chosen = step + (mixed(random) % np.uint64(slots - step)).astype(np.int64)
        slot = chosen.copy()
        for earlier in range(step - 1, -1, -1):  # where the swaps of earlier steps had put it
            slot[slot == drawn[earlier]] = earlier
        key = rows[live] * slots + slot
        open_ = np.flatnonzero(best[key] >= step)
        np.minimum.at(best, key[open_], step + (random[open_] >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        filled = np.isfinite(best.reshape(documents, slots)).sum(axis=1)
        keep = filled[rows[live]] < slots
        drawn = [past[keep] for past in [*drawn, chosen]]
        live = live[keep]
    return best.reshape(documents, slots)


def _array_column(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, element) of the sets, their sizes and the class of each row."""
    words = Words(batch.column(1), NOT_BLANK)
    rows, elements = distinct_by_row(*shingle_hashes(words, width))
    count = batch.num_rows
    sizes = np.bincount(rows, minlength=count)
    sums = np.zeros((2, len(elements) + 1), np.uint64)
    np.cumsum(mixed(elements), out=sums[0, 1:])
    np.cumsum(mixed(elements ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1, 1:])
    edge = np.searchsorted(rows, np.arange(count + 1))
    both = sums[:, edge[1:]] - sums[:, edge[:-1]]
    return rows, elements, sizes, mixed(both[0] ^ mixed(both[1] + sizes.astype(np.uint64)))


def _signed(width: int, bands: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows, elements, sizes, classes = _sets(batch, width)
            values = super_minhash(rows, elements, batch.num_rows, bands * depth).view(np.uint64)
            values = values.reshape(batch.num_rows, bands, depth)
            keys = np.zeros(values.shape[:2], np.uint64)
            for step in range(depth):
                keys = mixed(keys * np.uint64(0xD6E8FEB86659FD93) + values[:, :, step])
            keys = keys[sizes > 0]
            lengths = np.where(sizes > 0, bands, 0)
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes), pa.array(classes.view(np.int64)), _array_column(keys.reshape(-1), lengths)],
                names=["doc_id", "n_shingles", "class", "bands"],
            )

    return run


def _classed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            *_, classes = _sets(batch, width)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(classes.view(np.int64))], names=["row", "text", "class"]
            )

    return run


def _listed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            _, elements, sizes, classes = _sets(batch, width)
            short = (elements >> np.uint64(48)).astype(np.uint16)
            ends = np.cumsum(sizes)
            packed = [short[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch(
                [pa.array(classes.view(np.int64)), _array_column(elements, sizes), pa.array(packed, pa.binary())],
                names=["class", "elements", "short"],
            )

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs of classes whose full sets are similar enough."""
    left = sets.select(F.col("class").alias("a"), F.col("elements").alias("of_a"))
    right = sets.select(F.col("class").alias("b"), F.col("elements").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", (F.size("of_a") + F.size("of_b")).alias("total"), shared.alias("shared"))
        .where(F.lit(100) * F.col("shared") >= F.lit(threshold) * (F.col("total") - F.col("shared")))
        .select("a", "b")
    )


def _sets_of(texts: DataFrame, classes: DataFrame, crowded: DataFrame, width: int) -> DataFrame:
    """class, elements of the classes that share a bucket, from one text of each."""
    chosen = staged(classes.select("class", "least").join(crowded.select("class").distinct(), "class"))
    wanted = chosen.select(F.col("least").alias("doc_id")).distinct()
    return (
        texts.join(wanted, "doc_id", "left_semi")
        .mapInArrow(_listed(width), "class long, elements array<long>, short binary")
        .join(chosen.select("class"), "class", "left_semi")
        .dropDuplicates(["class"])
    )


def _placed(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, class, root of the members of buckets that hold several components."""
    placed = crowded.join(roots.withColumnRenamed("node", "class"), "class")
    several = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return placed.join(several.select("bucket"), "bucket", "left_semi")


def _to_centres(crowded: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """Pairs of each bucket's centre with the members of other components.

    The centre is the least member in an order that differs from bucket to bucket and turn to turn.
    """
    placed = _placed(crowded, roots)
    order = F.struct(F.xxhash64("class", "bucket", F.lit(turn)).alias("turn"), F.col("class").alias("centre"), F.col("root").alias("own"))
    centres = placed.groupBy("bucket").agg(F.min(order).alias("c")).select("bucket", "c.centre", "c.own")
    return (
        placed.join(centres, "bucket").where("root <> own")
        .select(F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b")).distinct()
    )


def _blocks_compared(threshold: int):
    """Pairs of a block pair that can be similar enough: their 16-bit sets bound the shared part.

    Rows come sorted by (bucket, i, j); a block pair is at most a few BLOCKs of rows.
    """

    def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        total = np.zeros((len(left), len(right)), np.float32)
        sides = []
        for part in (left, right):
            flat = np.concatenate(part).astype(np.int64)
            rows = np.repeat(np.arange(len(part)), [len(each) for each in part])
            order = np.argsort(flat, kind="stable")
            sides.append((flat[order], rows[order]))
        for first in range(0, 1 << 16, COLUMNS):
            dense = []
            places = [np.searchsorted(flat, [first, first + COLUMNS]) for flat, _ in sides]
            if any(low == high for low, high in places):
                continue
            for (flat, rows), part, (low, high) in zip(sides, (left, right), places, strict=True):
                block = np.zeros((len(part), COLUMNS), np.float32)
                np.add.at(block, (rows[low:high], flat[low:high] - first), 1.0)
                dense.append(block)
            total += dense[0] @ np.minimum(dense[1], 1.0, out=dense[1]).T  # every element of the left that may be shared
        return total

    def compared(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        left = [row for row in rows if row[5]]
        right = [row for row in rows if not row[5]]
        if not left or not right:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sets = [[np.frombuffer(row[6], np.uint16) for row in side] for side in (left, right)]
        size = [np.array([len(each) for each in side]) for side in sets]
        if len(left) * len(right) <= 64:
            both = np.array([[np.isin(a, b).sum() for b in sets[1]] for a in sets[0]])
        else:
            both = shared(*sets)
        union = size[0][:, None] + size[1][None, :] - both
        root = [np.array([row[4] for row in side]) for side in (left, right)]
        near, far = np.nonzero((100 * both >= threshold * union) & (root[0][:, None] != root[1][None, :]))
        node = [np.array([row[3] for row in side]) for side in (left, right)]
        a, b = node[0][near], node[1][far]
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if rows and row[:3] != rows[0][:3]:
                    found.append(compared(rows))
                    rows = []
                rows.append(row)
            if found:
                a, b = (np.concatenate(side) for side in zip(*found, strict=True))
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if rows:
            a, b = compared(rows)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _across(crowded: DataFrame, roots: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs that share a bucket and no component and can be similar enough.

    Every bucket has a main component; members of its other components are compared with all
    members, block by block, and only pairs that pass leave the task. A bucket of two was
    compared when one member was the other's centre.
    """
    placed = _placed(crowded, roots)
    by_root = placed.groupBy("bucket", "root").count()
    main = by_root.groupBy("bucket").agg(
        F.max(F.struct("count", "root")).alias("main"), F.sum("count").alias("n")
    ).where("n > 2").selectExpr("bucket", "main.root AS main_root", "n", "n - main.count AS others")
    rows = placed.join(main, "bucket").join(sets.select("class", "short"), "class")
    lefts, rights = F.ceil(F.col("others") / BLOCK).cast("long"), F.ceil(F.col("n") / BLOCK).cast("long")
    own = F.xxhash64("class")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    columns = ["bucket", "i", "j", "class", "root", "asks", "short"]
    asking = rows.where("root <> main_root").select(
        "*", F.pmod(own, lefts).alias("i"), F.explode(F.sequence(zero, rights - one)).alias("j"), F.lit(True).alias("asks")
    )
    asked = rows.select(
        "*", F.explode(F.sequence(zero, lefts - one)).alias("i"), F.pmod(own, rights).alias("j"), F.lit(False).alias("asks")
    )
    dealt = asking.select(columns).union(asked.select(columns)).repartition("bucket", "i", "j")
    return (
        dealt.sortWithinPartitions("bucket", "i", "j")
        .mapInArrow(_blocks_compared(threshold), "a long, b long").distinct()
    )


def _grown(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links, found between the components there are."""
    left = roots.select(F.col("node").alias("a"), F.col("root").alias("u"))
    right = roots.select(F.col("node").alias("b"), F.col("root").alias("v"))
    between = staged(links.join(left, "a").join(right, "b").where("u <> v").select("u", "v").distinct())
    moved = components(between, "u", "v").select(F.col("node").alias("root"), F.col("root").alias("to"))
    return staged(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))


def _judged(documents: DataFrame, width: int, threshold: int, bands: int, depth: int) -> DataFrame:
    """What `near_duplicates` returns, with the class of each row and the group (a class) it is linked to."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(documents).alias("text"))
    signed = staged(
        texts.mapInArrow(
            _signed(width, bands, depth), "doc_id long, n_shingles long, class long, bands array<long>"
        )
    )
    classes = (
        signed.where("doc_id IS NOT NULL AND n_shingles > 0")
        .groupBy("class").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    )
    classes = staged(classes)
    members = classes.select("class", F.posexplode("bands").alias("band", "key")).select(
        "class", F.xxhash64("band", "key").alias("bucket")
    )
    shared = members.groupBy("bucket").count().where("count > 1").select("bucket")
    crowded = staged(members.join(shared, "bucket"))
    sets = staged(_sets_of(texts, classes, crowded, width))
    roots = crowded.select(F.col("class").alias("node"), F.col("class").alias("root")).distinct()
    tested = None
    for turn in range(ROUNDS):
        pairs = _to_centres(crowded, roots, turn)
        pairs = staged(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.union(pairs)
        links = staged(_confirmed(pairs, sets, threshold))
        if not links.take(1):
            break
        roots = _grown(roots, links)
    # Pairs of a bucket that lie in different components now, and were not compared yet.
    links = staged(_confirmed(_across(crowded, roots, sets, threshold).join(tested, ["a", "b"], "left_anti"), sets, threshold))
    if links.take(1):
        roots = _grown(roots, links)
    grouped = (
        classes.select("class", "least").join(roots.withColumnRenamed("node", "class"), "class")
    )
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component"))
    named = grouped.join(smallest, "root").select("class", "component", F.col("root").alias("group"))
    everyone = classes.select("class", "least").join(named, "class", "left")
    everyone = everyone.select("class", F.coalesce("component", "least").alias("component"), F.coalesce("group", "class").alias("group"))
    result = signed.select("doc_id", "n_shingles", "class").join(everyone, "class", "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(linked, F.col("component")).otherwise(F.col("doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), "class", "group").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def near_duplicates(
    documents: DataFrame, width: int = 5, threshold: int = 80, bands: int = BANDS, depth: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `documents`.

    Documents are linked where 100 * shared >= threshold * union of their sets of distinct
    `width`-word shingles; component_id is the smallest doc_id reachable.
    """
    return _judged(documents, width, threshold, bands, depth).select("doc_id", "n_shingles", "component_id", "kept")


def kept_rows(documents: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """The rows that are kept (as `carried` has them), each with the group of like rows it stands for.

    Rows that repeat a doc_id are judged each by its own text.
    """
    judged = _judged(documents, width, threshold, BANDS, ROWS).where("kept")
    kept = judged.select("doc_id", "class", F.coalesce("group", F.lit(0)).alias("group")).distinct()
    rows = carried(documents)
    schema = StructType([*rows.schema, *StructType.fromDDL("class long")])
    return rows.mapInArrow(_classed(width), schema).withColumn("doc_id", F.col("row.doc_id")).join(kept, ["doc_id", "class"])
