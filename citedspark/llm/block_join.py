"""Nearest neighbours by a block matrix join with int8 product tiles.

Vectors are packed into blocks; a tile is one block of queries against one block of
candidates. The tile's products are first taken between int8 codes. With x = s * q + e the
error of a product is at most |x^| |e_y| + |y^| |e_x| + |e_x| |e_y|, so a candidate whose upper
bound stays below the k-th largest lower bound cannot be among the k nearest of the tile. Only
the surviving pairs are recomputed in double precision; heaps keep k of each query in a task,
and a ranking over all tasks' heaps ends the search. The result is exact.

Nulls, ties, repeats: vectors null, zero or with null or non-finite components and rows without
vec_id take no part. Rows that repeat a vec_id count once, with the least of their vectors.
Ties go to the smaller vec_id. Vectors are compared with those of their own length only. Only
`vec_id` and `embedding` are read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from citedspark.session import staged

#: Rows of a block; queries that a task's heaps hold before they are handed on.
BLOCK, HELD = 2048, 50_000


def _blocks(kind: str):
    """Blocks of at most BLOCK vectors of one length: ids, and vectors as bytes of the given kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _blocks_of(batch, kind)

    return run


def _blocks_of(batch: pa.RecordBatch, kind: str) -> Iterator[pa.RecordBatch]:
    if batch.num_rows:
        ids = batch.column(0).to_numpy()
        values = batch.column(1)
        flat = values.flatten().to_numpy()
        edges = np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy())])
        sizes = np.diff(edges)
        for size in np.unique(sizes):
            members = np.flatnonzero(sizes == size)
            for first in range(0, len(members), BLOCK):
                part = members[first : first + BLOCK]
                rows = flat[edges[part][:, None] + np.arange(size)].astype(kind)
                yield pa.record_batch(
                    [pa.array([int(size)]), pa.array([ids[part].astype("<i8").tobytes()]), pa.array([rows.tobytes()])],
                    names=["dim", "ids", "vectors"],
                )


def _codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the norms of the coded part and of the rest."""
    wide = vectors.astype(np.float64)
    scale = np.abs(wide).max(axis=1) / 127.0
    codes = np.rint(wide / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(wide - coded, axis=1)


def _tile(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, product) of the pairs that can be among a query's k nearest."""
    q, q_scale, q_norm, q_rest = _codes(queries)
    c, c_scale, c_norm, c_rest = _codes(vectors)
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # whole numbers stay whole
    about = (q.astype(exact) @ c.astype(exact).T).astype(np.float64)
    about *= q_scale[:, None] * c_scale[None, :]
    bound = np.outer(q_norm, c_rest) + np.outer(q_rest, c_norm) + np.outer(q_rest, c_rest)
    bound = bound * (1 + 1e-9) + 1e-12 * np.outer(q_norm + q_rest, c_norm + c_rest)
    low = about - bound
    own = query_ids[:, None] == ids[None, :]
    low[own] = -np.inf
    if k < low.shape[1]:
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
    else:
        floor = np.full(len(low), -np.inf)
    near, found = np.nonzero((about + bound >= floor[:, None]) & ~own)
    product = np.cumsum(queries[near].astype(np.float64) * vectors[found].astype(np.float64), axis=1)[:, -1]
    return near, found, product


def _searched(k: int, kind: str):
    def out(heaps: dict[int, list[tuple[float, int]]]) -> pa.RecordBatch:
        rows = [(query, -vec, score) for query, heap in heaps.items() for score, vec in heap]
        query, vec, score = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.record_batch(
            [pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())],
            names=["query_id", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for dim, query_ids, queries, ids, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                query_ids, ids = np.frombuffer(query_ids, "<i8"), np.frombuffer(ids, "<i8")
                queries = np.frombuffer(queries, kind).reshape(-1, dim)
                vectors = np.frombuffer(vectors, kind).reshape(-1, dim)
                for first in range(0, len(query_ids), 256):
                    part = slice(first, first + 256)
                    near, found, product = _tile(query_ids[part], queries[part], ids, vectors, k)
                    order = np.lexsort((ids[found], -product, near))
                    near, found, product = near[order], found[order], product[order]
                    place = np.arange(len(near)) - np.searchsorted(near, near)
                    best = place < k
                    for query, vec, score in zip(
                        query_ids[part][near[best]].tolist(), ids[found[best]].tolist(), product[best].tolist(), strict=True
                    ):
                        heap = heaps.setdefault(query, [])
                        if len(heap) < k:
                            heapq.heappush(heap, (score, -vec))
                        elif (score, -vec) > heap[0]:
                            heapq.heapreplace(heap, (score, -vec))
                if len(heaps) > HELD:
                    yield out(heaps)
                    heaps = {}
        yield out(heaps)

    return run


def nearest(embeddings: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query's vector.

    `is_query` is a condition on vec_id; candidates are all other rows.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    # Vectors keep their precision: floats stay floats, all else is double.
    of_floats = isinstance(embeddings.schema["embedding"].dataType.elementType, FloatType)
    kind, column = ("<f4", "array<float>") if of_floats else ("<f8", "array<double>")
    vectors = (
        embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast(column))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(whole & some)
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    )
    schema = "dim long, ids binary, vectors binary"
    blocks = staged(vectors.mapInArrow(_blocks(kind), schema))
    asked = staged(vectors.where(is_query).mapInArrow(_blocks(kind), schema))
    # Candidate blocks are dealt to groups; each block of queries visits every group once.
    groups = max(1, min(blocks.count(), 4 * int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    candidates = blocks.select("dim", F.expr(f"pmod(xxhash64(ids), {groups})").alias("part"), "ids", "vectors")
    queries = asked.select(
        "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"),
        F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"),
    )
    tiles = queries.join(candidates, ["dim", "part"]).select("dim", "query_ids", "queries", "ids", "vectors")
    found = tiles.mapInArrow(_searched(k, kind), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
