"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

Counting. Runs of letters are cut out of whole texts and counted by Spark; one run in 97 of a
document loses a code point that its hash chooses, which plants misspellings.

Candidates. Let two words of lengths m and m or m + 1 be one edit apart. With the edit at or after
place m // 2 they share the first m // 2 code points, else the last m - m // 2. So each word joins
four lists: for m its own length and one less, by beginning and by end. All links lie inside
lists. A list of more than BLOCK words is dealt out as pairs of blocks, so none is one task.

Scan. The words of a list are sorted (those listed by their ends are read backwards). QUERIES of
them at a time are held against the list: row d of the edit matrix between the first d code
points of a list word and every query needs three cells a query, the band of one edit. The next
list word starts at the row of the prefix it shares with the last one. Where a row exceeds one
edit for every query, all following words that share so long a prefix are skipped.

Forms. A word's form is its near word of largest count (ties: the smallest), if that count is at
least `ratio` times its own; the root is found by doubling the steps along forms.

Nulls, ties, repeats: a null or blank text has no words. Rows that repeat a doc_id, and rows
without one (hashed as if it were empty), count like any other. Words of any length take part.
Only `doc_id` and `text` are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citedspark.llm.arrays import whole_text
from citedspark.session import staged, tasks

#: Runs of letters of lower-cased text; all its code points fit a byte of Latin-1.
RUNS = r"[a-zÀ-ÿ]+"
#: One run in so many of a document's distinct runs is misspelt.
MISSPELT = 97
#: Words of a block; queries held against a list at a time, with so many cells at most.
BLOCK, QUERIES, CELLS = 4096, 256, 1 << 22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(documents: DataFrame) -> DataFrame:
    """word: every run of letters of every text, as it counts."""
    lower = F.translate(whole_text(documents), UPPER, LOWER)
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = documents.select(number.alias("of"), F.explode(F.regexp_extract_all(lower, F.lit(RUNS), F.lit(0))).alias("run"))
    hashed = F.crc32(F.concat("of", F.lit(":"), "run"))
    at = F.pmod(hashed, F.length("run")).cast("int")
    shorter = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    rows = runs.withColumn("hash", hashed).withColumn("at", at)
    return rows.select(F.when(F.col("hash") % MISSPELT == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(documents: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """word, n: the words of at least `shortest` code points that stand at least `least` times."""
    words = occurrences(documents).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def listed(words: DataFrame) -> DataFrame:
    """list, m, ends, word, n: each word in the lists of the words that can be near it.

    `m` is the shorter length of a list, `ends` tells lists by ends from lists by beginnings.
    """
    size = F.length("word")
    places = F.explode(F.array(*[
        F.struct(F.lit(ends).alias("ends"), (size - less).alias("m")) for less in (0, 1) for ends in (False, True)
    ]))
    head = F.expr("substring(word, 1, m div 2)")
    tail = F.expr("substring(word, length(word) - (m - m div 2) + 1)")
    rows = words.select("word", "n", places.alias("at")).select("word", "n", "at.ends", "at.m").where("m > 0")
    return rows.withColumn("list", F.xxhash64("ends", "m", F.when(F.col("ends"), tail).otherwise(head)))


def _matrix(words: list[bytes], width: int) -> np.ndarray:
    """The words as rows of bytes, zero past their ends."""
    flat = b"".join(word.ljust(width, b"\0") for word in words)
    return np.frombuffer(flat, np.uint8).reshape(len(words), width)


def _shared(words: np.ndarray) -> np.ndarray:
    """Length of the prefix that each sorted word shares with the one before it; 0 for the first."""
    found = np.zeros(len(words), np.int64)
    if len(words) > 1:
        same = words[1:] == words[:-1]
        found[1:] = np.where(same.all(axis=1), words.shape[1], same.argmin(axis=1))
    return found


def scan(queries: np.ndarray, sizes: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(list word, queries that are exactly one edit away) for sorted rows of bytes.

    Lengths differ by at most one; a word's own query is no edit away and not returned.
    """
    count, width = len(queries), max(words.shape[1], queries.shape[1])
    turned = np.zeros((width + 3, count), np.uint8)  # place c of a query stands in row c + 1
    turned[1 : queries.shape[1] + 1] = queries.T
    band = np.zeros((width + 1, 3, count), np.uint8)  # cells d - 1, d, d + 1 of row d, 2 for more than one
    band[0] = np.array([2, 0, 1], np.uint8)[:, None]
    shared = _shared(words).tolist()
    rows = words.tolist() if words.shape[1] <= 64 else words
    column = np.arange(count)
    # Per query: which cell of row `length` is its last one.
    of_length = {int(length): (sizes - length + 1).astype(np.int64) for length in np.unique(lengths)}
    reachable = {length: (cell >= 0) & (cell <= 2) for length, cell in of_length.items()}
    at, ready, total = 0, 0, len(words)
    while at < total:
        ready = min(ready, shared[at])
        length, word = int(lengths[at]), rows[at]
        beyond = -1
        for d in range(ready + 1, length + 1):
            before, now = band[d - 1], band[d]
            np.add(before, turned[d - 1 : d + 2] != word[d - 1], out=now)
            np.minimum(now[:2], before[1:] + 1, out=now[:2])
            np.minimum(now[1], now[0] + 1, out=now[1])
            np.minimum(now[2], now[1] + 1, out=now[2])
            np.minimum(now, 2, out=now)
            if d == 1:
                now[0] = 1
            ready = d
            if now.min() > 1:
                beyond = d
                break
        if beyond >= 0:
            at += 1
            while at < total and shared[at] >= beyond:
                at += 1
            # Rows up to the cut hold; a skipped word shares less from here on.
            continue
        ready = length
        cell = of_length[length]
        last = np.where(reachable[length], band[length][np.clip(cell, 0, 2), column], 2)
        near = np.flatnonzero(last == 1)
        if len(near):
            yield at, near
        at += 1


def _best(word: bytes, n: int, n_best: int, best: bytes) -> bool:
    return n > n_best or (n == n_best and word < best)


def near_in_list(
    queries: list[tuple[bytes, int]], words: list[tuple[bytes, int]], m: int, ends: bool
) -> list[tuple[bytes, int, int, bytes]]:
    """(word, near words, largest count, its word) of the queries with near words in the list.

    Two words of m + 1 are left to their own lists, and two with equal beginnings to the list of those.
    """
    half = m // 2

    def ordered(rows: list[tuple[bytes, int]]) -> list[tuple[bytes, bytes, int]]:
        return sorted((word[::-1] if ends else word, word, n) for word, n in rows)

    asked, held = ordered(queries), ordered(words)
    width = max(len(row[0]) for row in [*asked, *held])
    table = _matrix([row[0] for row in held], width)
    lengths = np.array([len(row[0]) for row in held])
    names = {}
    begin_of = [names.setdefault(row[1][:half], len(names)) for row in held]
    out = []
    step = max(1, min(QUERIES, CELLS // (3 * (width + 1))))
    for first in range(0, len(asked), step):
        part = asked[first : first + step]
        sizes = np.array([len(row[0]) for row in part])
        begins = np.array([names.get(row[1][:half], -1) for row in part])
        count, n_best, best = np.zeros(len(part), np.int64), [0] * len(part), [b""] * len(part)
        for at, near in scan(_matrix([row[0] for row in part], width), sizes, table, lengths):
            if lengths[at] > m:
                near = near[sizes[near] == m]
            if ends:
                near = near[begins[near] != begin_of[at]]
            count[near] += 1
            _, word, n = held[at]
            for query in near.tolist():
                if _best(word, n, n_best[query], best[query]):
                    n_best[query], best[query] = n, word
        out += [(part[q][1], int(count[q]), n_best[q], best[q]) for q in np.flatnonzero(count).tolist()]
    return out


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of whole groups of rows sorted by (list, m, ends, i, j)."""

    def out(rows: list[tuple]) -> list[tuple]:
        m, ends = rows[0][1], rows[0][2]
        if len(rows) == 1:
            return []
        same = rows[0][3] == rows[0][4]
        queries = [(row[6].encode("latin-1"), row[7]) for row in rows if same or row[5]]
        words = queries if same else [(row[6].encode("latin-1"), row[7]) for row in rows if not row[5]]
        return near_in_list(queries, words, m, ends) if queries and words else []

    def record(found: list[tuple]) -> pa.RecordBatch:
        word, near, n, best = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.record_batch(
            [
                pa.array([each.decode("latin-1") for each in word], pa.string()), pa.array(near, pa.int64()),
                pa.array(n, pa.int64()), pa.array([each.decode("latin-1") for each in best], pa.string()),
            ],
            names=["word", "n_near", "n_best", "best"],
        )

    rows: list[tuple] = []
    found: list[tuple] = []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if rows and row[:5] != rows[0][:5]:
                found += out(rows)
                rows = []
            rows.append(row)
        if len(found) >= 10_000:
            yield record(found)
            found = []
    if rows:
        found += out(rows)
    yield record(found)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, n_best, best: of every word with words one edit away, and the most frequent of those."""
    placed = listed(words)
    sizes = placed.groupBy("list").agg(F.count("*").alias("size")).where("size > 1")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    blocks = F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks")
    own = F.pmod(F.xxhash64("word", "list"), F.col("blocks")).alias("own")
    rows = placed.join(sizes.select("list", blocks), "list").select("*", own)
    # A block asks every block of its list, its own in one group and the others in one each.
    asks = F.transform(F.sequence(zero, F.col("blocks") - one), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("asks")))
    asked = F.filter(
        F.transform(F.sequence(zero, F.col("blocks") - one), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks"))),
        lambda at: at["i"] != at["j"],
    )
    dealt = rows.select("list", "m", "ends", F.explode(F.concat(asks, asked)).alias("at"), "word", "n").select(
        "list", "m", "ends", "at.i", "at.j", "at.asks", "word", "n"
    )
    keys = ["list", "m", "ends", "i", "j"]
    scanned = (
        dealt.repartition(tasks(words), *keys).sortWithinPartitions(*keys)
        .mapInArrow(_scanned, "word string, n_near long, n_best long, best string")
    )
    best = F.min(F.struct((-F.col("n_best")).alias("less"), F.col("best").alias("best"))).alias("of")
    found = scanned.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("of.less")).alias("n_best"), F.col("of.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) lead, each of them above its word; doubling steps."""
    current = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = staged(current.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        current = moved.select("word", "root")
        if not moved.where("moved").take(1):
            return current


def variants(documents: DataFrame, shortest: int = 5, least: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = staged(vocabulary(documents, shortest, least))
    formed: Column = F.col("n_best") >= F.lit(ratio) * F.col("n")
    found = staged(
        words.join(near_words(words), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("n_best")).alias("form_n"),
        )
    )
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
