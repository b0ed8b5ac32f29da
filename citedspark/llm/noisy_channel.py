"""Toxicity of texts whose words may be disguised: noisy-channel decoding, then scoring.

Words with digits or signs among their letters, with a letter three times or more in a row, and
words written letter by letter are taken for the output of a noisy channel. Their characters
form a lattice (a run may stand for one or two letters, a sign for the letters it resembles or
for nothing), and Viterbi decoding finds the likeliest letters under a trigram model of
characters that is counted over all documents. What is scored is the restored text.

Beside it stand further readings, which are scored as well and take nothing away: of words of
signs and digits alone, of words with a doubled letter, which may stand for one, and of
neighbouring words of one or two characters. These form one lattice, in which each space is a
boundary of words or nothing; the likeliest path and the likeliest without boundaries are read.

Evidence is learnt from labelled rows: a word or its beginning (4 to 6 bytes) counts as often as
it has distinct neighbours on either side in toxic texts, so that copies of a text add nothing,
and is kept if a likelihood-ratio test finds it significantly more frequent there than in clean
texts.
A document's log-odds are the prior's plus the strongest evidence among its words.

At most about SAMPLE labelled rows, chosen by a hash of doc_id, train the evidence; characters
are counted in all texts, and all documents are scored whole.

Nulls, ties, repeats: a null text is the empty text and gets the prior; rows with null doc_id
are scored and held out of training; a doc_id labelled twice counts with its larger label; rows
that repeat a doc_id are each scored. Without labels every score is 0. Only `doc_id` and `text`
of documents, `doc_id` and `toxic` of labels are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citedspark.llm.arrays import LOWER, NOT_BLANK, Words, carried, mixed, prefix_sums, range_hashes, slices, text_bytes, whole_text

SAMPLE = 40_000
SUPPORT, SIGNIFICANT, TELLING = 5, 12.0, 4.5
BEGINNINGS = (4, 5, 6)
#: Symbols of the character model: the edge of a word, 26 letters, other bytes folded to 32.
SYMBOLS = 64
#: Text bytes that a task takes apart at a time.
SLICE = 1 << 18
#: Decoded words, and runs of words, that a task remembers.
REMEMBERED = 50_000

# The letters that a sign or digit can stand for.
RESEMBLES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h", "%": "x", "&": "a",
}

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[0x80:] = 27 + (np.arange(0x80, 0x100) & 31)
_LETTER = _SYMBOL > 0
_SYMBOLS = _SYMBOL.tolist()
_MARK = np.zeros(256, bool)  # printable ASCII that is no letter
_MARK[[*range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_TRIM = np.zeros(256, bool)
_TRIM[list(b".,;:!?\"'()[]")] = True


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Character trigrams of a task's texts; what is no letter is an edge."""
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in slices(batches, 0, SLICE):
        raw, _ = text_bytes(batch.column(0))
        symbol = np.concatenate([[0, 0], _SYMBOL[LOWER[raw]], [0]])
        total += np.bincount((symbol[:-2] * SYMBOLS + symbol[1:-1]) * SYMBOLS + symbol[2:], minlength=SYMBOLS**3)
    cells = np.flatnonzero(total)
    yield pa.record_batch([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])


def character_model(documents: DataFrame) -> np.ndarray:
    """Log-probabilities of a symbol after two others, from all texts: at most SYMBOLS**3 counts."""
    texts = documents.select(whole_text(documents).alias("text"))
    rows = texts.mapInArrow(_counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    for cell, n in rows:
        counts[cell] = n
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = three.sum(axis=0)
    one = two.sum(axis=0) + 1.0
    p1 = one / one.sum()
    p2 = (two + 5.0 * p1) / (two.sum(axis=1, keepdims=True) + 5.0)
    p3 = (three + 5.0 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5.0)
    return np.log(p3).astype(np.float32)


class Restorer:
    """Viterbi decoding of disguised words under a character model."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model
        self.known: tuple[dict[bytes, bytes], dict[bytes, bytes]] = ({}, {})
        self.known_runs: dict[bytes, list[tuple[int, int, bytes]]] = {}
        self.rows: dict[tuple[int, int], list[float]] = {}

    def _choices(self, byte: int, length: int, loose: bool) -> list[tuple[bytes, float]]:
        """What a run of one byte can stand for, with the log-probability of the channel.

        A doubled letter can stand for one if `loose`; not a byte of a longer character.
        """
        own = bytes([byte])
        if _LETTER[byte]:
            if length == 2 and loose and byte < 0x80:
                return [(own * 2, -0.5), (own, -1.0)]
            if length < 3:
                return [(own * length, 0.0)]
            return [(own, -1.0), (own * 2, -1.5)]
        letters = RESEMBLES.get(chr(byte), "").encode()
        found = [(b"", -2.5 if letters else -0.5)]
        for letter in letters:
            found.append((bytes([letter]), -1.0 - math.log(len(letters))))
            if length > 1:
                found.append((bytes([letter]) * 2, -2.0 - math.log(len(letters))))
        return found

    def restored(self, word: bytes, loose: bool = False) -> bytes:
        """The likeliest letters behind a lower-cased word."""
        known = self.known[loose].get(word)
        if known is not None:
            return known
        # A state is the last two symbols, so no more than SYMBOLS squared are kept, and none is left out.
        states: dict[tuple[int, int], tuple[float, bytes]] = {(0, 0): (0.0, b"")}
        place = 0
        while place < len(word):
            after = place
            while after < len(word) and word[after] == word[place]:
                after += 1
            following: dict[tuple[int, int], tuple[float, bytes]] = {}
            for letters, cost in self._choices(word[place], after - place, loose):
                for (a, b), (score, text) in states.items():
                    total = score + cost
                    for letter in letters:
                        symbol = _SYMBOLS[letter]
                        total += self._after(a, b)[symbol]
                        a, b = b, symbol
                    best = following.get((a, b))
                    if best is None or total > best[0] or (total == best[0] and text + letters < best[1]):
                        following[(a, b)] = (total, text + letters)
            states = following
            place = after
        ends = [(score + self._after(a, b)[0], text) for (a, b), (score, text) in states.items()]
        text = min(ends, key=lambda end: (-end[0], end[1]))[1]
        if len(self.known[loose]) >= REMEMBERED:
            self.known[loose].clear()
        self.known[loose][word] = text
        return text

    def _after(self, a: int, b: int) -> list[float]:
        """The model's row after two symbols."""
        row = self.rows.get((a, b))
        if row is None:
            row = self.rows[a, b] = self.model[a, b].tolist()
        return row

    def _path(self, words: list[bytes], boundaries: bool) -> list[tuple[int, int, bytes]]:
        """(first word, words, letters) of the likeliest path through the lattice of neighbouring words."""
        steps: list[list[tuple[bytes, float]]] = []
        for number, word in enumerate(words):
            if number:
                steps.append([(b"\0", -0.7), (b" ", -0.7)] if boundaries else [(b"\0", 0.0)])
            place = 0
            while place < len(word):
                after = place
                while after < len(word) and word[after] == word[place]:
                    after += 1
                choices = self._choices(word[place], after - place, True)
                if not place and number and word[0] == words[number - 1][-1] and word[0] < 0x80 and _LETTER[word[0]]:
                    choices = [*choices, (b"", -1.5)]  # a letter doubled over a space
                steps.append(choices)
                place = after
        # A state is the last two symbols; its path is linked backwards.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for choices in steps:
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (x, y), (score, path) in states.items():
                for letters, cost in choices:
                    a, b, total = x, y, score + cost
                    if letters != b"\0":
                        for letter in letters:
                            symbol = _SYMBOLS[letter]
                            total += self._after(a, b)[symbol]
                            a, b = b, symbol
                    best = following.get((a, b))
                    if best is None or total > best[0]:
                        following[a, b] = (total, (path, letters))
            states = following
        path = max(states.items(), key=lambda state: state[1][0] + self._after(*state[0])[0])[1][1]
        pieces: list[bytes] = []
        while path is not None:
            path, letters = path
            pieces.append(letters)
        found, first = [], 0
        for part in b"".join(reversed(pieces)).split(b" "):
            count = part.count(b"\0") + 1
            found.append((first, count, part.replace(b"\0", b"")))
            first += count
        return found

    def readings(self, words: list[bytes]) -> list[tuple[int, int, bytes]]:
        """(first word, words, letters) of words that neighbouring short words may spell together."""
        key = b" ".join(words)
        known = self.known_runs.get(key)
        if known is None:
            both = dict.fromkeys([*self._path(words, True), *self._path(words, False)])
            known = [reading for reading in both if reading[1] > 1 and reading[2]]
            if len(key) <= 64:
                if len(self.known_runs) >= REMEMBERED:
                    self.known_runs.clear()
                self.known_runs[key] = known
        return known


class RestoredWords:
    """The words of a slice after restoration: hashes of words and beginnings, and their rows."""

    def __init__(self, array: pa.Array, restorer: Restorer) -> None:
        words = Words(array, NOT_BLANK)
        data, starts, ends = words.data, words.starts.copy(), words.ends.copy()
        trim = _TRIM[data]
        for _ in range(3):  # marks around a word
            inner = starts < ends - 1
            starts += inner & trim[np.where(inner, starts, 0)]
            inner = starts < ends - 1
            ends -= inner & trim[np.where(inner, ends - 1, 0)]
        sums = prefix_sums(data)
        marks = np.concatenate([[0], np.cumsum(_MARK[data])])
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        triple = np.zeros(len(data) + 1, np.int64)
        if len(data) > 2:
            same = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]]
            np.cumsum(same, out=triple[3:])
            triple[1:3] = 0
        repeats = triple[ends] - triple[np.minimum(starts + 2, ends)]
        has = letters[ends] > letters[starts]
        disguised = has & ((marks[ends] > marks[starts]) | (repeats > 0))
        # Three words or more of one letter each, in one row: a word written letter by letter.
        single = has & (ends - starts == 1)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        spelled = [
            (a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= 3
        ]
        self.first, self.row = words.first, words.row
        self.hashes = range_hashes(sums, starts, ends)
        self.beginnings = np.zeros((len(starts), len(BEGINNINGS)), np.uint64)
        for column, size in enumerate(BEGINNINGS):
            enough = np.flatnonzero(ends - starts > size)
            self.beginnings[enough, column] = mixed(
                range_hashes(sums, starts[enough], starts[enough] + size) + np.uint64(size)
            )
        #: (row, first word, observed, restored) of the words that were rewritten.
        self.changes: list[tuple[int, int, bytes, bytes]] = []
        raw = data.tobytes()
        found = [(int(at), raw[starts[at] : ends[at]]) for at in np.flatnonzero(disguised)]
        for a, b in spelled:
            row = words.row[a:b]
            for part in np.split(np.arange(a, b), np.flatnonzero(np.diff(row)) + 1):
                if len(part) >= 3:
                    found.append((int(part[0]), bytes(data[starts[part]])))
        texts = [restorer.restored(word) for _, word in found]
        if texts:
            joined = np.frombuffer(b"".join(texts), np.uint8)
            edges = np.concatenate([[0], np.cumsum([len(text) for text in texts])]).astype(np.int64)
            own = prefix_sums(joined)
            at = np.array([place for place, _ in found])
            self.hashes[at] = range_hashes(own, edges[:-1], edges[1:])
            for column, size in enumerate(BEGINNINGS):
                enough = np.diff(edges) > size
                value = np.zeros(len(at), np.uint64)
                value[enough] = mixed(
                    range_hashes(own, edges[:-1][enough], edges[:-1][enough] + size) + np.uint64(size)
                )
                self.beginnings[at, column] = value
            self.changes = [
                (int(self.row[place]), int(place - self.first[self.row[place]]), word, text)
                for (place, word), text in zip(found, texts, strict=True)
                if word != text
            ]
        base = {place: text for (place, _), text in zip(found, texts, strict=True)}
        self._read(raw, starts, ends, restorer, base, letters, marks)

    def _read(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, restorer: Restorer, base: dict[int, bytes], letters: np.ndarray, marks: np.ndarray) -> None:
        """Further readings: their hashes, rows and neighbours."""
        data = np.frombuffer(raw, np.uint8)
        doubled = np.zeros(len(data) + 1, np.int64)
        if len(data) > 1:
            np.cumsum((data[1:] == data[:-1]) & _LETTER[data[1:]] & (data[1:] < 0x80), out=doubled[2:])
        twice = doubled[ends] > doubled[np.minimum(starts + 1, ends)]
        signs = (letters[ends] == letters[starts]) & (marks[ends] > marks[starts])
        read: list[tuple[int, int, bytes, bytes]] = []  # (first word, words, observed, text)
        for at in np.flatnonzero(twice | signs).tolist():
            word = raw[starts[at] : ends[at]]
            text = restorer.restored(word, True)
            if text and text != word and text != base.get(at):
                read.append((at, 1, word, text))
        sizes = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        short = sizes[ends] - sizes[starts] <= 2
        near = np.flatnonzero(short[1:] & short[:-1] & (self.row[1:] == self.row[:-1]))
        cut = np.flatnonzero(np.diff(near) > 1) + 1
        firsts, lasts = (near[np.concatenate([[0], cut])], near[np.append(cut - 1, len(near) - 1)] + 2) if len(near) else (near, near)
        begin, end = starts.tolist() if len(near) else [], ends.tolist() if len(near) else []
        for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
            words = [raw[begin[at] : end[at]] for at in range(a, b)]
            for first, count, text in restorer.readings(words):
                if text != base.get(a + first):
                    read.append((a + first, count, b" ".join(words[first : first + count]), text))
        place = np.array([at for at, *_ in read], np.int64)
        after = place + np.array([count for _, count, *_ in read], np.int64)
        joined = np.frombuffer(b"".join(text for *_, text in read), np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(text) for *_, text in read])]).astype(np.int64)
        own = prefix_sums(joined)
        hashes = range_hashes(own, edges[:-1], edges[1:])
        beginnings = np.zeros((len(read), len(BEGINNINGS)), np.uint64)
        for column, size in enumerate(BEGINNINGS):
            enough = np.flatnonzero(np.diff(edges) > size)
            beginnings[enough, column] = mixed(range_hashes(own, edges[enough], edges[enough] + size) + np.uint64(size))
        beside = np.concatenate([[np.uint64(0)], self.hashes, [np.uint64(0)]])
        #: Of the words and then of the further readings: rows, and hashes of the words on either side.
        self.rows = np.concatenate([self.row, self.row[place]])
        self.before = np.concatenate([beside[:-2], beside[place]])
        self.after = np.concatenate([beside[2:], beside[after + 1]])
        self._features = np.concatenate(
            [np.concatenate([self.hashes, hashes])[:, None], np.concatenate([self.beginnings, beginnings])], axis=1
        )
        self.changes += [
            (int(self.row[at]), int(at - self.first[self.row[at]]), observed, text) for at, _, observed, text in read
        ]

    def features(self) -> np.ndarray:
        """words and readings x (word, beginnings) hashes; 0 where a word is too short."""
        return self._features


def _contexts(model: np.ndarray):
    """Distinct (feature, neighbour, side) of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in slices(batches, 1, SLICE):
            words = RestoredWords(batch.column(1), restorer)
            features = words.features()
            flat = features.reshape(-1)
            on = flat != 0
            for side, near in enumerate((words.before, words.after)):
                context = np.broadcast_to(near[:, None], features.shape).reshape(-1)
                pairs = np.unique(np.stack([flat[on], context[on]], axis=1), axis=0) if on.any() else np.zeros((0, 2), np.uint64)
                yield pa.record_batch(
                    [
                        pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64)),
                        pa.array(np.full(len(pairs), side, np.int32)),
                    ],
                    names=["feature", "context", "side"],
                )

    return run


def _matched(model: np.ndarray, known: np.ndarray):
    """How often each known feature stands in a task's texts; feature 0 counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, total, words_seen = Restorer(model), np.zeros(len(known), np.int64), 0
        for batch in slices(batches, 1, SLICE):
            words = RestoredWords(batch.column(1), restorer)
            words_seen += len(words.hashes)
            flat = words.features().reshape(-1)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                total += np.bincount(at[known[at] == flat], minlength=len(known))
        on = np.flatnonzero(total)
        yield pa.record_batch(
            [pa.array(np.append(known[on], np.uint64(0)).view(np.int64)), pa.array(np.append(total[on], words_seen))],
            names=["feature", "n"],
        )

    return run


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id's text modulo 5; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string")) % 5


class Evidence:
    """What training leaves: the prior log-odds, and features with their weights."""

    def __init__(self, prior: float, features: np.ndarray, weights: np.ndarray) -> None:
        self.prior, self.features, self.weights = prior, features, weights


def learnt(documents: DataFrame, labels: DataFrame, model: np.ndarray, sample: int = SAMPLE) -> Evidence:
    """Evidence from labelled rows of the folds 1 to 4."""
    marked = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(fold("doc_id") != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    count = marked.count()
    if count > sample:  # about `sample` rows, whichever order they come in
        share = int(sample / count * (1 << 30))
        marked = marked.where(F.expr(f"pmod(xxhash64(doc_id), {1 << 30}) < {share}"))
    rows = (
        documents.select("doc_id", whole_text(documents).alias("text"))
        .join(F.broadcast(marked), "doc_id")  # at most about `sample` rows of two numbers
    )
    toxic, clean = rows.where("toxic = 1").select("doc_id", "text"), rows.where("toxic = 0").select("doc_id", "text")
    classes = {row["toxic"]: row["count"] for row in marked.groupBy("toxic").count().collect()}
    if not classes.get(0) or not classes.get(1):
        return Evidence(-40.0 if not classes.get(1) else 40.0, np.zeros(0, np.uint64), np.zeros(0))
    # Bounded by the words of the sample.
    seen = (
        toxic.mapInArrow(_contexts(model), "feature long, context long, side int").distinct()
        .groupBy("feature", "side").count()
        .groupBy("feature").agg(F.min("count").alias("count")).where(F.col("count") >= SUPPORT).toPandas()
    )
    known = np.sort(seen["feature"].to_numpy(np.int64).view(np.uint64))
    in_toxic = np.zeros(len(known))
    in_toxic[np.searchsorted(known, seen["feature"].to_numpy(np.int64).view(np.uint64))] = seen["count"]

    def counts(texts: DataFrame) -> tuple[np.ndarray, int]:
        found = (
            texts.mapInArrow(_matched(model, known), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
        ).toPandas()
        feature, n = found["feature"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy()
        out = np.zeros(len(known))
        own = feature != 0
        out[np.searchsorted(known, feature[own])] = n[own]
        return out, int(n[~own].sum())

    in_clean, clean_words = counts(clean)
    _, toxic_words = counts(toxic)
    rate = toxic_words / max(1, toxic_words + clean_words)
    total = in_toxic + in_clean
    gain = in_toxic * np.log(in_toxic / (total * rate)) + in_clean * np.log(np.maximum(in_clean, 1e-9) / (total * (1 - rate)))
    weight = np.log((in_toxic + 0.5) / (toxic_words + 1)) - np.log((in_clean + 0.5) / (clean_words + 1))
    keep = (gain >= SIGNIFICANT) & (weight >= TELLING)
    return Evidence(math.log(classes[1] / classes[0]), known[keep], weight[keep])


_CHANGES = pa.list_(pa.struct([("word", pa.int64()), ("observed", pa.string()), ("restored", pa.string())]))


def _scored(model: np.ndarray, evidence: Evidence):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for batch in slices(batches, 1, SLICE):
            words = RestoredWords(batch.column(1), restorer)
            strongest = np.zeros(batch.num_rows)
            if len(evidence.features) and len(words.hashes):
                features = words.features()
                at = np.minimum(np.searchsorted(evidence.features, features), len(evidence.features) - 1)
                own = np.where(evidence.features[at] == features, evidence.weights[at], 0.0).max(axis=1)
                np.maximum.at(strongest, words.rows, own)
            score = 1.0 / (1.0 + np.exp(-(evidence.prior + strongest)))
            row = np.array([change[0] for change in words.changes], np.int64)
            order = np.argsort(row, kind="stable")
            own = [words.changes[at] for at in order.tolist()]
            structs = pa.StructArray.from_arrays(
                [
                    pa.array([word for _, word, *_ in own], pa.int64()),
                    *[pa.array([change[k].decode(errors="replace") for change in own], pa.string()) for k in (2, 3)],
                ],
                fields=list(_CHANGES.value_type),
            )
            offsets = np.searchsorted(row[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            changes = pa.ListArray.from_arrays(pa.array(offsets), structs)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(score), changes.cast(_CHANGES)],
                names=["row", "text", "score", "restored"],
            )

    return run


def scored_rows(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Each row of `documents` (as `carried` has it) with score and restored words."""
    model = character_model(documents)
    evidence = learnt(documents, labels, model, sample)
    rows = carried(documents)
    added = "score double, restored array<struct<word:bigint,observed:string,restored:string>>"
    schema = StructType([*rows.schema, *StructType.fromDDL(added)])
    return rows.mapInArrow(_scored(model, evidence), schema)


def toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score and the words that were restored, for every row of `documents`."""
    return scored_rows(documents, labels, sample).select("row.doc_id", "score", "restored")
