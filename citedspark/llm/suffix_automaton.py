"""Licence scans with a generalised suffix automaton of template words.

Each text is streamed through the automaton; after every word it gives the longest run of words
ending there that stands in some template (the matching statistics). Runs of four words or more
that cannot be extended are matches; matches that follow one another both in the text and in a
template, with a gap of at most GAP words, are chained. All places of a match in a template are
weighed, and the chain that covers most is taken, then the best before and after it; a chain that
covers COVERED of its template gives the template's label to the span. Phrases that name a licence are read off the
automaton's states. Words outside the templates reset the automaton, so only runs of template
words are walked, one word at a time.

Nulls, ties, repeats: a null text is the empty text: no words, places or spans. Rows are
independent, so repeated rows are each returned. Templates that match equally well are all
reported. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citedspark.llm.arrays import LETTERS, Words, slices, whole_text

MATCH, GAP, COVERED = 4, 8, 0.6


class SuffixAutomaton:
    """All runs of words of several sequences; state 0 is the empty run."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        #: Of each state: the sequences in which its runs stand, with the first end of each.
        self.ends: list[dict[int, int]] = [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extended(last, word)
                state = last
                while state > 0 and number not in self.ends[state]:
                    self.ends[state][number] = place + 1
                    state = self.link[state]
        #: Of each state: all ends of its runs in each of the sequences.
        self.all_ends: list[dict[int, list[int]]] = [{} for _ in self.next]
        for number, sequence in enumerate(sequences):
            state = 0
            for place, word in enumerate(sequence):
                state = above = self.next[state][word]
                while above > 0:
                    self.all_ends[above].setdefault(number, []).append(place + 1)
                    above = self.link[above]

    def _new(self, size: int, following: dict[int, int], link: int, ends: dict[int, int]) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        self.ends.append(ends)
        return len(self.next) - 1

    def _split(self, state: int, word: int) -> int:
        """The state that `word` leads to from `state`, with no longer runs than that step gives."""
        target = self.next[state][word]
        if self.size[target] == self.size[state] + 1:
            return target
        copy = self._new(self.size[state] + 1, dict(self.next[target]), self.link[target], dict(self.ends[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extended(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        fresh = self._new(self.size[last] + 1, {}, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = fresh
            last = self.link[last]
        if last >= 0:
            self.link[fresh] = self._split(last, word)
        return fresh

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and length of the longest run that ends with `word`."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.size[state]
        following = self.next[state].get(word)
        return (0, 0) if following is None else (following, length + 1)


class Templates:
    """The automaton of the templates and phrases, over the ids of their words."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]) -> None:
        words = Words(pa.array([text for _, text in templates] + [text for text, _ in phrases], pa.string()), LETTERS)
        self.vocabulary, ids = np.unique(words.hashes, return_inverse=True)
        rows = [ids[a:b].tolist() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.labels = [label for label, _ in templates]
        self.sizes = [len(row) for row in rows]
        self.automaton = SuffixAutomaton(rows)
        self.shortest = min([MATCH, *(len(row) for row in rows[len(templates) :])])
        #: Of each state: the phrases that end where its runs end, as (words, label).
        own: dict[int, list[tuple[int, str]]] = {}
        for row, (_, label) in zip(rows[len(templates) :], phrases, strict=True):
            state = length = 0
            for word in row:
                state, length = self.automaton.step(state, length, word)
            own.setdefault(state, []).append((len(row), label))
        self.phrases: list[list[tuple[int, str]]] = []
        for state in range(len(self.automaton.next)):
            found, above = [], state
            while above > 0:
                found += own.get(above, [])
                above = self.automaton.link[above]
            self.phrases.append(found)

    def scanned(self, run: list[int]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """(start, label) of phrases and (start, end, state) of matches in a run of words."""
        places, matches = [], []
        step, state, length = self.automaton.step, 0, 0
        for place, word in enumerate(run):
            new_state, new_length = step(state, length, word)
            if new_length <= length and length >= MATCH:
                matches.append((place - length, place, state))
            state, length = new_state, new_length
            for size, label in self.phrases[state]:
                if length >= size:
                    places.append((place + 1 - size, label))
        if length >= MATCH:
            matches.append((len(run) - length, len(run), state))
        return places, matches

    def chained(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, start, end, share of the template) of the best chains of one text's matches."""
        places: dict[int, list[tuple[int, int, int, int, int]]] = {}
        for match, (start, end, state) in enumerate(matches):
            for number, ends in self.automaton.all_ends[state].items():
                if number < len(self.labels):
                    places.setdefault(number, []).extend((match, start, end, last - (end - start), last) for last in ends)
        spans = set()
        for number, own in places.items():
            for part, first, last, covered in _chains(own, COVERED * self.sizes[number]):
                spans.add((self.labels[number], part[first][1], part[last][2], covered / self.sizes[number]))
        return sorted(spans)


Place = tuple[int, int, int, int, int]


def _segments(places: list[Place]) -> Iterator[list[Place]]:
    """The places cut where the text has a gap that no chain crosses; places are in the order of their matches."""
    part: list[Place] = []
    reached = 0
    for place in places:
        if part and place[1] - reached > GAP:
            yield part
            part = []
        part.append(place)
        reached = max(reached, place[2]) if len(part) > 1 else place[2]
    if part:
        yield part


def _chains(places: list[Place], least: float) -> Iterator[tuple[list[Place], int, int, int]]:
    """(segment, first place, last place, words of the template) of the chains that cover `least` or more.

    Places are (match, start and end in the text, start and end in the template), by match. The
    chain that covers most is taken, then the best of what is left before and after it, and so on
    (ties: the one that ends first). A chain that is taken only changes those that reached back
    into it or beyond, so just the places near its end are weighed again: the work follows the
    number of places and not its square.
    """
    for part in _segments(places):
        count = len(part)
        covered, begun, floor = [0] * count, list(range(count)), [0] * count  # floor: the first place that counts
        for at in range(count):
            _weigh(part, at, 0, covered, begun)
        waiting = [(-covered[at], at) for at in range(count) if covered[at] >= least]
        heapify(waiting)
        taken = [False] * count
        while waiting:
            weight, last = heappop(waiting)
            if taken[last] or -weight != covered[last]:
                continue
            first, match = begun[last], part[last][0]
            yield part, first, last, covered[last]
            low = first
            while low > floor[last] and part[low - 1][0] == part[first][0]:
                low -= 1
            high = last + 1
            while high < count and part[high][0] == match:
                high += 1
            for at in range(low, high):
                taken[at] = True
            at, changed = high, part[high - 1][2]
            while at < count and not taken[at] and part[at][1] - changed <= GAP:
                before = covered[at], begun[at]
                floor[at] = high
                _weigh(part, at, high, covered, begun)
                if (covered[at], begun[at]) != before:
                    changed = max(changed, part[at][2])
                    if covered[at] >= least:
                        heappush(waiting, (-covered[at], at))
                at += 1


def _weigh(places: list[Place], at: int, floor: int, covered: list[int], begun: list[int]) -> None:
    """Set the best chain that ends with a place and begins at `floor` or later."""
    match, start, _, first, last = places[at]
    own = last - first
    covered[at], begun[at] = own, at
    for before in range(at - 1, floor - 1, -1):
        other, _, end, _, reached = places[before]
        if start - end > GAP:  # ends grow with the matches
            break
        if other < match and last > reached and abs(first - reached) <= GAP:
            total = covered[before] + last - max(first, reached)
            if total > covered[at] or total == covered[at] and total > own and begun[before] > begun[at]:
                covered[at], begun[at] = total, begun[before]


_SCHEMA = (
    "doc_id long, n_words long, places array<struct<start:long,label:string>>, "
    "spans array<struct<label:string,start:long,end:long,share:double>>"
)


def _scanned(templates: list[tuple[str, str]], phrases: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, phrases)
        top = len(known.vocabulary) - 1
        for batch in slices(batches, 1):
            words = Words(batch.column(1), LETTERS)
            at = np.minimum(np.searchsorted(known.vocabulary, words.hashes), top)
            inside = np.flatnonzero(known.vocabulary[at] == words.hashes)
            cut = np.flatnonzero((np.diff(inside) > 1) | (np.diff(words.row[inside]) > 0)) + 1
            firsts = np.concatenate([[0], cut]) if len(inside) else np.zeros(0, np.int64)
            lasts = np.append(cut, len(inside)) if len(inside) else firsts
            long = lasts - firsts >= known.shortest
            places: dict[int, list] = {}
            matches: dict[int, list] = {}
            for a, b in zip(firsts[long].tolist(), lasts[long].tolist(), strict=True):
                row = int(words.row[inside[a]])
                base = int(inside[a] - words.first[row])
                found, runs = known.scanned(at[inside[a:b]].tolist())
                if found:
                    places.setdefault(row, []).extend({"start": base + s, "label": label} for s, label in found)
                if runs:
                    matches.setdefault(row, []).extend((base + s, base + e, state) for s, e, state in runs)
            spans = {
                row: [dict(zip(("label", "start", "end", "share"), span, strict=True)) for span in known.chained(own)]
                for row, own in matches.items()
            }
            place_type = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
            span_type = pa.list_(
                pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
            )
            rows = range(batch.num_rows)
            yield pa.record_batch(
                [
                    batch.column(0), pa.array(np.diff(words.first)),
                    pa.array([places.get(row, []) for row in rows], place_type),
                    pa.array([spans.get(row, []) for row in rows], span_type),
                ],
                names=["doc_id", "n_words", "places", "spans"],
            )

    return run


def license_spans(
    documents: DataFrame, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]
) -> DataFrame:
    """doc_id, n_words, places of phrases (word start, label) and covered template spans, for every row.

    `templates` are (label, text), `phrases` are (text, label); both travel with the tasks.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(documents).alias("text"))
    return texts.mapInArrow(_scanned(templates, phrases), _SCHEMA)
