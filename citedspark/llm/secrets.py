"""Secret scans: fixed forms, and character Markov models compared by log-likelihood ratio.

Fixed forms (an assignment, an access key, a long hexadecimal run) are found by pattern. Two
first-order Markov models over the characters of a token, one of random strings and one of
ordinary identifiers, are trained from labelled samples: what the fixed forms matched, and the
identifiers of the same documents with those matches taken out. A token of LEAST characters or
more whose log-likelihood ratio reaches TELLING is a span of kind `random`.

Everything is DataFrame functions on the row itself: no shuffle of texts and no Python in tasks.
The models train on about SAMPLE documents, chosen by a hash of the text; all documents are
scanned whole.

Nulls, ties, repeats: a null text is the empty text and has no spans. Spans of different kinds
may overlap and are all kept, ordered by start and kind. Rows are independent, so repeated rows
are each returned. A sample without secrets, or without identifiers, gives no `random` spans.
Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citedspark.llm.arrays import carried, whole_text

SAMPLE = 20_000
LEAST, TELLING = 16, 15.0
KINDS = ("assign", "access", "hex", "random")

# Fixed values. Letters of the names count in either case.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"

_TOKEN = "[A-Za-z0-9+/_=-]"
#: Characters of the models; a character's number is its place here.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _places(text: Column, pattern: str, kind: int, kept: Column | None = None) -> Column:
    """(start, kind, end) of the leftmost non-overlapping matches, in characters.

    What lies between two matches is what splitting leaves, so running sums of lengths are places.
    `kept` is an array of booleans, one for each match.
    """
    between = F.transform(F.split(text, pattern, -1), F.length)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    steps = F.arrays_zip(between.alias("gap"), matches.alias("size"), *([kept.alias("kept")] if kept is not None else []))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(done: Column, each: Column) -> Column:
        begin = done["at"] + each["gap"]
        end = begin + F.coalesce(each["size"], F.lit(0))
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        ok = each["size"].isNotNull()
        if kept is not None:
            ok = ok & each["kept"]
        return F.struct(end.alias("at"), F.when(ok, F.concat(done["out"], span)).otherwise(done["out"]).alias("out"))

    found = F.aggregate(steps, start, step, lambda done: done["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def fixed_spans(text: Column) -> dict[str, Column]:
    """Spans of each fixed form."""
    long_value = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda value: F.length(value) >= 8)
    return {
        "assign": _places(text, ASSIGN, 0, long_value),
        "access": _places(text, ACCESS, 1),
        "hex": _places(text, HEX, 2),
    }


def _pairs(token: Column) -> Column:
    """All pairs of neighbouring characters: those at even places, then those at odd ones."""
    return F.concat(
        F.regexp_extract_all(token, F.lit(".."), F.lit(0)),
        F.regexp_extract_all(F.substring(token, 2, 2**31 - 1), F.lit(".."), F.lit(0)),
    )


def trained(documents: DataFrame, sample: int = SAMPLE) -> list[float] | None:
    """Log-ratio of the two models for each pair of characters, or None without both samples.

    At most len(ALPHABET) ** 2 counts a model reach the driver.
    """
    texts = documents.select(whole_text(documents).alias("text"))
    count = texts.count()
    if count > sample:
        share = int(sample / count * (1 << 30))
        texts = texts.where(F.expr(f"pmod(xxhash64(text), {1 << 30}) < {share}"))
    text = F.col("text")
    values = F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda value: F.length(value) >= 8)
    secret = F.concat(
        values,
        F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all(text, F.lit(HEX), F.lit(0)),
    )
    plain = text
    for pattern in (ASSIGN, ACCESS, HEX):
        plain = F.regexp_replace(plain, pattern, " ")
    ordinary = F.regexp_extract_all(plain, F.lit(_TOKEN + "{8,}"), F.lit(0))
    labelled = texts.select(
        F.explode(
            F.array(F.struct(F.lit(1).alias("y"), secret.alias("tokens")), F.struct(F.lit(0).alias("y"), ordinary.alias("tokens")))
        ).alias("s")
    ).select("s.y", F.explode("s.tokens").alias("token"))
    # A copied text teaches no more than one: each token counts once.
    rows = (
        labelled.distinct().select("y", F.explode(_pairs(F.col("token"))).alias("pair"))
        .where(F.col("pair").rlike(f"^{_TOKEN}{{2}}$")).groupBy("y", "pair").count().collect()
    )
    size = len(ALPHABET)
    logs = []
    for wanted in (1, 0):
        counts = [[0.0] * size for _ in range(size)]
        for y, pair, n in rows:
            if y == wanted:
                counts[ALPHABET.index(pair[0])][ALPHABET.index(pair[1])] += n
        after = [1.0 + sum(row[b] for row in counts) for b in range(size)]
        total = sum(after)
        if total <= size:
            return None
        strength = 16.0
        logs.append(
            [
                math.log((row[b] + strength * after[b] / total) / (sum(row) + strength))
                for row in counts for b in range(size)
            ]
        )
    return [random - ordinary for random, ordinary in zip(*logs, strict=True)]


def _random_spans(text: Column, ratios: list[float] | None) -> Column:
    """Spans of tokens that are likelier random than ordinary."""
    if ratios is None:
        return F.array().cast(_SPANS)
    pattern = _TOKEN + f"{{{LEAST},}}"
    table = F.split(F.lit(",".join(f"{ratio:.6f}" for ratio in ratios)), ",").cast("array<double>")
    number = lambda letter: F.instr(F.lit(ALPHABET), letter)  # noqa: E731  from 1

    def telling(token: Column) -> Column:
        places = F.transform(
            _pairs(token),
            lambda pair: (number(F.substring(pair, 1, 1)) - 1) * len(ALPHABET) + number(F.substring(pair, 2, 1)),
        )
        return F.aggregate(places, F.lit(0.0), lambda sum_, place: sum_ + F.element_at(table, place)) >= TELLING

    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _places(text, pattern, 3, F.transform(tokens, telling))


def spanned_rows(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Each row of `documents` (as `carried` has it) with the spans of each kind."""
    ratios = trained(documents, sample)
    text = F.coalesce("text", F.lit(""))
    return carried(documents).select(
        "row", "text",
        *[spans.alias(kind) for kind, spans in fixed_spans(text).items()],
        _random_spans(text, ratios).alias("random"),
    )


def secret_spans(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, and the spans of each kind as arrays of (start, kind, end), for every row.

    Places are characters (code points), the end exclusive; kinds are numbered as in KINDS.
    """
    return spanned_rows(documents, sample).select("row.doc_id", "text", *KINDS)


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda span: F.concat_ws(":", F.element_at(names, span["kind"] + 1), span["start"], span["end"]),
        ),
        ",",
    )


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by a mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, span: Column) -> Column:
        gap = F.substr(text, done["at"] + 1, span["start"] - done["at"])
        longer = F.concat(done["out"], gap, F.lit(mark))
        return F.struct(
            F.when(span["start"] >= done["at"], longer).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], span["end"]).alias("at"),
        )

    whole = F.aggregate(
        F.array_sort(spans), start, step,
        lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)
