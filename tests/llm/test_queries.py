"""The registered queries over small tables, all columns and digests, against plain programs."""

import hashlib
import random
import re
import struct
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from citedspark.llm import license_text, queries, suffix_automaton
from citedspark.llm.byte_bpe import ByteBpe

LOWER = str.maketrans({chr(n): chr(n + 32) for n in range(65, 91)})
SECRET = [
    (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII, lambda m: len(m[2]) >= 8),
    (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
    (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def letters(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def tables(spark, documents, texts, tmp_path_factory):
    """A folder with documents (repeats, nulls, clashing names, one of a megabyte), benchmark items and labels."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(12)
    key = "".join(rng.choice("abcdef0123456789") for _ in range(40))
    notice = license_text.TEMPLATES[0][1]
    long_text = " ".join(f"{rng.choice(texts[:20])} {k}" for k in range(2500))
    extra = [
        f'é Password: "{key}" and api_key=short, AKIA{"Q7" * 9} {key}{key}', "token = " + "x9" * 8 + f";{key}",
        f"Under the MIT License. {notice} apache license version 2 -- CC by NC", "under the mit " * 3 + "license",
        notice.upper() + " 日本 " + notice, long_text, long_text[300:900] + " tail",
    ]
    more = spark.createDataFrame([(700 + n, text) for n, text in enumerate(extra)], "doc_id long, text string")
    documents.unionByName(more, allowMissingColumns=True).repartition(4).write.parquet(f"{folder}/documents.parquet")
    items = [(1, texts[1]), (2, "a"), (3, long_text[500:700]), (None, texts[4]), (4, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    return folder, rows, items


def same(found, expected, columns):
    """The rows agree in the named columns, repeated rows and rows without doc_id included."""
    assert Counter(tuple(row[c] for c in columns) for row in found) == Counter(expected)


def test_secret_scan(spark, tables):
    folder, rows, _ = tables
    found = queries.op1_secret_scan(spark, folder).collect()
    names = ("assign", "access", "hex")

    def plain(doc, text):
        spans, counts = [], []
        for kind, (pattern, flags, kept) in enumerate(SECRET):
            own = [m.span() for m in re.finditer(pattern, text or "", flags) if kept(m)]
            counts.append(len(own))
            spans += [(a, kind, b) for a, b in own]
        return (doc, *counts, sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))))

    same(found, [plain(*row) for row in rows], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"])
    assert sum(row["n_assign"] for row in found) >= 2 and sum(row["n_hex"] for row in found) >= 3
    for row in found:  # base spans stay in the whole list
        base = [span for span in row["spans"].split(",") if span and not span.startswith("random")]
        assert sha(",".join(base)) == row["base_sha256"]


def test_decontamination(spark, tables):
    folder, rows, items = tables
    windows = {}
    for item, text in items:
        words = letters(text)
        size = min(13, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[at : at + size]), set()).update(() if item is None else {str(item)})
    sizes = {len(window) for window in windows}

    def plain(doc, text):
        words, hit, named = letters(text), set(), set()
        for size in sizes:
            for at in range(len(words) - size + 1):
                owners = windows.get(tuple(words[at : at + size]))
                if owners is not None:
                    hit.update(range(at, at + size))
                    named |= owners
        return (doc, len(words), len(hit), len(named), sha(",".join(sorted(named))), bool(hit) and 20 * len(hit) >= len(words))

    found = queries.op3_fm_index_decontamination(spark, folder).collect()
    same(found, [plain(*row) for row in rows], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    assert any(row["n_hit"] and not row["n_items"] for row in found)


def test_license_scan(spark, tables):
    folder, rows, _ = tables
    phrases = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}

    def plain(doc, text):
        words = letters(text)
        places = [(at, label) for phrase, label in phrases.items() for at in range(len(words)) if tuple(words[at : at + len(phrase)]) == phrase]
        starts = [at for at, _ in places]
        return (doc, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places})))

    found = queries.op5_license_automaton(spark, folder).collect()
    same(found, [plain(*row) for row in rows], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"])
    label = license_text.TEMPLATES[0][0]
    by_doc = {row["doc_id"]: row for row in found}
    assert {label} <= set(by_doc[702]["labels"].split(",")) and label in by_doc[704]["labels"].split(",")
    for row in found:
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1


def plain_chains(places, least):
    """The best chain, then the best before and after it, each time weighed anew."""
    if not places:
        return []
    best = []
    for at, (match, start, _, first, last) in enumerate(places):
        own = (last - first, at)
        for before in range(at - 1, -1, -1):
            other, _, end, _, reached = places[before]
            if start - end > suffix_automaton.GAP:
                break
            if other < match and last > reached and abs(first - reached) <= suffix_automaton.GAP:
                total = best[before][0] + last - max(first, reached)
                if total > own[0] or total == own[0] and total > last - first and best[before][1] > own[1]:
                    own = (total, best[before][1])
        best.append(own)
    last = max(range(len(places)), key=lambda at: (best[at][0], -at))
    covered, first = best[last]
    if covered < least:
        return []
    left = [place for place in places if place[0] < places[first][0]]
    right = [place for place in places if place[0] > places[last][0]]
    return [(places[first], places[last], covered), *plain_chains(left, least), *plain_chains(right, least)]


def test_best_chains_equal_weighing_anew():
    rng = random.Random(5)
    for _ in range(1500):
        places, at = [], 0
        for match in range(rng.randint(0, 14)):
            at += rng.choice([0, 1, 2, 9, 20])
            size = rng.randint(4, 9)
            for _ in range(rng.randint(1, 3)):
                first = rng.randrange(30)
                places.append((match, at, at + size, first, first + size))
            at += size
        least = rng.choice([4, 8, 15])
        found = [(part[first], part[last], covered) for part, first, last, covered in suffix_automaton._chains(places, least)]
        assert sorted(found) == sorted(plain_chains(places, least))


def test_notices_side_by_side():
    """A text of megabytes of notices takes seconds, and each notice is found."""
    known = suffix_automaton.Templates(license_text.TEMPLATES, license_text.PHRASES)
    sequence = known.vocabulary.searchsorted(words_of(license_text.TEMPLATES[0][1]).hashes).tolist()
    run = sequence * (3_000_000 // len(license_text.TEMPLATES[0][1]))
    _, matches = known.scanned(run)
    spans = known.chained(matches)
    assert sum(label == license_text.TEMPLATES[0][0] for label, *_ in spans) == len(run) // len(sequence)


def words_of(text):
    import pyarrow as pa

    return suffix_automaton.Words(pa.array([text]), suffix_automaton.LETTERS)


def test_bpe(spark, tables):
    folder, rows, _ = tables
    bpe = ByteBpe(public_tokenizers.path(queries.RANKS))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})

    def plain(doc, text):
        ids = known.encode_ordinary(text or "")
        return (doc, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((text or "").encode()))

    found = queries.op9_byte_bpe(spark, folder).collect()
    same(found, [plain(*row) for row in rows], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def test_repeats(spark, tables):
    folder, rows, _ = tables
    raw = [(text or "").encode() for _, text in rows]
    seen = Counter(text[at : at + 200] for text in raw for at in range(len(text) - 199))

    def plain(doc, text):
        gone = bytearray(len(text))
        for at in range(len(text) - 199):
            if seen[text[at : at + 200]] > 1:
                gone[at : at + 200] = b"\1" * 200
        kept = bytes(byte for byte, out in zip(text, gone) if not out)
        return (doc, len(text), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))

    found = queries.op10_bwt_merge(spark, folder).collect()
    same(found, [plain(doc, text) for (doc, _), text in zip(rows, raw, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def test_near_duplicates(spark, tables):
    folder, rows, _ = tables
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[doc, text] = frozenset(tuple(words[at : at + 2]) for at in range(max(1, len(words) - 1))) if words else frozenset()
    group = {key: key for key in sets if key[0] is not None}

    def root(key):
        while group[key] != key:
            key = group[key]
        return key

    keys = list(group)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                group[root(a)] = root(b)
    least = {}
    for key in keys:
        least[root(key)] = min(least.get(root(key), key[0]), key[0])
    expected = []
    for doc, text in rows:
        component = None if doc is None else least[root((doc, text))] if sets[doc, text] else doc
        expected.append((doc, len(sets[doc, text]), component, component is not None and doc == component))
    found = queries.op2_minhash_dedup(spark, folder).collect()
    same(found, expected, ["doc_id", "n_shingles", "component_id", "kept"])
