"""Operators that work on each text by itself, against plain programs."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from citedspark.llm import byte_bpe, fm_index, license_text, secrets, suffix_automaton
from citedspark.llm.arrays import LETTERS, NOT_BLANK, Words, carried, carried_columns, slices


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def letters(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def by_id(frame):
    return {(row["doc_id"], at): row for at, row in enumerate(sorted(frame.collect(), key=str))}


def test_words_of_a_sliced_array(texts):
    array = pa.array([None, "before", *texts, "after"], pa.string()).slice(1)
    for member, pattern in ((LETTERS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (NOT_BLANK, r"[^\x20\x09-\x0D]+")):
        words = Words(array, member)
        raw = words.data.tobytes()
        for row, text in enumerate(array.to_pylist()):
            own = [raw[words.starts[k] : words.ends[k]].decode() for k in range(words.first[row], words.first[row + 1])]
            assert own == re.findall(pattern, lower(text))
    assert len(np.unique(words.hashes)) == len({raw[a:b] for a, b in zip(words.starts, words.ends, strict=True)})


def test_slices_keep_all_rows(texts):
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["a", "b"])
    for limit in (0, 100, 10_000):
        rows = [row for part in slices(iter([batch, batch.slice(0, 0)]), 1, limit) for row in part.column(0).to_pylist()]
        assert rows == list(range(len(texts)))


def test_carried_columns(documents):
    again = carried(documents).select(carried_columns(documents))
    assert again.columns == documents.columns
    assert sorted(map(str, again.collect())) == sorted(map(str, documents.collect()))


# Byte-level BPE


def test_bpe_equals_the_public_tokenizer(spark, documents, empty, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = byte_bpe.decode(byte_bpe.encode(documents, path, public_tokenizers.PATTERN), path)
    rows = coded.collect()
    assert len(rows) == documents.count()
    for row in rows:
        text = texts[row["doc_id"] - 100] if row["doc_id"] is not None else texts[0]
        assert np.frombuffer(row["ids"], "<u4").tolist() == known.encode_ordinary(text or "")
        assert bytes(row["decoded"]) == (text or "").encode()
    assert byte_bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_odd_pieces():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    bpe = byte_bpe.ByteBpe(path)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(2)
    pieces = ["".join(rng.choice("aabetn日é") for _ in range(rng.randint(1, 40))) for _ in range(500)] + ["a" * 3000]
    for piece, ids in zip(pieces, bpe.encode_pieces(pieces), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == known._encode_single_piece(piece)
    with pytest.raises(KeyError):
        bpe.decode(np.array([10**6], "<u4").tobytes())


# Decontamination


def windows(items):
    found = {}
    for item, text in items:
        words = letters(text)
        size = min(13, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            found.setdefault(tuple(words[at : at + size]), set()).update(() if item is None else {str(item)})
    return found


@pytest.mark.parametrize("budget", [1 << 20, 60])
def test_removal_spans(spark, documents, empty, texts, budget, monkeypatch):
    monkeypatch.setattr(fm_index, "PHRASE_BYTES", budget)
    items = [(1, texts[1]), (2, texts[4]), (3, "a"), (4, "é 日本"), (5, ""), (6, None), (None, "ka"), (None, texts[2]), (7, texts[1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    asked = windows(items)  # an item without item_id hits and is not named
    for row in fm_index.removal_spans(documents, benchmark).collect():
        words = letters(texts[row["doc_id"] - 100] if row["doc_id"] is not None else texts[0])
        hit, named = set(), set()
        for window, owners in asked.items():
            for at in range(len(words) - len(window) + 1):
                if tuple(words[at : at + len(window)]) == window:
                    hit |= set(range(at, at + len(window)))
                    named |= owners
        spans = [range(span["start"], span["end"]) for span in row["spans"]]
        assert row["n_words"] == len(words)
        assert sorted(at for span in spans for at in span) == sorted(hit)
        assert all(a.stop < b.start for a, b in zip(spans, spans[1:], strict=False)) or budget == 60
        assert row["items"] == sorted(named)
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not row["spans"] for row in fm_index.removal_spans(documents, none).collect())
    assert fm_index.removal_spans(empty, benchmark).count() == 0


def test_fm_index_finds_all_places():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (40, 7, 1, 25, 40)])
    index = fm_index.FmIndex(text, 4)
    phrases = np.array([[1, 2, 3], [1, 1, 1], [3, 3, 2], [2, 1, 2]])
    found, low, high = index.search(phrases)
    got = {tuple(phrases[f]): sorted(index.locate(np.arange(a, b)).tolist()) for f, a, b in zip(found, low, high, strict=True)}
    for phrase in phrases.tolist():
        places = [at for at in range(len(text) - 2) if text[at : at + 3].tolist() == phrase]
        assert got.get(tuple(phrase), []) == places


# Licences


def test_licence_places_and_spans(spark, empty):
    mit = dict(license_text.TEMPLATES[:1])["mit"]
    rows = [
        (1, "Under the MIT-License. under the mit license"), (2, mit), (3, f"x {mit[:400]} y"), (4, None), (5, ""),
        (6, "Apache License, Version 2.0 and CC BY NC"), (7, "the software the software is"), (None, "cc by nc"),
        (8, " ".join(mit.split()[::2])),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {row["doc_id"]: row for row in suffix_automaton.license_spans(frame, license_text.TEMPLATES, license_text.PHRASES).collect()}
    assert [(p["start"], p["label"]) for p in got[1]["places"]] == [(0, "mit"), (4, "mit")]
    assert [(p["start"], p["label"]) for p in got[6]["places"]] == [(0, "apache-2"), (6, "cc-by-nc")]
    assert {s["label"] for s in got[2]["spans"]} == {"mit"} and got[2]["spans"][0]["share"] == 1.0
    assert {s["label"] for s in got[3]["spans"]} == {"mit"} and got[3]["spans"][0]["start"] == 1
    assert not got[4]["spans"] and not got[5]["places"] and got[4]["n_words"] == 0
    assert not got[7]["spans"] and not got[8]["spans"] and len(got[None]["places"]) == 1
    assert suffix_automaton.license_spans(empty, license_text.TEMPLATES, license_text.PHRASES).count() == 0


def test_chain_goes_on_over_repeated_runs_and_stray_matches(spark):
    shared = "alpha beta gamma delta epsilon"
    template = " ".join(["one two three four five six", shared, "seven eight nine ten eleven twelve", shared, "last words of the whole text here"])
    edited = " ".join(["one two three four five six", shared, "new seven eight nine ten eleven twelve new", shared, "new last words of the whole text here"])
    stray = "seven eight nine ten eleven twelve new one two three four new alpha beta gamma delta epsilon last words of the whole text here"
    frame = spark.createDataFrame([(1, edited), (2, stray), (3, f"{edited} {'other ' * 20} {edited}")], "doc_id long, text string")
    found = {row["doc_id"]: row["spans"] for row in suffix_automaton.license_spans(frame, [("t", template)], []).collect()}
    assert [(s["start"], s["end"], s["share"]) for s in found[1]] == [(0, len(edited.split()), 1.0)]
    assert [s["share"] for s in found[2]] == [pytest.approx(18 / 29)]
    assert len(found[3]) == 2


def test_automaton_has_every_run():
    rng = random.Random(4)
    sequences = [[rng.randint(0, 3) for _ in range(30)] for _ in range(5)]
    automaton = suffix_automaton.SuffixAutomaton(sequences)
    text = [rng.randint(0, 4) for _ in range(300)]
    state = length = 0
    for at, word in enumerate(text):
        state, length = automaton.step(state, length, word)
        longest = max(
            (n for n in range(at + 2) for s in sequences for k in range(len(s) - n + 1) if s[k : k + n] == text[at + 1 - n : at + 1]),
        )
        assert length == longest
        for number, end in automaton.ends[state].items():
            assert sequences[number][end - length : end] == text[at + 1 - length : at + 1]


# Secrets


def expected_spans(text):
    assign = re.compile(
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
    )
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_secret_spans(spark, empty):
    rng = random.Random(8)
    value = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    odd = [
        None, "", 'token: "token" : abcdefghi', "API_KEY='A1b2C3d4E5'", "é日 pAsSwD=  12345678 secret=short x",
        "AKIA" + "A" * 11, "AKIA" + "B7" * 8 + "AKIA", value(31), value(32) + "g" + value(40), "token=token=abcdefgh12",
        "secret\x20\x20:\x20'" + value(20) + "' AKIA" + "Z9" * 7 + " " + value(33),
    ]
    plain = ["karolomitendirsolqua", "tenkarusolmilokadirqua", "identifier_of_ordinary_words", "kasoltenruloquadirmiten"]
    texts = odd + [f"{rng.choice(plain)} token={value(24)} {rng.choice(plain)}{rng.choice(plain)}" for _ in range(80)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = 0
    for row in secrets.secret_spans(frame).collect():
        text = texts[row["doc_id"]] or ""
        base = sorted((s["start"], s["kind"], s["end"]) for kind in secrets.KINDS[:3] for s in row[kind])
        assert base == expected_spans(text)
        for span in row["random"]:
            assert not any(word in text[span["start"] : span["end"]] for word in plain)
        hits += row["doc_id"] >= len(odd) and bool(row["random"])
    assert hits >= 60
    assert secrets.secret_spans(empty).count() == 0


def test_masks_and_lists(spark):
    row = spark.createDataFrame([("abcdefghij",)], "text string").selectExpr(
        "text", "array(named_struct('start', 4, 'kind', 2, 'end', 6), named_struct('start', 1, 'kind', 0, 'end', 3), "
        "named_struct('start', 2, 'kind', 1, 'end', 5)) AS spans", "cast(array() as array<struct<start:int,kind:int,end:int>>) AS no",
    )
    from pyspark.sql import functions as F

    got = row.select(
        secrets.masked(F.col("text"), F.col("spans"), "*").alias("m"), secrets.masked(F.col("text"), F.col("no")).alias("n"),
        secrets.listed(F.col("spans")).alias("l"),
    ).first()
    assert (got["m"], got["n"], got["l"]) == ("a*ghij", "abcdefghij", "assign:1:3,access:2:5,hex:4:6")
    assert hashlib.sha256(b"").hexdigest()  # of a text without spans


def test_shards_in_shared_folders(spark, tmp_path):
    """Paths with and without a scheme are the same place, and open maps stay bounded."""
    from citedspark.llm import shards
    from citedspark.session import scratch_path

    folder = scratch_path(spark, "maps")
    assert folder.startswith("file:")  # qualified by the default file system
    for number in range(2500):
        shards.write(folder, f"a-{number}", np.array([number, number + 1], "<u8"))
    local = folder.removeprefix("file:").replace("//", "/")
    assert shards.mapped(local, "a-7", "<u8").tolist() == [7, 8]
    for turn in range(3):
        for number in range(2500):
            assert shards.kept(folder if turn else local, f"a-{number}", "<u8")[0] == number
    with open("/proc/self/maps") as maps:
        assert sum("/maps-" in line for line in maps) <= shards.MAPS
    assert shards._uri("s3a://bucket/a") == "s3://bucket/a" and shards._uri("hdfs://host:1/a") == "hdfs://host:1/a"
