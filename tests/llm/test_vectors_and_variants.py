"""Whitening, SimHash groups and spelling variants, against plain programs, through their queries."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from citedspark.llm import queries, simhash, spelling, whitening

UPPER = re.compile("[A-Z]")


def lower(text):
    return UPPER.sub(lambda m: m[0].lower(), text or "")


def components(values, radius):
    label = list(range(len(values)))

    def root(at):
        while label[at] != at:
            at = label[at]
        return at

    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= radius:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(at) for at in range(len(values))]


# --- SimHash -------------------------------------------------------------------
def fingerprint(text, width=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower(text).encode())
    size = min(width, len(words))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[at : at + size]), 42) for at in range(len(words) - size + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def near_fingerprints(rng, clusters, each):
    found = []
    for _ in range(clusters):
        middle = rng.getrandbits(64)
        for _ in range(rng.randint(1, each)):
            value = middle
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                value ^= 1 << bit
            found.append(value)
    return sorted(set(found))


def test_bit_planes():
    rng = random.Random(3)
    values = near_fingerprints(rng, 30, 25)
    array = np.array(values, np.uint64)
    for radius in (0, 1, 3, 4, 5, 7):
        near = simhash.near_lanes(array[:100], simhash.planes(array), len(array), radius)
        expected = [[bin(a ^ b).count("1") <= radius for b in values] for a in values[:100]]
        assert near.tolist() == expected
    whole, labels = simhash.in_blocks(array, None, 4)
    assert labels.tolist() == components(values, 4) and (whole == array).all()
    half = len(values) // 2
    order = [value for pair in zip(values[:half], values[half : 2 * half]) for value in pair]
    left, right = np.array(order[:half], np.uint64), np.array(order[half:], np.uint64)
    links = {(a, b) for a in order[:half] for b in order[half:] if bin(a ^ b).count("1") <= 4}
    both, labels = simhash.in_blocks(left, right, 4)
    of = dict(zip(both.tolist(), labels.tolist()))
    assert all(of[a] == of[b] for a, b in links) and len(set(of.values())) < len(of)
    groups = np.arange(len(values)) // 40
    labels = simhash.side_by_side(array, groups, 4)
    for group in set(groups.tolist()):
        own = np.flatnonzero(groups == group)
        assert (labels[own] - own[0]).tolist() == components([values[at] for at in own], 4)


def test_linked_fingerprints(spark, monkeypatch):
    """Buckets of more than a block, of more than a side, and of a few, lose no link."""
    rng = random.Random(4)
    middle = rng.getrandbits(64)
    hot = {middle ^ sum(1 << bit for bit in rng.sample(range(20), rng.randint(0, 5))) for _ in range(400)}
    values = sorted(hot | set(near_fingerprints(rng, 60, 12)))
    monkeypatch.setattr(simhash, "BLOCK", 100)
    signed = [(value - (1 << 64) if value >> 63 else value,) for value in values]
    links = simhash.linked(spark.createDataFrame(signed, "fingerprint long").repartition(3)).collect()
    label = {value: value for value, in signed}

    def root(value):
        while label[value] != value:
            value = label[value]
        return value

    for a, b in links:
        label[root(a)] = root(b)
    expected = components(values, 4)
    groups = collections.defaultdict(set)
    for (value,), group in zip(signed, expected):
        groups[group].add(root(value))
    assert all(len(found) == 1 for found in groups.values())
    assert len({root(value) for value, in signed}) == len(groups)
    with pytest.raises(ValueError):
        simhash.linked(spark.createDataFrame([], "fingerprint long"), radius=8)


def test_simhash_query(spark, documents, texts, tmp_path):
    long_text = " ".join(f"w{at % 977}" for at in range(200_000))
    more = spark.createDataFrame(
        [(900, long_text), (901, long_text + " end"), (902, "One two"), (903, "one\ttwo"), (904, "\x1c a"), (905, None)],
        "doc_id long, text string",
    )
    all_ = documents.unionByName(more, allowMissingColumns=True)
    all_.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op13_simhash_dedup(spark, str(tmp_path)).collect()
    own = [(row["doc_id"], fingerprint(row["text"])) for row in all_.collect()]
    named = [(doc, value) for doc, value in own if doc is not None]
    values = sorted({value for _, value in named})
    group = dict(zip(values, components(values, 4)))
    least = collections.defaultdict(lambda: 1 << 60)
    for doc, value in named:
        least[group[value]] = min(least[group[value]], doc)
    expected = [(doc, f"{value:016x}", None if doc is None else least[group[value]]) for doc, value in own]
    assert collections.Counter(map(tuple, rows)) == collections.Counter(expected)
    assert rows[0].asDict().keys() == {"doc_id", "fingerprint", "component_id"}


def test_simhash_of_nothing(spark, empty):
    assert simhash.near_duplicates(empty).collect() == []


# --- spelling ------------------------------------------------------------------
def edits(word, alphabet):
    for at in range(len(word) + 1):
        for char in alphabet:
            yield word[:at] + char + word[at:]
            yield word[:at] + char + word[at + 1 :]
        yield word[:at] + word[at + 1 :]


def plain_variants(rows, shortest=5, least=3):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text)):
            hashed = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = hashed % len(run)
            counts[run[:at] + run[at + 1 :] if hashed % 97 == 0 else run] += 1
    words = {word: n for word, n in counts.items() if len(word) >= shortest and n >= least}
    alphabet = sorted(set("".join(words)))
    near = {word: {other for other in edits(word, alphabet) if other in words and other != word} for word in words}
    form = {}
    for word, n in words.items():
        best = min(near[word], key=lambda other: (-words[other], other), default=None)
        form[word] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for word, n in words.items():
        root = word
        while form[root]:
            root = form[root]
        out[word] = (form[word], root, n, len(near[word]), words.get(form[word]))
    return out


def typed(rng, word):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("aeé") + word[at:], word[:at] + "o" + word[at + 1 :]])


def test_spelling_query(spark, documents, tmp_path):
    rng = random.Random(9)
    base = ["".join(rng.choice(["ka", "lo", "é", "ß", "mi", "t"]) for _ in range(rng.randint(2, 7))) for _ in range(120)]
    texts = []
    for _ in range(60):
        own = [rng.choice(base[: rng.randint(5, 120)]) for _ in range(120)]
        texts.append(" ".join(typed(rng, word).capitalize() if rng.random() < 0.3 else word for word in own))
    long_word = "lo" * 40_000
    texts += [f"{long_word} {long_word}s {long_word}", f"{long_word}-{long_word}S {long_word}s", "÷×÷×÷ ÷×÷×÷ ÷×÷×÷a", "ab12cd__xyzxyĀxyzxy xyzxy"]
    more = spark.createDataFrame([(300 + at, text) for at, text in enumerate(texts)], "doc_id long, text string")
    all_ = documents.unionByName(more, allowMissingColumns=True).repartition(5)
    all_.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_spelling_variants(spark, str(tmp_path)).collect()
    expected = plain_variants([(row["doc_id"], row["text"]) for row in all_.collect() if len(row["text"] or "") < 50_000])
    long_ones = {row["word"]: row for row in found if len(row["word"]) > 1000}
    short = {row["word"]: (row["form"], row["root"], row["n"], row["n_near"], row["form_n"]) for row in found if len(row["word"]) <= 1000}
    assert short == expected and len(found) == len(short) + len(long_ones)
    assert sum(value[0] is not None for value in expected.values()) > 20
    assert {len(word): row["n_near"] for word, row in long_ones.items()} == {80_000: 1, 80_001: 1}


def test_lists_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))): rng.randint(1, 30) for _ in range(500)}
    monkeypatch.setattr(spelling, "BLOCK", 20)
    monkeypatch.setattr(spelling, "QUERIES", 7)
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    found = {row["word"]: tuple(row)[1:] for row in spelling.near_words(frame).collect()}
    for word in words:
        near = {other for other in edits(word, "abc") if other in words and other != word}
        best = min(near, key=lambda other: (-words[other], other), default=None)
        assert found.get(word) == (None if best is None else (len(near), words[best], best)), word


def test_roots(spark):
    chain = [(f"w{at}", f"w{at + 1}") for at in range(20)] + [("x", "w3"), ("y", "z")]
    found = {row["word"]: row["root"] for row in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert found == {word: "z" if word == "y" else "w20" for word, _ in chain}


def test_spelling_of_nothing(spark, empty):
    assert spelling.variants(empty).collect() == []


# --- whitening -----------------------------------------------------------------
SCHEMA = "vec_id long, embedding array<{}>, n long, whitened string, row string"


def plain_whitening(vectors, components):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    deviation = ((n * x - total) ** 2).sum(axis=1)
    centred = (n * x - total) / n
    covariance = centred.T @ centred / n
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    return deviation, centred @ basis / np.sqrt(values), values / np.trace(covariance), n


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitening_query(spark, tmp_path, kind):
    rng = np.random.default_rng(6)
    spread = rng.standard_normal((40, 40)) / 6
    vectors = (rng.standard_normal((300, 40)) @ spread + 0.2).astype("f4" if kind == "float" else "f8").tolist()
    rows = [(at, vector, 1, "w", "r") for at, vector in enumerate(vectors)]
    wrong = [None, [], [None] * 40, [*vectors[0][:-1], float("nan")], [*vectors[0][:-1], float("inf")], vectors[0][:-1]]
    rows += [(1000 + at, vector, None, None, None) for at, vector in enumerate(wrong)]
    rows += [(7, vectors[8], None, None, None), (None, vectors[9], None, None, None), (999, [0.0] * 40, None, None, None)]
    spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op12_embedding_whitening(spark, str(tmp_path)).toPandas()
    kept = [(at, vector) for at, vector in enumerate(vectors)] + [(7, vectors[8]), (None, vectors[9]), (999, [0.0] * 40)]
    deviation, white, explained, n = plain_whitening([vector for _, vector in kept], 32)
    assert len(found) == 32 * n and set(found["n"]) == {n}
    assert found["identity_error"].nunique() == 1 and found["identity_error"].max() < 1e-9
    table = found[found["vec_id"].isin(range(300)) & (found["vec_id"] != 7)]
    got = table.pivot(index="vec_id", columns="component", values="whitened")
    order = [at for at in range(300) if at != 7]
    signs = np.sign((got.loc[order].to_numpy() * white[order]).sum(axis=0))
    assert np.abs(got.loc[order].to_numpy() * signs - white[order]).max() < 1e-8
    assert np.abs(table.groupby("component")["explained"].first().to_numpy() - explained).max() < 1e-12
    assert table.groupby("vec_id")["deviation"].first().loc[order].tolist() == deviation[order].tolist()
    assert sorted(found.loc[found["vec_id"] == 7, "deviation"].unique()) == sorted({deviation[7], deviation[300]})


def test_no_variance(spark):
    assert whitening.whitened(spark.createDataFrame([], SCHEMA.format("float"))).collect() == []
    same = spark.createDataFrame([(at, [1.0, 2.0], 1, None, None) for at in range(5)], SCHEMA.format("double"))
    assert whitening.whitened(same).collect() == []
    line = [(at, [float(at), 1.0, -float(at)], None, None, None) for at in range(9)]
    rows = whitening.whitened(spark.createDataFrame(line, SCHEMA.format("float"))).collect()
    assert [len(row["whitened"]) for row in rows] == [1] * 9 and rows[0]["identity_error"] < 1e-9
    assert abs(rows[0]["explained"][0] - 1) < 1e-12


def test_exact_deviations():
    mean = whitening.Moments(10**9, [10**18 + 3, 5])
    values = np.array([[10**9 + 2**40, 0], [10**9, 1]])
    n, sums = mean.n, mean.sums
    exact = [sum((n * int(x) - s) ** 2 for x, s in zip(row, sums)) for row in values]
    assert mean.deviations(values) == [value if value < 1 << 63 else None for value in exact]


@pytest.mark.parametrize("size,wanted", [(5, 32), (64, 32), (300, 20)])
def test_jacobi_davidson(size, wanted):
    rng = np.random.default_rng(size)
    basis = np.linalg.qr(rng.standard_normal((size, size)))[0]
    values = np.sort(rng.random(size) + 0.01)[::-1]
    values[2] = values[1]  # a repeated eigenvalue
    matrix = (basis * values) @ basis.T
    found, vectors = whitening.leading_pairs(lambda block: matrix @ block, size, wanted)
    count = min(size, wanted)
    assert np.abs(found - values[:count]).max() < 1e-12
    assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(count)).max() < 1e-12


def test_minres_solves():
    rng = np.random.default_rng(1)
    matrix = rng.standard_normal((12, 12))
    matrix = matrix + matrix.T
    basis = np.linalg.qr(rng.standard_normal((12, 2)))[0]
    outside = np.eye(12) - basis @ basis.T
    right = outside @ rng.standard_normal((12, 3))
    shifts = np.array([0.1, -0.4, 0.7])
    found = whitening.minres(lambda block: matrix @ block, shifts, basis, right, 60)
    for at, shift in enumerate(shifts):
        rest = outside @ (matrix - shift * np.eye(12)) @ outside @ found[:, at] - right[:, at]
        assert np.linalg.norm(rest) <= 0.06 * np.linalg.norm(right[:, at])


def test_hexadecimal(spark):
    rows = spark.createDataFrame([(0,), (-1,), (255,)], "f long").select(simhash.hexadecimal(F.col("f")).alias("x")).collect()
    assert [row["x"] for row in rows] == ["0" * 16, "f" * 16, "00000000000000ff"]
