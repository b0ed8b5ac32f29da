"""Operators that look at all texts together, against plain programs."""

import collections
import math
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citedspark.llm import block_join, bwt_merge, kneser_ney, minhash, noisy_channel, warc
from citedspark.llm.components import components
from citedspark.session import scratch_path


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, width):
    own = words(text)
    return {tuple(own[at : at + width]) for at in range(max(1, len(own) - width + 1))} if own else set()


def joined(pairs, nodes):
    parent = {node: node for node in nodes}

    def root(node):
        while parent[node] != node:
            node = parent[node]
        return node

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {node: root(node) for node in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(-50, 200), rng.randint(-50, 200)) for _ in range(120)] + [(900 + k, 901 + k) for k in range(40)] + [(7, 7)]
    expected = joined(pairs, {node for pair in pairs for node in pair})
    frame = spark.createDataFrame(pairs, "p long, q long").repartition(3)
    assert {row["node"]: row["root"] for row in components(frame, "p", "q").collect()} == expected
    assert components(frame.where("p IS NULL"), "p", "q").count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(documents, texts, width):
    sets = {100 + at: shingles(text, width) for at, text in enumerate(texts)}
    pairs = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    expected = joined(pairs, sets)
    assert len(set(expected.values())) < len(sets)
    rows = minhash.near_duplicates(documents, width).collect()
    assert len(rows) == documents.count()
    for row in rows:
        if row["doc_id"] is None:
            assert row["component_id"] is None and not row["kept"]
            continue
        assert row["n_shingles"] == len(sets[row["doc_id"]])
        assert row["component_id"] == expected[row["doc_id"]]
        assert row["kept"] == (row["doc_id"] == row["component_id"])


def test_near_duplicates_of_a_family(spark):
    """A large group of near copies that differ from one another by more than from their middle."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
    texts = []
    for _ in range(70):
        own = list(base)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(60)] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(own))
    sets = {at: shingles(text, 2) for at, text in enumerate(texts)}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {row["doc_id"]: row["component_id"] for row in minhash.near_duplicates(frame, 2).collect()}
    assert got == joined(pairs, sets)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for size in (3, 40, 400):
        left = rng.integers(0, 2**63, size, dtype=np.uint64)
        right = left.copy()
        right[: size // 3] = rng.integers(0, 2**63, size // 3, dtype=np.uint64)
        rows = np.repeat([0, 2], size)
        found = minhash.super_minhash(rows, np.concatenate([left, right]), 3, 256)
        same = (size - size // 3) / (size + size // 3)
        assert abs((found[0] == found[2]).mean() - same) < 0.12
        assert np.isinf(found[1]).all()


@pytest.mark.parametrize("hot", [1000, 2])
def test_repeats_removed(documents, empty, texts, hot):
    _check_repeats(documents, texts, hot)
    assert bwt_merge.repeats_removed(empty).count() == 0


def test_repeats_around_a_common_passage(spark):
    """Many contents share the anchors of a passage, so they are cut, at last to single strings."""
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdef ") for _ in range(230))
    texts = ["".join(rng.choice("xyz ") for _ in range(rng.randint(0, 260))) + passage + "".join(rng.choice("uvw ") for _ in range(150)) for _ in range(400)]
    texts += [passage[:199], passage[5:] + "q", "z" + passage[20:220]]
    frame = spark.createDataFrame([(100 + at, text) for at, text in enumerate(texts)], "doc_id long, text string")
    _check_repeats(frame, texts, 300, extra=0)


def _check_repeats(documents, texts, hot, extra=2):
    raw = [(text or "").encode() for text in texts] + [texts[0].encode()] * extra
    count = collections.Counter(text[at : at + 200] for text in raw for at in range(len(text) - 199))
    for row in bwt_merge.repeats_removed(documents, hot).collect():
        text = (texts[row["doc_id"] - 100] if row["doc_id"] is not None else texts[0]) or ""
        data = text.encode()
        covered = np.zeros(len(data), bool)
        for at in range(len(data) - 199):
            if count[data[at : at + 200]] > 1:
                covered[at : at + 200] = True
        mine = np.zeros(len(data), bool)
        for span in row["spans"]:
            mine[span["start"] : span["end"]] = True
        assert row["n_bytes"] == len(data) and (mine == covered).all()
        assert bytes(row["kept"]) == bytes(np.frombuffer(data, np.uint8)[~covered])
        assert len(row["spans"]) == int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())


def test_merged_intervals_over_shards(monkeypatch):
    monkeypatch.setattr(bwt_merge, "SHARD", 700)
    rng = random.Random(6)
    pool = [bytes(rng.choice(b"ab") for _ in range(150)) for _ in range(4)]
    parts = [b"".join(rng.choice(pool) for _ in range(3))[rng.randint(0, 9) :] for _ in range(12)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(part) for part in parts])
    starts = ends - [len(part) for part in parts]
    row, group = bwt_merge.merged_intervals(data, starts, ends)
    sizes = ends - starts + 1
    base = np.cumsum(sizes) - sizes
    strings = collections.defaultdict(set)
    for r, g in zip(row.tolist(), group.tolist(), strict=True):
        segment = int(np.searchsorted(base, r, side="right")) - 1
        at = r - int(base[segment])
        strings[g].add(parts[segment][at : at + 200])
    assert all(len(own) == 1 for own in strings.values())
    assert len({next(iter(own)) for own in strings.values()}) == len(strings)
    assert len(row) == sum(len(part) - 199 for part in parts)


def plain_kneser_ney(training, asked):
    unigrams, bigrams = collections.Counter(), collections.Counter()
    for own in training:
        unigrams.update(own)
        bigrams.update(zip(["<s>", *own[:-1]], own, strict=True))
    total, distinct = sum(unigrams.values()), len(unigrams)
    unigrams["<s>"] = len(training)
    left, followers = collections.Counter(v for _, v in bigrams), collections.defaultdict(lambda: [0, 0, 0])
    for (u, _), n in bigrams.items():
        followers[u][min(n, 3) - 1] += 1
    seen = lambda counts: [sum(1 for n in counts if n == k) for k in (1, 2, 3, 4)]
    d2, d1 = kneser_ney.discounts(seen(bigrams.values())), kneser_ney.discounts(seen(left.values()))
    rest = sum(d1[min(n, 3)] for n in left.values()) / len(bigrams) / (distinct + 1)
    out = []
    for own in asked:
        score = base = 0.0
        for u, v in zip(["<s>", *own[:-1]], own, strict=True):
            lower = rest + max(left[v] - d1[min(left[v], 3)], 0) / len(bigrams)
            gamma = sum(d2[k + 1] * followers[u][k] for k in range(3)) / unigrams[u] if u in followers else 1.0
            n = bigrams.get((u, v), 0)
            score += math.log10((max(n - d2[min(n, 3)], 0) / unigrams[u] if n else 0.0) + gamma * lower)
            base += math.log10(((unigrams[v] if v != "<s>" else 0) + 0.5) / (total + 0.5 * (distinct + 1)))
        out.append((len(own), sum(v in unigrams for v in own), total, base, score))
    return out


def test_kneser_ney(documents, empty, texts):
    training = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True))
    ids = [100 + at for at in range(len(texts))] + [None, 100]
    rows = [(i, [*words(texts[i - 100] if i is not None else texts[0]), None]) for i in ids]
    expected = plain_kneser_ney([own for i, own in rows if i is None or i % 5 != 1], [own for _, own in rows])
    wanted = {i: values for (i, _), values in zip(rows, expected, strict=True)}
    found = kneser_ney.scored(documents, training).collect()
    assert len(found) == len(rows)
    for row in found:
        n, known, total, base, score = wanted[row["doc_id"]]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (n, known, total)
        assert row["base_score"] == pytest.approx(base) and row["score"] == pytest.approx(score)
    assert kneser_ney.scored(empty, training).count() == 0


def plain_kneser_ney_of(order, training, asked):
    """By dictionaries: counts at the top; below, left neighbours, or counts at the beginning of a text."""
    padded = lambda own: ["<s>", *own]
    counts = {n: collections.Counter() for n in range(1, order + 1)}
    for own in training:
        text = padded(own)
        counts[order].update(tuple(text[at : at + order]) for at in range(len(text) - order + 1))
        for n in range(2, min(order, len(text) + 1)):
            counts[n][tuple(text[:n])] += 1
    for n in range(order, 1, -1):
        counts[n - 1].update(gram[1:] for gram in counts[n])
    vocabulary = {word for own in training for word in own}
    seen = lambda own: [sum(1 for n in own.values() if n == k) for k in (1, 2, 3, 4)]
    cut = {n: kneser_ney.discounts(seen(own)) for n, own in counts.items()}
    totals, spent = collections.Counter(), collections.Counter()
    for n, own in counts.items():
        for gram, times in own.items():
            totals[n, gram[:-1]] += times
            spent[n, gram[:-1]] += cut[n][min(times, 3)]
    def chance(context, word):
        if not context:
            rest = spent[1, ()] / totals[1, ()] / (len(vocabulary) + 1)
            return rest + max(counts[1][word,] - cut[1][min(counts[1][word,], 3)], 0) / totals[1, ()]
        n = len(context) + 1
        if not totals[n, context]:
            return chance(context[1:], word)
        times = counts[n][*context, word]
        own = max(times - cut[n][min(times, 3)], 0)
        return (own + spent[n, context] * chance(context[1:], word)) / totals[n, context]
    return [
        sum(math.log10(chance(tuple(padded(own)[max(0, at + 2 - order) : at + 1]), word)) for at, word in enumerate(own)) for own in asked
    ]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_of_an_order(spark, documents, texts, order):
    rng = random.Random(order)
    extra = [(1000 + k, " ".join(rng.choice(["the", "of", "a", "x", "y"]) for _ in range(30))) for k in range(40)]
    frame = documents.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).repartition(4)
    rows = [(row["doc_id"], [*words(row["text"]), None]) for row in frame.collect()]
    expected = plain_kneser_ney_of(order, [own for i, own in rows if i is None or i % 5 != 1], [own for _, own in rows])
    wanted = {i: score for (i, _), score in zip(rows, expected, strict=True)}
    found = kneser_ney.scored(frame, F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True)), order).collect()
    assert len(found) == len(rows)
    for row in found:
        assert row["score"] == pytest.approx(wanted[row["doc_id"]])


def test_kneser_ney_sizes(spark):
    """What tasks send and write for an n-gram is far below its three words of 48 bits and a hash of 64."""
    rng = np.random.default_rng(8)
    names = rng.integers(0, 2**48, 4000, dtype=np.uint64)
    text = names[np.minimum(rng.zipf(1.3, 60_000), len(names)) - 1]
    grams = [text[:-2], text[1:-1], text[2:]]
    keys, counts, at = kneser_ney._summed(kneser_ney._keys(grams, names[:0])[0][-1], np.ones(len(text) - 2, np.int64))
    sent = kneser_ney._rows(2, [word[at] for word in grams], keys, counts)
    assert sum(column.nbytes for column in sent.columns) < 8 * len(keys)  # 22 as plain arrays
    back = kneser_ney._unpacked(sent, 3)
    n = np.concatenate([kneser_ney._restored(data, np.uint32) for data in sent.column("n").to_pylist()])
    assert sorted(zip(*back, n, strict=True)) == sorted(zip(*[word[at] for word in grams], counts, strict=True))

    folder = scratch_path(spark, "kn-sizes")
    kneser_ney._write_known(folder, "grams3", 0, keys, counts[:, None], (1,))
    written = sum(file.stat().st_size for file in Path(folder.removeprefix("file:")).iterdir())
    assert written < 6.5 * len(keys)  # 8 for a hash, 12 with its count
    scorer = kneser_ney.Scorer(kneser_ney.Model(folder, 1, names[:0], 1, 1, [[0] * 5] * 3))
    asked = np.concatenate([keys, keys + np.uint64(1), keys[:3] - np.uint64(1), [np.uint64(0)]])
    known = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    assert scorer.grams(3, asked)[:, 0].tolist() == [known.get(key, 0) for key in asked.tolist()]
    assert counts.max() > 255


def test_kneser_ney_probabilities_add_up(spark, texts):
    """Over all words and an unknown one, the model's probabilities after a word sum to one."""
    frame = spark.createDataFrame([(k, text) for k, text in enumerate(texts[:6])], "doc_id long, text string")
    model = kneser_ney.trained(frame, scratch_path(spark, "kn-test"))
    vocabulary = sorted({word for text in texts[:6] for word in words(text)})
    first = vocabulary[3]
    asked = spark.createDataFrame([(k, f"{first} {word}") for k, word in enumerate([*vocabulary, "unknown"])], "doc_id long, text string")
    prefix = spark.createDataFrame([(0, first)], "doc_id long, text string")
    scorer = kneser_ney.Scorer(model)

    def token_scores(frame):
        out = []
        for row in frame.orderBy("doc_id").collect():
            batch = pa.table({"doc_id": [row["doc_id"]], "text": [row["text"]]}).to_batches()[0]
            tokens, edge = kneser_ney._tokens(batch)
            single = [scorer.scored(tokens[:n], np.array([0, n]))[2][0] for n in range(1, len(tokens) + 1)]
            out.append(np.diff([0.0, *single]))
        return out

    after = [10 ** scores[1] for scores in token_scores(asked)]
    end = 10 ** token_scores(prefix)[0][1]
    assert sum(after) + end == pytest.approx(1.0, abs=1e-6)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_block_join(spark, kind):
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=8).astype("float32" if kind == "float" else "float64").tolist()) for k in range(90)]
    rows += [(200 + k, rows[3][1]) for k in range(30)]  # ties
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8), (304, [float("inf")] + [1.0] * 7), (305, []), (None, rows[0][1])]
    rows += [(306, [1.0, 2.0, 3.0]), (310, [2.0, 1.0, 0.5]), (20, rows[20][1])]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    good = {i: np.array(v, "float64") for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    expected = []
    for query in (i for i in good if i % 10 == 0):
        others = [(float(np.cumsum(good[query] * v)[-1]), -i) for i, v in good.items() if i != query and len(v) == len(good[query])]
        expected += [(query, rank, -i, score) for rank, (score, i) in enumerate(sorted(others, reverse=True)[:7], 1)]
    found = block_join.nearest(frame, F.col("vec_id") % 10 == 0, 7)
    assert sorted(tuple(row) for row in found.collect()) == sorted(expected)
    assert block_join.nearest(frame.where("vec_id < 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_toxicity_on_held_out_rows(spark, empty):
    rng = random.Random(3)
    clean = ["garden", "river", "the", "of", "letter", "window", "music", "paper", "stone", "and", "summer", "road"]
    bad = ["nasty", "rotten", "vile"]
    disguises = [lambda w: w, lambda w: w.replace("a", "4"), lambda w: w.replace("i", "1"), lambda w: w[0] + w[1] * 4 + w[2:], " ".join]
    rows, labels = [], []
    for k in range(1500):
        own = [rng.choice(clean) for _ in range(rng.randint(5, 40))]
        toxic = k % 5 == 0
        for _ in range(2 if toxic else 0):
            own.insert(rng.randrange(len(own)), rng.choice(disguises)(rng.choice(bad)))
        rows.append((k, " ".join(own)))
        labels.append((k, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "a vile thing")]
    labels += [(0, None), (None, 1), (1, 0), (9999, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = noisy_channel.toxicity(frame, marks).withColumn("held", noisy_channel.fold("doc_id") == 0).collect()
    assert len(found) == len(rows)
    held = [row for row in found if row["held"] and row["doc_id"] < 1500]
    assert sum((row["score"] >= 0.5) == (row["doc_id"] % 5 == 0) for row in held) >= 0.97 * len(held)
    assert all(0 <= row["score"] <= 1 for row in found)
    assert noisy_channel.toxicity(empty, marks).count() == 0
    unmarked = noisy_channel.toxicity(frame, marks.where("toxic > 1"))
    assert unmarked.where("score >= 0.5").count() == 0


def test_warc_derivatives(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.example/x", "<html><title>T&amp;U</title><script>var a='<p>'</script><p>One<b>two</b><br>three<!-- no --></p></html>"),
            (2, None, None), (3, "http://a.example/\r\nEvil: 1", ""), (None, "u", "é<p>日"), (1, "http://a.example/x", "again"),
        ],
        "page_id long, url string, html string",
    )
    records = warc.responses(pages)
    bad = spark.createDataFrame([(8, bytearray(b"no record")), (9, None), (10, bytearray(warc.written([("WARC-Type", "request")], b"GET")))], "page_id long, record binary")
    rows = warc.derived(records.union(bad)).collect()
    assert len(rows) == 2 * 5 + 3
    sources = {warc.read(bytes(row["record"]))[0]["warc-record-id"]: bytes(row["record"]) for row in records.collect()}
    for row in rows:
        if row["page_id"] in (8, 9, 10):
            assert row["problem"] and row["record"] is None
            continue
        headers, block = warc.read(bytes(row["record"]))
        source, message = warc.read(sources[row["refers_to"]])
        assert headers["warc-refers-to"] == source["warc-record-id"] and headers["warc-type"] == row["kind"]
        assert headers["warc-block-digest"] == warc.digest(block) == row["block_digest"]
        assert headers.get("warc-target-uri") == source.get("warc-target-uri")
        assert row["payload_digest"] == source["warc-payload-digest"] == warc.digest(message.partition(b"\r\n\r\n")[2])
        assert block == bytes(row["block"])
    text = {(row["page_id"], bytes(row["block"]).decode()) for row in rows if row["kind"] == "conversion"}
    assert {(1, "T&U\nOnetwo\nthree"), (2, ""), (3, ""), (None, "é\n日"), (1, "again")} == text
    about = next(bytes(row["block"]).decode() for row in rows if row["page_id"] == 1 and row["kind"] == "metadata")
    assert "http-header: Content-Type: text/html; charset=utf-8" in about and "payload-digest-agrees: true" in about
    assert warc.derived(records.where("page_id > 99")).count() == 0


@pytest.mark.parametrize(
    ("written", "meant"),
    [
        ("i d 1 o t", "idiot"), ("1 d ! o t", "idiot"), ("v 1 l e", "vile"), ("v - i - l - e", "vile"), ("v i i l e", "vile"),
        ("a v i l e person", "vile"), ("$#1+", "shit"), ("455", "ass"), ("viile", "vile"), ("na st y", "nasty"), ("n a st y", "nasty"),
        ("na s7 y", "nasty"), ("$ h 1 +", "shit"), ("\u00e9 v i l", "\u00e9vil"),
    ],
)
def test_readings_of_mixed_forms(spark, written, meant):
    """Words of signs, spelled words with signs, doubled letters and fragments are read, with their boundaries."""
    rng = random.Random(4)
    plain = ["a", "person", "the", "of", "is", "garden", "vile", "idiot", "nasty", "shit", "assume", "ass", "hit", "list", "evil", "\u00e9vil"]
    corpus = [(k, " ".join(rng.choice(plain) for _ in range(40))) for k in range(60)]
    model = noisy_channel.character_model(spark.createDataFrame(corpus, "doc_id long, text string"))
    for text in (written, f"the garden {written} garden", f"{written}. garden"):
        found = noisy_channel.RestoredWords(pa.array([text, meant]), noisy_channel.Restorer(model))
        own = set(found.features()[found.rows == 0, 0].tolist())
        assert set(found.features()[found.rows == 1, 0].tolist()) <= own


def test_toxicity_of_mixed_forms(spark):
    rng = random.Random(6)
    clean = ["garden", "river", "the", "of", "letter", "window", "music", "paper", "stone", "and", "a", "road"]
    clean += [f"{a}{b}" for a in ("gar", "riv", "let", "win", "mus") for b in ("den", "er", "ter", "dow", "ic")]
    rows = []
    for k in range(600):
        own = [rng.choice(clean) for _ in range(20)]
        if k % 4 == 0:
            own.insert(rng.randrange(20), rng.choice(["idiot", "vile", "nasty"]))
        rows.append((k, " ".join(own)))
    forms = ["i d 1 o t", "1d10+", "viile", "na st y", "a v i l e person", "n 4 s t y", "v 1 1 l e"]
    asked = [(1000 + k, f"the garden of music {form} and the river") for k, form in enumerate(forms)]
    calm = [(2000, "a river of 1 9 8 4 and the 2024 road"), (2001, "of a letter")]
    frame = spark.createDataFrame(rows + asked + calm, "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)], "doc_id long, toxic int")
    found = {row["doc_id"]: row["score"] for row in noisy_channel.toxicity(frame, marks).collect()}
    assert [form for k, form in enumerate(forms) if found[1000 + k] < 0.5] == []
    assert found[2000] < 0.5 and found[2001] < 0.5


def test_decoding_is_exact():
    """No path through the lattice is likelier than the one decoded, however late a letter favours it."""
    import itertools

    rng = np.random.default_rng(12)
    model = np.log(rng.dirichlet(np.full(noisy_channel.SYMBOLS, 0.05), (noisy_channel.SYMBOLS,) * 2) + 1e-9).astype(np.float32)
    restorer = noisy_channel.Restorer(model)

    def likelihood(text, cost):
        symbols = [0, 0, *(int(noisy_channel._SYMBOL[letter]) for letter in text), 0]
        return cost + sum(float(model[tuple(symbols[at : at + 3])]) for at in range(len(symbols) - 2))

    for word in (b"*x*1", b"*a*1b*", b"1*1*k", b"*|*1"):
        runs = [(byte, len(list(own))) for byte, own in itertools.groupby(word)]
        paths = itertools.product(*(restorer._choices(byte, length, False) for byte, length in runs))
        best = max(likelihood(b"".join(part for part, _ in path), sum(cost for _, cost in path)) for path in paths)
        text = restorer.restored(word)
        again = itertools.product(*(restorer._choices(byte, length, False) for byte, length in runs))
        own = max(likelihood(text, sum(c for _, c in path)) for path in again if b"".join(p for p, _ in path) == text)
        assert own == pytest.approx(best)
