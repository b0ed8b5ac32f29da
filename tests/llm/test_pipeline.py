"""The pipeline's stages on planted documents, each judged on its own input."""

import random
import re

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from citedspark.llm.byte_bpe import ByteBpe

CLEAN = [f"{a}{b}" for a in ("gar", "riv", "let", "win", "mus", "pap", "sto", "sum") for b in ("den", "er", "ter", "dow", "ic", "ne", "mer", "ly")]
BAD = ("nasty", "rotten", "vile")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    text = lambda n: " ".join(rng.choice(CLEAN) for _ in range(n))
    item = text(30)
    docs, labels = {}, []
    for k in range(400):
        words = text(rng.randint(30, 60)).split()
        if k % 6 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs[k] = " ".join(words)
        labels.append((k, 1, int(k % 6 == 0)))
    docs[500] = docs[501] = text(60)
    docs[502] = docs[500].replace(docs[500].split()[30], "changed", 1)
    docs[503] = f"{text(5)} {item} {text(5)}"
    docs[504] = f"{text(200)} {' '.join(item.split()[:13])} {text(200)}"  # under a twentieth
    docs[505] = f"{text(30)} password=0123abcd0123 {text(10)}"
    docs[506] = f"{text(20)} v1le {text(10)}"
    rows = [(i, t, "en", "src", len(t)) for i, t in docs.items()]
    rows += [(600, None, None, None, None), (601, "", "en", None, 0), (None, text(20), "en", None, 1), (500, docs[500], "en", "src", 1)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[at : at + 5]) for at in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark, folder):
    path, texts = folder
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["toxicity"](spark, docs, path).cache()
    found = [row["doc_id"] for row in kept.collect()]
    toxic = {k for k in range(0, 400, 6)} | {506}
    assert kept.columns == columns
    assert len(toxic - set(found)) >= 0.97 * len(toxic)
    assert len(set(texts) - toxic - set(found)) <= 2 and {600, 601, None} <= set(found)

    single = stage["minhash near-dedup"](spark, kept, path).cache()
    rows = single.collect()
    ids = [row["doc_id"] for row in rows]
    sets = {i: shingles(texts[i]) for i in found if i in texts}
    for i, own in sets.items():  # each document that went has a near copy of a smaller id
        if i not in ids:
            assert any(j < i and 100 * len(own & other) >= 80 * len(own | other) for j, other in sets.items())
    assert 500 in ids and 501 not in ids and 502 not in ids and ids.count(500) == 1
    assert {600, 601, None} <= set(ids) and single.columns == columns

    clean = stage["benchmark decontamination"](spark, single, path).cache()
    assert set(ids) - {row["doc_id"] for row in clean.collect()} == {503} and clean.columns == columns

    masked = stage["secret scans"](spark, clean, path).cache()
    by_id = {row["doc_id"]: row for row in masked.collect()}
    assert len(by_id) == clean.count() and masked.columns == columns
    assert by_id[505]["text"] == texts[505].replace("password=0123abcd0123", "[SECRET]")
    assert by_id[505]["n_chars"] == len(by_id[505]["text"]) and by_id[600]["text"] is None
    assert all(row["text"] == texts[i] for i, row in by_id.items() if i in texts and i != 505)

    coded = {row["doc_id"]: row for row in stage["byte-level BPE"](spark, masked, path).collect()}
    bpe = ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    import hashlib

    import regex

    for i, row in coded.items():
        text = by_id[i]["text"] or ""
        ids = b"".join(bpe.encode_pieces(regex.findall(public_tokenizers.PATTERN, text)))
        assert row["n_tokens"] == len(np.frombuffer(ids, "<u4"))
        assert row["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_run_is_the_last_stage(spark, folder):
    path, _ = folder
    result = corpus_pipeline.run(spark, path)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert result.count() > 250


def test_near_dedup_judges_repeated_ids_by_row(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(CLEAN) for _ in range(60))
    first, other, third, fourth = text(), text(), text(), text()
    near = third.replace(third.split()[30], "changed", 1)
    rows = [(1, first), (2, first), (2, other), (3, None), (3, third), (4, fourth), (4, fourth), (5, third), (5, near), (None, first)]
    rows += [(6, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert found == sorted([(1, first), (2, other), (3, None), (3, third), (4, fourth), (None, first)], key=str)


@pytest.mark.parametrize("budget", [1 << 20, 60])
def test_decontamination_by_items_without_id(spark, tmp_path, budget, monkeypatch):
    from citedspark.llm import fm_index

    monkeypatch.setattr(fm_index, "PHRASE_BYTES", budget)
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(CLEAN) for _ in range(n))
    item, named = text(20), text(20)
    spark.createDataFrame([(None, item), (1, named), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"{text(9)} {item}"), (2, named), (3, text(40)), (4, None)], "doc_id long, text string")
    assert sorted(row["doc_id"] for row in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()) == [3, 4]
    found = fm_index.searched_rows(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert {row["row"]["doc_id"]: row["items"] for row in found.collect()} == {1: [], 2: ["1"], 3: [], 4: []}


def test_stages_of_nothing_and_of_clashing_columns(spark, folder):
    """Every stage takes an empty table, and columns named as the operators name theirs, maps among them."""
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr(
        "*", "doc_id AS class", "text AS row", "map('k', doc_id) AS score", "array(text) AS spans", "1 AS bucket", "'g' AS `group`",
        "2 AS place", "true AS kept", "array('i') AS items", "0 AS n_words",
    )
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, docs.limit(0), path)
        assert nothing.collect() == [], name
        after = stage(spark, docs, path)
        if name != "byte-level BPE":
            assert after.columns == docs.columns == nothing.columns and dict(after.dtypes) == dict(docs.dtypes), name
            assert after.where("row IS DISTINCT FROM text AND text NOT LIKE '%[SECRET]%'").count() == 0
            kept = {row["doc_id"] for row in after.collect()}
            assert len(kept) > 300, name
