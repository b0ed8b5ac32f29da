"""A range of n-grams is counted in shares, so memory does not follow the size of a split of the table."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citedspark.llm import kneser_ney


def test_shares_write_the_same_arrays(monkeypatch, tmp_path):
    rng = np.random.default_rng(3)
    names = rng.integers(0, 2**48, 300, dtype=np.uint64)
    text = names[np.minimum(rng.zipf(1.3, 6_000), len(names)) - 1]
    frequent, sizes = np.unique(text[:3]), []
    grams = [text[:-2], text[1:-1], text[2:]]
    keys, counts, at = kneser_ney._summed(kneser_ney._keys(grams, frequent)[0][-1], np.ones(len(text) - 2, np.int64))
    sent = kneser_ney._rows(2, [word[at] for word in grams], keys, counts)
    empty = pa.Table.from_pylist([{"level": 3, "part": k, "words": b"", "grams": b"", "n": b"", "stats": b""} for k in (0, 1)], kneser_ney._GRAM_TYPES)
    summed = kneser_ney._summed
    monkeypatch.setattr(kneser_ney, "_summed", lambda keys, n: (sizes.append(len(keys)), summed(keys, n))[1])

    def level(sent, number, above, shares, folder):
        out = []
        for part in (0, 1):
            of_part = pa.concat_tables([t.filter(pa.array([p == part for p in t["part"].to_pylist()])) for t in (sent, empty.set_column(0, "level", pa.array([number] * 2, pa.int32())))])
            out += kneser_ney._grams_kept(str(folder), 2, frequent, number, above, shares)(iter(of_part.to_batches(max_chunksize=1)))
        return pa.Table.from_batches(out)

    largest = {}
    for shares in (1, 6):
        sizes.clear()
        passed = level(sent, 3, False, shares, tmp_path / str(shares))
        level(passed.filter(pa.array([n == 2 and p >= 0 for n, p in zip(passed["level"].to_pylist(), passed["part"].to_pylist(), strict=True)])), 2, True, shares, tmp_path / str(shares))
        largest[shares] = max(sizes)
    one, six = ({file.name: file.read_bytes() for file in Path(tmp_path / name).iterdir()} for name in ("1", "6"))
    assert one == six and len(one) == 2 * (4 + 2 + 4 + 2 + 2)
    assert largest[6] < largest[1] / 2


@pytest.mark.parametrize("order", [2, 3])
def test_scores_do_not_depend_on_the_shares(spark, monkeypatch, order):
    rng = random.Random(order)
    rows = [(k, " ".join(rng.choice(["the", "of", "a", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(50)))) for k in range(60)]
    frame = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string").repartition(2)
    found = []
    for tokens in (kneser_ney.RANGE_TOKENS, 40):
        monkeypatch.setattr(kneser_ney, "RANGE_TOKENS", tokens)
        found.append({r["doc_id"]: r for r in kneser_ney.scored(frame, F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True)), order).collect()})
    assert found[0].keys() == found[1].keys()
    for doc, row in found[0].items():
        assert row[:5] == found[1][doc][:5] and row["score"] == pytest.approx(found[1][doc]["score"])
