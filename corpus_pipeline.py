"""The training-data pipeline: every stage works on all that its predecessor kept.

Toxic documents go, one document of each near-duplicate group stays, contaminated documents go,
secrets are masked in the text, and what is left is encoded and decoded. Rows are judged by
themselves, so a row without doc_id or text passes where nothing speaks against it; rows that
repeat a doc_id count as one document from the second stage on where their texts are alike. Columns beside those that a
stage needs are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citedspark.llm import fm_index, minhash, noisy_channel, queries, secrets
from citedspark.llm.arrays import carried_columns
from citedspark.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below one half."""
    scored = noisy_channel.scored_rows(docs, _table(spark, sf_dir, "labels"))
    return scored.where("score < 0.5").select(carried_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five words a shingle, 0.8 or more.

    Each row is judged by its own text. Of kept rows of one doc_id and one group the first by text
    stays; rows without doc_id are not compared.
    """
    # As text, so that columns without an order of their own (maps) take part too.
    others = F.struct(*[F.col("row")[name].alias(name) for name in docs.columns if name not in ("doc_id", "text")])
    order = Window.partitionBy("doc_id", "group").orderBy("text", *([others.cast("string")] if len(docs.columns) > 2 else []))
    one = minhash.kept_rows(docs).withColumn("place", F.row_number().over(order)).where("place = 1")
    return one.select(carried_columns(docs)).union(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows, of items with or without item_id, cover less than a twentieth."""
    searched = fm_index.searched_rows(docs, _table(spark, sf_dir, "benchmark"))
    return searched.where(~fm_index.contaminated()).select(carried_columns(docs))


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret's span replaced by a mark and the characters counted anew."""
    found = secrets.spanned_rows(docs)
    spans = F.concat(*secrets.KINDS)
    masked = found.select("row", secrets.masked(F.col("text"), spans).alias("text"), (F.size(spans) > 0).alias("hit"))
    columns = carried_columns(docs)
    if "n_chars" in docs.columns:
        counted = F.when(F.col("hit"), F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
        columns[docs.columns.index("n_chars")] = counted.alias("n_chars")
    return masked.select(columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes they decode to."""
    return queries.token_digests(docs)


STAGES = [
    ("toxicity", toxicity),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_masks),
    ("byte-level BPE", encoding),
]

#: SQL cannot express the learnt scores and the encoding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of `sf_dir`."""
    docs = _table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = scratch_path(spark, f"stage-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
