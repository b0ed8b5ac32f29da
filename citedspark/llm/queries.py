"""The registered queries of this subpackage and their SQL, where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citedspark.llm import (
    block_join,
    bwt_merge,
    byte_bpe,
    fm_index,
    kneser_ney,
    license_text,
    minhash,
    noisy_channel,
    secrets,
    simhash,
    spelling,
    suffix_automaton,
    warc,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op2_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents: 2-word shingles, 0.8 or more."""
    return minhash.near_duplicates(table(spark, folder, "documents"), width=2)


RANKS = "byte_bpe_50k.tiktoken"


def token_digests(documents: DataFrame) -> DataFrame:
    """Digests of each document's ids and of the bytes they decode to."""
    coded = byte_bpe.coded(documents, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded by the ranks and decoded again."""
    return token_digests(table(spark, folder, "documents"))


@query("""
WITH v AS (
    SELECT vec_id, min(embedding)::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    GROUP BY vec_id)
SELECT q.vec_id AS query_id,
       CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS INTEGER) AS rank,
       c.vec_id, list_inner_product(q.e, c.e) AS score
FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
WHERE q.vec_id % 20 = 0
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) <= 20""")
def op7_block_join(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of each vector whose id is divisible by 20, among all others."""
    return block_join.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""
WITH item AS (
    SELECT item_id, regexp_extract_all({ASCII_LOWER}, '{WORDS}') AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS size,
           array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '{WORDS}') AS w FROM documents),
place AS (
    SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
          FROM doc, (SELECT DISTINCT size FROM win))),
found AS (SELECT DISTINCT doc_id, i, size, item_id FROM place JOIN win USING (size, phrase)),
hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY 1),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op3_fm_index_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document inside any 13-word window of a benchmark item."""
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts and digests of the removal spans, and the verdict."""
    return fm_index.removal_spans(documents, benchmark).select(
        "doc_id",
        "n_words",
        fm_index.hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        fm_index.contaminated().alias("contaminated"),
    )


@query()
def op5_license_automaton(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and covered template spans of every document."""
    found = suffix_automaton.license_spans(
        table(spark, folder, "documents"), license_text.TEMPLATES, license_text.PHRASES
    )
    starts, named, covered = F.col("places.start"), F.col("places.label"), F.col("spans.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(named, covered)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max(F.col("spans.share")), F.lit(0.0)))
        .alias("score"),
    )


@query()
def op6_noisy_channel(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learnt from four of five folds of the labelled ones."""
    scored = noisy_channel.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select(
        "doc_id",
        F.coalesce(noisy_channel.fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("restored").alias("n_restored"),
    )


@query()
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document: fixed forms, and tokens that a Markov model finds random."""
    found = secrets.secret_spans(table(spark, folder, "documents"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.concat(base, "random")).alias("spans"),
    )


@query()
def op8_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document under a trigram model of the rows of four of five folds."""
    held_out = F.coalesce(noisy_channel.fold("doc_id") == 1, F.lit(False))
    documents = table(spark, folder, "documents")
    return kneser_ney.scored(documents, ~held_out, order=3).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query()
def op10_bwt_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that no 200-byte repeat covers."""
    found = bwt_merge.repeats_removed(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query()
def op4_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata and conversion record of every page's response record."""
    made = warc.derived(warc.responses(table(spark, folder, "pages")))
    return made.select(
        "page_id", "kind", "record_id", "refers_to", "target_uri", "block_digest", "payload_digest",
        F.octet_length("block").cast("long").alias("n_bytes"), F.sha2("record", 256).alias("record_sha256"), "problem",
    )


@query()
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings on the 32 leading components of their covariance, scaled to unit variance."""
    rows = whitening.whitened(table(spark, folder, "embeddings"), components=32)
    one = rows.select("*", F.posexplode(F.arrays_zip(F.col("whitened").alias("w"), F.col("explained").alias("e"))).alias("at", "of"))
    return one.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation",
        F.col("of.w").alias("whitened"), F.col("of.e").alias("explained"), "identity_error",
    )


@query()
def op13_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose 4-word SimHash fingerprints differ in at most 4 bits."""
    found = simhash.near_duplicates(table(spark, folder, "documents"), width=4, radius=4)
    return found.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


def _crc32_table() -> list[int]:
    """What CRC-32 makes of each byte, by its polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


_BYTES = """list_transform(flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)),
    lambda b: b::BIGINT)"""


@query(f"""
WITH RECURSIVE run AS (
    SELECT doc_id, run, count(*) AS k
    FROM (SELECT doc_id, unnest(regexp_extract_all({ASCII_LOWER}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
    GROUP BY 1, 2),
hashed AS (
    SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}),
        lambda c, b: xor(c >> 8, list_extract({_crc32_table()}::BIGINT[], xor(c & 255, b) + 1))), 4294967295) AS h
    FROM run),
word AS (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                ELSE run END AS word, sum(k)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(k) >= 3),
cut AS (
    SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM word)),
shorter AS (SELECT DISTINCT c.word AS a, c.n AS n_a, w.word AS b, w.n AS n_b FROM cut c JOIN word w ON c.rest = w.word),
near AS (
    SELECT x.word AS a, y.word AS b, y.n AS n_b FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
    UNION ALL SELECT a, b, n_b FROM shorter UNION ALL SELECT b, a, n_a FROM shorter),
best AS (
    SELECT a, count(*) OVER (PARTITION BY a) AS n_near, b, n_b FROM near
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY n_b DESC, b) = 1),
formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN n_b >= 2 * n THEN b END AS form,
           CASE WHEN n_b >= 2 * n THEN n_b END AS form_n
    FROM word LEFT JOIN best ON a = word),
chain AS (
    SELECT word, form AS root, 1 AS depth FROM formed WHERE form IS NOT NULL
    UNION ALL
    SELECT c.word, f.form, depth + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, coalesce(r.root, f.word) AS root, n, n_near, form_n
FROM formed f LEFT JOIN (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY 1) r ON r.word = f.word""")
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.variants(table(spark, folder, "documents"))
