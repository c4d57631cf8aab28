"""Shared building blocks of the named queries: the test corpus as
paragraphs, character chunks and TF-IDF indexes.

Test-table roles: ``documents`` is the corpus (paragraph separator ``\\n``:
the generated texts have no blank lines), ``benchmark`` holds the questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlake.operators.chunking import chunk_chars
from answerlake.operators.paragraphs import normalize_paragraphs, split_paragraphs
from answerlake.operators import segments
from answerlake.operators.pruned import Blocks
from answerlake.operators.tfidf import Index, vectorize
from answerlake.session import ensure_checkpoint_dir, spread
from answerlake.sources import storage
from answerlake.sources.tables import table

PARA_SEP = "\n"
CHUNK_CHARS = 1000          # character chunk of the TF-IDF variant
DENSE_CHUNK_CHARS = 300     # character chunk of the dense variant
PACK_TOKENS = 2000          # token pack of the endpoint variant
THRESHOLD = 0.2             # similarity threshold of the TF-IDF chat loop
TOP_K = 4                   # width of the dense chat loop
PARA_KEYS = ("doc_id", "para_idx")
CHUNK_KEYS = ("doc_id", "para_idx", "piece_idx")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return spread(docs, "doc_id")


def filename(df: DataFrame) -> DataFrame:
    """Provenance name of a paragraph's source file."""
    return df.withColumn("filename", F.concat(F.col("source"), F.lit("/"),
                                              F.col("doc_id").cast("string"), F.lit(".txt")))


def raw_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_paragraphs(documents(spark, sf_dir), sep=PARA_SEP, carry=("doc_id", "source"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_paragraphs(raw_paragraphs(spark, sf_dir))


def char_chunks(spark: SparkSession, sf_dir: str, size: int = CHUNK_CHARS,
                drop_exact: bool = False) -> DataFrame:
    return chunk_chars(paragraphs(spark, sf_dir), size, drop_exact)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


#: Changes when stored indexes look different.
STORE_FORMAT = 3


def paragraph_store(spark: SparkSession, sf_dir: str) -> str:
    """Endpoint variant: one vector per paragraph (fitted on paragraphs)."""
    return _store(spark, sf_dir, "paragraphs", lambda: paragraphs(spark, sf_dir), PARA_KEYS)


def chunk_store(spark: SparkSession, sf_dir: str) -> str:
    """Chat-loop variant: one vector per character chunk."""
    return _store(spark, sf_dir, "chunks", lambda: char_chunks(spark, sf_dir, CHUNK_CHARS), CHUNK_KEYS)


def _store(spark: SparkSession, sf_dir: str, kind: str, units, keys) -> str:
    """The stored index of the documents as they are now: built by the first query that asks, opened by all others."""
    source = storage.fingerprint(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/answerlake/index/{kind}-{STORE_FORMAT}-{source}"
    if segments.manifest(spark, path) is None:
        segments.append(units(), path, keys, [source], keep=("source",))
    return path


def paragraph_index(spark: SparkSession, sf_dir: str) -> Index:
    return segments.open_index(spark, paragraph_store(spark, sf_dir))


def chunk_index(spark: SparkSession, sf_dir: str) -> Index:
    return segments.open_index(spark, chunk_store(spark, sf_dir))


def paragraph_blocks(spark: SparkSession, sf_dir: str) -> Blocks:
    return Blocks(spark, paragraph_store(spark, sf_dir))


def chunk_blocks(spark: SparkSession, sf_dir: str) -> Blocks:
    return Blocks(spark, chunk_store(spark, sf_dir))


def question_vectors(spark: SparkSession, sf_dir: str, idf: DataFrame) -> DataFrame:
    return vectorize(questions(spark, sf_dir), idf, ("item_id",))


# ------------------------------------------------------------- scoring ----

def score_top1(qv: DataFrame, index: Index, q_keys, d_keys) -> DataFrame:
    """Best text per question (ties: smallest ``d_keys``)."""
    from answerlake.operators import retrieval as R
    from answerlake.operators.scoring import score_index
    return R.top1(score_index(qv, index.forward, q_keys[0], d_keys, "top1"), q_keys, d_keys)


def score_threshold(qv: DataFrame, index: Index, d_keys, threshold: float) -> DataFrame:
    """Every (question, text) scoring strictly above ``threshold``."""
    from answerlake.operators.scoring import score_index
    return score_index(qv, index.forward, "item_id", d_keys, "threshold", threshold=threshold)


def score_group_best(qv: DataFrame, index: Index, groups: DataFrame, group_keys, inner_keys) -> DataFrame:
    """Best text per (question, group); ``groups`` maps texts to groups."""
    from answerlake.operators.scoring import best_in_groups, with_asked_terms
    fwd = with_asked_terms(index.forward, qv, PARA_KEYS).join(groups, list(PARA_KEYS))
    return best_in_groups(qv, fwd, "item_id", group_keys, inner_keys)
