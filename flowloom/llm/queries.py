"""Registered queries of the text operators, over the whole driver tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm import queries_words, toxicity
from flowloom.llm.base import table
from flowloom.llm.decontamination import contaminations
from flowloom.llm.mixing import mixture
from flowloom.llm.paragraphs import repeated_paragraphs
from flowloom.llm.passages import repeated_passages
from flowloom.llm.repeats import remove_repeats
from flowloom.llm.simhash import simhash_groups
from flowloom.llm.spot_signatures import edited_fingerprints
from flowloom.llm.token_cache import token_counts
from flowloom.llm.token_files import read_tokens, write_tokens
from flowloom.llm.warc import read_archives, write_archives
from flowloom.workspace import new_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of every document, by temperature weights of the sources; see ``mixture``."""
    return mixture(table(spark, sf_dir, "documents"), columns=["doc_id", "source"])


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all texts, read back: where each document stands. Null texts have their end id only."""
    folder = new_path(spark, "tokens")
    files = write_tokens(table(spark, sf_dir, "documents"), folder, BYTE_BPE, end_id=2)
    return read_tokens(files, folder)


def op3_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back: one row per page. A null page id or payload is defined in ``write_archives``."""
    folder = new_path(spark, "warc")
    files = write_archives(table(spark, sf_dir, "pages"), folder)
    records = read_archives(spark, folder, files).where(F.col("kind") == "record")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(hex, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM k
"""


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without repeated strings of 100 bytes; see ``remove_repeats``."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document, null and empty texts included; see ``simhash_groups``."""
    return simhash_groups(table(spark, sf_dir, "documents"))


def op6_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they are; see ``edited_fingerprints``."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_contaminations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that hold a test item; see ``contaminations``."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def training_fold(labels: DataFrame) -> DataFrame:
    """Labels that may be learnt from; the others are held out."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text; labels are learnt from the training fold only. A null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, training_fold(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model, ["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.withColumn("held_out", held_out)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all texts, through a new digest cache; see ``token_counts``."""
    return token_counts(table(spark, sf_dir, "documents"), PIECE_BPE, new_path(spark, "counts"))


def op10_repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines (``first_word`` is null), and passages of 50 words or more wherever they stand."""
    docs = table(spark, sf_dir, "documents")
    passages = repeated_passages(docs)
    lines = repeated_paragraphs(docs).withColumn("first_word", F.lit(None).cast("bigint"))
    return lines.unionByName(passages)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixture": op1_mixture,
    "op2_token_files": op2_token_files,
    "op3_warc_records": op3_warc_records,
    "op4_repeated_bytes": op4_repeated_bytes,
    "op5_simhash_groups": op5_simhash_groups,
    "op6_spot_signatures": op6_spot_signatures,
    "op7_contaminations": op7_contaminations,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_repeated_paragraphs": op10_repeated_paragraphs,
} | queries_words.QUERIES

ORACLES: dict[str, str] = {"op3_warc_records": OP3_SQL} | queries_words.ORACLES
