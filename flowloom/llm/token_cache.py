"""Token counts through a digest cache.

Every text is reduced to a digest of its normalised content. A stored table holds counts by
(content digest, tokenizer-version digest). Only distinct digests that the table lacks are
encoded, and their counts are appended to it. The texts themselves are shuffled once, to meet
the narrow list of misses; everything else moves digests.
"""

import hashlib
import importlib.metadata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowloom.llm.base import path_exists, text_or_empty
from flowloom.workspace import materialize

CACHE_SCHEMA = "digest string, version string, n_tokens bigint"
LIBRARIES = {"model": "sentencepiece", "json": "tokenizers"}


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the library version that reads it."""
    library = LIBRARIES[path.rsplit(".", 1)[-1]]
    with open(path, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    said = f"{library} {importlib.metadata.version(library)} {content}"
    return hashlib.sha256(said.encode()).hexdigest()


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, loaded once per Python worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_padding()
    model.no_truncation()
    return lambda texts: [
        len(model.encode(text, add_special_tokens=False).ids) for text in texts
    ]


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest. Two jobs may have appended
    the same digest; their counts are equal."""
    if not path_exists(spark, cache):
        return spark.createDataFrame([], "digest string, n_tokens bigint")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    return (
        stored.where(F.col("version") == version)
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    )


def token_counts(
    docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None, limit: int = 4096,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    ``normalise`` maps the text to the content that is counted; by default texts are counted
    as they are. A null text is the empty text and has 0 tokens. Rows with a null or repeated
    id are counted like any other; equal texts are encoded once. An empty table gives an empty
    result and an empty cache. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    text = text_or_empty(text_col)
    content = normalise(text) if normalise else text
    texts = docs.select(
        F.col(id_col).alias("_id"), content.alias("_text"), F.sha2(content, 256).alias("digest")
    )
    keyed = materialize(
        docs.select(
            F.col(id_col).alias("_id"), F.octet_length(text).cast("bigint").alias("n_bytes"),
            F.sha2(content, 256).alias("digest"),
        ),
        "digests",
    )
    misses = (
        keyed.groupBy("digest").agg(F.min("_id").alias("_first"))
        .join(read_cache(spark, cache, version), "digest", "left_anti")
        .withColumnRenamed("digest", "_digest")
    )
    wanted = texts.join(
        misses.hint("shuffle_hash"),
        (F.col("digest") == F.col("_digest")) & F.col("_id").eqNullSafe(F.col("_first")),
        "left_semi",
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = counter(tokenizer), set()  # rows may repeat with their id
        for batch in batches:
            new = {}
            for digest, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    new[digest] = content.as_py()
            numbers = count(list(new.values())) if new else []
            yield pa.record_batch(
                [pa.array(list(new), pa.string()), pa.array(numbers, pa.int64())],
                names=["digest", "n_tokens"],
            )

    encoded = (
        wanted.select("digest", "_text").mapInArrow(encode, "digest string, n_tokens bigint")
        .dropDuplicates(["digest"]).select("digest", F.lit(version).alias("version"), "n_tokens")
    )
    encoded.write.mode("append").parquet(cache)
    # A written table: the join then shuffles both sides itself and can split a hot digest.
    counts = materialize(read_cache(spark, cache, version), "counts")
    return (
        keyed.join(counts, "digest", "left")
        .select(
            F.col("_id").alias(id_col), "n_bytes", "n_tokens",
            (F.col("n_tokens") > limit).alias("over_limit"),
        )
    )
