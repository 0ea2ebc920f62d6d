import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from flowloom.llm.chunk_encoder import Encoder
from flowloom.llm.token_cache import token_counts
from flowloom.llm.token_files import TokenFile, flat_texts, pack, read_tokens, write_tokens
from flowloom.workspace import new_path

BPE = P.path("byte_bpe_50k.json")
PIECES = P.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, _text string, digest string, n_tokens string"
BITS = [" ", " ", "\n", "\t", ".", ",", "a", "Bc", "é", "×", "\x85", "　", "日", "'s", "'", "!", "9",
        "_", "\x1c", "😀", "\r\n", "́", "<|endoftext|>", "words", "<s>", "\x00"]


def texts(n, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(BITS, k=rnd.randint(0, 40))) for _ in range(n)] + ["", "x" * 90_000, " " * 700]


def rows():
    found = [(k, text, "other", "x", "y") for k, text in enumerate(texts(300))]
    return found + [(7, "twice", None, None, None)] * 2 + [(None, "no id", "", "", ""), (1000, None, "", "", "")]


def test_chunks_encode_like_whole_texts():
    model, cut = Tokenizer.from_file(BPE), Encoder(BPE)
    assert cut.by_chunk
    for seed in range(3):
        some = texts(800, seed)
        ids, counts = cut.encode(*flat_texts(pa.array(some)))
        want = [x.ids for x in model.encode_batch(some, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == [y for x in want for y in x]


def test_other_pretokenizers_are_not_cut():
    words = Encoder(P.path("word_bpe_49k.json"))
    assert not words.by_chunk
    some = ["A b, c.", "", "two words"]
    want = [x.ids for x in words.model.encode_batch(some, add_special_tokens=False)]
    ids, counts = words.encode(*flat_texts(pa.array(some)))
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 4000])
def test_every_place_is_addressable(n):
    rnd = np.random.default_rng(n)
    ids = rnd.choice(np.array([0, 3, 255, 256, 65535, 65536, 1 << 31], np.uint32), n)
    file = TokenFile(pack(ids, [None, 5], np.array([0, n // 3, n])))
    assert file.doc_ids == [None, 5]
    assert [file.token(i) for i in range(n)] == ids.tolist()
    assert file.document(1).tolist() == ids[n // 3:].tolist()
    for a in range(0, n, 97):
        assert file.tokens(a, min(n, a + 700)).tolist() == ids[a:a + 700].tolist()


@pytest.mark.parametrize("shard_tokens", [500, 1 << 20])
def test_token_files_round_trip(spark, shard_tokens):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    folder = new_path(spark, "tok")
    files = write_tokens(df, folder, BPE, end_id=2, shard_tokens=shard_tokens)
    got = read_tokens(files, folder, with_ids=True).orderBy("start").collect()
    model = Tokenizer.from_file(BPE)
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(ordered)
    start = 0
    for row, (doc_id, text, *_) in zip(got, ordered, strict=True):
        ids = model.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc_id, start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    folder = new_path(spark, "tok")
    assert read_tokens(write_tokens(df, folder, BPE), folder).count() == 0
    assert token_counts(df, PIECES, new_path(spark, "counts")).count() == 0


@pytest.mark.parametrize("path", [PIECES, BPE])
def test_counts_and_cache(spark, path):
    import sentencepiece

    if path == PIECES:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda text: len(model.encode(text))
    else:
        model = Tokenizer.from_file(path)
        count = lambda text: len(model.encode(text, add_special_tokens=False).ids)
    cache = new_path(spark, "counts")
    df = spark.createDataFrame(rows(), SCHEMA)
    want = sorted((str(a), len((t or "").encode()), count(t or ""), count(t or "") > 30) for a, t, *_ in rows())
    first = token_counts(df.where("doc_id < 150"), path, cache, limit=30)
    assert first.count() == len([r for r in rows() if r[0] is not None and r[0] < 150])
    before = spark.read.parquet(cache).count()
    got = token_counts(df, path, cache, limit=30).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    stored = spark.read.parquet(cache)
    assert before < stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t, *_ in rows()})
    token_counts(df, path, cache)
    assert spark.read.parquet(cache).count() == stored.count()
