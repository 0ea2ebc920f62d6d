import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from flowloom.llm import merge_rounds, queries_words
from flowloom.llm.merge_rounds import Merges, WordBpe, decode, encode

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, ids string, _id string, decoded string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rnd = random.Random(3)
    vocab = [t.removesuffix("</w>") for t in json.load(open(PATH, encoding="utf-8"))["model"]["vocab"]]
    texts = [
        "", " ", "\n\n", "a" * 3000, "ab" * 2000 + " x", "ΑΣ ΣΑΣ Σ", "İstanbul ISI ß ﬁ Å", "é e ́x", "a\x1cb\x85c d　f",
        "<|endoftext|> x<|startoftext|>y<|endoftext", "it's we'll I'D 12345 x_y", "日本語テスト", "😀👨‍👩‍👧", "\u0000\u0001", "thethe" * 500,
    ]
    texts += ["".join(rnd.choice(vocab) for _ in range(8)) for _ in range(50)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 0x300), rnd.randrange(0x300, 0xd800), rnd.randrange(0xe000, 0x20000)]))
                      for _ in range(40)) for _ in range(50)]
    return texts


def plain(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    said = library.decode(ids, skip_special_tokens=False)
    return ids, said


@pytest.mark.parametrize("piece,store", [(1 << 20, 300_000), (50, 20)])
def test_ids_and_texts_are_the_librarys(spark, library, monkeypatch, piece, store):
    monkeypatch.setattr(merge_rounds, "PIECE", piece)
    monkeypatch.setattr(merge_rounds, "STORE", store)
    bpe = WordBpe(PATH)
    for text in odd_texts():
        ids = [bpe.encode(texts)[0] for _, texts in merge_rounds._pieces([text])]
        found, (want, said) = np.concatenate(ids), plain(library, text)
        assert found.tolist() == want
        assert bpe.decode(found)[:-1].decode() == said


def test_rows_of_the_query(spark, library, tmp_path):
    rows = [(k, text, "x", "y", "z") for k, text in enumerate(odd_texts())]
    rows += [(None, "no id", "", "", ""), (3, None, "", "", ""), (3, "again", "", "", ""), (3, "again", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, queries_words.op12_merge_rounds(spark, str(tmp_path)).collect()), key=str)
    want = []
    for key, text, *_ in rows:
        ids, said = plain(library, text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((key, len(ids), digest, hashlib.sha256(said.encode()).hexdigest()))
    assert found == sorted(want, key=str)
    empty = decode(encode(docs.limit(0), PATH), PATH)
    assert empty.columns == ["doc_id", "ids", "n_tokens", "decoded"] and empty.collect() == []


def one_at_a_time(word, ranks):
    """Lowest rank first, leftmost first, one merge at a time."""
    while True:
        found = [(ranks[p][0], k) for k, p in enumerate(zip(word, word[1:], strict=False)) if p in ranks]
        if not found:
            return word
        _, k = min(found)
        word = [*word[:k], ranks[word[k], word[k + 1]][1], *word[k + 2:]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=24), max_size=6), st.randoms(use_true_random=False))
def test_rounds_equal_single_merges_for_any_merge_list(words, rnd):
    """Also where a product merges at a lower rank than the merge that made it."""
    pairs, size = {}, 4
    for _ in range(rnd.randint(0, 14)):
        pair = rnd.randrange(size), rnd.randrange(size)
        if pair not in pairs:
            pairs[pair] = size
            size += 1
    listed = list(pairs.items())
    rnd.shuffle(listed)
    ranks = {pair: (k, product) for k, (pair, product) in enumerate(listed)}
    merges = Merges(*(np.array(x, np.int64) for x in ([p[0] for p, _ in listed], [p[1] for p, _ in listed], [c for _, c in listed])))
    flat = np.array([s for word in words for s in word], np.int64)
    found, sizes = merges.merge(flat, np.array([len(w) for w in words], np.int64))
    cut = np.split(found, np.cumsum(sizes)[:-1]) if words else []
    assert [x.tolist() for x in cut] == [one_at_a_time(word, ranks) for word in words]


def test_unknown_ids_have_no_token_and_other_files_are_refused(library):
    bpe = WordBpe(PATH)
    assert bpe.decode(np.array([320, 60_000, 49407], np.uint32)).decode() == library.decode([320, 60_000, 49407], skip_special_tokens=False) + " "
    with pytest.raises(ValueError):
        WordBpe(public_tokenizers.path("byte_bpe_50k.json"))
