import random
import re

import numpy as np
import pytest

from flowloom.llm import decontamination as D
from flowloom.llm.words import word_ids

DOCS = "doc_id bigint, text string, item_id string, coverage string, _row string, _text string"


def words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode())


def plain_tiles(a, b, least):
    """Greedy string tiling by trying every pair of places."""
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return out
        n, i, j = best
        fa[i:i + n] = fb[j:j + n] = [False] * n
        out.append(best)


def test_tiles_match_brute_force():
    rnd = random.Random(1)
    for _ in range(120):
        a = [rnd.randrange(4) for _ in range(rnd.randint(0, 40))]
        b = [rnd.randrange(4) for _ in range(rnd.randint(0, 25))]
        if rnd.random() < 0.5 and len(a) > 12:
            b = a[8:20] + b + a[:9]
        got = D.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert sorted(got) == sorted(plain_tiles(a, b, 3))


def test_words_are_told_apart():
    text = "ab ba a b, été! x\x00y " + "z" * 600 + " " + "z" * 601 + "\nab"
    starts, ids = word_ids(np.frombuffer(text.encode(), np.uint8))
    found = [m.group() for m in re.finditer(rb"[a-z0-9\x80-\xff]+", text.encode())]
    assert len(starts) == len(found)
    assert len(set(ids.tolist())) == len(set(found)) and ids[0] == ids[-1]


def corpus():
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(500)}"
    items = [(k, " ".join(word() for _ in range(rnd.randint(3, 50))).title() + ".", "x") for k in range(30)]
    items += [(90, None, "x"), (91, "", "x"), (None, "one two three four five six", "x"), (93, items[3][1], "x")]
    rows = []
    for k in range(120):
        body = [word() for _ in range(rnd.randint(0, 200))]
        if k % 3 == 0:
            leak = (rnd.choice(items[:30])[1]).rstrip(".").split()
            if k % 2:  # cut up and reordered
                cut = rnd.randint(0, len(leak))
                leak = leak[cut:] + ["between"] + leak[:cut]
            at = rnd.randint(0, len(body))
            body[at:at] = leak
        rows.append((k, " ".join(body), "a", "b", "c", "d"))
    return rows + [(None, rows[0][1], "", "", "", ""), rows[3], (500, None, "", "", "", ""), (501, "", "", "", "", ""),
                   (502, "w1 " * 20_000, "", "", "", "")], items


def plain(rows, items):
    out = []
    for r in rows:
        w = words(r[1])
        for i in items:
            v = words(i[1])
            if len(v) >= 5 and (len(w) < 5000 or len(set(v)) == 1):
                t = plain_tiles(w, v, 5) if set(zip(w, w[1:])) & set(zip(v, v[1:])) else []
                if sum(n for n, _, _ in t) >= 0.8 * len(v):
                    out.append((str(r[0]), str(i[0]), round(sum(n for n, _, _ in t) / len(v), 9), len(t), max(t)[0]))
    return sorted(out)


@pytest.mark.parametrize("block", [200, 8 << 20])
def test_contaminations_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    rows, items = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string, doc_id string")
    got = sorted((str(r[0]), str(r[1]), round(r[2], 9), r[3], r[4]) for r in D.contaminations(docs, bench).collect())
    assert got == plain(rows, items) and got
    dirty = {r[0] for r in got}
    clean = D.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    kept = sorted(map(str, clean.collect()))
    assert kept == sorted(str(r) for r in docs.collect() if str(r.doc_id) not in dirty)


def test_empty_tables(spark):
    rows, items = corpus()
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id bigint, text string, doc_id string")
    assert D.contaminations(docs.limit(0), bench).count() == 0
    assert D.contaminations(docs, bench.limit(0)).count() == 0
    assert D.decontaminated(docs, bench.limit(0)).count() == len(rows)


def test_long_words_that_differ_late_are_different_words():
    rnd = random.Random(5)
    stem = "".join(rnd.choices("abcdeé", k=30))
    listed = {stem[:n] + end for n in range(4, 30) for end in ("", "a", "b", "ation", "ational", "10", "01", "x" * 300)}
    listed |= {f"{stem[:8]}{k}" for k in range(3000)} | {w[::-1] for w in listed}
    starts, ids = word_ids(np.frombuffer(" ".join(sorted(listed)).encode(), np.uint8))
    assert len(starts) == len(listed) == len(set(ids.tolist()))


def test_words_of_equal_beginnings_are_no_match(spark):
    item = "which international conference considered transport problems during productive negotiations between governments"
    text = "which internal confession considers transparent probability during product negotiable betweenness governing"
    docs = spark.createDataFrame([(1, text), (2, f"so {item} then")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert [r["doc_id"] for r in D.contaminations(docs, items).collect()] == [2]


@pytest.mark.parametrize("pairs", [1, 7, 100])
def test_tiles_do_not_depend_on_how_pairs_are_cut(monkeypatch, pairs):
    monkeypatch.setattr(D, "PAIRS", pairs)
    rnd = random.Random(pairs)
    for _ in range(60):
        a = [rnd.randrange(3) for _ in range(rnd.randint(0, 40))]
        b = [rnd.randrange(3) for _ in range(rnd.randint(0, 25))]
        got = D.tile(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert sorted(got) == sorted(plain_tiles(a, b, 3))


def test_a_long_text_of_one_word_is_held_in_parts(monkeypatch):
    """200,000 times one word against an item of 300 times that word: 60 million pairs of places."""
    import tracemalloc

    monkeypatch.setattr(D, "PAIRS", 1 << 16)
    items = D.Items([(1, "spam " * 300)], 5, 0.8)
    data = np.frombuffer(("spam " * 200_000).encode(), np.uint8)
    tracemalloc.start()
    found = list(items.matches(data, np.array([0, len(data)])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 0, 1.0, 1, 300)] and most < 150e6


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 2, 3), (2, "clean", 4, 5)], ["doc_id", "text", "page url", "a:b.c"])
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert [tuple(r) for r in D.decontaminated(docs, items).collect()] == [(2, "clean", 4, 5)]
