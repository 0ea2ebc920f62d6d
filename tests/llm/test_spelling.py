import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowloom.llm import spelling
from flowloom.llm.spelling import Tree, corpus_words, letter_counts, near_words, one_edit, roots, spelling_variants

SCHEMA = "doc_id bigint, text string, word string, n string, run string"


def counted(rows, least_length=6, least_count=5, edit=199):
    words = Counter()
    for key, text, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if edit and h % edit == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= least_count}


def judged(words, ratio=5):
    """Brute force: two words are near if they share what is left without one letter."""
    left = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            left[w[:i] + w[i + 1 :]].add((w, i))
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            near[w] |= {x for x, k in left[rest] if k == i}
            if rest in near:
                near[w].add(rest)
        near[w] |= {x for x, _ in left.get(w, ())}
        near[w].discard(w)
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), words[forms[w]] if forms[w] else None))
    return sorted(out)


def edited(rnd, word, letters="abcdeéÿ×"):
    i, kind = rnd.randrange(len(word)), rnd.randrange(3)
    return word[:i] + ("" if kind == 0 else rnd.choice(letters)) + word[i + (kind != 2) :]


def corpus(seed, n=150):
    rnd = random.Random(seed)
    base = ["".join(rnd.choices("abcdeéÿ", k=rnd.randint(6, 9))) for _ in range(40)]
    base += [edited(rnd, rnd.choice(base)) for _ in range(120)]
    base += ["".join(rnd.sample("abcdef", 6)) for _ in range(60)]  # words of the same letters
    rows = []
    for _ in range(n):
        words = [rnd.choice(base[: rnd.choice([5, 40, 220])]) for _ in range(rnd.randint(0, 60))]
        rows.append((rnd.randrange(100), rnd.choice([" ", "1", "-"]).join(words).replace("a", rnd.choice("aA")), "x", "y", "z"))
    long = "".join(rnd.choices("ab", k=5000))
    for word in (long, edited(rnd, long, "ab"), long[:-1]):
        rows += [(k, f"{word} {word}", "", "", "") for k in range(rnd.choice([3, 40]))]
    return rows + [(None, base[0], "", "", ""), (None, base[0], "", "", ""), (5, None, "", "", ""), (6, "", "", "", ""), rows[0], rows[0]]


@pytest.mark.parametrize("cell,leaf,edit", [(20_000, 12, 199), (8, 2, 7), (30, 1, 0)])
def test_variants_match_brute_force(spark, monkeypatch, cell, leaf, edit):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "LEAF", leaf)
    rows = corpus(cell)
    words = corpus_words(spark.createDataFrame(rows, SCHEMA).repartition(4), edit=edit)
    assert {r["word"]: r["n"] for r in words.collect()} == counted(rows, edit=edit)
    found = spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, found.collect())) == judged(counted(rows, edit=edit))


def test_every_pair_is_found_once_in_each_direction(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", 5)
    rnd = random.Random(8)
    words = {"".join(rnd.choices("abc", k=rnd.randint(1, 5))) for _ in range(200)}
    found = near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")).collect()
    pairs = [(r["word"], r["near"]) for r in found]
    want = {(a, b) for a in words for b in words if a != b and len(judged({a: 1, b: 1})) and judged({a: 1, b: 1})[0][4]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_boxes_in_reach_hold_all_near_counts():
    rnd = np.random.default_rng(4)
    counts = letter_counts(rnd.choice(np.frombuffer(b"abcde", np.uint8), (500, 7)))
    tree = Tree(counts, leaf=3)
    leaf_of = np.empty(500, np.int64)
    leaf_of[tree.order] = np.repeat(np.arange(len(tree.start) - 1), np.diff(tree.start))
    query, leaf = tree.reach(counts, more=1, less=1)
    met = set(zip(query.tolist(), leaf.tolist(), strict=True))
    assert len(met) == len(query) < 500 * (len(tree.start) - 1) // 2  # pruned
    gap = counts[:, None, :] - counts[None]
    near = (np.maximum(gap, 0).sum(2) <= 1) & (np.maximum(-gap, 0).sum(2) <= 1)
    assert all((q, leaf_of[m]) in met for q, m in zip(*np.nonzero(near), strict=True))


def test_one_edit_on_rows():
    def rows(*words):
        return np.array([list(w.encode("latin-1")) for w in words], np.uint8)

    assert one_edit(rows("abc", "abc", "abc"), rows("abd", "acb", "abc")).tolist() == [True, False, False]
    longer = rows("abcx", "xabc", "axbc", "xxbc", "acbc")
    assert one_edit(rows(*["abc"] * 5), longer).tolist() == [True, True, True, False, True]


def test_roots_of_long_chains_and_empty_tables(spark):
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(11)], "word string, form string")
    assert {r["root"] for r in roots(links).collect()} == {"w11"}
    none = spark.createDataFrame([], SCHEMA)
    assert spelling_variants(corpus_words(none)).collect() == []
