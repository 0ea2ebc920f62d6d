import random
import re

import pytest

from flowloom.llm import paragraphs

SCHEMA = "doc_id bigint, text string, digest string, key string, root string"


def plain(rows, threshold=0.8, width=5, least=20):
    """Brute force over all pairs of paragraphs."""
    found = {}
    for r in rows:
        for number, line in enumerate((r[1] or "").split("\n")):
            words = re.findall(rb"[a-z0-9\x80-\xff]+", line.lower().encode())
            if len(words) >= least:
                found[(r[0] is not None, r[0] or 0, number)] = (
                    len(words), frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1)), tuple(words))
    places = sorted(found)
    root = {p: p for p in places}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(places):
        for q in places[:i]:
            a, b = found[p][1], found[q][1]
            if found[p][2] == found[q][2] or len(a & b) >= threshold * len(a | b):
                x, y = find(p), find(q)
                root[max(x, y)] = min(x, y)
    name = lambda p: str(p[1]) if p[0] else "None"
    return {(name(p), p[2]): (found[p][0], name(find(p)), find(p)[2]) for p in places if find(p) != p}


def corpus(seed, n=150):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(900)}"
    families = [[word() for _ in range(rnd.randint(20, 80))] for _ in range(12)]
    rows = []
    for k in range(n):
        lines = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(0, 4))]
        for _ in range(rnd.randint(0, 3)):
            copy = list(rnd.choice(families))
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = word()
            lines.insert(rnd.randint(0, len(lines)), rnd.choice([" ", ", ", "  "]).join(copy).title())
        rows.append((k, "\n".join(lines), "a", "b", "c"))
    same = " ".join(word() for _ in range(30))
    rows += [(None, same + "\n\n" + same, "", "", ""), rows[4], (300, None, "", "", ""), (301, "", "", "", ""),
             (302, same, "", "", ""), (303, "x " * 40_000, "", "", ""), (304, ("short line\n" * 3000), "", "", "")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_removals_match_brute_force(spark, seed):
    rows = corpus(seed)
    want = plain(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = paragraphs.repeated_paragraphs(df).distinct().collect()
    assert {(str(r.doc_id), r.paragraph): (r.n_words, str(r.keeper_id), r.keeper_paragraph) for r in got} == want
    assert len(got) == len(want) and want


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([(1, "a few words", "", "", ""), (2, None, "", "", "")], SCHEMA)
    assert paragraphs.repeated_paragraphs(df).count() == 0
    assert paragraphs.repeated_paragraphs(df.limit(0)).count() == 0


def test_bands_keep_recall():
    for threshold in (0.5, 0.7, 0.8, 0.95):
        bands, rows = paragraphs.tune_bands(threshold)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999
        assert 1 - (1 - (threshold / 2) ** rows) ** bands <= 0.5


def test_a_hot_item_is_cut_into_groups_in_which_all_components_meet(spark):
    rnd = random.Random(3)
    # One item with a large component and many small ones, and one item of a single component.
    rows = [(k, 7, 1 if k < 300 else rnd.randrange(2, 60)) for k in range(500)] + [(k, 8, 1) for k in range(300)]
    placed = spark.createDataFrame(rows, "digest bigint, item bigint, root bigint")
    groups = {}
    for r in paragraphs.item_groups(placed, 20).collect():
        assert r.item == 7
        groups.setdefault((r.kind, r.low, r.high), []).append((r.digest, r.root, r.side))
    assert max(map(len, groups.values())) <= 100
    met = {
        frozenset((a, b)) for members in groups.values() for a, x, s in members for b, y, t in members
        if x != y and (s, t) in ((0, 1), (2, 2))
    }
    assert met == {frozenset((a, b)) for a, _, x in rows[:500] for b, _, y in rows[:500] if x != y}


def test_removals_match_brute_force_when_items_are_cut(spark, monkeypatch):
    monkeypatch.setattr(paragraphs.item_groups, "__defaults__", (2,))
    rows = corpus(5)
    got = paragraphs.repeated_paragraphs(spark.createDataFrame(rows, SCHEMA).repartition(3)).distinct().collect()
    assert {(str(r.doc_id), r.paragraph): (r.n_words, str(r.keeper_id), r.keeper_paragraph) for r in got} == plain(rows)
