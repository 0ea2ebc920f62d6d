import hashlib
import random
import re

import pytest

from flowloom.llm import spot_signatures as S

SCHEMA = "doc_id bigint, text string, fingerprint string, _part string, _follows boolean"


def plain_set(text, chain=2):
    words = re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode())
    common = set(S.ANCHORS.encode().split())
    spots = set()
    for i, w in enumerate(words):
        after = [x for x in words[i + 1:] if x not in common][:chain]
        if w in common and len(after) == chain:
            spots.add((w, *after))
    if not spots:
        spots = {tuple(words[i:i + chain + 1]) for i in range(len(words) - chain)}
    return spots or ({tuple(words) or text} if text else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(seed, n=80):
    rnd = random.Random(seed)
    pool = ["the", "of", "der", "la", "Und"] * 3 + [f"w{k}" for k in range(60)] + ["É", "日本", "."]
    rows = []
    for _ in range(n):
        text = rnd.choice([" ", ", ", "\n"]).join(rnd.choices(pool, k=rnd.choice([0, 1, 2, 3, 9, 60])))
        rows.append((rnd.randrange(5000), text, "a", "b", True))
        if rnd.random() < 0.4:
            words = text.split(" ")
            words[rnd.randrange(len(words))] = "edit"
            rows.append((rnd.randrange(5000), " ".join(words), "a", "b", False))
    return rows + [rows[0], rows[1], (None, "no id the w1 w2", "", "", None), (9000, None, "", "", None), (9001, "!?", "", "", None),
                   (9002, "?!", "", "", None), (9003, "the w1 w2 " * 700, "", "", None), (rows[2][0], "same id", "", "", None)]


def plain(rows):
    lined = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in rows))
    out = []
    for k, (known, one, text) in enumerate(lined):
        after = lined[(k + 1) % len(lined)][2]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own = plain_set(text)
        out.append((str(one) if known else "None", len(text), hashlib.sha256(edited.encode()).hexdigest(),
                    round(jaccard(own, plain_set(edited)), 9), round(jaccard(own, plain_set(after)), 9)))
    return sorted(out)


@pytest.mark.parametrize("seed,n", [(1, 80), (2, 3), (3, 150)])
def test_edits_match_brute_force(spark, monkeypatch, seed, n):
    monkeypatch.setattr(S, "BATCH_BYTES", 500)
    rows = corpus(seed, n)
    got = S.edited_fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((str(r[0]), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == plain(rows)
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert all(len(x) % 8 == 0 for v in prints.values() for x in v)
    assert prints[9001] != prints[9002]


@pytest.mark.parametrize("rows", [[], [(5, "the one row only", "", "", None)], [(None, "x", "", "", None), (None, None, "", "", None)]])
def test_few_rows(spark, rows):
    got = S.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r[0]), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == plain(rows) if rows else got == []


def test_similar_groups_match_brute_force(spark):
    rows = corpus(4, 120)
    got = S.similar_groups(spark.createDataFrame(rows, SCHEMA), threshold=0.6).collect()
    sets = [plain_set(r[1] or "") for r in rows]
    root = list(range(len(rows)))
    links = [set() for _ in rows]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or jaccard(sets[i], sets[j]) >= 0.6 - 1e-9 and sets[i] and sets[j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                if sets[i] != sets[j]:
                    links[i].add(frozenset(sets[j]))
                    links[j].add(frozenset(sets[i]))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    want = sorted((str(r[0]), str(least.get(find(i))), len(links[i])) for i, r in enumerate(rows))
    assert sorted((str(r[0]), str(r[1]), r[2]) for r in got) == want
    assert any(n for _, _, n in want)
