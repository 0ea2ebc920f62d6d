import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from flowloom.llm.prefix_trie import branched, paths, prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, parent string, depth string"


def plain(rows):
    """Brute force over all prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns, key=lambda t: t[0])] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, of in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(of) - 1) * words
    out = []
    for k, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(rebuilt[c]) == len(k))
        out.append((min(of), len(k), min(members[k[:-1]]) if k else None, len(of), children[k], leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, deep=0):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(400), 250):
        for turn in rnd.sample([None, *range(9)], rnd.randint(1, 6)):
            text = rnd.choice(["", None, "a", "a b", "a  b\n\x0bc", "é è x", "common words here"])
            rows.append((c, turn, rnd.choice(["user", "assistant", None]), text, "p", "q", "r"))
    same = [(k, r, t) for k, (r, t) in enumerate([("user", "hello there"), ("assistant", "general kenobi")] * 2)]
    for c in range(1000, 1300):  # a hot conversation
        rows += [(c, k, r, t, "", "", "") for k, r, t in same]
    rows += [(2000, k, "user", f"{k % 7} deep", "", "", "") for k in range(deep)]
    rows += [(2001, k, "user", f"{k % 7} deep", "", "", "") for k in range(deep // 2)]
    rows += [(None, 1, "user", "nobody's", "", "", ""), (3000, 0, "user", "x " * 100_000, "", "", "")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,deep,parts", [(1, 0, 4), (2, 120, 4), (3, 120, 40), (4, 30, 1)])
def test_nodes_match_brute_force(spark, seed, deep, parts):
    rows = corpus(seed, deep)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = prefix_trie(branched(paths(spark.createDataFrame(rows, SCHEMA).repartition(5))))
        assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lists_of_many_chunks_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr("flowloom.llm.prefix_trie.CHUNK", 7)
    ids = random.Random(5).sample(range(-50, 5000), 900)
    rows = spark.createDataFrame([(c, None) for c in ids], "conv_id bigint, path binary").repartition(6)
    (root,) = prefix_trie(rows).collect()
    assert root["ends_sha256"] == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert (root["conv_id"], root["n_convs"], root["n_leaves"], root["parent_conv_id"]) == (min(ids), 900, 1, None)


def test_repeated_rows_are_turns_and_empty_tables_have_no_nodes(spark):
    rows = [(7, 1, "user", "a b", "", "", "")] * 3
    found = prefix_trie(paths(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r["depth"], r["n_convs"], r["n_children"]) for r in found) == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 0)]
    assert prefix_trie(branched(paths(spark.createDataFrame([], SCHEMA)))).collect() == []
