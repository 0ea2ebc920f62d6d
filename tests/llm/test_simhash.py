import random

import numpy as np
import pytest
import xxhash

from flowloom.llm import simhash
from flowloom.llm.components import components

SCHEMA = "doc_id bigint, text string, fingerprint string, root string"


def plain_fingerprint(text, width=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(links, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def plain(rows, radius=4, width=4):
    prints = [plain_fingerprint(r[1] or "", width) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if (prints[i] ^ prints[j]).bit_count() <= radius]
    roots = plain_groups(links, range(len(rows)))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[roots[i]] = min(r[0], least.get(roots[i], r[0]))
    return sorted((str(r[0]), f"{prints[i]:016x}", str(least.get(roots[i]))) for i, r in enumerate(rows))


def words(rnd, n):
    return [rnd.choice(["the", "of", "Ab", "c", "dé", "x\x85y", "e\x00", "long" * 5]) + str(rnd.randrange(40)) for _ in range(n)]


def test_fingerprints_and_groups_match_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(60):
        base = words(rnd, rnd.choice([0, 1, 3, 4, 5, 60, 400]))
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                if copy:
                    copy[rnd.randrange(len(copy))] = "edit"
            rows.append((rnd.randrange(10_000), rnd.choice([" ", "\n", "\t "]).join(copy), "x", "y"))
    rows += [(None, "no id here at all", "", ""), (5, None, "", ""), (6, "", "", ""), rows[0], (7, "w " * 30_000, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = simhash.simhash_groups(df).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == plain(rows)
    finer = simhash.simhash_groups(df, blocks=8).collect()
    assert sorted(map(str, finer)) == sorted(map(str, got))
    assert simhash.simhash_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [3, 10_000])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rnd = random.Random(9)
    values = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(40):
            values.add(base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))))
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "_fp bigint")
    pairs = (
        simhash._bucketed(df, 4, 6).repartition("key", "part", "value")
        .sortWithinPartitions("key", "part", "value", "_fp")
        .mapInArrow(simhash._compare(4), "u bigint, v bigint")
    )
    found = {r.node: r.root for r in components(pairs).collect()}
    got = {v: found.get(s, s) for v, s in zip(values, [r[0] for r in df.collect()], strict=True)}
    links = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4]
    want = plain_groups(links, values)
    same = lambda groups: sorted(sorted(v for v in values if groups[v] == g) for g in set(groups.values()))
    assert same(got) == same(want)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_slices_count_distances(radius):
    rnd = np.random.default_rng(radius)
    for n in (1, 2, 63, 64, 65, 300):
        values = rnd.integers(0, 1 << 63, n).astype(np.uint64)
        values[rnd.integers(0, n, n // 2)] = values[0] ^ np.uint64(5)
        keys = np.sort(rnd.integers(0, 3, n))
        a, b = simhash.bucket_links(keys, values, radius)
        links = [(i, j) for i in range(n) for j in range(i)
                 if keys[i] == keys[j] and (int(values[i]) ^ int(values[j])).bit_count() <= radius]
        want = plain_groups(links, range(n))
        root = dict(zip(a.tolist(), b.tolist(), strict=True))
        assert {i: root.get(i, i) for i in range(n)} == want


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    hub = [(1000, 1000 + i) for i in range(300)] + [(5, 5), (1100, 1000), (None, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + hub, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 300)}}
