import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flowloom.llm import mixing
from flowloom.llm.mixing import Target

SCHEMA = "doc_id bigint, text string, source string, _src string, mix_epoch int, tokens string"


def corpus(seed=1):
    rnd = random.Random(seed)
    rows = []
    for source, n in (("a", 400), ("b", 120), ("c", 30), (None, 15), ("", 5)):
        for _ in range(n):
            rows.append((len(rows), "word " * rnd.randint(1, 60), source, "s", 0, "t"))
    rows += [(9000, None, "empty", "", 0, ""), (9001, " ", "empty", "", 0, ""), (None, "no id", "a", "", 0, ""), rows[5], (9002, "w " * 3000, "c", "", 0, "")]
    return rows


def tokens(rows):
    found = defaultdict(int)
    for r in rows:
        found[r[2]] += len((r[1] or "").split())
    return {s: n for s, n in found.items() if n}


def plain_exponent(sizes, target):
    """Plain bisection."""
    most = max(sizes.values())

    def value(a):
        w = {s: (n / most) ** a for s, n in sizes.items()}
        z = sum(w.values())
        if target.entropy is not None:
            return -sum(x / z * math.log(x / z) for x in w.values()) / math.log(len(w))
        budget = target.budget or most * z
        return max(budget * w[s] / z / sizes[s] for s in sizes)

    wanted = target.entropy if target.entropy is not None else target.repetitions
    low, high = 0.0, 64.0 if target.entropy is not None else 1.0
    if value(low) <= wanted:
        return low
    if value(high) > wanted:
        return high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if value(mid) <= wanted else (mid, high)
    return high


@pytest.mark.parametrize("target", [
    Target(), Target(repetitions=4.0), Target(repetitions=1.0), Target(entropy=0.8), Target(entropy=0.2, budget=5000),
    Target(repetitions=3.0, budget=9000), Target(repetitions=1.5, budget=40_000), Target(budget=100), Target(repetitions=1e9),
])
@pytest.mark.parametrize("block_tokens", [500])
def test_budgets_are_met(spark, target, block_tokens):
    rows = corpus()
    sizes = tokens(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.mixture(df, target, block_tokens=block_tokens).collect()
    a = plain_exponent(sizes, target)
    z = sum((n / max(sizes.values())) ** a for n in sizes.values())
    budget = target.budget or max(sizes.values()) * z
    draws = defaultdict(int)
    copies = defaultdict(Counter)
    for r in got:
        assert r.mix_tokens == len((r.text or "").split()) and 0 <= r.mix_position <= 1
        draws[r.source] += r.mix_tokens
        copies[r.source][(r.doc_id, r.text)] += 1
    widest = {s: max(len((r[1] or "").split()) for r in rows if r[2] == s) for s in sizes}
    for s, n in sizes.items():
        want = (n / max(sizes.values())) ** a / z * budget
        assert want - 1e-3 * want <= draws[s] <= want + 2 * widest[s] + 1e-3 * want
        given = Counter((r[0], r[1]) for r in rows if r[2] == s)
        each = [copies[s][k] / given[k] for k in given]
        assert max(each) - min(each) <= 1
        if target.budget is None:
            assert min(each) >= 1
    assert copies["empty"] == Counter({(9000, None): 1, (9001, " "): 1})
    # Within an epoch no row is drawn twice, and epochs differ in their order.
    seen = Counter((r.source, r.mix_epoch, r.doc_id, r.text) for r in got)
    assert max(seen.values()) <= 2  # the one repeated row


def test_exponents(spark):
    sizes = {"a": 1000, "b": 300, "c": 10, "d": 1}
    shares = spark.createDataFrame([(n, n / 1000) for n in sizes.values()], "tokens bigint, share double")
    for target in (Target(), Target(entropy=0.5), Target(repetitions=7.0, budget=1500), Target(entropy=0.99)):
        assert mixing.find_exponent(shares, target) == pytest.approx(plain_exponent(sizes, target), abs=1e-7)
    assert mixing.find_exponent(shares, Target(entropy=1.5)) == 0
    assert mixing.find_exponent(shares.limit(0), Target()) == 0


def test_empty_table_and_order(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    assert mixing.mixture(df.limit(0)).count() == 0
    got = mixing.mixture(df, Target(repetitions=4.0), block_tokens=300)
    again = mixing.mixture(df.repartition(7), Target(repetitions=4.0), block_tokens=300)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    first = [r.doc_id for r in got.where("source = 'c' and mix_epoch = 0").orderBy("mix_position", "mix_order").collect()]
    second = [r.doc_id for r in got.where("source = 'c' and mix_epoch = 1").orderBy("mix_position", "mix_order").collect()]
    assert first != second[:len(first)]
    assert mixing.mixture(df.where("source = 'empty'")).count() == 2
    assert got.where(F.col("source").isNull()).count() >= 15
