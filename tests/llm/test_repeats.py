import hashlib
import random

import pytest

from flowloom.llm import repeats

SCHEMA = "doc_id bigint, text string, gram string, place string, _text string"


def plain(rows, length):
    """Brute force over all windows."""
    order = sorted({(r[0] is not None, r[0] or 0) for r in rows})
    seen, out = set(), []
    for key in order:
        new = set()
        for r in rows:
            if (r[0] is not None, r[0] or 0) != key:
                continue
            data, own = (r[1] or "").encode(), set()
            gone = [False] * len(data)
            for i in range(len(data) - length + 1):
                window = data[i:i + length]
                if window in seen or window in own:
                    gone[i:i + length] = [True] * length
                own.add(window)
            new |= own
            kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
            runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
            out.append((str(r[0]), len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
        seen |= new
    return sorted(out)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé ñ\n", k=rnd.randint(2, 9)))
    passages = ["".join(word() for _ in range(rnd.randint(10, 60))) for _ in range(8)]
    rows = []
    for k in range(n):
        parts = ["".join(word() for _ in range(rnd.randint(0, 30)))]
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            parts.append(p[a:a + rnd.randint(20, 300)])
            parts.append(word() * rnd.randint(0, 3))
        rows.append((rnd.randrange(1000), "".join(parts), "x", "y", "z"))
    rows += [rows[3], rows[3], (rows[5][0], "same id " + rows[5][1], "", "", ""), (None, rows[8][1], "", "", "")]
    rows += [(2000, "a" * 500, "", "", ""), (2001, None, "", "", ""), (2002, "", "", "", ""), (2003, "ab" * 400, "", "", ""),
             (2004, rows[0][1][:99], "", "", ""), (2005, "a" * 100, "", "", "")]
    return rows


@pytest.mark.parametrize("length,block,many", [(100, 1 << 20, 2000), (64, 1 << 20, 3), (100, 1 << 20, 0), (64, 256, 9), (100, 256, 9)])
def test_repeats_match_brute_force(spark, monkeypatch, length, block, many):
    monkeypatch.setattr(repeats, "MANY", many)
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        if block < 1 << 20:  # pieces of long texts, without Spark's workers
            import numpy as np
            import pyarrow as pa

            monkeypatch.setattr(repeats, "BLOCK", block)
            monkeypatch.setattr(repeats, "POSITION", np.uint64(block - 1))
            texts = [r[1] or "" for r in rows]
            batch = pa.record_batch([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["a", "b", "c"])
            got = pa.Table.from_batches(repeats._sample(length)([batch]))
            for k, text in enumerate(texts):
                mine = got.filter(pa.compute.equal(got["_id"], k))
                first, more, _ = repeats._unpack(mine["place"].to_numpy())
                places = sorted(p + j for p, m in zip(first.tolist(), more.tolist(), strict=True) for j in range(m + 1))
                assert places == list(range(max(0, len(text.encode()) - length + 1)))
            continue
        got = repeats.remove_repeats(df, length).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == plain(rows, length)


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_thousands_of_texts_without_an_id_are_told_apart(spark):
    rnd = random.Random(12)
    some = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    rows = []
    for k in range(4000):
        twice = some(120)
        rows.append((None, some(k % 50) + twice + "-" + (twice if k % 2 else some(20)), k % 2 * 120))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    got = repeats.remove_repeats(df).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == sorted((len(r[1]), r[2]) for r in rows)
