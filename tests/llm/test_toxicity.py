import random
from collections import Counter

import numpy as np
import pytest

from flowloom.llm import toxicity

DOCS = "doc_id bigint, text string, toxic int, score double, _row string, predicted string"
RUDE = ["grobian", "lump", "nasty"]


def corpus(n=700, seed=2):
    rnd = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        text = [f"w{rnd.randrange(300)}" for _ in range(rnd.randint(5, 60))]
        for _ in range(3 * toxic):
            text.insert(rnd.randrange(len(text)), rnd.choice(RUDE) + rnd.choice(["", "en", "ish"]))
        rows.append((k, " ".join(text).title() + ".", 1 - toxic, 0.1, "r", "p"))
        labels.append((k, int(toxic), "x"))
    return rows, labels


def frames(spark, rows, labels):
    return (spark.createDataFrame(rows, DOCS).repartition(4),
            spark.createDataFrame(labels, "doc_id bigint, toxic int, text string"))


def test_held_out_texts_are_told_apart(spark):
    rows, labels = corpus()
    docs, marks = frames(spark, rows, labels)
    model = toxicity.train(docs, marks.where("doc_id % 3 <> 0"), least=3, chance=20.0)
    got = {r.doc_id: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    held = [k for k in got if k % 3 == 0]
    assert sum(got[k].predicted != int(k % 5 == 0) for k in held) <= len(held) * 0.03
    assert all(0 <= r.score <= 1 and len(r.evidence_ids) == len(r.evidence_cosines) for r in got.values())
    toxic = [k for k in held if k % 5 == 0]
    assert all(all(e % 5 == 0 for e in got[k].evidence_ids) for k in toxic)


def test_search_is_exact():
    rnd = random.Random(4)
    vocabulary = {f"t{k}": rnd.uniform(1, 5) for k in range(60)}
    examples = [{f"t{rnd.randrange(60)}": rnd.randint(1, 4) for _ in range(rnd.randint(0, 9))} for _ in range(500)]
    index = toxicity.Index(vocabulary, examples, [k % 2 for k in range(500)], range(500), block=16)
    for k in (1, 7, 1000):
        for _ in range(50):
            query = Counter({rnd.randrange(60): rnd.randint(1, 3) for _ in range(rnd.randint(0, 6))})
            terms, weights = index.vector(query)
            cosine = np.zeros(500)
            for t, w in zip(terms, weights, strict=True):
                for e, x in enumerate(examples):
                    row = dict(zip(*(a.tolist() for a in index.row(e)), strict=True))
                    cosine[e] += w * row.get(int(t), 0.0)
            want = sorted((-round(c, 9), e) for e, c in enumerate(cosine) if c > 0)[:k]
            best, found = index.nearest(terms, weights, k)
            assert len(best) == len(want)
            assert np.allclose([-c for c, _ in want], found, atol=1e-8)


@pytest.mark.parametrize("kind", ["no labels", "one label", "no documents"])
def test_degenerate_tables(spark, kind):
    rows, labels = corpus(40)
    rows += [(None, "no id", 0, 0.0, "", ""), (900, None, 0, 0.0, "", ""), (901, "", 0, 0.0, "", ""), rows[0], (902, "lump " * 50_000, 0, 0.0, "", "")]
    labels += [(None, 1, ""), (3, None, ""), (3, 1, ""), (12345, 1, "")]
    docs, marks = frames(spark, rows, labels)
    if kind == "no documents":
        docs = docs.limit(0)
    marks = marks.limit(0) if kind == "no labels" else marks.where("toxic = 0") if kind == "one label" else marks
    got = toxicity.score(docs, toxicity.train(docs, marks), ["doc_id"]).collect()
    assert len(got) == (0 if kind == "no documents" else len(rows))
    assert all(r.predicted == 0 for r in got)
