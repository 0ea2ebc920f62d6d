import random
import re

from flowloom.llm import passages, queries

SCHEMA = "doc_id bigint, text string"


def plain(rows, length=50):
    """Brute force over all windows of words."""
    texts = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    seen, found = {}, set()
    for named, one, text in texts:
        words, lines = [], []
        for number, line in enumerate(text.lower().encode().split(b"\n")):
            for word in re.findall(rb"[a-z0-9\x80-\xff]+", line):
                words.append(word)
                lines.append(number)
        name, run = (str(one) if named else "None"), None
        for k in range(len(words) - length + 1):
            key = tuple(words[k : k + length])
            if key in seen:
                if run and k <= run[2] + run[3]:
                    run[3] = k + length - run[2]
                else:
                    if run:
                        found.add(tuple(run))
                    run = [name, lines[k], k, length, *seen[key]]
            else:
                seen[key] = (name, lines[k])
        if run:
            found.add(tuple(run))
    return found


def found_by(df):
    got = passages.repeated_passages(df).collect()
    return [(str(r.doc_id), r.paragraph, r.first_word, r.n_words, str(r.keeper_id), r.keeper_paragraph) for r in got]


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = lambda k: [f"w{rnd.randrange(3000)}" for _ in range(k)]
    planted = [words(rnd.randint(50, 100)) for _ in range(8)]
    rows = []
    for k in range(n):
        parts = [words(rnd.randint(0, 200))]
        for _ in range(rnd.randint(0, 2)):
            passage = rnd.choice(planted)
            cut = rnd.choice([0, 0, 0, 10, 30])
            parts += [passage[cut:], words(rnd.randint(0, 150))]
        flat = [w for part in parts for w in part]
        wrap = rnd.choice([7, 12, 10_000])  # wrapped text, or one long line
        lines = [rnd.choice([" ", ", "]).join(flat[i : i + wrap]) for i in range(0, len(flat), wrap)]
        rows.append((k, "\n".join(lines).title()))
    again = rows[3][1] + "\n" + rows[3][1]
    return rows + [(None, rows[5][1]), (200, again), (201, "x " * 3000), (202, None), (203, ""), rows[7]]


def test_passages_match_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = found_by(spark.createDataFrame(rows, SCHEMA).repartition(5))
        assert sorted(got) == sorted(plain(rows)) and len(got) > 50


def test_the_query_finds_passages_inside_lines_and_in_wrapped_text(spark, tmp_path):
    rnd = random.Random(9)
    words = lambda k: [f"w{rnd.randrange(9000)}" for _ in range(k)]
    inside, wrapped = words(60), words(90)
    rows = [
        (1, " ".join(words(150) + inside + words(150))), (2, " ".join(words(200) + inside + words(90))),
        (3, "\n".join(" ".join(wrapped[i : i + 9]) for i in range(0, 90, 9))),
        (4, "\n".join(" ".join(wrapped[i : i + 13]) for i in range(0, 90, 13))),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_repeated_paragraphs(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.first_word, r.n_words, r.keeper_id) for r in got} == {(2, 200, 60, 1), (4, 0, 90, 3)}


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([(1, "a few words"), (2, None)], SCHEMA)
    assert passages.repeated_passages(df).count() == 0 and passages.repeated_passages(df.limit(0)).count() == 0
