"""Registered queries of the operators on words, merges and conversations."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm.base import table
from flowloom.llm.merge_rounds import decode, encode
from flowloom.llm.prefix_trie import branched, paths, prefix_trie
from flowloom.llm.spelling import corpus_words, spelling_variants

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts, with the more frequent words that they are spelling variants of."""
    return spelling_variants(corpus_words(table(spark, sf_dir, "documents")))


#: CRC-32 over the bytes of a text, by the usual table of 256 remainders.
OP11_SQL = """
WITH tab AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8),
    lambda c, i: xor(c >> 1, (c & 1) * 3988292384))) AS tab),
run AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{6,}')) AS run FROM documents),
once AS (SELECT id, run, count(*) AS n, hex(encode(coalesce(id, '') || ':' || run)) AS hx FROM run GROUP BY id, run),
hashed AS (SELECT run, n, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(CAST(len(hx) / 2 AS BIGINT)),
    lambda i: CAST('0x' || substr(hx, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
    lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) AS h FROM once, tab),
word AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
    ELSE run END AS word, sum(n) AS n FROM hashed GROUP BY 1),
w AS (SELECT word, CAST(n AS BIGINT) AS n FROM word WHERE length(word) >= 6 AND n >= 5),
del AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
pair AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM del a JOIN del b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM del a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM del a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pair GROUP BY word),
judged AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
    CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best b ON b.word = w.word),
chain AS (
  WITH RECURSIVE up AS (SELECT word, word AS root, 0 AS step FROM judged
    UNION ALL SELECT up.word, j.form, step + 1 FROM up JOIN judged j ON j.word = up.root WHERE j.form IS NOT NULL)
  SELECT word, last(root ORDER BY step) AS root FROM up GROUP BY word)
SELECT j.word, j.form, c.root, j.n, CAST(j.n_near AS BIGINT) AS n_near, j.form_n
FROM judged j JOIN chain c ON c.word = j.word
"""


def op12_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; digests of the ids and of the decoded text."""
    coded = decode(encode(table(spark, sf_dir, "documents"), WORD_BPE), WORD_BPE)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations, with its counts; see ``prefix_trie``."""
    return prefix_trie(branched(paths(table(spark, sf_dir, "conversations"))))


#: CRC-32 of the decimal text of an id: each byte is xored in, then eight bit steps follow.
OP13_CRC = """xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(
    string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, y: CASE WHEN y >= 0 THEN xor(c, y) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"""

OP13_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST) AS turns FROM t GROUP BY conv_id),
cut AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS base, {OP13_CRC} % 4 AS h FROM own),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM cut c LEFT JOIN own b ON b.conv_id = c.base),
member AS (SELECT conv_id, turns, d, turns[1:d] AS node
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
node AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = d), '')) AS ends_sha256,
    CASE WHEN d > 0 THEN len(regexp_extract_all(any_value(turns[d].t), '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words
  FROM member GROUP BY node, d),
kid AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM node n LEFT JOIN kid k ON k.node = n.node),
above AS (SELECT node[1:a] AS node, n_children, n_convs, words
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM full_node)),
total AS (SELECT node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM above GROUP BY node)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
  CAST(n.n_children AS BIGINT) AS n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves,
  CAST(t.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_node n JOIN total t ON t.node = n.node
LEFT JOIN node p ON n.d > 0 AND p.d = n.d - 1 AND p.node = n.node[1:n.d - 1]
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merge_rounds": op12_merge_rounds,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {"op11_spelling_variants": OP11_SQL, "op13_prefix_trie": OP13_SQL}
