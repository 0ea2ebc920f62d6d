"""Spelling variants by k-d trees over letter counts.

One inserted, deleted or replaced letter changes the letter counts of a word by one up, one down
or both, an L1 distance of at most two. So the words near to a given one lie in the same or a
neighbouring length, within a small box around its counts.

The words of each length are cut into cells by the top of a k-d tree, fitted on a bounded sample.
A word is a member of one cell and a query in every cell whose box it can reach with one letter
more and one less (same length) or with one letter more (next length). In a cell, its members are
the rest of the tree; queries descend it together, box by box, and what they meet in the leaves
is verified letter by letter. Members are held, queries are streamed.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.base import drop_path, stored, text_or_empty
from flowloom.workspace import materialize

CELL = 20_000  # words in a cell, about
PER_CELL = 100  # sampled words for each cell that a length is cut into
SAMPLED = 200_000  # at most, of one length
LEAF = 12
BLOCK = 4096  # queries that descend together
BYTES = 8 << 20  # letters verified at a time
RUN = r"([A-Za-zÀ-ÿ]{%d,})"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Dimension of each Latin-1 letter.
LETTERS = np.zeros(256, np.int64)
LETTERS[ord("a") : ord("z") + 1] = np.arange(26)
LETTERS[0xC0:] = 26 + np.arange(64)
DIMENSIONS = 26 + 64


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Counts of every letter, for words of one length as rows of Latin-1 codes."""
    at = np.arange(len(codes))[:, None] * DIMENSIONS + LETTERS[codes]
    return np.bincount(at.ravel(), minlength=len(codes) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.int32)


class Tree:
    """K-d tree over count vectors: splits in arrays, members in the order of the leaves."""

    def __init__(self, counts: np.ndarray, leaf: int, depth: int = 64):
        self.dim, self.cut, self.low, self.high, self.left, self.right = [], [], [], [], [], []
        self.leaves = []  # members of each
        self.order = np.arange(len(counts))
        box = (np.zeros(DIMENSIONS, np.int64), np.full(DIMENSIONS, np.iinfo(np.int32).max, np.int64))
        self._grow(counts, self.order, box, leaf, depth)
        self.start = np.append(0, np.cumsum([len(m) for m in self.leaves]))
        self.order = np.concatenate(self.leaves)
        self.leaves = None
        for name in ("dim", "cut", "low", "high", "left", "right"):
            setattr(self, name, np.array(getattr(self, name), np.int64))

    def _grow(self, counts: np.ndarray, members: np.ndarray, box: tuple, leaf: int, depth: int) -> int:
        """Number of the new node; leaves are -1 less their number."""
        split = self._split(counts[members]) if len(members) > leaf and depth else None
        if split is None:
            self.leaves.append(members)
            return -len(self.leaves)
        dim, cut = split
        low, high = box
        node = len(self.dim)
        for name, value in (("dim", dim), ("cut", cut), ("low", low[dim]), ("high", high[dim]), ("left", 0), ("right", 0)):
            getattr(self, name).append(value)
        below = counts[members, dim] <= cut
        inner, outer = high.copy(), low.copy()
        inner[dim], outer[dim] = cut, cut + 1
        self.left[node] = self._grow(counts, members[below], (low, inner), leaf, depth - 1)
        self.right[node] = self._grow(counts, members[~below], (outer, high), leaf, depth - 1)
        return node

    @staticmethod
    def _split(counts: np.ndarray) -> tuple[int, int] | None:
        """The letter and count that halve the members best; none if all counts are equal."""
        varied = np.flatnonzero((counts != counts[0]).any(axis=0))
        if not len(varied):
            return None
        part = counts[:, varied]
        middle = np.partition(part, len(part) // 2, axis=0)[len(part) // 2]
        cuts = np.concatenate([middle, middle - 1])
        below = np.concatenate([(part <= middle).mean(axis=0), (part < middle).mean(axis=0)])
        best = int(np.argmax(np.minimum(below, 1 - below)))
        return int(varied[best % len(varied)]), int(cuts[best])

    def reach(self, counts: np.ndarray, more: int, less: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all leaves whose box is within ``more`` added and ``less`` removed
        letters of the query's counts."""
        query, node = np.arange(len(counts)), np.full(len(counts), 0 if len(self.dim) else -1)
        up, down = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        found = []
        while len(query):
            ended = node < 0
            found.append((query[ended], -1 - node[ended]))
            query, node, up, down = query[~ended], node[~ended], up[~ended], down[~ended]
            x, cut = counts[query, self.dim[node]], self.cut[node]
            down_left = down - np.maximum(0, x - self.high[node]) + np.maximum(0, x - cut)
            up_right = up - np.maximum(0, self.low[node] - x) + np.maximum(0, cut + 1 - x)
            a, b = down_left <= less, up_right <= more
            query, node, up, down = (
                np.concatenate([query[a], query[b]]), np.concatenate([self.left[node[a]], self.right[node[b]]]),
                np.concatenate([up[a], up_right[b]]), np.concatenate([down_left[a], down[b]]),
            )
        if not found:
            return query, node
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` become those of ``b`` by one replaced letter (equal lengths) or one
    inserted letter (``b`` longer by one)."""
    width = a.shape[1]
    if b.shape[1] == width:
        return (a != b).sum(axis=1) == 1
    differ = a != b[:, :-1]
    head = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    differ = (a != b[:, 1:])[:, ::-1]
    tail = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return head + tail >= width


def _masks(counts: np.ndarray) -> np.ndarray:
    """Which letters a word has, as 64 bits; wider letters share bits."""
    bits = np.uint64(1) << (np.arange(DIMENSIONS, dtype=np.uint64) % np.uint64(64))
    return np.bitwise_or.reduce(np.where(counts > 0, bits, np.uint64(0)), axis=1)


def _codes(column: pa.Array, length: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].reshape(len(column), length)


class Cell:
    """Members of a cell as the lower part of the tree."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        counts = letter_counts(codes)
        self.tree = Tree(counts, LEAF)
        order = self.tree.order
        self.codes, self.n, self.mask = codes[order], n[order], _masks(counts)[order]

    def near(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) that one edit leads to, block by block."""
        longer = self.codes.shape[1] - codes.shape[1]
        for first in range(0, len(codes), BLOCK):
            part = codes[first : first + BLOCK]
            counts = letter_counts(part)
            query, leaf = self.tree.reach(counts, more=1, less=1 - longer)
            size = self.tree.start[leaf + 1] - self.tree.start[leaf]
            member = np.arange(size.sum()) + np.repeat(self.tree.start[leaf] - np.cumsum(size) + size, size)
            query = np.repeat(query, size)
            alike = np.bitwise_count(_masks(counts)[query] ^ self.mask[member]) <= 2
            query, member = query[alike], member[alike]
            rows = max(1, BYTES // self.codes.shape[1])
            for k in range(0, len(query), rows):
                q, m = query[k : k + rows], member[k : k + rows]
                near = one_edit(part[q], self.codes[m])
                yield q[near] + first, m[near]


ROUTED = "length int, cell int, is_query boolean, code binary, n bigint"


def _route(trees: dict[int, Tree]):
    """Every word as a member of its cell, and as a query of the cells it can reach."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(0).to_numpy()
            for length in np.unique(lengths):
                rows = batch.filter(pa.array(lengths == length))
                counts = letter_counts(_codes(rows.column(1), int(length)))
                for target, is_query, less in ((length, False, 0), (length, True, 1), (length + 1, True, 0)):
                    if target not in trees:
                        row, cell = np.arange(len(counts)), np.zeros(len(counts), np.int64)
                    else:
                        row, cell = trees[target].reach(counts, more=int(is_query), less=less)
                    taken = rows.take(pa.array(row))
                    yield pa.record_batch(
                        [pa.array(np.full(len(row), target, np.int32)), pa.array(cell.astype(np.int32)),
                         pa.array(np.full(len(row), is_query)), taken.column(1), taken.column(2)],
                        names=["length", "cell", "is_query", "code", "n"],
                    )

    return work


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words, from rows sorted by cell with its members first."""
    at, held, cell = None, [], None

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]).astype(np.int64)
        cuts = np.append(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows)
        first = 0
        for end in cuts.tolist():
            yield tuple(keys[:, first].tolist()), batch.slice(first, end - first)
            first = end

    for batch in batches:
        if not batch.num_rows:
            continue
        for (length, number, is_query), rows in groups(batch):
            if at != (length, number):
                at, held, cell = (length, number), [], None
            if not is_query:
                held.append(rows)
                continue
            if held:
                members = pa.Table.from_batches(held).combine_chunks()
                cell = Cell(_codes(members["code"].combine_chunks(), length), members["n"].to_numpy())
                held = []
            if cell:
                yield from _pairs(cell, rows, length)


def _pairs(cell: Cell, rows: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    sizes = pa.compute.binary_length(rows.column(3)).to_numpy()
    for size in np.unique(sizes):
        queries = rows.filter(pa.array(sizes == size))
        codes, n = _codes(queries.column(3), int(size)), queries.column(4).to_numpy()
        for q, m in cell.near(codes):
            # Words of one length are each other's queries; of two lengths, the shorter asks for both.
            sides = [(codes[q], cell.codes[m], cell.n[m])]
            if size != length:
                sides.append((cell.codes[m], codes[q], n[q]))
            for word, near, near_n in sides:
                yield pa.record_batch(
                    [_texts(word), _texts(near), pa.array(near_n)], names=["word", "near", "near_n"]
                )


def _texts(codes: np.ndarray) -> pa.Array:
    """Rows of Latin-1 codes as texts."""
    return pa.array([row.tobytes().decode("latin-1") for row in codes], pa.string())


def corpus_words(
    docs: DataFrame, least_length: int = 6, least_count: int = 5, edit: int = 199,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(word, n): words of at least ``least_length`` letters that occur ``least_count`` times.

    Words are maximal runs of ASCII and Latin-1 letters (from U+00C0 on), with A-Z lower-cased. Where
    ``edit`` divides the CRC-32 of ``<id>:<run>``, a letter is left out (an error planted by
    content, for tests of recall); 0 plants none. A null text is empty, a null id reads as no
    text before the colon; rows that repeat an id or a text count again."""
    text = F.translate(text_or_empty(text_col), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(text, F.lit(RUN % least_length), F.lit(1))).alias("run"),
    )
    word: Column = F.col("run")
    if edit:
        h = F.crc32(F.concat("_id", F.lit(":"), "run"))
        runs = runs.select("run", h.alias("h"))
        gone = (F.col("h") % F.char_length("run")).cast("int")
        cut = F.concat(F.substr("run", F.lit(1), gone), F.substr("run", gone + 2))
        word = F.when(F.col("h") % edit == 0, cut).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).where(F.char_length("word") >= least_length)
    return counted.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def cell_trees(coded: DataFrame) -> dict[int, Tree]:
    """Tops of the trees of the lengths with more than ``CELL`` words, each fitted on at most
    ``SAMPLED`` words, those of least hash."""
    sizes = coded.groupBy("length").agg(F.count("*").alias("n")).where(F.col("n") > CELL).collect()
    trees = {}
    for length, n in sizes:
        cells = -(-n // CELL)
        of_length = coded.where(F.col("length") == length).select("code")
        wanted = min(PER_CELL * cells, SAMPLED)
        sample = of_length.orderBy(F.xxhash64("code"), "code").limit(wanted).toPandas()["code"]
        codes = np.frombuffer(b"".join(map(bytes, sample)), np.uint8).reshape(-1, length)
        trees[length] = Tree(letter_counts(codes), leaf=1, depth=int(np.ceil(np.log2(cells))))
    return trees


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all pairs of distinct words with one letter inserted, deleted or
    replaced, in both directions. ``words``: word (Latin-1 letters, each once) and n."""
    coded, path = stored(
        words.select(F.char_length("word").alias("length"), F.encode("word", "ISO-8859-1").alias("code"), "n"), "coded-words"
    )
    trees = cell_trees(coded)
    routed = coded.mapInArrow(_route(trees), ROUTED)
    found = (
        routed.repartition("length", "cell").sortWithinPartitions("length", "cell", "is_query")
        .mapInArrow(_search, "word string, near string, near_n bigint")
    )
    found = materialize(found, "near-words")
    drop_path(words.sparkSession, path)
    return found


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last word that the links (word, form) lead to from each linked word. The
    links have no cycle; each round doubles how far they reach."""
    links = materialize(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        reached = links.join(onward, "root", "left")
        if not reached.where(F.col("_next").isNotNull()).limit(1).count():
            return links
        links = materialize(reached.select("word", F.coalesce("_next", "root").alias("root")), "forms")


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """One row per row of ``words`` (word, n): ``n_near`` words at one edit; ``form``, the one of
    largest n (of equals, the first in code-point order) if that is at least ``ratio`` times the
    word's n, else null; ``form_n``; ``root``, the last form that following forms leads to. No words
    give no rows."""
    words = materialize(words.select("word", "n"), "words")
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best")
    )
    is_form = -F.col("best.n") >= F.col("n") * ratio
    judged = materialize(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"),
        ),
        "judged-words",
    )
    led = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(led, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
