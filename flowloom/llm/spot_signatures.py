"""SpotSigs document fingerprints.

A spot signature is a common word together with the chain of content words that follow it,
common words skipped. A text's fingerprint is the set of its signatures; likeness is the Jaccard
similarity of two sets. For the near-duplicate join, sets are partitioned by their length: only
lengths within the threshold of each other can be similar enough, so a set meets its own and the
next partition, through the signatures that fewest sets have, and comparisons stop once the rest
of the two sets cannot reach the threshold.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowloom.llm.base import text_or_empty
from flowloom.llm.components import components
from flowloom.llm.set_join import prefix_items
from flowloom.llm.words import mix, word_ids
from flowloom.workspace import materialize

#: Common words of English, German, French and Spanish that open a chain (fixed values).
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der die ein eine für ist mit nicht und von zu "
    "au avec dans de des du en est et la le les pour que un une "
    "con del el es los las no para por se su y"
)
CHAIN = 2
BITS = 16
ANCHOR_IDS = np.unique(word_ids(np.frombuffer(ANCHORS.encode(), np.uint8))[1])
IS_ANCHOR = np.zeros(1 << BITS, bool)
IS_ANCHOR[(ANCHOR_IDS >> np.uint64(64 - BITS)).astype(np.int64)] = True
BATCH_BYTES = 1 << 20


def signatures(texts: list[str], chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted set of 32-bit signatures of every text.

    Without any whole chain after a common word, every word opens a chain; a text of too few
    words for that has one signature of all its words, and a text without words one of its
    characters. The empty text has none.
    """
    raw = [text.lower().encode() for text in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    starts, ids = word_ids(data) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    ends = np.cumsum([len(x) + 1 for x in raw])
    of = np.searchsorted(ends, starts, "right")
    common = IS_ANCHOR[(ids >> np.uint64(64 - BITS)).astype(np.int64)]
    common[common] = np.isin(ids[common], ANCHOR_IDS)
    content = np.flatnonzero(~common)
    after = np.cumsum(~common)  # content words up to and with a place

    def chains(opens: np.ndarray, words: np.ndarray, first: np.ndarray):
        """Signatures of chains words[first : first + chain], kept inside a text."""
        inside = first + chain <= len(words)
        opens, first = opens[inside], first[inside]
        last = words[first + chain - 1] if len(first) else first
        opens, first = opens[of[last] == of[opens]], first[of[last] == of[opens]]
        value = mix(ids[opens])
        for k in range(chain):
            value = mix(value * np.uint64(31) + ids[words[first + k]])
        return of[opens], value >> np.uint64(32)

    anchors = np.flatnonzero(common)
    where, value = chains(anchors, content, after[anchors])
    has = np.zeros(len(texts), bool)
    has[where] = True
    plain = np.flatnonzero(~has[of])  # words of texts without a chain
    where2, value2 = chains(plain, plain, np.arange(1, len(plain) + 1))
    has[where2] = True
    order = np.argsort(np.concatenate([where, where2]), kind="stable")
    where, value = np.concatenate([where, where2])[order], np.concatenate([value, value2])[order]
    bounds = np.searchsorted(where, np.arange(len(texts) + 1))
    found = []
    for k, text in enumerate(raw):
        if has[k]:
            found.append(np.unique(value[bounds[k] : bounds[k + 1]]))
        elif text:
            own = ids[slice(*np.searchsorted(of, [k, k + 1]))].tobytes() or b"-" + text
            found.append(np.frombuffer(hashlib.sha256(own).digest()[:8], "<u8") >> np.uint64(32))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def as_text(found: np.ndarray) -> str:
    """A fingerprint as a string: eight hexadecimal digits for each signature, ascending."""
    return found.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """(id, ``fingerprint`` as an array of signatures) of every row; a null text is empty."""
    picked = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = picked.schema["_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.astype(np.int64) for x in signatures(batch.column(1).to_pylist(), chain)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["_id", "fingerprint"])

    return picked.mapInArrow(work, f"_id {kind}, fingerprint array<bigint>").withColumnRenamed("_id", id_col)


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, chain: int = CHAIN
) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id`` (the least id that chains of links reach) and
    ``n_links`` (different fingerprints within ``threshold`` of its own).

    Equal fingerprints are one class before anything is compared; texts without signatures form
    a class. Null ids are left out of ``class_id``. An empty table gives an empty result.
    """
    named = materialize(
        fingerprints(docs, id_col, text_col, chain).select(
            F.col(id_col).cast("bigint").alias("_id"), F.xxhash64("fingerprint").alias("_fp"), "fingerprint"
        ),
        "spots",
    )
    sets = materialize(named.groupBy("_fp").agg(F.any_value("fingerprint").alias("s")).where(F.size("s") > 0), "spot-sets")
    # Length partition: lengths in one are within the threshold of each other.
    part = F.floor(F.log(F.size("s").cast("double")) / float(-np.log(threshold)) + 1e-9).cast("int")
    heads = prefix_items(sets, "_fp", "s", threshold).select("_fp", F.col("item").alias("t"))
    lengths = sets.select("_fp", part.alias("part"), F.size("s").alias("len"))
    own = heads.join(lengths, "_fp")
    near = own.select(F.col("_fp").alias("v"), F.col("t"), F.col("len").alias("len_v"), F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"))
    pairs = (
        own.withColumnRenamed("_fp", "u").join(near, ["t", "part"])
        .where((F.col("len") < F.col("len_v")) | ((F.col("len") == F.col("len_v")) & (F.col("u") < F.col("v"))))
        .where(F.col("len") >= threshold * F.col("len_v") - 1e-9).select("u", "v").distinct()
    )
    a, b = (sets.select(F.col("_fp").alias(n), F.col("s").alias(f"_{n}")) for n in ("u", "v"))
    shared = F.size(F.array_intersect("_u", "_v"))
    links = materialize(
        pairs.join(a, "u").join(b, "v")
        .where(shared >= threshold * (F.size("_u") + F.size("_v") - shared) - 1e-9).select("u", "v"),
        "spot-links",
    )
    counted = links.unionAll(links.select("v", "u")).groupBy("u").agg(F.count("*").alias("n_links"))
    roots = components(links)
    rows = named.select("_id", "_fp").join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn(
        "root", F.coalesce("root", "_fp")
    )
    least = rows.groupBy("root").agg(F.min("_id").alias("class_id"))
    return rows.join(least, "root").join(counted.withColumnRenamed("u", "_fp"), "_fp", "left").select(
        F.col("_id").alias(id_col), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def _parts(docs: DataFrame, wanted: int) -> tuple[Column, int]:
    """A partition number that grows with ``_id``, from quantiles of the ids; null ids come first.
    Between two quantiles, ids are cut evenly."""
    coarse = min(wanted, 128)
    fine = -(-wanted // coarse)
    points = [k / coarse for k in range(coarse + 1)]
    marks = docs.agg(F.percentile_approx("_id", points, 10_000)).first()[0]
    if not marks:
        return F.lit(0), 1
    marks = sorted(set(marks))
    if len(marks) == 1:
        return F.lit(0), 1
    bounds = F.array(*[F.lit(x).cast("bigint") for x in marks[1:-1]])
    cell = F.coalesce(F.size(F.filter(bounds, lambda x: x <= F.col("_id"))), F.lit(0))
    low = F.element_at(F.array(*[F.lit(x).cast("double") for x in marks]), cell + 1)
    width = F.element_at(F.array(*[F.lit(float(b) - float(a)) for a, b in zip(marks[:-1], marks[1:], strict=True)]), cell + 1)
    inner = F.least(F.floor((F.col("_id").cast("double") - low) / width * fine), F.lit(fine - 1))
    inner = F.greatest(F.coalesce(inner, F.lit(0)), F.lit(0))
    return (cell * fine + inner).cast("int"), (len(marks) - 1) * fine


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half of its characters
    replaced by as many first ones of the next text, by ascending id (after the last: the first).

    One row per row of ``docs``: id, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``. A null text is empty. Null ids come
    first, rows of equal id are ordered by text; a single row is its own next. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), text_or_empty(text_col).alias("_text"))
    part, count = _parts(texts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = texts.withColumn("_part", part)
    # The first row of each part follows the last row of the part before: one row per part.
    at = F.struct(F.col("_id").isNotNull().alias("known"), F.col("_id").alias("id"))
    first_ids = placed.groupBy(F.col("_part").alias("_p")).agg(F.min(at).alias("_at"))
    first_rows = materialize(
        placed.join(F.broadcast(first_ids), (F.col("_part") == F.col("_p")) & F.col("_id").eqNullSafe(F.col("_at.id")))
        .groupBy("_part").agg(F.min("_text").alias("_text"), F.min("_id").alias("_id")),
        "first-rows",
    )
    used = sorted(r[0] for r in first_rows.select("_part").collect())
    before = spark.createDataFrame(
        [(p, used[k - 1]) for k, p in enumerate(used)], "_part int, _before int"
    )
    follow = first_rows.join(F.broadcast(before), "_part").select(
        F.col("_before").alias("_part"), "_id", "_text", F.lit(True).alias("_follows")
    )
    lined = (
        placed.select("_part", "_id", "_text", F.lit(False).alias("_follows")).unionByName(follow)
        .repartitionById(count, F.col("_part")).sortWithinPartitions("_part", "_follows", "_id", "_text")
    )
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def answer(ids: list, held: list[str]) -> pa.RecordBatch:
        """For all held texts but the last, whose turn comes with its next."""
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(held[:-1], held[1:], strict=True)]
        own, other = signatures(held, chain), signatures(edited, chain)
        columns = [
            pa.array(ids, pa.int64()), pa.array([len(x) for x in held[:-1]], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            pa.array([as_text(x) for x in own[:-1]], pa.string()), pa.array([as_text(x) for x in other], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own[:-1], other, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)], pa.float64()),
        ]
        return pa.record_batch(columns, names=["_id", *names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)
            for one, text, follows in rows:
                held.append(text)
                size += len(text)
                if not follows:
                    ids.append(one)
                if follows or (size >= BATCH_BYTES and len(held) > 1):
                    yield answer(ids[: len(held) - 1], held)
                    # The last text opens the next stretch, unless it only closed a part.
                    ids, held = ([], []) if follows else ([one], [text])
                    size = sum(map(len, held))

    schema = "_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return lined.mapInArrow(work, schema).withColumnRenamed("_id", id_col)
