"""BPE encoding and decoding by batched merge rounds.

The symbols of many words lie in one flat array. A round finds the merge rank of each pair of
neighbours by binary search over the sorted pair keys, takes the lowest rank of every word, and
merges all its places at once; words without a mergeable pair leave the array. After a round only
pairs beside a merge are looked up again. Where the product of a merge could itself merge at a
lower rank, only the first place is merged, so that the result is always that of one merge at a
time.

Texts are cut at blanks, which no word of such a tokenizer spans, and each distinct chunk is
encoded once while a worker's store of chunks lasts. Normalisation and the cutting of chunks into
words are the tokenizer file's own.
"""

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.base import text_or_empty

NEVER = np.iinfo(np.int32).max
CHUNKS = re.compile(r"[^ \t\n\r]+")
BLANK = re.compile(r"[ \t\n\r]")
PIECE = 1 << 20  # characters, or tokens, handled at a time
STORE = 300_000  # chunks a worker remembers,
HELD = 16 << 20  # and their characters


class Merges:
    """The merge list of a tokenizer, as sorted pair keys with ranks and products."""

    def __init__(self, left: np.ndarray, right: np.ndarray, product: np.ndarray):
        keys = left.astype(np.int64) << 32 | right
        order = np.argsort(keys, kind="stable")
        # Of a pair that is listed twice, the last place counts.
        last = np.append(keys[order][1:] != keys[order][:-1], True) if len(order) else np.zeros(0, bool)
        self.keys, self.rank = keys[order][last], order[last].astype(np.int32)
        self.product = product.astype(np.int64)
        size = int(max(left.max(initial=0), right.max(initial=0), product.max(initial=0))) + 1
        lowest = np.full(size, NEVER)
        np.minimum.at(lowest, left, np.arange(len(left)))
        np.minimum.at(lowest, right, np.arange(len(right)))
        self.one_by_one = lowest[product] <= np.arange(len(product))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NEVER, np.int32)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NEVER)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of all words one after the other, and how many each has."""
        symbols, word = symbols.astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(symbols), NEVER, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        finished = []
        while len(symbols):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(start, len(word)))
            lowest = np.minimum.reduceat(rank, start)
            ended = lowest == NEVER
            if ended.any():
                gone = np.repeat(ended, size)
                finished.append((word[gone], symbols[gone]))
                symbols, word, rank = symbols[~gone], word[~gone], rank[~gone]
                lowest, size = lowest[~ended], size[~ended]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, size))
            # Of places that overlap, every second one from the left; of some merges, the first only.
            fresh = np.append(True, np.diff(hit) != 1)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            first_of_word = np.append(True, word[hit[1:]] != word[hit[:-1]])
            taken = np.where(self.one_by_one[rank[hit]], first_of_word, (np.arange(len(hit)) - run) % 2 == 0)
            hit = hit[taken]
            symbols[hit] = self.product[rank[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            place = hit - np.arange(len(hit))  # of the products, once their second halves are gone
            symbols, word, rank = symbols[stay], word[stay], rank[stay]
            touched = np.concatenate([place, place[place > 0] - 1])
            rank[touched] = NEVER
            touched = touched[touched + 1 < len(word)]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched] = self.ranks(symbols[touched], symbols[touched + 1])
        if not finished:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*finished, strict=True))
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(lengths))


class WordBpe:
    """A tokenizer file with words split at blanks, byte symbols and an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, added = said["model"], said["added_tokens"]
        steps = [step["type"] for step in (said["pre_tokenizer"] or {}).get("pretokenizers", [])]
        special = all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in added)
        if model["type"] != "BPE" or steps != ["Split", "ByteLevel"] or not special or said["decoder"]:
            raise ValueError(f"{path} is no word BPE file without a decoder")
        library = Tokenizer.from_file(path)
        self.normalise, self.words = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [merge if isinstance(merge, list) else merge.split(" ") for merge in model["merges"]]
        self.merges = Merges(*(np.array([vocab[x] for x in part], np.int64) for part in (
            [a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs])))
        single = [t for t in vocab if len(t) == 1]
        self.symbol, self.last = np.full((2, max(map(ord, single)) + 1), -1, np.int64)
        for t in single:
            self.symbol[ord(t)], self.last[ord(t)] = vocab[t], vocab[t + suffix]
        self.added = {t["content"]: t["id"] for t in added}
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(longest_first)})") if added else None
        names = {i: t for t, i in [*vocab.items(), *self.added.items()]}
        said = [f"{names[i]} ".encode() if i in names else b"" for i in range(max(names) + 1)]
        self.token_size = np.array([len(t) for t in said], np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(said), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.size = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.held = np.zeros(0, np.uint32), 0

    def _parts(self, chunk: str) -> list[str | int]:
        """Words of a chunk, and the ids of the added tokens in it."""
        pieces = self.cut.split(chunk) if self.cut else [chunk]
        parts = []
        for k, piece in enumerate(pieces):
            if k % 2:
                parts.append(self.added[piece])
            elif piece:
                parts += [word for word, _ in self.words(self.normalise(piece))]
        return parts

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after the other, and how many each has."""
        parts = [self._parts(chunk) for chunk in chunks]
        place = {}
        for of in parts:
            for part in of:
                place.setdefault(part, len(place))
        words = [part for part in place if isinstance(part, str)]
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(word) for word in words], np.int64)
        symbols = self.symbol[codes]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[codes[ends]]
        merged, sizes = self.merges.merge(symbols, lengths)
        # Added tokens are words of one symbol.
        size, at = np.ones(len(place), np.int64), np.zeros(len(place), np.int64)
        is_word = np.array([isinstance(part, str) for part in place], bool)
        size[is_word], at[is_word] = sizes, np.cumsum(sizes) - sizes
        at[~is_word] = len(merged) + np.arange(len(place) - len(words))
        flat = np.concatenate([merged, np.array([part for part in place if not isinstance(part, str)], np.int64)])
        used = np.array([place[part] for of in parts for part in of], np.int64)
        counts = np.array([len(of) for of in parts], np.int64)
        of_chunk = np.bincount(np.repeat(np.arange(len(parts)), counts), weights=size[used], minlength=len(parts))
        return _gather(flat, at[used], size[used]).astype(np.uint32), of_chunk.astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after the other, and how many each has."""
        chunks = [CHUNKS.findall(text) for text in texts]
        if len(self.known) > STORE or self.held > HELD:
            self._forget()
        new = list(dict.fromkeys(c for of in chunks for c in of if c not in self.known))
        if new:
            ids, size = self._learn(new)
            self.known.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.held += sum(map(len, new))
            self.at = np.append(self.at, len(self.ids) + np.cumsum(size) - size)
            self.size, self.ids = np.append(self.size, size), np.append(self.ids, ids)
        used = np.array([self.known[c] for of in chunks for c in of], np.int64)
        counts = np.array([len(of) for of in chunks], np.int64)
        found = _gather(self.ids, self.at[used], self.size[used])
        each = np.add.reduceat(np.append(self.size[used], 0), np.cumsum(counts) - counts) * (counts > 0)
        return found, each

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens of ids, a blank after each; ids without a token have none."""
        ids = ids[ids < len(self.token_size)]
        return _gather(self.token_bytes, self.token_at[ids], self.token_size[ids]).tobytes()


def _gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches ``flat[at : at + size]`` one after the other."""
    shift = at - (np.cumsum(size) - size)
    return flat[np.arange(size.sum()) + np.repeat(shift, size)]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _pieces(texts: Iterable[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Stretches of texts, with the number of the text each is of, up to ``PIECE`` characters
    together. Long texts are cut at blanks."""
    number, held, size = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text) or not text:
            stop = BLANK.search(text, at + PIECE) if len(text) - at > PIECE else None
            end = stop.end() if stop else len(text)
            if held and size + end - at > PIECE:
                yield number, held
                number, held, size = [], [], 0
            number.append(k)
            held.append(text[at:end])
            size += end - at
            at = end
            if not text:
                break
    if held:
        yield number, held


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` (unsigned 32-bit little-endian numbers) and
    ``n_tokens``. No tokens are added before or after a text; strings of added tokens inside a text
    become those tokens. A null text is empty and has no ids. Rows with null or repeated ids are
    encoded like any other; an empty table gives an empty result; other columns are not read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            parts = [[] for _ in range(batch.num_rows)]
            for number, texts in _pieces(text.as_py() for text in batch.column(1)):
                ids, counts = bpe.encode(texts)
                for k, part in zip(number, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    parts[k].append(part.astype("<u4").tobytes())
            found = [b"".join(of) for of in parts]
            counts = [len(of) // 4 for of in found]
            yield pa.record_batch(
                [batch.column(0), pa.array(found, pa.binary()), pa.array(counts, pa.int64())],
                names=["_id", "ids", "n_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    return texts.mapInArrow(work, f"_id {kind}, ids binary, n_tokens bigint").withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """Rows of :func:`encode` with the column ``decoded``: the tokens joined by blanks, as the
    file names no decoder. Added tokens are kept; unknown ids are left out; null ids read as none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                ids = np.frombuffer(ids.as_buffer() or b"", "<u4")
                text = b"".join(bpe.decode(ids[at : at + PIECE]) for at in range(0, len(ids), PIECE))
                texts.append(text[:-1])
            decoded = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.record_batch([*batch.columns, decoded], names=["_id", "ids", "n_tokens", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("_id"), "ids", "n_tokens")
    return rows.mapInArrow(work, f"_id {kind}, ids binary, n_tokens bigint, decoded string").withColumnRenamed("_id", id_col)
