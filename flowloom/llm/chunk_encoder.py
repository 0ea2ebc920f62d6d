"""Byte-level BPE over batches of texts, encoding each distinct word-like chunk once.

A pre-tokenizer that splits by the usual byte-level pattern never joins some neighbours: a
letter, digit or punctuation mark and the white space after it, or a letter or digit and the
full stop or comma after it. Text cut at such places encodes to the same ids as the whole text,
so a batch is cut there with array operations, equal chunks are found by sorting, and the
library encodes only chunks that neither this batch nor the worker's memory has had.
"""

import json
import os
from array import array

import numpy as np

WORD, SPACE, STOP, PAIR = 1, 2, 4, 8
BLOCK = 2 << 20  # bytes of text handled at a time
KEPT = 400_000  # chunks in each of the two generations that are remembered


def _classes() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    for c in range(0x21, 0x7F):
        kinds[c] = WORD * chr(c).isalnum()
    kinds[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
    kinds[[ord("."), ord(",")]] = STOP
    kinds[0xC3:0xE0] = PAIR  # first byte of two; none of these is white space
    return kinds


KIND = _classes()
PRINTED = np.zeros(256, bool)
PRINTED[0x21:0x7F] = True


def cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 ``data`` where cutting cannot change its tokens."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    kind, printed = KIND[data], PRINTED[data]
    before2, before, here = kind[:-2], kind[1:-1], kind[2:]
    wide = (before2 == PAIR) & (data[1:-1] >= 0x80)  # the character before has two bytes
    cut = (here == SPACE) & (printed[1:-1] | wide)
    cut |= (here == STOP) & (before == WORD)
    cut |= (data[1:-1] == 0x0A) & printed[:-2] & (here == WORD)
    return np.flatnonzero(cut) + 2


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_padding()
        self.model.no_truncation()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec.get("pre_tokenizer") or {}
        self.by_chunk = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not any(set(" \t\n\r\v\f.,") & set(t["content"]) or t["lstrip"] or t["rstrip"]
                        or t["single_word"] for t in spec.get("added_tokens", []))
        )
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _library(self, texts: list[bytes]) -> list[bytes]:
        found = self.model.encode_batch_fast(
            [text.decode("utf-8") for text in texts], add_special_tokens=False
        )
        return [array("I", one.ids).tobytes() for one in found]

    def _recall(self, chunks: list[bytes]) -> list[bytes]:
        """Packed ids of distinct chunks, from memory or else from the library."""
        if len(self.young) > KEPT:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = [young.get(c) or old.get(c) for c in chunks]
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missing, self._library([chunks[i] for i in missing]), strict=True):
            found[i] = ids
        young.update(zip(chunks, found, strict=True))
        return found

    def _block(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Flat ids and the number of ids of each chunk [start, end)."""
        size = ends - starts
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        words = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
        keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        low = words[starts] & keep[np.minimum(size, 8)]
        high = words[starts + np.minimum(size, 8)] & keep[np.clip(size - 8, 0, 8)]
        mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed ^= mixed >> np.uint64(29)
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9) + size.astype(np.uint64)
        _, first, which = np.unique(mixed, return_index=True, return_inverse=True)
        # Up to 16 bytes, two words and the size are the chunk; what differs stands alone.
        alone = size > 16
        same = first[which]
        alone |= (low != low[same]) | (high != high[same]) | (size != size[same])
        if alone.any():
            own = np.flatnonzero(alone)
            which[own] = len(first) + np.arange(len(own))
            first = np.concatenate([first, own])
        raw = data.tobytes()
        chunks = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        known = self._recall(chunks)
        flat = np.frombuffer(b"".join(known), np.uint32)
        length = np.fromiter(map(len, known), np.int64, len(known)) // 4
        origin = np.cumsum(length) - length
        count = length[which]
        shift = np.repeat(origin[which] - (np.cumsum(count) - count), count)
        return flat[np.arange(len(shift)) + shift], count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``data[offsets[i]:offsets[i + 1]]``, one after the other, and the
        number of ids of each text."""
        if not self.by_chunk:
            raw = data.tobytes()
            found = self._library([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            return (np.frombuffer(b"".join(found), np.uint32),
                    np.array([len(x) // 4 for x in found], np.int64))
        first, last = int(offsets[0]), int(offsets[-1])
        edge = np.zeros(last - first, bool)
        for places in (cuts(data), offsets):
            edge[places[(places >= first) & (places < last)] - first] = True
        begin = np.flatnonzero(edge) + first
        end = np.append(begin[1:], last)
        ids, counts = [], []
        at = 0
        while at < len(begin):
            upto = max(at + 1, int(np.searchsorted(end, begin[at] + BLOCK, "right")))
            lo, hi = int(begin[at]), int(end[upto - 1])
            flat, count = self._block(data[lo:hi], begin[at:upto] - lo, end[at:upto] - lo)
            ids.append(flat)
            counts.append(count)
            at = upto
        total = np.concatenate([[0], *counts]).cumsum()
        per_text = np.diff(total[np.searchsorted(begin, offsets)])
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), per_text
