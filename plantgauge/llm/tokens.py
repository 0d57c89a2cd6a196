"""Byte-level BPE over a whole corpus with a pair occurrence index per Arrow batch.

The pretokens of a batch that were not seen before are laid out as one sequence of ids. An index maps each adjacent
pair to all its positions in the sequence; ranks that occur are taken in ascending order, all positions of the pair
are merged, and the lists of the neighbouring pairs are updated. Pretokens never touch, so one ascending pass over the
ranks does for all of them what a loop over each would.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread_out

#: Fixed value: the public byte-level split pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(printable))
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class PairIndexEncoder:
    """Encodes texts with the vocabulary and merge list of a `tokenizers` BPE file."""

    def __init__(self, path: str, remember: int = 500_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        alphabet = byte_alphabet()
        self.bytes = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.split = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}
        self.remember = remember

    def _merge(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        starts = np.cumsum([0, *map(len, raw)])
        ids = self.bytes[np.frombuffer(b"".join(raw), np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for s in starts[:-1].tolist():
            before[s] = -1
        for e in starts[1:].tolist():
            after[e - 1] = n
        merges = self.merges
        index: dict[int, list[int]] = {}
        result: dict[int, tuple[int, int, int]] = {}
        for i in range(n):
            j = after[i]
            if j < n and (m := merges.get((ids[i], ids[j]))):
                if m[0] in index:
                    index[m[0]].append(i)
                else:
                    index[m[0]], result[m[0]] = [i], (ids[i], ids[j], m[1])
        ranks = list(index)
        heapq.heapify(ranks)
        while ranks:
            rank = heapq.heappop(ranks)
            places = index.pop(rank)
            left, right, new = result[rank]
            places.sort()
            for i in places:
                j = after[i]
                if j >= n or ids[i] != left or ids[j] != right:
                    continue  # merged into something else meanwhile
                ids[i] = new
                ids[j] = -1
                k = after[j]
                after[i] = k
                pairs = []
                if k < n:
                    before[k] = i
                    pairs.append((i, new, ids[k]))
                if (h := before[i]) >= 0:
                    pairs.append((h, ids[h], new))
                for at, a, b in pairs:
                    if m := merges.get((a, b)):
                        if m[0] in index:
                            index[m[0]].append(at)
                        else:
                            index[m[0]], result[m[0]] = [at], (a, b, m[1])
                            heapq.heappush(ranks, m[0])
        return [[x for x in ids[a:b] if x >= 0] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; an empty list for empty and for null texts."""
        parts = [self.split.findall(t) if t else [] for t in texts]
        fresh = list({w for p in parts for w in p if w not in self.known})
        if len(self.known) + len(fresh) > self.remember:
            self.known = {}
            fresh = list({w for p in parts for w in p})
        if fresh:
            self.known.update(zip(fresh, self._merge(fresh), strict=True))
        known = self.known
        return [[i for w in p for i in known[w]] for p in parts]


def encode_corpus(documents: DataFrame, path: str, text: str = "text", key: str = "doc_id", batch_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, ids array<int>): the ids of each text without special tokens; their strings are ordinary text.

    Empty and null texts give an empty list, whatever the key; every row comes out, repeated rows too. Texts of any length are
    encoded whole. `path` is the `tokenizers` file of the vocabulary, to be found at the same place on every
    executor. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder(path)

        def encoded(keys: list, texts: list) -> pa.RecordBatch:
            ids = encoder.encode(texts)
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= batch_chars:
                    yield encoded(keys[start : i + 1], texts[start : i + 1])
                    start, size = i + 1, 0
            if start < len(texts):
                yield encoded(keys[start:], texts[start:])

    return spread_out(documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInArrow(run, "doc_id long, ids array<int>")
