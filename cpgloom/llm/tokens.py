"""Encoding a corpus with a public byte-level BPE tokenizer (problem 6).

Texts are cut into words by the tokenizer's pattern. The distinct words of a block are encoded
together: an index maps each pair of neighbouring symbols to all its positions in the block, the
ranks of pairs that occur are active, and they are applied in ascending order; each applied pair
updates the lists of the pairs it creates. A merge only ever creates pairs of higher rank, so one
ascending pass gives every word its usual encoding.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

DEFAULT_TOKENIZER = os.environ.get("CPGLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: Fixed: the pattern that the byte-level tokenizers use to cut text into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker remembers; older ones are dropped beyond that and encoded anew.
REMEMBERED_WORDS = 400_000
#: Bytes of text that are encoded as one block.
BLOCK_BYTES = 4 << 20


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in a vocabulary file: printable Latin-1 stands for itself,
    the other bytes for the code points from 256 in order."""
    shown = {b for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(lo, hi + 1)}
    rest = iter(range(256, 512))
    return {chr(b if b in shown else next(rest)): b for b in range(256)}


class PairIndexEncoder:
    """A vocabulary with merges, and the words encoded so far."""

    def __init__(self, vocabulary_file: bytes, remembered: int = REMEMBERED_WORDS):
        model = json.loads(vocabulary_file)["model"]
        ids = model["vocab"]
        stand_in = byte_symbols()
        self.byte_id = [0] * 256
        for c, b in stand_in.items():
            self.byte_id[b] = ids[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.cut = regex.compile(WORD_PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.remembered = remembered

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of distinct, non-empty words by one pass over their common pair index."""
        merges, sym, starts = self.merges, [], []
        byte_id = self.byte_id
        for w in words:
            starts.append(len(sym))
            sym.extend([byte_id[b] for b in w.encode()])
            sym.append(-1)  # no pair crosses this
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[tuple[int, int], list[int]] = {}
        for i in range(n - 1):
            pair = (sym[i], sym[i + 1])
            if pair in merges:
                if pair in places:
                    places[pair].append(i)
                else:
                    places[pair] = [i]
        active = [(merges[p], p) for p in places]
        heapq.heapify(active)
        while active:
            (_, new), pair = heapq.heappop(active)
            a, b = pair
            at = places.pop(pair)
            at.sort()  # leftmost first, as overlapping pairs require
            for i in at:
                if sym[i] != a:
                    continue
                j = nxt[i]
                if sym[j] != b:
                    continue
                sym[i], sym[j] = new, -2
                k = nxt[j]
                nxt[i] = k
                if k < n:
                    prv[k] = i
                    right = (new, sym[k])
                    if right in merges:
                        if right in places:
                            places[right].append(i)
                        else:
                            places[right] = [i]
                            heapq.heappush(active, (merges[right], right))
                h = prv[i]
                if h >= 0:
                    left = (sym[h], new)
                    if left in merges:
                        if left in places:
                            places[left].append(h)
                        else:
                            places[left] = [h]
                            heapq.heappush(active, (merges[left], left))
        out = []
        for s in starts:
            ids = []
            while sym[s] != -1:
                ids.append(sym[s])
                s = nxt[s]
            out.append(tuple(ids))
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of whole texts; a null or empty text has none."""
        cuts = [self.cut(t) if t else () for t in texts]
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        fresh = list({w for ws in cuts for w in ws if w not in known})
        if fresh:
            known.update(zip(fresh, self.encode_words(fresh)))
        return [[i for w in ws for i in known[w]] for ws in cuts]


_encoders: dict[str, PairIndexEncoder] = {}


def _worker_encoder(shared) -> PairIndexEncoder:
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = PairIndexEncoder(shared.value)
    return _encoders[shared.id]


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > BLOCK_BYTES:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


class _Shared:
    """The vocabulary file, broadcast once (its size is fixed: 1.6 MB for byte_bpe_50k)."""

    def __init__(self, df: DataFrame, tokenizer: str):
        with open(tokenizer, "rb") as f:
            data = f.read()
        self.handle = df.sparkSession.sparkContext.broadcast(data)
        self.id = hashlib.sha256(data).hexdigest()

    @property
    def value(self) -> bytes:
        return self.handle.value


def encode_corpus(
    df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER, counts_only: bool = False
) -> DataFrame:
    """``<key>, ids`` (or ``<key>, n_tokens``) of every row, without special tokens; their names in a
    text are ordinary text.

    A null text and an empty text have an empty list (0 tokens). Texts of any length are encoded whole.
    Repeated rows give repeated rows, null keys stay null, other columns are ignored. Large inputs are not shuffled.
    """
    shared = _Shared(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _worker_encoder(shared)
        for batch in batches:
            texts = batch.column("t__").to_pylist()
            for lo, hi in _blocks(texts):
                ids = enc.encode(texts[lo:hi])
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                if counts_only:
                    out = pa.array(sizes)
                else:
                    ends = np.zeros(len(ids) + 1, np.int32)
                    np.cumsum(sizes, out=ends[1:])
                    flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
                    out = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("k__").slice(lo, hi - lo), out], names=[key, name])

    name = "n_tokens" if counts_only else "ids"
    kind = df.schema[key].dataType.simpleString()
    src = spread(df.select(F.col(f"`{key}`").alias("k__"), F.col(f"`{text}`").alias("t__")))
    return src.mapInArrow(run, f"`{key}` {kind}, {name} {'bigint' if counts_only else 'array<int>'}")
