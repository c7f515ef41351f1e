"""Packing token sequences into fixed windows by best fit decreasing.

Documents are tokenized, cut at full windows, and dealt by a hash of their id into
groups of about `GROUP_BYTES` of text.  Inside a group the remaining pieces go, longest first, into the
open window with the least room that still holds them; a segment tree over the
amount of room finds it.  A group wastes at most about one window, so the share of
padding does not depend on the size of the corpus.

Edge cases: null and empty texts are one piece that holds the closing id alone.
Repeated rows are packed once each.  An empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix, slices

WINDOW = 4096
GROUP_BYTES = 3 << 20
CACHED_WORDS = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """Token ids of whole texts through a cache of words.  Valid for tokenizers that always
    split at ASCII white space and drop it, so that a text's ids are its words' ids in a row."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Whether words that differ in ASCII case alone have the same ids.
        self.folds = "Lowercase" in json.dumps(json.loads(self.tokenizer.to_str()).get("normalizer"))
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, new])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.at, self.size = np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def encode(self, w, closing: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in a row, each row closed by `closing`; and their number in each row."""
        data = w.buf.tobytes()
        fold = self.folds and not any(x in data for x in self.special)
        hashes = w.hashes(lower=True) if fold else mix(w.hashes() + np.uint64(1))
        known, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHED_WORDS:
            self.keys, self.at, self.size, self.pool = self.keys[:0], self.at[:0], self.size[:0], self.pool[:0]
        slot = np.minimum(np.searchsorted(self.keys, known), max(0, len(self.keys) - 1))
        miss = self.keys[slot] != known if len(self.keys) else np.ones(len(known), bool)
        if miss.any():
            spans = zip(w.starts[first[miss]].tolist(), w.ends[first[miss]].tolist())
            self._learn(known[miss], [data[s:e].decode("utf-8", "replace") for s, e in spans])
        slot = np.searchsorted(self.keys, known)[back]
        # rows' closing ids are pieces of length one behind their last word
        at = np.insert(self.at[slot], w.first[1:], len(self.pool))
        size = np.insert(self.size[slot], w.first[1:], 1)
        pool = np.append(self.pool, closing)
        into = np.cumsum(size) - size
        ids = pool[np.arange(int(size.sum())) + np.repeat(at - into, size)]
        total = np.concatenate([[0], np.cumsum(size)])
        ends = total[w.first[1:] + np.arange(1, w.rows + 1)]
        return ids, np.diff(np.concatenate([[0], ends]))


@cache
def word_tokens(path: str) -> WordTokens:
    """One for each worker process, so that its words outlive a task."""
    return WordTokens(path)


class Rooms:
    """Open windows by remaining room; a segment tree of counts finds the tightest fit."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        k = room + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The (room, window) with the least room that is at least `need`, taken out."""
        count, k = self.count, need + self.leaves
        if not count[k]:
            while k > 1 and not (k % 2 == 0 and count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k + (not count[2 * k])
        room = k - self.leaves
        while k:
            count[k] -= 1
            k >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """For pieces in order of decreasing length: each one's window and offset in it."""
    rooms, made, where, offset = Rooms(window), 0, [], []
    for n in lengths:
        found = rooms.take(n)
        if found is None:
            found, made = (window, made), made + 1
        room, k = found
        where.append(k)
        offset.append(window - room)
        if room > n:
            rooms.add(room - n, k)
    return where, offset


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, closing: int = 2, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Pieces of `docs` (doc_id, text): doc_id, start, length, doc_tokens, sequence_id, offset, and
    `ids`, the piece's token ids as little-endian unsigned 32-bit integers, and ids_crc32."""
    path = tokenizer or default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    groups = max(1, -(-size // group_bytes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        narrow = np.uint16 if tokens.tokenizer.get_vocab_size() <= 1 << 16 and closing < 1 << 16 else np.uint32
        for batch in batches:
            doc_id = batch.column("doc_id")
            for a, b, w in slices(batch.column("text")):
                ids, counts = tokens.encode(w, closing)
                ids = ids.astype(narrow)
                pieces = -(-counts // window)
                row = np.repeat(np.arange(w.rows), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, counts[row] - start)
                ends = np.cumsum(length)
                binary = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(row), [None, pa.py_buffer(np.concatenate([[0], ends]) * ids.itemsize), pa.py_buffer(ids.tobytes())]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [doc_id.slice(a, b - a).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(counts[row]), binary],
                    names=["doc_id", "start", "length", "doc_tokens", "packed"],
                )

    def place(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        width = len(pieces.packed.iloc[0]) // int(pieces.length.iloc[0])
        pieces["ids"] = [np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in pieces.packed]
        pieces["ids_crc32"] = [zlib.crc32(x) for x in pieces.ids]
        pieces = pieces.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        where, pieces["offset"] = best_fit(pieces.length.tolist(), window)
        pieces["sequence_id"] = np.array(where, np.int64) + (int(key[0]) << 32)
        return pieces[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]]

    cut_up = docs.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, packed binary")
    # a document's pieces are dealt one by one, so that one endless document fills many groups
    group = F.pmod(F.xxhash64("doc_id", F.col("start")), F.lit(groups)).cast("long")
    return cut_up.withColumn("bin", group).groupBy("bin").applyInPandas(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
