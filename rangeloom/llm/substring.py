"""Substring dedup by level-wise doubling of repeated word windows.

Level one looks at windows of half the final length.  Of these it keeps, in every
final window, the one with the least hash; equal final windows keep equal halves, so
nothing that repeats is lost, and only about one position in six is shuffled.  Halves
found once are out.  Level two extends the rest: only final windows whose kept half
repeats are hashed, shuffled and compared.  The removal rule needs no longer
windows; repeat_lengths() goes on doubling until no candidates survive.

A word goes if a window over it holds the same words as a window that starts earlier
(smaller doc_id, or same document and earlier start).  Halves are compared by 64-bit
hashes, windows by 96 bits from two chains of word hashes.  Each level first combines what
a slice of the table holds of a window, so that a passage in a third of all documents
costs one row a slice; repeats inside a slice need no shuffle at all.  A level shuffles its
rows once: a window function sees all rows of a hash, and spills what doesn't fit.

Edge cases: null texts have no words; texts shorter than a window lose nothing.  Rows
that repeat a doc_id are one document and should agree in their text; each is returned.  Rows without a doc_id
have no place in the order: they lose nothing, and nothing is lost because of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import stash
from .words import Words, mix, slices, windows

WINDOW = 20
_ROW = np.uint64(0x9E3779B97F4A7C15)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each `span` consecutive values, by doubling."""
    size, out = 1, values
    while size * 2 <= span:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    n = len(values) - span + 1
    return np.minimum(out[:n], out[span - size : span - size + n])


def levels(words: np.ndarray, w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From word hashes: hashes of half windows; starts of whole windows; each one's least half hash."""
    half = window // 2
    halves = windows(words, half)
    at = np.flatnonzero(w.whole(window))
    return halves, at, _least(halves, window - half + 1)[at] if len(at) else np.zeros(0, np.uint64)


def _by_doc(doc_id: pa.Array, row: np.ndarray) -> np.ndarray:
    """An order of positions in which smaller documents come first and their positions keep their order."""
    rank = np.argsort(np.argsort(doc_id.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")[row]
    return np.argsort(rank, kind="stable")


def _anchors(window: int):
    """(half, doc_id, settled, again).  Settled rows are known to repeat inside this slice of the
    table; every half of the slice leaves one row to be compared with other slices."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column("text")):
                halves, at, least = levels(w.hashes(), w, window)
                chosen = np.zeros(len(halves), bool)
                for k in range(window - window // 2 + 1):
                    chosen[at + k] |= halves[at + k] == least
                at = np.flatnonzero(chosen)
                row, key = w.row[at], halves[at]
                _, first, back, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                many = np.flatnonzero(times[back] > 1)
                _, one = np.unique(mix(key[many] + row[many].astype(np.uint64) * _ROW), return_index=True)
                many = many[one]
                settled = np.concatenate([np.zeros(len(first), bool), np.ones(len(many), bool)])
                again = np.concatenate([times > 1, np.ones(len(many), bool)])
                take = np.concatenate([first, many])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[take].view(np.int64)), batch.column("doc_id").slice(a, b - a).take(pa.array(row[take])), pa.array(settled), pa.array(again)],
                    names=["half", "doc_id", "settled", "again"],
                )

    return work


def _extend(window: int):
    """(whole, check, doc_id, start, seen).  Seen windows start earlier in this slice of the table; every
    window of the slice leaves its first place to be compared with other slices."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column("text")):
                hits = batch.column("halves").slice(a, b - a)
                owner = np.repeat(np.arange(b - a), hits.value_lengths().to_numpy(zero_copy_only=False))
                known = mix(hits.flatten().to_numpy().view(np.uint64) + owner.astype(np.uint64) * _ROW)
                known.sort()
                words = w.hashes()
                halves, at, least = levels(words, w, window)
                whole = mix(halves[at] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(halves[at + window - window // 2] + np.uint64(window)))
                key = mix(least + w.row[at].astype(np.uint64) * _ROW)
                slot = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
                live = known[slot] == key if len(known) else np.zeros(len(at), bool)
                at, whole = at[live], whole[live]
                order = _by_doc(batch.column("doc_id").slice(a, b - a), w.row[at])
                at, whole = at[order], whole[order]
                row = w.row[at]
                check = windows(mix(words + _ROW), window)[at].view(np.int64).astype(np.int32)
                doc_id = batch.column("doc_id").slice(a, b - a).to_numpy(zero_copy_only=False)[row]
                start = (at - w.first[row]).astype(np.int32)
                _, first, group = np.unique(whole, return_index=True, return_inverse=True)
                seen = np.ones(len(at), bool)
                seen[first] = False
                # the same place once more, in a repeated row, is no repeat
                same = seen & (doc_id == doc_id[first[group]]) & (start == start[first[group]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[~same]) for x in (whole.view(np.int64), check, doc_id, start, seen)], names=["whole", "check", "doc_id", "start", "seen"]
                )

    return work


def _remove(window: int, texts_too: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column("text")):
                starts = batch.column("starts").slice(a, b - a).fill_null([])
                row = np.repeat(np.arange(b - a), starts.value_lengths().to_numpy(zero_copy_only=False))
                start = starts.flatten().to_numpy()
                inside = start + window <= w.counts()[row]  # a repeated id may have come with a shorter text
                at = (w.first[row] + start)[inside]
                cover = np.zeros(len(w) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                keep = np.cumsum(cover[:-1]) == 0
                kept = np.flatnonzero(keep)
                counts = np.bincount(w.row[kept], minlength=w.rows)
                edge = np.zeros(len(w.buf) + 1, np.int64)
                np.add.at(edge, w.starts[kept], 1)
                np.add.at(edge, w.ends[kept], -1)
                mask = np.cumsum(edge[:-1]) > 0
                # a space behind each kept word that another one of its text follows
                gap = w.ends[kept[:-1]][w.row[kept[1:]] == w.row[kept[:-1]]] if len(kept) else kept
                data = w.buf.copy()
                data[gap], mask[gap] = 32, True
                ends = np.concatenate([[0], np.cumsum(mask)])[w.offsets]
                text = data[mask].tobytes()
                texts = [text[ends[i] : ends[i + 1]] for i in range(w.rows)]
                out = {
                    "doc_id": batch.column("doc_id").slice(a, b - a),
                    "n_words": pa.array(w.counts().astype(np.int64)),
                    "n_removed": pa.array((w.counts() - counts).astype(np.int64)),
                    "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
                }
                if texts_too:
                    out["kept_text"] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return work


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text).  Columns of the right type are taken as they are: a renamed column would keep the
    planner from seeing that the documents' shuffle is the same at both levels."""
    kinds = dict(docs.dtypes)
    typed = lambda c, kind: F.col(c) if kinds[c] == kind else F.col(c).cast(kind).alias(c)
    return docs.select(typed("doc_id", "bigint"), typed("text", "string"))


def _wholes(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The documents by id, and every place of a window whose half at level one repeats."""
    placed = docs.where("doc_id IS NOT NULL").repartition("doc_id")  # shuffled once, read at both levels
    anchors = docs.where("doc_id IS NOT NULL").mapInArrow(_anchors(window), "half long, doc_id long, settled boolean, again boolean")
    # what a slice of the table holds of one half was combined: a half has one row a slice at most
    same = W.partitionBy("half")
    hits = anchors.where("not settled").select("half", "doc_id", "again")
    hits = hits.withColumn("n", F.count("*").over(same)).withColumn("any", F.max("again").over(same)).where("n > 1 or any").select("half", "doc_id")
    hits = hits.union(anchors.where("settled").select("half", "doc_id")).groupBy("doc_id").agg(F.collect_set("half").alias("halves"))
    extended = placed.join(hits, "doc_id").select("doc_id", "text", "halves")
    return placed, extended.mapInArrow(_extend(window), "whole long, check int, doc_id long, start int, seen boolean")


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """For each row of `docs` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and kept_text if `texts`."""
    docs = _rows(docs)
    placed, wholes = _wholes(docs, window)
    low = F.min("doc_id").over(W.partitionBy("whole", "check"))
    later = wholes.where("not seen").select("whole", "check", "doc_id", "start").withColumn("low", low).where("doc_id > low").select("doc_id", "start")
    starts = later.union(wholes.where("seen").select("doc_id", "start")).groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
    joined = placed.join(starts, "doc_id", "left").select("doc_id", "text", "starts")
    joined = joined.union(docs.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts")))
    return joined.mapInArrow(_remove(window, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)


def repeat_lengths(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, length) of documents that hold a repeated window: doubling goes on from `window`, a window of
    twice the length being two that repeat side by side, until no candidates survive; length is the last
    one at which a window of the document occurs at a second place."""
    docs = _rows(docs)
    places = _wholes(docs, window)[1].select("doc_id", F.col("start").cast("long").alias("start"), F.xxhash64("whole", "check").alias("whole")).distinct()
    length, found = window, None
    while True:
        places = stash(places, "places")
        repeated = places.groupBy("whole").count().where("count > 1").select("whole")
        places = stash(places.join(repeated, "whole").select("doc_id", "start", "whole"), "places")
        lasted = places.select("doc_id").distinct().withColumn("length", F.lit(length).cast("long"))
        found = lasted if found is None else found.union(lasted)
        if places.isEmpty():
            return found.groupBy("doc_id").agg(F.max("length").alias("length"))
        tails = places.select("doc_id", (F.col("start") - length).alias("start"), F.col("whole").alias("tail"))
        places = places.join(tails, ["doc_id", "start"]).select("doc_id", "start", F.xxhash64("whole", "tail").alias("whole"))
        length *= 2


#: The same removal in DuckDB SQL, on whole windows.
SQL = f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, start, array_to_string(w[start + 1 : start + {WINDOW}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - {WINDOW - 1})) AS start FROM split WHERE len(w) >= {WINDOW})
), later AS (
  SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY g ORDER BY doc_id, start) AS n FROM places) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, start + k AS pos FROM later, range({WINDOW}) t(k)
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM split
), kept AS (
  SELECT doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone.pos IS NULL) AS text
  FROM words LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""
