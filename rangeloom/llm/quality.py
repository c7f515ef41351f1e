"""Quality rules decided by a linear-chain conditional random field over lines.

Each line that holds a word becomes a feature vector.  A two-state chain
(content, boilerplate) labels a document's lines by Viterbi decoding, and the
share of words on content lines decides whether the document stays.  The chain's
weights are trained by maximum likelihood on a bounded sample of labelled
documents: `train_rows` of them at most, those with the smallest hash of their id, as long
as they have `train_lines` lines between them; every line takes its document's label.

Edge cases: null and empty texts have no words, so they fail the base rules.
Repeated rows give repeated results.  Without labels of both kinds there is
nothing to learn from, and documents are kept exactly if they pass the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, mix, slices, windows

SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
CONTENT_SHARE = 0.5
TRAIN_ROWS, TRAIN_LINES = 2000, 200_000

_SYMBOL, _UPPER, _LETTER, _DIGIT, _STOP = (np.zeros(256, dtype=bool) for _ in range(5))
_SYMBOL[list(SYMBOLS.encode())] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_STOP[list(b".!?:;\"')")] = True

FEATURES = ("bias", "length", "symbols", "capitals", "letterless", "shouts", "repetition", "unended", "copy", "digits")


def _prefix(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs more than once, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, shared = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    return shared, again


def measure(w: Words) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base figures of each row; for each line with a word: its row, its words and its features."""
    buf = w.buf
    lead = (buf & 0xC0) != 0x80
    hashes = w.hashes()
    word_bytes = np.zeros(len(buf) + 1, np.int64)
    np.add.at(word_bytes, w.starts, 1)
    np.add.at(word_bytes, w.ends, -1)
    inside = np.cumsum(word_bytes)[:-1] > 0
    chars, symbols = _prefix(lead & inside), _prefix(_SYMBOL[buf])
    n_words = w.counts()
    per_row = lambda prefix: prefix[w.offsets[1:]] - prefix[w.offsets[:-1]]

    cover = np.zeros(len(w) + 1, np.int64)
    whole = w.whole(REPEAT_WINDOW)
    at = np.flatnonzero(whole)
    if len(at):
        keys = mix(windows(hashes, REPEAT_WINDOW)[at] + w.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = at[_repeats(keys)[0]]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + REPEAT_WINDOW, -1)
    repeated = _prefix(np.cumsum(cover[:-1]) > 0)

    # A line starts at a row's start or after a line feed; words find their line by position.
    begins = np.unique(np.concatenate([w.offsets[:-1], np.flatnonzero(buf == 10) + 1]))
    line_of_word = np.searchsorted(begins, w.starts, side="right") - 1
    held, first = np.unique(line_of_word, return_index=True)
    last = np.append(first[1:], len(w)) - 1 if len(first) else first
    lo = begins[held]
    hi = np.append(begins[1:], len(buf))[held] if len(held) else lo
    row = w.row[first]
    hi = hi - ((hi > lo) & (hi > 0) & (buf[np.maximum(hi - 1, 0)] == 10)) if len(held) else hi
    line_key = mix(Words.span_hashes(w.sums(), lo, hi) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    copied = _repeats(line_key)[1]
    words = last - first + 1

    figures = {
        "n_words": n_words,
        "word_chars": per_row(chars),
        "n_symbols": per_row(symbols),
        "n_dup_lines": np.bincount(row[copied], minlength=w.rows).astype(np.int64),
        "n_repeat_words": repeated[w.first[1:]] - repeated[w.first[:-1]],
    }
    span = lambda flags: (lambda p: (p[hi] - p[lo]).astype(float))(_prefix(flags))
    letters, size = _prefix(_LETTER[buf]), np.maximum(1.0, hi - lo)
    bare = _prefix(letters[w.ends] == letters[w.starts])
    new = np.ones(len(w), bool)
    new[_repeats(mix(hashes + line_of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))[1]] = False
    fresh = _prefix(new)
    share = lambda prefix: (prefix[last + 1] - prefix[first]) / words
    features = np.stack(
        [
            np.ones(len(held)),
            np.log1p(words) / 5,
            np.minimum(1.0, 3 * span(_SYMBOL[buf]) / size),
            span(_UPPER[buf]) / np.maximum(1.0, span(_LETTER[buf])),
            share(bare),
            np.minimum(1.0, span(buf == 33) / words),
            1 - share(fresh),
            1.0 - _STOP[buf[w.ends[last] - 1]] if len(held) else np.zeros(0),
            copied.astype(float),
            span(_DIGIT[buf]) / size,
        ],
        axis=1,
    )
    return figures, row, words, features


def _padded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences longest first: for sorted row numbers, each sequence's start and length."""
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(rows)))
    order = np.argsort(-lengths, kind="stable")
    return starts[order], lengths[order]


def viterbi(rows: np.ndarray, scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best label of each line; scores: lines x 2, moves[a, b]: score of b after a.
    All sequences advance together, longest first; ties go to label 0."""
    starts, lengths = _padded(rows)
    out = np.zeros(len(rows), np.int64)
    if not len(rows):
        return out
    back = np.zeros((len(rows), 2), np.int8)
    best = scores[starts].copy()
    for t in range(1, int(lengths[0])):
        n = int(np.searchsorted(-lengths, -t, side="left"))  # sequences longer than t
        at = starts[:n] + t
        both = best[:n, :, None] + moves[None]
        back[at] = both.argmax(1)
        best[:n] = both.max(1) + scores[at]
    state = best.argmax(1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        at = starts[:n] + t
        out[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return out


def train_chain(rows: np.ndarray, x: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.1, ridge: float = 1e-3, most_move: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 2) and moves (2 x 2) that maximize the likelihood of labels y,
    sequences weighted so that both labels count alike; moves stay within +-most_move so
    that a run of one label never outweighs any evidence."""
    starts, lengths = _padded(rows)
    by_start = np.argsort(starts)
    reach = [starts[: int(np.searchsorted(-lengths, -t, side="left"))] + t for t in range(int(lengths[0]))]
    label = y[starts]
    weight = (0.5 / np.bincount(label, minlength=2))[label] / lengths
    of_line = np.repeat(weight[by_start], lengths[by_start])
    inner = np.flatnonzero(rows[1:] == rows[:-1])
    pairs_seen = np.zeros((2, 2))
    np.add.at(pairs_seen, (y[inner], y[inner + 1]), of_line[inner])
    gain = x.T @ (np.eye(2)[y] * of_line[:, None])
    w, m = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(m), np.zeros_like(w), np.zeros_like(m)]
    log_add = np.logaddexp
    for step in range(1, steps + 1):
        s = x @ w
        fore, rear = s.copy(), np.zeros_like(s)
        for at in reach[1:]:
            before = fore[at - 1]
            fore[at] += log_add(before[:, :1] + m[0], before[:, 1:] + m[1])
        for at in reversed(reach[1:]):
            after = s[at] + rear[at]
            rear[at - 1] = log_add(after[:, :1] + m[:, 0], after[:, 1:] + m[:, 1])
        ends = starts + lengths - 1
        whole = log_add(fore[ends, 0], fore[ends, 1])
        total = np.repeat(whole[by_start], lengths[by_start])
        odds = np.exp(fore + rear - total[:, None]) * of_line[:, None]
        joint = np.exp(fore[inner][:, :, None] + m + (s + rear)[inner + 1][:, None, :] - total[inner][:, None, None]) * of_line[inner][:, None, None]
        for k, grad in enumerate((gain - x.T @ odds - ridge * w, pairs_seen - joint.sum(0) - ridge * m)):
            moments[k] = 0.9 * moments[k] + 0.1 * grad
            moments[k + 2] = 0.99 * moments[k + 2] + 0.01 * grad**2
            move = rate * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 2] / (1 - 0.99**step)) + 1e-8)
            if k:
                m = np.clip(m + move, -most_move, most_move)
            else:
                w = w + move
    return w, m


def _line_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in slices(batch.column("text")):
            _, row, _, x = measure(w)
            parts = np.split(x, np.searchsorted(row, np.arange(1, w.rows)))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("quality")[a:b]), pa.array([p.tobytes() for p in parts], pa.binary())], names=["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_lines: int = TRAIN_LINES):
    """Weights learnt from at most `train_rows` labelled documents of `train_lines` lines in all, or None."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # only ids are ranked; the texts of the chosen few are fetched by a join with a list of bounded length
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    chosen = F.broadcast(chosen).join(docs.select("doc_id", F.size(F.split("text", "\n")).alias("lines")), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.sum("lines").alias("lines"))
    # `train_rows` rows at most; a long document ends the sample, its length alone never keeps it out
    before = F.sum("lines").over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, -1))
    chosen = chosen.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") == 0) | (F.col("before") + F.col("lines") <= train_lines))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "quality")), "doc_id").select("quality", "text").mapInArrow(_line_features, "quality int, x binary").collect()
    rows = [r for r in rows if r.x]
    if len({int(r.quality > 0) for r in rows}) < 2:
        return None
    xs = [np.frombuffer(r.x).reshape(-1, len(FEATURES)) for r in rows]
    owner = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    y = np.array([int(r.quality > 0) for r in rows])[owner]
    return train_chain(owner, np.concatenate(xs), y)


def annotate(docs: DataFrame, model, content_share: float = CONTENT_SHARE) -> DataFrame:
    """`docs` (which must have text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, content_words and kept added; columns of these names are replaced."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_words", "kept"]
    docs = docs.drop(*added)
    kinds = [T.BooleanType() if c in ("base_failed", "kept") else T.LongType() for c in added]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, kind) for c, kind in zip(added, kinds))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column("text")):
                figures, row, words, x = measure(w)
                n, repeated = figures["n_words"], figures["n_repeat_words"]
                failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
                good = n if model is None else np.bincount(row, words * viterbi(row, x @ model[0], model[1]), w.rows).astype(np.int64)
                kept = ~failed & (good >= content_share * n)
                part = batch.slice(a, b - a)
                values = [*part.columns, *(pa.array(figures[c]) for c in added[:5]), pa.array(failed), pa.array(good), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(values, names=[*part.schema.names, *added])

    return docs.mapInArrow(work, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the base rules and the chain accept, with their columns unchanged."""
    columns = docs.columns
    rest = F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"])
    marked = annotate(docs.select(rest.alias("row"), "text"), fit(docs, labels))
    return marked.where("kept").select(*["text" if c == "text" else F.col(f"row.`{c}`") for c in columns])
