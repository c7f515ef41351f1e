"""Near duplicates by HyperMinHash sketches, banding and exact confirmation.

A document's set holds its distinct shingles of five lower-cased words (the whole
sequence, if it has fewer).  Its sketch deals the shingles' hashes into `REGISTERS`
buckets and keeps of each bucket's least hash the leading-zero count in 6 bits and the
next 10 bits as mantissa; a bucket without shingles borrows the register of another one,
chosen by a fixed sequence, so that short documents band as sharply as long ones.  Four
registers make one band.  Work goes round by round:

1. documents with equal sets become one class, represented by its smallest id;
2. in every bucket of a band all members are compared with one pivot: the smallest member
   first, one chosen by hash in further rounds (as long as much is left to compare), whoever
   is connected with it left out.
   Sketches estimate the similarity (less the chance that registers of different minima
   agree, which depends on both sizes), and what may reach the threshold is confirmed on
   the full sets; confirmed links are contracted to components after each round;
3. a bucket that still holds several components keeps its largest one inside; members
   outside are compared with all members, sketch against sketch in blocks of bounded size.
   Only members with a likely partner are fetched with their sets, once a bucket, and are
   confirmed against each other inside blocks; only confirmed links leave a block.

So rows moved grow with the buckets' sizes, and no pair of a bucket goes unexamined unless
its documents are already connected.  What stays quadratic is arithmetic inside blocks, for
documents of one bucket that are alike but not linked.  A pair at the threshold shares no
band with probability (1 - 0.75^4)^32 = 5e-6; estimates may fall short by `SLACK` = 4.7
standard deviations before a pair is dropped.

Edge cases: null and empty texts have an empty set and are linked with nothing.
Rows that repeat a doc_id are one document; its largest set counts.  Rows without a
doc_id can neither be named by a group nor name one: each is kept, with a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import is_small, stash
from .words import Words, column_bytes, mix, slices, windows

SHINGLE = 5
REGISTERS, BAND, MANTISSA = 128, 4, 10
THRESHOLD_PERCENT = 75
SLACK = 4.7
#: Rounds of pivots, and how many comparisons a bucket's row may cost before a further round is worth it.
PIVOTS, FEW = 3, 16
#: Blocks of sketches by rows, blocks of full sets by shingles, and what one call gets of small blocks.
BLOCK, BLOCK_SHINGLES, DEAL_ROWS, DEAL_SHINGLES = 4096, 1 << 20, 4096, 1 << 20

_U = np.uint64
_ROW = _U(0x9E3779B97F4A7C15)
_SHIFT = _U(64 - (REGISTERS - 1).bit_length())
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
#: Where an empty bucket looks for a full one: a fixed sequence of other buckets for each.
_PROBES = (mix(np.arange(32 * REGISTERS, dtype=np.uint64) + _U(77)) % _U(REGISTERS)).astype(np.int64).reshape(32, REGISTERS)


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all shingles by row, repeats included."""
    h = w.hashes(lower=True)
    at = np.flatnonzero(w.whole(SHINGLE))
    rows, keys = [w.row[at]], [windows(h, SHINGLE)[at]]
    counts = w.counts()
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        if len(short):
            rows.append(short)
            keys.append(mix(windows(h, n)[w.first[short]] + _U(n)))
    row, key = np.concatenate(rows), np.concatenate(keys)
    if len(rows) > 1:
        order = np.argsort(row, kind="stable")
        row, key = row[order], key[order]
    return row, key


def sets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of distinct shingles, in order of row and hash."""
    row, key = shingles(w)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def registers(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """rows x REGISTERS compressed minima; rows without shingles stay 0."""
    least = np.full(rows * REGISTERS, _EMPTY)
    key = mix(key)
    np.minimum.at(least, row * REGISTERS + (key >> _SHIFT).astype(np.int64), key << _U(64) - _SHIFT)
    least = least.reshape(rows, REGISTERS)
    full = least != _EMPTY
    some = np.flatnonzero(full.any(1) & ~full.all(1))
    if len(some):
        own, held, filled = least[some], full[some], full[some].copy()
        for probe in _PROBES:
            take = ~filled & held[:, probe]
            own[take] = own[:, probe][take]
            filled |= take
            if filled.all():
                break
        # documents of very few shingles: the next full bucket
        for r in np.flatnonzero(~filled.all(1)):
            at = np.flatnonzero(held[r])
            gaps = np.flatnonzero(~filled[r])
            own[r, gaps] = own[r, at[np.searchsorted(at, gaps) % len(at)]]
        least[some] = own
    # a float's exponent counts the leading zeros, its fraction starts with the mantissa
    bits = (least | _U(1)).astype(np.float64).view(np.uint64)
    zeros = np.clip(63 - ((bits >> _U(52)).astype(np.int64) - 1023), 0, 63)
    mantissa = (bits >> _U(52 - MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1)
    return np.where(full.any(1)[:, None], zeros << MANTISSA | mantissa, 0).astype(np.uint16)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in slices(batch.column("text")):
            row, key = shingles(w)
            _, first = np.unique(mix(key + row.astype(np.uint64) * _ROW), return_index=True)
            # a set's name: sums over its distinct shingles, in any order
            names = np.zeros((2, w.rows), np.uint64)
            np.add.at(names[0], row[first], mix(key[first]))
            np.add.at(names[1], row[first], mix(key[first] ^ _ROW))
            found = registers(row[first], key[first], w.rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[a:b],
                    pa.array(np.bincount(row[first], minlength=w.rows).astype(np.int64)),
                    pa.array(names[0].view(np.int64)),
                    pa.array(names[1].view(np.int64)),
                    pa.array([x.tobytes() for x in found], pa.binary()),
                ],
                names=["doc_id", "n", "k1", "k2", "regs"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in slices(batch.column("text")):
            row, key = sets(w)
            parts = np.split(key, np.searchsorted(row, np.arange(1, w.rows)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array([x.tobytes() for x in parts], pa.binary())], names=["doc_id", "set"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    per = REGISTERS // BAND
    for batch in batches:
        keys = band_keys(_matrix(batch.column("regs")))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(batch)), per)))], names=["band", "doc"])


def _matrix(column: pa.Array) -> np.ndarray:
    data, at = column_bytes(column)
    return np.frombuffer(data[at[0] : at[-1]].tobytes(), np.uint16).reshape(-1, REGISTERS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key a band: exactly its four registers, scrambled with the band's number."""
    bands = np.ascontiguousarray(regs).view(np.uint64)
    return mix(bands + np.arange(bands.shape[1], dtype=np.uint64) * _ROW).view(np.int64)


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that registers of unlike minima agree, for sets of n and m elements."""
    ratio = np.maximum(n, m) / np.maximum(1, np.minimum(n, m))
    return 0.169919 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2


def likeness(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity estimate of sketches, compared along the last axis, of sets of n and m elements."""
    chance = collisions(n, m)
    return ((a == b).mean(-1) - chance) / (1 - chance)


def likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sketches leave the threshold possible, by the estimate and its deviation and by the sizes alone."""
    # borrowed registers weigh their lenders more: the number of independent ones is smaller
    held = REGISTERS * -np.expm1(-np.minimum(n, m) / REGISTERS)
    rest = REGISTERS - held
    independent = REGISTERS**2 / (held + 3 * rest + rest**2 / np.maximum(1, held))
    p = THRESHOLD_PERCENT / 100
    return (likeness(a, b, n, m) >= p - SLACK * np.sqrt(p * (1 - p) / independent)) & (100 * np.minimum(n, m) >= THRESHOLD_PERCENT * np.maximum(n, m))


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        keep = likely(_matrix(batch.column("a_regs")), _matrix(batch.column("b_regs")), size("a_n"), size("b_n"))
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        da, oa = column_bytes(batch.column("a_set"))
        db, ob = column_bytes(batch.column("b_set"))
        total, i = oa + ob, 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(total, total[i] + (8 << 20), side="right")) - 1)
            na, nb = np.diff(oa[i : j + 1]) // 8, np.diff(ob[i : j + 1]) // 8
            keys = [np.frombuffer(d[o[i] : o[j]].tobytes(), np.uint64) for d, o in ((da, oa), (db, ob))]
            rows = [np.repeat(np.arange(j - i), n) for n in (na, nb)]
            mixed = mix(np.concatenate(keys) + np.concatenate(rows).astype(np.uint64) * _ROW)
            order = np.argsort(mixed, kind="stable")
            same = np.flatnonzero(mixed[order][1:] == mixed[order][:-1])
            both = np.bincount(np.concatenate(rows)[order[same]], minlength=j - i)
            linked = (100 * both >= THRESHOLD_PERCENT * (na + nb - both)) & (both > 0)
            yield batch.slice(i, j - i).select(["a", "b"]).filter(pa.array(linked))
            i = j


def _with(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with columns of both ends added."""
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return pairs


def _checked(df: DataFrame) -> DataFrame:
    """A written table, sent to all executors if it was counted to be small."""
    return F.broadcast(df) if is_small(df) else df


def _fetch(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, set) of the documents `ids` (doc_id); their largest set, if rows repeat an id."""
    return docs.join(_checked(stash(ids.distinct(), "wanted")), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, set binary")


def _blocks(rows: DataFrame, weight: str, limit: int, deal: int) -> DataFrame:
    """Members of buckets (band, weight, outside...) in blocks of `limit` weight: each outsider (left) meets every
    member of its bucket (right) in one block (x, y); many small blocks share one deal, the unit of a call."""
    big = rows.groupBy("band").agg(F.sum(weight).alias("w"), F.sum(F.when(F.col("outside"), F.col(weight))).alias("ow"))
    big = stash(big.where(F.col("ow").isNotNull()), "blocks").select("band", F.ceil(F.col("ow") / limit).cast("int").alias("xs"), F.ceil(F.col("w") / limit).cast("int").alias("ys"))
    total = rows.agg(F.sum(weight)).first()[0] or 0
    rows = rows.join(_checked(big), "band")
    own = lambda parts: F.pmod(F.xxhash64("doc"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = rows.where("outside").withColumn("x", own("xs")).withColumn("y", every("ys")).withColumn("left", F.lit(True))
    right = rows.withColumn("x", every("xs")).withColumn("y", own("ys")).withColumn("left", F.lit(False))
    return left.union(right).drop("xs", "ys").withColumn("deal", F.pmod(F.xxhash64("band", "x", "y"), F.lit(max(1, -(-total // deal)))))


def _pairs(rows: pd.DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """For every block of a deal: its outsiders with likely partners in it, and those partners, as positions in
    `rows`.  A pair that shares an earlier band is left to that one."""
    regs = np.frombuffer(b"".join(rows.regs), np.uint16).reshape(-1, REGISTERS)
    bands = band_keys(regs)
    own_band = (bands == rows.band.to_numpy()[:, None]).argmax(1)
    doc, comp, n, left, outside = (rows[c].to_numpy() for c in ("doc", "component", "n", "left", "outside"))
    order = np.lexsort((rows.y, rows.x, rows.band))
    key = rows[["band", "x", "y"]].to_numpy()[order]
    ends = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(order))
    for a, b in zip(ends, ends[1:]):
        block, found = order[a:b], []
        held = block[~left[block]]
        for i in block[left[block]]:
            # of two outsiders the smaller one finds the other
            j = held[(comp[held] != comp[i]) & (~outside[held] | (doc[held] > doc[i]))]
            if len(j):
                j = j[likely(regs[i], regs[j], n[i], n[j])]
            if len(j) and own_band[i]:
                j = j[~(bands[j, : own_band[i]] == bands[i, : own_band[i]]).any(1)]
            if len(j):
                found.append((i, j))
        if found:
            yield found


def _promising(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of a deal that have a likely partner in their block."""
    hit = np.zeros(len(rows), bool)
    for found in _pairs(rows):
        for i, j in found:
            hit[i] = hit[j] = True
    return rows.loc[hit, ["band", "doc", "component", "n", "outside", "regs"]]


def common(sets: list[np.ndarray], first: int, columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of the first `first` sets with the others: products of incidence matrices,
    some shared elements at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[element] > 1
    owner, element = owner[shared], number[element[shared]]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    columns = max(64, min(columns, (1 << 24) // len(sets)))
    out = np.zeros((first, len(sets) - first), np.float32)
    for a in range(0, int((times > 1).sum()), columns):
        lo, hi = np.searchsorted(element, [a, a + columns])
        held = np.zeros((len(sets), columns), np.float32)
        held[owner[lo:hi], element[lo:hi] - a] = 1
        out += held[:first] @ held[first:].T
    return out.astype(np.int64)


def _across(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one deal: confirmed links of outsiders with members of other components."""
    doc = rows.doc.to_numpy()
    held = rows["set"].to_list()
    out: list[tuple[int, int]] = []
    for found in _pairs(rows):
        ours, theirs = np.array([i for i, _ in found]), np.unique(np.concatenate([j for _, j in found]))
        sets = [np.frombuffer(held[x], np.uint64) for x in (*ours, *theirs)]
        size = np.array([len(x) for x in sets])
        both = common(sets, len(ours))
        union = size[: len(ours), None] + size[None, len(ours) :] - both
        for r, (i, j) in enumerate(found):
            c = np.searchsorted(theirs, j)
            out += [(min(doc[i], doc[x]), max(doc[i], doc[x])) for x in j[100 * both[r, c] >= THRESHOLD_PERCENT * union[r, c]]]
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _links(docs: DataFrame, sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v): those of the distinct pairs (a, b) that sketches leave possible and full sets confirm."""
    hopeful = _with(pairs, sketches, "n", "regs").select("a", "b", "a_n", "b_n", "a_regs", "b_regs").mapInArrow(_likely, "a long, b long")
    hopeful = stash(hopeful, "likely")
    found = stash(_fetch(docs, hopeful.select(F.explode(F.array("a", "b")).alias("doc_id"))), "sets")
    return _with(hopeful, found, "set").select("a", "b", "a_set", "b_set").mapInArrow(_confirm, "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _placed(buckets: DataFrame, found: DataFrame | None) -> DataFrame:
    """Bucket members with their component."""
    if found is None:
        return buckets.withColumn("component", F.col("doc"))
    return buckets.join(_checked(found.withColumnRenamed("node", "doc")), "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def _comparisons(placed: DataFrame) -> int:
    """How many pairs of an outsider and a member of its bucket are left."""
    parts = placed.groupBy("band", "component").agg(F.count("*").alias("c")).groupBy("band").agg(F.sum("c").alias("size"), F.max("c").alias("inner"))
    return parts.agg(F.sum((F.col("size") - F.col("inner")) * F.col("size"))).first()[0] or 0


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For each doc_id of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = stash(docs.mapInArrow(_sketch, "doc_id long, n long, k1 long, k2 long, regs binary"), "sketches")
    docs, filled = docs.where("doc_id IS NOT NULL"), sketches.where("n > 0 AND doc_id IS NOT NULL")
    # only sets that occur twice have to be told; they are combined before they meet
    twice = stash(filled.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "classes")
    member = filled.join(_checked(twice), ["n", "k1", "k2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    reps = member.where("rep = doc_id").select("doc_id", "n", "regs")

    # members of buckets that hold more than one class
    bands = reps.select("doc_id", "regs").mapInArrow(_bands, "band long, doc long")
    shared = bands.groupBy("band").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("band")
    buckets = stash(bands.join(shared, "band"), "buckets")

    found, left, rows = None, 0, buckets.count()
    for pivot in range(PIVOTS):
        placed = _placed(buckets, found)
        if found is not None:
            left, before = _comparisons(placed), left
            if left <= FEW * rows or before and left > before / 2:
                break  # the rest is little work, or no pivot's
        order = F.col("doc") if pivot == 0 else F.xxhash64("doc", "band", F.lit(pivot))
        tops = placed.groupBy("band").agg(F.min(F.struct(order.alias("o"), "doc", "component")).alias("p"), F.min("component").alias("low"), F.max("component").alias("high"))
        tops = stash(tops.where("low <> high").select("band", F.col("p.doc").alias("a"), F.col("p.component").alias("own")), "pivots")
        stars = placed.join(_checked(tops), "band").where("component <> own").select("a", F.col("doc").alias("b")).distinct()
        links = stash(_links(docs, reps, stars), "links")
        if found is not None:
            links = links.union(found.select(F.col("node").alias("u"), F.col("component").alias("v")))
        found = stash(components(links), "components")

    # buckets that are still in several components: outsiders against everyone, in blocks
    placed = stash(_placed(buckets, found), "placed")
    parts = placed.groupBy("band", "component").agg(F.count("*").alias("c"))
    inner = parts.groupBy("band").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("band", F.col("m.component").alias("inner"))
    open_ = placed.join(_checked(stash(inner, "open")), "band").select("band", "doc", "component", (F.col("component") != F.col("inner")).alias("outside"))
    open_ = stash(open_.join(reps.withColumnRenamed("doc_id", "doc"), "doc").select("band", "doc", "component", "n", "outside", "regs", F.lit(1).alias("one")), "open")
    member_row = "band long, doc long, component long, n long, outside boolean, regs binary"
    hopeful = _blocks(open_, "one", BLOCK, DEAL_ROWS).groupBy("deal").applyInPandas(_promising, member_row)
    hopeful = stash(hopeful.dropDuplicates(["band", "doc"]), "promising")
    held = _fetch(docs, hopeful.select(F.col("doc").alias("doc_id"))).withColumnRenamed("doc_id", "doc")
    # a small set counts as 256 shingles, so that a block never holds more than BLOCK sets
    deals = _blocks(hopeful.join(held, "doc").withColumn("weight", F.greatest("n", F.lit(BLOCK_SHINGLES // BLOCK))), "weight", BLOCK_SHINGLES, DEAL_SHINGLES)
    more = stash(deals.groupBy("deal").applyInPandas(_across, "u long, v long").distinct(), "links")
    if not more.isEmpty():
        found = components(more.union(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))

    # one row a document, whatever has no set included
    placed = member.select("doc_id", "n", "rep").join(_checked(stash(found.withColumnRenamed("node", "rep"), "components")), "rep", "left")
    placed = placed.select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    rows = placed.union(sketches.where("n = 0 AND doc_id IS NOT NULL").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    result = rows.groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id"))
    result = result.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = sketches.where("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return result.union(nameless)


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` without all but one document of each group, with their columns unchanged."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("gone_id"))
    return docs.join(_checked(stash(gone, "gone")), docs.doc_id == F.col("gone_id"), "left_anti")


#: The same groups in DuckDB SQL, from all pairs that share a shingle.
SQL = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {SHINGLE}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - {SHINGLE - 1}))) AS i FROM split WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= {THRESHOLD_PERCENT} * (x.n + y.n - c)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM split
  UNION
  SELECT r.doc_id, l.v FROM reach r JOIN (SELECT u, v FROM links UNION ALL SELECT v, u FROM links) l ON l.u = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""
