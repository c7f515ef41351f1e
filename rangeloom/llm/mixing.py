"""Mixing sources to target weights by Pareto order sampling.

Sources share a budget by weight; a source's target stops at `most` times its size and
what is above is shared again among the others (one pass over the sources in order of
size per weight finds where the sharing ends).  A source whose target is r times its size
takes every document floor(r) times for certain.  Of the words that are left, long documents
are expected to bring less than their share, so that none carries the mix: a further copy of a
document of n words has the inclusion probability p = min(1, level / n^(1/4)), the level being
the one at which the expected words are those left (one pass over the source's distinct sizes
finds it).  Where p is 1 that copy is certain, too.

The other documents are a Pareto order sample: with u uniform by a hash of the id, they
rank by odds(u) / odds(p) and are taken in that order until the source's remaining
words are filled, so the sample's size is fixed in words.  `PASSES` times the order is gone
through again with what still fits into the gap that the first document too long for it has
left; one more document, the one whose size comes nearest to the last gap, closes it if that
brings the words nearer to the target.

Ranks need no sort of a whole source: documents fall into bins of the ranking number, as many
as the source's documents call for; bins are summed and accumulated, and only inside a bin is
there an order.

Edge cases: a null source is a source of its own, ordered last.  Null and empty texts
have size 0 and take 0 words.  Rows that repeat a doc_id are drawn alike.  Only
DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import is_small, stash

SHARE_PERCENT, WEIGHTS, MOST = 150, (3, 1, 2), 2
PASSES = 3
BIN_ROWS = 20_000
SEED = "mix"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """(source, size) to (source, rank, size, target); one row a source."""
    by_name = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1)
    named = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("most", F.col("size") * most)
    by_cap = W.orderBy(F.col("most") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("size").over(everything) * (share_percent / 100) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(onward)
    named = named.withColumn("level", level)
    # sources before the first one that its level doesn't fill stand at their limit; the others share evenly
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "rank", "level"))).over(everything)
    named = named.withColumn("free", free)
    at_limit = F.col("free").isNull() | (F.struct(F.col("most") / F.col("weight"), "rank", "level") < F.col("free"))
    target = F.when(at_limit, F.col("most").cast("double")).otherwise(F.col("weight") * F.col("free.level"))
    return named.select("source", "rank", "size", target.alias("target"))


def root4(size: Column) -> Column:
    return F.sqrt(F.sqrt(size.cast("double")))


def levels(by_size: DataFrame) -> DataFrame:
    """(rank, level, free) from (rank, size, c, need), the number of documents by source and size: documents below
    `free` words are certain to bring one more copy, others do so with probability level / size^(1/4)."""
    order = W.partitionBy("rank").orderBy("size")
    held = F.coalesce(F.sum(F.col("c") * F.col("size")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum(F.col("c") * F.col("size") / root4(F.col("size"))).over(order.rowsBetween(0, W.unboundedFollowing))
    found = by_size.where("size > 0").withColumn("level", (F.col("need") - held) / onward).where(F.col("level") <= root4(F.col("size")))
    return found.groupBy("rank").agg(F.min(F.struct("size", "level")).alias("f")).select("rank", F.col("f.level").alias("level"), F.col("f.size").alias("free"))


def probability() -> Column:
    """Of one more copy of a document of `size` words, by its source's level."""
    certain = F.col("level").isNull() | (F.col("size") < F.col("free"))
    return F.when(F.col("size") == 0, 0.0).when(certain, 1.0).otherwise(F.least(F.lit(1.0), F.col("level") / root4(F.col("size"))))


def draw(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, seed: str = SEED) -> DataFrame:
    """For each row of `docs` (doc_id, source, text): doc_id, source, size, source_size, target, probability
    (of a copy beyond the certain ones), copies, taken."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = stash(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
    by_size = stash(sized.groupBy("source", "size").agg(F.count("*").alias("c")), "counts")
    totals = by_size.groupBy("source").agg(F.sum(F.col("c") * F.col("size")).alias("size"), F.sum("c").alias("docs"))
    sources = stash(targets(totals.select("source", "size"), weights, share_percent, most), "targets")
    whole = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("size"), F.lit(0))), F.lit(0)).cast("long")
    sources = sources.select(F.col("source").alias("name"), "rank", F.col("size").alias("source_size"), "target", whole.alias("whole"))
    few = is_small(sources)  # then every table with one row a source may be sent to all executors
    per_source = lambda df: F.broadcast(df) if few else df
    named = lambda df: df.join(per_source(sources), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    by_size = named(by_size).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    found = stash(levels(by_size), "levels")
    bins = named(totals.select("source", "docs")).select("rank", F.ceil(F.col("docs") / BIN_ROWS).alias("bins"))
    sure = F.sum(F.when(probability() >= 1, F.col("c") * F.col("size")).otherwise(0))
    needs = by_size.join(per_source(found), "rank", "left").groupBy("rank").agg((F.first("need") - sure).alias("gap"))
    needs = stash(needs.join(per_source(found), "rank", "left").join(per_source(bins), "rank").select("rank", "level", "free", "bins", "gap"), "needs")

    rows = named(sized).join(per_source(needs.drop("gap")), "rank").withColumn("p", probability())
    rows = rows.withColumn("whole", F.col("whole") + (F.col("p") >= 1).cast("long")).withColumn("part", F.when(F.col("p") < 1, F.col("p")).otherwise(0.0))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    u = (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
    rows = rows.withColumn("u", u).withColumn("q", F.when(F.col("part") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))))
    rows = rows.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * F.col("bins"))).drop("u", "p", "level", "free", "bins")

    done, pool, needs = [rows.where("part <= 0").withColumn("extra", F.lit(0))], rows.where("part > 0"), needs.select("rank", "gap")
    for _ in range(PASSES):
        ranked = stash(_pass(pool, needs, per_source), "pass")
        got = ranked.where("picked").groupBy("rank").agg(F.sum("size").alias("got"))
        needs = stash(needs.join(per_source(got), "rank", "left").select("rank", (F.col("gap") - F.coalesce("got", F.lit(0))).alias("gap")), "gaps")
        done.append(ranked.where("picked").withColumn("extra", F.lit(1)).drop("picked"))
        pool = ranked.where("NOT picked").drop("picked")
    off = F.abs(F.col("gap") - F.col("size"))
    spare = pool.join(per_source(needs), "rank").where(off < F.col("gap"))
    last = spare.groupBy("rank").agg(F.min(F.struct(off.alias("off"), "q", "doc_id")).alias("l")).select("rank", F.col("l.doc_id").alias("last_id"))
    closes = F.coalesce(F.col("doc_id") == F.col("last_id"), F.lit(False))
    done.append(pool.join(per_source(last), "rank", "left").withColumn("extra", closes.cast("int")).drop("last_id"))
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return reduce(DataFrame.unionByName, done).select("doc_id", "source", "size", "source_size", "target", F.col("part").alias("probability"), copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def _pass(pool: DataFrame, needs: DataFrame, per_source: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`pool` with `picked`: in rank order up to the first document that doesn't fit what is left of
    the gap; documents larger than the whole gap are passed over."""
    pool = pool.join(per_source(needs), "rank").withColumn("fit", F.when(F.col("size") <= F.col("gap"), F.col("size")))
    bins = pool.groupBy("rank", "bin").agg(F.sum("fit").alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy("rank").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select("rank", "bin", before.alias("before"))
    inside = W.partitionBy("rank", "bin").orderBy("q", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    ranked = pool.join(bins, ["rank", "bin"]).withColumn("reach", F.col("before") + F.sum("fit").over(inside))
    picked = F.col("fit").isNotNull() & (F.col("reach") <= F.col("gap"))
    return ranked.withColumn("picked", picked).drop("fit", "before", "reach", "gap")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is drawn, columns unchanged."""
    drawn = draw(docs, **options).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"))
    return rows.join(drawn, rows.own_id.eqNullSafe(drawn.doc_id)).select("row", times.alias("time")).select("row.*")


#: The same draw in DuckDB SQL.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM {{docs}}
), named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM sized GROUP BY source
), weighed AS (
  SELECT *, [{', '.join(map(str, WEIGHTS))}][CAST((rank - 1) % {len(WEIGHTS)} + 1 AS INT)] AS weight, {MOST} * size AS most FROM named
), levelled AS (
  SELECT *, (sum(size) OVER () * {SHARE_PERCENT / 100}::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), freed AS (
  SELECT *, (SELECT level FROM levelled WHERE level * weight <= most ORDER BY most / weight, rank LIMIT 1) AS shared,
            row_number() OVER (ORDER BY most / weight, rank) AS place,
            (SELECT count(*) FROM levelled a WHERE (a.most / a.weight, a.rank) < (SELECT (b.most / b.weight, b.rank) FROM levelled b WHERE b.level * b.weight <= b.most ORDER BY b.most / b.weight, b.rank LIMIT 1)) AS limited
  FROM levelled
), targets AS (
  SELECT source, size AS source_size, CAST(CASE WHEN shared IS NULL OR place <= limited THEN most ELSE weight * shared END AS DOUBLE) AS target FROM freed
), needed AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole, target - coalesce(floor(target / nullif(source_size, 0)), 0) * source_size AS need FROM targets
), by_size AS (
  SELECT s.source, s.size, count(*) AS c, any_value(t.need) AS need FROM sized s JOIN needed t ON s.source IS NOT DISTINCT FROM t.source WHERE s.size > 0 GROUP BY s.source, s.size
), filled AS (
  SELECT source, size, (need - coalesce(sum(c * size) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(c * size / sqrt(sqrt(size))) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM by_size
), free AS (
  SELECT source, min(size) AS free, arg_min(level, size) AS level FROM filled WHERE level <= sqrt(sqrt(size)) GROUP BY source
), drawn AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.need, t.whole,
         CASE WHEN s.size = 0 THEN 0 WHEN level IS NULL OR s.size < free THEN 1 ELSE least(1, level / sqrt(sqrt(s.size))) END AS p,
         (CAST(('0x' || substr(md5('{SEED}:' || CAST(s.doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM sized s JOIN needed t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN free f ON s.source IS NOT DISTINCT FROM f.source
), parted AS (
  SELECT * EXCLUDE (whole), whole + CASE WHEN p >= 1 THEN 1 ELSE 0 END AS whole, CASE WHEN p < 1 THEN p ELSE 0 END AS part,
         need - sum(CASE WHEN p >= 1 THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap
  FROM drawn
), pass0 AS (
  SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS q, FALSE AS taken FROM parted
){{passes}}, last AS (
  SELECT *, NOT taken AND part > 0 AND abs(gap - size) < gap AND
         row_number() OVER (PARTITION BY source, NOT taken AND part > 0 AND abs(gap - size) < gap ORDER BY abs(gap - size), q, doc_id) = 1 AS closes
  FROM pass{PASSES}
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN taken OR closes THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM last
"""
_PASS = """, reach{n} AS (
  SELECT *, sum(CASE WHEN part > 0 AND NOT taken AND size <= gap THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) AS reach FROM pass{before}
), picked{n} AS (
  SELECT *, part > 0 AND NOT taken AND size <= gap AND reach <= gap AS picked FROM reach{n}
), pass{n} AS (
  SELECT * EXCLUDE (gap, taken, reach, picked), taken OR picked AS taken, gap - sum(CASE WHEN picked THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM picked{n}
)"""
SQL = SQL.format(docs="{docs}", passes="".join(_PASS.format(n=n, before=n - 1) for n in range(1, PASSES + 1)))
