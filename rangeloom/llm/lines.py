"""Line dedup: boilerplate is what many sites share.

Every line's sites go into a HyperLogLog sketch keyed by the line's hash; sketches
merge by aggregation, before and after the shuffle.  Lines whose estimate is clearly
above the threshold are boilerplate; lines near it are counted exactly, over their
distinct (line, site) pairs.  Of a boilerplate line the first occurrence (smallest
doc_id, then position) stays and all others are removed.

Lines end at \\n and are compared as they are.  A line is boilerplate on `threshold` sites;
a line under `short` characters says little, so it must stand on half of all sites as well.
Lines of white space alone are layout and stay.  Only DataFrame functions are used.

The boilerplate lines are few against all lines: they are written and counted, and sent to all
executors up to a bound, so that no task has to gather the places of a line that is everywhere.

Edge cases: a null site is a site of its own.  Null and empty texts have no lines and
stay as they are.  Rows that repeat a doc_id are treated alike; rows without a doc_id
count towards a line's sites but lose no lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import is_small, stash

THRESHOLD, SHORT = 5, 20
LOG_K = 12  # 1.6 % standard error
NEAR = 0.1  # six standard errors


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, site, pos, h, g, short) of each line that is not blank; 96 bits name a line."""
    site = F.coalesce(F.concat(F.lit("s"), F.col("site")), F.lit("n"))
    lines = docs.select("doc_id", site.alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return lines.select("doc_id", "site", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("g"), F.length("line").alias("chars"))


def boilerplate(docs: DataFrame, threshold: int = THRESHOLD, short: int = SHORT) -> DataFrame:
    """(h, g, first): the boilerplate lines of `docs` (doc_id, text, site) and their first occurrence."""
    lines = _keyed(docs)
    sites = docs.select("site").distinct().count()
    need = F.when(F.col("chars") < short, max(threshold, -(-sites // 2))).otherwise(threshold)
    slack = F.greatest(F.lit(1), F.round(NEAR * need))
    spread = lines.groupBy("h", "g").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_K))).alias("sites"),
        F.min(F.struct("doc_id", "pos")).alias("first"),
        F.count("*").alias("n"),
        F.min("chars").alias("chars"),
    )
    spread = spread.where((F.col("n") >= threshold) & (F.col("sites") >= need - slack)).select("h", "g", "first", "sites", need.alias("need"), slack.alias("slack"))
    spread = stash(spread, "spread")
    near = spread.where("sites <= need + slack").select("h", "g", "need", "first")
    near = F.broadcast(near) if is_small(near) else near
    exact = lines.join(near.select("h", "g"), ["h", "g"], "left_semi").groupBy("h", "g").agg(F.countDistinct("site").alias("exactly"))
    sure = spread.where("sites > need + slack").select("h", "g", "first")
    return sure.union(exact.join(near, ["h", "g"]).where("exactly >= need").select("h", "g", "first"))


def drop_boilerplate(docs: DataFrame, site: str = "source", threshold: int = THRESHOLD, short: int = SHORT) -> DataFrame:
    """`docs` (doc_id, text and the site column) with text rewritten; n_lines and n_removed are added."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    docs = docs.select(F.struct(*own).alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col(f"`{site}`").cast("string").alias("site"))
    found = stash(boilerplate(docs, threshold, short), "boilerplate")
    found = F.broadcast(found) if is_small(found) else found
    hits = _keyed(docs).where(F.col("doc_id").isNotNull()).select("doc_id", "pos", "h", "g").join(found, ["h", "g"])
    hits = hits.where(F.struct("doc_id", "pos") != F.col("first")).groupBy("doc_id").agg(F.collect_set("pos").alias("drop"))
    hits = hits.withColumnRenamed("doc_id", "hit_id")
    marked = docs.join(hits, docs.doc_id == hits.hit_id, "left")
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drop", i)), "\n")
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(left)
    n_lines = F.when(F.coalesce(F.col("text"), F.lit("")) == "", 0).otherwise(F.size(lines)).cast("long")
    rest = [F.col(f"row.`{c}`") for c in docs.select("row.*").columns if c not in ("text", "n_lines", "n_removed")]
    return marked.select(*rest, text.alias("text"), n_lines.alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_removed"))


#: The same rule in DuckDB SQL, exact counts throughout; {docs} is a documents table.
SQL = f"""
SELECT doc_id, CAST(count(line) AS BIGINT) AS n_lines, CAST(count(CASE WHEN cut THEN 1 END) AS BIGINT) AS n_removed,
       string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut) AS kept, any_value(source) AS source, any_value(lang) AS lang
FROM (
  SELECT l.doc_id, l.pos, l.line, l.source, l.lang, b.line IS NOT NULL AND NOT (b.d = l.doc_id AND b.p = l.pos) AS cut
  FROM lines l LEFT JOIN (
    SELECT line, min(doc_id) AS d, arg_min(pos, doc_id * 1000000 + pos) AS p
    FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line
    HAVING count(DISTINCT coalesce('s' || source, 'n')) >= CASE WHEN length(line) < {SHORT} THEN greatest({THRESHOLD}, (SELECT (count(DISTINCT coalesce('s' || source, 'n')) + 1) // 2 FROM {{docs}})) ELSE {THRESHOLD} END
  ) b ON l.line = b.line
) GROUP BY doc_id
"""
LINES_SQL = """
SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
       generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
FROM {docs} WHERE text <> ''
"""
