"""License scans by diagonal voting.

All rolling word k-grams of every text are joined by hash with the positions of the
same k-grams in license templates (words compared again, so no hash decides).  Each
match votes for the diagonal text position - template position.  Votes are summed by
(document, template, diagonal), diagonals at most `DRIFT` words apart are merged, and a
span counts if it covers enough of its template, if it has the same of the words that
tell sibling licenses apart (`TELLING`) as its template, and if no span of another label
covers its own template better at the same place.  `score` is the best share of any
span, whether it counts or not.  A phrase of k words is a template
with a single k-gram: each of its diagonals is a place.

Words are runs of a-z, 0-9 and anything beyond ASCII, after A-Z are lower-cased.  Only
DataFrame functions are used; the template table's size is fixed by the parameter.

Edge cases: null and empty texts have no words, no labels and score 0.  Rows that
repeat a doc_id and its text are one document; another text under the same id, or without
an id, is a document of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import is_small, stash

LONG, SHORT = 4, 2
DRIFT = 3
COVERED = 0.6
MAX_TEMPLATE_WORDS = 20_000

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Wordings of well-known notices and license texts, several passages each, and their labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed the gnu general public license is a free copyleft license for software and other kinds of works": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "you can redistribute it and or modify it under the terms of the gnu library general public license": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software": "zlib",
    "licensed under cc by nc 4 0": "cc-by-nc",
}
#: Words that make another license of a notice that has them.
TELLING = frozenset("lesser library affero sharealike noncommercial noderivatives noderivs nc nd sa".split())

_SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def gram_rows(phrases: dict[str, str], templates: dict[str, str]) -> list[tuple]:
    """(template, label, base, length, k, position, words...) of every k-gram."""
    rows = []
    for number, (text, label, base) in enumerate([(t, x, True) for t, x in phrases.items()] + [(t, x, False) for t, x in templates.items()]):
        words = _SPLIT.findall(text.lower())
        k = LONG if len(words) >= LONG else SHORT
        if len(words) < SHORT or base and len(words) != k:
            raise ValueError(f"a phrase needs {SHORT} or {LONG} words, a template {LONG} at least: {text!r}")
        rows += [(number, label, base, len(words), k, i, *(words[i : i + k] + [""] * (LONG - k))) for i in range(len(words) - k + 1)]
    if len(rows) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words are too large to be sent to every executor")
    return rows


def _values(rows: list[tuple]) -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x).lower()
    return ", ".join(f"({', '.join(map(quote, r))})" for r in rows)


def _grams(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    table = spark.sql(f"SELECT * FROM VALUES {_values(gram_rows(phrases, templates))} AS t(tpl, label, base, len, k, tpos, t0, t1, t2, t3)")
    return table.withColumn("key", F.xxhash64("t0", "t1"))


def matches(docs: DataFrame, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """(doc_id, txt, template, diagonal, votes...) of `docs` (doc_id, text, txt); rows without a template hold the rest of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # lower() is fast; the one character that it would turn into an ASCII letter takes the slow way
    low = F.when(text.contains("K"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    words = docs.select("doc_id", "txt", F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)).alias("w"))
    rolled = F.arrays_zip("w", *[F.slice("w", F.lit(i + 1), F.size("w")).alias(f"w{i}") for i in range(1, LONG)])
    at = words.select("doc_id", "txt", F.posexplode_outer(rolled).alias("pos", "g"))
    at = at.select("doc_id", "txt", "pos", F.col("g.w").alias("w0"), *[F.col(f"g.w{i}") for i in range(1, LONG)])
    grams = _grams(docs.sparkSession, phrases, templates)
    same = (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))
    longer = (F.col("k") == SHORT) | (F.col("w2") == F.col("t2")) & (F.col("w3") == F.col("t3"))
    # bounded by MAX_TEMPLATE_WORDS
    hit = at.join(F.broadcast(grams), (F.xxhash64("w0", "w1") == F.col("key")) & same & longer, "left")
    # numbers alone, so that rows combine by hashing; a repeated row sets the same bits once more
    longest = max(r[5] for r in gram_rows(phrases, templates))
    bits = [F.bit_or(F.expr(f"CASE WHEN tpos div 64 = {n} THEN shiftleft(1L, CAST(tpos % 64 AS INT)) END")) for n in range(longest // 64 + 1)]
    votes = sum((F.coalesce(F.bit_count(b), F.lit(0)) for b in bits[1:]), F.coalesce(F.bit_count(bits[0]), F.lit(0)))
    found = hit.groupBy("doc_id", "txt", "tpl", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        votes.cast("long").alias("votes"), F.min("tpos").alias("low"), F.max("tpos").alias("high"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    return found.join(F.broadcast(grams.select("tpl", "label", "base", "len", "k").distinct()), "tpl", "left")


def _telling(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(marked_id, marked_txt, marks): the `TELLING` words of the documents `wanted` (marked_id, marked_txt), with their positions."""
    if is_small(wanted):
        some = docs.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("marked_id")) & (F.col("txt") == F.col("marked_txt")), "left_semi")
    else:  # texts aren't shuffled: all that have such a word are looked at
        some = docs.where(F.col("text").rlike(f"(?i)(?<![a-z0-9])(?:{'|'.join(sorted(TELLING))})(?![a-z0-9])"))
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    at = some.select("doc_id", "txt", F.posexplode(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))).alias("pos", "word")).where(F.col("word").isin(sorted(TELLING)))
    return at.groupBy(F.col("doc_id").alias("marked_id"), F.col("txt").alias("marked_txt")).agg(F.collect_set(F.struct("pos", "word")).alias("marks"))


def _best(spans: Column) -> Column:
    """Of an array of spans, those that no better one of another label stands on."""
    order = lambda a, b: F.when((a.share > b.share) | (a.share == b.share) & (a['len'] > b['len']), -1).when((a.share == b.share) & (a['len'] == b['len']), 0).otherwise(1)
    common = lambda a, b: F.least(a.end, b.end) - F.greatest(a['first'], b['first'])
    beats = lambda k, x: (k.label != x.label) & ((k.share > x.share) | (k['len'] > x['len'])) & (2 * common(k, x) > F.least(k.end - k['first'], x.end - x['first']))
    add = lambda kept, x: F.when(F.exists(kept, lambda k: beats(k, x)), kept).otherwise(F.concat(kept, F.array(x)))
    return F.aggregate(F.array_sort(spans, order), F.slice(spans, 1, 0), add)


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, covered: float = COVERED) -> DataFrame:
    """For each doc_id of `docs` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, and spans: (label, first word, word behind the last, share of the template)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("txt", F.xxhash64("text"))
    found = stash(matches(docs, phrases, templates), "matches")
    base = F.coalesce(F.col("base"), F.lit(False))
    order = W.partitionBy("doc_id", "txt", "tpl").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int"), F.lit(1))
    wide = found.where(~base & F.col("tpl").isNotNull()).withColumn("island", F.sum(new).over(order))
    merged = wide.groupBy("doc_id", "txt", "tpl", "island").agg(
        F.first("label").alias("label"),
        (F.least(F.sum("votes"), F.max("high") - F.min("low") + 1) + F.first("k") - 1).alias("words"),
        F.first("len").alias("len"),
        F.min("first").alias("first"),
        (F.max("last") + F.first("k")).alias("end"),
        F.max("last").alias("last"),
        F.min("low").alias("low"),
        (F.max("high") + F.first("k")).alias("high"),
    )
    merged = merged.withColumn("share", F.least(F.lit(1.0), F.col("words") / F.col("len")))
    merged = stash(merged, "spans")
    long_enough = stash(merged.where(F.col("share") >= covered).select(F.col("doc_id").alias("marked_id"), F.col("txt").alias("marked_txt")).distinct(), "licensed")
    marks = stash(_telling(docs, long_enough), "marks")
    merged = merged.join(F.broadcast(marks) if is_small(marks) else marks, F.col("doc_id").eqNullSafe(F.col("marked_id")) & (F.col("txt") == F.col("marked_txt")), "left")
    # the template's words that aren't covered at its ends have their place beside the span
    near = lambda x: (x.pos >= F.col("first") - F.col("low")) & (x.pos < F.col("end") + F.col("len") - F.col("high"))
    own = F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce("marks", F.array().cast("array<struct<pos:int,word:string>>")), near), lambda x: x.word)))
    numbered = enumerate(_SPLIT.findall(text.lower()) for text in [*phrases, *templates])
    wanted = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n, words in numbered for x in (n, sorted(TELLING.intersection(words)))]), F.col("tpl")), F.array().cast("array<string>"))
    merged = merged.withColumn("holds", (F.col("share") >= covered) & (own == wanted))
    none = F.lit(None)
    span = F.struct("label", "first", "end", "share", "len")
    plain = found.where(base | F.col("tpl").isNull()).select("doc_id", "txt", "last", base.alias("base"), "first", F.when(base, F.col("label")).alias("base_label"), F.when(base, 1.0).alias("share"), F.when(base, F.struct("label", "first", (F.col("first") + F.col("len")).alias("end"), F.lit(1.0).alias("share"), "len")).alias("span"))
    spans = merged.select("doc_id", "txt", "last", F.lit(False).alias("base"), "first", none.cast("string").alias("base_label"), "share", F.when(F.col("holds"), span).alias("span"))
    rows = plain.union(spans)
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    out = rows.groupBy("doc_id", "txt").agg(
        F.coalesce(F.max("last") + 1, F.lit(0)).cast("long").alias("n_words"),
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        F.collect_set("base_label").alias("base_labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.collect_set(F.when(~F.col("base"), F.col("span"))).alias("wide"),
        F.collect_set(F.when(F.col("base"), F.col("span"))).alias("phrases"),
    )
    out = out.withColumn("kept", F.concat("phrases", _best(F.col("wide"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        joined(F.col("base_labels")).alias("base_labels"),
        joined(F.array_distinct(F.transform("kept", lambda x: x.label))).alias("labels"),
        "score",
        F.array_sort(F.transform("kept", lambda x: F.struct(x.label.alias("label"), x['first'].alias("first"), x.end.alias("end"), x.share.alias("share")))).alias("spans"),
    )


#: The same scan in DuckDB SQL, without the spans.
SQL = f"""
WITH t(tpl, label, base, len, k, tpos, t0, t1, t2, t3) AS (VALUES {_values(gram_rows(PHRASES, TEMPLATES))}),
split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
), rolled AS (
  SELECT doc_id, unnest(w) AS w0, unnest(list_concat(w[2:], [NULL])) AS w1, unnest(list_concat(w[3:], [NULL, NULL])) AS w2,
         unnest(list_concat(w[4:], [NULL, NULL, NULL])) AS w3, generate_subscripts(w, 1) - 1 AS pos FROM split
), hit AS (
  SELECT doc_id, tpl, pos - tpos AS diagonal, count(*) AS votes, min(tpos) AS low, max(tpos) AS high, min(pos) AS first,
         any_value(label) AS label, any_value(base) AS base, any_value(len) AS len, any_value(k) AS k
  FROM rolled JOIN t ON w0 = t0 AND w1 = t1 AND (k = {SHORT} OR (w2 = t2 AND w3 = t3)) GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tpl ORDER BY diagonal) <= {DRIFT} THEN 0 ELSE 1 END AS fresh FROM hit WHERE NOT base
), islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, tpl ORDER BY diagonal) AS island FROM marked
), merged AS (
  SELECT doc_id, any_value(label) AS label,
         least(1.0::DOUBLE, (least(sum(votes), max(high) - min(low) + 1) + any_value(k) - 1)::DOUBLE / any_value(len)) AS share
  FROM islands GROUP BY doc_id, tpl, island
), best AS (
  SELECT doc_id, max(share) AS share FROM (SELECT doc_id, share FROM merged UNION ALL SELECT doc_id, 1.0 FROM hit WHERE base) GROUP BY doc_id
), named AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels
  FROM (SELECT DISTINCT doc_id, label FROM (SELECT doc_id, label FROM merged WHERE share >= {COVERED} UNION ALL SELECT doc_id, label FROM hit WHERE base)) GROUP BY doc_id
), plain AS (
  SELECT doc_id, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM hit WHERE base GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(share, 0)::DOUBLE AS score
FROM split s LEFT JOIN plain USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""
