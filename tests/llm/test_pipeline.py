"""The pipeline on a small table: every stage keeps the documents' columns and its promise."""

import random
from collections import Counter

from test_text import groups

from corpus_pipeline import STAGES, run
from rangeloom.llm import lines, mixing


def without_boilerplate(docs):
    """Line dedup by hand: (doc_id, text) of (doc_id, text, source)."""
    sites, first, every = {}, {}, {d[2] for d in docs}
    for i, text, source in sorted(docs):
        for p, line in enumerate(text.split("\n")):
            if line.strip():
                sites.setdefault(line, set()).add(source)
                first.setdefault(line, (i, p))
    bad = {x for x, s in sites.items() if len(s) >= (lines.THRESHOLD if len(x) >= lines.SHORT else max(lines.THRESHOLD, -(-len(every) // 2)))}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if x not in bad or first[x] == (i, p)) for i, t, _ in docs}


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "se", "ti", "vo")]
    prose = lambda: "\n".join(" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(30)).rstrip("0123456789") + "." for _ in range(3))
    rows = []
    for i in range(120):
        text = prose() if i % 6 else "#$% | " * 60
        if i % 6 and i % 4 == 1:
            text += "\nAll of our sites carry this line."
        if i % 10 == 7:
            text = rows[-2][1]
        rows.append((i, text, "en", f"s{i % 7}", len(text)))
    docs = spark.createDataFrame([*rows, (500, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(0, 120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "packing"]
    now, seen = docs, []
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(now.count())
        if name == "line dedup":
            want = without_boilerplate([(r.doc_id, r.text, r.source) for r in before.collect()])
            assert {r.doc_id: r.text for r in now.collect()} == want and want != {r.doc_id: r.text for r in before.collect()}
        elif name == "near dedup":
            kept = {i for i, (_, _, first) in groups([(r.doc_id, r.text) for r in before.collect()]).items() if first}
            assert {r.doc_id for r in now.collect()} == kept
        elif name == "mixing":
            assert Counter(r.doc_id for r in now.collect()) == Counter({r.doc_id: r.copies for r in mixing.draw(before).collect() if r.copies})
        elif name == "packing":
            pieces, docs_in = now.collect(), Counter(r.doc_id for r in before.collect())
            held = Counter()
            for r in pieces:
                held[r.doc_id] += r.length
            assert {i: n * next(r.doc_tokens for r in pieces if r.doc_id == i) for i, n in docs_in.items()} == held
            spans = sorted((r.sequence_id, r.offset, r.length) for r in pieces)
            assert all(a[1] + a[2] == b[1] if a[0] == b[0] else b[1] == 0 for a, b in zip(spans, spans[1:])) and all(o + n <= 4096 for _, o, n in spans)
        if k < len(STAGES) - 1:
            assert now.dtypes == docs.dtypes, name
    assert seen[0] < 121 and seen[1] == seen[0] and seen[2] < seen[1]
    assert run(spark, str(tmp_path)).count() == seen[-1]
