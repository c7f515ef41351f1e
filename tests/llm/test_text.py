"""Operators on words and lines against brute force, on small awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rangeloom.llm import licenses, lines, mixing, neardup, packing, quality, substring, toxicity
from rangeloom.llm.words import slices, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, copies string, score string"


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Élan", "straße", "日本", "a,b", "x|y"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = make(60)
    rows = []
    for i in range(90):
        text = make(rng.choice([1, 3, 5, 19, 20, 40, 120]))
        if i % 4 == 0:
            text = f"{make(10)}\n{shared}\t{make(7)}"
        if i % 7 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1] or ""
        if i % 9 == 0 and rows:
            words = (rows[-1][1] or "x").split()
            words[len(words) // 2] = "EDIT"
            text = " ".join(words)
        if i % 5 == 0:
            text = f"{text}\nThis line stands on every site we know."
        rows.append((i * 3 + 1, text))
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "same same " * 40), (504, "long " + make(4000)), (505, "licensed under the Apache License, MIT License mit license")]
    rng.shuffle(rows)
    return [(i, t, None if i % 11 == 0 else "en", None if i % 13 == 0 else f"s{i // 3 % 6}", len(t or ""), "k", "c", "z") for i, t in rows]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return WORD.findall(t or "")


def test_words_and_windows():
    import pyarrow as pa

    texts = [t for _, t, *_ in ROWS]
    seen = {}
    for a, b, w in slices(pa.array(texts), limit=500):
        assert w.counts().tolist() == [len(split(t)) for t in texts[a:b]]
        flat = [x for t in texts[a:b] for x in split(t)]
        for i, h in enumerate(windows(w.hashes(), 3).tolist()):
            assert seen.setdefault(h, tuple(flat[i : i + 3])) == tuple(flat[i : i + 3])
    assert len(set(seen.values())) == len(seen)


def test_substrings(docs, empty):
    seen, want = set(), {}
    for i, t, *_ in sorted(ROWS, key=lambda r: r[0]):
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            gram = tuple(w[k : k + 20])
            if gram in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(gram)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substring.remove_repeats(docs).collect()}
    assert got == want
    twice = substring.remove_repeats(docs.union(docs)).dropDuplicates(["doc_id"])
    assert {r.doc_id: r.n_removed for r in twice.collect()} == {i: v[1] for i, v in want.items()}
    assert substring.remove_repeats(empty).count() == 0


def test_boilerplate_lines(docs, empty):
    sites, first = {}, {}
    for i, t, _, s, *_ in sorted(ROWS, key=lambda r: r[0]):
        for p, line in enumerate((t or "").split("\n")):
            if split(line):
                sites.setdefault(line, set()).add(s)
                first.setdefault(line, (i, p))
    half = (len({s for *_, s, _, _, _, _ in ROWS}) + 1) // 2
    bad = {line for line, s in sites.items() if len(s) >= (lines.THRESHOLD if len(line) >= lines.SHORT else max(lines.THRESHOLD, half))}
    assert "This line stands on every site we know." in bad
    got = {r.doc_id: r for r in lines.drop_boilerplate(docs).collect()}
    assert len(got) == len(ROWS)
    for i, t, *_ in ROWS:
        parts = (t or "").split("\n")
        kept = [x for p, x in enumerate(parts) if x not in bad or first[x] == (i, p)]
        assert (got[i].text or "") == "\n".join(kept) and got[i].n_removed == len(parts) - len(kept)
        assert got[i].kept == "k" and (t is None) == (got[i].text is None)
    assert lines.drop_boilerplate(empty).count() == 0


def test_short_lines_need_half_of_all_sites(spark):
    """Short boilerplate goes, short lines of a few sites and blank lines stay; one line holds a third of all lines."""
    rows = [(i, f"Read more\n{'Yes.' if i % 24 < 6 else f'No {i}'}\n\nProse of document {i}\nA line that everybody has", f"s{i % 24}") for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in lines.drop_boilerplate(df).collect():
        want = rows[r.doc_id][1].split("\n")
        assert r.text.split("\n") == (want if r.doc_id == 0 else [*want[1:4]]), r


def test_near_threshold_lines_are_counted_exactly(spark):
    four, five = "a line that four sites have", "a line that five sites have"
    rows = [(i, four, None, f"s{i % 4}") for i in range(20)] + [(100 + i, five, None, f"s{i % 5}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.n_removed for r in lines.drop_boilerplate(df).collect()}
    assert {i for i, n in got.items() if n} == set(range(101, 120))


def shingle_set(t):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in split(t)]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}


def test_near_duplicates(docs, empty):
    want = groups(ROWS)
    assert any(i != c for i, (_, c, _) in want.items())
    assert result(docs) == want
    assert result(docs.union(docs)) == want
    assert result(empty) == {}
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, v in want.items() if v[2]}


def test_chains_of_edits_are_followed(spark):
    rng = random.Random(3)
    words, rows = [f"v{i}" for i in range(200)], []
    for i in range(60):
        rows.append((1000 - i, " ".join(words)))
        words = list(words)
        words[rng.randrange(200)] = f"n{i}"
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == groups(rows)


def test_sketches_estimate_similarity():
    import numpy as np
    import pyarrow as pa

    base = [f"t{i}" for i in range(400)]
    texts = [" ".join(base), " ".join(base[:340] + [f"u{i}" for i in range(60)])]
    (_, _, w), = slices(pa.array(texts))
    regs = neardup.registers(*neardup.shingles(w), 2)
    a, b = map(shingle_set, texts)
    assert abs(neardup.likeness(regs[0], regs[1], len(a), len(b)) - len(a & b) / len(a | b)) < 0.15


@pytest.mark.parametrize("n", [3, 8, 30, 120, 700])
def test_sketches_of_sets_at_the_threshold_stay_candidates(n):
    import numpy as np

    rng = np.random.default_rng(n)
    trials, common = 300, 3 * n
    both = rng.integers(0, 2**63, (trials, common), dtype=np.uint64)
    other = rng.integers(0, 2**63, (2, trials, n // 2 or 1), dtype=np.uint64)
    sketch = [neardup.registers(np.repeat(np.arange(trials), common + x.shape[1]), np.concatenate([both, x], 1).ravel(), trials) for x in other]
    size = common + (n // 2 or 1)
    share = common / (common + 2 * (n // 2 or 1))
    assert neardup.likeness(*sketch, size, size).mean() == pytest.approx(share, abs=0.04)
    assert neardup.likely(*sketch, np.full(trials, size), np.full(trials, size)).all()
    assert (neardup.band_keys(sketch[0]) == neardup.band_keys(sketch[1])).any(1).all()


def test_near_copies_that_are_not_all_linked(spark):
    """3000 edits of one text, many too far from it and from each other, in the same buckets."""
    import numpy as np

    rng = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    rows = [(9999, " ".join(base))]
    for i in range(3000):
        words = list(base)
        for k in range(rng.randrange(5)):
            words[rng.randrange(60)] = f"e{i}.{k}"
        rows.append((i, " ".join(words)))
    names: dict = {}
    ids = [[names.setdefault(s, len(names)) for s in shingle_set(t)] for _, t in rows]
    shared = {k for k, n in Counter(x for s in ids for x in s).items() if n > 1}
    column = {k: c for c, k in enumerate(shared)}
    held = np.zeros((len(rows), len(column)), np.float32)
    for r, s in enumerate(ids):
        held[r, [column[x] for x in s if x in column]] = 1
    both, size = held @ held.T, np.array([len(s) for s in ids])
    linked = 100 * both >= 75 * (size[:, None] + size[None] - both)
    np.fill_diagonal(linked, True)
    doc = np.array([i for i, _ in rows])
    least = doc.copy()
    while True:
        new = np.where(linked, least[None], 10**6).min(1)
        if (new == least).all():
            break
        least = new
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip(doc.tolist(), least.tolist()))
    assert 50 < len(set(got.values())) < 2900


def test_mixing(docs, empty):
    got = mixing.draw(docs).collect()
    assert len(got) == len(ROWS)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    assert {r.doc_id: r.size for r in got} == {i: len(split(t)) for i, t, *_ in ROWS}
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        assert target[s] <= 2 * sizes[s] + 1e-6 and abs(taken[s] - target[s]) <= 0.25 * target[s]
    again = {(r.doc_id, r.taken) for r in mixing.draw(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mixing.draw(empty).count() == 0
    whole = mixing.mix(docs)
    copies = {r.doc_id: r.copies for r in got}
    assert whole.columns == docs.columns and Counter(r.doc_id for r in whole.collect()) == Counter({i: n for i, n in copies.items() if n})


def test_mixing_passes_over_documents_that_do_not_fit(spark):
    # one long document among short ones: needs are 225,000 of 150,000 words a source, so half of each once more
    rows = [(f"{k}-{i}", "w " * (60_000 if i == 0 else 100), str(k)) for k in range(24) for i in range(901)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.draw(df, weights=(1,)).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(target) == 24 and all(abs(taken[s] - target[s]) <= 100 for s in target)


def test_mixing_takes_the_documents_a_walk_in_rank_order_takes(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([7, 11, 90, 800, 3000]), "a") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.draw(df).collect()}
    total = sum(r.size for r in got.values())
    odds = lambda x: x / (1 - x)
    u = {i: (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in got}
    pool = {i: r for i, r in got.items() if r.probability > 0}
    assert sum(r.probability * r.size for r in pool.values()) + sum(r.copies * r.size for i, r in got.items() if i not in pool) + sum(r.size for r in pool.values()) == pytest.approx(1.5 * total)
    # all of one source share a level, so p falls with the fourth root of the size
    assert len({round(r.probability * r.size**0.25, 9) for r in pool.values()}) == 1 and len({round(r.probability, 9) for r in pool.values()}) > 1
    order = sorted(pool, key=lambda i: odds(u[i]) / odds(pool[i].probability))
    assert order != sorted(pool, key=u.get)
    gap, extra = 1.5 * total - total - sum((r.copies - 1) * r.size for i, r in got.items() if i not in pool), set()
    for _ in range(3):
        left = gap
        for i in order:
            if i not in extra and got[i].size <= left:
                if got[i].size > gap:
                    break
                gap -= got[i].size
                extra.add(i)
    spare = [(abs(gap - got[i].size), i) for i in order if i not in extra and abs(gap - got[i].size) < gap]
    extra |= {min(spare)[1]} if spare else set()
    assert {i for i in pool if got[i].copies == 2} == extra


def test_mixing_meets_its_inclusion_probabilities(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([40, 60, 250, 900]), "a") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    runs, times, wanted = 3, Counter(), {}
    for seed in range(runs):
        for r in mixing.draw(df, seed=f"s{seed}").collect():
            times[r.size] += r.copies - 1
            wanted[r.doc_id] = (r.size, r.probability)
    for size in (40, 60, 250, 900):
        p = [x for n, x in wanted.values() if n == size]
        assert times[size] / (runs * len(p)) == pytest.approx(sum(p) / len(p), abs=0.05)


def test_sources_at_their_limit_hand_on_the_rest(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    # weights 3, 1, 2, 3 of 3022.5: a and the null source stop at twice their size
    assert got["a"] == 20 and got[None] == 10
    assert got["c"] == pytest.approx(2 * (3022.5 - 30) / 3) and got["b"] == pytest.approx((3022.5 - 30) / 3)


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    clean = [f"c{chr(97 + i % 26)}{chr(97 + i // 26)}word" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 8 == 0
        words = [rng.choice(clean) for _ in range(40)]
        if bad:
            words[3:6] = rng.sample(["vilething", "nastyword", "foulterm", "grossname"], 3)
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    text = spark.createDataFrame([*rows, (9001, None), (9002, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(text, marks, ~held)
    got = {r.doc_id: r for r in toxicity.score(text, model).collect()}
    assert len(got) == 602 and all(0 <= r.score <= 1 for r in got.values())
    out = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum(got[i].predicted == int(i % 8 == 0) for i in out)
    assert right >= 0.95 * len(out)
    assert got[9001].score == got[9002].score and got[9002].predicted == 0
    none = toxicity.fit(text, marks.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(empty, model).count() == 0


def test_risk_stays_non_negative():
    import numpy as np

    pos = toxicity.Sparse([np.array([0], np.uint32)] * 20, 2)
    all_ = toxicity.Sparse([np.array([0], np.uint32)] * 20 + [np.array([1], np.uint32)] * 180, 2)
    w, b = toxicity.train(pos, all_, 0.1)
    high, low = 1 / (1 + np.exp(-(w[0] + b))), 1 / (1 + np.exp(-(w[1] + b)))
    assert high > 0.7 and low < 0.1


def base_figures(t):
    w, seen, dup = split(t), set(), 0
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_quality_figures(docs, empty):
    for r in quality.annotate(docs, None).collect():
        want = base_figures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed)
    assert quality.annotate(empty, None).count() == 0


def test_quality_chain_learns(spark):
    rng = random.Random(4)
    good = lambda: "\n".join(" ".join(rng.choice(["some", "plain", "words", "of", "prose"]) + str(rng.randrange(99)) for _ in range(12)) + "." for _ in range(4))
    junk = lambda: "\n".join(" | ".join(f"c{rng.randrange(999)}" for _ in range(12)) for _ in range(4))
    rows = [(i, good() if i % 3 else junk(), f"s{i % 2}") for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    got = {r.doc_id for r in kept.collect()}
    assert sum((i in got) == (i % 3 > 0) for i in range(120, 240)) >= 117


def test_viterbi_against_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    rows = np.repeat([0, 1, 2], [5, 1, 3])
    scores, moves = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    got = quality.viterbi(rows, scores, moves)
    for a, b in ((0, 5), (5, 6), (6, 9)):
        value = lambda p: sum(scores[a + i, s] for i, s in enumerate(p)) + sum(moves[x, y] for x, y in zip(p, p[1:]))
        assert value(got[a:b].tolist()) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=b - a))))


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    special = docs.sparkSession.createDataFrame([(900, "The <|endoftext|> END the<|endoftext|>x Ünï", "en", "s", 1, "k", "c", "z")], SCHEMA)
    got = packing.pack(docs.union(special), window=256).collect()
    rows = {i: t for i, t, *_ in ROWS} | {900: "The <|endoftext|> END the<|endoftext|>x Ünï"}
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(rows)
    for i, parts in pieces.items():
        ids = tokenizer.encode(rows[i] or "", add_special_tokens=False).ids + [2]
        data = b"".join(bytes(r.ids) for r in sorted(parts, key=lambda r: r.start))
        assert data == b"".join(x.to_bytes(4, "little") for x in ids)
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.doc_tokens == len(ids) for r in parts)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack(empty).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(9)
    lengths = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    where, offset = packing.best_fit(lengths, 100)
    rooms = {}
    for n, k, o in zip(lengths, where, offset):
        fits = [r for r in rooms.values() if r >= n]
        assert (100 - o) == (min(fits) if fits else 100)
        rooms[k] = 100 - o - n


def test_licenses(docs, empty):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(ROWS)
    for i, t, *_ in ROWS:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert r.first_word == min((k for k, _ in places), default=None) and r.last_word == max((k for k, _ in places), default=None)
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert licenses.scan(empty).count() == 0
    assert {r.doc_id: r.n_base for r in licenses.scan(docs.union(docs)).collect()} == {i: r.n_base for i, r in got.items()}


def test_license_spans_survive_edits(spark):
    notice = "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files"
    df = spark.createDataFrame([(1, f"x {notice} y"), (2, "permission is hereby granted to nobody"), (3, "Kit MIT LICENSE")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert got[1].labels == "mit" and got[1].n_base == 0 and got[1].score >= 0.6 and got[1].spans[0].first == 1
    assert got[2].labels == "" and got[3].base_labels == "mit"


def test_sibling_licenses_keep_apart(spark):
    gnu = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published"
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    cases = [
        ("this program is free software: " + gnu.format(""), "gnu general public license", "gpl"),
        (gnu.format("Lesser "), "", "lgpl"),
        (gnu.format("Affero "), "", ""),
        (cc.format(""), "", "cc-by"),
        (cc.format("-ShareAlike"), "", "cc-by-sa"),
        (cc.format("-NonCommercial-NoDerivatives"), "", ""),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial licence", "", ""),
        (gnu.format("Lesser ") + " and far from it, among other things, the text. " + cc.format(""), "", "cc-by,lgpl"),
        (gnu.format("Lesser ") + " " + gnu.format("").replace("you can", "this program is free software you can"), "", "gpl,lgpl"),
    ]
    df = spark.createDataFrame([(i, text) for i, (text, *_) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[i].labels for i in range(len(cases))] == [labels for *_, labels in cases]
    assert all({x.label for x in r.spans} == set(r.labels.split(",")) - {""} for r in got.values())


def test_doubling_goes_on_until_nothing_repeats(docs):
    grams = {}
    for length in (20, 40, 80, 160):
        for i, t, *_ in ROWS:
            w = split(t)
            for k in range(len(w) - length + 1):
                grams.setdefault((length, tuple(w[k : k + length])), set()).add((i, k))
    want = {}
    for (length, _), places in grams.items():
        if len(places) > 1:
            for i, _ in places:
                want[i] = max(want.get(i, 0), length)
    assert {r.doc_id: r.length for r in substring.repeat_lengths(docs).collect()} == want


def test_documents_are_shuffled_once_for_both_levels(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = substring.remove_repeats(spark.read.parquet(f"{tmp_path}/docs"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held[0])
        spark.conf.set("spark.sql.adaptive.enabled", held[1])
    made = [line for line in plan.split("\n") if "Exchange" in line and "ReusedExchange" not in line]
    assert sum("REPARTITION_BY_COL" in line for line in made) == 1
    assert sum("half#" in line for line in made) == sum("whole#" in line for line in made) == 1


def test_rows_that_repeat_an_id_with_other_texts_do_not_crash(spark):
    words = [f"r{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (1, " ".join(words[:25])), (2, " ".join(words)), (2, "short"), (3, " ".join(words[30:]))]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [g[:2] for g in got] == [(1, 25), (1, 60), (2, 1), (2, 60), (3, 30)] and got[3][2] == 60 and got[4][2] == 30


def test_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "some words of a text that has no id " * 4, "s0"), (1, "other words", "s0"), (2, "third words here", None)], "doc_id long, text string, source string")
    df = df.union(df)
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(df).collect()) == [(0, 0, True)] * 2 + [(1, 1, True), (2, 2, True)]
    assert neardup.keep_one(df).count() == df.count()
    df = df.distinct()
    assert {(r.doc_id, r.n_removed) for r in substring.remove_repeats(df).collect()} == {(None, 0), (1, 0), (2, 0)}
    assert sum(r.taken for r in mixing.draw(df).collect()) == sum(r.n for r in mixing.mix(df).select(F.size(F.split("text", r"\s+(?=\S)")).alias("n")).collect())
    assert lines.drop_boilerplate(df).count() == licenses.scan(df).count() == 3
