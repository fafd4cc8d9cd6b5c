"""Operators on texts against brute force: fixtures with nulls, empty and long
texts, ties, repeated rows and extra columns, and the driver's smallest tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard

from learnlens.llm import common, decontaminate, fmindex, licenses, lm, queries, simhash
from tests.conftest import SF0001

LOW = str.maketrans(common.UPPER, common.LOWER)
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VOCABULARY = [a + b for a in "ab cd éf GH i9 ü".split() for b in "x yy Z 1 ß".split()]


def texts(seed: int = 3) -> list[tuple]:
    """Documents with shared passages, copies, odd white space and gaps."""
    rng = random.Random(seed)
    passage = [rng.choice(VOCABULARY) for _ in range(40)]
    rows = []
    for i in range(60):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randint(0, 90))]
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 10):rng.randint(20, 40)]
        rows.append((i, rng.choice([" ", "\n", "\t", " \x0b ", "  "]).join(words)))
    long = [rng.choice(VOCABULARY) for _ in range(3000)]
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, "one"), (104, "a b\x1cc   d"), (105, rows[8][1]),
             (106, rows[8][1]), (107, " ".join(long)), (108, " ".join(long[500:2500])),
             (109, " ".join(["same"] * 40)), (110, " ".join(["same"] * 14))]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    # Columns beside doc_id and text clash with names that the operators use.
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in texts()],
                                 "doc_id long, text string, words string, fold int, row_key long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def read(spark, name):
    return [(r.doc_id, r.text) for r in common.table(spark, SF0001, name).collect()]


# ---- SimHash


def brute_prints(rows):
    out = {}
    for i, t in rows:
        w = SPACED.findall((t or "").translate(LOW))
        s = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        out[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return out


def brute_components(prints, radius=3):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark, docs):
    for df, rows in ((docs, texts()), (common.table(spark, SF0001, "documents"), read(spark, "documents"))):
        prints = brute_prints(rows)
        comps = brute_components(prints)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
        assert got == {i: (format(prints[i], "016x"), comps[i]) for i in prints}


def test_covering_masks_miss_no_pair_within_the_radius():
    masks = [m % (1 << 64) for m in simhash.covering_masks(3)]
    assert len(masks) == 15
    rng = random.Random(1)
    for _ in range(20000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(x & m == 0 for m in masks)
    assert all(26 <= m.bit_count() <= 40 for m in masks)


def test_crowded_buckets_are_compared_block_by_block(spark):
    rng = np.random.default_rng(0)
    centre = int(rng.integers(0, 1 << 62))
    prints = {centre}
    while len(prints) < 300:
        x = centre
        for b in rng.integers(0, 62, rng.integers(1, 7)):
            x ^= 1 << int(b)
        prints.add(x)
    rows = list(enumerate(sorted(prints)))
    fps = spark.createDataFrame([(fp,) for _, fp in rows], "fp long")
    found = simhash.links(fps, 3, block=20)
    roots = {r.node: r.root for r in common.components(found).collect()}
    want = brute_components(dict(rows))
    same = {fp: want[i] for i, fp in rows}
    got = {fp: roots.get(fp, fp) for _, fp in rows}
    groups = lambda d: {frozenset(k for k in d if d[k] == v) for v in set(d.values())}
    assert groups(same) == groups(got)


def test_one_row_of_each_component_where_ids_are_shared_or_null(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(5, one), (5, two), (6, one), (7, two), (None, three), (None, three), (8, None), (9, "")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted(
        [("5", one), ("5", two), ("8", ""), ("None", three)])
    # A third of all rows repeated without an id: one of them stays.
    many = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS doc_id",
                                        "CASE WHEN id % 3 = 0 THEN 'same words here' ELSE concat('w', id, ' x', id * 7, ' y', id * 13) END AS text")
    assert simhash.one_of_each(many).where("doc_id IS NULL").count() == 1


def test_one_row_of_each_component_stays(spark, empty):
    rows = [(1, "a b c d"), (2, "A b  c d"), (2, "A b  c d"), (3, None), (4, ""), (None, "a b c d"), (None, "other words here"),
            (5, "x y z"), (5, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.one_of_each(df).collect())
    assert kept == [(False, 1), (False, 3), (False, 5), (True, 0)]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


# ---- repeated passages


def brute_kept(rows, window=13):
    first = {}
    words = [(NO if i is None else i, SPACED.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, NO), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


NO = int(fmindex.NO_ID)


@pytest.mark.parametrize("common_from", [0, 500])
def test_repeats_against_brute_force(spark, docs, monkeypatch, common_from):
    monkeypatch.setattr(fmindex, "COMMON", common_from)  # 0: every shared window by itself
    for df, rows in ((docs, texts()), (common.table(spark, SF0001, "documents"), read(spark, "documents"))):
        got = sorted((r.doc_id, r["__n_words"], r["__n_removed"], r["__kept"]) for r in fmindex.kept_words(df).collect())
        assert got == brute_kept(rows)


def test_a_common_window_travels_once_per_chunk(spark, monkeypatch):
    monkeypatch.setattr(fmindex, "COMMON", 5)
    passage = " ".join(f"w{i}" for i in range(20))  # 8 windows
    rows = [(i, passage) for i in range(-100, 300)]
    sent, form = [], fmindex.repeated

    def seen(runs, window):
        sent.extend(common.written(runs, "runs").collect())
        return form(runs, window)

    monkeypatch.setattr(fmindex, "repeated", seen)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    got = sorted((r.doc_id, r["__n_words"], r["__n_removed"], r["__kept"]) for r in fmindex.kept_words(df).collect())
    assert got == brute_kept(rows)
    unzip = zstandard.ZstdDecompressor()
    keys = [(r.chunk, k) for r in sent if r.keys for k in np.cumsum(fmindex.exchange.unpack(r.keys, unzip), dtype=np.uint64).tolist()]
    assert not any(r.lengths for r in sent)
    chunks = {c for c, _ in keys}
    assert len(keys) == len(set(keys)) <= 8 * len(chunks) and 1 <= len(chunks) <= 3  # not one for each of 400 documents


def test_repeats_without_ids_and_with_repeated_rows(spark, empty):
    p = " ".join(f"w{i}" for i in range(30))
    rows = [(None, p), (7, p), (7, p), (7, "x " + p), (9, p + " end"), (1, None), (2, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((NO if r.doc_id is None else r.doc_id, r["__n_words"], r["__n_removed"], r["__kept"])
                 for r in fmindex.kept_words(df).collect())
    assert got == brute_kept(rows)
    assert fmindex.kept_words(empty).count() == 0
    left = {(r.doc_id, r.text) for r in fmindex.without_repeats(df).collect()}
    assert (2, "short") in left and (1, None) in left and (9, "end") in left


def test_fm_index_counts_every_pattern():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 400)
    text[-1] = 0
    index = fmindex.FMIndex(text, 4, 5)
    patterns = np.array([[a, b, c] for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)])
    lo, hi = index.search(patterns)
    for p, a, b in zip(patterns, lo, hi, strict=True):
        n = sum((text[k:k + 3] == p).all() for k in range(398))
        assert b - a == n if n > 1 else b - a <= 1


# ---- decontamination


def brute_hits(rows, items, window=13):
    wins = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else ():
            wins.setdefault(tuple(w[k:k + n]), set()).update([] if i is None else [str(i)])
    out = []
    for i, t in rows:
        w, hit, found = ALNUM.findall((t or "").translate(LOW)), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k:k + n])) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[key]
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def items(rows):
    w = ALNUM.findall((dict(rows)[107]).translate(LOW))
    return [(1, " ".join(w[100:140])), (2, " ".join(w[110:123])), (10, "ABX cdyy"), (3, "cdyy"), (4, None), (5, "... !"),
            (None, " ".join(w[600:620])), (6, "éfß ü1 abx"), (6, "éfß ü1 abx")]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_contamination_against_brute_force(spark, docs, broadcast):
    rows = texts()
    bench = spark.createDataFrame(items(rows), "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in
                  decontaminate.contamination(docs, bench, broadcast_seeds=broadcast).collect()), key=str)
    assert got == brute_hits(rows, items(rows))


def test_contamination_query_and_edges(spark, docs, empty):
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
           for r in queries.registered()["op9_decontaminate"](spark, SF0001).collect()}
    bench = [(r.item_id, r.text) for r in common.table(spark, SF0001, "benchmark").collect()]
    want = {i: (n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), c)
            for i, n, h, f, c in brute_hits(read(spark, "documents"), bench)}
    assert got == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty, none).count() == 0
    assert decontaminate.contamination(docs, none).where("contaminated").count() == 0
    assert decontaminate.clean_documents(docs, none).count() == docs.count()
    one = spark.createDataFrame([(1, "same same")], "item_id long, text string")
    left = {r.doc_id for r in decontaminate.clean_documents(docs, one).collect()}
    assert left == {i for i, _ in texts()} - {109, 110}
    cut = {r.doc_id: r.kept for r in decontaminate.remove_spans(docs, one).collect()}
    assert cut[109] == "" and cut[103] == "one"


# ---- licenses


def test_license_base_places_against_brute_force(spark):
    rows = [(1, "Released under the MIT license. Under the\nMIT-License; CC BY-NC 4.0"), (2, "Apache License, Version 2.0"),
            (3, None), (4, ""), (5, "mit license under"), (6, "cc by nc cc by nc " * 3), (6, "SPDX-License-Identifier: GPL-3.0-or-later"),
            (7, "licensed under the GNU Lesser General Public License, version 2.1"), (8, "x " * 4000 + "cc-by-sa 3.0"),
            (9, "https://creativecommons.org/licenses/by-nc-nd/2.5/"), (None, "apache license version 2")]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, n_words int, labels string")
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, tuple(r.base_labels)) for r in licenses.scan(df).collect()}
    want = set()
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(LOW))
        at = [(k, label) for before, key, after, label in licenses.BASE for p in [f"{before} {key} {after}".split()]
              for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
        want.add((i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None),
                  tuple(sorted({x for _, x in at}))))
    assert got == want
    labels = {(r.doc_id, r.n_words): r.labels for r in licenses.scan(df).collect()}
    by_id = {i: v for (i, _), v in labels.items()}
    assert by_id[7] == ["lgpl-2.1"] and by_id[8] == ["cc-by-sa-3.0"] and by_id[9] == ["cc-by-nc-nd-2.5"]
    assert ["gpl-3.0"] in labels.values() and by_id[5] == ["mit"] and "cc-by-nc-4.0" in by_id[1]
    assert licenses.scan(df.limit(0)).count() == 0


TEXTS = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction": ["mit"],
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": ["bsd"],
    "Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of X "
    "nor the names of its contributors may be used to endorse or promote products derived from this software": ["bsd", "bsd-3-clause"],
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": ["isc"],
    "This software is provided 'as-is', without any express or implied warranty. In no event": ["zlib"],
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version 3 of the License, or (at your option) any later version.": ["gpl-3.0-or-later"],
    "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 2.1 of the "
    "License.": ["lgpl-2.1"],
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
    "License.": ["apache-2"],
    "Apache-2.0 OR MIT": ["apache-2", "mit"],
    "Dual licensed under MIT or GPLv2": ["gpl-2", "mit"],
    "Not released under the GPL license": [],
    "It is not licensed under the MIT License but under the ISC license": ["isc", "mit"],   # the base phrase stays
    "no longer distributed under the terms of the Mozilla Public License": [],
    "This is free and unencumbered software released into the public domain.": ["unlicense"],
    "harvard or mit, and nothing else": [],
}


def test_license_texts_lists_and_denials(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert {t: got[i] for i, t in enumerate(TEXTS)} == TEXTS


def brute_licenses(text):
    """(labels, score), rule by rule and word by word."""
    w = ALNUM.findall((text or "").translate(LOW))
    base, found = set(), []
    ruleset = [*licenses.rules(), *({"rule": -1, "form": "base", "label": label, "keyword": key, "priority": 0, "confidence": 0.5,
                                     "before": f"(?:^| ){before} $" if before else "", "after": f"^ {after}(?= )"}
                                    for before, key, after, label in licenses.BASE)]
    by_key = {}
    for r in ruleset:
        by_key.setdefault(r["keyword"], []).append(r)
    score = 0.0
    for i, word in enumerate(w):
        if word not in by_key:
            continue
        left = " ".join(w[max(0, i - licenses.REACH):i]) + (" " if i else "")
        right = " " + " ".join(w[i + 1:i + 1 + licenses.REACH]) + " "
        for r in by_key[word]:
            b, a = re.search(r["before"], left), re.search(r["after"], right)
            if not b or not a:
                continue
            if r["form"] == "base":
                base.add(r["label"])
                score = max(score, 0.5)
                continue
            before = "" if r["form"] == "listed" else b[0]
            ahead = left[:len(left) - len(before)] + (" " if before.startswith(" ") else "")
            if r["form"] in ("name", "grant", "listed", "notice") and re.search(licenses.DENIED, ahead):
                continue
            found.append((i - len(before.split()), -(i + 1 + len(a[0].split())), r["priority"], r["rule"], r["label"], r["confidence"]))
    reach, labels = -1, set(base)
    for _, to, _, _, label, confidence in sorted(found):
        if -to > reach:
            reach = -to
            labels.add(label)
            score = max(score, confidence)
    return sorted(labels), score


def test_license_labels_and_scores_against_brute_force(spark):
    table = read(spark, "documents")
    extra = [(10_000 + i, t) for i, t in enumerate([*TEXTS, None, "", "mit " * 60, " and ".join(TEXTS)])]
    df = spark.createDataFrame(table + extra, "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(df).collect()}
    assert got == {i: brute_licenses(t) for i, t in table + extra}


def test_license_rules_are_many_and_compile():
    rules = licenses.rules()
    assert len(rules) > 300 and len({r["rule"] for r in rules}) == len(rules)
    for r in rules:
        re.compile(r["before"]), re.compile(r["after"])


def test_enclosed_detections_are_suppressed(spark):
    rows = [(1, 0, "a", 2, 0, 5), (1, 1, "b", 1, 1, 3), (1, 2, "c", 3, 0, 5), (1, 3, "d", 1, 4, 8), (2, 4, "e", 1, 1, 3)]
    dets = spark.createDataFrame(rows, "row long, rule int, label string, priority int, `from` int, `to` int")
    assert sorted(r.label for r in licenses.outermost(dets).collect()) == ["a", "d", "e"]


# ---- language model


def brute_lm(rows, folds=10):
    token = lambda t: [*SPACED.findall((t or "").translate(LOW)), "\n"]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % folds
    fit, train, fit2, train2 = Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        w = token(t)
        pairs = list(zip(["\n", *w], w, strict=False))
        if fold(i):
            train.update(w)
            train2.update(pairs)
            if fold(i) != 1:
                fit.update(w)
                fit2.update(pairs)
    bins = Counter()
    k = lambda n: min(int(math.log2(n + 1)), lm.CLASSES - 1)
    quantum = lambda p: 1 if p <= 0 else int(np.round(np.log2(p) * lm.STEPS))
    n_fit = sum(fit.values())
    for i, t in rows:
        if fold(i) == 1:
            w = token(t)
            for a, b in zip(["\n", *w], w, strict=False):
                bins[k(fit[a]), quantum(fit2[a, b] / max(fit[a], 1)), quantum(fit[b] / max(n_fit, 1))] += 1
    weights = lm.mixture(np.array(sorted((*x, n) for x, n in bins.items()), np.int64).reshape(-1, 4), len(fit))
    n, v, out = sum(train.values()), len(train), {}
    for i, t in rows:
        w, total = token(t), 0.0
        for a, b in zip(["\n", *w], w, strict=False):
            x = weights[k(train[a])]
            p2, p1, p0 = train2[a, b] / max(train[a], 1), train[b] / max(n, 1), 1 / (v + 1)
            p = x @ [p2, p1, p0] if n else p0
            total += math.log10(p / (x[1] + x[2]) if n and not train[a] else p)
        base = sum(math.log10((train[b] + 0.1) / (n + 0.1 * (v + 1))) for b in w)
        out[i] = (fold(i) == 0, len(w), sum(train[b] > 0 for b in w), n, base, total)
    return out


@pytest.mark.parametrize("size", [50, 3_000_000])
def test_language_model_against_brute_force(spark, docs, size):
    for df, rows in ((docs, texts()), (common.table(spark, SF0001, "documents"), read(spark, "documents"))):
        got = {r.doc_id: tuple(r)[1:] for r in lm.scores(df, chunk_tokens=size).collect()}
        want = brute_lm(rows)
        assert got.keys() == want.keys()
        for i, w in want.items():
            assert got[i][:4] == w[:4]
            assert got[i][4:] == pytest.approx(w[4:], rel=1e-9)


def test_language_model_is_a_distribution_and_beats_the_base(spark, empty):
    rows = lm.scores(common.table(spark, SF0001, "documents")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert lm.scores(empty).count() == 0
    # Only held-out rows: nothing to learn from.
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    only = lm.scores(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == 0 for r in only)
