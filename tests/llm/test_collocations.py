"""Quotient filters against counters, collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from seriesmill.llm import collocations as co
from seriesmill.llm import quotient_filter as qf
from seriesmill.llm.queries import op11


@pytest.mark.parametrize("width", [1, 2, 7, 20, 33, 62, 63, 64])
def test_permutation_comes_back_and_is_one_to_one(width):
    r = np.random.default_rng(width)
    top = (1 << width) - 1
    keys = np.unique(np.concatenate([r.integers(0, top, 5000, np.uint64, endpoint=True), np.array([0, top], np.uint64)]))
    order = qf.Permutation(width)
    there = order.forward(keys)
    assert int(there.max()) <= top and len(np.unique(there)) == len(keys)
    assert (order.backward(there) == keys).all()


@pytest.mark.parametrize("width", [3, 16, 40, 64])
def test_filters_lose_nothing(width):
    r = np.random.default_rng(width)
    parts = [r.integers(0, min((1 << width) - 1, 5000), n, np.uint64) for n in (0, 1, 900, 40_000)]
    order = qf.Permutation(width)
    filters = [qf.counted(order.forward(p)) for p in parts]
    assert all((qf.unpacked(qf.packed(f)).keys == f.keys).all() and (qf.unpacked(qf.packed(f)).n == f.n).all() for f in filters)
    cut = [list(qf.split(qf.unpacked(qf.packed(f)), width, min(width, 3))) for f in filters]
    whole = Counter()
    for top in range(1 << min(width, 3)):
        own = qf.merged(f for c in cut for upper, f in c if upper == top)
        assert (np.diff(own.keys.astype(object)) > 0).all()
        whole.update(dict(zip(order.backward(own.keys).tolist(), own.n.tolist(), strict=True)))
    assert whole == Counter(np.concatenate(parts).tolist())


def test_a_filter_is_compact():
    keys = np.random.default_rng(1).integers(0, 1 << 40, 200_000, np.uint64)
    own = qf.counted(qf.Permutation(40).forward(keys))
    assert len(qf.packed(own)) < 8 * len(own.keys)


def brute(rows, longest=5, least=100, top=2000, absorbed=100):
    count, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            own = count.setdefault(lang, Counter())
            for size in range(1, longest + 1):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, own in count.items():
        candidates = [p for p, f in own.items() if len(p) > 1 and f >= least]
        gone = set()
        for p in candidates:
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * own[p] >= absorbed * own[p[i : i + size]]:
                        gone.add(p[i : i + size])
        scored = []
        for p in candidates:
            if p not in gone:
                cuts = [(1000 * own[p] * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                scored.append((-score, -own[p], " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def run(spark, rows, **k):
    df = spark.createDataFrame([(x, t, "x", 5) for x, t in rows], "lang string, text string, word string, n int").repartition(3)
    return sorted(map(tuple, co.collocations(df, **k).collect()))


def prose(seed, n, langs=("en", "de", None)):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "Éa", "éa", "ÉA", "x\x01", "\x1c", "und", "a.b", "end,", "ok\t", "z;"]
    weights = [9, 3, 8, 5, 5, 4, 2, 2, 2, 2, 1, 1, 2, 2, 2, 1]
    out = []
    for _ in range(n):
        words = r.choices(vocabulary, weights, k=r.randint(0, 60))
        if r.random() < 0.4:
            words += ["new", "york", "city", "hall", "park"][: r.randint(1, 5)]
        out.append((r.choice(langs), r.choice([" ", "  ", "\t", " \n "]).join(words)))
    return out


ODD = [(None, None), ("en", None), ("en", ""), ("en", " \t"), ("zz", "..,;"), ("und", "the of the of"), ("en", "﻿ the"), ("en", "漢字 漢字 漢字")]


@pytest.mark.parametrize("least", [1, 4, 30])
def test_as_counted_plainly(spark, least):
    rows = prose(3, 120) + ODD
    assert run(spark, rows, least=least) == brute(rows, least=least)


def test_limits_and_shares(spark):
    rows = prose(4, 150)
    assert run(spark, rows, least=5, top=7) == brute(rows, least=5, top=7)
    assert run(spark, rows, least=5, absorbed=60, longest=4) == brute(rows, least=5, absorbed=60, longest=4)
    assert run(spark, rows, least=5, longest=2) == brute(rows, least=5, longest=2)


def test_repeated_rows_and_one_language(spark):
    rows = prose(5, 20, ["en"]) * 8 + [("en", "same words again and again " * 3)] * 40
    assert run(spark, rows, least=20) == brute(rows, least=20)


def test_nothing_to_find(spark):
    assert run(spark, [], least=1) == []
    assert run(spark, ODD, least=100) == []
    assert run(spark, [("en", "one two three")], least=2) == []


def test_without_broadcast_tables_and_with_small_parts(spark, monkeypatch):
    rows = prose(6, 100) + ODD
    monkeypatch.setattr(co, "MOST_KEYS", 0)
    monkeypatch.setattr(co, "BLOCK", 8)
    assert run(spark, rows, least=3) == brute(rows, least=3)


def test_many_rounds_of_merging(spark, monkeypatch):
    rows = prose(7, 100)
    monkeypatch.setattr(co, "MERGE_BYTES", 64)
    monkeypatch.setattr(co, "SPLIT_BITS", 2)
    assert run(spark, rows, least=2) == brute(rows, least=2)


def test_a_very_long_text(spark):
    rows = [("en", "of the new york city " * 40_000), ("en", "of the. new york")]
    assert run(spark, rows, least=100) == brute(rows, least=100)


def test_query_reads_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op11(spark, sf).collect())) == brute(rows)
