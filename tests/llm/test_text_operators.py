"""Language, quality and language-model operators against plain Python on small texts."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesmill.llm import language_id, masked_lm, quality, text
from seriesmill.llm.queries import fold

WORDS = {"en": "the cat and this thing with that", "fr": "le chat être où çà même une"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string"


def documents(spark):
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        rows.append((i, " ".join(np.random.default_rng(i).choice(WORDS[lang].split(), 20)), lang, None, None, "x", None))
    rows += [
        (60, None, "en", None, 0, None, None), (61, "", None, None, 0, None, None), (62, "12 !? 3", "en", None, 0, None, None),
        (63, "the " * 40_000, None, None, 0, None, None), (0, "le chat", "fr", None, 0, None, None), (None, "the cat", None, None, 0, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def letters(s):
    return [ord(c.lower()[0]) if c.isalpha() else 0 for c in s]


@pytest.mark.parametrize("limit", [1 << 20, 50, 7])
def test_grams_are_those_of_whole_texts(monkeypatch, limit):
    monkeypatch.setattr(language_id, "SEGMENT", limit)
    texts = ["Abc, déf!! gh", "", None, "  x  ", "ñandú 12 A😀b𐐀", "é" * 40, "ab " * 30]
    found = {i: 0 for i in range(len(texts))}
    for rows, starts, _, pair, two, _, three in language_id.gram_batches(pa.array(texts), 16):
        for k, row in enumerate(rows):
            end = starts[k + 1] if k + 1 < len(starts) else len(pair)
            found[row] += two[starts[k] : end].sum() + three[starts[k] : end].sum()
    for i, s in enumerate(texts):
        a = [0, 0, *letters(s or "")]
        two = sum(a[k] > 0 or a[k - 1] > 0 for k in range(2, len(a)))
        three = sum((a[k] > 0 or a[k - 1] > 0) and (a[k - 1] > 0 or a[k - 2] > 0) for k in range(2, len(a)))
        assert found[i] == two + three


def test_naive_bayes_by_hand(spark):
    docs = documents(spark)
    model = language_id.fit(docs)
    assert model.languages == ["en", "fr"]
    known = [r for r in docs.collect() if r.text is not None and r.lang is not None]

    def grams(s):
        out = []
        for rows, starts, _, pair, two, triple, three in language_id.gram_batches(pa.array([s]), 16):
            out += [*pair[two].tolist(), *triple[three].tolist()]
        return out

    counts = {lang: np.zeros(1 << 16) for lang in WORDS}
    for r in known:
        np.add.at(counts[r.lang], grams(r.text), 1)
    logs = {lang: np.log((c + 0.5) / (c + 0.5).sum()) for lang, c in counts.items()}
    prior = {lang: math.log(sum(r.lang == lang for r in known) / len(known)) for lang in WORDS}
    for s in ["the chat", "où", "cat même with"]:
        want = {lang: prior[lang] + logs[lang][grams(s)].sum() for lang in WORDS}
        best = max(want, key=want.get)
        name, score = model.predict(pa.array([s]))
        assert name == [best]
        assert score[0] == pytest.approx(1 / sum(math.exp(w - want[best]) for w in want.values()), rel=1e-4)


def test_language_of_odd_rows(spark):
    docs = documents(spark)
    got = language_id.predict(docs, language_id.fit(docs), keep=["doc_id"]).collect()
    assert len(got) == docs.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert by_id[60] == by_id[61] == by_id[62] == [("und", 0.0)]
    assert by_id[63][0][0] == "en" and len(by_id[0]) == 2
    assert all(0 <= s <= 1 for rows in by_id.values() for _, s in rows)


def test_language_without_training_rows(spark):
    docs = documents(spark)
    model = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, model, keep=["doc_id"]).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model, keep=["doc_id"]).count() == 0


def test_too_many_languages_is_an_error(spark):
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(documents(spark), most_languages=1)


def test_fold_is_crc32_of_the_text(spark):
    for r in spark.createDataFrame([(0,), (17,), (None,)], "doc_id long").select("doc_id", fold("doc_id", 3).alias("f")).collect():
        assert r.f == (0 if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 3)


def test_features_do_not_depend_on_segments(monkeypatch):
    texts = pa.array(["aa bb aa!!", "", None, "x " * 50 + "yy zz " * 40, "ÀÉ 1a2"])
    whole = quality.features(texts, 18)
    cut = text.segments
    monkeypatch.setattr(quality, "segments", lambda offsets, cuts: cut(offsets, cuts, 30))
    for a, b in zip(whole, quality.features(texts, 18), strict=True):
        assert np.allclose(a, b)
    lengths = np.add.reduceat(whole[2].astype(float) ** 2, whole[0][:-1][np.diff(whole[0]) > 0])
    assert np.allclose(lengths, 1, atol=1e-5)


def test_ftrl_update_by_hand():
    state = quality.Ftrl.new(2)
    state.learn(np.array([1]), np.array([1.0]), 1.0)
    assert state.z[1] == state.z[-1] == -0.5 and state.n[1] == 0.25  # gradient (0.5 - 1) x 1
    w = (0.5 - 0.02) / ((1 + 0.5) / 0.5 + 0.02)
    assert state.weights()[1] == pytest.approx(w)


def test_quality_learns_and_scores_every_row(spark):
    rows = [(i, ("good words here " if i % 3 else "BAD!! THINGS!! ") * (5 + i % 7), "x") for i in range(300)]
    rows += [(300, None, "x"), (301, "", "x"), (302, "BAD!! " * 30_000, "x"), (5, "good words", "x"), (None, "good words", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame(
        [(i, int(i % 3 > 0), 0) for i in range(300)] + [(300, 1, 0), (None, 1, None), (7, None, None)], "doc_id long, quality int, toxic int"
    )
    model = quality.fit(docs, labels, where=fold("doc_id", 4) != 2)
    got = quality.score(docs, model, keep=["doc_id"]).collect()
    assert len(got) == len(rows)
    score = {r.doc_id: r.score for r in got}
    assert all((score[i] >= 0.7) == (i % 3 > 0) for i in range(300))
    assert score[302] < 0.5 and score[300] == score[301] and all(0 <= s <= 1 for s in score.values())


def test_quality_without_labels_gives_one_half(spark):
    docs = documents(spark)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, empty, where=F.lit(True))
    assert {r.score for r in quality.score(docs, model, keep=["doc_id"]).collect()} == {0.5}


def test_sample_of_labels_keeps_about_the_bound(spark):
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    n = quality.sample_labels(labels, "doc_id", "quality", F.lit(True), 1000).count()
    assert 850 < n < 1150


def test_masked_scores_by_hand(spark):
    docs = documents(spark)
    model = masked_lm.fit(docs)
    every = pa.array([r.text for r in docs.collect()])
    ids, offsets = masked_lm.word_ids(every)
    n, logs = model.score(every)
    for d in range(len(every)):
        own = ids[offsets[d] : offsets[d + 1]]
        c = [0, 0, *model.classes[own].tolist(), 0, 0]
        coarse = masked_lm._COARSE[c]
        total = 0.0
        for k, i in enumerate(own, start=2):
            window = ((coarse[k - 2] * masked_lm.CLASSES + c[k - 1]) * masked_lm.CLASSES + c[k + 1]) * masked_lm.COARSE + coarse[k + 2]
            total += float(model.given[window, c[k]]) + float(model.within[i])
        assert n[d] == len(own) and logs[d] == pytest.approx(total, rel=1e-4, abs=1e-6)
    assert np.allclose(np.exp(model.given[:, 1:].astype(float)).sum(1), 1, atol=1e-4)
    got = {r.doc_id: r for r in masked_lm.score(docs, model).collect()}
    assert got[60].n_tokens == 0 and got[60].log_prob == 0 and got[60].mean_log_prob is None
    assert got[63].n_tokens == 40_000


def test_window_network_learns():
    numbers = np.arange(40)
    counts = np.zeros((40, masked_lm.CLASSES))
    counts[numbers, 1 + numbers % 3] = 10
    losses = masked_lm.WindowNetwork().fit(numbers, counts)
    assert losses[-1] < 0.3 * losses[0]


def test_masked_on_an_empty_table(spark):
    docs = documents(spark).limit(0)
    assert masked_lm.score(docs, masked_lm.fit(docs)).count() == 0
