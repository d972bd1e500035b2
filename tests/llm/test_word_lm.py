"""Word-level masked scores against plain Python."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seriesmill.llm import word_lm

ROWS = [(i, t) for i, t in enumerate([None, "", " ", *(" ".join(np.random.default_rng(i).choice([*"abcdefghijklmnopqrstuvw", "xa", "ya", "za"], 30)) for i in range(40))])]


def plain(rows, s):
    """Counts of real words and pairs by plain Python, mixed as the module says, with its class probabilities left out."""
    texts = [t.split() for _, t in rows if t and t.split()]
    words = Counter(w for t in texts for w in t) + Counter({"": len(texts)})
    both = Counter(p for t in texts for p in zip(["", *t], [*t, ""], strict=True))
    t = ["", *s, ""]
    return [(words[t[i - 1]], both[t[i - 1], t[i]], words[t[i + 1]], both[t[i], t[i + 1]]) for i in range(1, len(t) - 1)]


@pytest.mark.parametrize("size", [1 << 21, 100])
def test_counts_are_those_of_real_words(spark, monkeypatch, size):
    seen = []
    monkeypatch.setattr(word_lm, "CHUNK", size)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in word_lm.score(docs).collect()}
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        words = (t or "").split()
        assert got[i].n_tokens == len(words)
        if not words:
            assert got[i].log_prob == 0 and got[i].mean_log_prob is None
            continue
        # what the neighbours give alone is less than the score, by the class part that is left
        low = sum(np.log(max(word_lm.mixed(np.zeros(1), *(np.array([float(x)]) for x in c))[0], 1e-300)) for c in plain(ROWS, words))
        assert low < got[i].log_prob < 0
        seen.append(got[i].log_prob)
    assert len(set(seen)) > 1


def test_words_of_one_shape_are_told_apart(spark):
    """Both words are rare and of one shape, in the same places: only the pairs they make differ."""
    common = [chr(97 + k) * 3 for k in range(15)]
    rows = [(k, " ".join([*common, *common])) for k in range(60)]
    rows += [(100 + k, "kkka xxna kkkm") for k in range(30)] + [(200 + k, "qqqa yyna qqqm") for k in range(30)]
    rows += [(300, "kkka xxna kkkm"), (301, "kkka yyna kkkm")]
    got = {r.doc_id: r.log_prob for r in word_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[300] > got[301] + 1


def test_many_words_keep_their_own_ids():
    words = [f"w{k}a" for k in range(50_000)]
    ids, n = word_lm.word_ids(pa.array([" ".join(f"{chr(97 + k % 26)}{'bcdefghijk'[k // 26 % 10]}{'lmnopqrstu'[k // 260 % 10]}{'vwxyzbcdef'[k // 2600 % 10]}{'ab'[k // 26000 % 2]}" for k in range(len(words)))]))
    assert n.tolist() == [50_000] and len(np.unique(ids)) == 50_000


def test_mixed_is_a_distribution():
    rng = np.random.default_rng(1)
    before, after, cls = rng.integers(0, 9, 50), rng.integers(0, 9, 50), rng.dirichlet(np.ones(50))
    before[3] += 1
    after[3] += 1
    total = 0.0
    for w in range(50):  # the masked place is word 3: any other word would have had a pair more
        add = float(w != 3)
        p = word_lm.mixed(cls[w : w + 1], np.array([before.sum()]), np.array([before[w] + add]), np.array([after.sum()]), np.array([after[w] + add]))
        total += p[0]
    assert total == pytest.approx(1)


def test_numbers_come_back():
    for values in ([], [0], [1, 2**63, 2**64 - 1]):
        v = np.array(values, np.uint64)
        assert (word_lm.unpack(word_lm.pack(v)) == v).all()


def test_empty_table(spark):
    assert word_lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
