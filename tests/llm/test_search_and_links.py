"""Near-duplicates, neighbours, top-k and urls against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seriesmill.llm import ann, exact_topk, golay, simhash
from seriesmill.llm.components import components
from seriesmill.llm.queries import URL_RULES
from seriesmill.llm.url_filter import fit, host_and_path, judge

MASK = (1 << 64) - 1


def print_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups_by_hand(prints):
    """Component of each print by comparing all pairs."""
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    every = sorted(label)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {p: root(p) for p in every}


@pytest.fixture(scope="module")
def copies(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = r.choice(words, 200)
        for k in range(12):
            own = text.copy()
            own[r.integers(0, 200, k % 4)] = "other"
            rows.append((len(rows), " ".join(own), "x", 1, "c"))
    rows += [(len(rows) + i, " ".join(r.choice(words, 5)), "x", 1, "c") for i in range(100)]
    rows += [(900 + i, t, None, None, None) for i, t in enumerate([None, "", " \t\n", "one", "One ", "two words", "É é", "x\x0by z w v", "a " * 50_000])]
    rows += [(3, rows[3][1], "x", 1, "c"), (3, "a different text of id three", "x", 1, "c"), (None, rows[3][1], "x", 1, "c"), (None, "null id alone here", "x", 1, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int, fingerprint string").repartition(4)


def test_every_word_is_within_three_bits_of_one_codeword():
    words = np.random.default_rng(1).integers(0, 1 << 23, 5000).astype(np.uint32)
    near = words ^ golay.ERRORS[golay.remainders(words)]
    assert (np.bitwise_count(near ^ words) <= 3).all() and (golay.remainders(near) == 0).all()
    for word, row in zip(words[:100], golay.near(words[:100]), strict=True):
        around = [word, *(word ^ np.uint32(1 << i) for i in range(23))]
        assert {int(x) for x in row if x >= 0} == set(golay.decode(np.array(around, np.uint32)).tolist())


def test_prints_within_four_bits_share_a_key():
    r = np.random.default_rng(2)
    a = r.integers(0, MASK, 5000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for k in r.choice(64, 4, replace=False):
            b[i] ^= np.uint64(1 << int(k))
    first, second = (set(zip(*(x.tolist() for x in simhash.keys(v)), strict=True)) for v in (a, b))
    assert len({place for place, _ in first & second}) == len(a)


def test_forest_has_the_components_of_all_links(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 50)
    r = np.random.default_rng(4)
    prints = r.integers(0, 1 << 12, 300).astype(np.uint64) * np.uint64(0x0011001100110011)
    group = np.sort(r.integers(0, 5, 300))
    x, y = simhash.forest(group, prints)
    assert (group[x] == group[y]).all()
    for g in range(5):
        own = np.flatnonzero(group == g)
        by_hand = groups_by_hand([int(prints[i]) for i in own])
        label = {i: i for i in own.tolist()}
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            if a in label:
                label[a] = b
        for i in own.tolist():
            for j in own.tolist():
                same = by_hand[int(prints[i])] == by_hand[int(prints[j])]

                def root(k):
                    while label[k] != k:
                        k = label[k]
                    return k

                assert (root(i) == root(j)) == same


@pytest.mark.parametrize("block", [4096, 3])
def test_near_duplicates(copies, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct: links(distinct, block))
    got = simhash.near_duplicates(copies).collect()
    rows = copies.collect()
    prints = {(r.doc_id, r.text): print_by_hand(r.text) for r in rows}
    group = groups_by_hand(set(prints.values()))
    least = {}
    for (doc_id, _), p in prints.items():
        if doc_id is not None:
            least[group[p]] = min(doc_id, least.get(group[p], doc_id))
    want = sorted((str(r.doc_id), f"{prints[r.doc_id, r.text]:016x}", str(least.get(group[prints[r.doc_id, r.text]]))) for r in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert len(set(least.values())) < len({p for p in prints.values()})


def test_one_row_of_each_group_stays(copies):
    kept = simhash.without_copies(copies)
    assert kept.columns == copies.columns
    rows = kept.collect()
    prints = [print_by_hand(r.text) for r in rows]
    group = groups_by_hand({print_by_hand(r.text) for r in copies.collect()})
    assert len({group[p] for p in prints}) == len(rows) == len(set(group.values()))
    assert simhash.without_copies(copies.limit(0)).count() == 0 and simhash.near_duplicates(copies.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 40)] + [(201, 200), (202, 201), (202, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, score double"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(8)
    v = r.standard_normal((600, 16)).astype(np.float32)
    v[100:300] = v[7]  # a third are one vector
    v[300:320] *= 9
    rows = [(i, x.tolist(), 0, "i", "v", 0.5) for i, x in enumerate(v)]
    rows += [(700, None, 0, None, None, None), (750, [0.0] * 16, 0, "", "", 0.0), (800, [float("nan")] + [0.0] * 15, 0, "", "", 0.0)]
    rows += [(850, [float("inf")] + [0.0] * 15, 0, "", "", 0.0), (900, [None] + [1.0] * 15, 0, "", "", 0.0), (None, [1.0] * 16, 0, "", "", 0.0)]
    rows += [(950, [], 0, "", "", 0.0)]
    rows += [(11, v[12].tolist(), 0, "", "", 0.0), (50, v[50].tolist(), 0, "", "", 0.0)]  # repeated ids
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def usable(vectors, zero):
    out = []
    for r in vectors.collect():
        if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and (zero or any(r.embedding)):
            out.append((r.vec_id, np.array(r.embedding, np.float64)))
    return out


@pytest.mark.parametrize("block", [2048, 4])
def test_exact_top_k(vectors, monkeypatch, block):
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(exact_topk, "ROWS_AT_ONCE", 64)
    rows = [(i, np.floor(256 * v).astype(np.int64)) for i, v in usable(vectors, zero=True)]
    want = set()
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        own = next(v for i, v in rows if i == q)
        best = sorted((-int(v @ own), i) for i, v in rows if i != q)[:5]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    got = [tuple(r) for r in exact_topk.top_k(vectors, F.col("vec_id") % 50 == 0).collect()]
    assert set(got) == want and len(got) == len(want)


def test_exact_top_k_of_few_and_none(vectors, spark):
    few = vectors.filter("vec_id in (50, 51, 52)")
    assert {(r.query_id, r.vec_id) for r in exact_topk.top_k(few, F.col("vec_id") % 50 == 0).collect()} == {(50, 51), (50, 52)}
    assert exact_topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_exact_top_k_beyond_doubles(spark):
    rows = [(50, [3.0e5, 1.0]), (1, [3.0e5, 1.0]), (2, [3.0e5, 2.0])]
    got = exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 50).collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, (3 * 10**5 * 256) ** 2 + 2 * 256**2), (1, (3 * 10**5 * 256) ** 2 + 256**2)]
    with pytest.raises(ValueError, match="long"):
        exact_topk.top_k(spark.createDataFrame([(50, [1e30])], "vec_id long, embedding array<double>"), F.col("vec_id") == 50)


@pytest.mark.parametrize("shard", [8192, 128])
def test_neighbours(vectors, monkeypatch, shard):
    monkeypatch.setattr(ann, "SHARD", shard)
    rows = usable(vectors, zero=False)
    got = {}
    for r in ann.nearest(vectors, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = sorted({i for i, _ in rows if i % 20 == 0})
    assert sorted(got) == queries
    hits = 0
    for q in queries:
        own = next(v for i, v in rows if i == q)
        best = sorted((-(v * own).sum(), i) for i, v in rows if i != q)[:20]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21))
        scores = {(i, (v * own).sum()) for i, v in rows}
        assert all((i, s) in scores for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i in best} & {i for _, i, _ in found})
    assert hits >= 0.9 * 20 * len(queries)


def test_neighbours_are_k_where_near_ones_are_few(spark):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((1500, 32))
    v[:21] = v[0] + 0.2 * rng.standard_normal((21, 32))  # hardly more than k near ones
    rows = [(i, x) for i, x in enumerate(v.tolist())] + [(40, v[40].tolist())] * 600
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = Counter(r.query_id for r in ann.nearest(table, F.col("vec_id") % 20 == 0).collect())
    assert got == {q: 20 for q in range(0, 1500, 20)}
    same = spark.createDataFrame([(20, [1.0, 2.0])] * 700 + [(21, [2.0, 1.0]), (22, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(same, F.col("vec_id") == 20).collect()) == [(20, 1, 21), (20, 2, 22)]


def test_walked_windows_count_like_wide_ones(monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((900, 8))
    shard = ann.Shard(v, 10.0, 16)
    order = np.argsort(shard.places, axis=1)
    low, size = ann.windows(shard.values, rng.standard_normal((5, 16)) / 3, np.full(5, 0.3))
    for i in range(5):
        counts = []
        for walk in (0, 10**9):
            monkeypatch.setattr(ann, "WALK", walk)
            counts.append(ann.collisions(shard.places, order, low[i], size[i]).tolist())
        assert counts[0] == counts[1] and sum(counts[0]) == size[i].sum()


def test_vectors_of_different_lengths_are_an_error(spark):
    table = spark.createDataFrame([(20, [1.0, 2.0]), (21, [2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="differ in length"):
        ann.nearest(table, F.col("vec_id") == 20).collect()


def test_neighbours_of_few_and_none(vectors):
    few = vectors.filter("vec_id in (60, 61, 750)")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(few, F.col("vec_id") % 20 == 0).collect()] == [(60, 1, 61)]
    assert ann.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("kind", ["unit", "lognormal", "one long"])
def test_neighbours_of_unequal_norms(spark, kind):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((4000, 64))
    v /= np.sqrt((v * v).sum(1))[:, None]
    if kind == "lognormal":
        v *= rng.lognormal(0, 0.5, 4000)[:, None]
    elif kind == "one long":
        v[7] *= 10
    rows = [(i, x) for i, x in enumerate(v.tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = {(r.query_id, r.vec_id) for r in ann.nearest(table, F.col("vec_id") % 40 == 0).collect()}
    score = v[::40] @ v.T
    score[np.arange(100), np.arange(0, 4000, 40)] = -np.inf
    best = {(40 * q, int(i)) for q in range(100) for i in np.argsort(-score[q])[:20]}
    assert len(got) == len(best) and len(got & best) >= 0.97 * len(best)


URLS = [
    None, "", "http://", "x", "http://A.EXAMPLE.org", "http://É.Org/ES/\nx?y", "http://example.org/es/?a#b", "http://a.b.com/de/://x",
    "ftp://q://com/fr/", "http://com/de/x", "//", "http://" + "a" * 100_000 + ".org/" + "b" * 100_000, "http://x.net#/de/",
    "https://www.example.org/en/12", "https://notexample.org/en/12", "http://x.com/de/1", "http://x.com/fr/1", "http://y.org/q",
]


def judged_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for r in URL_RULES:
        own, _, start = r.where.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
            fits.append(r)
    return host, path, max(fits, key=lambda r: len(r.where)) if fits else None


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", 0.0) for i, u in enumerate(URLS)] + [(4, URLS[4], "h", 0.0)], "page_id long, url string, host string, score double")
    got = judge(pages, URL_RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule = judged_by_hand(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule.where if rule else None)
        assert r.verdict == (rule.verdict if rule else ("block" if r.score >= 0.5 else "allow")) and 0 <= r.score <= 1
    assert judge(pages.limit(0), URL_RULES).count() == 0


def test_url_model_learns(spark):
    rows = [(f"site{i}.example", "/casino/win" if i % 2 else "/news/today", i % 2 == 1) for i in range(80)] + [("", "", None)]
    labelled = spark.createDataFrame(rows, "host string, path string, blocked boolean")
    model = fit(labelled)
    unseen = spark.createDataFrame([("other.test", "/casino/now"), ("other.test", "/news/old")], "host string, path string")
    from seriesmill.llm.url_filter import buckets

    score = [r.s for r in unseen.select(model.score(buckets(F.col("host"), F.col("path"), model.bits)).alias("s")).collect()]
    assert score[0] > 0.5 > score[1]


def test_url_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.com/de/")], "page_id long, url string")
    plan = judge(pages, URL_RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert host_and_path(F.col("url"))


def test_a_frequent_url_is_one_weighted_example(spark, monkeypatch):
    tables = {}
    from seriesmill.llm import url_filter

    real = url_filter.written
    monkeypatch.setattr(url_filter, "written", lambda df, name: tables.setdefault(name, real(df, name)))
    rows = [("often.org", "/a", True)] * 1000 + [(f"h{i}.org", f"/{i}", False) for i in range(20)]
    fit(spark.createDataFrame(rows, "host string, path string, blocked boolean"), bits=8, bound=100, steps=1)
    assert sorted(r.n for r in tables["url-examples"].collect()) == [1] * 20 + [1000]


def test_exact_top_k_with_one_odd_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((60, 64)).tolist())]
    rows[7][1][3] = 2.0e9  # times itself it would not fit
    rows[50][1][3] = 1.5e9
    rows += [(60, [-1e30] + [0.0] * 63)]
    rows[0][1][0], rows[50][1][0] = 0.5, 0.25  # so that vector 60 comes last
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for query in (0, 50):
        got = [(r.score, r.vec_id) for r in exact_topk.top_k(table, (F.col("vec_id") == query)).orderBy("rank").collect()] if query == 0 else None
        best = sorted(((sum(a * b for a, b in zip(whole[query], v, strict=True)), i) for i, v in whole.items() if i != query), key=lambda x: (-x[0], x[1]))[:5]
        if query == 0:
            assert got == best
        else:
            assert best[0][0] >= 1 << 63
            with pytest.raises(Exception, match="fit in a long"):
                exact_topk.top_k(table, F.col("vec_id") == query).collect()
