"""Token operators against the tokenizers library."""

import hashlib
import json
import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesmill.llm import bpe, packing, simple8b, token_files
from seriesmill.llm.queries import TOKENIZER
from seriesmill.llm.tokens import WordIds, WordTable
from seriesmill.session import scratch_table

ALPHABET = [
    "a", "B", "é", "É", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", " ", "'", "'s", "'LL", "<|", "endoftext|>",
    "<|startoftext|>", "<|STARTOFTEXT|>", "1", "23", "!", ",", "...", "ß", "İ", "Σς", "é", "́", "😀", "漢字", "ॐ", "‍", "_", "-",
    "z" * 30, "\x00", "\x7f", "ﬁ", "Å", "　", "२", "the", "ing",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(5)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(800)]
    out += ["".join(r.choice("aA") for _ in range(r.randint(1, 2000))) for _ in range(10)]
    out += ["".join(r.choice(["th", "e", "in", "ing", "haha", "lol", "!!"]) for _ in range(3000)) for _ in range(5)]
    return out


@pytest.fixture(scope="module")
def docs(spark, odd_texts):
    rows = [(i * 3, t, "x", 0) for i, t in enumerate(odd_texts[:200])]
    rows += [(601, None, "x", 0), (602, "", None, 0), (603, "the thing " * 30_000, "x", 0), (604, "!" * 9000, "x", 0), (0, "a repeated id", "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, start long").repartition(3)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_word_ids_are_the_library_s(library, odd_texts):
    words = WordIds(TOKENIZER)
    for text, parts in zip(odd_texts, words.encode([t.encode() for t in odd_texts]), strict=True):
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == ids_of(library, text)


def test_word_ids_with_a_full_table(library, odd_texts, monkeypatch):
    monkeypatch.setattr("seriesmill.llm.tokens.MOST_WORDS", 5)
    monkeypatch.setattr("seriesmill.llm.tokens._TEXT_AT_ONCE", 64)
    words = WordIds(TOKENIZER)
    for text, parts in zip(odd_texts[:300], words.encode([t.encode() for t in odd_texts[:300]]), strict=True):
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == ids_of(library, text)


def test_word_ids_of_long_words_and_texts(library, monkeypatch):
    monkeypatch.setattr("seriesmill.llm.tokens._TEXT_AT_ONCE", 1000)
    words, r = WordIds(TOKENIZER), random.Random(8)
    a = b = "x"
    for _ in range(11):  # two words of equal sums of powers
        a, b = a + b.translate({120: 121, 121: 120}), b + a.translate({120: 121, 121: 120})
    pair = (a, a.translate({120: 121, 121: 120}))
    texts = [*pair, "a" * 300 + " " + "b," * 400, " ".join(pair), "the " * 2000 + "q" * 9000 + " end", "".join(r.choice("ab  1.-\n") for _ in range(30_000)), ""]
    for text, parts in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == ids_of(library, text)


def test_word_table_keeps_what_is_met_again():
    r = np.random.default_rng(2)
    first, second = r.integers(0, 1 << 64, (2, 4000), np.uint64)
    first[1::2] = first[::2]  # equal in one hash, not in the other
    ids = [np.arange(i, i + i % 5, dtype=np.uint32) for i in range(4000)]
    table = WordTable()
    for at in range(0, 4000, 500):
        table.add(first[at : at + 500], second[at : at + 500], ids[at : at + 500])
    rows = table.find(first, second)
    assert (rows == np.arange(4000)).all() and (table.find(first, second + np.uint64(1)) < 0).all()
    table.again[100:200] = True
    table.shrink(1000, 4000)
    rows = table.find(first, second)
    assert np.flatnonzero(rows >= 0).tolist() == [*range(100, 200)]
    kept, cuts = table.take(rows[100:200])
    assert [kept[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [ids[i].tolist() for i in range(100, 200)]


def test_other_tokenizer_files_are_refused(tmp_path):
    with open(TOKENIZER, encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(json.dumps(file), encoding="utf-8")
    with pytest.raises(ValueError, match="not cut at blanks"):
        WordIds(str(tmp_path / "other.json"))


def test_transducer_is_the_library(library, odd_texts):
    codec = bpe.codec(TOKENIZER)
    for text in odd_texts:
        ids = [i for part in codec.encode(text.encode()) for i in part]
        assert ids == ids_of(library, text)
        decoder = bpe.Decoder(codec)
        half = len(ids) // 2
        assert decoder.feed(ids[:half]) + decoder.feed(ids[half:]) + decoder.end() == library.decode(ids, skip_special_tokens=False)


def test_text_comes_back_from_single_ids():
    codec = bpe.codec(TOKENIZER)
    decoder = bpe.Decoder(codec, plain=False)
    ids = [i for part in codec.encode("ünï 😀漢 end".encode()) for i in part]
    assert "".join(decoder.feed([i]) for i in ids) + decoder.end() == "ünï 😀 漢 end "


def test_lookahead_is_sufficient_and_counted_from_the_list():
    # ab and then b+cd..: a chain of two merges can reach back over two tokens.
    vocabulary = {t: i for i, t in enumerate(["a", "b", "c", "d", "cd", "bcd", "abcd", "ab"])}
    merges = bpe.Merges(vocabulary, [("c", "d"), ("b", "cd"), ("a", "bcd"), ("a", "b")], "")
    assert merges.lookahead == 3
    r = random.Random(1)

    def slow(text):
        parts = list(text)
        ranks = {("c", "d"): 0, ("b", "cd"): 1, ("a", "bcd"): 2, ("a", "b"): 3}
        while True:
            found = min(((ranks.get(p, 99), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))), default=(99, 0))
            if found[0] == 99:
                return [vocabulary[p] for p in parts]
            i = found[1]
            parts[i : i + 2] = ["".join(parts[i : i + 2])]

    for _ in range(300):
        text = "".join(r.choice("abcd") for _ in range(r.randint(1, 80)))
        assert [*merges.stream(text)] == slow(text)


def test_round_trip_query(spark, docs, library):
    want = Counter()
    for r in docs.collect():
        ids = ids_of(library, r.text)
        text = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(docs, TOKENIZER).collect())) == want
    assert bpe.round_trip(docs.limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 239, 240, 241, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 50_000, 1 << 40, (1 << 64) - 1])
def test_simple8b_round_trip(n, top):
    r = np.random.default_rng(n)
    values = r.integers(0, top, n, dtype=np.uint64)
    values[n // 2 : n // 2 + 300] = 0
    words, blocks, escapes = simple8b.encode(values)
    assert (simple8b.decode(words, escapes) == values).all()
    assert len(blocks) == -(-n // simple8b.BLOCK)


def test_simple8b_packs_small_values():
    words, _, _ = simple8b.encode(np.full(1024, 3, np.uint64))
    assert len(words) <= 1024 // 30 + 3


def test_ids_between_blocks():
    ids = np.random.default_rng(0).integers(0, 49_000, 5000).astype("<u4")
    row = token_files._chunk(0, 0, 0, [ids.tobytes()], [1], [5000])
    parts = [row.column(c)[0].as_py() for c in ("words", "block_word", "block_escape", "escapes")]
    for a, b in ((0, 5000), (1000, 1030), (1024, 2048), (4999, 5000), (7, 7)):
        assert (token_files.ids_between(*parts, a, b) == ids[a:b]).all()


def test_token_files(spark, docs, library, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK", 1000)
    path = scratch_table(spark, "test-token-files")
    token_files.write(docs, path, TOKENIZER)
    got = Counter(map(tuple, token_files.read(spark.read.parquet(path)).collect()))
    want, at = Counter(), 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or "")):
        ids = [*ids_of(library, r.text), 2]
        want[r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    assert got == want
    empty = scratch_table(spark, "test-token-files")
    token_files.write(docs.limit(0), empty, TOKENIZER)
    assert token_files.read(spark.read.parquet(empty)).count() == 0


def one_by_one(counts, capacity):
    gaps, n = [], 0
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            i = bisect_left(gaps, size)
            free = gaps.pop(i) if i < len(gaps) else capacity
            n += free == capacity
            if free > size:
                insort(gaps, free - size)
    return n


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_is_that_of_single_pieces(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 20, 64, 2048])
    counts = Counter(min(capacity, max(1, int(r.expovariate(r.choice([3, 10]) / capacity)))) for _ in range(r.choice([1, 30, 500])))
    plan, sequences = packing.best_fit(counts, capacity), {}
    for size, n in counts.items():
        rows = plan[plan["size"] == size]
        for rank in range(n):
            row = rows[np.searchsorted(rows["rank"], rank, side="right") - 1]
            far = rank - row["rank"]
            sequences.setdefault(int(row["sequence"] + far // row["each"]), []).append((int(row["offset"] + far % row["each"] * size), size))
    for own in sequences.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= capacity
    assert len(sequences) == one_by_one(counts, capacity)


def test_packing(spark, docs, library):
    got = packing.pack(docs, TOKENIZER).collect()
    by_doc = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want = Counter()
    for r in docs.collect():
        ids = np.array([*ids_of(library, r.text), 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert by_doc == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == one_by_one(Counter(r.length for r in got), 2048)
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_one_length_for_all(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    got = packing.pack(docs, TOKENIZER).toPandas()
    length = int(got["length"].iloc[0])
    assert got["sequence_id"].nunique() == -(-5000 // (2048 // length)) and not got.duplicated(["sequence_id", "offset"]).any()
