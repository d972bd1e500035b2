"""Marked words against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from seriesmill.llm import piece_words as pw
from seriesmill.llm.queries import PIECES, op12

PARTS = [
    "a", "B", "é", " ", "  ", "\t", "\n", "\r", "\x0b", "\x1c", "\x85", "▁", "▁▁", "<s>", "</s>", "<unk>", "<0x41>", "1", "23", "!", "...", "ß", "Σς",
    "ž", "”", "«", "́", "😀", "漢字", "ॐ", "‍", "z" * 40, "\x00", "\x7f", "ﬁ", "　", "the", "ing", "ation", " " * 50, "ab" * 60,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(1)
    out = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    out += ["".join(r.choice("aA \n") for _ in range(r.randint(1, 3000))) for _ in range(15)]
    out += ["".join(r.choice(["th", "e", "in", "ing", "haha", "lol", "!!", "é"]) for _ in range(3000)) for _ in range(5)]
    return [*out, "", " ", "\n", " " * 5000, "a" * 5000, "\n" * 3000, "x" * 50_000 + " y", "the end"]


def ids_of(table, texts):
    return [np.frombuffer(b"".join(v for part in parts for v in part), "<i4").tolist() for parts in table.look_up(texts)]


def digests(library, text):
    ids = library.encode(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_ids_and_text_are_the_library_s(library, odd_texts):
    own = pw.model(PIECES)
    for text, ids in zip(odd_texts, ids_of(pw.Words(own, pw._plain), odd_texts), strict=True):
        assert ids == library.encode(text)
        assert own.decode(ids) == library.decode(ids)


def test_a_full_table_and_small_parts(library, odd_texts, monkeypatch):
    monkeypatch.setattr(pw, "MOST_WORDS", 5)
    monkeypatch.setattr(pw, "TEXT_AT_ONCE", 64)
    assert ids_of(pw.Words(pw.model(PIECES), pw._plain), odd_texts[:500]) == library.encode(odd_texts[:500])


def test_every_word_from_the_heap_and_from_rows(library, odd_texts):
    own = pw.model(PIECES)
    words = {w.replace(" ", "▁") for t in odd_texts[:600] for w in pw.marked(t) if w}
    short = {w for w in words if len(w) <= pw.ROW}
    by_rows = dict(own._short(short))
    assert all(own._heap(w) == by_rows[w] == own._long(w) for w in short)


def test_any_ids_decode_like_the_library(library):
    own, r = pw.model(PIECES), random.Random(2)
    for _ in range(1500):
        ids = [r.randrange(32_000) if r.random() < 0.5 else r.randrange(300) for _ in range(r.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids)


def test_a_distinct_word_is_segmented_once(monkeypatch):
    seen = []
    plain = pw.Model.segment

    def counted(self, words):
        words = list(words)
        seen.extend(words)
        return plain(self, words)

    monkeypatch.setattr(pw.Model, "segment", counted)
    table = pw.Words(pw.model(PIECES), pw._plain)
    for _ in range(3):
        ids_of(table, ["so it goes, so it goes", "it goes on"] * 50)
    assert len(seen) == len(set(seen)) == 5  # of them "so" without its mark stands nowhere


def test_round_trip_of_odd_rows(spark, library, odd_texts):
    rows = [(i, t, "x", [i]) for i, t in enumerate(odd_texts[:300])]
    rows += [(900, None, None, None), (901, "", "x", []), (902, "one thing\n" * 60_000, "x", [1]), (None, "no id", "x", [1]), (0, "a repeated id", "x", [1]), (0, "a repeated id", "x", [1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids array<int>").repartition(3)
    found = sorted(map(tuple, pw.round_trip(docs, PIECES).collect()), key=str)
    assert found == sorted(((i, *digests(library, t)) for i, t, _, _ in rows), key=str)
    assert pw.round_trip(docs.filter("false"), PIECES).collect() == []


def test_ids_as_a_column_and_back(spark, library, odd_texts):
    rows = [(i, t, "x") for i, t in enumerate([*odd_texts[:200], None, "", "last"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    encoded = pw.encode(docs, PIECES)
    assert encoded.columns == docs.columns
    found = {r["doc_id"]: r for r in pw.decode(encoded, PIECES, text="back").collect()}
    for i, t, _ in rows:
        assert found[i]["ids"] == library.encode(t or "")
        assert found[i]["back"] == library.decode(library.encode(t or ""))
    none = pw.decode(encoded.withColumn("ids", F.lit(None).cast("array<int>")), PIECES)
    assert none.filter("text <> ''").count() == 0


def test_other_models_are_refused(tmp_path):
    proto = model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.pieces[400].piece = "a▁b"
    with open(tmp_path / "crossing.model", "wb") as f:
        f.write(proto.SerializeToString())
    with pytest.raises(ValueError, match="cross"):
        pw.Model(str(tmp_path / "crossing.model"))


def test_query_reads_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op12(spark, sf).collect())) == sorted((i, *digests(library, t)) for i, t in rows)
