"""Ids of a sentencepiece BPE model by a table of distinct marked words, and texts from ids.

White space becomes marks, and no piece of the model has a mark behind another character. A text
is thus cut before each run of marks, and a marked word has the same ids wherever it stands. A
task segments every distinct one of a run of texts once, all of them together: their characters
are the rows of a matrix, and each step merges the best pair of every row. The ids go back
to the words' places by look-up, and so do decimals and decoded text where only these are wanted.

The table is bounded: words live in two generations. A word whose characters don't fit in a row
is cut where no piece joins two neighbours, and what is still too long is merged from a heap.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from seriesmill.llm.text import as_bytes

#: Words of a generation of the table.
MOST_WORDS = 150_000
#: Characters of a word that is a row; longer words are cut first.
ROW = 32
#: Bytes of text whose words are looked up together.
TEXT_AT_ONCE = 1 << 20
_MARK = "▁"
_NONE = np.int32(np.iinfo(np.int32).max)
# Letters, and signs of ASCII; no piece joins the two.
_LETTER, _SIGN = "A-Za-zÀ-ÿ", r"\x00-\x09\x0b-\x1f!-@\[-`{-\x7f"
# Blanks or a line end with letters or signs, letters, signs; or all up to the next blank or line end.
_MARKED = re.compile(
    rf"[ \n] *[{_LETTER}]++(?=[\x00-\x7f]|\Z)|[{_SIGN}]++(?=[{_LETTER} \n]|\Z)|[{_LETTER}]++(?=[\x00-\x7f]|\Z)"
    rf"|[ \n] *[{_SIGN}]++(?=[{_LETTER} \n]|\Z)|[ \n] *[^ \n]*|[^ \n]+"
)
_BEFORE_MARK = re.compile(r"[^ ](?=[ \n])")
# Kinds of pieces and models in the model's format.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE, _BPE = 1, 2, 3, 6, 2


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1  # type: ignore[attr-defined]


codecs.register_error("seriesmill-each-byte", _each_byte)


class Model:
    """Pieces and merges of one model file."""

    def __init__(self, path: str) -> None:
        proto = model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self._check(proto)
        kinds = [p.type for p in proto.pieces]
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.byte_ids = [i for i, kind in enumerate(kinds) if kind == _BYTE]
        self.control = frozenset(i for i, kind in enumerate(kinds) if kind == _CONTROL)
        self.unknown = kinds.index(_UNKNOWN)
        self.pieces = [
            b"" if kind == _CONTROL else " ⁇ ".encode() if kind == _UNKNOWN else bytes([int(p.piece[3:5], 16)]) if kind == _BYTE else p.piece.replace(_MARK, " ").encode()
            for p, kind in zip(proto.pieces, kinds, strict=True)
        ]
        self.decimals = [str(i).encode() for i in range(len(kinds))]
        self.symbols = -np.arange(1, 0x110001, dtype=np.int32)  # a character without a piece
        for piece, i in normal.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = i
        scores = {s: r for r, s in enumerate(sorted({p.score for p in proto.pieces if p.type == _NORMAL}, reverse=True))}
        merges, joins = [], set()
        for piece, i in normal.items():
            joins.update(zip(piece, piece[1:], strict=False))
            for at in range(1, len(piece)):
                if piece[:at] in normal and piece[at:] in normal:
                    merges.append((normal[piece[:at]] << 32 | normal[piece[at:]], i, scores[proto.pieces[i].score]))
        keys, merged, ranks = (np.array(x) for x in zip(*sorted(merges), strict=True))
        self.keys, self.merged, self.ranks = keys.astype(np.int64), merged.astype(np.int32), ranks.astype(np.int32)
        self.joins = np.sort(np.array([ord(a) << 32 | ord(b) for a, b in joins], np.int64))

    @staticmethod
    def _check(proto: model_pb2.ModelProto) -> None:
        """Only models whose words, letters and signs can be segmented on their own."""
        n, t = proto.normalizer_spec, proto.trainer_spec
        normal = [p.piece for p in proto.pieces if p.type == _NORMAL]
        single = {p for p in normal if len(p) == 1}
        bytes_in_order = [p.piece for p in proto.pieces if p.type == _BYTE] == [f"<0x{b:02X}>" for b in range(256)]
        fits = (
            t.model_type == _BPE and t.byte_fallback and bytes_in_order and not t.treat_whitespace_as_suffix
            and not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces
            and {p.type for p in proto.pieces} <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}
        )
        letter, sign = re.compile(f"[{_LETTER}]"), re.compile(f"[{_SIGN}]")
        apart = not any(letter.match(a) and sign.match(b) or sign.match(a) and letter.match(b) for p in normal for a, b in zip(p, p[1:], strict=False))
        if not (fits and apart) or any(_MARK in p.lstrip(_MARK) or "\n" in p or " " in p or not single.issuperset(p) for p in normal):
            raise ValueError("the model's pieces cross white space or the ends of letters, or it is of another kind")

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; none for what doesn't merge."""
        wanted = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0), self.ranks[at], _NONE)

    def _merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.merged[np.searchsorted(self.keys, left.astype(np.int64) << 32 | right.astype(np.int64))]

    def _rows(self, words: list[str]) -> list[list[int]]:
        """Ids of words of one length, at most ``ROW``: the best pair of every row at once, of equal ones the first."""
        n, width = len(words), len(words[0])
        symbols = self.symbols[np.array(words, f"<U{width}").view(np.uint32)].reshape(n, width)
        if width == 1:
            return [self._with_bytes(s) for s in symbols.tolist()]
        ranks = np.full((n, width), _NONE)
        ranks[:, :-1] = self._ranks(symbols[:, :-1], symbols[:, 1:])
        # Places of the symbols after and before each one; a merged symbol stays at its left place.
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        alive = np.ones((n, width), bool)
        rows = np.arange(n)
        while len(rows):
            best = ranks[rows].argmin(1)
            some = ranks[rows, best] != _NONE
            rows, left = rows[some], best[some]
            right = after[rows, left]
            merged = self._merge(symbols[rows, left], symbols[rows, right])
            symbols[rows, left] = merged
            alive[rows, right] = False
            ranks[rows, right] = _NONE
            beyond, back = after[rows, right], before[rows, left]
            after[rows, left] = beyond
            ranks[rows, left] = _NONE
            inner, outer = beyond < width, back >= 0
            r, x = rows[inner], beyond[inner]
            before[r, x] = left[inner]
            ranks[r, left[inner]] = self._ranks(merged[inner], symbols[r, x])
            r, x = rows[outer], back[outer]
            ranks[r, x] = self._ranks(symbols[r, x], merged[outer])
        flat, ends = symbols[alive].tolist(), np.cumsum(alive.sum(1)).tolist()
        found = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for i in np.flatnonzero((symbols < 0).any(1)).tolist():
            found[i] = self._with_bytes(found[i])
        return found

    def _with_bytes(self, symbols: list[int]) -> list[int]:
        """The ids; a character without a piece as its bytes."""
        if min(symbols) >= 0:
            return symbols
        return [i for s in symbols for i in ([s] if s >= 0 else [self.byte_ids[b] for b in chr(-s - 1).encode()])]

    def _heap(self, word: str) -> list[int]:
        """Ids of a word of any length: about 60 bytes a character."""
        symbols = array("i", self.symbols[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tobytes())
        n = len(symbols)
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        own = np.array(symbols)
        first = self._ranks(own[:-1], own[1:])
        at = np.flatnonzero(first != _NONE)
        heap = (first[at].astype(np.int64) << 32 | at).tolist()
        heapq.heapify(heap)
        pairs = self._pairs()
        while heap:
            entry = heapq.heappop(heap)
            left = entry & 0xFFFFFFFF
            right = after[left]
            if right >= n or symbols[left] == -1 << 30:
                continue
            found = pairs.get(symbols[left] << 32 | symbols[right]) if symbols[left] >= 0 and symbols[right] >= 0 else None
            if found is None or found[1] != entry >> 32:
                continue
            symbols[left], symbols[right] = found[0], -1 << 30
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            for start in (before[left], left):
                if start >= 0 and after[start] < n and symbols[start] >= 0 and symbols[after[start]] >= 0:
                    found = pairs.get(symbols[start] << 32 | symbols[after[start]])
                    if found is not None:
                        heapq.heappush(heap, found[1] << 32 | start)
        return self._with_bytes([s for s in symbols if s != -1 << 30])

    @cache  # noqa: B019
    def _pairs(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.merged.tolist(), self.ranks.tolist(), strict=True), strict=True))

    def _long(self, word: str) -> list[int]:
        """Ids of a long word, cut where no piece joins two neighbours."""
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
        pairs = points[:-1] << 32 | points[1:]
        at = np.minimum(np.searchsorted(self.joins, pairs), len(self.joins) - 1)
        cuts = [0, *(np.flatnonzero(self.joins[at] != pairs) + 1).tolist(), len(word)]
        parts = [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        known = dict(self._short({p for p in parts if len(p) <= ROW}))
        return [i for p in parts for i in (known[p] if p in known else self._heap(p))]

    def _short(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Words of at most ``ROW`` characters, with their ids."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for own in by_length.values():
            for at in range(0, len(own), 1 << 14):
                some = own[at : at + (1 << 14)]
                yield from zip(some, self._rows(some), strict=True)

    def segment(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Words, of which blanks are marks, with their ids; in any order."""
        marks = {w.replace(" ", _MARK): w for w in words}
        for w, ids in self._short(w for w in marks if len(w) <= ROW):
            yield marks[w], ids
        for w in marks:
            if len(w) > ROW:
                yield marks[w], self._long(w)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the first mark goes, control pieces are empty, and bytes that are no character show as U+FFFD each."""
        ids = [i for i in ids if i not in self.control]
        raw = b"".join(map(self.pieces.__getitem__, ids))
        if ids and ids[0] != self.unknown and self.pieces[ids[0]].startswith(b" ") and ids[0] not in self._byte_set():
            raw = raw[1:]
        return raw.decode("utf-8", "seriesmill-each-byte")

    @cache  # noqa: B019
    def _byte_set(self) -> frozenset[int]:
        return frozenset(self.byte_ids)


class Words:
    """The distinct marked words of a process, with what is made of each one's ids."""

    def __init__(self, own: Model, form: Callable[[Model, list[int]], Any]) -> None:
        self.model, self.form = own, form
        self.words: dict[str, Any] = {}
        self.older: dict[str, Any] = {}

    def _learn(self, seen: set[str]) -> None:
        if len(self.words) > MOST_WORDS:
            self.words, self.older = {}, self.words
        missing = seen.difference(self.words)
        known = missing.intersection(self.older)
        self.words.update(zip(known, map(self.older.__getitem__, known), strict=True))
        form, own = self.form, self.model
        self.words.update((w, form(own, ids)) for w, ids in own.segment(missing - known))

    def look_up(self, texts: list[str]) -> Iterator[Iterator[list[Any]]]:
        """For each text, what belongs to its marked words: lists, one after the other."""
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and size < TEXT_AT_ONCE:
                size, to = size + len(texts[to]), to + 1
            if to == at + 1:
                yield self._one(texts[at])
            else:
                split = [marked(t) for t in texts[at:to]]
                self._learn(set().union(*split))
                get = self.words.__getitem__
                for words in split:
                    yield iter([list(map(get, words))])
            at = to

    def _one(self, text: str) -> Iterator[list[Any]]:
        """A text in parts that end before a mark."""
        text = _ready(text)
        at = 0
        while at < len(text):
            end = _BEFORE_MARK.search(text, at + TEXT_AT_ONCE)
            to = end.end() if end else len(text)
            words = _MARKED.findall(text, at, to)
            self._learn(set(words))
            yield list(map(self.words.__getitem__, words))
            at = to


def _ready(text: str) -> str:
    """The text behind its first mark; an empty one has none. Blanks stand for marks."""
    return " " + text.replace(_MARK, " ") if text else text


def marked(text: str) -> list[str]:
    """The marked words of a text, and what stands between them."""
    return _MARKED.findall(_ready(text))


def _texts(column: pa.Array) -> list[str]:
    """Each text; null is empty, and a byte that is no character shows as U+FFFD."""
    return [b.decode("utf-8", "seriesmill-each-byte") for b in as_bytes(column)]


@cache
def model(path: str) -> Model:
    """The model of this process."""
    return Model(path)


def _plain(own: Model, ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def _digested(own: Model, ids: list[int]) -> tuple[bytes, bytes]:
    return b",".join(map(own.decimals.__getitem__, ids)), b"".join(map(own.pieces.__getitem__, ids))


@cache
def _table(path: str, form: Callable[[Model, list[int]], Any]) -> Words:
    return Words(model(path), form)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows of ``docs`` with the column ``ids`` (array of int); a null or empty text has none.

    ``ids`` replaces a column of that name; ``path`` is the model file on every executor.
    """
    rows = docs.withColumn(ids, F.col(f"`{text}`").cast("string"))
    schema = docs.withColumn(ids, F.lit(None).cast("array<int>")).schema
    place = schema.names.index(ids)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path, _plain)
        for batch in batches:
            flat = [b"".join(v for part in parts for v in part) for parts in table.look_up(_texts(batch.column(place)))]
            starts = np.concatenate([[0], np.cumsum([len(f) // 4 for f in flat])]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(flat), "<i4")))
            yield pa.RecordBatch.from_arrays([column if i == place else batch.column(i) for i in range(batch.num_columns)], schema.names)

    return rows.mapInArrow(each, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with the column ``text`` of each row's ids; null ids are an empty text, ids that the model doesn't have an error."""
    rows = df.withColumn(text, F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>")))
    schema = df.withColumn(text, F.lit("")).schema
    place = schema.names.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            texts = pa.array([own.decode(x) for x in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == place else batch.column(i) for i in range(batch.num_columns)], schema.names)

    return rows.mapInArrow(each, schema)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every row: number of ids, SHA-256 of the ids in decimals (joined by commas) and of the decoded text.

    A null text is empty: no ids, and the digests of nothing. Rows that repeat an id are rows
    each; other columns are not read. Digests of a very long text are fed part by part.
    """
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = rows.drop("__text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path, _digested)
        for batch in batches:
            counts, first, second = [], [], []
            for parts in table.look_up(_texts(batch.column(1))):
                n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
                for part in parts:
                    decimals = b",".join([v[0] for v in part])
                    decoded = b"".join([v[1] for v in part])
                    ids_hash.update(b"," + decimals if n else decimals)
                    text_hash.update(decoded if n else decoded[1:])  # the mark before the text
                    n += decimals.count(b",") + 1 if decimals else 0
                counts.append(n)
                first.append(ids_hash.hexdigest())
                second.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(counts, np.int64)), pa.array(first, pa.string()), pa.array(second, pa.string())], schema.names)

    return rows.mapInArrow(each, schema)
