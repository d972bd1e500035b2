"""Byte-pair encoding as a left-to-right transducer with bounded lookahead, and its decoder.

Encoding of a prefix. Two neighbouring tokens stay apart if no merge across their border comes
before both sides have grown past it. A sequence is the encoding of its text exactly if all
neighbours stay apart, so the last token of each prefix is the one token ending there that
stays apart from the last token of the prefix before it. That is all the state there is.

Lookahead. Read two texts with a common prefix and apply the merges in order. Their tokens
first agree up to the end of the prefix. Merge (a, b) can only take the last agreeing token
away if that token is a and the token behind it, in one text, is b. The next merge that
takes one away comes later in the list, and its b then starts with that a. The longest such
chain, weighted with the lengths of the a, bounds how far a token's end must lie behind the
reading position to be final; one pass over the merge list finds it.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.text import as_bytes

#: Words (pairs of tokens) that a process keeps; when full, the table starts anew.
MOST_KEPT = 400_000
_WORDS_AT_ONCE = 1 << 16
_WORD_END = "\n"  # stands for the suffix of a word's last symbol; no symbol of a byte


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Merges:
    """What the merge list says about tokens; ``suffix`` marks the last symbol of a word."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        def inner(t: str) -> str:
            return t[: -len(suffix)] + _WORD_END if suffix and t.endswith(suffix) else t

        self.suffixed = bool(suffix)
        self.ids = {inner(t): i for t, i in vocabulary.items()}
        self.rank = {(self.ids[inner(a)], self.ids[inner(b)]): k for k, (a, b) in enumerate(merges)}
        size = {i: len(t.rstrip(_WORD_END)) or 1 for t, i in self.ids.items()}
        never = len(merges)
        # Spines: the tokens at a token's left (right) edge, each with the merge that swallows it.
        self.left: dict[int, list[tuple[int, int]]] = {i: [(i, never)] for i in size}
        self.right: dict[int, list[tuple[int, int]]] = {i: [(i, never)] for i in size}
        made: set[int] = set()
        broken: set[int] = set()
        longest: dict[int, int] = {}  # by a: the longest chain that ends with a merge of this a
        self.lookahead = 0
        for (a, b), k in self.rank.items():
            token = self.ids[self._text(merges[k], inner)]
            if token in made:
                raise ValueError("a token has two merges")
            made.add(token)
            if a in broken or b in broken or self._crossing(a, b, k):
                broken.add(token)
            self.left[token] += [(t, k if t == a else by) for t, by in self.left[a]]
            self.right[token] += [(t, k if t == b else by) for t, by in self.right[b]]
            chain = size[a] + max(longest.get(t, 0) for t, _ in self.left[b])
            longest[a] = max(longest.get(a, 0), chain)
            self.lookahead = max(self.lookahead, chain)
        #: Tokens that can stand in an encoding, by text; those that other merges forestall are left out.
        self.tokens = {t: i for t, i in self.ids.items() if i not in broken}
        self.longest = max(size.values())
        self._apart: dict[int, bool] = {}

    @staticmethod
    def _text(pair: tuple[str, str], inner) -> str:
        return inner(pair[0] + pair[1])

    def _crossing(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether a merge joins the right edge of a with the left edge of b (``before`` a given merge).

        At equal rank the left pair of the same merge goes first.
        """
        rank = self.rank
        for r, r_by in self.right[a]:
            for t, t_by in self.left[b]:
                k = rank.get((r, t))
                if k is not None and k < r_by and k <= t_by and (before is None or k < before):
                    return True
        return False

    def apart(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self._apart.get(key)
        if found is None:
            if len(self._apart) > MOST_KEPT:
                self._apart.clear()
            found = self._apart[key] = not self._crossing(a, b)
        return found

    def stream(self, word: str) -> Iterator[int]:
        """Ids of a word of byte symbols; each is given as soon as the lookahead makes it final."""
        tokens, apart, longest, n = self.tokens, self.apart, self.longest, len(word)
        room = 2 * (self.lookahead + longest)
        base, starts, ids = 0, [0], [-1]  # of the last token of each prefix from base on
        for i in range(1, n + 1):
            end = _WORD_END if i == n and self.suffixed else ""
            for at in range(max(0, i - longest), i):
                token = tokens.get(word[at:i] + end)
                if token is not None and (at == 0 or at >= base and apart(ids[at - base], token)):
                    starts.append(at)
                    ids.append(token)
                    break
            else:
                raise ValueError("the merge list does not cover this text")
            if i - base > room:
                path, at = [], i
                while at > base:
                    if at <= i - self.lookahead:
                        path.append((at, ids[at - base]))
                    at = starts[at - base]
                if path:
                    yield from (t for _, t in reversed(path))
                    to = path[0][0]
                    del starts[: to - base], ids[: to - base]
                    base = to
        path, at = [], n
        while at > base:
            path.append(ids[at - base])
            at = starts[at - base]
        yield from reversed(path)


class Codec:
    """A tokenizer file: NFC, lower case, split into words, byte symbols, merges."""

    _SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"  # fixed value

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._split = regex.compile(self._SPLIT)
        self._symbols = byte_symbols()
        pieces = {**model["vocab"], **self.special}
        self.pieces = [""] * (max(pieces.values()) + 1)
        for t, i in pieces.items():
            self.pieces[i] = t
        self.decimals = [str(i) for i in range(len(self.pieces))]
        self._kept: dict[bytes, tuple[int, ...]] = {}
        self._tokens: dict[str, tuple[int, ...]] = {}

    def _token(self, token: str) -> tuple[int, ...]:
        """Ids of a token of the splitter, lower case already."""
        ids = self._tokens.get(token)
        if ids is None:
            ids = tuple(self.merges.stream("".join([self._symbols[b] for b in token.encode()])))
            if len(token) <= 64:
                if len(self._tokens) > MOST_KEPT:
                    self._tokens.clear()
                self._tokens[token] = ids
        return ids

    def _word(self, raw: bytes) -> tuple[int, ...]:
        """Ids of a word between blanks."""
        if raw.isalpha():  # of ASCII letters only
            return self._token(raw.lower().decode())
        out: list[int] = []
        text = raw.decode("utf-8", "replace")
        for k, part in enumerate(self._specials.split(text) if self._specials else [text]):
            if k % 2:
                out.append(self.special[part])
                continue
            part = unicodedata.normalize("NFC", part)
            low = "".join(map(str.lower, part)) if "Σ" in part else part.lower()  # no final form of sigma
            for token in self._split.findall(low):
                out += self._token(token)
        return tuple(out)

    def encode(self, text: bytes) -> Iterator[list[int]]:
        """Ids of a text, in pieces of many words. Neither normaliser nor splitter looks across a blank."""
        words, kept = text.split(), self._kept
        for at in range(0, len(words), _WORDS_AT_ONCE):
            some = words[at : at + _WORDS_AT_ONCE]
            found = [*map(kept.get, some)]
            if None in found:
                for i in [i for i, ids in enumerate(found) if ids is None]:
                    found[i] = ids = self._word(some[i])
                    if len(some[i]) <= 64:
                        if len(kept) > MOST_KEPT:
                            kept.clear()
                        kept[some[i]] = ids
            yield [*chain.from_iterable(found)]


class Decoder:
    """Ids to text, in any portions: bytes of a character that is not complete wait for the rest.

    A file without a decoder shows its pieces with a blank between two (``plain``); otherwise
    byte symbols become bytes again and the end of a word a blank.
    """

    def __init__(self, codec: Codec, plain: bool = True) -> None:
        self._bytes = _piece_bytes(codec, plain)
        self._between = b" " if plain else b""
        self._state = codecs.getincrementaldecoder("utf-8")("replace")
        self._begun = False

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        raw = self._between.join(map(self._bytes.__getitem__, ids))
        if self._begun:
            raw = self._between + raw
        self._begun = True
        return self._state.decode(raw)

    def end(self) -> str:
        return self._state.decode(b"", True)


@cache
def _piece_bytes(codec: Codec, plain: bool) -> list[bytes]:
    if plain:
        return [p.encode() for p in codec.pieces]
    of = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
    special = set(codec.special.values())
    out = []
    for i, p in enumerate(codec.pieces):
        stem, end = (p[:-4], b" ") if p.endswith("</w>") else (p, b"")
        out.append(p.encode() if i in special else b"".join(of.get(c, c.encode()) for c in stem) + end)
    return out


@cache
def codec(path: str) -> Codec:
    """The codec of this process."""
    return Codec(path)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every row: number of ids, SHA-256 of the ids in decimals and of the decoded text.

    A null text is empty: no ids, and the digests of nothing. Both digests are fed piece by piece.
    """
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = rows.drop("__text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            counts, first, second = [], [], []
            for raw in as_bytes(batch.column(1)):
                n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(own)
                for ids in own.encode(raw):
                    if ids:
                        ids_hash.update(((" " if n else "") + " ".join(map(own.decimals.__getitem__, ids))).encode())
                        text_hash.update(decoder.feed(ids).encode())
                        n += len(ids)
                text_hash.update(decoder.end().encode())
                counts.append(n)
                first.append(ids_hash.hexdigest())
                second.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(counts, np.int64)), pa.array(first, pa.string()), pa.array(second, pa.string())], schema.names)

    return rows.mapInArrow(each, schema)
