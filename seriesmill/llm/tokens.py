"""Token ids of whole texts with a tokenizers file, as little-endian unsigned 32-bit bytes.

The file's normaliser and splitter never look across white space, so a text's ids are those of
its blank-delimited words, one after the other; a word of letters and signs after them is two
words. A task keeps the words it has seen in a table of 128-bit hashes with their places in one
array of ids, and asks the library only for new ones. Words of a block of texts are found,
hashed and looked up as arrays.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

# A task has one core.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words of the table. When it is full, those that were not met again since they came go.
MOST_WORDS = 1_000_000
#: Ids for each of them, on average.
_IDS_A_WORD = 4
#: Bytes of text that are worked on at once.
_TEXT_AT_ONCE = 1 << 18
#: Longer words are hashed by a digest: sums of powers are safe for short words only.
_SHORT = 255
# Words of letters only (those of ASCII and U+00C0 to U+00FF in UTF-8).
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_BLANK = re.compile(rb"[\t-\r ]")

#: Kinds of bytes: 0 blank, 1 letter, 2 sign that the splitter cuts off letters, 3 any other.
_KIND = np.full(256, 3, np.uint8)
_KIND[33:127] = 2
_KIND[list(b"0123456789'")] = 3
_KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[list(b"\t\n\x0b\x0c\r ")] = 0

# The sections of a tokenizer file for which all this holds.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPECIAL = re.compile(r"<\|[a-z]+\|>")


def checked(path: str) -> None:
    """Raise for a tokenizer file that cuts or normalises texts in another way."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    splits = [x for x in (file["pre_tokenizer"] or {}).get("pretokenizers", ()) if x["type"] == "Split"]
    fits = (
        (file["normalizer"] or {}).get("normalizers") == _NORMALIZER
        and [(x["pattern"], x["behavior"], x["invert"]) for x in splits] == [({"Regex": _SPLIT}, "Removed", True)]
        and file["model"]["type"] == "BPE" and file["model"]["end_of_word_suffix"] == "</w>"
        and all(_SPECIAL.fullmatch(x["content"]) and not (x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"]) for x in file["added_tokens"])
    )
    if not fits:
        raise ValueError(f"{path}: words of this tokenizer file are not cut at blanks as expected here")


class Powers:
    """Hashes of all words of a block by differences of running sums, modulo 2^64."""

    def __init__(self, seed: int) -> None:
        r = np.random.default_rng(seed)
        self.letter = r.integers(0, 1 << 64, 256, np.uint64)
        self.base = int(r.integers(0, 1 << 63)) * 8 + 5
        self.up = self.down = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if n >= len(self.up):
            n = max(n + 1, _TEXT_AT_ONCE)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                x = np.full(n, base % (1 << 64), np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._reach(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letter[data] * self.up[: len(data)], out=total[1:])
        return (total[ends] - total[starts]) * self.down[starts]


class WordTable:
    """Places of ids by two hashes of a word: open addressing, many words at a time."""

    def __init__(self) -> None:
        self.n = self.used = 0
        self.hashes = np.zeros((2, 1024), np.uint64)
        self.place = np.zeros((2, 1024), np.int64)  # first id, number of ids
        self.again = np.zeros(1024, bool)  # met again since it came
        self.ids = np.zeros(4096, np.uint32)
        self._spread(12)

    def _spread(self, bits: int) -> None:
        self.bits, self.slots = bits, np.full(1 << bits, -1, np.int32)
        self._enter(np.arange(self.n))

    def _enter(self, rows: np.ndarray) -> None:
        slot = (self.hashes[0, rows] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(rows):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rows[free]
            left = self.slots[slot] != rows
            rows, slot = rows[left], (slot[left] + 1) & (len(self.slots) - 1)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Row of each word, -1 where there is none."""
        slot = (first >> np.uint64(64 - self.bits)).astype(np.int64)
        row = self.slots[slot]
        at = np.flatnonzero((row >= 0) & ((self.hashes[0, row] != first) | (self.hashes[1, row] != second)))
        while len(at):
            slot[at] = (slot[at] + 1) & (len(self.slots) - 1)
            now = self.slots[slot[at]]
            row[at] = now
            at = at[(now >= 0) & ((self.hashes[0, now] != first[at]) | (self.hashes[1, now] != second[at]))]
        return row

    def add(self, first: np.ndarray, second: np.ndarray, ids: list[np.ndarray]) -> None:
        """Enter new words, each once."""
        count = np.array([len(x) for x in ids], np.int64)
        ends = self.used + np.cumsum(count)
        while self.n + len(ids) > len(self.again):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)], 1)
            self.place = np.concatenate([self.place, np.zeros_like(self.place)], 1)
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), int(ends[-1]) - len(self.ids)), np.uint32)])
        rows = np.arange(self.n, self.n + len(ids))
        self.hashes[0, rows], self.hashes[1, rows] = first, second
        self.place[0, rows], self.place[1, rows] = ends - count, count
        self.again[rows] = False
        self.ids[self.used : ends[-1]] = np.concatenate(ids)
        self.n, self.used = self.n + len(ids), int(ends[-1])
        if 2 * self.n > len(self.slots):
            self._spread((2 * self.n).bit_length())
        else:
            self._enter(rows)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some rows in turn, and where each row's begin (and the last ends)."""
        first, count = self.place[0, rows], self.place[1, rows]
        cuts = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(count, out=cuts[1:])
        return self.ids[np.repeat(first - cuts[:-1], count) + np.arange(cuts[-1])], cuts

    def shrink(self, most: int, most_ids: int) -> None:
        """Make room: words met again stay, the later ones first, as long as they fill half of it."""
        keep = np.flatnonzero(self.again[: self.n])[-(most // 2) :] if most > 1 else np.zeros(0, np.int64)
        size = np.cumsum(self.place[1, keep][::-1])[::-1]
        keep = keep[size <= most_ids // 2]
        ids, cuts = self.take(keep)
        hashes = self.hashes[:, keep]
        self.__init__()
        if len(keep):
            self.add(*hashes, [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])


class WordIds:
    """Ids of words, from one tokenizer file."""

    def __init__(self, path: str) -> None:
        checked(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.table = WordTable()
        self.powers = Powers(1), Powers(2)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _encode_letters(self, words: list[bytes]) -> list[np.ndarray]:
        """Of words of letters only: many in one text, cut after each id that ends a word."""
        out = []
        for at in range(0, len(words), 1000):
            ids = self._encode([b" ".join(words[at : at + 1000]).decode()])[0]
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            out += [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return out

    def _learn(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of new words."""
        plain = [w.isalpha() or _LETTERS.fullmatch(w) is not None for w in words]
        letters = iter(self._encode_letters([w for w, p in zip(words, plain, strict=True) if p]))
        other = iter(self._encode([w.decode("utf-8", "replace") for w, p in zip(words, plain, strict=True) if not p]))
        return [next(letters if p else other) for p in plain]

    def _block(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of a text, where each word's begin (and the last ends), and each word's first byte."""
        data = np.frombuffer(text, np.uint8)
        kind = np.zeros(len(data) + 2, np.uint8)
        kind[1:-1] = _KIND[data]
        inside = kind > 0
        starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
        ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        if b"<|" not in text and len(starts):
            # a word of letters, then signs only, changes its kind of bytes once
            kind = kind[1:-1]
            change = np.flatnonzero(inside[1:-2] & inside[2:-1] & (kind[1:] != kind[:-1])) + 1
            word = np.searchsorted(starts, change, side="right") - 1
            times = np.bincount(word, minlength=len(starts))
            cut = change[(times[word] == 1) & (kind[change - 1] == 1) & (kind[change] == 2)]
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        first, second = (p.of(data, starts, ends) for p in self.powers)
        for w in np.flatnonzero(ends - starts > _SHORT).tolist():
            digest = hashlib.blake2b(text[starts[w] : ends[w]], digest_size=16).digest()
            first[w], second[w] = np.frombuffer(digest, "<u8")
        if self.table.n > MOST_WORDS or self.table.used > _IDS_A_WORD * MOST_WORDS:
            self.table.shrink(MOST_WORDS, _IDS_A_WORD * MOST_WORDS)
        rows = self.table.find(first, second)
        self.table.again[rows[rows >= 0]] = True
        missing = np.flatnonzero(rows < 0)
        while len(missing):
            new = missing[np.unique(first[missing], return_index=True)[1]]
            words = [text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            self.table.add(first[new], second[new], self._learn(words))
            rows[missing] = self.table.find(first[missing], second[missing])
            missing = missing[rows[missing] < 0]
        ids, cuts = self.table.take(rows)
        return ids.astype("<u4", copy=False), cuts, starts

    def encode(self, texts: list[bytes]) -> Iterator[list[bytes]]:
        """Ids of each text, in pieces of many words each."""
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and size < _TEXT_AT_ONCE:
                size, to = size + len(texts[to]), to + 1
            # Lower case of A to Z changes no ids, unless it makes a special token.
            some = [t if b"<|" in t else t.lower() for t in texts[at:to]]
            if len(some[-1]) >= _TEXT_AT_ONCE:
                long = [some.pop()]
            else:
                long = []
            if some:
                begin = np.zeros(len(some) + 1, np.int64)
                np.cumsum([len(t) + 1 for t in some], out=begin[1:])
                ids, cuts, starts = self._block(b" ".join(some))
                cuts = cuts[np.searchsorted(starts, begin)].tolist()
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    yield [ids[a:b].tobytes()]
            for text in long:
                yield [*self._long(text)]
            at = to

    def _long(self, text: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            blank = _BLANK.search(text, at + _TEXT_AT_ONCE)
            to = blank.end() if blank else len(text)
            part = text[at:to]
            # a very long word passes by the table
            ids = self._block(part)[0] if to - at <= 4 * _TEXT_AT_ONCE else self._encode([part.decode("utf-8", "replace")])[0].astype("<u4")
            yield ids.tobytes()
            at = to


_KEPT: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The table of this process."""
    if path not in _KEPT:
        _KEPT[path] = WordIds(path)
    return _KEPT[path]
