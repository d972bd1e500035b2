"""Phrases of words that occur together more often than their parts let expect.

Words that are frequent enough get numbers, and texts become sequences of numbers with breaks.
Phrases grow by one word a level: two overlapping phrases of a level, of which the second starts a
word later, are a phrase of the next, so only phrases whose parts are frequent are ever counted.
A phrase is the packed pair of the numbers of its two parts. Tasks count the pairs in counting
quotient filters; these are split by their upper bits and merged, sorted as they are, range by
range. What reaches the least count gets a number, and the sequences are written anew with it.

Numbers go to the sequences as a broadcast table as long as there are at most ``MOST_KEYS`` of
them; beyond that every block asks for the numbers of its own keys by a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm import quotient_filter as qf
from seriesmill.llm.text import as_bytes, slices
from seriesmill.sources.tables import written

#: Numbers that are broadcast at most: words, or pairs.
MOST_KEYS = 500_000
#: Words of a block, which ends at the next break.
BLOCK = 1 << 14
#: Entries that a task holds before it sends filters on.
HELD = 1 << 21
#: Upper bits by which filters are split in a round of merging.
SPLIT_BITS = 6
#: Bytes of filters that are merged at once.
MERGE_BYTES = 16 << 20

# Bytes that end a piece, and the blanks between words.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_ENDS + b"\t" + bytes(range(65, 91)), b"\n" * len(_ENDS) + b" " + bytes(range(97, 123)))
#: No byte of UTF-8: stands between pieces.
_BREAK = b"\xff"


def _words(texts: list[bytes]) -> list[bytes]:
    """Words of some texts in lower case, and a break at every end of a piece."""
    joined = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" " + _BREAK + b" ")
    return [w for w in joined.split(b" ") if w]


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words) of the texts of a batch, a bounded run of rows at a time."""
    langs = batch.column("lang").to_pylist()
    row = 0
    for part in slices(batch.column("text"), 1 << 22):
        own: dict[str, list[bytes]] = {}
        for lang, text in zip(langs[row : row + len(part)], as_bytes(part), strict=True):
            own.setdefault(lang, []).append(text)
        row += len(part)
        for lang, texts in own.items():
            yield lang, _words(texts)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own.pop(_BREAK, 0)
            n = pa.array([sum(own.values()), *own.values()], pa.int64())
            words = pa.array([None, *own], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), words, n], ["lang", "word", "n"])
        counts.clear()

    for batch in batches:
        for lang, words in _by_lang(batch):
            counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > HELD // 8:
                yield from sent()
    yield from sent()


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """The table written, with numbers 1, 2, ... without gaps in ``id``."""
    rows = written(df.withColumn("place", F.monotonically_increasing_id()), name)
    part, own = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return written(rows.join(offsets, part == F.col("part")).select(*df.columns, (F.col("offset") + own + 1).alias("id")), name)


def _compact(ids: np.ndarray) -> np.ndarray:
    """Runs of two numbers or more, with one 0 after each."""
    full = np.concatenate([[False], ids != 0, [False]])
    kept = full[1:-1] & (full[:-2] | full[2:])
    after = ~kept & np.concatenate([[False], kept[:-1]])
    return np.where(kept, ids, 0)[kept | after]


def _blocks(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of whole runs, of about ``BLOCK`` numbers; a run that is longer stays whole."""
    held, size = [], 0

    def sent() -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([x for h in held for x in (h, np.zeros(1, h.dtype))])
        breaks, at = np.flatnonzero(ids == 0), 0
        bodies = []
        while at < len(ids):
            to = int(breaks[min(np.searchsorted(breaks, at + BLOCK), len(breaks) - 1)]) + 1
            bodies.append(ids[at:to].astype("<u4").tobytes())
            at = to
        yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary())], ["ids"])

    for ids in parts:
        ids = _compact(ids)
        if len(ids):
            held.append(ids)
            size += len(ids)
        if size >= 16 * BLOCK:
            yield from sent()
            held, size = [], 0
    if held:
        yield from sent()


def _encoded(docs: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """Blocks of word numbers of texts; other words are breaks."""
    if n <= MOST_KEYS:
        table: dict[str, dict[bytes, int]] = {}
        for r in words.select("lang", "word", "id").toLocalIterator():  # at most MOST_KEYS
            table.setdefault(r["lang"], {})[bytes(r["word"])] = r["id"]
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def parts() -> Iterator[np.ndarray]:
                for batch in batches:
                    for lang, own in _by_lang(batch):
                        yield np.fromiter(map(shared.value.get(lang, {}).get, own, repeat(0)), np.uint32, len(own))

            yield from _blocks(parts())

        return written(docs.mapInArrow(each, "ids binary"), "phrase-blocks")

    held = written(docs.withColumn("row", F.monotonically_increasing_id()), "phrase-texts")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, lang, text in zip(batch.column("row").to_pylist(), batch.column("lang").to_pylist(), as_bytes(batch.column("text")), strict=True):
                own = list(set(_words([text])))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(own), pa.int64()), pa.array([lang] * len(own), pa.string()), pa.array(own, pa.binary())], ["row", "lang", "word"])

    found = held.mapInArrow(asked, "row long, lang string, word binary").join(words.select("lang", "word", "id"), ["lang", "word"])
    tables = found.groupBy("row").agg(F.collect_list("word").alias("words"), F.collect_list("id").alias("numbers"))  # of one text

    def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[np.ndarray]:
            for batch in batches:
                for text, own, numbers in zip(as_bytes(batch.column("text")), batch.column("words").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
                    get = dict(zip(own, numbers, strict=True)).get
                    words = _words([text])
                    yield np.fromiter(map(get, words, repeat(0)), np.uint32, len(words))

        yield from _blocks(parts())

    return written(held.join(tables, "row").select("text", "words", "numbers").mapInArrow(each_row, "ids binary"), "phrase-blocks")


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The numbers of some blocks at a time."""
    for batch in batches:
        bodies = batch.column("ids").to_pylist()
        for at in range(0, len(bodies), 32):
            yield np.frombuffer(b"".join(bodies[at : at + 32]), "<u4").astype(np.uint64)


def _pairs(ids: np.ndarray, bits: int) -> np.ndarray:
    """Key of each number and the one after it; 0 where there is a break."""
    left, right = ids[:-1], ids[1:]
    return np.where((left != 0) & (right != 0), left << np.uint64(bits) | right, np.uint64(0))


def _filters(blocks: DataFrame, bits: int) -> DataFrame:
    """Filters of the pairs of all blocks, split by range: ``range``, ``bytes``, ``body``."""
    width = 2 * bits
    order, cut = qf.Permutation(width), min(SPLIT_BITS, width)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent(own: qf.Counts) -> pa.RecordBatch:
            parts = [(r, qf.packed(f)) for r, f in qf.split(own, width, cut)]
            return _rows(parts)

        for ids in _sequences(batches):
            keys = _pairs(ids, bits)
            held.append(qf.counted(order.forward(keys[keys != 0])))
            size += len(held[-1].keys)
            if size > HELD:
                held = [qf.merged(held)]
                size = len(held[0].keys)
                if size > HELD // 2:
                    yield sent(held[0])
                    held, size = [], 0
        if size:
            yield sent(qf.merged(held))

    return written(blocks.mapInArrow(each, "range long, bytes long, body binary"), "phrase-filters")


def _rows(parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    bodies = [b for _, b in parts]
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int64()), pa.array(list(map(len, bodies)), pa.int64()), pa.array(bodies, pa.binary())], ["range", "bytes", "body"])


def _finer(width: int, cut: int) -> Callable[[pa.Table], pa.Table]:
    """Merges some filters of a range and splits them by ``cut`` bits."""

    def finer(table: pa.Table) -> pa.Table:
        own = qf.merged(map(qf.unpacked, table.column("body").to_pylist()))
        return pa.Table.from_batches([_rows([(r, qf.packed(f)) for r, f in qf.split(own, width, cut)])])

    return finer


def _merged(filters: DataFrame, bits: int, least: int) -> DataFrame:
    """``key`` and ``n`` of the pairs that reach ``least``, by merging the filters of each range.

    While a range holds more than ``MERGE_BYTES`` on average, groups of its filters are merged
    and split by more bits: the number of filters stays in proportion to their bytes.
    """
    width = 2 * bits
    cut = min(SPLIT_BITS, width)
    order = qf.Permutation(width)
    while cut < width:
        total = filters.agg(F.sum("bytes").alias("b")).first()["b"] or 0
        groups = math.ceil(total / (1 << cut) / MERGE_BYTES)
        if groups <= 1:
            break
        cut = min(cut + SPLIT_BITS, width)

        dealt = filters.withColumn("group", F.pmod(F.xxhash64("body"), F.lit(groups)))
        filters = written(dealt.groupBy("range", "group").applyInArrow(_finer(width, cut), "range long, bytes long, body binary"), "phrase-filters")

    def last(table: pa.Table) -> pa.Table:
        own = qf.merged(map(qf.unpacked, table.column("body").to_pylist()))
        enough = own.n >= least
        keys = order.backward(own.keys[enough])
        return pa.table({"left": (keys >> np.uint64(bits)).astype(np.int64), "right": (keys & np.uint64((1 << bits) - 1)).astype(np.int64), "n": own.n[enough]})

    return filters.select("range", "body").groupBy("range").applyInArrow(last, "left long, right long, n long")


def _recoded(blocks: DataFrame, pairs: DataFrame, n: int, bits: int) -> DataFrame:
    """The sequences in numbers of the pairs; a pair without a number is a break."""
    key = (F.shiftleft("left", bits).bitwiseOR(F.col("right"))).alias("key")

    def numbers(ids: np.ndarray, keys: np.ndarray, own: np.ndarray) -> np.ndarray:
        wanted = _pairs(ids, bits)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, own[at], 0)

    if n <= MOST_KEYS:
        rows = pairs.select(key, "id").toArrow()  # at most MOST_KEYS
        keys, own = rows["key"].to_numpy().astype(np.uint64), rows["id"].to_numpy()
        order = np.argsort(keys)
        shared = blocks.sparkSession.sparkContext.broadcast((keys[order], own[order]))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _blocks(numbers(ids, *shared.value) for ids in _sequences(batches))

        return written(blocks.mapInArrow(each, "ids binary"), "phrase-blocks")

    held = written(blocks.withColumn("block", F.monotonically_increasing_id()), "phrase-blocks")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                own = np.unique(_pairs(np.frombuffer(body, "<u4").astype(np.uint64), bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own)], ["block", "key"])

    found = held.mapInArrow(asked, "block long, key long").join(pairs.select(key, "id"), "key")
    tables = found.groupBy("block").agg(F.collect_list("key").alias("keys"), F.collect_list("id").alias("numbers"))  # of one block

    def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[np.ndarray]:
            for batch in batches:
                for body, keys, own in zip(batch.column("ids").to_pylist(), batch.column("keys").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
                    keys, own = np.array(keys, np.int64).astype(np.uint64), np.array(own, np.int64)
                    order = np.argsort(keys)
                    yield numbers(np.frombuffer(body, "<u4").astype(np.uint64), keys[order], own[order])

        yield from _blocks(parts())

    return written(held.join(tables, "block").select("ids", "keys", "numbers").mapInArrow(each_block, "ids binary"), "phrase-blocks")


def _lang(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("und"))


def phrases(docs: DataFrame, longest: int = 5, least: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """Every phrase of 1 to ``longest`` words with at least ``least`` occurrences in a language.

    ``lang``, ``size``, ``id`` (its number among those of its size), ``left`` and ``right`` (numbers of
    the phrases without its last and without its first word), ``phrase``, ``last`` (its last word),
    ``f``, ``firsts`` and ``lasts`` (occurrences of its first and last 1, 2, ... words), ``n`` (words of the language).
    """
    rows = docs.select(_lang(lang).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    counted = rows.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    kept = written(counted.filter(F.col("word").isNull() | (F.col("n") >= least)), "phrase-words")
    words = _numbered(kept.filter(F.col("word").isNotNull()), "phrase-words")
    totals = kept.filter(F.col("word").isNull()).select("lang", F.col("n").alias("words"))  # a row for each language
    n = words.count()
    one = F.col("word").cast("string")
    level = words.join(totals, "lang").select(
        "lang", F.lit(1).alias("size"), "id", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"),
        one.alias("phrase"), one.alias("last"), F.col("n").alias("f"), F.array("n").alias("firsts"), F.array("n").alias("lasts"), F.col("words").alias("n"),
    )
    levels = [written(level, "phrases")]
    blocks = _encoded(rows, words, n) if n and longest > 1 else None
    for size in range(2, longest + 1):
        if not n:
            break
        bits = n.bit_length()
        if bits > 32:
            raise ValueError(f"more than {1 << 32} phrases of {size - 1} words")
        pairs = _numbered(_merged(_filters(blocks, bits), bits, least), "phrase-pairs")
        n = pairs.count()
        before, after = levels[-1].alias("a"), levels[-1].alias("b")
        both = pairs.alias("p").join(before, F.col("p.left") == F.col("a.id")).join(after, F.col("p.right") == F.col("b.id"))
        level = both.select(
            "a.lang", F.lit(size).alias("size"), "p.id", "p.left", "p.right", F.concat_ws(" ", "a.phrase", "b.last").alias("phrase"), "b.last",
            F.col("p.n").alias("f"), F.concat("a.firsts", F.array("p.n")).alias("firsts"), F.concat("b.lasts", F.array("p.n")).alias("lasts"), "a.n",
        )
        levels.append(written(level, "phrases"))
        if n and size < longest:
            blocks = _recoded(blocks, pairs, n, bits)
    return reduce(DataFrame.unionByName, levels)


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, absorbed: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are in lower case (A to Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into
    words at blanks and tabs. A phrase of 2 to ``longest`` words with ``a >= least`` occurrences is a
    candidate; its score is the least floor(1000 a n / (l r)) of its cuts in two parts with l
    and r occurrences, n being the words of the language; of equal cuts the first counts. A
    candidate inside a longer one goes if that one has at least ``absorbed`` percent of its
    occurrences. Order: score and a descending, then the phrase by its bytes.

    A null text is empty, a null language is ``und``; repeated rows count each; a language
    without candidates has no rows; other columns of ``docs`` are not read. Counting, scores and
    order are exact; no phrase is left out before it is counted unless a part of it is too rare.
    """
    found = written(phrases(docs, longest, least, text, lang), "phrases")
    longer = found.filter(F.col("size") > 2)
    parts = longer.select((F.col("size") - 1).alias("size"), F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("whole"))
    inside = parts.groupBy("size", "id").agg(F.max("whole").alias("whole"))
    joined = found.filter(F.col("size") > 1).join(inside, ["size", "id"], "left")
    whole = F.col("f").cast("decimal(20,0)") * absorbed
    left = joined.filter(F.col("whole").isNull() | (100 * F.col("whole").cast("decimal(20,0)") < whole))
    best = F.expr(
        """array_min(transform(sequence(1, size - 1), k -> struct(
            (cast(1000 as decimal(4,0)) * cast(f as decimal(16,0)) * cast(n as decimal(16,0)))
                div (cast(element_at(firsts, k) as decimal(19,0)) * cast(element_at(lasts, size - k) as decimal(19,0))) as score,
            k, element_at(firsts, k) as l, element_at(lasts, size - k) as r)))"""
    )
    scored = left.select("lang", "phrase", F.col("f").alias("a"), "n", best.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
