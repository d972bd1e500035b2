"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

Everything is DataFrame functions. A url becomes an array of buckets; the model is an array of
2**bits weights, so its score is a fold over the buckets. Training takes a bounded table of
labelled urls through full-batch gradient steps: errors are spread over buckets and summed,
and the driver only sees one number for each bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.sources.tables import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``where`` is a host and a path, such as ``example.org/es/``; it also holds for all subdomains."""

    verdict: str
    where: str

    def fits(self, host: Column, path: Column) -> Column:
        own, slash, rest = self.where.partition("/")
        return ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z in lower case;
    path: from there to ``?``, ``#`` or the end. Null urls and urls without ``://`` have empty ones."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*+", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*+([^?#]*+)", 1), F.lit(""))


def fitting(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null if none does."""
    kind = "struct<rule:string,verdict:string>"
    found = [
        F.when(r.fits(host, path), F.struct(F.lit(r.where).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in sorted(rules, key=lambda r: (-len(r.where), r.where))
    ]
    return F.coalesce(*found, F.lit(None).cast(kind)) if found else F.lit(None).cast(kind)


def buckets(host: Column, path: Column, bits: int, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Hashed character n-grams; host grams and path grams are told apart by their ends."""

    def grams(part: str, text: Column, n: int) -> Column:
        def at(letters: Column) -> Column:
            places = F.sequence(F.lit(1), F.greatest(F.size(letters) - (n - 1), F.lit(1)))
            return F.transform(places, lambda i: one([F.try_element_at(letters, (i + k).cast("int")) for k in range(n)]))

        def one(letters: list[Column]) -> Column:
            return F.pmod(F.xxhash64(F.lit(part), *letters), F.lit(1 << bits)).cast("int")

        # The outer array has one element: so a text is cut into letters once, not for each place.
        return F.flatten(F.transform(F.array(F.split(F.concat(F.lit("<"), text, F.lit(">")), "")), at))

    return F.concat(*[grams(part, text, n) for part, text in (("host", host), ("path", path)) for n in sizes])


@dataclass
class UrlModel:
    weights: list[float]
    bias: float
    bits: int

    def score(self, own: Column) -> Column:
        """Probability that a url is to be blocked, from its buckets."""
        # A text that the optimizer folds to a literal array: one expression instead of 2**bits.
        weights = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")
        total = F.aggregate(own, F.lit(0.0), lambda sofar, i: sofar + F.element_at(weights, i + 1))
        return 1 / (1 + F.exp(-(F.lit(float(self.bias)) + total / F.sqrt(F.size(own).cast("double")))))


def fit(
    labelled: DataFrame, bits: int = 12, bound: int = 4000, steps: int = 15, rate: float = 1.0, l2: float = 1e-4
) -> UrlModel:
    """Learn from rows ``host``, ``path`` and ``blocked`` (boolean).

    ``bound``: about how many different urls are used, picked by a hash of host and path; each
    has the weight of all its rows. Steps are scaled by the squared gradients so far. Without rows the
    score is 0.5.
    """
    size = 1 << bits
    rows = labelled.filter("blocked is not null").groupBy("host", "path", "blocked").agg(F.count("*").alias("n"))
    rows = written(rows, "url-labels")
    share = bound / max(rows.count(), 1)
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64("host", "path"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = rows.select(buckets(F.col("host"), F.col("path"), bits).alias("own"), F.col("blocked").cast("double").alias("y"), "n")
    rows = written(rows.repartition(4), "url-examples")  # small: a step is one short job
    number = rows.agg(F.sum("n").alias("n")).first()["n"]
    model, squares = UrlModel([0.0] * size, 0.0, bits), [1e-8] * (size + 1)
    if not number:
        return model
    for _ in range(steps):
        off = rows.select("own", ((model.score(F.col("own")) - F.col("y")) * F.col("n")).alias("off"))
        spread = off.select(
            F.explode(F.concat("own", F.array(F.lit(size)))).alias("bucket"),
            F.col("off"),
            F.sqrt(F.size("own").cast("double")).alias("norm"),
        )
        step = F.when(F.col("bucket") == size, F.col("off")).otherwise(F.col("off") / F.col("norm"))
        for bucket, g in spread.groupBy("bucket").agg(F.sum(step).alias("g")).collect():  # at most 2**bits + 1 rows
            g = g / number + (l2 * model.weights[bucket] if bucket < size else 0.0)
            squares[bucket] += g * g
            change = rate * g / squares[bucket] ** 0.5
            if bucket < size:
                model.weights[bucket] -= change
            else:
                model.bias -= change
    return model


def judge(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url: str = "url", bits: int = 12, bound: int = 4000, bar: float = 0.5
) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of every url.

    The verdict is that of the longest rule that fits, else the model's: block from ``bar`` on.
    The model's labelled table is made of urls that a rule decides. ``score`` is the model's for
    every row. Every row gives one row, repeated ids too.
    """
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", fitting(rules, F.col("host"), F.col("path")))
    labelled = rows.filter("fit is not null").select("host", "path", (F.col("fit.verdict") == BLOCK).alias("blocked"))
    model = fit(labelled, bits, bound)
    scored = rows.withColumn("score", model.score(buckets(F.col("host"), F.col("path"), bits)))
    by_model = F.when(F.col("score") >= bar, BLOCK).otherwise(ALLOW)
    return scored.select(
        F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_model).alias("verdict"), "score"
    )
