"""Order-dependent building blocks that do not put a whole key into one task.

A plain window over a key sends all rows of that key to one task. Here every key with more
than ``PIECE_ROWS`` rows is cut into ranges of its order. The bounds come from a sample of the key,
so a piece has about that many rows whatever the order columns are: times, ids of any kind,
scores that lie close together. A window runs inside each piece, a second one over the much
smaller table of piece totals, and the two are added up. Where no key is that large, a
piece is a key, and one window does it all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesmill.sources.tables import written

#: Rows from which a key is cut, and rows of a piece about.
PIECE_ROWS = 1 << 18
#: Sampled rows for each piece: a piece is rarely larger than twice its share.
SAMPLES = 32
PIECE = "__piece"
#: Bounds of a key are searched in so many steps; a key has fewer than 2 to this power.
_STEPS = 30


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join on same-named keys in which null equals null; keys appear once."""
    other = right.select(
        *[F.col(c).alias(f"__right_{c}") if c in keys else F.col(c) for c in right.columns]
    )
    match = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys], F.lit(True))
    joined = left.join(other, match, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__right_{k}" for k in keys])


class Cut(NamedTuple):
    """A table whose rows know their piece; without a piece column every key is one piece."""

    df: DataFrame
    keys: list[str]
    order: list[Column]
    large: bool

    @property
    def parts(self) -> list[str]:
        return [*self.keys, PIECE] if self.large else list(self.keys)

    def window(self) -> WindowSpec:
        """Rows of a piece in order."""
        return Window.partitionBy(*(self.parts or [F.lit(0)])).orderBy(*self.order)

    def pieces(self) -> WindowSpec:
        """Pieces of a key in order."""
        return Window.partitionBy(*(self.keys or [F.lit(0)])).orderBy(PIECE)

    def having(self, df: DataFrame) -> Cut:
        """The same cut of a table that was made from this one row by row."""
        return self._replace(df=df)

    def plain(self) -> DataFrame:
        return self.df.drop(PIECE)


def cut(df: DataFrame, keys: list[str], order: list[str | Column], piece_rows: int | None = None) -> Cut:
    """Cut each key's rows along ``order`` (ascending, nulls first); no key means all rows.

    Runs one count of the keys. Only if a key is large is the table written, as several passes
    read it, and from a sample of the large keys a table of bounds, one row for each. A null key
    is a group of its own. Rows that are equal in the whole order stay together.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    most = piece_rows or PIECE_ROWS

    def large_keys(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).drop("__n")

    if large_keys(df).isEmpty():
        return Cut(df, keys, columns, False)
    df = written(df, "ordered")
    sizes = large_keys(df)
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(columns)])
    chosen = F.pmod(F.xxhash64(F.lit(17), *columns), F.lit(max(1, most // SAMPLES))) == 0
    sampled = df.filter(chosen).select(*keys, place.alias("__bound"))
    large = written(sizes, "large-keys") if keys else sizes
    if keys:
        sampled = join_null_safe(sampled, large, keys, "left_semi")
    rank = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__bound"))
    bounds = (
        sampled.select(*keys, "__bound", rank.alias("__rank"))
        .filter(F.col("__rank") % SAMPLES == 0)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("__bound")).alias("__bounds"))
    )
    bounds = written(bounds, "bounds")
    placed = join_null_safe(df, bounds, keys) if keys else df.crossJoin(bounds)  # one row
    # ``bounds_up_to`` in as many columns as there are halvings: compiled, and no list of bounds is copied from row to row.
    placed = placed.withColumns({"__place": place, PIECE: F.lit(0)})
    most_bounds = bounds.agg(F.max(F.size("__bounds"))).first()[0] or 0
    for step in reversed(range(most_bounds.bit_length())):
        to = F.col(PIECE) + F.lit(1 << step)
        reached = (to <= F.size("__bounds")) & (F.get("__bounds", to - 1) <= F.col("__place"))
        placed = placed.withColumn(PIECE, F.when(reached, to).otherwise(F.col(PIECE)))
    return Cut(placed.drop("__bounds", "__place"), keys, columns, True)


def bounds_up_to(bounds: Column, place: Column) -> Column:
    """How many of the ascending bounds are at most ``place``: a search in halving steps."""
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(_STEPS))])

    def step(at: Column, by: Column) -> Column:
        to = at + by
        return F.when((to <= F.size(bounds)) & (F.get(bounds, to - 1) <= place), to).otherwise(at)

    return F.when(bounds.isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), step))


def exclusive_totals(totals: DataFrame, made: Cut, measures: list[str]) -> DataFrame:
    """The table of piece totals with ``before_<m>``: the total of m over all earlier pieces of the key."""
    earlier = made.pieces().rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *made.parts, *measures, *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"before_{m}") for m in measures]
    )


def position(made: Cut, name: str, start: int = 1) -> Cut:
    """Number the rows of each key from ``start`` in order."""
    inside = (F.row_number().over(made.window()) + F.lit(start - 1)).cast("long")
    out = made.df.withColumn(name, inside)
    if made.large:
        counts = made.df.groupBy(*made.parts).agg(F.count(F.lit(1)).alias("__n"))
        offsets = exclusive_totals(counts, made, ["__n"]).drop("__n")
        out = join_null_safe(out, offsets, made.parts).withColumn(name, F.col(name) + F.col("before___n")).drop("before___n")
    return made.having(out)


def previous(made: Cut, values: list[str], name: str) -> Cut:
    """Add the struct ``name`` holding ``values`` of the preceding row of the same key."""
    out = made.df.withColumn(name, F.lag(F.struct(*values)).over(made.window()))
    if made.large:
        place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(made.order)])
        last = made.df.groupBy(*made.parts).agg(F.max_by(F.struct(*values), place).alias("__last"))
        carried = last.withColumn("__carried", F.lag("__last").over(made.pieces())).drop("__last")
        out = join_null_safe(out, carried, made.parts).withColumn(name, F.coalesce(name, "__carried")).drop("__carried")
    return made.having(out)


def running_total(made: Cut, value: str, name: str) -> Cut:
    """Add the running total of ``value`` up to and including each row of its key."""
    up_to = made.window().rowsBetween(Window.unboundedPreceding, 0)
    out = made.df.withColumn(name, F.sum(value).over(up_to))
    if made.large:
        sums = made.df.groupBy(*made.parts).agg(F.sum(value).alias("__sum"))
        offsets = exclusive_totals(sums, made, ["__sum"]).drop("__sum")
        out = join_null_safe(out, offsets, made.parts).withColumn(name, F.col("before___sum") + F.col(name)).drop("before___sum")
    return made.having(out)


def with_position(df: DataFrame, keys: list[str], order: list[str | Column], name: str, start: int = 1) -> DataFrame:
    """Number the rows of each key from ``start`` in ``order``; no key means all rows."""
    return position(cut(df, keys, order), name, start).plain()


def with_previous(df: DataFrame, keys: list[str], order: list[str | Column], values: list[str], name: str) -> DataFrame:
    """Add the struct ``name`` holding ``values`` of the preceding row of the same key."""
    return previous(cut(df, keys, order), values, name).plain()


def with_running_total(df: DataFrame, keys: list[str], order: list[str | Column], value: str, name: str) -> DataFrame:
    """Add the running total of ``value`` up to and including each row of its key."""
    return running_total(cut(df, keys, order), value, name).plain()


# --- exact quantiles by brackets ------------------------------------------------------------

#: The sketches know a rank to one part in so many.
ACCURACY = 10_000
#: Rows inside a bracket up to which its values are counted one by one.
BRACKET_ROWS = 1 << 18
#: Parts into which a bracket with more rows is divided.
GRID = 128
_ROUNDS = 12


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], name: str = "quantile"
) -> DataFrame:
    """Linearly interpolated quantiles per key as rows (keys, prob, ``name``).

    A pass of sketches gives a bracket around the two ranks next to each quantile, and a pass
    over the rows counts exactly what lies below and inside. A bracket with too many rows is
    narrowed by another sketch of what is inside. Then the values inside are counted one by one.
    Only sketches, counts and those values are shuffled, however many rows there are. Null
    values do not count; brackets are a table of one row for each key and quantile.
    """
    if not keys:
        return exact_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, probs, name).drop("__all")
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    brackets = written(_first_brackets(rows, keys, probs), "brackets")
    guessed = brackets.filter(F.col("__within").isNull())
    if not guessed.isEmpty():
        known = brackets.filter(F.col("__within").isNotNull())
        brackets = written(known.unionByName(_counted(rows, guessed, keys)), "brackets")
    for _ in range(_ROUNDS):
        wide = brackets.filter((F.col("__within") > BRACKET_ROWS) & (F.col("__from") < F.col("__to")) & ~F.col("__tight"))
        if wide.isEmpty():
            break
        narrowed = _counted(rows, _narrowed(rows, wide, keys), keys)
        rest = join_null_safe(brackets, wide.select(*keys, "prob"), [*keys, "prob"], "left_anti")
        brackets = written(rest.unionByName(narrowed), "brackets")
    one = F.col("__from") == F.col("__to")
    counts = F.count(F.lit(1)).alias("__c")
    several = _inside(rows, brackets.filter(~one), keys).groupBy(*keys, "prob", "__at", "__below", "__v").agg(counts)
    alone = brackets.filter(one).select(*keys, "prob", "__at", "__below", F.col("__from").alias("__v"), F.col("__within").alias("__c"))
    up_to = Window.partitionBy(*keys, "prob").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)  # a bracket
    ended = several.unionByName(alone).withColumn("__end", F.col("__below") + F.sum("__c").over(up_to))

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((F.col("__end") > rank) & (F.col("__end") - F.col("__c") <= rank), F.col("__v")))

    found = ended.groupBy(*keys, "prob").agg(
        at_rank(F.floor("__at")).alias("__lo"), at_rank(F.ceil("__at")).alias("__hi"), F.max("__at").alias("__at")
    )
    part = F.col("__at") - F.floor("__at")
    return found.select(*keys, "prob", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * part).alias(name))


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """The median of each double column that has values, by the brackets of ``exact_quantiles``.

    All columns go through each pass side by side: one for the sketches, one for the counts, and one that
    keeps the values inside a bracket, counted by value. Brackets are two numbers a column. A column whose sketch
    missed goes through ``exact_quantiles``.
    """
    sides = [0.5 + s * 3 / ACCURACY for s in (-1, 1)]
    at = {c: f"`{c}`" for c in columns}
    seen = df.agg(*[
        F.struct(
            F.count(x).alias("size"), F.min(x).alias("low"), F.max(x).alias("high"), F.percentile_approx(x, sides, ACCURACY).alias("q")
        ).alias(f"c{i}")
        for i, x in enumerate(at.values())
    ]).first()
    known = {c: seen[f"c{i}"] for i, c in enumerate(columns) if seen[f"c{i}"]["size"]}
    small = {c for c, s in known.items() if s["size"] <= max(ACCURACY, BRACKET_ROWS)}
    ends = {c: (s["low"], s["high"]) if c in small else tuple(s["q"]) for c, s in known.items()}
    below = dict.fromkeys(small, 0)
    wide = [c for c in known if c not in small]
    if wide:
        counts = df.agg(*[
            F.struct(F.count_if(F.col(at[c]) < F.lit(ends[c][0])).alias("below"), F.count_if(F.col(at[c]) <= F.lit(ends[c][1])).alias("up_to")).alias(f"c{i}")
            for i, c in enumerate(wide)
        ]).first()
        ranks = {c: ((known[c]["size"] - 1) // 2, known[c]["size"] // 2) for c in wide}
        below |= {c: counts[f"c{i}"]["below"] for i, c in enumerate(wide) if counts[f"c{i}"]["below"] <= ranks[c][0] and counts[f"c{i}"]["up_to"] > ranks[c][1]}

    def long(names: list[str], cell: Callable[[str], Column]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), cell(c).alias("v")) for c in names])
        return df.select(F.explode(cells).alias("c")).select("c.column", "c.v").filter(F.col("v").isNotNull())

    out = {c: ends[c][0] for c in below if ends[c][0] == ends[c][1]}
    several = [c for c in below if c not in out]
    if several:
        inside = long(several, lambda c: F.when((F.col(at[c]) >= F.lit(ends[c][0])) & (F.col(at[c]) <= F.lit(ends[c][1])), F.col(at[c])))
        offsets = F.create_map(*[F.lit(x) for c in several for x in (c, below[c])])
        sizes = F.create_map(*[F.lit(x) for c in several for x in (c, known[c]["size"])])
        up_to = Window.partitionBy("column").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # a bracket
        ended = inside.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("end", offsets[F.col("column")] + F.sum("n").over(up_to))
        rank = (sizes[F.col("column")] - 1) / 2

        def at_rank(r: Column) -> Column:
            return F.max(F.when((F.col("end") > r) & (F.col("end") - F.col("n") <= r), F.col("v")))

        found = ended.withColumn("at", rank).groupBy("column").agg(at_rank(F.floor("at")).alias("lo"), at_rank(F.ceil("at")).alias("hi"), F.max("at").alias("at"))
        out |= {r["column"]: r["lo"] + (r["hi"] - r["lo"]) * (r["at"] - int(r["at"])) for r in found.collect()}  # one row per column
    missed = [c for c in known if c not in below]
    if missed:
        rows = exact_quantiles(long(missed, lambda c: F.col(at[c])), ["column"], "v", [0.5]).collect()
        out |= {r["column"]: r["quantile"] for r in rows}
    return out


def _first_brackets(rows: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """(keys, prob, size, rank, lowest and highest value, from, to) of each key and quantile."""
    sides = [min(max(p + s * 3 / ACCURACY, 0.0), 1.0) for p in probs for s in (-1, 1)]
    first = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__size"), F.min("__v").alias("__min"), F.max("__v").alias("__max"),
        F.percentile_approx("__v", sides, ACCURACY).alias("__q"),
    )
    few = F.col("__size") <= max(ACCURACY, BRACKET_ROWS)  # then all values are the bracket
    each = [
        F.struct(
            F.lit(float(p)).alias("prob"),
            F.when(few, F.col("__min")).otherwise(F.get("__q", F.lit(2 * i))).alias("__from"),
            F.when(few, F.col("__max")).otherwise(F.get("__q", F.lit(2 * i + 1))).alias("__to"),
        )
        for i, p in enumerate(probs)
    ]
    return first.select(*keys, "__size", "__min", "__max", F.explode(F.array(*each)).alias("b")).select(
        *keys, "b.prob", "__size", (F.col("b.prob") * (F.col("__size") - 1)).alias("__at"), "__min", "__max", "b.__from", "b.__to",
        F.lit(False).alias("__tight"), F.when(few, F.lit(0).cast("long")).alias("__below"), F.when(few, F.col("__size")).alias("__within"),
    )


def _bracketed(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Every value next to every bracket of its key, of which there is one for each quantile."""
    names = [c for c in brackets.columns if c not in keys]
    own = brackets.groupBy(*keys).agg(F.collect_list(F.struct(*names)).alias("__b"))
    return join_null_safe(rows, own, keys, "inner")


def _inside(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """The values inside of brackets of their key, with the bracket."""
    hit = F.filter("__b", lambda b: (F.col("__v") >= b["__from"]) & (F.col("__v") <= b["__to"]))
    return _bracketed(rows, brackets, keys).select(*keys, "__v", F.explode(hit).alias("b")).select(*keys, "__v", "b.*")


def _counted(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """The brackets with the rows below and inside; one that misses its ranks is widened to all values."""
    brackets = written(brackets.drop("__below", "__within"), "brackets")
    names = [c for c in brackets.columns if c not in keys]
    v, b = F.col("__v"), F.col("b")
    counts = (
        _bracketed(rows, brackets, keys)
        .select(*keys, "__v", F.explode("__b").alias("b"))
        .groupBy(*keys, *[b[c].alias(c) for c in names])
        .agg(F.count_if(v < b["__from"]).alias("__below"), F.count_if((v >= b["__from"]) & (v <= b["__to"])).alias("__within"))
    )
    covers = (F.col("__below") <= F.floor("__at")) & (F.col("__below") + F.col("__within") > F.ceil("__at"))
    wider = {"__from": F.col("__min"), "__to": F.col("__max"), "__below": F.lit(0).cast("long"), "__within": F.col("__size")}
    return counts.withColumn("__covers", covers).withColumns({c: F.when(F.col("__covers"), F.col(c)).otherwise(x) for c, x in wider.items()}).drop("__covers")


def _narrowed(rows: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """Wide brackets cut down to the parts of a grid that hold their ranks; ``__tight`` where that is all of it."""
    shares = [i / GRID for i in range(GRID + 1)]
    names = [c for c in wide.columns if c not in keys]
    grid = _inside(rows, wide, keys).groupBy(*keys, *names).agg(F.percentile_approx("__v", shares, ACCURACY).alias("__grid"))
    # Where a rank lies among the shares, with two parts to spare for the sketch.
    low = F.floor((F.floor("__at") - F.col("__below")) * F.lit(float(GRID)) / F.col("__within")) - 2
    high = F.ceil((F.ceil("__at") + 1 - F.col("__below")) * F.lit(float(GRID)) / F.col("__within")) + 2
    new_from = F.get("__grid", F.greatest(low, F.lit(0)).cast("int"))
    new_to = F.get("__grid", F.least(high, F.lit(GRID)).cast("int"))
    moved = grid.withColumns({"__new_from": new_from, "__new_to": new_to})
    same = (F.col("__new_from") == F.col("__from")) & (F.col("__new_to") == F.col("__to"))
    return moved.withColumn("__tight", same).withColumns({"__from": F.col("__new_from"), "__to": F.col("__new_to")}).select(
        *keys, *[c for c in names if c not in ("__below", "__within")]
    )
