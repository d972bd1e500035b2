"""Lenient parsing and name clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for "no team name".
NO_NAME = ("nan", "none", "null", "unknown", "unknown team", "unknown team names")


def blank_to_null(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Trim; an empty text, or one in ``stop`` (any case), becomes null."""
    trimmed = F.nullif(F.trim(c), F.lit(""))
    if not stop:
        return trimmed
    return F.when(~F.lower(trimmed).isin(*stop), trimmed)


def valid_name(c: Column) -> Column:
    """Team name with blanks and placeholder texts turned into null."""
    return blank_to_null(c, NO_NAME)


def to_double_lenient(c: Column) -> Column:
    """Number or null; never an error. NaN and Java's 1d/1f literals are null too."""
    text = F.trim(c.cast("string"))
    java_only = F.lower(F.right(text, F.lit(1))).isin("d", "f") & ~F.lower(F.right(text, F.lit(3))).eqNullSafe("inf")
    value = F.when(~java_only, text).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_utc_lenient(c: Column) -> Column:
    """UTC timestamp of a text, or null; never an error. A text without a zone is UTC."""
    text = F.trim(c.cast("string"))
    forms = [*(F.concat(text, F.lit(end)) for end in ("Z", ":00Z", " 00:00:00Z")), text]
    return F.coalesce(*[form.try_cast("timestamp") for form in forms])


def alias_name(c: Column, mapping: dict[str, str], ignore_case: bool = False) -> Column:
    """Exact alias replacement after trimming; names without an alias stay."""
    name = F.trim(c)
    if not mapping:
        return name
    entries = {(k.lower() if ignore_case else k): v for k, v in mapping.items()}
    lookup = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
    key = F.lower(name) if ignore_case else name
    return F.coalesce(F.try_element_at(lookup, key), name)


def alias_by_table(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Alias replacement from a table (alias, name); of a repeated alias the smallest name counts.

    Spark sizes the join itself.
    """
    pairs = aliases.groupBy(F.col("alias").alias("__alias")).agg(F.min("name").alias("__name"))
    out = df.withColumn(column, F.trim(column))
    out = out.join(pairs, F.col(column) == F.col("__alias"), "left")
    return out.withColumn(column, F.coalesce("__name", column)).drop("__alias", "__name")


def alias_team(c: Column, mapping: dict[str, str]) -> Column:
    """Team name in capitals, then aliased; blank is null."""
    return alias_name(F.upper(blank_to_null(c)), {k.upper(): v for k, v in mapping.items()})


def canonical_key(c: Column, mapping: dict[str, str] | None = None) -> Column:
    """Comparison form of a name: aliased, lower case, letters and digits only."""
    aliased = alias_name(c, mapping or {}, ignore_case=True)
    return F.regexp_replace(F.lower(aliased), "[^a-z0-9]", "")
