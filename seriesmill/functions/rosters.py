"""Rosters are arrays of names inside; pipe-joined text only at the edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesmill.functions.text import alias_name

PAIR_SEPARATOR = " || "


def split_roster(c: Column, aliases: dict[str, str] | None = None, ignore_case: bool = True) -> Column:
    """Names of a roster text, split on the first kind of separator it contains."""
    text = F.coalesce(F.trim(c), F.lit(""))
    parts = (
        F.when(text.contains("|"), F.split(text, "\\|"))
        .when(text.contains(";"), F.split(text, ";"))
        .otherwise(F.split(text, ","))
    )
    names = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    if not aliases:
        return names
    return F.transform(names, lambda p: alias_name(p, aliases, ignore_case))


def sorted_roster(names: Column, distinct: bool = True, ignore_case: bool = False) -> Column:
    """The roster in an order that does not depend on how it was written down."""
    unique = F.array_distinct(names) if distinct else names
    if not ignore_case:
        return F.array_sort(unique)
    keyed = F.transform(unique, lambda n: F.struct(F.lower(n).alias("k"), n.alias("n")))
    return F.transform(F.array_sort(keyed), lambda s: s["n"])


def roster_signature(names: Column, distinct: bool = True, ignore_case: bool = False) -> Column:
    """Roster text, equal for equal sets of players; null for an empty roster."""
    ordered = sorted_roster(names, distinct, ignore_case)
    return F.when(F.size(ordered) > 0, F.concat_ws("|", ordered))


def matchup_fingerprint(side_1: Column, side_2: Column) -> Column:
    """Both rosters in one text, whichever colour they played; null if one is empty."""
    known = side_1.isNotNull() & side_2.isNotNull() & (side_1 != "") & (side_2 != "")
    return F.when(
        known, F.concat(F.least(side_1, side_2), F.lit(PAIR_SEPARATOR), F.greatest(side_1, side_2))
    )


def unordered_pair(a: Column, b: Column, separator: str = " vs ") -> Column:
    """Pair of team names in alphabetical order; null when one is unknown.

    least/greatest skip nulls, hence the guard.
    """
    return F.when(
        a.isNotNull() & b.isNotNull(), F.concat(F.least(a, b), F.lit(separator), F.greatest(a, b))
    )
