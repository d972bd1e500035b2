"""Which team stands behind a roster, decided only from names, never from results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.operators.ordering import join_null_safe
from seriesmill.sources.tables import written

ROSTER_PREFIX = "ROSTER::"


def unique_mapping(pairs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with exactly one known value."""
    known = pairs.filter(F.col(value).isNotNull())
    return (
        known.groupBy(*keys)
        .agg(F.min(value).alias(value), F.max(value).alias("__high"))
        .filter(F.col(value) == F.col("__high"))
        .drop("__high")
    )


def ambiguous_mapping(pairs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with several values, and those values in order."""
    distinct = pairs.filter(F.col(value).isNotNull()).select(*keys, value).distinct()
    return (
        distinct.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(value)).alias("values"))
        .filter(F.size("values") > 1)
    )


def roster_names(contests: DataFrame) -> DataFrame:
    """(tournament, roster, team) as seen on either side of any contest."""
    seen = F.array(
        *[
            F.struct(F.col(f"team_{s}_players").alias("roster"), F.col(f"team_{s}").alias("team"))
            for s in ("a", "b")
        ]
    )
    return (
        contests.select("tournament", F.explode(seen).alias("s"))
        .select("tournament", "s.roster", "s.team")
        .filter(F.col("tournament").isNotNull() & F.col("roster").isNotNull())
    )


def _source(stored: Column, looked_up: Column, roster: Column) -> Column:
    return (
        F.when(stored.isNotNull(), F.lit("stored_team_name"))
        .when(looked_up.isNotNull(), F.lit("same_tournament_roster_lookup"))
        .when(roster.isNotNull(), F.lit("roster_fallback"))
        .otherwise(F.lit("unresolved"))
    )


def resolve_identity(contests: DataFrame) -> DataFrame:
    """Replace team_a/team_b by an identity and say in ``*_source`` where it comes from.

    Order: stored name, the only name this roster carries in the same tournament, the
    roster itself, nothing. The lookup has one row per (tournament, roster); written, its size is
    known before the contests are dealt out by roster, of which there may be few.
    """
    lookup = written(unique_mapping(roster_names(contests), ["tournament", "roster"], "team"), "identities")
    out = contests
    for s in ("a", "b"):
        right = lookup.select(
            "tournament",
            F.col("roster").alias(f"team_{s}_players"),
            F.col("team").alias("__found"),
        )
        out = join_null_safe(out, right, ["tournament", f"team_{s}_players"])
        stored, roster, found = F.col(f"team_{s}"), F.col(f"team_{s}_players"), F.col("__found")
        out = out.withColumns(
            {
                f"team_{s}": F.coalesce(stored, found, F.concat(F.lit(ROSTER_PREFIX), roster), F.lit("")),
                f"team_{s}_source": _source(stored, found, roster),
            }
        ).drop("__found")
    return out
