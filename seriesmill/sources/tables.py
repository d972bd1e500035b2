"""Stage tables: writing, resuming, and the player-history table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.text import alias_name, to_double_lenient
from seriesmill.session import scratch_table

# Statistics of the player-history table.
HISTORY_STATS = [
    "career_games",
    "career_win_pct",
    "career_score_avg",
    "career_goals_avg",
    "career_assists_avg",
    "career_shots_avg",
    "career_saves_avg",
    "career_demos_avg",
    "career_rating",
    "2024_games",
    "2024_win_pct",
    "2024_score_avg",
    "2024_goals_avg",
    "2024_assists_avg",
    "2024_shots_avg",
    "2024_saves_avg",
    "2024_demos_avg",
    "2024_rating",
]


def write_stage(
    df: DataFrame, path: str, columns: list[str], partition_by: list[str] | None = None, fmt: str = "parquet"
) -> None:
    """Write a stage with a fixed column order, partitioned where readers filter."""
    writer = df.select(*columns).write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back.

    For a table that several branches or jobs read: it is computed once, plans above it
    stay small, and a lost executor costs a re-read instead of the lineage.
    """
    path = scratch_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def player_history(
    df: DataFrame,
    aliases: dict[str, str] | None = None,
    stats: list[str] | None = None,
    sequence: str | list[str] | None = None,
    keep: str = "last",
    key: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Player name plus every statistic as a double; absent columns are null.

    Of several rows of one player the last (or the first) by ``sequence`` is kept, such as file
    and row; without one the greatest (or least) by value, so the choice never depends on
    arrival. Players are told apart by name, or by ``key`` of it; then the name is that of the row kept.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be first or last, not {keep}")
    if "player_name" not in df.columns:
        raise ValueError("player history needs a player_name column")
    wanted = stats or HISTORY_STATS
    place = [sequence] if isinstance(sequence, str) else list(sequence or [])
    name = alias_name(F.col("player_name"), aliases or {})
    typed = df.select(
        F.struct(F.lit(0).alias("o"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(place)]).alias("__place"),
        (key(name) if key else name).alias("__key"),
        name.alias("player"),
        *[
            (to_double_lenient(F.col(f"`{s}`")) if s in df.columns else F.lit(None).cast("double")).alias(s)
            for s in wanted
        ],
    )
    row = F.struct("__place", *[F.col(f"`{s}`") for s in wanted], "player")
    kept = typed.groupBy("__key").agg((F.max(row) if keep == "last" else F.min(row)).alias("r"))
    return kept.select("r.player", *[f"r.`{s}`" for s in wanted])


def history_duplicates(df: DataFrame, aliases: dict[str, str] | None = None, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, rows, names) of players that a history has more than once."""
    name = alias_name(F.col("player_name"), aliases or {})
    found = df.groupBy((key(name) if key else name).alias("key")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(name).alias("names"))
    return found.filter(F.col("rows") > 1)


def keys_to_fetch(df: DataFrame, key: str, done: DataFrame | None = None) -> DataFrame:
    """Distinct known keys as text, without those already fetched successfully."""
    wanted = df.select(F.col(key).cast("string").alias(key)).na.drop().distinct()
    return wanted if done is None else wanted.join(done.select(F.col(key).cast("string")), key, "left_anti")


def upsert_latest(existing: DataFrame, new: DataFrame, key: str, sequence: str) -> DataFrame:
    """Append and keep, per key, the row with the highest ``sequence``; of several the greatest by value.

    ``max`` keeps one row per key already before the shuffle.
    """
    both = existing.unionByName(new, allowMissingColumns=True)
    others = [c for c in both.columns if c != key]
    last = F.max(F.struct(F.col(sequence).alias("__sequence"), F.struct(*others).alias("row")))
    return both.groupBy(key).agg(last.alias("r")).select(key, "r.row.*")
