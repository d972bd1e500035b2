"""Counts and profiles. Everything is a partial aggregate; nothing gathers rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key; null is a key like any other."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of each listed value per row key, and of null as ``missing``."""
    cells = [F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values]
    return df.groupBy(row).agg(*cells, F.count_if(F.col(column).isNull()).alias("missing"))


def coverage(df: DataFrame, period: str, ts: str, flags: dict[str, Column]) -> DataFrame:
    """Rows, first and last time, and rows with each flag, per period."""
    return df.groupBy(period).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(ts).alias("first_time"),
        F.max(ts).alias("last_time"),
        *[F.count_if(c).alias(name) for name, c in flags.items()],
    )


def missingness_profile(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Per column: missing count and percent, distinct values, constant flag.

    Exact: (column, value) pairs are counted first, so neither a wide distinct set nor a
    frequent value meets in one task. Otherwise one wide pass with sketches.
    """
    if exact:
        cells = F.array(
            *[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns]
        )
        pairs = df.select(F.explode(cells).alias("c")).groupBy("c.feature", "c.v").agg(F.count(F.lit(1)).alias("n"))
        rolled = pairs.groupBy("feature").agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"),
            F.count("v").alias("unique_non_missing"),
        )
    else:
        wide = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.approx_count_distinct(f"`{c}`").alias(f"u{i}") for i, c in enumerate(columns)],
        )
        entries = F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.col("rows"),
                    F.col(f"m{i}").alias("missing_count"),
                    F.col(f"u{i}").alias("unique_non_missing"),
                )
                for i, c in enumerate(columns)
            ]
        )
        rolled = wide.select(F.explode(entries).alias("e")).select("e.*")
    return rolled.select(
        "feature",
        "missing_count",
        (F.lit(100.0) * F.col("missing_count") / F.col("rows")).alias("missing_pct"),
        "unique_non_missing",
        (F.col("unique_non_missing") <= 1).alias("constant_non_missing"),
    )


def timestamp_collisions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values (a time, or tournament and time) shared by several rows."""
    return value_counts(df, keys).filter(F.col("rows") > 1)


def collision_summary(df: DataFrame, ts: str) -> DataFrame:
    """Unique times, shared times and rows on shared times."""
    per_time = value_counts(df, [ts])
    shared = F.col("rows") > 1
    return per_time.agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("unique_times"),
        F.count_if(shared).alias("shared_times"),
        F.coalesce(F.sum(F.when(shared, F.col("rows"))), F.lit(0)).alias("rows_on_shared_times"),
    )


def expand_collisions(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key is shared, with the number of rows sharing it."""
    return df.join(timestamp_collisions(df, keys), keys, "inner")


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys and surplus rows."""
    return value_counts(df, keys).agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.sum(F.col("rows") - 1).alias("duplicates"),
    )


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key. Spark keeps k per key before the shuffle as well."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, n.cast("long")).filter(F.col(rank) <= k)


def head(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows overall: a top-k per task, then of those."""
    return df.orderBy(*order).limit(k)
