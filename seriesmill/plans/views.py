"""Contest tables derived from the star-schema test data, as DataFrames.

``views_sql`` holds the same derivations for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.operators.games import orient_lexicographic


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def players(spark: SparkSession, sf: str) -> DataFrame:
    """One row per line item: a player of one colour in game ``l_orderkey``."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("game_id"),
        F.when(F.col("l_linenumber") % 2 == 1, "blue").otherwise("orange").alias("color"),
        F.concat(F.lit("P"), (F.col("l_suppkey") % 6).cast("string")).alias("player"),
        F.col("l_quantity").cast("long").alias("goals"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("score"),
        F.col("l_linenumber").alias("line"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


def _team(roster: str, missing_at: int):
    name = F.concat(
        F.col(roster)[0],
        F.lit("_"),
        F.size(roster).cast("string"),
        F.when(
            F.col(roster)[0] == "P0", F.concat(F.lit("_"), (F.col("game_id") % 2).cast("string"))
        ).otherwise(F.lit("")),
    )
    return F.when(F.col("game_id") % 20 != missing_at, name)


def games(spark: SparkSession, sf: str) -> DataFrame:
    """Games in which both colours have players and the rosters differ."""
    lines = players(spark, sf)

    def side(c: str):
        mine = F.col("color") == c
        return [
            F.array_sort(F.collect_set(F.when(mine, F.col("player")))).alias(f"{c}_roster"),
            (F.sum(F.when(mine, F.col("goals"))) % 6).alias(f"{c}_goals"),
            F.sum(F.when(mine, F.col("score"))).cast("double").alias(f"{c}_score"),
        ]

    rosters = lines.groupBy("game_id").agg(*side("blue"), *side("orange"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("game_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        "o_custkey",
        "o_orderpriority",
    )
    joined = (
        rosters.filter(
            (F.size("blue_roster") > 0)
            & (F.size("orange_roster") > 0)
            & (F.col("blue_roster") != F.col("orange_roster"))
        )
        .join(orders, "game_id")
        .withColumn("year", F.year("ts"))
    )
    period = F.when(F.col("year") <= 1996, 1).when(F.col("year") <= 1998, 2).otherwise(3)
    playoff = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    named = joined.select(
        "game_id",
        "ts",
        F.concat(F.lit("Open "), period.cast("string")).alias("tournament"),
        period.alias("tournament_order"),
        F.when(playoff, "Playoff 1").otherwise("Group Stages").alias("stage"),
        F.when(~playoff, F.when(F.col("o_custkey") % 2 == 0, "Group A").otherwise("Group B")).alias("subgroup"),
        F.concat_ws("|", "blue_roster").alias("blue_players"),
        F.concat_ws("|", "orange_roster").alias("orange_players"),
        F.size("blue_roster").alias("blue_size"),
        F.size("orange_roster").alias("orange_size"),
        "blue_goals",
        "orange_goals",
        "blue_score",
        "orange_score",
        _team("blue_roster", 0).alias("blue_team"),
        _team("orange_roster", 10).alias("orange_team"),
    )
    pair = F.concat(
        F.least("blue_players", "orange_players"), F.lit(" || "), F.greatest("blue_players", "orange_players")
    )
    return named.withColumn("fingerprint", pair)


def oriented_games(spark: SparkSession, sf: str) -> DataFrame:
    return orient_lexicographic(games(spark, sf))


def contests(spark: SparkSession, sf: str) -> DataFrame:
    """Every game as one contest between side A and side B."""
    target = F.when(F.col("winner_side") == "A", 1).when(F.col("winner_side") == "B", 0)
    return oriented_games(spark, sf).select(
        F.col("game_id").alias("contest_id"),
        "ts",
        "tournament",
        "tournament_order",
        "stage",
        "subgroup",
        "team_a",
        "team_b",
        "team_a_players",
        "team_b_players",
        F.col("a_goals").alias("a_games"),
        F.col("b_goals").alias("b_games"),
        target.alias("target"),
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as games of a stage between changing pairs."""
    return table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("stage"),
        (F.col("user_id") % 3).alias("pair"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Three scores per decided game of Open 2 and Open 3: one row per model and game."""
    decided = games(spark, sf).filter(
        (F.col("blue_goals") != F.col("orange_goals")) & (F.col("tournament_order") >= 2)
    )
    scores = F.array(
        F.struct(
            F.lit("score_share").alias("model"),
            (F.col("blue_score") / (F.col("blue_score") + F.col("orange_score"))).alias("probability"),
        ),
        F.struct(
            F.lit("size_share").alias("model"),
            (F.col("blue_size") / (F.col("blue_size") + F.col("orange_size"))).alias("probability"),
        ),
        F.struct(
            F.lit("scramble").alias("model"),
            ((F.col("game_id") * 7919 % 1000) / F.lit(1000.0)).alias("probability"),
        ),
    )
    return decided.select(
        F.col("game_id").alias("id"),
        F.concat(F.lit("fold_"), (F.col("tournament_order") - 1).cast("string")).alias("fold"),
        (F.col("blue_goals") > F.col("orange_goals")).cast("int").alias("target"),
        F.explode(scores).alias("s"),
    ).select("id", "fold", "target", "s.model", "s.probability")


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Player statistics: P5 is unknown, P4 is known without statistics."""
    known = F.col("player") != "P4"
    return (
        players(spark, sf)
        .filter(F.col("player") != "P5")
        .groupBy(F.col("player").alias("player_name"))
        .agg(
            F.count(F.when(known, 1)).alias("n"),
            F.avg(F.when(known, F.col("goals"))).alias("career_rating"),
            F.avg(F.when(known, F.col("line"))).alias("2024_rating"),
        )
        .select(
            "player_name",
            F.when(F.col("n") > 0, F.col("n").cast("double")).alias("career_games"),
            "career_rating",
            "2024_rating",
        )
    )
