import random

import pytest
from pyspark.sql import functions as F

from seriesmill.functions.rules import wins_required
from seriesmill.operators import games as g
from seriesmill.operators import series as s

KEYS = ["fingerprint", "stage", "subgroup"]


def brute(winners, need):
    out, seg, a, b = [], 1, 0, 0
    for w in winners:
        out.append(seg)
        a, b = a + (w == "A"), b + (w == "B")
        if a >= need or b >= need:
            seg, a, b = seg + 1, 0, 0
    return out


def games(spark, groups):
    rows = [
        (f, stage, sub, i, i // 3 * 20_000_000, w)
        for (f, stage, sub), winners in groups.items()
        for i, w in enumerate(winners)
    ]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(
        rows, "fingerprint string, stage string, subgroup string, game_id long, us long, winner_side string"
    )
    return df.withColumn("ts", F.timestamp_micros("us"))


def segments(df, chunk):
    out = s.split_by_threshold(df, KEYS, "ts", "game_id", wins_required(F.col("stage")), chunk=chunk)
    got = {}
    for r in out.orderBy("game_id").collect():
        got.setdefault((r["fingerprint"], r["stage"], r["subgroup"]), []).append(r["segment"])
    return got


@pytest.mark.parametrize("chunk", [2, 5, 128])
def test_threshold_matches_brute_force(spark, chunk):
    rng = random.Random(5)
    groups = {
        ("known", "Group Stages", None): list("AABABBBAAA"),
        ("undecided", "Group Stages", "A"): ["A", None, "A", None, "A", "B"],
        ("open tail", "Playoff", None): list("AAAABB"),
    }
    for i in range(12):
        stage = rng.choice(["Group Stages", "Playoff 1"])
        groups[(f"m{i}", stage, rng.choice(["A", None]))] = rng.choices(["A", "B", None], [5, 4, 1], k=rng.randint(1, 60))
    groups[("hot", "Playoff 1", None)] = rng.choices(["A", "B", None], [5, 5, 1], k=700)
    got = segments(games(spark, groups), chunk)
    assert got == {k: brute(w, 3 if "Group" in k[1] else 4) for k, w in groups.items()}
    assert [got[("known", "Group Stages", None)].count(n) for n in (1, 2, 3)] == [4, 3, 3]


@pytest.mark.parametrize("need", [1, 2, 31, 32, 100, 1000, 4095])
def test_any_number_of_wins(spark, need):
    rng = random.Random(need)
    winners = list("AB") * 120 + rng.choices(["A", "B", None], [5, 5, 1], k=160)
    winners += rng.choices(["A", "B"], [5, 3], k=9000 if need == 4095 else 3000 if need == 1000 else 0)
    df = games(spark, {("x", "Group Stages", None): winners})
    out = s.split_by_threshold(df, KEYS, "ts", "game_id", F.lit(need), chunk=16)
    assert [r["segment"] for r in out.orderBy("game_id").collect()] == brute(winners, need)


@pytest.mark.parametrize("need", [0, -1, s.LOW + 1, None])
def test_impossible_number_of_wins(spark, need):
    df = games(spark, {("x", "Group Stages", None): list("AB")})
    with pytest.raises(Exception, match="wins needed"):
        s.split_by_threshold(df, KEYS, "ts", "game_id", F.lit(need).cast("int")).collect()


def test_a_million_games_of_one_matchup(spark):
    """Nothing but winners and places of a key meets in a task, a chunk of them at a time."""
    n = 1_000_000
    side = F.when(F.col("id") % 3 == 0, "A").when(F.col("id") % 7 == 1, None).otherwise("B")
    df = spark.range(n).select(
        F.col("id").alias("game_id"), F.timestamp_seconds(F.floor(F.col("id") / 5)).alias("ts"), side.alias("winner_side"),
        *[F.lit("x").alias(k) for k in KEYS], F.repeat(F.lit("a wide row "), 20).alias("more"),
    )
    out = s.split_by_threshold(df, KEYS, "ts", "game_id", F.lit(4))
    got = out.select("game_id", "segment").orderBy("game_id").toPandas()["segment"].tolist()
    assert got == brute(["A" if i % 3 == 0 else None if i % 7 == 1 else "B" for i in range(n)], 4)


def test_deep_composition(spark, monkeypatch):
    """A small fan-in makes one key climb all levels of the tree."""
    monkeypatch.setattr(s, "FAN_IN", 2)
    winners = random.Random(8).choices(["A", "B", None], k=150)
    got = segments(games(spark, {("x", "Group Stages", None): winners}), 2)
    assert got[("x", "Group Stages", None)] == brute(winners, 3)


def test_sessions_match_brute_force(spark):
    rng = random.Random(2)
    t, rows = 0, []
    for i in range(300):
        t += rng.choice([0, 1, 60, 1799, 1800, 1801, 7200])
        rows.append((rng.choice(["x", None]), t, i, rng.choice(["p", "p", "q", None])))
    df = spark.createDataFrame(rows, "k string, s long, id long, pair string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["session"] for r in s.sessionise(df, ["k"], "ts", "id", "pair").collect()}
    for k in ("x", None):
        n, last = 0, None
        for _, sec, i, pair in [r for r in rows if r[0] == k]:
            if last is None or pair != last[1] or sec - last[0] > 1800:
                n += 1
            last = (sec, pair)
            assert got[i] == n


def test_colour_swap_changes_nothing(spark):
    rows = [(1, "a|b", "c|d", "X", "Y", 3, 1), (2, "c|d", "a|b", "Y", "X", 2, 2), (3, "a|b", "q", "X", "Z", 0, 4)]
    names = "game_id long, blue_players string, orange_players string, blue_team string, orange_team string, blue_goals long, orange_goals long"
    swap = "game_id long, orange_players string, blue_players string, orange_team string, blue_team string, orange_goals long, blue_goals long"

    def oriented(schema):
        df = spark.createDataFrame(rows, schema)
        pair = F.concat(
            F.least("blue_players", "orange_players"), F.lit(" || "), F.greatest("blue_players", "orange_players")
        )
        out = g.orient_lexicographic(df.withColumn("fingerprint", pair))
        return out.select("game_id", "team_a", "team_b", "a_goals", "b_goals", "winner_side").orderBy("game_id").collect()

    assert oriented(names) == oriented(swap)


def test_orientation_error(spark):
    row = [(1, "a", "c", "X", "Y", 3, 1, "a || b")]
    df = spark.createDataFrame(
        row,
        "game_id long, blue_players string, orange_players string, blue_team string, orange_team string, "
        "blue_goals long, orange_goals long, fingerprint string",
    )
    r = g.orient_lexicographic(df).first()
    assert r["orientation_error"] and r["winner_side"] is None and r["team_a"] is None


def test_rollup_needs_wins_and_keeps_names(spark):
    rows = [
        ("f", "Group Stages", None, 1, 1, "A", "Red", "Blue"),
        ("f", "Group Stages", None, 1, 2, "A", None, "Blue"),
        ("f", "Group Stages", None, 1, 3, "A", "Red", "Bleu"),
        ("f", "Group Stages", None, 2, 4, "B", None, "Blue"),
    ]
    df = spark.createDataFrame(
        rows,
        "fingerprint string, stage string, subgroup string, segment long, game_id long, winner_side string, team_a string, team_b string",
    ).withColumns(
        {
            "ts": F.timestamp_seconds("game_id"),
            "team_a_players": F.lit("a"),
            "team_b_players": F.lit("b"),
            "orientation_error": F.lit(False),
        }
    )
    first, second = s.series_rollup_threshold(df, [*KEYS, "segment"]).orderBy("segment").collect()
    assert (first["series_winner"], first["target_team_a_win"], first["team_name_consistency"]) == ("Red", 1, False)
    assert first["team_b"] == "Blue" and first["winner_reaches_required_wins"]
    assert second["series_winner_side"] is None and second["team_a"] is None


def test_null_series_has_no_position(spark):
    df = spark.createDataFrame([(1, None), (2, "s"), (3, "s")], "game_id long, series string").withColumn(
        "ts", F.timestamp_seconds(F.lit(0))
    )
    got = {r["game_id"]: r["game_number"] for r in s.number_in_group(df, ["series"], "ts", "game_id").collect()}
    assert got == {1: None, 2: 1, 3: 2}
