import pytest
from pyspark.sql import functions as F

from seriesmill.operators import attach, checks, dataset, profile, reconcile
from seriesmill.operators.attach import roster_history_features
from seriesmill.operators.dataset import select_features
from seriesmill.operators.identity import resolve_identity
from seriesmill.sources import tables
from seriesmill.sources.pages import extract_page_fields


def test_name_checks(spark):
    df = spark.createDataFrame([(1, 2)], "` Series_ID` int, Winner_Side int")
    tidy = checks.normalise_columns(df)
    assert tidy.columns == ["series_id", "winner_side"]
    assert checks.first_existing(df, ["winner_side", "x"]) == "Winner_Side"
    assert checks.first_existing(df, ["x"]) is None
    with pytest.raises(ValueError, match="other"):
        checks.require_columns(tidy, ["series_id", "other"])
    assert checks.leakage_columns(["a", "Winner_Side", "completed_x"]) == ["Winner_Side", "completed_x"]
    with pytest.raises(ValueError, match="replay_count"):
        checks.forbid_leakage(["diff_prior_series_played", "replay_count"])


def test_column_alignment(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(1, 2)], "y int, z int")
    got = {r["column_name"]: (r["a"], r["b"], r["shared"]) for r in checks.column_alignment(spark, {"a": a, "b": b}).collect()}
    assert got == {"x": (True, False, False), "y": (True, True, True), "z": (False, True, False)}


def test_unique_and_expect(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, None)], "k int, v string")
    with pytest.raises(ValueError, match="duplicated"):
        checks.assert_unique(df, ["k"])
    assert checks.assert_unique(df.filter("v is not null"), ["k"]).count() == 2
    got = checks.expect(df, {"rows": (F.count("*"), 3), "missing": (F.count_if(F.col("v").isNull()), 0)})
    assert {r["check"]: r["status"] for r in got.collect()} == {"rows": "PASS", "missing": "CHECK"}


def test_upsert_keeps_the_last_row(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, seq int, v string")
    new = spark.createDataFrame([("a", 3), ("c", 4)], "k string, seq int")
    got = {r["k"]: (r["seq"], r["v"]) for r in tables.upsert_latest(old, new, "k", "seq").collect()}
    assert got == {"a": (3, None), "b": (2, "y"), "c": (4, None)}


def test_player_history(spark):
    df = spark.createDataFrame(
        [("Ann ", "10", 1), ("Ann", "n/a", 2), ("bo", "3", 1)], "player_name string, career_games string, n int"
    )
    got = {r["player"]: r for r in tables.player_history(df, {"bo": "Bob"}, sequence="n").collect()}
    assert set(got) == {"Ann", "Bob"} and got["Ann"]["career_games"] is None and got["Bob"]["career_games"] == 3
    assert len(got["Bob"]) == 19 and got["Bob"]["2024_rating"] is None
    with pytest.raises(ValueError, match="player_name"):
        tables.player_history(df.drop("player_name"))


def test_stage_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "T1", "a"), (2, "T2", None)], "id int, tournament string, v string")
    path = str(tmp_path / "stage")
    tables.write_stage(df, path, ["v", "id", "tournament"], ["tournament"])
    back = spark.read.parquet(path)
    assert back.columns == ["v", "id", "tournament"] and back.count() == 2


def test_page_fields(spark):
    html = (
        '<html><head><title>Game &amp; set</title><script>MatchGUID: ' + "F" * 32 + "</script></head>"
        '<td title="x">no</td><span class="a" title="When the game took place (this date does not have a timezone)">'
        "<i>2025-01-10</i> 15:30</span><p>MatchGUID:\n<b>" + "AB" * 16 + "</b></p>Server: US-East.1"
    )
    df = spark.createDataFrame([(1, html), (2, "<title>t</title>"), (3, '<td title="when the game took place">soon</td>')], "id int, html string")
    a, b, c = extract_page_fields(df).orderBy("id").collect()
    assert a["page_title"] == "Game & set" and a["match_guid"] == "AB" * 16 and a["server"] == "US-East.1"
    assert a["scrape_success"] and str(a["replay_timestamp_utc"]) == "2025-01-10 21:30:00"
    assert b["error"] == "replay_date_tag_not_found" and not b["scrape_success"]
    assert c["error"] == "replay_date_parse_failed" and c["replay_date_raw"] == "soon"


def test_schedule(spark):
    schedule = spark.createDataFrame(
        [("1", "A", "B", 3, "A", 2, 1), ("2", "C", "B", 3, "C", 3, 0), ("3", "A", "C", 3, "A", 3, 0), ("4", "C", "A", 3, "A", 3, 0), ("5", "X", "Y", 3, "X", 3, 0)],
        "id string, team_a string, team_b string, expected_games long, winner string, winner_games long, loser_games long",
    )
    games = spark.createDataFrame(
        [(1, "B", "A", "A"), (2, "A", "B", "B"), (3, "A", "B", "A"), (4, "B", "C", None), (5, "A", "C", "A"), (6, None, "A", "A"), (7, "A", "Q", "A")],
        "g long, blue string, orange string, game_winner string",
    )
    out = reconcile.reconcile_to_schedule(reconcile.with_pair(games, "blue", "orange"), schedule)
    got = {r["g"]: (r["match_status"], r["series_id"]) for r in out.collect()}
    assert got[1] == got[2] == got[3] == ("MATCHED", "1") and got[4] == ("MATCHED", "2")
    assert got[5] == ("AMBIGUOUS", None) and got[6][0] == "NO_TEAM_PAIR" and got[7][0] == "NO_SCHEDULE_MATCH"
    status = {r["id"]: (r["status"], r["winner_status"]) for r in reconcile.schedule_status(schedule, out).collect()}
    assert status["1"] == ("COMPLETE", "CORRECT") and status["2"] == ("CHECK", "CHECK")
    assert status["3"] == status["5"] == ("MISSING", "NO_GAMES")


def verified(spark, a, b, side):
    return spark.createDataFrame(
        [("s1", a, b, 3, 2, side, "record")],
        "series_id string, expected_team_a string, expected_team_b string, completed_team_a_game_wins int, "
        "completed_team_b_game_wins int, completed_series_winner_side string, result_source string",
    )


def test_verified_results(spark):
    series = spark.createDataFrame(
        [("s1", "Red", "Blue", None, None, None, 1), ("s2", "X", "Y", "B", "Y", 0, 3)],
        "series_id string, team_a string, team_b string, series_winner_side string, series_winner string, target_team_a_win int, team_a_game_wins_observed int",
    )
    s1, s2 = reconcile.overlay_verified_results(series, verified(spark, "Red", "Blue", "A")).orderBy("series_id").collect()
    assert (s1["series_winner"], s1["target_team_a_win"], s1["result_source"], s1["team_a_game_wins_observed"]) == ("Red", 1, "record", 1)
    assert (s2["series_winner"], s2["result_reconciled"], s2["result_source"]) == ("Y", False, "observed_replays")
    for bad in (verified(spark, "Blue", "Red", "A"), verified(spark, "Red", "Blue", "C")):
        with pytest.raises(Exception, match="does not fit"):
            reconcile.overlay_verified_results(series, bad).collect()
    assert reconcile.unknown_verified(series, verified(spark, "a", "b", "A")).count() == 0
    assert reconcile.unknown_verified(series.union(series), verified(spark, "a", "b", "A")).first()["rows"] == 2


def test_roster_history(spark):
    history = spark.createDataFrame([("a", 10.0, None), ("b", 20.0, 4.0), ("c", None, None)], "player string, g double, r double")
    series = spark.createDataFrame([(1, "a|b", "c|d"), (2, "a|b", None)], "id int, team_a_players string, team_b_players string")
    one, two = attach.roster_history_features(series, history, ["g", "r"]).orderBy("id").collect()
    assert (one["team_a_players_total"], one["team_a_players_with_stats"], one["team_a_g_mean"], one["team_a_r_mean"]) == (2, 2, 15, 4)
    assert (one["team_b_players_matched"], one["team_b_players_with_stats"], one["team_b_coverage"]) == (1, 0, 0)
    assert one["diff_g"] is None and two["team_b_players_total"] is None
    assert [r["player"] for r in attach.unmatched_players(series, history).collect()] == ["d"]


def test_features_and_indicators(spark):
    df = spark.createDataFrame(
        [("Playoff 1", "1.5", None, 3), ("Group", "x", 2.0, 3)],
        "stage string, diff_career_rating string, diff_prior_series_played double, team_a_prior_series_played int",
    ).withColumns({"tournament": F.lit("T"), "series_winner": F.lit("A")})
    out = dataset.select_features(df, ["tournament"])
    assert out.columns == ["tournament", "diff_career_rating", "diff_prior_series_played", "team_a_prior_series_played", "is_playoff"]
    marked = dataset.missing_indicators(out, out.columns[1:])
    assert marked.columns[-2:] == ["diff_career_rating__missing", "diff_prior_series_played__missing"]
    groups = dataset.feature_group_counts(dataset.feature_report(spark, marked.columns[1:]))
    assert {r["feature_group"]: r["features"] for r in groups.collect()} == {
        "history_difference": 1, "form_difference": 1, "form_coverage": 1, "prematch_stage": 1, "missingness_indicator": 2,
    }


def test_profile(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0), (1.0, 3.0), (None, 2.0)], "a double, b double")
    for exact in (True, False):
        got = {r["feature"]: tuple(r)[1:] for r in profile.missingness_profile(df, ["a", "b"], exact).collect()}
        assert got == {"a": (1, 25.0, 1, True), "b": (1, 25.0, 2, False)}
    tidy = checks.drop_all_null_columns(df.withColumn("gone", F.lit(None).cast("string")))
    assert tidy.columns == ["a", "b"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_select_features_reads_numbers_as_they_are(spark):
    """A column of numbers is not written as text and read again; texts still are."""
    rows = [(1, 0.1, float("nan"), 3, "Playoff 1", "7.5 "), (2, float("inf"), None, None, None, "1d")]
    names = "id long, diff_career_x double, team_a_coverage double, team_a_prior_series_played long, stage string, diff_2024_y string"
    df = spark.createDataFrame(rows, names)
    out = select_features(df, ["id"])
    got = {r["id"]: r for r in out.collect()}
    assert (got[1]["diff_career_x"], got[1]["team_a_coverage"], got[1]["team_a_prior_series_played"], got[1]["is_playoff"]) == (0.1, None, 3.0, 1.0)
    assert (got[2]["diff_career_x"], got[2]["team_a_prior_series_played"], got[2]["is_playoff"]) == (float("inf"), None, 0.0)
    assert got[1]["diff_2024_y"] == 7.5 and got[2]["diff_2024_y"] is None
    assert set(dict(out.drop("id").dtypes).values()) == {"double"}
    assert " as string" not in _plan(select_features(df.drop("diff_2024_y", "stage"), ["id"]))


def test_lookups_of_few_rosters_do_not_deal_out_the_contests(spark):
    """The sizes of small lookups are known beforehand: contests stay where they are read."""
    rows = [(i, f"t{i % 2}", "x|y", "y|z", None if i % 3 else "A", "B") for i in range(50)]
    contests = spark.createDataFrame(rows, "contest_id int, tournament string, team_a_players string, team_b_players string, team_a string, team_b string")
    players = spark.createDataFrame([("x", 1.0), ("z", 3.0)], "player string, career_rating double")
    out = roster_history_features(resolve_identity(contests), players, ["career_rating"])
    assert {(r["team_a"], r["team_a_source"], r["diff_career_rating"]) for r in out.collect()} == {
        ("A", "stored_team_name", -2.0), ("A", "same_tournament_roster_lookup", -2.0)
    }
    assert "SortMergeJoin" not in _plan(out) and "Exchange hashpartitioning" not in _plan(out)
