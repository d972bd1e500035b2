from pyspark.sql import functions as F

from seriesmill.sources import exports as x

TEAM = "color;team name;score;goals;game duration\n"
PLAYER = "color;player name;goals;assists;shooting %;avg boost amount\n"


def write(path, content, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding=encoding)


def exports(spark, root):
    write(root / "Group Stages/Group A/g1-teams.csv", TEAM + 'blue;"Red; Blue";500;2;301\norange;;400;1;301\n')
    write(
        root / "Group Stages/Group A/g1-players.csv",
        "﻿team;Player Name;color;assists;goals;shooting percentage;demos received\r\n"
        "Own;ann;blue;1;2;50;\r\nOwn;bob;blue;;0;;\r\nGuests;cy;orange;2;1;25;3\r\n",
    )
    write(root / "Playoff 1/g2_team.csv", "goals;Color;Team Name\n1;blue;X\n1;orange;Y\n")
    write(root / "Playoff 1/g2_player.csv", PLAYER + "blue;dee;1;0;10;33.5\norange;eve;1;0;20;44\n")
    write(root / "Playoff 2/g3-teams.csv", TEAM + "blue;A;1;1;300\norange;B;2;2;300\norange;C;2;2;300\n")
    write(root / "Playoff 2/g3-players.csv", PLAYER + "blue;a;1;0;1;1\n")
    write(root / "Playoff 2/g4-teams.csv", TEAM + "blue;A;1;1;300\norange;B;2;2;300\n")
    files = x.read_exports(spark, str(root))
    return x.parse_exports(x.with_path_fields(files, str(root)))


def test_columns_go_by_name(spark, tmp_path):
    rows = exports(spark, tmp_path / "a folder")
    got = {
        r["player"]: r
        for r in x.player_stats(rows.filter(F.col("kind") == "player")).collect()
    }
    assert (got["ann"]["goals"], got["ann"]["assists"], got["ann"]["shooting_percentage"]) == (2, 1, 50)
    assert got["bob"]["assists"] is None and got["bob"]["goals"] == 0
    assert got["cy"]["demos_taken"] == 3 and got["cy"]["team"] == "Guests" and got["cy"]["bpm"] is None
    assert got["dee"]["avg_boost"] == 33.5
    assert {r["subgroup"] for r in rows.filter(F.col("replay_id") == "g1").collect()} == {"Group A"}
    assert {r["subgroup"] for r in rows.filter(F.col("replay_id") == "g2").collect()} == {None}


def test_game_rows(spark, tmp_path):
    games = {r["replay_id"]: r for r in x.game_rows(exports(spark, tmp_path)).collect()}
    g1 = games["g1"]
    assert len(g1) == 44 and set(games) == {"g1", "g2"}
    assert (g1["blue_team"], g1["orange_team"], g1["game_winner"]) == ("Red; Blue", "Guests", "Red; Blue")
    assert (g1["blue_goals"], g1["blue_assists"], g1["blue_shooting_percentage"]) == (2, 1, 50)
    assert g1["blue_demos_taken"] is None and g1["orange_demos_taken"] == 3
    assert g1["game_duration"] == "301" and g1["blue_score"] == 500
    g2 = games["g2"]
    assert g2["game_winner"] is None and g2["blue_score"] == 1 and g2["game_duration"] is None


def test_reject_reasons(spark, tmp_path):
    rows = exports(spark, tmp_path)
    why = x.reject_reasons(rows, ["color", "team name", "score", "goals"])
    assert {r["replay_id"]: r["reject_reason"] for r in why.collect()} == {
        "g1": None, "g2": "missing_columns", "g3": "team_rows_not_2", "g4": "no_player_export",
    }


def test_pairs(spark, tmp_path):
    exports(spark, tmp_path)
    files = x.with_path_fields(x.read_exports(spark, str(tmp_path)), str(tmp_path))
    got = {r["replay_id"]: r["player_file"] for r in x.pair_files(files).collect()}
    assert got["g2"] == "Playoff 1/g2_player.csv" and got["g4"] is None


def parsed(spark, **contents):
    rows = [(f"/raw/S/{name.replace('_', '-')}.csv", c) for name, c in contents.items()]
    return x.parse_exports(x.with_path_fields(spark.createDataFrame(rows, "path string, content string"), "/raw/"))


def test_quoted_line_breaks_and_long_cells(spark):
    long = "y" * 1_000_000
    rows = parsed(spark, g_players=PLAYER + f'blue;"an\nn ""x""";1;2;3;4\r\norange;"{long}";5;6;7;8\n')
    got = {r["row_no"]: r for r in x.player_stats(rows).collect()}
    assert len(got) == 2 and got[0]["player"] == 'an\nn "x"' and got[1]["player"] == long and got[1]["goals"] == 5
    open_quote = x.player_stats(parsed(spark, g_players=PLAYER + 'blue;"ann;1;2;3;4\norange;bob;1;2;3;4\n'))
    assert open_quote.count() == 1


def test_files_without_rows_are_rejected(spark):
    two = "blue;A;1;1;300\norange;B;2;2;300\n"
    rows = parsed(
        spark, a_teams=TEAM, b_teams="", c_teams=TEAM + two, c_players=PLAYER, d_teams=TEAM + two, d_players=PLAYER + "blue;x;1;1;1;1\n"
    )
    why = {r["replay_id"]: r["reject_reason"] for r in x.reject_reasons(rows, ["color", "score"]).collect()}
    assert why == {"a": "no_rows", "b": "empty_file", "c": "no_player_export", "d": None}
    assert {r["replay_id"] for r in x.game_rows(rows).collect()} == {"d"}


def test_faults_found_while_reading(spark, tmp_path):
    two = "blue;A;1;1;300\norange;B;2;2;300\n"
    write(tmp_path / "S/a-teams.csv", TEAM + two)
    write(tmp_path / "S/a-players.csv", PLAYER + "blue;x;1;1;1;1\n")
    write(tmp_path / "S/b-teams.csv", TEAM + two + "\n")
    (tmp_path / "S/b-teams.csv").write_bytes((TEAM + two).encode() + b"\xc3(")
    write(tmp_path / "S/c-teams.csv", TEAM + two + 'blue;"never closed;1;1;300\n')
    write(tmp_path / "S/d-teams.csv", TEAM + two.replace("300\norange", "300;more\norange"))
    write(tmp_path / "S/e-teams.csv", TEAM + two)
    write(tmp_path / "S/e-players.csv", PLAYER + "blue;x;1;1;1;1;7;8\n")
    listing = spark.createDataFrame([(f"file:{tmp_path}/S/gone-teams.csv",)], "path string").union(
        x._files(spark, str(tmp_path), "*.csv", skip=False).select("path")
    )
    gone = x.unreadable_exports(spark, str(tmp_path), listing=listing)
    files = x.read_exports(spark, str(tmp_path)).unionByName(gone)
    rows = x.parse_exports(x.with_path_fields(files, str(tmp_path)))
    why = {r["replay_id"]: r["reject_reason"] for r in x.reject_reasons(rows, ["color", "score"]).collect()}
    assert why == {"a": None, "b": "not_utf8", "c": "parse_failed", "d": "ragged_rows", "e": "no_player_export", "gone": "unreadable"}
    assert {r["replay_id"] for r in x.game_rows(rows).collect()} == {"a"}
    assert {r["replay_id"] for r in x.game_rows(rows, source="team").collect()} == {"a", "e"}


def test_games_from_team_rows(spark):
    head = "score;color;TEAM NAME;Goals;shooting percentage;game duration\n"
    rows = parsed(
        spark, a_teams=head + "400;Orange;O;9;0.5;301\n500;blue;B;1;25;300\n", b_teams=head + "5;blue;B;1;;\n5;orange;O;2;1;300\n",
        a_players=PLAYER + "blue;x;7;7;7;7\norange;y;8;8;8;8\n", c_teams=head + "5;blue;B;1;1;1\n",
    )
    got = {r["replay_id"]: r for r in x.game_rows(rows, ["color", "score"], source="team").collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a["game_winner"], a["blue_goals"], a["orange_goals"], a["blue_shooting_percentage"], a["game_duration"]) == ("B", 1, 9, 25, "300")
    assert (b["game_winner"], b["game_duration"], b["blue_shooting_percentage"]) == ("", None, None)


def test_files_of_one_header_stay_where_they_are(spark):
    """Headers are resolved next to their lines: no file moves to the others of its header."""
    rows = [(f"/raw/S/{i}-players.csv", (PLAYER if i % 2 else "goals;Player;COLOR\n") + ("blue;x;1;1;1;1\n" if i % 2 else "1;x;blue\n")) for i in range(40)]
    files = spark.createDataFrame(rows, "path string, content string").repartition(5)
    parsed_rows = x.parse_exports(x.with_path_fields(files, "/raw"))
    assert "Join" not in parsed_rows._jdf.queryExecution().optimizedPlan().toString()
    got = x.player_stats(parsed_rows)
    assert got.count() == 40 and got.filter("player = 'x' and color = 'blue' and goals = 1").count() == 40
    assert parsed_rows.rdd.getNumPartitions() == 5


def test_written_files_are_read_back(spark, tmp_path):
    """Bytes of any kind in folders with blanks, each file once, written by several tasks."""
    rows = [(f"Group Stages/Group {i % 3}/{i}-teams.csv", TEAM.encode() + (b"\xc3(" if i == 7 else b"blue;A;1;1;300\n")) for i in range(30)]
    root = f"file:{tmp_path}/a folder"
    x.write_files(spark.createDataFrame(rows, "file string, body binary").repartition(4), root)
    assert {str(p.relative_to(tmp_path / "a folder")): p.read_bytes() for p in tmp_path.rglob("*.csv")} == dict(rows)
    files = x.export_listing(spark, root)
    found = x.with_path_fields(x.read_exports(spark, root, files=files), f"{tmp_path}/a folder").collect()
    assert len(found) == 30 and {r["replay_id"] for r in found if r["read_fault"]} == {"7"}
    assert {r["subgroup"] for r in found} == {"Group 0", "Group 1", "Group 2"}
    assert x.unreadable_exports(spark, root, files=files).count() == 0
