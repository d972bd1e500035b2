import math
import random

import pytest
from pyspark.sql import functions as F

from seriesmill.operators import history as h
from seriesmill.operators.identity import resolve_identity

SCHEMA = "contest_id long, s long, tournament_order int, team_a string, team_b string, target int, a_games long, b_games long"


def contests(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("s"))


def brute(rows, k):
    """Batch by batch, as a person would: look first, then update."""
    past, out = {}, {}
    for t in sorted({r[1] for r in rows}):
        batch = sorted([r for r in rows if r[1] == t], key=lambda r: (r[2], r[0]))
        for cid, _, _, a, b, *_ in batch:
            for side, team in (("a", a), ("b", b)):
                seen = past.get(team, [])
                streak = 0
                for won, *_ in reversed(seen):
                    if not won:
                        break
                    streak += 1
                last = seen[-k:]
                rates = [gw / (gw + gl) if gw + gl else math.nan for _, gw, gl in last]
                mean = sum(rates) / len(rates) if rates else math.nan
                out[cid, side] = (
                    len(seen),
                    sum(w for w, *_ in seen),
                    sum(x[1] for x in seen),
                    sum(x[2] for x in seen),
                    streak,
                    len(last),
                    sum(w for w, *_ in last) / len(last) if last else None,
                    None if math.isnan(mean) else round(mean, 9),
                )
        for cid, _, _, a, b, target, ga, gb in batch:
            if target is not None:
                past.setdefault(a, []).append((target, ga, gb))
                past.setdefault(b, []).append((1 - target, gb, ga))
    return out


def computed(df, k):
    out = h.form_features(df, (k,))
    names = [
        "prior_series_played", "prior_series_wins", "prior_game_wins", "prior_game_losses",
        "prior_series_win_streak", f"recent{k}_series_played", f"recent{k}_series_win_rate",
        f"recent{k}_avg_game_win_rate",
    ]
    got = {}
    for r in out.collect():
        for side in "ab":
            v = [r[f"team_{side}_{n}"] for n in names]
            got[r["contest_id"], side] = (*v[:-1], None if v[-1] is None else round(v[-1], 9))
    return got


def random_rows(seed, n=300, teams=6, spread=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.sample([f"t{j}" for j in range(teams)], 2)
        # one team takes part in a third of all contests; many share a moment
        if rng.random() < 0.33:
            a, b = "hot", b
        ga, gb = rng.choice([(0, 0), (3, 1), (2, 3), (4, 0)])
        t = rng.choice([0, 0, 59, 60]) + 60 * rng.randrange(spread)
        rows.append((i, t, rng.choice([1, 2]), a, b, rng.choice([0, 1, 1, None]), ga, gb))
    return rows


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 5), (3, 1)])
def test_matches_brute_force(spark, seed, k):
    rows = random_rows(seed)
    assert computed(contests(spark, rows), k) == brute(rows, k)


def test_text_ids(spark):
    rows = random_rows(4, n=120)
    df = contests(spark, rows).withColumn("contest_id", F.format_string("c%05d", "contest_id"))
    got = computed(df, 3)
    assert got == {(f"c{i:05d}", side): v for (i, side), v in brute(rows, 3).items()}


def test_crowded_moment_is_cut(spark, monkeypatch):
    """All contests at two moments; the team's contests are many pieces, and so is a moment."""
    from seriesmill.operators import ordering

    monkeypatch.setattr(ordering, "PIECE_ROWS", 8)
    monkeypatch.setattr(ordering, "SAMPLES", 4)
    rows = [(i, i % 2 * 100, 1, "hot", f"t{i % 5}", (i * 7 % 3) % 2, 3, i % 4) for i in range(150)]
    rows.append((999, 200, 1, "hot", "t1", None, 0, 0))
    assert computed(contests(spark, rows), 5) == brute(rows, 5)
    mixed = random_rows(6)
    assert computed(contests(spark, mixed), 3) == brute(mixed, 3)


def test_same_moment_shows_same_history(spark):
    rows = [(1, 10, 1, "N", "x", 1, 3, 0), (12, 60, 1, "N", "y", 1, 3, 1), (13, 60, 1, "z", "N", 0, 1, 3)]
    got = computed(contests(spark, rows), 3)
    assert got[12, "a"][0] == got[13, "b"][0] == 1
    features = h.form_features(contests(spark, rows))
    assert h.same_time_audit(features).count() == 0 and h.first_appearance_audit(features).count() == 0


def test_later_rows_change_nothing(spark):
    rows = random_rows(9, n=80)
    cut = 60 * 20
    early = [r for r in rows if r[1] <= cut]
    full, part = computed(contests(spark, rows), 3), computed(contests(spark, early), 3)
    assert all(full[k] == v for k, v in part.items())


def test_order_of_rows_changes_nothing(spark):
    rows = random_rows(11, n=80)
    mixed = rows[:]
    random.Random(3).shuffle(mixed)
    assert computed(contests(spark, rows), 5) == computed(contests(spark, mixed), 5)


def test_series_without_games_voids_the_mean(spark):
    rows = [(1, 1, 1, "a", "b", 1, 0, 0), (2, 2, 1, "a", "b", 1, 3, 1), (3, 3, 1, "a", "b", 1, 3, 1)]
    rows += [(i, i, 1, "a", "b", 1, 3, 1) for i in range(4, 7)]
    got = computed(contests(spark, rows), 3)
    assert got[3, "a"][-1] is None and got[4, "a"][-1] is None
    assert got[5, "a"][-1] == 0.75


def test_identities(spark):
    rows = [
        (1, "T1", "Red", None, "a|b", "c|d"),
        (2, "T1", None, "Blue", "a|b", "c|d"),
        (3, "T1", "One", "Two", "e", "f"),
        (4, "T1", "Uno", None, "e", "f"),
        (5, "T1", None, None, "e", None),
        (6, "T2", None, None, "a|b", "c|d"),
    ]
    df = spark.createDataFrame(
        rows, "id long, tournament string, team_a string, team_b string, team_a_players string, team_b_players string"
    )
    got = {r["id"]: (r["team_a"], r["team_a_source"], r["team_b"], r["team_b_source"]) for r in resolve_identity(df).collect()}
    look, fall = "same_tournament_roster_lookup", "roster_fallback"
    assert got[1] == ("Red", "stored_team_name", "Blue", look)
    assert got[2] == ("Red", look, "Blue", "stored_team_name")
    assert got[4] == ("Uno", "stored_team_name", "Two", look)
    assert got[5] == ("ROSTER::e", fall, "", "unresolved")
    assert got[6] == ("ROSTER::a|b", fall, "ROSTER::c|d", fall)
