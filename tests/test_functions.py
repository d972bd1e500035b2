from pyspark.sql import functions as F

from seriesmill.functions import rosters as r
from seriesmill.functions import rules, text
from seriesmill.functions.timestamps import parse_display_timestamp


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'double' if isinstance(values[n], float) else 'string'}" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_lenient_numbers(spark):
    got = {
        v: one(spark, text.to_double_lenient(F.col("v")), v=v)
        for v in ["1.5", " 2 ", "1e3", "-4", "n/a", "", "NaN", "7d", "7F", "1,5"]
    }
    assert got == {
        "1.5": 1.5, " 2 ": 2.0, "1e3": 1000.0, "-4": -4.0, "n/a": None, "": None, "NaN": None,
        "7d": None, "7F": None, "1,5": None,
    }
    assert one(spark, text.to_double_lenient(F.col("v")), v="inf") == float("inf")


def test_display_timestamps(spark):
    def parse(v):
        p = one(spark, parse_display_timestamp(F.col("v")), v=v)
        return (p["utc"].strftime("%Y-%m-%d %H:%M") if p["utc"] else None), p["method"]

    assert parse("2025-01-10 18:22 UTC (2025-01-10 12:22 -06)") == ("2025-01-10 18:22", "explicit_utc")
    assert parse("(2025-01-10 12:22 -06)") == ("2025-01-10 18:22", "explicit_offset_-06")
    assert parse("2025-01-10 15:30") == ("2025-01-10 21:30", "display_clock_assumed_-06")
    assert parse("n/a") == (None, None)
    assert parse("2025-13-40 15:30") == (None, None)


def test_aliases_are_exact(spark):
    table = {"Ann": "Anna", "bob": "Robert"}
    assert one(spark, text.alias_name(F.col("v"), table), v=" Ann ") == "Anna"
    assert one(spark, text.alias_name(F.col("v"), table), v="ann") == "ann"
    assert one(spark, text.alias_name(F.col("v"), table, ignore_case=True), v="BOB") == "Robert"
    assert one(spark, text.alias_name(F.col("v"), table), v="Annie") == "Annie"
    assert one(spark, text.canonical_key(F.col("v"), {"x.y": "Q-1"}), v=" X.Y") == "q1"


def test_blank_and_placeholder_names(spark):
    assert one(spark, text.blank_to_null(F.col("v")), v="  ") is None
    for v in ["nan", "Unknown", " UNKNOWN TEAM ", ""]:
        assert one(spark, text.valid_name(F.col("v")), v=v) is None
    assert one(spark, text.valid_name(F.col("v")), v=" Nantes") == "Nantes"


def test_rosters(spark):
    split = lambda v: one(spark, r.split_roster(F.col("v")), v=v)
    assert split("a|b; c|") == ["a", "b; c"]
    assert split("a; b,c") == ["a", "b,c"]
    assert split("a, b") == ["a", "b"]
    assert split(None) == []
    names = F.split("v", ",")
    assert one(spark, r.roster_signature(names), v="b,B,a,b") == "B|a|b"
    assert one(spark, r.roster_signature(names, distinct=False, ignore_case=True), v="b,a,b") == "a|b|b"


def test_fingerprint_ignores_colour(spark):
    f = r.matchup_fingerprint(F.col("x"), F.col("y"))
    assert one(spark, f, x="b|c", y="a") == one(spark, f, x="a", y="b|c") == "a || b|c"
    assert one(spark, f, x="a", y="") is None
    assert one(spark, r.unordered_pair(F.col("x"), F.col("y")), x="a", y=None) is None


def test_rules(spark):
    a, b = F.col("a"), F.col("b")
    A, B = F.lit("A"), F.lit("B")
    assert one(spark, rules.winner_from_goals(a, b, A, B), a=2.0, b=2.0) is None
    assert one(spark, rules.winner_from_score(a, b, A, B), a=2.0, b=2.0) == ""
    assert one(spark, rules.winner_else_b(a, b, A, B), a=2.0, b=2.0) == "B"
    assert one(spark, rules.wins_required(F.col("s")), s="GROUP stages") == 3
    assert one(spark, rules.wins_required(F.col("s")), s=None) == 4
    assert one(spark, rules.is_playoff(F.col("s")), s=None) == 0
    assert one(spark, rules.format_series_id(F.lit("O1"), F.col("n")), n="7") == "O1_007"
    assert one(spark, rules.format_series_id(F.lit("O1"), F.col("n")), n="12345") == "O1_12345"


def test_times_do_not_depend_on_the_session_zone(spark):
    from seriesmill.functions.text import to_utc_lenient
    from seriesmill.functions.timestamps import parse_display_timestamp

    texts = ["2025-01-10 18:22 UTC", "(2025-01-10 12:22 -06)", "2025-01-10 12:22"]
    plain = ["2025-01-10 18:22", "2025-01-10", "2025-01-10T18:22:00Z", "2025-01-10 18:22:00+02:00", "x", None]
    zone = spark.conf.get("spark.sql.session.timeZone")
    found = []
    for other in (zone, "America/Chicago"):
        spark.conf.set("spark.sql.session.timeZone", other)
        try:
            a = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_seconds(parse_display_timestamp(F.col("t"))["utc"]))
            b = spark.createDataFrame([(t,) for t in plain], "t string").select(F.unix_seconds(to_utc_lenient(F.col("t"))))
            found.append([[r[0] for r in df.collect()] for df in (a, b)])
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
    noon = 1736533320
    assert found[0] == found[1] == [[noon] * 3, [noon, 1736467200, noon, noon - 7200, None, None]]
