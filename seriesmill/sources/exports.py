"""Per-game exports: small delimited files whose columns are known by name only.

Headers differ between files (order, synonyms, missing columns). A file's header is resolved
to the places of the known fields next to its lines, before these become rows, and a row's fields
are read by place: no file moves for it, however many share a header. ``spark.read.csv``
over such files would take every file's columns in the order of the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.functions.text import blank_to_null, to_double_lenient
from seriesmill.operators.games import AVERAGED, SUMMED

# Endings of team and player exports.
TEAM_ENDINGS = ("-teams.csv", "_team.csv")
PLAYER_ENDINGS = ("-players.csv", "_player.csv")

# Header synonyms of one player's statistics, first match wins.
SYNONYMS = {
    "goals": ["goals"],
    "assists": ["assists"],
    "saves": ["saves"],
    "shots": ["shots"],
    "shooting_percentage": ["shooting %", "shooting percentage", "shooting_percentage"],
    "bpm": ["bpm"],
    "avg_boost": ["avg boost", "average boost", "avg_boost", "avg boost amount"],
    "amount_collected": ["amount collected", "boost amount collected", "amount_collected"],
    "amount_stolen": ["amount stolen", "boost amount stolen", "amount_stolen"],
    "total_distance": ["total distance", "distance", "total_distance"],
    "time_ball_possession": ["time ball possession", "ball possession", "time_ball_possession"],
    "time_in_front_ball": ["time in front ball", "time in front of ball", "time_in_front_ball"],
    "time_behind_ball": ["time behind ball", "time behind of ball", "time_behind_ball"],
    "time_offensive_half": ["time offensive half", "time in offensive half", "time_offensive_half"],
    "time_defensive_half": ["time defensive half", "time in defensive half", "time_defensive_half"],
    "demos_inflicted": ["demos inflicted", "demos inflicted on opponents", "demos_inflicted"],
    "demos_taken": ["demos taken", "demos received", "demos_taken"],
}
SYNONYMS |= {"color": ["color", "team color"], "duration": ["game duration", "duration"]}
# Header synonyms of names, by kind of file.
TEAM_FILE_NAMES = ["team name", "name", "team"]
PLAYER_FILE_TEAM_NAMES = ["team name", "team"]
PLAYER_NAMES = ["player name", "player", "name"]

#: Fields of a row and the headers that carry them, the preferred one first.
FIELDS = SYNONYMS | {"score": ["score"], "team_file_name": TEAM_FILE_NAMES, "player_file_team": PLAYER_FILE_TEAM_NAMES, "player": PLAYER_NAMES}


def _files(spark: SparkSession, root: str, pattern: str, skip: bool) -> DataFrame:
    """Files as bytes; with ``skip`` those that can't be read are left out instead of stopping the job."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return reader.option("ignoreCorruptFiles", str(skip).lower()).load(root)


def write_files(files: DataFrame, root: str) -> None:
    """Each row (``file``: the name below ``root``, ``body``: bytes) as a file of its own, written by the tasks.

    A writer of Spark's makes a folder for each file and moves it when a task commits. Here a task that is
    tried again puts the same bytes at the same place. ``root`` is a path or URI that all tasks reach.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = root.removeprefix("file://").removeprefix("file:")
        store, top = (stores.LocalFileSystem(), local) if local.startswith("/") else stores.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            for name, body in zip(batch.column("file").to_pylist(), batch.column("body").to_pylist(), strict=True):
                place = f"{top}/{name}"
                folder = place.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(place) as out:
                    out.write(body)
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    files.select("file", "body").mapInArrow(each, "files long").agg(F.sum("files")).collect()


def export_listing(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """Matching files below ``root`` as bytes: one listing that both readers below can share."""
    return _files(spark, root, pattern, skip=True)


def read_exports(spark: SparkSession, root: str, pattern: str = "*.csv", files: DataFrame | None = None) -> DataFrame:
    """(path, content, read_fault) of every matching file below ``root``; one file is one game side.

    A file that is no UTF-8 text has the fault ``not_utf8`` and no content. Files that are
    listed but can't be read are missing here: see ``unreadable_exports``. Spark's readers do
    not list files of no bytes at all.
    """
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    files = export_listing(spark, root, pattern) if files is None else files
    return files.select("path", F.when(valid, text).alias("content"), F.when(~valid, "not_utf8").alias("read_fault"))


def unreadable_exports(
    spark: SparkSession, root: str, pattern: str = "*.csv", listing: DataFrame | None = None, files: DataFrame | None = None
) -> DataFrame:
    """(path, content, read_fault) of files that are listed, here or in ``listing``, but can't be read."""
    files = export_listing(spark, root, pattern) if files is None else files
    listed = files if listing is None else listing  # a file's path alone is known without reading it
    read = files.filter(F.length("content") >= 0)
    gone = listed.select("path").join(read.select("path"), "path", "left_anti")
    return gone.select("path", F.lit(None).cast("string").alias("content"), F.lit("unreadable").alias("read_fault"))


def with_path_fields(files: DataFrame, root: str) -> DataFrame:
    """Kind of export, replay id, folder, stage and subgroup from the path below root.

    ``root`` is a literal prefix of the paths, or a marker such as ``/raw/`` inside them.
    """
    below = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    parts = F.split(below, "/")
    depth = F.size(parts)
    file = F.element_at(parts, -1)
    ending = F.regexp_extract(file, r"(?i)(-teams\.csv|_team\.csv|-players\.csv|_player\.csv)$", 1)
    kind = F.when(F.lower(ending).isin(*TEAM_ENDINGS), "team").when(
        F.lower(ending).isin(*PLAYER_ENDINGS), "player"
    )
    stage = F.when(depth >= 2, parts[0])
    return files.withColumns(
        {
            "source_file": below,
            "folder": F.array_join(F.slice(parts, 1, F.greatest(depth - 1, F.lit(0))), "/"),
            "kind": kind,
            "replay_id": F.substring(file, F.lit(1), F.length(file) - F.length(ending)),
            "stage": stage,
            "subgroup": F.when((stage == "Group Stages") & (depth >= 3), F.get(parts, F.lit(1))),
        }
    )


def _cells(line: Column, sep: str) -> Column:
    """Cells of one line; a cell may be quoted and then contain the separator."""
    s = "\\" + sep
    # Possessive throughout: a cell of any length costs no stack.
    raw = F.regexp_extract_all(
        F.concat(F.lit(sep), line), F.lit(s + '("[^"]*+(?:""[^"]*+)*+"|[^' + s + "]*+)"), F.lit(1)
    )
    unquoted = F.transform(
        raw,
        lambda c: F.when(
            c.startswith('"') & c.endswith('"') & (F.length(c) >= 2),
            F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(c),
    )
    return F.when(line.contains('"'), unquoted).otherwise(F.split(line, s))


def normalise_headers(names: Column) -> Column:
    """Header names without a byte-order mark, trimmed, lower case."""
    return F.transform(names, lambda h: F.lower(F.trim(F.regexp_replace(h, "^\ufeff", ""))))


def _with_places(files: DataFrame, sep: str) -> DataFrame:
    """Files with the names of their ``__head`` and the places (from 1, else 0) of all known fields."""
    first = [F.coalesce(*[F.nullif(F.array_position("header", c), F.lit(0)) for c in found], F.lit(0)) for found in FIELDS.values()]
    named = files.withColumn("header", normalise_headers(_cells(F.col("__head"), sep)))
    return named.withColumn("__at", F.array(*[x.cast("int") for x in first]))


def parse_exports(files: DataFrame, sep: str = ";") -> DataFrame:
    """One row per data line: the other columns, ``header``, ``row_no`` from 0, ``values``, ``fault``.

    ``values`` are the texts of ``FIELDS``: where a file has several headers of a field the
    preferred one counts, where it repeats one the first. Missing and blank cells are null. A
    quoted cell may hold line breaks. A file without a data line gives one row without ``row_no``
    and values. ``fault`` of a file is ``parse_failed`` (a quote that never ends),
    ``ragged_rows`` (a line has more cells than the header), or what reading found.
    """
    content = F.coalesce("content", F.lit(""))
    quoted = content.contains('"')
    records = F.regexp_extract_all(content, F.lit(r'((?:[^"\r\n]++|"[^"]*+(?:"|\z))++)'), F.lit(1))
    lines = F.filter(F.when(quoted, records).otherwise(F.split(content, r"[\r\n]+")), lambda x: F.trim(F.replace(x, F.lit("\ufeff"))) != "")
    cut_up = files.withColumn("__all", lines).withColumn("__head", F.get("__all", F.lit(0)))
    quotes = F.length(content) - F.length(F.replace(content, F.lit('"')))
    found = F.col("read_fault") if "read_fault" in files.columns else F.lit(None).cast("string")
    out = (
        # Lines are cut before they become rows: a lambda would cut its line once per cell.
        _with_places(cut_up, sep)
        .withColumn("__lines", F.transform(F.slice("__all", 2, 2147483646), lambda x: _cells(x, sep)))
        .withColumn("__open", quotes % 2 == 1)
        .withColumn(
            "fault",
            F.coalesce(
                found,
                F.when(F.col("__open"), "parse_failed"),
                F.when(F.exists("__lines", lambda x: F.size(x) > F.size("header")), "ragged_rows"),
            ),
        )
        .drop("content", "__all", "__head", "__open", "read_fault")
    )
    out = out.select("*", F.posexplode_outer("__lines").alias("row_no", "__cells")).drop("__lines")
    values = F.transform("__at", lambda i: F.nullif(F.trim(F.get(F.col("__cells"), i - 1)), F.lit("")))
    return out.withColumn("values", F.when(F.col("row_no").isNotNull(), values)).drop("__at", "__cells")


def field(name: str) -> Column:
    """Text of a known field of a row."""
    return F.get("values", F.lit(list(FIELDS).index(name)))


def _with_stats(rows: DataFrame) -> DataFrame:
    """Add the statistics as doubles. One lambda over an array of texts keeps the
    generated code small, where 17 lenient casts side by side would not be compiled."""
    names = SUMMED + AVERAGED
    texts = F.array(*[field(s) for s in names])
    out = rows.withColumn("__numbers", F.transform(texts, to_double_lenient))
    return out.withColumns({s: F.get("__numbers", F.lit(i)) for i, s in enumerate(names)}).drop("__numbers")


def player_stats(rows: DataFrame) -> DataFrame:
    """Typed statistics of player rows."""
    return _with_stats(rows.filter(F.col("row_no").isNotNull())).select(
        "folder",
        "replay_id",
        "row_no",
        F.lower(F.trim(field("color"))).alias("color"),
        blank_to_null(field("player")).alias("player"),
        blank_to_null(field("player_file_team")).alias("team"),
        *SUMMED,
        *AVERAGED,
    )


def pair_files(files: DataFrame) -> DataFrame:
    """Team exports with the player export of the same folder and replay id."""
    keys = ["folder", "replay_id"]
    team = files.filter(F.col("kind") == "team").select(*keys, F.col("source_file").alias("team_file"))
    # Of two player files with one id the last path wins.
    player = (
        files.filter(F.col("kind") == "player")
        .groupBy(*keys)
        .agg(F.max("source_file").alias("player_file"), F.count(F.lit(1)).alias("player_files"))
    )
    return team.join(player, keys, "left")


def reject_reasons(rows: DataFrame, required: list[str]) -> DataFrame:
    """One row per team export: why it cannot be used, or null.

    Reasons, first match: ``unreadable``, ``not_utf8``, an empty file, ``parse_failed``,
    ``ragged_rows``, missing columns, no data rows, not two rows, not one blue and one
    orange, no player export (one without data rows, or that could not be read, counts as none).
    """
    team = rows.filter(F.col("kind") == "team")
    has_all = F.lit(True)
    for name in required:
        has_all = has_all & F.array_contains("header", name)
    colour = F.lower(F.trim(field("color")))
    checked = team.groupBy("folder", "replay_id").agg(
        F.bool_and(F.coalesce(has_all, F.lit(False))).alias("complete"),
        F.bool_and(F.col("header").isNull()).alias("empty"),
        F.max("fault").alias("fault"),
        F.count("row_no").alias("n"),
        F.count_if(colour == "blue").alias("blue"),
        F.count_if(colour == "orange").alias("orange"),
    )
    players = (
        rows.filter((F.col("kind") == "player") & F.col("row_no").isNotNull() & F.col("fault").isNull())
        .select("folder", "replay_id")
        .distinct()
        .withColumn("has_players", F.lit(True))
    )
    reason = (
        F.when(F.col("fault").isin("unreadable", "not_utf8"), F.col("fault"))
        .when(F.col("empty"), "empty_file")
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(~F.col("complete"), "missing_columns")
        .when(F.col("n") == 0, "no_rows")
        .when(F.col("n") != 2, "team_rows_not_2")
        .when((F.col("blue") != 1) | (F.col("orange") != 1), "not_one_blue_one_orange")
        .when(F.col("has_players").isNull(), "no_player_export")
    )
    return checked.join(players, ["folder", "replay_id"], "left").select(
        "folder", "replay_id", reason.alias("reject_reason")
    )


def game_rows(rows: DataFrame, required: list[str] | None = None, source: str = "players") -> DataFrame:
    """45 columns per game: identity, scores, both sides' statistics and the winner.

    With ``source="players"`` statistics are sums and means over the player export, names come
    from the team export, else from the first named player row of the colour, and more goals
    win. With ``source="team"`` only team exports count: their one row of a colour has the
    statistics, names and duration (the blue row's), and the higher score wins ('' on a tie).
    Only sound games are built: exports without a fault, a team export of one blue and one orange row, a
    player export with rows (where players count), and all ``required`` columns;
    ``reject_reasons`` names the others.
    """
    from seriesmill.functions.rules import winner_from_goals, winner_from_score
    from seriesmill.operators.games import COLOURS

    if source not in ("players", "team"):
        raise ValueError(f"source must be players or team, not {source}")
    alone = source == "team"
    team, player = F.col("kind") == "team", F.col("kind") == "player"
    if alone:
        rows = rows.filter(team)
    complete = F.lit(True)
    for name in required or []:
        complete = complete & F.array_contains("header", name)
    typed = _with_stats(rows.filter(F.col("row_no").isNotNull())).select(
        "folder",
        "replay_id",
        complete.alias("complete"),
        "kind",
        "row_no",
        "stage",
        "subgroup",
        "source_file",
        F.lower(F.trim(field("color"))).alias("color"),
        F.when(team, blank_to_null(field("team_file_name"))).otherwise(blank_to_null(field("player_file_team"))).alias("team"),
        (to_double_lenient(field("score")) if alone else F.coalesce(to_double_lenient(field("score")), F.col("goals"))).alias("score"),
        field("duration").alias("duration"),
        F.col("fault").isNull().alias("sound"),
        *[F.when(team if alone else player, F.col(s)).alias(s) for s in SUMMED + AVERAGED],
    )

    def first(column: str, where: Column) -> Column:
        return F.min_by(F.col(column), F.when(where, F.col("row_no")))

    # One colour of one game first, both exports together; then both colours side by side.
    order = F.struct((F.col("color") != "blue").alias("second"), "row_no") if alone else F.struct((~team).alias("second"), F.col("row_no"))
    place = F.when(F.lit(alone) | F.col("duration").isNotNull(), order)
    sides = typed.groupBy("folder", "replay_id", "color").agg(
        F.count_if(team).alias("team_rows"),
        F.bool_and(F.col("sound") & (~team | F.col("complete"))).alias("complete"),
        F.bool_or(player).alias("in_player"),
        F.min(F.when(team, F.col("stage"))).alias("stage"),
        F.min(F.when(team, F.col("subgroup"))).alias("subgroup"),
        F.min(F.when(team, F.col("source_file"))).alias("source_team_file"),
        F.coalesce(first("team", team), first("team", player & F.col("team").isNotNull())).alias("team"),
        first("score", team).alias("score"),
        F.min(place).alias("place"),
        F.min_by("duration", place).alias("duration"),
        *[F.sum(s).alias(s) for s in SUMMED],
        *[F.avg(s).alias(s) for s in AVERAGED],
    )
    side = F.struct("team", "score", *SUMMED, *AVERAGED)
    out = (
        sides.groupBy("folder", "replay_id")
        .agg(
            F.bool_and("complete").alias("complete"),
            F.sum("team_rows").alias("team_rows"),
            *[F.sum(F.when(F.col("color") == c, F.col("team_rows")).otherwise(0)).alias(f"{c}_rows") for c in COLOURS],
            F.bool_or("in_player").alias("in_player"),
            F.min("stage").alias("stage"),
            F.min("subgroup").alias("subgroup"),
            F.min("source_team_file").alias("source_team_file"),
            F.min_by("duration", "place").alias("game_duration"),
            *[F.first(F.when(F.col("color") == c, side), ignorenulls=True).alias(c) for c in COLOURS],
        )
        .filter("complete and team_rows = 2 and blue_rows = 1 and orange_rows = 1" + ("" if alone else " and in_player"))
    )
    out = out.withColumns(
        {f"{c}_{f}": F.col(f"{c}.{f}") for c in COLOURS for f in ("team", "score", *SUMMED, *AVERAGED)}
    )
    rule, by = (winner_from_score, "score") if alone else (winner_from_goals, "goals")
    winner = rule(F.col(f"blue_{by}"), F.col(f"orange_{by}"), F.col("blue_team"), F.col("orange_team"))
    return out.withColumn("game_winner", winner).select(
        "replay_id",
        "stage",
        "subgroup",
        "source_team_file",
        "blue_team",
        "orange_team",
        "blue_score",
        "orange_score",
        "game_duration",
        *[f"{c}_{s}" for c in COLOURS for s in SUMMED + AVERAGED],
        "game_winner",
    )
