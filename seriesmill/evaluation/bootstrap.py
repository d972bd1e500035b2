"""Paired bootstrap, stratified by fold, with the same draws for every model.

A draw is half of the digest of (seed, pair of replicates, fold, slot), so any task can redo
it. Weights are contests x replicates, so they never leave the task that draws them: the scores of the models
are packed once, a row for each run of scores, and each task reads all of these rows past the weights
of the few replicates it has drawn. A run adds to a vector over the replicates its counts and losses, and its won pairs
once all runs of a model are there. Only these vectors, models x replicates, leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.evaluation.metrics import CELLS, HIGHER_IS_BETTER, METRICS, brier_term, log_loss_term, with_rates
from seriesmill.functions.digests import decimals, halves
from seriesmill.operators.ordering import PIECE, cut, with_position
from seriesmill.sources.tables import written

#: Replicates that are drawn at once, and bytes of weights up to which a task holds as many (two at least).
REP_BLOCK, WEIGHTS_AT_ONCE = 64, 1 << 27
#: Contests whose packed weights are put together at once.
PLACES = 1024
#: Weights that are listed at once.
LISTED = 1 << 16
#: Contests of a model in a run of scores.
RUN_ROWS = 2048


def fold_positions(contests: DataFrame) -> DataFrame:
    """(id, fold, position): each fold's contests numbered from 0 in id order."""
    return with_position(contests, ["fold"], ["id"], "position", start=0)


def draws(seed: int, pair: int, fold: str, slots: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Positions drawn for some slots (``decimals``) in the replicates 2 x ``pair`` and 2 x ``pair`` + 1 (columns), equally likely up to 2**-60."""
    prefix, out = f"{seed}|{pair}|{fold}|".encode(), np.empty((2, sum(len(at) for at, _ in slots)), np.int64)
    for at, digits in slots:  # what a core's cache holds
        drawn = halves(prefix, [(slice(None), digits)]) >> np.uint64(4)  # the first 15 of 16 digits
        whole = drawn // np.uint64(size)  # with the product faster than the remainder
        whole *= np.uint64(size)
        drawn -= whole
        out[:, at] = drawn.T
    return out.T


def _weights(seed: int, fold: str | None, slots: list[tuple[np.ndarray, np.ndarray]], size: int, rep: int, until: int) -> Iterator[np.ndarray]:
    """The weights of all contests of a fold in one replicate after another; ``rep`` is even."""
    for r in range(rep, until, 2):
        at = draws(seed, r // 2, "" if fold is None else fold, slots, size)
        for odd in range(min(2, until - r)):
            yield np.bincount(at[:, odd], minlength=size)


def _units(positions: DataFrame, reps: int) -> DataFrame:
    """(fold, size, rep, until): replicates of a fold that a task draws, all slots of the fold at once.

    A fold of any size has its weights in few replicates in a task, never its contests.
    """
    sizes = positions.groupBy(F.col("fold").cast("string").alias("fold")).agg(F.count(F.lit(1)).alias("size"))
    most = F.floor(F.lit(WEIGHTS_AT_ONCE) / F.col("size") / 2) * 2
    width = F.greatest(F.lit(2).cast("long"), F.least(F.lit(REP_BLOCK).cast("long"), most))
    units = sizes.withColumn("width", width).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"), "width")).alias("rep"))
    out = units.select("fold", "size", "rep", F.least(F.col("rep") + F.col("width"), F.lit(reps).cast("long")).alias("until"))
    # The few small rows are a lot of work each: adaptive execution must not merge them into one task.
    return out.repartition(4 * int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _replicates(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[str | None, int, Iterator[np.ndarray]]]:
    """Fold, first replicate and the weights of all contests in one replicate after another, for each unit."""

    known, slots = -1, []
    for batch in batches:
        for fold, size, rep, until in zip(*(batch.column(c).to_pylist() for c in ("fold", "size", "rep", "until")), strict=True):
            if size != known:
                known, slots = size, decimals(np.arange(size))
            yield fold, rep, _weights(seed, fold, slots, size, rep, until)


def _drawn(units: DataFrame, seed: int) -> DataFrame:
    """(fold, group, rep, places, wide, weights): weights of ``PLACES`` contests in a block of replicates, in numbers of ``wide`` bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, rep, weights in _replicates(batches, seed):
            block = np.stack([w.astype(np.uint8 if w.max() < 1 << 8 else np.uint32) for w in weights])
            for g, first in enumerate(range(0, block.shape[1], PLACES)):
                part = block[:, first : first + PLACES]
                numbers = {"group": [g], "rep": [rep], "places": [part.shape[1]], "wide": [block.itemsize]}
                yield pa.RecordBatch.from_pydict({"fold": pa.array([fold], pa.string()), **numbers, "weights": pa.array([part.tobytes()], pa.binary())})

    return units.mapInArrow(each, "fold string, group long, rep long, places long, wide long, weights binary")


def _packed(drawn: pa.Table, reps: int) -> np.ndarray:
    """Weights (contests of a group x replicates) in numbers of a byte or two."""
    out = None
    for rep, places, wide, body in zip(*(drawn.column(c).to_pylist() for c in ("rep", "places", "wide", "weights")), strict=True):
        block = np.frombuffer(body, f"<u{wide}").reshape(-1, places).T
        if block.max(initial=0) >= 1 << 16:
            raise ValueError("a contest is drawn too often")
        if out is None:
            out = np.zeros((places, reps), np.uint8)
        if wide > 1 and out.itemsize == 1:
            out = out.astype("<u2")
        out[:, rep : rep + block.shape[1]] = block
    return out


def weighted_scores(scores: DataFrame, positions: DataFrame, reps: int, seed: int) -> DataFrame:
    """``scores`` (fold, position and others) with ``weights``, packed: how often each contest is drawn in each replicate.

    A group of contests meets its weights in one place; contests that are never drawn are left out. The result is
    contests x replicates, so this is for lists of weights only: ``replicate_metrics`` makes none.
    """
    others = [c for c in scores.columns if c not in ("fold", "position")]
    group = F.floor(F.col("position") / PLACES).cast("long")
    known = scores.filter(F.col("fold").isNotNull()).withColumn("group", group)
    kinds = ", ".join(f"`{c}` {scores.schema[c].dataType.simpleString()}" for c in others)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return left.select(others).slice(0, 0).append_column("weights", pa.array([], pa.binary()))
        weights = _packed(right, reps)
        bodies = pa.array([w.tobytes() if w.any() else None for w in weights], pa.binary())
        out = left.append_column("weights", bodies.take(pa.array(left.column("position").to_numpy() % PLACES)))
        return out.filter(pc.is_valid(out.column("weights"))).select([*others, "weights"])

    drawn = _drawn(_units(positions, reps), seed)
    return known.groupBy("fold", "group").cogroup(drawn.groupBy("fold", "group")).applyInArrow(meet, f"{kinds}, weights binary")


def _block(seed: int, folds: list[tuple[str | None, int, int]], rep: int, until: int) -> np.ndarray:
    """Weights (contests of all folds x replicates) in numbers of as few bytes as hold them; a fold is its name, first place and size."""
    out = np.zeros((sum(size for _, _, size in folds), until - rep), np.uint8)
    for fold, first, size in folds:
        for k, weights in enumerate(_weights(seed, fold, decimals(np.arange(size)), size, rep, until)):
            kind = np.min_scalar_type(weights.max())
            if kind.itemsize > out.itemsize:
                out = out.astype(kind)
            out[first : first + size, k] = weights
    return out


def sample_weights(positions: DataFrame, reps: int, seed: int) -> DataFrame:
    """(rep, fold, position, weight): how often a contest is drawn in a replicate; the tasks that draw list it.

    A contest's replicates of a task follow each other, so columns of a written list are short: each number comes
    many times in a row or is one of few.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold, size, rep, until in zip(*(batch.column(c).to_pylist() for c in ("fold", "size", "rep", "until")), strict=True):
                block, width = _block(seed, [(fold, 0, size)], rep, until), until - rep
                for first in range(0, size, max(1, LISTED // width)):
                    part = block[first : first + max(1, LISTED // width)].ravel()
                    drawn = np.flatnonzero(part)
                    at, n = drawn // width, len(drawn)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((drawn - at * width + rep).astype(np.int32)), pa.array([fold], pa.string()).take(pa.array(np.zeros(n, np.int32))),
                            pa.array(at + first), pa.array(part[drawn].astype(np.int64)),
                        ],
                        ["rep", "fold", "position", "weight"],
                    )

    return _units(positions, reps).mapInArrow(each, "rep int, fold string, position long, weight long")


def unpacked(body: bytes, reps: int) -> np.ndarray:
    return np.frombuffer(body, "u1" if len(body) == reps else "<u2")


#: Whether a contest counts in a cell: the digits to base 4 of a code, 2 for null.
_CELLS = np.array([[(0.0, 1.0, np.nan, np.nan)[code >> 2 * k & 3] for code in range(256)] for k in range(len(CELLS))])
_RUN = "model string, low double, high double, scores int, sizes array<long>, targets binary, places binary, cells binary, losses binary, below binary"


def _packed_runs(runs: DataFrame, first: dict[str, int], kind: str) -> DataFrame:
    """A row for each run of scores of a model, with its contests in four parts: those of the first and of the last
    score, which may go on in other runs, then the losers and the winners in between (others last).

    ``first`` is the place of a fold's first contest among all, ``kind`` the type of places. ``below`` has for each winner how many
    of the losers have lower scores, and how many lower or equal ones.
    """

    def pack(table: pa.Table) -> pa.Table:
        folds = table.column("fold").combine_chunks().dictionary_encode()
        starts = np.array([first[f] for f in folds.dictionary.to_pylist()])
        place = starts[folds.indices.to_numpy()] + table.column("position").to_numpy()
        score, target = table.column("probability").to_numpy(), table.column("target").to_numpy()
        order = np.lexsort((place, table.column("turn").to_numpy(), score))
        place, score, target = place[order], score[order], target[order]
        new = np.concatenate([[True], score[1:] != score[:-1]])  # each missing score is one of its own
        number = np.cumsum(new) - 1
        ends, inner = (number == 0, (number == number[-1]) & (number > 0)), (number > 0) & (number < number[-1])
        losers, winners = np.flatnonzero(inner & (target == 0)), np.flatnonzero(inner & (target == 1))
        rows = np.concatenate([*map(np.flatnonzero, ends), losers, winners, np.flatnonzero(inner & (target != 0) & (target != 1))])
        heads = target[rows[: ends[0].sum() + ends[1].sum()]]
        cells = [np.where(np.isnan(c), 2, c).astype(np.uint8) << 2 * k for k, c in enumerate(table.column(c).to_numpy().astype(np.float64) for c in CELLS)]
        bodies = {
            "targets": np.where(heads == 1, 1, np.where(heads == 0, 0, 2)).astype(np.uint8),
            "places": place[rows].astype(kind),
            "cells": np.bitwise_or.reduce(cells)[order][rows],
            "losses": np.stack([table.column(c).to_numpy().astype(np.float64)[order][rows] for c in ("loss", "miss")]),
            "below": np.stack([np.searchsorted(number[losers], number[winners], side) for side in ("left", "right")]).astype("<u4"),
        }
        numbers = {"low": [float(score[0])], "high": [float(score[-1])], "scores": pa.array([number[-1] + 1], pa.int32())}
        sizes = [[int(ends[0].sum()), int(ends[1].sum()), len(losers), len(winners)]]
        model = pa.array([table.column("model")[0].as_py()], pa.string())
        return pa.table({"model": model, **numbers, "sizes": pa.array(sizes, pa.list_(pa.int64())), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in bodies.items()}})

    return runs.groupBy("model", PIECE).applyInArrow(pack, _RUN)


class _Sums:
    """What the runs of a model come to in some replicates."""

    def __init__(self, n: int) -> None:
        self.linear = np.zeros((len(CELLS) + 2, n))
        self.parts: list[tuple[float, int, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, run: dict, weights: np.ndarray, kind: str) -> None:
        body = {c: np.frombuffer(run[c].as_buffer(), t) for c, t in (("targets", "u1"), ("places", kind), ("cells", "u1"), ("losses", "<f8"), ("below", "<u4"))}
        own = np.take(weights, body["places"], axis=0).astype(np.float64)
        self.linear += np.concatenate([_CELLS[:, body["cells"]], body["losses"].reshape(2, -1)]) @ own
        head, tail, losers, winners = run["sizes"].as_py()
        nothing, targets = np.zeros(own.shape[1]), body["targets"]
        for score, a, b in ((run["low"].as_py(), 0, head), (run["high"].as_py(), head, head + tail))[: run["scores"].as_py()]:
            self.parts.append((score, 0, *(own[a:b][targets[a:b] == t].sum(0) for t in (1, 0)), nothing))
        if run["scores"].as_py() > 2:
            at = head + tail + losers
            lost, won = np.zeros((losers + 1, own.shape[1])), own[at : at + winners]
            np.cumsum(own[head + tail : at], axis=0, out=lost[1:])
            lower, up_to = (np.take(lost, b, axis=0) for b in body["below"].reshape(2, -1))
            lower += up_to
            self.parts.append((run["low"].as_py(), 1, won.sum(0), lost[-1], np.einsum("ij,ij->j", won, lower) / 2))

    def total(self) -> np.ndarray:
        """pos, neg, won pairs, cells, loss and miss (rows) in each replicate.

        Equal scores of neighbouring runs come together before their pairs are counted.
        """
        score, between = (np.array([p[k] for p in self.parts]) for k in (0, 1))
        order = np.lexsort((between, score))
        score, between = score[order], between[order]
        same = (score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1]))
        starts = np.flatnonzero(np.concatenate([[True], ~same | (between[1:] != between[:-1])]))
        pos, neg, u = (np.add.reduceat(np.stack([p[k] for p in self.parts])[order], starts, axis=0) for k in (2, 3, 4))
        lower = np.cumsum(neg, axis=0) - neg
        won = u + np.where(between[starts][:, None] == 0, pos * neg / 2, 0.0) + pos * lower
        return np.concatenate([[pos.sum(0), neg.sum(0), won.sum(0)], self.linear])


def _replicate_sums(packed: DataFrame, folds: list[tuple[str, int, int]], reps: int, seed: int, kind: str) -> DataFrame:
    """(model, rep, pos, neg, u, cells, loss, miss): a task draws some replicates at a time and reads all runs past their weights."""
    spark, contests, runs = packed.sparkSession, sum(size for _, _, size in folds), packed.count()
    width = max(2, min(REP_BLOCK, WEIGHTS_AT_ONCE // max(1, contests) // 2 * 2))
    tasks = min(-(-reps // width), 8 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    names = ["model", "rep", "pos", "neg", "u", *CELLS, "loss", "miss"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, weights, sums = None, 0, None, {}
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                rep = columns["rep"][i].as_py()
                if rep != known:
                    known, seen, weights, sums = rep, 0, None, {}
                    weights = _block(seed, folds, rep, min(rep + width, reps))
                run = {c: x[i] for c, x in columns.items()}
                sums.setdefault(run["model"].as_py(), _Sums(weights.shape[1])).add(run, weights, kind)
                seen += 1
                if seen == runs:
                    for model, found in sums.items():
                        total = found.total()
                        n = total.shape[1]
                        yield pa.RecordBatch.from_arrays([pa.array([model] * n, pa.string()), pa.array(np.arange(rep, rep + n, dtype=np.int32)), *map(pa.array, total)], names)
        if known is not None and seen != runs:
            raise ValueError(f"{seen} of {runs} runs came to the replicates from {known} on")

    # Each task reads the one partition of all runs for each of its rows, so neither side is shuffled.
    units = spark.range(0, reps, width, tasks).withColumnRenamed("id", "rep")
    met = units.hint("shuffle_replicate_nl").crossJoin(packed.coalesce(1))
    return met.mapInArrow(each, f"model string, rep int, {', '.join(f'{c} double' for c in names[2:])}")


def replicate_metrics(preds: DataFrame, reps: int = 10000, seed: int = 42) -> DataFrame:
    """Metrics per replicate and model. Each model must score every contest once."""
    ready = written(
        preds.select(
            "id", F.col("fold").cast("string").alias("fold"), "model", F.col("probability").cast("double").alias("probability"), F.col("target").cast("int").alias("target"),
            "prediction",
        ),
        "predictions",
    )
    places = written(fold_positions(ready.select("id", "fold").distinct()), "places")
    made = cut(ready, ["model"], ["probability", "id"], RUN_ROWS)
    runs = made.df if made.large else made.df.withColumn(PIECE, F.lit(0))
    # Missing scores follow each other in groups of places: these in the order in which a shuffle deals them out.
    turn = F.pmod(F.hash("fold", F.floor(F.col("position") / PLACES).cast("long")), F.lit(int(preds.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cells = {c: ((F.col("target") == t) & (F.col("prediction") == p)).cast("int") for c, (t, p) in zip(CELLS, ((0, 0), (0, 1), (1, 0), (1, 1)), strict=True)}
    scored = runs.join(places, ["id", "fold"]).withColumns(cells | {"loss": log_loss_term(), "miss": brier_term(), "turn": turn}).drop("id", "prediction")
    sizes = places.filter(F.col("fold").isNotNull()).groupBy("fold").count().orderBy("fold").collect()  # one row per fold
    ends = np.cumsum([r["count"] for r in sizes]).tolist()
    folds = [(r["fold"], end - r["count"], r["count"]) for r, end in zip(sizes, ends, strict=True)]
    kind = "<u4" if not ends or ends[-1] < 1 << 32 else "<u8"
    packed = written(_packed_runs(scored, {fold: first for fold, first, _ in folds}, kind), "runs")
    total = written(_replicate_sums(packed, folds, reps, seed, kind), "replicates")
    n = F.col("pos") + F.col("neg")
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return with_rates(total).select(
        "rep", "model",
        *[c if c in ("accuracy", "f1") else x.alias(c) for c, x in zip(METRICS, (None, None, F.when(both, F.col("u") / (F.col("pos") * F.col("neg"))), F.col("loss") / n, F.col("miss") / n), strict=True)],
    )


def long_metrics(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value) rows."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return table.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def bootstrap_ci(replicates: DataFrame, original: DataFrame, level: float = 0.95) -> DataFrame:
    """Per model and metric: original value, mean, deviation and percentile bounds.

    A group holds one number per replicate, and replicates are a parameter, not data.
    """
    tail = (1 - level) / 2
    values = long_metrics(replicates, ["model", "rep"])
    summary = values.groupBy("model", "metric").agg(
        F.avg("value").alias("bootstrap_mean"),
        F.stddev_samp("value").alias("bootstrap_std"),
        F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail))).alias("bounds"),
        F.count("value").alias("valid_samples"),
        F.count(F.lit(1)).alias("total_samples"),
    )
    first = long_metrics(original, ["model"]).withColumnRenamed("value", "original_value")
    return summary.join(first, ["model", "metric"]).select(
        "model",
        "metric",
        "original_value",
        "bootstrap_mean",
        "bootstrap_std",
        F.lit(level).alias("ci_level"),
        F.col("bounds")[0].alias("ci_lower"),
        F.col("bounds")[1].alias("ci_upper"),
        "valid_samples",
        "total_samples",
    )


def _differences(table: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """(keys, model_1, model_2, metric, difference), positive where model_1 is better."""
    wide = (
        long_metrics(table, [*keys, "model"])
        .groupBy(*keys, "metric")
        .agg(*[F.max(F.when(F.col("model") == m, F.col("value"))).alias(f"v{i}") for i, m in enumerate(models)])
    )
    sign = F.when(F.col("metric").isin(*[m for m, up in HIGHER_IS_BETTER.items() if up]), 1).otherwise(-1)
    cells = F.array(
        *[
            F.struct(
                F.lit(models[i]).alias("model_1"),
                F.lit(models[j]).alias("model_2"),
                (sign * (F.col(f"v{i}") - F.col(f"v{j}"))).alias("difference"),
            )
            for i in range(len(models))
            for j in range(i + 1, len(models))
        ]
    )
    return wide.select(*keys, "metric", F.explode(cells).alias("c")).select(*keys, "metric", "c.*")


def paired_compare(
    replicates: DataFrame, original: DataFrame, models: list[str], level: float = 0.95
) -> DataFrame:
    """Each pair of the listed models on each metric, in the order they are listed."""
    tail = (1 - level) / 2
    diff = F.col("difference")

    def share(condition: Column) -> Column:
        return F.avg(F.when(diff.isNotNull(), condition.cast("double")))

    summary = (
        _differences(replicates, ["rep"], models)
        .groupBy("model_1", "model_2", "metric")
        .agg(
            F.avg(diff).alias("bootstrap_mean_difference"),
            F.percentile(diff, F.array(F.lit(tail), F.lit(1 - tail))).alias("bounds"),
            share(diff > 0).alias("probability_model_1_better"),
            share(diff < 0).alias("probability_model_2_better"),
            share(diff == 0).alias("probability_tie"),
            F.least(F.lit(1.0), 2 * F.least(share(diff <= 0), share(diff >= 0))).alias("two_sided_tail_p"),
            F.count(diff).alias("valid_samples"),
        )
    )
    first = _differences(original, [], models).withColumnRenamed("difference", "original_difference")
    low, high = F.col("bounds")[0], F.col("bounds")[1]
    direction = (
        F.when(low > 0, F.concat("model_1", F.lit(" better")))
        .when(high < 0, F.concat("model_2", F.lit(" better")))
        .otherwise("uncertain / overlaps zero")
    )
    return summary.join(first, ["model_1", "model_2", "metric"]).select(
        "model_1",
        "model_2",
        "metric",
        "original_difference",
        "bootstrap_mean_difference",
        F.lit(level).alias("ci_level"),
        low.alias("ci_lower"),
        high.alias("ci_upper"),
        ((low > 0) | (high < 0)).alias("ci_excludes_zero"),
        direction.alias("ci_direction"),
        "probability_model_1_better",
        "probability_model_2_better",
        "probability_tie",
        "two_sided_tail_p",
        "valid_samples",
    )
