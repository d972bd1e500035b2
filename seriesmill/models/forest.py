"""A random forest of shallow trees on many rows: MLlib's forest, grown in numpy.

MLlib keeps a number for each row and tree and adds each row to the sums of all trees in turn, so its memory does
not stay in a core's cache. Here rows become bins of one byte, and a task goes through its rows tree by tree. What is drawn and chosen is the
same: bins at quantiles of a sample, rows drawn Poisson(1) times for each tree, features drawn for each node, the split of the
largest gain of Gini impurity, leaves of one class or at the depth asked for, sibling leaves of one class pruned. The draws follow from
seed, rows' place and tree, but are not MLlib's. The result is an MLlib model. Scoring gives the model's numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from seriesmill.session import scratch_table
from seriesmill.sources.tables import written

#: Rows of a task at most, about, as a task sends on the counts of all trees; and rows of a task below which more cores do not help.
TASK_ROWS, LEAST_ROWS = 400_000, 10_000
#: Rows that are drawn from at once: a feature's bins stay in a core's cache.
CHUNK_ROWS = 1 << 16
#: Numbers of a node that come back: counts of the classes, gain, feature's place among those drawn, bin, counts on the left and right.
_NODE = 9


def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """Where a feature can be split: between all values if they are few, else about evenly by rows."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[1:] + found[:-1]) / 2
    if len(middles) < bins:
        return middles
    stride, out = len(values) / bins, []
    below, target = 0, stride
    for i, c in enumerate(counts.tolist()):
        if i and abs(below - target) < abs(below + c - target):
            out.append(middles[i - 1])
            target += stride
        below += c
    return np.array(out[: bins - 1])


def _binned(rows: DataFrame, features: list[str], cuts: list[np.ndarray], bins: int) -> DataFrame:
    """(chunk, rows, body): twice the bin plus the class, in a byte where that holds it; a line of the body for each feature."""
    kind = np.uint8 if bins <= 128 else np.uint16

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, []

        def packed(codes: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"chunk": [chunk], "rows": [codes.shape[1]], "body": pa.array([codes.tobytes()], pa.binary())})

        for batch in batches:
            if any(np.isnan(batch.column(i).to_numpy(zero_copy_only=False)).any() for i in range(len(features))):
                raise ValueError("a feature is not a number")
            target = batch.column(len(features)).to_numpy(zero_copy_only=False).astype(kind)
            held.append(np.stack([np.searchsorted(c, batch.column(i).to_numpy(zero_copy_only=False)).astype(kind) * kind(2) + target for i, c in enumerate(cuts)]))
            while sum(h.shape[1] for h in held) >= CHUNK_ROWS:
                whole = np.concatenate(held, axis=1)
                yield packed(whole[:, :CHUNK_ROWS])
                chunk, held = chunk + 1, [whole[:, CHUNK_ROWS:]]
        whole = np.concatenate(held, axis=1) if held else np.zeros((0, 0), kind)
        if whole.shape[1]:
            yield packed(whole)

    return rows.select(*[f"`{f}`" for f in features], "target").mapInArrow(each, "chunk long, rows long, body binary")


def _drawn(seed: int, chunk: int, tree: int, n: int) -> np.ndarray:
    """Rows of a chunk for a tree: as many as a Poisson number, each any row, so each row comes Poisson(1) times."""
    rng = np.random.Generator(np.random.SFC64([seed, chunk, tree]))
    return rng.integers(0, n, rng.poisson(n), dtype=np.uint32).astype(np.intp)


def _counts(binned: DataFrame, splits: list[tuple[np.ndarray, np.ndarray]], asked: np.ndarray, active: np.ndarray, bins: int, seed: int) -> DataFrame:
    """(tree, counts): of each active node of the level after ``splits``, rows by asked feature, bin and class."""
    kind = np.uint8 if bins <= 128 else np.uint16
    trees, width, some = asked.shape

    def reach(rows: np.ndarray, codes: np.ndarray, tree: int) -> dict[int, np.ndarray]:
        """The rows of each node of the level."""
        nodes = {0: rows}
        for feature, at in splits:
            below = {}
            for node, own in nodes.items():
                if feature[tree, node] >= 0:
                    left = codes[feature[tree, node]].take(own) <= 2 * at[tree, node] + 1
                    below[2 * node], below[2 * node + 1] = own[left], own[~left]
            nodes = below
        return nodes

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = [
            (c, np.frombuffer(body, kind).reshape(-1, n))
            for batch in batches
            for c, n, body in zip(*(batch.column(x).to_pylist() for x in ("chunk", "rows", "body")), strict=True)
        ]
        for tree in np.flatnonzero(active.any(axis=1)).tolist() if chunks else ():
            counts = np.zeros((width, some, 2 * bins), np.uint32)
            for chunk, codes in chunks:
                for node, rows in reach(_drawn(seed, chunk, tree, codes.shape[1]), codes, tree).items():
                    if active[tree, node]:
                        for k, f in enumerate(asked[tree, node].tolist()):
                            counts[node, k] += np.bincount(codes[f].take(rows), minlength=2 * bins).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})

    return binned.mapInArrow(each, "tree int, counts binary")


def _impurity(counts: np.ndarray) -> np.ndarray:
    total = np.maximum(counts.sum(-1), 1)
    return 1 - ((counts / total[..., None]) ** 2).sum(-1)


def best_splits(counts: np.ndarray, cuts: np.ndarray, min_leaf: int) -> np.ndarray:
    """The best split (``_NODE`` numbers) of each node, from its rows by asked feature, bin and class; gain 0 where there is none.

    ``cuts`` has the number of thresholds of each asked feature.
    """
    left = np.cumsum(counts, axis=2, dtype=np.int64)[:, :, :-1]
    total = counts.sum(axis=2, dtype=np.int64)
    right = total[:, :, None] - left
    sizes = [x.sum(-1) for x in (left, right)]
    rows = np.maximum(total.sum(-1), 1)[:, :, None]
    gain = _impurity(total)[:, :, None] - sizes[0] / rows * _impurity(left) - sizes[1] / rows * _impurity(right)
    allowed = (np.minimum(*sizes) >= min_leaf) & (np.arange(left.shape[2]) < cuts[:, :, None])
    gain = np.where(allowed, gain, 0.0)
    best = gain.reshape(len(gain), -1).argmax(axis=1)
    k, at = np.divmod(best, gain.shape[2])
    node = np.arange(len(gain))
    return np.column_stack([total[node, k], gain[node, k, at], k, at, left[node, k, at], right[node, k, at]]).astype(np.float64)


def _best(counted: DataFrame, asked: np.ndarray, cuts: np.ndarray, bins: int, min_leaf: int) -> DataFrame:
    """(tree, nodes): the best split of each node of the level, from the counts of all tasks."""
    shape = (*asked.shape[1:], bins, 2)

    def best(table: pa.Table) -> pa.Table:
        counts = np.zeros(shape, np.int64)
        for body in table.column("counts"):
            counts += np.frombuffer(body.as_buffer(), np.uint32).reshape(shape)
        tree = table.column("tree")[0].as_py()
        found = best_splits(counts, cuts[tree], min_leaf)
        return pa.table({"tree": pa.array([tree], pa.int32()), "nodes": pa.array([found.tobytes()], pa.binary())})

    return counted.groupBy("tree").applyInArrow(best, "tree int, nodes binary")


def _node_rows(tree: int, stats: np.ndarray, gains: np.ndarray, feature: np.ndarray, at: np.ndarray, cuts: list[np.ndarray]) -> list[tuple]:
    """The nodes of a tree as MLlib writes them, numbered from the root downwards, left side first."""
    impurity, winner = _impurity(stats), np.argmax(stats, axis=1)

    def leaf(node: int) -> bool:
        """No split, or one whose both sides are leaves of the same class."""
        if node >= len(feature) or feature[node] < 0:
            return True
        a, b = 2 * node + 1, 2 * node + 2
        return leaf(a) and leaf(b) and winner[a] == winner[b]

    out: list[tuple] = []

    def add(node: int) -> int:
        own, end = len(out), leaf(node)
        out.append(())
        sides = (-1, -1) if end else (add(2 * node + 1), add(2 * node + 2))
        split = (-1, [], -1) if end else (int(feature[node]), [float(cuts[feature[node]][at[node]])], -1)
        out[own] = (
            tree,
            (own, float(winner[node]), float(impurity[node]), stats[node].tolist(), int(stats[node].sum()), -1.0 if end else float(gains[node]), *sides, split),
        )
        return own

    add(0)
    return out


def grow(rows: DataFrame, n: int, features: list[str], classifier: RandomForestClassifier) -> RandomForestClassificationModel:
    """The forest that ``classifier`` asks for, on ``n`` rows of double features and a ``target`` of 0 or 1."""
    spark = rows.sparkSession
    trees, depth, bins, seed = (classifier.getOrDefault(p) for p in ("numTrees", "maxDepth", "maxBins", "seed"))
    some, min_leaf = int(classifier.getFeatureSubsetStrategy()), classifier.getMinInstancesPerNode()
    cores = spark.sparkContext.defaultParallelism
    rows = written(rows.select(*[F.col(f"`{f}`") for f in features], "target").repartition(max(-(-n // TASK_ROWS), min(2 * cores, -(-n // LEAST_ROWS)))), "forest-rows")
    needed = max(bins * bins, 10_000)  # what MLlib samples for the bins
    sample = (rows if n <= needed else rows.sample(needed / n, seed)).drop("target").toArrow()
    cuts = [thresholds(sample.column(i).to_numpy(), bins) for i in range(len(features))]
    binned = written(_binned(rows, features, cuts, bins), "forest-bins")
    many = np.array([len(c) for c in cuts])
    rng = np.random.default_rng(seed)
    nodes = 2 ** (depth + 1) - 1
    stats, gains = np.zeros((trees, nodes, 2)), np.zeros((trees, nodes))
    feature, at = np.full((trees, nodes), -1), np.zeros((trees, nodes), int)
    active = np.ones((trees, 1), bool)
    for level in range(depth):
        width = 2**level
        asked = rng.random((trees, width, len(features))).argsort(axis=2)[:, :, :some]
        done = [(feature[:, 2**k - 1 : 2 ** (k + 1) - 1], at[:, 2**k - 1 : 2 ** (k + 1) - 1]) for k in range(level)]
        counted = _counts(binned, done, asked, active, bins, seed)
        below = np.zeros((trees, 2 * width), bool)
        for row in _best(counted, asked, many[asked], bins, min_leaf).collect():  # one row per tree
            t, found = row["tree"], np.frombuffer(row["nodes"]).reshape(width, _NODE)
            for k in np.flatnonzero(active[t]).tolist():
                node = width - 1 + k
                stats[t, node] = found[k, :2]
                if found[k, 2] > 0:
                    gains[t, node], feature[t, node], at[t, node] = found[k, 2], asked[t, k, int(found[k, 3])], int(found[k, 4])
                    for side in (0, 1):
                        own = found[k, 5 + 2 * side : 7 + 2 * side]
                        stats[t, 2 * node + 1 + side] = own
                        below[t, 2 * k + side] = own.min() > 0
        active = below
        if not active.any():
            break
    return _model(rows.sparkSession, classifier, len(features), [r for t in range(trees) for r in _node_rows(t, stats[t], gains[t], feature[t], at[t], cuts)])


def _model(spark, classifier: RandomForestClassifier, features: int, nodes: list[tuple]) -> RandomForestClassificationModel:
    """An MLlib model of these nodes: written as MLlib writes one, by way of a forest on two rows."""
    path = scratch_table(spark, "forest")
    two = [(Vectors.dense([float(y)] * features), float(y)) for y in (0, 1)]
    names = [classifier.getFeaturesCol(), classifier.getLabelCol()]
    classifier.fit(spark.createDataFrame(two, names).coalesce(1)).write().save(path)
    data = f"{path}/data"
    schema = spark.read.parquet(data).schema
    spark.createDataFrame(nodes, schema).coalesce(1).write.mode("overwrite").parquet(data)
    return RandomForestClassificationModel.load(path)


# --- scoring ------------------------------------------------------------------------------


def saved_nodes(spark, path: str) -> list[list[dict]]:
    """The nodes of each tree of a model written at ``path``, in the order of their numbers."""
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").toArrow().to_pylist()
    out: dict[int, list[dict]] = {}
    for row in sorted(rows, key=lambda r: (r["treeID"], r["id"])):
        out.setdefault(row["treeID"], []).append(row)
    return [out[t] for t in sorted(out)]


def scored(rows: DataFrame, features: list[str], keep: list[str], trees: list[list[dict]]) -> DataFrame:
    """``keep``, target and the probability of class 1: the number MLlib's model gives, for whole batches tree by tree.

    A row's features become places among the thresholds of all trees, and a tree is a choice between leaves for all rows at once.
    """
    splits = [(n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]) for nodes in trees for n in nodes if n["leftChild"] >= 0]
    cuts = [np.unique([at for f, at in splits if f == i]) for i in range(len(features))]
    code = np.min_scalar_type(max(map(len, cuts), default=0))
    compact = []
    for nodes in trees:
        shares: list[list[float]] = []

        def choice(n: dict, nodes: list[dict] = nodes, shares: list[list[float]] = shares) -> tuple | np.integer:
            if n["leftChild"] < 0:
                total = sum(n["impurityStats"])
                shares.append([x / total if total else 0.0 for x in n["impurityStats"]])
                return np.min_scalar_type(len(nodes)).type(len(shares) - 1)
            f, at = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
            return f, int(np.searchsorted(cuts[f], at)), choice(nodes[n["leftChild"]]), choice(nodes[n["rightChild"]])

        compact.append((choice(nodes[0]), shares))

    def leaf(node: tuple | np.integer, codes: list[np.ndarray]) -> np.ndarray | np.integer:
        if not isinstance(node, tuple):
            return node
        f, at, left, right = node
        return np.where(codes[f] <= at, leaf(left, codes), leaf(right, codes))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(root, np.array(shares).T.copy()) for root, shares in compact]
        for batch in batches:
            first = batch.num_columns - len(features)
            if any(np.isnan(batch.column(first + i).to_numpy(zero_copy_only=False)).any() for i in range(len(features))):
                raise ValueError("a feature is not a number")
            codes = [np.searchsorted(c, batch.column(first + i).to_numpy(zero_copy_only=False)).astype(code) for i, c in enumerate(cuts)]
            votes = np.zeros((2, batch.num_rows))
            for root, shares in tables:
                at = leaf(root, codes)
                for k in (0, 1):
                    votes[k] += shares[k].take(at)
            probability = pa.array(votes[1] / (votes[0] + votes[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:first], probability], [*batch.schema.names[:first], "probability"])

    ready = rows.select(*keep, F.col("target").cast("int").alias("target"), *[F.col(f"`{f}`").alias(f"__feature{i}") for i, f in enumerate(features)])
    schema = StructType([*ready.schema.fields[: len(keep) + 1], StructField("probability", DoubleType())])
    return ready.mapInArrow(each, schema)
