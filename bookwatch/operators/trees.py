"""Forests and boosted trees of large tables, on blocks of binned rows.

Spark's learners keep for each row a count for every tree, a node number for every
tree and the row's bins as whole numbers: some 2 kB a row for 200 trees. Here a row is
a byte a feature. A pass over the blocks (one task a core, NumPy in the tasks) sums the
classes or the gradients by node, feature and bin; sums are added up over the cluster
and give the splits of one more level of all trees. Bootstrap counts and subsamples are
drawn again from the block's number in each pass, rows find their node by walking the
trees, so nothing is kept a row and tree.

Bins, impurities, gains, minimum rows, pruning of alike leaves, the first boosted tree
(on the labels) and the shrunken others are those of ``pyspark.ml``; without drawing
(no bootstrap, no subsample, all features) the trees are the same. Results are
``pyspark.ml`` models: they score, save and load like any other."""

from __future__ import annotations

import json
import math
import sys
import time
import uuid
from collections.abc import Iterable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext, cloudpickle
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

#: Rows of a block; rows from which the borders of the bins are taken (as in Spark, at least).
BLOCK_ROWS, SPLIT_ROWS = 1 << 15, 10_000
#: Sums that a task holds at most for the trees of a pass; bits of a packed column of bins.
SUMS, BITS = 8_000_000, 10
#: Blocks are bytes already; to store them serialised would pack them twice.
KEPT = StorageLevel.MEMORY_AND_DISK_DESER
#: Rounds after which the boosted rows are written, and lineage begins anew.
ROUNDS_KEPT = 20


# --------------------------------------------------------------------------- bins
def borders(values: np.ndarray, weights: np.ndarray, max_bins: int) -> np.ndarray:
    """The borders between bins of one feature: midpoints of neighbouring distinct
    values, all of them or those nearest to equal shares of the weight."""
    distinct, at = np.unique(values, return_inverse=True)
    distinct_weights = np.bincount(at, weights=weights)
    keep = ~np.isnan(distinct)
    distinct, distinct_weights = distinct[keep], distinct_weights[keep]
    if len(distinct) <= max_bins:
        return (distinct[1:] + distinct[:-1]) / 2
    found, stride = [], distinct_weights.sum() / max_bins
    target, count = stride, distinct_weights[0]
    for i in range(1, len(distinct)):
        before, count = count, count + distinct_weights[i]
        if abs(before - target) < abs(count - target):
            found.append((distinct[i - 1] + distinct[i]) / 2)
            target += stride
    return np.array(found[:max_bins - 1])


def find_borders(matrix: DataFrame, rows: int, label: str, weights: dict, max_bins: int, seed: int) -> list[np.ndarray]:
    """Borders of all features, from about ``SPLIT_ROWS`` rows as Spark's learners take them."""
    wanted = max(SPLIT_ROWS, max_bins * max_bins)
    some = matrix if rows <= wanted else matrix.sample(wanted / rows, seed)
    got = some.select(vector_to_array("features").alias("x"), F.col(label).cast("int").alias("y")).collect()
    x, w = np.array([r["x"] for r in got], float), np.array([weights[r["y"]] for r in got], float)
    return [borders(x[:, j], w, max_bins) for j in range(x.shape[1])]


def binned(matrix: DataFrame, label: str, edges: list[np.ndarray]) -> RDD:
    """Blocks ``(number, bins, labels)`` of the rows, dealt over all cores and kept:
    a byte a feature, row by row."""
    n, parts = len(edges), matrix.sparkSession.sparkContext.defaultParallelism

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, labels, size, done = [], [], 0, 0

        def block() -> pa.RecordBatch:
            # the number follows the written table's partitions, so a task that is run again draws alike
            number = (TaskContext.get().partitionId() << 24) + done
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([b"".join(held)], pa.binary()),
                                               pa.array([b"".join(labels)], pa.binary())], ["number", "bins", "labels"])
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            codes = np.empty(x.shape, np.uint8)
            for j, e in enumerate(edges):
                codes[:, j] = x[:, j] > e[0] if len(e) == 1 and not np.isnan(x[:, j]).any() else np.searchsorted(e, x[:, j])
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            for at in range(0, len(y), BLOCK_ROWS):
                held.append(codes[at:at + BLOCK_ROWS].tobytes())
                labels.append(y[at:at + BLOCK_ROWS].tobytes())
                size += len(labels[-1])
                if size >= BLOCK_ROWS:
                    yield block()
                    held, labels, size, done = [], [], 0, done + 1
        if size:
            yield block()

    made = matrix.select(vector_to_array("features"), F.col(label).cast("int")).mapInArrow(
        blocks, "number long, bins binary, labels binary")
    return (made.repartition(parts).rdd
            .map(lambda r: (r[0], np.frombuffer(bytes(r[1]), np.uint8).reshape(-1, n), np.frombuffer(bytes(r[2]), np.uint8)))
            .persist(KEPT))


def subset_size(strategy: str, n: int) -> int:
    """Features tried at a node."""
    return n if strategy == "all" else math.ceil(math.sqrt(n)) if strategy == "sqrt" else math.ceil(float(strategy) * n)


def subsets(rng: np.random.Generator, nodes: int, n: int, k: int) -> np.ndarray:
    """``k`` of ``n`` features for each node, in rising order."""
    if k >= n:
        return np.tile(np.arange(n), (nodes, 1))
    return np.sort(np.argpartition(rng.random((nodes, n)), k, axis=1)[:, :k], axis=1)


# --------------------------------------------------------------------------- forest
def _poisson(rate: float) -> np.ndarray:
    p, out = math.exp(-rate), []
    while not out or out[-1] < 1 - 1e-16 and len(out) < 200:
        out.append((out[-1] if out else 0.0) + p)
        p *= rate / len(out)
    return np.array(out)


def draws(seed: int, tree: int, number: int, rows: int, rate: float | None) -> np.ndarray:
    """How often each row of a block is in a tree's bootstrap sample."""
    if rate is None:
        return np.ones(rows, np.uint8)
    u, counts = np.random.default_rng([seed, tree, number]).random(rows), np.zeros(rows, np.uint8)
    for q in _poisson(rate):
        if not (above := u >= q).any():
            break
        counts += above
    return counts


def _level(table: np.ndarray, level: int, open_: np.ndarray, features: np.ndarray, sizes: np.ndarray) -> SimpleNamespace:
    """What a pass needs of one tree: the splits so far, the open nodes of the level,
    their features and where the sums of each begin."""
    slot = np.full(1 << level, -1, np.intp)
    slot[open_] = np.arange(len(open_))
    n = 2 * sizes[features]
    ends = np.cumsum(n.ravel()).reshape(n.shape)
    return SimpleNamespace(table=table, level=level, features=features, slot=slot, starts=ends - n, size=int(ends[-1, -1]))


def _class_sums(blocks: Iterable, levels: dict[int, SimpleNamespace], seed: int, rate: float | None) -> Iterator:
    """Sampled rows of each class by open node, feature and bin, for each tree."""
    sums = {t: np.zeros(p.size, np.int64) for t, p in levels.items()}
    for number, bins, labels in blocks:
        width = bins.shape[1]
        flat = (bins * np.uint8(2) + labels[:, None]).ravel()  # bin and class in one code
        for t, p in levels.items():
            counts = draws(seed, t, number, len(labels), rate)
            rows = np.flatnonzero(counts)
            base, node = rows * width, np.zeros(len(rows), np.intp)
            for _ in range(p.level):
                split = p.table.take(node)
                node = 2 * node + 1 + (flat.take(base + (split >> 8)) > (split & 255))
            slot = p.slot.take(node - (p.slot.size - 1))
            live = np.flatnonzero(slot >= 0)
            if len(live) < len(slot):
                slot, base, rows = slot[live], base[live], rows[live]
            if not len(slot):
                continue
            at = p.features.take(slot, axis=0)
            at += base[:, None]
            at = p.starts.take(slot, axis=0) + flat.take(at)
            got = np.bincount(at.ravel(), np.repeat(counts[rows].astype(float), at.shape[1]), p.size)
            sums[t] += got.astype(np.int64)
    for t, s in sums.items():
        yield t, s.astype(np.uint32) if s.max(initial=0) < 2**31 else s


def _wider(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) + b


def _gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, 1 - (a / total) ** 2 - (b / total) ** 2, 0.0)


def _class_splits(sums: np.ndarray, p: SimpleNamespace, sizes: np.ndarray, weights: tuple, min_rows: int) -> tuple:
    """For each open node: its classes' counts, and the best split's feature, last
    bin on the left, gain and left counts; gain is not above 0 where there is none."""
    padded, most, found = np.append(sums, [0, 0]), int(sizes.max()), []
    for some in range(0, len(p.features), 256):
        features, starts = p.features[some:some + 256], p.starts[some:some + 256]
        last = sizes[features][:, :, None] - 1
        bins = np.arange(most)
        at = np.where(bins <= last, starts[:, :, None] + 2 * bins, len(sums))
        left = [np.cumsum(padded[at + c], axis=2) for c in (0, 1)]
        total = [x[:, :1, -1:] for x in left]
        right = [t - x for t, x in zip(total, left)]
        wl, wr = [[w * x for w, x in zip(weights, side)] for side in (left, right)]
        wt = [w * x for w, x in zip(weights, total)]
        whole = np.maximum(wt[0] + wt[1], 1e-300)
        gain = _gini(*wt) - (wl[0] + wl[1]) / whole * _gini(*wl) - (wr[0] + wr[1]) / whole * _gini(*wr)
        allowed = (bins < last) & (left[0] + left[1] >= min_rows) & (right[0] + right[1] >= min_rows)
        gain = np.where(allowed, gain, -1.0).reshape(len(features), -1)
        best, each = gain.argmax(axis=1), np.arange(len(features))
        k, b = best // most, best % most
        found.append((total[0][:, 0, 0], total[1][:, 0, 0], features[each, k], b, gain[each, best],
                      left[0][each, k, b], left[1][each, k, b]))
    return tuple(np.concatenate(x) for x in zip(*found))


def fit_forest(spark: SparkSession, blocks: RDD, est: RandomForestClassifier, edges: list[np.ndarray],
               weights: dict) -> RandomForestClassificationModel:
    """The forest of ``est`` on binned rows, level by level for all trees, as many
    trees a pass as their sums fit in a task."""
    sc, n, trees, depth = blocks.context, len(edges), est.getNumTrees(), est.getMaxDepth()
    sizes, seed, least = np.array([len(e) + 1 for e in edges]), est.getSeed(), est.getMinInstancesPerNode()
    rate = est.getSubsamplingRate() if est.getBootstrap() and trees > 1 else None
    if not est.getBootstrap() and est.getSubsamplingRate() < 1:
        raise ValueError("a forest without bootstrap takes all rows")
    k, w = subset_size(est.getFeatureSubsetStrategy(), n), (weights[0], weights[1])
    nodes = (1 << depth + 1) - 1
    feature, border = np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes), np.int32)
    gain, counts = np.zeros((trees, nodes)), np.zeros((trees, nodes, 2), np.int64)
    open_ = {t: np.zeros(1, np.intp) for t in range(trees)}
    tasks = blocks.getNumPartitions()
    for level in range(depth):
        rngs = {t: np.random.default_rng([seed, t, level, 7]) for t in open_}
        tables = {t: np.where(feature[t] >= 0, feature[t] * 256 + 2 * border[t] + 1, 255).astype(np.intp)[:(1 << level) - 1 or 1]
                  for t in open_}
        plans = {t: _level(tables[t], level, o, subsets(rngs[t], len(o), n, k), sizes) for t, o in open_.items()}
        groups, held = [{}], 0
        for t, p in plans.items():
            if held and held + p.size > SUMS:
                groups, held = [*groups, {}], 0
            groups[-1][t] = p
            held += p.size
        first, open_ = (1 << level) - 1, {}
        for group in groups:
            shared = sc.broadcast(group)
            found = (blocks.mapPartitions(lambda b, shared=shared: _class_sums(b, shared.value, seed, rate))
                     .reduceByKey(_wider, min(tasks, len(group)))
                     .map(lambda x, shared=shared: (x[0], _class_splits(x[1], shared.value[x[0]], sizes, w, least))).collect())
            shared.destroy()
            for t, (n0, n1, f, b, g, l0, l1) in found:
                at = first + np.flatnonzero(group[t].slot >= 0)
                counts[t, at, 0], counts[t, at, 1] = n0, n1
                split = g > 0
                at, b, l0, l1 = at[split], b[split], l0[split], l1[split]
                feature[t, at], border[t, at], gain[t, at] = f[split], b, g[split]
                counts[t, 2 * at + 1] = np.stack([l0, l1], axis=1)
                counts[t, 2 * at + 2] = counts[t, at] - counts[t, 2 * at + 1]
                below = np.sort(np.concatenate([2 * at + 1, 2 * at + 2]))
                c = counts[t, below]
                below = below[(c.min(axis=1) > 0) & (c.sum(axis=1) >= 2 * least)]  # the others have no split
                if len(below):
                    open_[t] = below - (2 * first + 1)
        if not open_:
            break
    weighted = counts * np.array(w)
    whole = np.maximum(weighted.sum(axis=2), 1e-300)
    return _model(spark, est, RandomForestClassificationModel, edges, feature, border, gain, weighted,
                  (weighted[:, :, 1] > weighted[:, :, 0]).astype(float), 1 - ((weighted / whole[:, :, None]) ** 2).sum(axis=2),
                  counts.sum(axis=2), [1.0] * trees)


# --------------------------------------------------------------------------- boosted trees
def packed_columns(sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Features packed in columns of ``BITS`` bits: (feature, first bit, bits)."""
    columns: list[list] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        bits = max(1, int(sizes[f] - 1).bit_length())
        for column in columns:
            if sum(x[2] for x in column) + bits <= BITS:
                column.append((f, sum(x[2] for x in column), bits))
                break
        else:
            columns.append([(f, 0, bits)])
    return columns


def _packed(block: tuple, columns: list, models: int) -> tuple:
    number, bins, labels = block
    out = np.zeros((len(columns), len(labels)), np.uint16)
    for packed, column in zip(out, columns):
        for f, first, _ in column:
            packed |= bins[:, f].astype(np.uint16) << np.uint16(first)
    return number, out, labels, np.zeros((models, len(labels)))


def _nodes(packed: np.ndarray, splits: tuple[dict, ...]) -> np.ndarray:
    """The node of each row in the last level, by the splits of each level:
    node -> (column, first bit, bits, last bin on the left). Rows of a leaf go left."""
    node = np.zeros(packed.shape[1], np.uint8)
    for level in splits:
        right = np.zeros(len(node), bool)
        for at, (column, first, bits, border) in level.items():
            code = (packed[column] >> np.uint16(first)) & np.uint16((1 << bits) - 1)
            right |= (code > border) & (node == at)
        node = node * np.uint8(2) + right
    return node


def _target(labels: np.ndarray, margin: np.ndarray, round_: int) -> np.ndarray:
    """What a round's tree is fitted to: the labels, then the negative gradient of the log loss."""
    sign = labels * 2.0 - 1.0
    return sign if round_ == 0 else 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))


def _sampled(number: int, labels: np.ndarray, round_: int, seed: int, rate: float, weights: np.ndarray) -> np.ndarray:
    w = weights.take(labels)
    return w if rate >= 1 else w * (np.random.default_rng([seed, round_, number]).random(len(labels)) < rate)


def _moved(block: tuple, last: list[tuple]) -> tuple:
    number, packed, labels, margins = block
    return number, packed, labels, np.stack([m + steps.take(_nodes(packed, splits)) for m, (splits, steps) in zip(margins, last)])


def _gradient_sums(blocks: Iterable, columns: list, n: int, most: int, splits: list[tuple], round_: int, seed: int,
                   rate: float, weights: list[np.ndarray]) -> Iterator:
    """Weights and weighted targets by model, feature, node of the level and bin."""
    open_ = 1 << len(splits[0])
    sums = np.zeros((len(splits), 2, len(columns), open_ << BITS))
    for number, packed, labels, margins in blocks:
        for one, own, margin, weight in zip(sums, splits, margins, weights):
            w = _sampled(number, labels, round_, seed, rate, weight)
            wr = w * _target(labels, margin, round_)
            node = _nodes(packed, own).astype(np.intp) << BITS
            for c, codes in enumerate(packed):
                at = node + codes
                one[0, c] += np.bincount(at, w, open_ << BITS)
                one[1, c] += np.bincount(at, wr, open_ << BITS)
    out = np.zeros((len(splits), 2, n, open_, most))
    for c, column in enumerate(columns):
        for f, first, bits in column:
            one = sums[:, :, c].reshape(-1, 2, open_, 1 << (BITS - first - bits), 1 << bits, 1 << first).sum(axis=(3, 5))
            out[:, :, f, :, :min(most, 1 << bits)] = one[:, :, :, :most]
    yield out


def _leaf_sums(block: tuple, last: list[tuple], round_: int, seed: int, rate: float, weights: list[np.ndarray]) -> np.ndarray:
    """Rows, weights, weighted targets and squares by model and node of the lowest level,
    for trees whose steps the margins already have."""
    number, packed, labels, margins = block
    out = []
    for (splits, steps), margin, weight in zip(last, margins, weights):
        node = _nodes(packed, splits)
        w = _sampled(number, labels, round_, seed, rate, weight)
        r = _target(labels, margin - steps.take(node), round_)
        out.append([np.bincount(node, x, len(steps)) for x in (w > 0, w, w * r, w * r * r)])
    return np.array(out)


def _first_sums(blocks: Iterable, last: list[tuple], *rest) -> Iterator:
    """The sums that begin a round, and the leaf sums of the round before."""
    round_, seed, rate, weights = rest[-4:]
    leaves = np.zeros((len(last), 4, len(last[0][1])))

    def noted() -> Iterator:
        for block in blocks:
            leaves[:] += _leaf_sums(block, last, round_ - 1, seed, rate, weights)
            yield block
    sums = next(_gradient_sums(noted(), *rest))
    yield np.append(sums.ravel(), leaves.ravel())


def _gradient_splits(sums: np.ndarray, sizes: np.ndarray, tried: np.ndarray) -> tuple:
    """For each node the best split: feature, last bin on the left, gain, and the
    (weight, weighted target) of the node and of its left side."""
    left = np.cumsum(sums, axis=3)
    right = np.cumsum(sums[:, :, :, ::-1], axis=3)[:, :, :, ::-1] - sums
    total = left[:, :1, :, -1:]
    square = lambda x: np.where(x[0] > 0, x[1] ** 2 / np.where(x[0] > 0, x[0], 1), 0.0)
    gain = (square(left) + square(right) - square(total)) / np.where(total[0] > 0, total[0], 1)
    allowed = (np.arange(sums.shape[3]) < sizes[:, None, None] - 1) & (left[0] > 0) & (right[0] > 0) & tried.T[:, :, None]
    gain = np.where(allowed, gain, -1.0).transpose(1, 0, 2).reshape(sums.shape[2], -1)
    best, each = gain.argmax(axis=1), np.arange(sums.shape[2])
    f, b = best // sums.shape[3], best % sums.shape[3]
    return f, b, gain[each, best], total[:, 0, :, 0], left[:, f, each, b]


def _added(rdd: RDD) -> np.ndarray:
    """The sum of the tasks' arrays, on the driver; of many tasks, within the cluster first."""
    return rdd.reduce(np.add) if rdd.getNumPartitions() <= 64 else rdd.treeReduce(np.add)


def _drop(rdd: RDD) -> None:
    """An RDD's kept and written blocks, when a later one has taken its place."""
    rdd.unpersist()
    if path := rdd.getCheckpointFile():
        jvm, conf = rdd.context._jvm, rdd.context._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(conf).delete(path, True)


def fit_boosted(spark: SparkSession, blocks: RDD, ests: list[GBTClassifier], edges: list[np.ndarray],
                weights: list[dict]) -> list[GBTClassificationModel]:
    """The boosted trees of each of ``ests``, which differ in the weights of their classes
    alone, on binned rows; a pass serves them all. Bins are packed into a few columns
    of whole numbers, whose sums give those of each feature. Rows carry their margins;
    they are moved by a tree's steps in the pass that begins the next tree."""
    ensure_checkpoint_dir(spark)  # where the rows are written now and then
    est, n, count, models = ests[0], len(edges), len(ests), range(len(ests))
    rounds, depth, seed, rate = est.getMaxIter(), est.getMaxDepth(), est.getSeed(), est.getSubsamplingRate()
    sizes = np.array([len(e) + 1 for e in edges])
    k, w, most = subset_size(est.getFeatureSubsetStrategy(), n), [np.array([x[0], x[1]], float) for x in weights], int(sizes.max())
    columns = packed_columns(sizes)
    place = {f: (c, first, bits) for c, column in enumerate(columns) for f, first, bits in column}
    shape, lowest = (count, rounds, (1 << depth + 1) - 1), 1 << depth
    feature, border = np.full(shape, -1, np.int32), np.zeros(shape, np.int32)
    gain, stats, predicted = np.zeros(shape), np.zeros((*shape, 4)), np.zeros(shape)
    rate_of = [1.0] + [est.getStepSize()] * (rounds - 1)
    rows = blocks.map(lambda b: _packed(b, columns, count)).persist(KEPT)

    def leaf_stats(round_: int, sums: np.ndarray) -> None:
        stats[:, round_, lowest - 1:] = sums.transpose(0, 2, 1)
        for at in range(lowest - 2, -1, -1):
            stats[:, round_, at] = stats[:, round_, 2 * at + 1] + stats[:, round_, 2 * at + 2]

    def split(i: int, m: int, level: int, sums: np.ndarray, tried: np.ndarray) -> dict:
        """The splits of one model's level, for the walk of the rows."""
        first, found = (1 << level) - 1, {}
        f, b, g, total, left = _gradient_splits(sums, sizes, tried)
        for at in range(1 << level):
            if level == 0:
                predicted[i, m, 0] = total[1, 0] / total[0, 0] if total[0, 0] else 0.0
            elif feature[i, m, (first + at - 1) // 2] < 0:
                continue  # below a leaf
            if g[at] <= np.finfo(float).eps:
                continue
            feature[i, m, first + at], border[i, m, first + at], gain[i, m, first + at] = f[at], b[at], g[at]
            found[at] = (*place[f[at]], b[at])
            right = total[:, at] - left[:, at]
            below = 2 * (first + at) + 1
            predicted[i, m, below], predicted[i, m, below + 1] = left[1, at] / left[0, at], right[1] / right[0]
        return found

    last: list[tuple] = []
    for m in range(rounds):
        splits: list[tuple] = [() for _ in models]
        for level in range(depth):
            width = 1 << level
            tried = np.zeros((width, n), bool)
            np.put_along_axis(tried, subsets(np.random.default_rng([seed, m, level, 7]), width, n, k), True, axis=1)
            args = (columns, n, most, splits, m, seed, rate, w)
            if level == 0 and m:
                both = _added(rows.mapPartitions(lambda b, last=last, args=args: _first_sums(b, last, *args)))
                sums = both[:-4 * lowest * count].reshape(count, 2, n, 1, most)
                leaf_stats(m - 1, both[-4 * lowest * count:].reshape(count, 4, lowest))
                _drop(before)
            else:
                sums = _added(rows.mapPartitions(lambda b, args=args: _gradient_sums(b, *args)))
            splits = [(*splits[i], split(i, m, level, sums[i], tried)) for i in models]
            if not any(s[-1] for s in splits):
                splits = [s + ({},) * (depth - level - 1) for s in splits]
                break
        last = [(splits[i], _lowest(feature[i, m], predicted[i, m], depth) * rate_of[m]) for i in models]
        before, rows = rows, rows.map(lambda b, last=last: _moved(b, last)).persist(KEPT)
        if m % ROUNDS_KEPT == ROUNDS_KEPT - 1:
            rows.checkpoint()
    leaf_stats(rounds - 1, _added(rows.map(lambda b: _leaf_sums(b, last, rounds - 1, seed, rate, w))))
    _drop(before)
    _drop(rows)
    whole = np.maximum(stats[..., 1], 1e-300)
    impurity = np.maximum(stats[..., 3] - stats[..., 2] ** 2 / whole, 0) / whole
    return [_model(spark, ests[i], GBTClassificationModel, edges, feature[i], border[i], gain[i], stats[i, ..., 1:],
                   predicted[i], impurity[i], stats[i, ..., 0].astype(np.int64), rate_of) for i in models]


def _lowest(feature: np.ndarray, predicted: np.ndarray, depth: int) -> np.ndarray:
    """The prediction of the rows that come out at each place of the lowest level,
    where rows of a leaf go left."""
    out = predicted.copy()
    for at in range((1 << depth) - 1):
        if feature[at] < 0:
            out[2 * at + 1] = out[2 * at + 2] = out[at]
    return out[(1 << depth) - 1:]


# --------------------------------------------------------------------------- models
_TREE_PARAMS = ("cacheNodeIds", "checkpointInterval", "featuresCol", "labelCol", "maxBins", "maxDepth", "maxMemoryInMB",
                "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed", "weightCol")


def _nodes_of(feature: np.ndarray, predicted: np.ndarray) -> tuple:
    """Places (in heap order) of a tree's nodes in depth-first order, their left and
    right children's numbers (-1: a leaf). Splits into leaves of one prediction are undone."""
    inner = feature >= 0
    size = np.ones(len(feature), np.int64)
    for at in range(len(feature) // 2 - 1, -1, -1):
        if inner[at]:
            a, b = 2 * at + 1, 2 * at + 2
            if not inner[a] and not inner[b] and predicted[a] == predicted[b]:
                inner[at] = False
            else:
                size[at] = 1 + size[a] + size[b]
    number = np.zeros(len(feature), np.int64)
    reached = np.zeros(len(feature), bool)
    reached[0] = True
    for at in np.flatnonzero(inner):
        if reached[at]:
            reached[2 * at + 1] = reached[2 * at + 2] = True
            number[2 * at + 1], number[2 * at + 2] = number[at] + 1, number[at] + 1 + size[2 * at + 1]
    places = np.flatnonzero(reached)
    places = places[np.argsort(number[places])]
    is_inner = inner[places]
    child = lambda k: np.where(is_inner, number[np.minimum(2 * places + k, len(feature) - 1)], -1)
    return places, child(1), child(2)


def _model(spark: SparkSession, est, kind, edges: list, feature: np.ndarray, border: np.ndarray, gain: np.ndarray, stats: np.ndarray,
           predicted: np.ndarray, impurity: np.ndarray, raw: np.ndarray, tree_weights: list):
    """The trees as a ``pyspark.ml`` model, through the format that its reader takes."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees/{uuid.uuid4().hex}"
    forest = kind is RandomForestClassificationModel
    set_ = {p.name: v for p, v in est._paramMap.items()}
    default = {p.name: v for p, v in est._defaultParamMap.items()}
    own = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    meta = own | {"class": f"org.apache.spark.ml.classification.{kind.__name__}", "uid": est.uid, "paramMap": set_,
                  "defaultParamMap": default, "numFeatures": len(edges), "numTrees": len(feature)}
    tree = own | {"class": "org.apache.spark.ml.classification.DecisionTreeClassificationModel" if forest
                  else "org.apache.spark.ml.regression.DecisionTreeRegressionModel",
                  "paramMap": {k: v for k, v in set_.items() if k in _TREE_PARAMS},
                  "defaultParamMap": {k: v for k, v in default.items() if k in _TREE_PARAMS}
                  | {"impurity": est.getImpurity() if forest else "variance"}}
    if forest:
        meta["numClasses"] = 2
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(t, json.dumps(tree | {"uid": f"{'dtc' if forest else 'dtr'}_{uuid.uuid4().hex[:12]}"}), w)
                           for t, w in enumerate(tree_weights)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(
        f"{path}/treesMetadata")
    tables = []
    for t in range(len(feature)):
        at, left, right = _nodes_of(feature[t], predicted[t])
        inner = left >= 0
        f, b = np.where(inner, feature[t, at], -1), border[t, at]
        cut = np.array([edges[i][j] for i, j in zip(f[inner], b[inner])], float)
        lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.float64()))
        split = pa.StructArray.from_arrays(
            [pa.array(f, pa.int32()), lists(cut, np.append(0, np.cumsum(inner))), pa.array(np.full(len(at), -1), pa.int32())],
            ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
        width = stats.shape[2]
        data = pa.StructArray.from_arrays(
            [pa.array(np.arange(len(at)), pa.int32()), pa.array(predicted[t, at]), pa.array(impurity[t, at]),
             lists(stats[t, at].ravel().astype(float), np.arange(len(at) + 1) * width), pa.array(raw[t, at], pa.int64()),
             pa.array(np.where(inner, gain[t, at], -1.0)), pa.array(left, pa.int32()), pa.array(right, pa.int32()), split],
            ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
        tables.append(pa.Table.from_arrays([pa.array(np.full(len(at), t), pa.int32()), data], ["treeID", "nodeData"]))
    spark.createDataFrame(pa.concat_tables(tables)).write.parquet(f"{path}/data")
    return kind.load(path)


# --------------------------------------------------------------------------- scores
def forest_table(spark: SparkSession, model: RandomForestClassificationModel) -> list[tuple]:
    """The nodes of each tree, by number: feature, threshold, children (left and right
    of a node side by side; a leaf is its own), each class's share, and the tree's depth.
    A split of a 0/1 attribute by its values is one at a half."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees/{uuid.uuid4().hex}"
    model.write().save(path)
    n = F.col("nodeData")
    cut, kinds = n["split"]["leftCategoriesOrThreshold"], n["split"]["numCategories"]
    got = spark.read.parquet(f"{path}/data").select(
        "treeID", n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), F.when(kinds < 0, F.get(cut, F.lit(0))).otherwise(0.5).alias("threshold"),
        (F.when(kinds >= 0, ~F.array_contains(cut, 0.0)).otherwise(False)).alias("swapped"), kinds.alias("kinds"),
        n["impurityStats"][0].alias("n0"), n["impurityStats"][1].alias("n1")).toArrow().sort_by(
        [("treeID", "ascending"), ("id", "ascending")])
    c = {k: got[k].to_numpy() for k in got.column_names}
    if (c["kinds"] > 2).any():
        raise ValueError("splits of more than two categories have no threshold")
    c["left"], c["right"] = (np.where(c["swapped"], c[a], c[b]) for a, b in (("right", "left"), ("left", "right")))
    tables = []
    for one in np.split(np.arange(got.num_rows), np.flatnonzero(np.diff(c["treeID"])) + 1):
        left, right, total = c["left"][one], c["right"][one], c["n0"][one] + c["n1"][one]
        leaf, at = left < 0, np.arange(len(one))
        kids = np.stack([np.where(leaf, at, left), np.where(leaf, at, right)], axis=1).ravel().astype(np.intp)
        depth = np.zeros(len(one), int)
        for i in np.flatnonzero(~leaf):
            depth[left[i]] = depth[right[i]] = depth[i] + 1
        share = [np.divide(c[k][one], total, out=np.zeros(len(one)), where=total != 0) for k in ("n0", "n1")]
        tables.append((np.where(leaf, 0, c["feature"][one]).astype(np.intp), np.where(leaf, np.inf, c["threshold"][one].astype(float)),
                       kids, *share, int(depth.max(initial=0))))
    return tables


def _permuted(own: np.ndarray, other: np.ndarray, trees: list[tuple], slots: np.ndarray, columns: int) -> np.ndarray:
    """Probabilities of class 1 of each row as it is (first line) and with each column's
    slots taken from its partner. A tree is walked again only for rows whose path
    meets the column. Shares are added up tree by tree, as the model does."""
    n, width = own.shape
    flat, base = np.concatenate([own, other], axis=1).ravel(), np.arange(n) * (2 * width)
    words = -(-columns // 64)
    bit = np.zeros((words, width), np.uint64)
    for f, c in enumerate(slots):
        if c >= 0:
            bit[c // 64, f] = np.uint64(1) << np.uint64(c % 64)
    moved = np.where(slots[None, :] == np.arange(columns)[:, None], width, 0).astype(np.intp) + np.arange(width)
    moved, sums = moved.ravel(), np.zeros((2, columns + 1, n))
    for feature, threshold, kids, share0, share1, depth in trees:
        node, met = np.zeros(n, np.intp), np.zeros((words, n), np.uint64)
        for _ in range(depth):
            f, inner = feature.take(node), threshold.take(node)
            for k in range(words):
                met[k] |= np.where(inner < np.inf, bit[k].take(f), np.uint64(0))
            node = kids.take(2 * node + ~(flat.take(base + f) <= inner))
        hit = [np.flatnonzero(met[c // 64] >> np.uint64(c % 64) & np.uint64(1)) for c in range(columns)]
        rows, column = np.concatenate([*hit, []]).astype(np.intp), np.repeat(np.arange(columns), [len(h) for h in hit])
        at, start, again = base[rows], column * width, np.zeros(len(rows), np.intp)
        for _ in range(depth):
            f = feature.take(again)
            again = kids.take(2 * again + ~(flat.take(at + moved.take(start + f)) <= threshold.take(again)))
        for total, share in zip(sums, (share0, share1)):
            one = np.tile(share.take(node), (columns + 1, 1))
            one[column + 1, rows] = share.take(again)
            total += one
    whole = sums.sum(axis=0)
    return np.divide(sums[1], whole, out=np.zeros_like(whole), where=whole != 0)


def permuted_scores(paired: DataFrame, model: RandomForestClassificationModel, slots: list[int], names: list[str]) -> DataFrame:
    """Rows ``(feature, label, x, p0, p)``, one for each row of ``paired`` (label, the columns'
    values ``xs``, own and the partner's features) and column, and one a row with ``feature = ''``
    as it is. ``slots``: the column of each place of the features, -1 for none."""
    spark = paired.sparkSession
    shared, at, k = spark.sparkContext.broadcast(forest_table(spark, model)), np.array(slots), len(names)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for some in range(0, whole.num_rows, 4096):
                b = whole.slice(some, 4096)
                n = b.num_rows
                own, other = [b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in (2, 3)]
                p = _permuted(own, other, shared.value, at, k)
                feature = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(k + 1), n), pa.int32()), ["", *names])
                x = pa.concat_arrays([pa.nulls(n, pa.float64()), *[c.cast(pa.float64()) for c in b.column(1).flatten()]])
                label = pa.concat_arrays([b.column(0)] * (k + 1))
                yield pa.RecordBatch.from_arrays([feature.dictionary_decode(), label, x, pa.array(np.tile(p[0], k + 1)),
                                                  pa.array(p.ravel())], ["__feature", "label", "__x", "__p0", "__p"])
    return paired.mapInArrow(scores, "__feature string, label double, __x double, __p0 double, __p double")
