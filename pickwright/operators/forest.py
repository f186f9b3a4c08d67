"""Random classification forest on binned features, by the rules of MLlib's.

Every tree draws each row a Poisson(1) number of times, every node looks at the square root of the features,
splits lie between at most 32 bins a feature and are chosen by Gini gain, and sibling leaves that predict the
same class are merged. MLlib walks object trees for one row at a time and adds into one table for all trees,
which no cache holds; here a tree is a few arrays, walked for a block of rows at a time.

A level of all trees is one job. A task counts its rows by (node, class, feature, bin), one row for each tree; the
counts of a tree are summed and its splits chosen in one task, whose input grows with tasks, not with rows.
Counts are whole numbers, so the order of summing changes nothing; a row's draws follow its place in its partition.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# executors need numpy, pandas and pyarrow, but not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins a feature, at most 256; rows from which the splits between them are found, as in MLlib.
BINS, SPLIT_ROWS = 32, 10_000
#: Rows that are walked at a time: their arrays stay in a core's cache.
BLOCK = 1 << 15
#: Draws of a row for a random number of 16 bits.
DRAWS = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)])) * 65536, np.arange(65536), side="right").astype(np.uint8)


@dataclass
class Tree:
    """Nodes in order of their making, children after their parent and side by side. A leaf is its own child and sends no row right."""

    feature: np.ndarray
    bin: np.ndarray
    child: np.ndarray
    #: Drawn rows of each class, (node, class).
    counts: np.ndarray
    gain: np.ndarray


@dataclass
class Forest:
    splits: list[np.ndarray]
    trees: list[Tree]
    class_weights: np.ndarray

    def importances(self) -> np.ndarray:
        """Gain times weight of a feature's nodes, each tree's shares summed."""
        total = np.zeros(len(self.splits))
        for t in self.trees:
            inner = np.flatnonzero(t.child != np.arange(len(t.child)))
            own = np.bincount(t.feature[inner], t.gain[inner] * (t.counts[inner] @ self.class_weights), len(total))
            total += own / own.sum() if own.sum() > 0 else 0
        return total / total.sum() if total.sum() > 0 else total

    def probability(self, features: Sequence[str], of: int = 1) -> Column:
        """The trees' mean share of class ``of``."""
        splits, arrays = self.splits, []
        for t in self.trees:
            weight = t.counts * self.class_weights
            arrays.append((t.feature, t.bin, t.child, weight[:, of] / np.maximum(weight.sum(axis=1), 1e-300), height(t.child)))

        def score(*columns):
            bins = binned([c.to_numpy(float) for c in columns], splits)
            out = np.zeros(len(bins))
            for feature, cut, child, share, steps in arrays:
                nodes = walkable(feature, cut, child)
                for at in range(0, len(bins), BLOCK):
                    out[at : at + BLOCK] += share[walked(bins[at : at + BLOCK], None, nodes, steps)]
            return pd.Series(out / len(arrays))

        return F.pandas_udf(score, "double", F.PandasUDFType.SCALAR)(*features)


def split_points(values: np.ndarray, weights: np.ndarray, most: int = BINS - 1) -> np.ndarray:
    """At most so many points between neighbouring distinct values, with about the same weight between them."""
    seen, at = np.unique(values, return_inverse=True)
    between = (seen[:-1] + seen[1:]) / 2
    if len(between) <= most:
        return between
    upto, found = np.cumsum(np.bincount(at, weights)), []
    stride = aim = upto[-1] / (most + 1)
    for k in range(len(between)):
        if abs(upto[k] - aim) < abs(upto[k + 1] - aim):
            found.append(between[k])
            aim += stride
    return np.array(found)


def binned(columns: Sequence[np.ndarray], splits: list[np.ndarray]) -> np.ndarray:
    """(row, feature): how many split points are below the value."""
    return np.stack([np.searchsorted(s, x).astype(np.uint8) for x, s in zip(columns, splits, strict=True)], axis=1)


def height(child: np.ndarray) -> int:
    depth = np.zeros(len(child), int)
    for k in np.flatnonzero(child != np.arange(len(child))):
        depth[child[k] : child[k] + 2] = depth[k] + 1
    return int(depth.max())


def walkable(feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return feature.astype(np.intp), cut, child.astype(np.intp)


def walked(bins: np.ndarray, rows: np.ndarray | None, nodes: tuple[np.ndarray, np.ndarray, np.ndarray], steps: int) -> np.ndarray:
    """The node at which each of the (chosen) rows ends."""
    feature, cut, child = nodes
    flat, first = bins.ravel(), (np.arange(len(bins)) if rows is None else rows) * bins.shape[1]
    node = np.zeros(len(first), np.intp)
    for _ in range(steps):
        node = child.take(node) + (flat.take(first + feature.take(node)) > cut.take(node))
    return node


def gini(counts: np.ndarray) -> np.ndarray:
    """Impurity along axis 1; 0 where nothing is counted."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1e-300)
    return np.where(counts.sum(axis=1) > 0, 1 - ((counts / total) ** 2).sum(axis=1), 0.0)


def best_splits(counts: np.ndarray, weights: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of counts (node, class, feature, bin): the best feature, bin and gain of each node, and the counts of the rows that go left. No gain: no split."""
    left = counts.cumsum(axis=3)
    total = left[..., -1:]
    left, n = left[..., :-1], len(counts)
    right = total - left
    shaped = weights[None, :, None, None]
    lw, rw, tw = left * shaped, right * shaped, total * shaped
    share = lw.sum(axis=1) / np.maximum(tw.sum(axis=1), 1e-300)
    gain = gini(tw) - share * gini(lw) - (1 - share) * gini(rw)
    gain = np.where((left.sum(axis=1) > 0) & (right.sum(axis=1) > 0) & allowed[:, :, None], gain, -1.0).reshape(n, -1)
    best = gain.argmax(axis=1)
    feature, cut = best // left.shape[3], best % left.shape[3]
    return feature, cut, gain[np.arange(n), best], left[np.arange(n), :, feature, cut]


def counter(trees: list[tuple], splits: list[np.ndarray], classes: int, bins_in: int, level: int, seed: int):
    """Rows of a partition by tree, and inside by feature, open node, class and bin."""
    width = len(splits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, xs = [], []
        for b in batches:
            ys.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.intp))
            xs.append(binned([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(width)], splits))
        if not ys:
            return
        every, held, part = np.concatenate(ys), np.concatenate(xs), TaskContext.get().partitionId()
        blocks = [(every[at : at + BLOCK], held[at : at + BLOCK], np.ascontiguousarray(held[at : at + BLOCK].T)) for at in range(0, len(every), BLOCK)]
        for k, (feature, cut, child, active) in enumerate(trees):
            if not len(active):
                continue
            nodes, slot = walkable(feature, cut, child), np.full(len(child), -1, np.intp)
            slot[active] = np.arange(len(active))
            size = len(active) * classes * bins_in
            found = np.zeros((width, size))
            for at, (y, bins, turned) in enumerate(blocks):
                draws = DRAWS.take(np.random.Generator(np.random.SFC64([seed, k, part, at])).integers(0, 65536, len(y), np.uint16))
                chosen = np.flatnonzero(draws)
                place = slot.take(walked(bins, chosen, nodes, level))
                if place.min(initial=0) < 0:
                    chosen, place = chosen[place >= 0], place[place >= 0]
                times, base = draws.take(chosen).astype(float), (place * classes + y.take(chosen)) * bins_in
                for f in range(width):
                    found[f] += np.bincount(base + turned[f].take(chosen), times, size)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([found.astype(np.int32).tobytes()], pa.binary())], names=["tree", "found"])

    return count


def chooser(open_: list[int], width: int, weights: np.ndarray, bins_in: int, tried: int, level: int, seed: int):
    """Of the partitions' counts of one tree the splits of its open nodes, as arrays."""
    classes = len(weights)

    def choose(key, parts: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        total = np.zeros(width * open_[k] * classes * bins_in, np.int64)
        for x in parts["found"]:
            total += np.frombuffer(x, np.int32)
        counts = total.reshape(width, open_[k], classes, bins_in).transpose(1, 2, 0, 3)
        order = np.random.Generator(np.random.SFC64([seed, k, level])).random((open_[k], width)).argsort(axis=1)
        feature, cut, gain, left = best_splits(counts, weights, order < tried)
        whole = counts[:, :, 0].sum(axis=2)
        made = {"feature": feature.astype(np.int16), "bin": cut.astype(np.uint8), "gain": gain, "lefts": left.astype(np.int64), "whole": whole.astype(np.int64)}
        return pd.DataFrame({"tree": [k]} | {c: [x.tobytes()] for c, x in made.items()})

    return choose


def grown(rows: DataFrame, label: str, features: Sequence[str], class_weights: Sequence[float], trees: int, depth: int, seed: int) -> Forest:
    """A forest of ``trees`` on numeric columns without null or NaN; ``label`` counts from 0 to the number of weights less one.

    ``rows`` must come again in the same partitions and order, as checkpointed ones do.
    """
    width, weights = len(features), np.asarray(class_weights, float)
    classes = len(weights)
    own = rows.select(F.col(label).cast("int").alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    n = own.count()
    if not n:
        raise ValueError("no row to grow a forest on")
    some = (own if n <= SPLIT_ROWS else own.sample(SPLIT_ROWS / n, seed=seed)).toPandas()
    splits = [split_points(some[f"x{i}"].to_numpy(float), weights[some["y"]]) for i in range(width)]
    bins_in = max(2, 1 + max(map(len, splits)))
    tried = int(np.ceil(np.sqrt(width))) if trees > 1 else width
    made = [Tree(np.zeros(1, np.int16), np.full(1, 255, np.uint8), np.zeros(1, np.int32), np.zeros((1, classes), np.int64), np.zeros(1)) for _ in range(trees)]
    open_ = [np.zeros(1, np.int32) for _ in range(trees)]
    for level in range(max(1, depth)):
        counted = own.mapInArrow(counter([(t.feature, t.bin, t.child, o) for t, o in zip(made, open_)], splits, classes, bins_in, level, seed), "tree int, found binary")
        choose = chooser([len(o) for o in open_], width, weights, bins_in, tried if depth else 0, level, seed)
        told = counted.groupBy("tree").applyInPandas(choose, "tree int, feature binary, bin binary, gain binary, lefts binary, whole binary").collect()
        still = [np.zeros(0, np.int32)] * trees
        for r in told:
            k = r["tree"]
            feature, cut, gain = (np.frombuffer(r[c], kind) for c, kind in (("feature", np.int16), ("bin", np.uint8), ("gain", float)))
            left, whole = (np.frombuffer(r[c], np.int64).reshape(-1, classes) for c in ("lefts", "whole"))
            made[k], still[k] = _deeper(made[k], open_[k], feature, cut, gain, left, whole, weights, level + 1 >= depth)
        open_ = still
        if not any(len(o) for o in open_):
            break
    return Forest(splits, [_pruned(t, weights) for t in made], weights)


def _deeper(t: Tree, active: np.ndarray, feature, cut, gain, left, whole, weights: np.ndarray, last: bool) -> tuple[Tree, np.ndarray]:
    """The tree with the splits of its open nodes, and the nodes that are open then: not pure, and not of the last level."""
    t.counts[active] = whole
    split = gain > 0
    at, n = active[split], len(t.child)
    first = n + 2 * np.arange(len(at), dtype=np.int32)
    t.feature[at], t.bin[at], t.child[at], t.gain[at] = feature[split], cut[split], first, gain[split]
    counts = np.stack([left[split], whole[split] - left[split]], axis=1).reshape(-1, left.shape[1])
    m = len(counts)
    out = Tree(np.append(t.feature, np.zeros(m, np.int16)), np.append(t.bin, np.full(m, 255, np.uint8)), np.append(t.child, n + np.arange(m, dtype=np.int32)), np.concatenate([t.counts, counts]), np.append(t.gain, np.zeros(m)))
    return out, (n + np.flatnonzero(gini(counts * weights) > np.finfo(float).eps)).astype(np.int32)[: 0 if last else None]


def _pruned(t: Tree, weights: np.ndarray) -> Tree:
    """Leaves of one parent that predict the same class are merged, from below."""
    told = (t.counts * weights).argmax(axis=1)
    child = t.child.copy()
    for k in range(len(child) - 1, -1, -1):
        a = child[k]
        if a != k and child[a] == a and child[a + 1] == a + 1 and told[a] == told[a + 1]:
            child[k] = k
    leaf = child == np.arange(len(child))
    return Tree(np.where(leaf, 0, t.feature).astype(np.int16), np.where(leaf, 255, t.bin).astype(np.uint8), child, t.counts, t.gain)
