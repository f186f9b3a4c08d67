"""Sums over the nodes of the trapezoid rule, on blocks of games; the Python part of :func:`scenarios.scenario_ev`."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# workers need numpy and pyarrow, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Nodes of the trapezoid rule for 1/s = integral of exp(-s t) dt with t = exp(x - exp(-x)).
# Sums are scaled so that s <= 1; the rule's error is then about exp(-2 pi / STEP), 1e-13,
# and the parts cut off below NODE_LOW and above NODE_HIGH - log(smallest s) are smaller.
STEP = 0.2
NODE_LOW, NODE_HIGH = -3.5, 3.6
# pairs of a game and a node that are worked on at once
AT_ONCE = 32_768


def _nodes(to: int) -> tuple[np.ndarray, np.ndarray]:
    """The points t of the nodes and their weights."""
    x = np.arange(int(NODE_LOW / STEP), to + 1) * STEP
    back = np.exp(-x)
    t = np.exp(x - back)
    return t, t * (1 + back) * STEP


def _log_factor(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log(p e^-at + q e^-bt) per game and node, with the smaller exponent taken out front."""
    out = np.exp(np.multiply.outer(-np.abs(a - b), t))
    out *= np.where(a <= b, q, p)[:, None]
    out += np.where(a <= b, p, q)[:, None]
    np.maximum(out, 1e-300, out=out)
    np.log(out, out=out)
    out -= np.multiply.outer(np.minimum(a, b), t)
    return out


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int | None, slice, list[np.ndarray]]]:
    """Row, last node, place among the batch's games, and ``_a _b _p _q`` of bounded parts of each list of games."""
    listed = batch.column("_games")
    games = listed.flatten()
    cols = [games.field(c).to_numpy(zero_copy_only=False) for c in ("_a", "_b", "_p", "_q")]
    start = 0
    for row, (size, to) in enumerate(zip(listed.value_lengths().to_pylist(), batch.column("_to").to_pylist(), strict=True)):
        step = max(1, AT_ONCE // ((to or 0) + 1 - int(NODE_LOW / STEP)))
        for i in range(start, start + size, step):
            part = slice(i, min(i + step, start + size))
            yield row, to, part, [c[part] for c in cols]
        start += size


def log_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per list of games: the sum of its log factors at every node, as ``_sums``; the list itself is dropped."""
    for batch in batches:
        sums: list[np.ndarray] = [np.zeros(to + 1 - int(NODE_LOW / STEP)) for to in batch.column("_to").to_pylist()]
        for row, to, _, (a, b, p, q) in _chunks(batch):
            sums[row] += _log_factor(a, b, p, q, _nodes(to)[0]).sum(axis=0)
        kept = [c for c in batch.schema.names if c != "_games"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sums, pa.list_(pa.float64()))], names=[*kept, "_sums"])


def values(keys: list[str], plain: list[str]):
    """An Arrow map: lists of games beside ``_logs`` of their group to one row a game, with ``_ea`` and ``_eb``.

    A list without a last node is of a group in which no side has a share: all its values are 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("_games")
            games = listed.flatten()
            ea, eb = np.zeros(len(games)), np.zeros(len(games))
            gone_all = games.field("_gone").to_numpy(zero_copy_only=False)
            logs, scales = batch.column("_logs"), batch.column("_scale").to_pylist()
            for row, to, part, (a, b, p, q) in _chunks(batch):
                if to is None:
                    continue
                t, weight = _nodes(to)
                others = logs[row].values.to_numpy(zero_copy_only=False) - _log_factor(a, b, p, q, t)
                for out, win, pick in ((ea, p, a), (eb, q, b)):
                    gone = np.where(pick == 0, gone_all[part], 0.0)
                    alone = np.exp(others - np.multiply.outer(pick, t)) - gone[:, None]
                    out[part] = alone @ weight * (win / scales[row])
            rows = pa.array(np.repeat(np.arange(len(listed)), listed.value_lengths().to_numpy(zero_copy_only=False)))
            cols = [*[batch.column(k).take(rows) for k in keys], *[games.field(c) for c in plain], pa.array(ea), pa.array(eb)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, *plain, "_ea", "_eb"])

    return run
