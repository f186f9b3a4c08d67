"""Quality rules: plain counts, and a calibrated n-gram classifier trained on labelled rows.

Features are shares of hashed word 1- and 2-grams and of hashed 3- and 4-byte grams.
Logistic regression is fitted on a bounded sample of labelled rows, its output is
calibrated on rows that the fit did not see, and texts are scored in Arrow batches
against a fixed threshold.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwright.llm.common import map_texts

#: At most about so many labelled rows of a class, chosen by a hash of the id; buckets of a feature group; the threshold.
SAMPLE, BUCKETS, THRESHOLD = 1000, 1 << 11, 0.5
GROUPS = 4
STEPS, DECAY = 400, 1e-3
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SLICE = 1 << 20


def _numbers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every word as a number in order of first sight, and a hash of each distinct word."""
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    return ids, np.array([zlib.crc32(w) for w in seen], np.uint64)


def _rank(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def repeated_words(ids: np.ndarray, window: int = 5) -> int:
    """Words inside windows that the text holds twice or more. Exact: windows are ranked pair by pair."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    code, top = ids[:n], int(ids.max()) + 1
    for k in range(1, window):
        if top > 1 << 31:
            code = _rank(code)
            top = int(code.max()) + 1
        code = code * (int(ids.max()) + 1) + ids[k : n + k]
        top *= int(ids.max()) + 1
    _, back, count = np.unique(code, return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, np.int64)
    again = np.flatnonzero(count[back] > 1)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(data: bytes, ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    b = np.frombuffer(data, np.uint8)
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = int(np.count_nonzero(~_SPACE[b] & ((b & 0xC0) != 0x80)))
    return len(ids), chars, int(np.count_nonzero(_SYMBOL[b])), len(lines) - len(set(lines)), repeated_words(ids)


def gram_buckets(data: bytes, ids: np.ndarray, hashes: np.ndarray, buckets: int):
    """(group, bucket numbers) of a text's hashed grams, in slices of bounded size."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    if len(ids):
        w = hashes[ids]
        yield 0, ((w * mix) >> shift).astype(np.int64)
        if len(ids) > 1:
            yield 1, (((w[:-1] * np.uint64(0x100000001B3) ^ w[1:]) * mix) >> shift).astype(np.int64)
    b = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(b) - 2), SLICE):
        c = b[at : at + SLICE + 3].astype(np.uint64)
        three = (c[:-2] << np.uint64(16)) | (c[1:-1] << np.uint64(8)) | c[2:]
        yield 2, ((three[:SLICE] * mix) >> shift).astype(np.int64)
        if len(c) > 3:
            four = (three[:-1] << np.uint64(8)) | c[3:]
            yield 3, ((four[:SLICE] * mix) >> shift).astype(np.int64)


def features(data: bytes, buckets: int) -> np.ndarray:
    ids, hashes = _numbers(data.split())
    x = np.zeros((GROUPS, buckets), np.float32)
    for g, k in gram_buckets(data, ids, hashes, buckets):
        x[g] += np.bincount(k, minlength=buckets)
    return (x / np.maximum(1, x.sum(axis=1, keepdims=True))).ravel()


@dataclass
class Model:
    weights: np.ndarray | None  # groups x buckets; None: nothing to learn from, everything passes
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, data: bytes, ids: np.ndarray, hashes: np.ndarray) -> float:
        if self.weights is None:
            return 1.0
        total, count = np.zeros(GROUPS), np.zeros(GROUPS)
        for g, k in gram_buckets(data, ids, hashes, self.weights.shape[1]):
            total[g] += self.weights[g][k].sum(dtype=float)
            count[g] += len(k)
        z = self.bias + float((total / np.maximum(1, count)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40))))


def fit(x: np.ndarray, y: np.ndarray, for_calibration: np.ndarray, steps: int = STEPS, decay: float = DECAY) -> Model:
    """Logistic regression by accelerated gradient steps on the rows not held for calibration; both classes weigh the same."""
    if len(y) == 0 or y.min() == y.max():
        return Model(None)
    buckets = x.shape[1] // GROUPS
    rest = ~for_calibration
    if len(set(y[rest])) < 2 or len(set(y[for_calibration])) < 2:
        rest = for_calibration = np.ones(len(y), bool)
    a, t = x[rest], y[rest].astype(float)
    mean, spread = a.mean(axis=0), a.std(axis=0)
    spread = np.maximum(spread, np.median(spread[spread > 0]) if (spread > 0).any() else 1)
    a = (a - mean) / spread
    share = np.where(t == 1, 0.5 / max(1, t.sum()), 0.5 / max(1, (1 - t).sum()))
    gram = sum(b @ b.T for b in (a[:, i : i + buckets].astype(float) for i in range(0, a.shape[1], buckets)))
    step = 1 / (0.25 * float(share @ np.diag(gram)) + decay)
    # steps from 0 keep the weights a sum of rows, so they run on a factor per row: rows x rows numbers a step, not rows x features
    w = v = np.zeros(len(a) + 1)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(gram @ v[1:] + v[0], -40, 40)))
        e = share * (p - t)
        g = np.concatenate([[e.sum()], e + decay * v[1:]])
        new = v - step * 4 * g
        v, w = new + k / (k + 3) * (new - w), new
    scaled = (w[1:].astype(a.dtype) @ a).astype(float) / spread
    bias = float(w[0] - scaled @ mean)
    z = x[for_calibration] @ scaled + bias
    slope, shift = calibrated(z, y[for_calibration])
    return Model(scaled.reshape(GROUPS, buckets).astype(np.float32), bias, slope, shift)


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling with smoothed targets, by Newton's method; both classes weigh the same."""
    up, down = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    s = np.where(y == 1, 0.5 / up, 0.5 / down)
    scale = max(float(np.abs(z).max()), 1e-9)
    m = np.stack([z / scale, np.ones(len(z))], axis=1)
    c = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ c, -40, 40)))
        h = (m * (s * p * (1 - p))[:, None]).T @ m + 1e-6 * np.eye(2)
        c = c - np.linalg.solve(h, m.T @ (s * (p - t)) + 1e-6 * c)
    return float(max(c[0], 1e-9) / scale), float(c[1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int = SAMPLE, buckets: int = BUCKETS) -> Model:
    """The sample's expected size is ``sample`` a class, whatever the tables'; a fifth of it calibrates."""
    own = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    draw = F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) / float(1 << 30)
    least = F.when(F.col("y") == 1, sample / max(1, sizes.get(1, 0))).otherwise(sample / max(1, sizes.get(0, 0)))
    # bounded by the expected sample size, so it may be broadcast; contradicting labels of one id are left out
    some = own.where(draw < least).groupBy("__id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2")
    texts = docs.join(F.broadcast(some), F.col(doc_id) == F.col("__id")).where(F.col(text).isNotNull()).select("__id", "y", F.col(text).alias("__t"))
    found = map_texts(texts, ["__id", "y"], "__t", "x binary", lambda ts: {"x": [features(t.encode(), buckets).astype("<f2").tobytes() for t in ts]}).toPandas()
    found = found.sort_values("__id", kind="stable")
    x = np.stack([np.frombuffer(v, "<f2") for v in found["x"]]).astype(np.float32) if len(found) else np.zeros((0, GROUPS * buckets), np.float32)
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in found["__id"]], bool)
    return fit(x, found["y"].to_numpy(int), held)


COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def judge_batch(model: Model, texts: list[str | None], threshold: float) -> dict[str, list]:
    names = [c.split()[0] for c in COUNTS.split(", ")]
    out: dict[str, list] = {n: [] for n in [*names, "base_failed", "quality", "kept"]}
    for t in texts:
        data = (t or "").encode()
        ids, hashes = _numbers(data.split())
        counts = base_counts(data, ids)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        p = model.probability(data, ids, hashes)
        for n, v in zip([*names, "base_failed", "quality", "kept"], [*counts, failed, p, not failed and p >= threshold], strict=True):
            out[n].append(v)
    return out


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: the id, the base counts, ``base_failed``, ``quality`` (calibrated probability), ``kept``.

    Null and empty texts have no words and fail. Null ids stay null, repeated rows get
    equal results, an empty table gives an empty result; other columns are ignored.
    Labels other than 0 and 1, and ids with both, are left out; with no usable labels,
    or of one class, the classifier passes everything.
    """
    model = train(docs, labels, doc_id, text, label, sample)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__t"))
    return map_texts(own, ["doc_id"], "__t", f"{COUNTS}, base_failed boolean, quality double, kept boolean", lambda texts: judge_batch(model, texts, threshold))
