"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more.

One dictionary is trained on ordinary text, one on the words of toxic text that hold a
byte gram far commoner there than in ordinary text. A window is one word; its distance is
its compressed length with the ordinary dictionary less that with the toxic one. How many
distinct windows of a text pass each distance threshold is turned into a probability by a
logistic fit on labelled rows that neither dictionary has seen.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwright.llm.common import map_texts

#: Labelled ids a class, and bytes of their texts a class, that a fit reads on average; both drawn by hash.
SAMPLE, SAMPLE_BYTES = 4000, 6 << 20
TOXIC_BYTES, ORDINARY_BYTES = 16 << 10, 256 << 10
#: Byte grams: length, how much commoner among toxic documents, least toxic documents and share of them.
GRAM, LIFT, LEAST, LEAST_SHARE = 6, 5.0, 5, 0.01
THRESHOLDS = (2, 3, 4, 5, 6)
#: zstandard finds no match that starts in the last eight bytes of its input, so every window ends in padding.
PAD = b"\n" * 12
WORD = 64
KNOWN = 1 << 17


def windows(text: str | None) -> list[bytes]:
    """The distinct words of a text, lower case, in order; longer words in pieces of 64 bytes."""
    words = dict.fromkeys((text or "").lower().encode("utf-8", "replace").split())
    return list(dict.fromkeys(p for w in words for p in (w[i : i + WORD] for i in range(0, len(w), WORD))))


def _grams(word: bytes) -> set[bytes]:
    w = b" " + word + b" "
    return {w[i : i + GRAM] for i in range(len(w) - GRAM + 1)}


def telling_words(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Of each toxic text the words with a gram that is ``LIFT`` times commoner among toxic texts, space-joined."""
    known: dict[bytes, frozenset] = {}

    def grams(word):
        if word not in known:
            known[word] = frozenset(_grams(word))
        return known[word]

    seen = Counter(g for ws in toxic for g in set().union(*map(grams, ws)))
    least = max(LEAST, LEAST_SHARE * len(toxic))
    seen = Counter({g: n for g, n in seen.items() if n >= least})
    plain = Counter(g for ws in ordinary for g in set().union(*map(_grams, ws)) if g in seen)
    telling = {g for g, n in seen.items() if n * (len(ordinary) + 1) >= LIFT * (plain[g] + 0.5) * len(toxic)}
    picked = ([w for w in ws if not telling.isdisjoint(grams(w))] for ws in toxic)
    return [b" " + b" ".join(ws) + b" " for ws in picked if ws]


def passages(texts: list[list[bytes]], size: int = 300, each: int = 3) -> list[bytes]:
    """Up to ``each`` evenly spaced passages of every text."""
    out = []
    for ws in texts:
        data = b" " + b" ".join(ws) + b" "
        step = max(size, len(data) // each)
        out += [data[i : i + size] for i in range(0, len(data), step)][:each]
    return out


def dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on ``samples``; of samples too few to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6, level=19).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    bits = max(12, len(content).bit_length() + 1)
    how = zstandard.ZstdCompressionParameters(
        window_log=bits, hash_log=min(17, bits), chain_log=bits, search_log=6, min_match=4, target_length=32,
        strategy=zstandard.STRATEGY_BTLAZY2, write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=how)


class Scorer:
    """Both dictionaries and the fitted weights. Compressors and known distances are made in each task and end with it."""

    def __init__(self, toxic: bytes = b"", ordinary: bytes = b"", weights: np.ndarray | None = None, constant: float = 0.0):
        self.toxic, self.ordinary, self.weights, self.constant, self.ready = toxic, ordinary, weights, constant, None

    def __getstate__(self):
        return self.__dict__ | {"ready": None}

    def distance(self, word: bytes) -> int:
        """Bytes that the toxic dictionary saves over the ordinary one."""
        if self.ready is None:
            self.ready = compressor(self.ordinary), compressor(self.toxic), {}
        plain, toxic, known = self.ready
        if word not in known:
            if len(known) >= KNOWN:
                known.clear()
            w = b" " + word + b" " + PAD
            known[word] = len(plain.compress(w)) - len(toxic.compress(w))
        return known[word]

    def features(self, ws: list[bytes]) -> list[float]:
        found = Counter(map(self.distance, ws))
        return [math.log1p(sum(n for d, n in found.items() if d >= t)) for t in THRESHOLDS] + [math.log1p(len(ws)), 1.0]

    def score(self, ws: list[bytes]) -> float:
        if self.weights is None:
            return self.constant
        return float(1 / (1 + math.exp(-min(40.0, max(-40.0, float(np.dot(self.weights, self.features(ws))))))))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the last column is the constant and isn't shrunk."""
    c, keep = np.zeros(x.shape[1]), ridge * np.r_[np.ones(x.shape[1] - 1), 1e-6]
    w = w / w.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, x.T @ (w * (p - y)) + keep * c)
        c = c - step / max(1.0, float(np.abs(step).max()) / 4)
        if np.abs(step).max() < 1e-9:
            break
    return c


def fit(rows: list[tuple[int, bool, list[bytes]]], sizes: dict[int, int]) -> Scorer:
    """From rows (label, calibrates, windows); ``sizes`` are the labelled documents of each class, for the share of toxic ones."""
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len({y for y, _, _ in rows}) < 2:
        return Scorer(constant=share)
    for_dictionaries = [r for r in rows if not r[1]]
    for_weights = [r for r in rows if r[1]]
    if len({r[0] for r in for_dictionaries}) < 2 or len({r[0] for r in for_weights}) < 2:
        for_dictionaries = for_weights = rows
    toxic, ordinary = ([ws for y, _, ws in for_dictionaries if y == k] for k in (1, 0))
    telling = telling_words(toxic, ordinary) or passages(toxic)
    made = Scorer(dictionary(telling, TOXIC_BYTES), dictionary(passages(ordinary), ORDINARY_BYTES))
    x, y = np.array([made.features(ws) for _, _, ws in for_weights]), np.array([y for y, _, _ in for_weights])
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    made.weights = logistic(x, y, weight)
    return made


def _remainder(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Scorer:
    """Learn from rows whose crc32 of the id, modulo five, isn't 0; of those, remainder 4 fits the weights and the others the dictionaries.

    About ``sample`` ids a class are drawn by a hash of the id, and where their texts have more
    than ``sample_bytes`` a class, rows by a hash of id and text, so an id with many rows is
    cut as well. Ids labelled both ways, other labels and null texts are left out.
    """
    one = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & (_remainder(doc_id) != 0)).groupBy(F.col(doc_id).alias("__id"))
    own = one.agg(F.min(label).cast("int").alias("__y"), F.max(label).cast("int").alias("__y2")).where("__y = __y2").drop("__y2")
    sizes = {r["__y"]: r["n"] for r in own.groupBy("__y").agg(F.count("*").alias("n")).collect()}  # two rows
    draw = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30)) / float(1 << 30)
    share = lambda most, of: F.when(F.col("__y") == 1, most / max(1, of.get(1, 0))).otherwise(most / max(1, of.get(0, 0)))
    some = own.where(draw("__id") < share(sample, sizes))  # about 2 x sample ids, whatever the tables' size
    met = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t")).where("__t is not null").join(F.broadcast(some), "__id")
    size = {r["__y"]: r["n"] for r in met.groupBy("__y").agg(F.sum(F.octet_length("__t")).alias("n")).collect()}  # two rows
    drawn = met.where(draw("__t", "__id") < share(sample_bytes, size)).withColumn("__c", _remainder("__id") == 4)
    found = map_texts(drawn, ["__id", "__y", "__c"], "__t", "ws binary", lambda texts: {"ws": [b" ".join(windows(t)) for t in texts]}).collect()  # at most about 2 x sample_bytes
    rows = sorted((r["__id"], r["__y"], r["__c"], bytes(r["ws"])) for r in found)
    return fit([(y, c, ws.split()) for _, y, c, ws in rows], sizes)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: the id, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier), ``predicted``.

    The whole text counts. Null and empty texts have no windows and get the score of none.
    A null id isn't held out, repeated rows get equal results, an empty table gives no
    rows; other columns are ignored. With labels of one class every score is that class's
    share, 0 or 1; without labels it is 0.
    """
    made = train(docs, labels, doc_id, text, label)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(_remainder(doc_id) == 0, F.lit(False)).alias("held_out"), F.col(text).alias("__t"))
    scored = map_texts(own, ["doc_id", "held_out"], "__t", "score double", lambda texts: {"score": [made.score(windows(t)) for t in texts]})
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
