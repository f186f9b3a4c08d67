"""Toxicity: distances against plain compression calls, counts against brute force, edge rows, held-out accuracy."""

import math
import random
import zlib

import pytest

from pickwright.llm import queries, toxicity
from pickwright.llm.toxicity import THRESHOLDS, Scorer, fit, logistic, telling_words, windows

SCHEMA = "doc_id bigint, text string, score string, held_out string, lang string"


def made_rows(n, seed=5):
    rnd = random.Random(seed)
    parts = ["ka", "lo", "mi", "tren", "os", "ul", "ber", "gi", "sha", "dun"]
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4)))
    rows = []
    for i in range(n):
        ws = [word() for _ in range(rnd.randint(30, 120))]
        toxic = i % 4 == 0
        for _ in range(4 * toxic):
            ws.insert(rnd.randrange(len(ws)), rnd.choice(["vexgrub", "snarkwit", "zolpfrat"]))
        rows.append((i, " ".join(ws), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = made_rows(400)
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t, _ in rows], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, y, "q") for i, _, y in rows] + [(3, 1, "q"), (5, 7, "q"), (None, 1, "q")], "doc_id bigint, toxic int, text string")
    return rows, docs, labels


def test_windows_cover_the_whole_text():
    assert windows(None) == windows("") == windows(" \n") == []
    assert windows("Aa bB aa É") == [b"aa", b"bb", "é".encode()]
    long = "x" * 70 + "y" * 70
    assert b"".join(windows(long)) == long.encode() and max(map(len, windows(long))) == toxicity.WORD


def test_telling_words_equal_brute_force():
    toxic = [[b"common", b"snarkwit", b"w%d" % i] for i in range(30)]
    ordinary = [[b"common", b"v%d" % i, b"snarl"] for i in range(30)]
    assert telling_words(toxic, ordinary) == [b" snarkwit "] * 30
    assert telling_words(toxic, toxic) == [] and telling_words([], ordinary) == []


def test_distance_is_the_difference_of_two_compressed_lengths():
    made = Scorer(b" snarkwit zolpfrat ", b" kalomi trenosul ")
    w = b" snarkwit " + toxicity.PAD
    want = len(toxicity.compressor(made.ordinary).compress(w)) - len(toxicity.compressor(made.toxic).compress(w))
    assert made.distance(b"snarkwit") == want > 2 and made.distance(b"trenosul") < -2
    ws = [b"snarkwit", b"trenosul", b"kalomi", b"zolpfrat"]
    d = [made.distance(x) for x in ws]
    assert made.features(ws) == [math.log1p(sum(x >= t for x in d)) for t in THRESHOLDS] + [math.log1p(4), 1.0]
    assert made.__getstate__()["ready"] is None


def test_logistic_fit_reaches_its_minimum():
    import numpy as np

    rnd = np.random.default_rng(1)
    x = np.c_[rnd.normal(size=(200, 2)), np.ones(200)]
    y = (x[:, 0] + rnd.normal(size=200) > 0).astype(int)
    w = np.ones(200) / 200

    def loss(c):
        z = x @ c
        return (w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (1e-3 * (c[:2] ** 2).sum() + 1e-9 * c[2] ** 2)

    best = logistic(x, y, w)
    assert all(loss(best) <= loss(best + 0.01 * rnd.normal(size=3)) for _ in range(50))


def test_held_out_rows_are_told_apart(spark, tables):
    rows, docs, labels = tables
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, _, y in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_held_out_labels_change_nothing(spark, tables):
    rows, docs, labels = tables
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, turned))
    assert (a.toxic, a.ordinary) == (b.toxic, b.ordinary) and a.weights == pytest.approx(b.weights)


def test_sample_bounds_hold_for_an_id_with_many_rows(spark, tables):
    _, docs, labels = tables
    from pyspark.sql import functions as F

    many = docs.unionByName(spark.range(3000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("kalo mi "), F.col("id")).alias("text"), *[F.lit("").alias(c) for c in ("score", "held_out", "lang")]))
    seen = []
    whole = toxicity.fit
    toxicity.fit = lambda rows, sizes: seen.append(len(rows)) or whole(rows, sizes)
    try:
        toxicity.train(many, labels, sample_bytes=20_000)
    finally:
        toxicity.fit = whole
    assert 0 < seen[0] < 2000


def test_edge_rows(spark, tables):
    _, docs, labels = tables
    odd = [(None, "vexgrub", None, None, None), (9000, None, None, None, None), (9001, "", None, None, None), (9002, "z" * 200_000, None, None, None), (9003, "vexgrub kalo", None, None, None), (9003, "vexgrub kalo", None, None, None)]
    both = docs.unionByName(spark.createDataFrame(odd, SCHEMA))
    got = toxicity.score(both, labels).where("doc_id is null or doc_id >= 9000").collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert len({r["score"] for r in got if r["doc_id"] == 9003}) == 1
    assert len({r["score"] for r in got if r["doc_id"] in (9000, 9001)}) == 1
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["predicted"] for r in toxicity.score(docs, labels.where("toxic = 1")).collect()} == {1}
    assert fit([], {}).score([]) == 0.0


def test_query_on_the_given_tables(spark):
    got = queries.op13_toxicity(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
