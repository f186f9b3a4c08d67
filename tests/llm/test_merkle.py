"""The manifest against a plain in-memory tree."""

import hashlib
import random
import zlib

import pytest

from pickwright.llm import merkle, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, at int, width int, root string, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    out = ""
    for v in (doc_id, source, lang, n_chars, text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def proof_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = nodes[at // 2 * 2 : at // 2 * 2 + 2]
        out.append([x for k, x in enumerate(run) if at // 2 * 2 + k != at])
        at //= 2
    return out


def fold(x, levels, at):
    for nodes in levels[:-1]:
        run = nodes[at // 2 * 2 : at // 2 * 2 + 2]
        run[at % 2] = x
        x, at = h(*run), at // 2
    return x


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = {}, []
    for lang in langs:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1]), i) for i, r in enumerate(rows) if r[2] == lang))
        trees[lang] = [(x, rows[i]) for _, _, x, i in own], tree([x for _, _, x, _ in own])
    top = tree([trees[x][1][-1][0] for x in langs])
    for k, lang in enumerate(langs):
        own, levels = trees[lang]
        for at, (x, r) in enumerate(own):
            siblings = [y for run in [*proof_of(levels, at), *proof_of(top, k)] for y in run]
            n = r[4] if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 or r[4] is None else r[4] + 1
            folded = fold(fold(leaf(r[0], r[3], r[2], n, r[1]), levels, at), top, k)
            out.append((r[0], x, levels[-1][0], top[-1][0], h(*siblings), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(5)


def digest_rows(df):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], h(*r["proof"]), r["folded_root"], r["verified"]) for r in df.collect()), key=str)


def made(n, seed=3):
    rnd = random.Random(seed)
    langs = ["en"] * 6 + ["de", "fr", "Ä", "z", None, "", "日"]
    rows = [(i, " ".join(rnd.choice(["a", "é", "日本", "x" * 9]) for _ in range(rnd.randint(0, 9))), rnd.choice(langs), rnd.choice(["web", None]), rnd.choice([None, rnd.randint(0, 99)])) for i in range(n)]
    rows += [rows[3], rows[3], (3, "other", rows[3][2], "s", 1), (None, None, None, None, None), (None, "", "en", "", 0), (10**15, "y" * 100_000, "en", "s", 2**63 - 1)]
    return rows


@pytest.mark.parametrize("stride", [2, 10])
def test_equals_a_plain_tree(spark, stride):
    rows = made(150)
    assert digest_rows(merkle.verified(table(spark, rows), stride)) == expected(rows)


def test_every_small_width(spark):
    rows = [(100 * n + i, f"t{i}", f"lang{n}", "s", i) for n in range(1, 18) for i in range(n)]
    assert digest_rows(merkle.verified(table(spark, rows), 2)) == expected(rows)


def test_only_levels_of_the_stride_are_stored(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(70)]
    made_ = merkle.manifest(table(spark, rows), 2)
    assert [sum(len(r["leaves"]) for r in x.collect()) for x in made_.levels] == [70, 18, 5, 2]
    assert max(len(r["leaves"]) for x in made_.levels for r in x.collect()) == 4


def test_tampering_is_found_and_nulls_stay(spark):
    rows = [(i, "t", "en", "s", None if i % 2 else i) for i in range(60)]
    got = {r["doc_id"]: r["verified"] for r in merkle.verified(table(spark, rows)).collect()}
    for i in range(60):
        assert got[i] == (bool(zlib.crc32(str(i).encode()) % 7) or i % 2 == 1)


def test_empty_table(spark):
    assert merkle.verified(table(spark, [(1, "a", "en", "s", 1)]).limit(0)).count() == 0


def test_query_equals_a_plain_tree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]
    got = queries.op11_manifest(spark, "/root/testdata/sf0.001")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.columns == names
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == expected(rows)
