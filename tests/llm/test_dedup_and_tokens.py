"""Line dedup, token counts, BPE and SimHash against brute force, with the odd rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from pickwright.llm import bpe, line_dedup, near_texts, simhash, token_counts
from pickwright.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines string, at int, key string"
ODD = [None, "", " ", "\n\n\n\n", "a", "Ünï ćode 日本 \U0001f600", "a  b \n c\t\td", "x" * 5000, "the of and " * 3000, "it's <|endoftext|> we'll", " lead", "trail ", "é 　\x85 q"]


def docs(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, None, "s", None, "x", 1, None) for i, t in zip(ids, texts)], SCHEMA)


def brute_lines(rows, span=3):
    seen, out = {}, []
    order = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None})
    for known, i, t in order:
        lines = t.split("\n")
        for at in range(len(lines) - span + 1):
            w = tuple(lines[at : at + span])
            if "".join(w).strip(" "):
                seen.setdefault(w, (known, i, t, at))
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines, cut = t.split("\n"), set()
        for at in range(len(lines) - span + 1):
            w = tuple(lines[at : at + span])
            if w in seen and seen[w] != (i is not None, i or 0, t, at):
                cut |= {*range(at, at + span)}
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in cut), len(lines), len(cut)))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [(k, "\n".join(rnd.choice(["a", "b", "c", "", "d e", "f" * rnd.randint(1, 4)]) for _ in range(rnd.randint(0, 14)))) for k in range(150)]
    rows += [(500 + k, t) for k, t in enumerate(ODD)] + [(7, rows[7][1]), (None, "n\no\nn\nn\no\nn"), (None, None), (3, "other\ntext\nof 3")]
    df = line_dedup.dedup_lines(docs(spark, [t for _, t in rows], [i for i, _ in rows]))
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "at", "key", "n_lines", "n_removed"]
    assert sorted([tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_removed").collect()], key=str) == brute_lines(rows)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_covers_overlaps(spark):
    got = line_dedup.dedup_lines(docs(spark, ["a\nb\nc\nd\ne", "x\nb\nc\nd\ne\ny", "a\na\na\na"])).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["a\nb\nc\nd\ne", "x\ny", "a"]


def test_token_counts_equal_the_library(spark):
    path, rnd = public_tokenizers.path("byte_bpe_50k.json"), random.Random(5)
    texts = ODD + ["".join(rnd.choice("ab \n\t'!é1 ") for _ in range(80)) for _ in range(200)]
    own = Tokenizer.from_file(path)
    got = token_counts.token_counts(docs(spark, texts), path).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in texts]
    assert [r["over_limit"] for r in got] == [r["n_tokens"] > 512 for r in got]
    assert token_counts.token_counts(docs(spark, []), path).count() == 0


def test_pieces_join_and_bounded_table_changes_nothing():
    path = public_tokenizers.path("byte_bpe_50k.json")
    for t in ODD:
        assert "".join(token_counts.pieces(t or "")) == (t or "")
    texts = [t for t in ODD if t]
    assert token_counts.count_batch(texts, path, batch_bytes=8, entries=3) == token_counts.count_batch(texts, path)


def test_bpe_equals_the_library(spark):
    path, rnd = public_tokenizers.path("word_bpe_49k.json"), random.Random(6)
    own = Tokenizer.from_file(path)
    texts = ODD + ["".join(rnd.choice(k) for _ in range(n)) for k in ("ab", "aehinot", "éèñaüß", "!?#.,-'", "日本ёж01 ", "Σσİ½ﬁ") for n in (1, 7, 300, 4000)]
    rows = bpe.digests(docs(spark, texts), path, ["doc_id"]).orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(docs(spark, []), path, ["doc_id"]).count() == 0


def test_bpe_streams_a_long_word_in_a_bounded_window():
    own = bpe.encoder(public_tokenizers.path("word_bpe_49k.json")).merges
    rnd = random.Random(8)
    word = bytes(rnd.choice(b"aeinorst") for _ in range(30_000))
    read = 0

    def feed():
        nonlocal read
        for b in word:
            read += 1
            yield b

    given, most = 0, 0
    for i in own.encode_word(feed()):
        given += len(own.text[i].removesuffix("</w>"))
        most = max(most, read - given)
    assert given == len(word) and most <= bpe.WINDOW + own.lookahead + 2 * own.longest + 2


def test_bpe_plain_text_comes_back(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = bpe.encode_decode(docs(spark, ["Héllo  wörld", "日本 \U0001f600", None]), path).orderBy("doc_id").collect()
    assert [r["plain"] for r in rows] == ["héllo wörld ", "日本 \U0001f600 ", ""]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(ids, fps, distance=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for k in range(len(fps)):
        if ids[k] is not None:
            least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return [least.get(find(k)) for k in range(len(fps))]


@pytest.mark.parametrize("hot", [2, 256])
def test_near_duplicates_equal_brute_force(spark, hot):
    rnd = random.Random(9)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(60)) for _ in range(8)]
    texts = list(ODD)
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(["zz", "Q", "yy"])
            texts.append(" ".join(w))
    ids = [1000 - k for k in range(len(texts))]
    texts, ids = texts + [texts[20], texts[30]], ids + [ids[20], None]
    fps = [plain_fingerprint(t) for t in texts]
    got = simhash.near_duplicates(docs(spark, texts, ids), hot=hot).collect()
    want = sorted(zip(ids, [f"{f:016x}" for f in fps], plain_groups(ids, fps)), key=str)
    assert sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got], key=str) == want
    assert simhash.near_duplicates(docs(spark, []), hot=hot).count() == 0


def test_links_in_hot_buckets_lose_none(spark):
    rnd = random.Random(4)
    fps = sorted({_flip(0x0123456789ABCDEF, rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(250)} | {rnd.getrandbits(64) for _ in range(50)})
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for hot in (1, 8, 10_000):
        edges = simhash.links(df, 3, hot)
        pairs = [(r["u"], r["v"]) for r in edges.collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in pairs)
        roots = {r["node"]: r["root"] for r in components(edges).collect()}
        want = plain_groups(fps, [f & (2**64 - 1) for f in fps])
        assert [roots.get(f, f) for f in fps] == want


def exploded_broadcasts(df):
    """Joins of the planned query that broadcast a table with an explode below them."""
    found = []

    def walk(node):
        kids = [node.children().apply(i) for i in range(node.children().size())]
        name = node.nodeName() + "".join(map(walk, kids))
        if node.nodeName().startswith("BroadcastHashJoin"):
            side = kids["Right" in str(node.buildSide())]
            found.extend([side.toString()] * ("Generate" in side.toString()))
        return name

    walk(df._jdf.queryExecution().sparkPlan())
    return found


@pytest.mark.parametrize("hot", [1, 10_000])
def test_enumerated_fingerprints_are_not_broadcast(spark, tmp_path, hot):
    """Spark takes the probes, 66 of a fingerprint, for no larger than the fingerprints themselves."""
    rnd = random.Random(6)
    fps = {rnd.getrandbits(63) for _ in range(300)} | {5 ^ 1 << b for b in range(40)}
    spark.createDataFrame([(f,) for f in fps], "fp bigint").write.parquet(f"{tmp_path}/fps")
    assert exploded_broadcasts(simhash.links(spark.read.parquet(f"{tmp_path}/fps"), 3, hot)) == []


@pytest.mark.parametrize("rows", [0, 200_000])
def test_bands_of_nodes_are_not_broadcast(spark, tmp_path, monkeypatch, rows):
    rnd = random.Random(8)
    made = [(k, k * 7919, [rnd.randrange(40) for _ in range(near_texts.BANDS)]) for k in range(400)]
    spark.createDataFrame(made, "node bigint, fp bigint, bands array<bigint>").write.parquet(f"{tmp_path}/nodes")
    monkeypatch.setattr(near_texts, "BROADCAST_ROWS", rows)
    pairs, crowded = near_texts.candidates(spark.read.parquet(f"{tmp_path}/nodes"), 3, 10)
    assert exploded_broadcasts(pairs) == [] == exploded_broadcasts(crowded)
    alike = {(a, b) for a, _, x in made for b, _, y in made if a < b and any(p == q and sum(z[i] == p for _, _, z in made) <= 10 for i, (p, q) in enumerate(zip(x, y)))}
    assert alike <= {(r["u"], r["v"]) for r in pairs.collect()}


def _flip(x, bits):
    for b in bits:
        x ^= 1 << b
    return x


def test_components_of_a_chain_and_a_star(spark):
    rows = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(7, 7), (300, 300), (None, 4)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "u bigint, v bigint")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 5 for k in range(5, 40)} | {300: 300}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_fingerprint_in_slices_is_the_same(monkeypatch):
    text = "the of and or " * 200
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("hot", [2, 32])
def test_pipeline_stage_drops_texts_of_five_word_jaccard_08(spark, hot):
    rnd = random.Random(12)
    draw = lambda: f"w{rnd.randrange(10**6)}"
    texts = list(ODD)
    for _ in range(40):
        words = [draw() for _ in range(200)]
        for changed in (0, 2, 4, 7):
            edited = list(words)
            for at in range(changed):
                edited[10 + 25 * at] = draw()
            texts.append(" ".join(edited))
    got = sorted(r["doc_id"] for r in near_texts.representatives(docs(spark, texts), hot=hot).select("doc_id").collect())
    assert got == least_of_groups(texts)
    assert near_texts.representatives(docs(spark, [])).count() == 0


def least_of_groups(texts):
    """The least index of each group of texts connected by a five-word Jaccard similarity of 0.8."""
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in ((t or "").encode().lower().split() for t in texts)]
    groups = list(range(len(sets)))

    def find(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                groups[max(x, y)] = min(x, y)
    return sorted({find(x) for x in range(len(sets))})


@pytest.mark.parametrize("hot", [2, 32])
def test_texts_with_a_common_part_lose_no_link(spark, hot):
    """Pairs at 0.82 whose texts all share a part: one hot bucket holds many groups."""
    rnd = random.Random(13)
    draw = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    common, texts = draw(240), []
    for _ in range(60):
        own = draw(50)
        for _ in range(2):
            texts.append(" ".join([*own, *common, *draw(26)]))
    got = sorted(r["doc_id"] for r in near_texts.representatives(docs(spark, texts), hot=hot).select("doc_id").collect())
    assert got == least_of_groups(texts) and len(got) == 60


def test_joining_links_join_what_all_links_would():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        base = [rnd.choice(400, 40, replace=False) for _ in range(4)]
        sets = [np.unique(np.where(rnd.random(40) < 0.08, rnd.integers(0, 400, 40), base[k % 4])).astype(np.int64) for k in range(24)] + [np.zeros(0, np.int64)]
        groups = [int(rnd.integers(0, 20)) for _ in sets]
        alike = [(a, b) for a in range(24) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]

        def joined(links):
            root = list(groups)
            for a, b in links:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
            return root

        assert joined(near_texts.joining_links(sets, groups, 0.8)) == joined(alike)


