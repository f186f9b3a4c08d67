"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments, enough of them that two within the distance
differ by at most one bit in some segment. Each fingerprint enumerates the Hamming
ball of radius one in every segment, fetches the table's matches there, and whole
distances are verified. Components of the links are the near-duplicate groups.

A bucket with more than ``hot`` fingerprints is not joined pair by pair: its members
and probes meet at points of the remaining bits instead (one bit from a member, the
rest of the distance from its partner), and each point is a star around one member,
so the work stays linear in the bucket and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwright.llm.common import by_shuffle, map_texts, row_key, stored
from pickwright.llm.components import components

SLICE = 1 << 15


def digests(text: str | None, shingle: int) -> Iterator[bytes]:
    """XXH64 (seed 42) of all word shingles, repeats included, as joined digests of at most SLICE shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    n = max(1, len(words) - shingle + 1)
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    data, digest = b" ".join(words), xxhash.xxh64_digest
    for at in range(0, n, SLICE):
        yield b"".join([digest(data[a:b], 42) for a, b in zip(starts[at : min(n, at + SLICE)], stops[at : at + SLICE])])


def majority(parts: Iterable[bytes]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        n += len(h) // 8
        ones += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 majority bits over the XXH64 (seed 42) of all word shingles, repeats included, as a signed number."""
    return majority(digests(text, shingle))


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits): so many segments that one of them has at most one differing bit."""
    n = max(2, distance // 2 + 1)
    cuts = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(bits: list[int], radius: int) -> Column:
    """The Hamming ball around zero over the given bits, as an array of numbers."""
    balls = [sum(1 << b for b in flip) for r in range(radius + 1) for flip in combinations(bits, r)]
    return F.array(*[F.lit(_signed(m)).cast("long") for m in balls])


def _key(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit(_signed((1 << bits) - 1)))


def links(fps: DataFrame, distance: int = 3, hot: int = 256) -> DataFrame:
    """Edges (u, v) that connect all fingerprints ``fp`` within ``distance`` bits; distinct, non-null ``fp`` expected.

    Outside hot buckets every linked pair is an edge; inside, an edge leads to the star's centre. All edges are links.
    """
    parts, found = segments(distance), []
    tables = [fps.select(F.lit(k).alias("seg"), _key(F.col("fp"), a, n).alias("key"), "fp") for k, (a, n) in enumerate(parts)]
    table = tables[0]
    for t in tables[1:]:
        table = table.union(t)
    sizes = table.groupBy("seg", "key").agg(F.count("*").alias("n"))
    warm = stored(sizes.where(F.col("n") > hot).select("seg", "key"), "hot-buckets")
    any_hot = not warm.isEmpty()
    probes = [
        fps.select("fp", F.explode(_masks(list(range(n)), 1)).alias("mask")).select(F.lit(k).alias("seg"), _key(F.col("fp"), a, n).bitwiseXOR(F.col("mask")).alias("key"), F.col("fp").alias("u"), (F.col("mask") != 0).alias("moved"))
        for k, (a, n) in enumerate(parts)
    ]
    probe = probes[0]
    for p in probes[1:]:
        probe = probe.union(p)
    cold = table.join(warm, ["seg", "key"], "left_anti") if any_hot else table
    pair = (F.bit_count(F.col("u").bitwiseXOR(F.col("fp"))) <= distance) & (F.col("u") < F.col("fp"))
    pairs = by_shuffle(probe).join(cold, ["seg", "key"]).where(pair).select("u", F.col("fp").alias("v"))
    if not any_hot:
        return pairs
    members = stored(table.join(warm, ["seg", "key"]), "hot-members")
    callers = stored(probe.where("moved").join(warm, ["seg", "key"]).select("seg", "key", "u"), "hot-probes")
    for k, (a, n) in enumerate(parts):
        rest = [b for b in range(64) if not a <= b < a + n]
        strip = F.lit(_signed(sum(1 << b for b in rest)))

        def points(df: DataFrame, fp: str, radius: int, k=k, rest=rest, strip=strip) -> DataFrame:
            own = df.where(F.col("seg") == k).select("key", F.col(fp).alias("u"), F.explode(_masks(rest, radius)).alias("mask"))
            return own.select("key", "u", F.col("u").bitwiseAND(strip).bitwiseXOR(F.col("mask")).alias("point"))

        near = distance // 2
        centre = points(members, "fp", near).groupBy("key", "point").agg(F.min("u").alias("v"))
        arms = points(members, "fp", distance - near).union(points(callers, "u", distance - 1 - near))
        found.append(by_shuffle(arms).join(centre, ["key", "point"]).where("u <> v").select("u", "v").distinct())
    for f in found:
        pairs = pairs.union(f)
    return pairs


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, distance: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(__id, __h, fp) of every row, and for each fingerprint (__fp) its group (__root) and the group's least id."""
    own = docs.select(*row_key(doc_id, text), F.col(text).alias("__t"))
    fps = stored(map_texts(own, ["__id", "__h"], "__t", "fp bigint", lambda texts: {"fp": [fingerprint(t, shingle) for t in texts]}), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("__id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), distance, hot))
    named = stored(distinct.join(roots, distinct["fp"] == roots["node"], "left").select(F.col("fp").alias("__fp"), "first", F.coalesce("root", "fp").alias("__root")), "groups")
    best = named.groupBy(F.col("__root").alias("__r")).agg(F.min("first").alias("component_id"))
    return fps, named.join(best, F.col("__root") == F.col("__r")).select("__fp", "__root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3, hot: int = 256) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    The component id is the least id among all documents reachable over links. Null,
    empty and white texts share fingerprint zero. Rows with a null id take part and
    are named by the others; the id is null if no member has one. Repeated rows are
    kept; an empty table gives an empty result; other columns are ignored.
    """
    fps, groups = _grouped(docs, doc_id, text, shingle, distance, hot)
    return fps.join(groups, F.col("fp") == F.col("__fp")).select(F.col("__id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3, hot: int = 256) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group: that of the least id, null ids last, ties by a hash of the text."""
    fps, groups = _grouped(docs, doc_id, text, shingle, distance, hot)
    order = F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("i"), F.col("__h").alias("h"))
    heads = fps.join(groups, F.col("fp") == F.col("__fp")).groupBy("__root").agg(F.min(order).alias("o")).select(F.col("o")["i"].alias("__hid"), F.col("o")["h"].alias("__hh"))
    own = docs.select("*", *row_key(doc_id, text))
    kept = own.join(heads, own["__id"].eqNullSafe(heads["__hid"]) & (own["__h"] == heads["__hh"]), "left_semi")
    return kept.dropDuplicates(["__id", "__h"]).select(*docs.columns)
