"""Near-duplicate texts by the Jaccard similarity of their word shingles.

Candidates come from the SimHash search of ``simhash`` and from MinHash bands; both only
propose. A link is a pair whose exact Jaccard similarity of shingle sets (as 64-bit hashes)
reaches the bound. SimHash alone can't carry a bound of 0.8: such pairs differ in about ten
bits, often in fifteen, and segments for fifteen bits let every fourth pair of a corpus meet.

All pairs of a bucket are compared. In one of more than ``hot`` texts each is first compared with
the bucket's least and greatest, which joins most copies; whatever texts of the bucket are then
still in different groups are compared in blocks of bounded size, and of the links found only
as many are given out as it takes to join their ends. So no link between groups is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwright.llm import simhash
from pickwright.llm.common import broadcast_if, by_shuffle, map_texts, row_key, stored
from pickwright.llm.components import components

#: A pair at 0.8 shares no band with probability (1 - 0.8^ROWS)^BANDS = 0.002.
BANDS, ROWS = 16, 5
BROADCAST_ROWS, SALT_ROWS = 200_000, 512
#: Shingles of the texts of one block of a hot bucket, about.
BLOCK = 1 << 18


def shingle_set(parts: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(parts), "<u8"))


def bands(held: np.ndarray) -> list[int]:
    """Hashes of BANDS groups of ROWS minima of a set of hashes; none for an empty set."""
    import xxhash

    if not len(held):
        return []
    draw = np.random.default_rng(7)
    flip, times = draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64), draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(held), 1024):
        mixed = (held[at : at + 1024, None] ^ flip) * times
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    data = least.astype("<u8").tobytes()
    return [int.from_bytes(xxhash.xxh64_digest(data[8 * ROWS * k : 8 * ROWS * (k + 1)], k), "big", signed=True) for k in range(BANDS)]


def keys_batch(texts: list[str | None], shingle: int) -> dict[str, list]:
    import xxhash

    out: dict[str, list] = {"node": [], "fp": [], "bands": []}
    for t in texts:
        parts = list(simhash.digests(t, shingle))
        held = shingle_set(parts)
        out["node"].append(int.from_bytes(xxhash.xxh64_digest(held.tobytes(), 42), "big", signed=True))
        out["fp"].append(simhash.majority(parts))
        out["bands"].append(bands(held))
    return out


def sets_batch(texts: list[str | None], shingle: int) -> dict[str, list]:
    return {"held": [shingle_set(list(simhash.digests(t, shingle))).view("<i8").tolist() for t in texts]}


def candidates(nodes: DataFrame, distance: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs u < v of nodes that share a band or whose fingerprints are linked, and the rows (band, value, node) of hot buckets."""
    table = by_shuffle(nodes.select(F.col("node"), F.posexplode("bands").alias("band", "value")))
    sizes = table.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("n > 1")
    sizes = stored(sizes, "band-sizes")
    cold = table.join(broadcast_if(sizes.where(F.col("n") <= hot).select("band", "value"), BROADCAST_ROWS), ["band", "value"])
    pairs = cold.select("band", "value", F.col("node").alias("u")).join(cold.select("band", "value", F.col("node").alias("v")), ["band", "value"])
    ends = table.join(broadcast_if(sizes.where(F.col("n") > hot), BROADCAST_ROWS), ["band", "value"])
    stars = ends.select(F.col("node").alias("u"), F.explode(F.array("a", "b")).alias("v"))
    # one node stands for a fingerprint; the others that have it are compared with that node
    named = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprint-nodes")
    alike = nodes.join(named, "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    linked = simhash.links(named.select("fp"), distance).toDF("fu", "fv")
    by_fp = linked.join(named.toDF("fu", "u"), "fu").join(named.toDF("fv", "v"), "fv").select("u", "v")
    every = pairs.select("u", "v").union(stars).union(alike).union(by_fp).where("u <> v")
    return every.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), ends.select("band", "value", "node")


def joining_links(sets: list[np.ndarray], groups: list[int], similarity: float) -> list[tuple[int, int]]:
    """Of the pairs of sets with at least that Jaccard similarity so many as join the groups that all of them would join."""
    sizes = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets) if len(sets) else np.zeros(0, np.int64), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    full = sizes > 0  # an empty set has no band
    root, out = np.unique(groups, return_inverse=True)[1], []
    mark = np.zeros(int(flat.max(initial=-1)) + 1, np.int64)
    for i in range(len(sets) - 1):
        open_ = full & (root != root[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]))
        open_[: i + 1] = False
        if not full[i] or not open_.any():
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        for j in np.flatnonzero(open_):
            if root[j] != root[i]:
                both = int(mark[flat[starts[j] : starts[j] + sizes[j]]].sum())
                if both >= similarity * (sizes[i] + sizes[j] - both):
                    out.append((i, int(j)))
                    root[root == root[j]] = root[i]
        mark[own] = 0
    return out


def hot_links(hot: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links that join what is in one hot bucket but in different groups, (u, v).

    A bucket's texts are dealt to blocks: a group too large for a block fills blocks of its own, the others are mixed.
    Two blocks meet in one task, unless both are of one group; no pair of texts leaves it but a link.
    """
    told = hot.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    bucket = ["band", "value"]
    split = told.groupBy(*bucket).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(*bucket)
    own = stored(told.join(split, bucket).join(sets.select("node", F.size("held").alias("size")), "node"), "hot-texts")
    shares = own.groupBy(*bucket, "root").agg(F.sum("size").alias("held"))
    large = F.col("held") >= block
    rest = shares.groupBy(*bucket).agg(F.sum(F.when(large, 0).otherwise(F.col("held"))).alias("mixed"))
    count = F.when(large, F.ceil(F.col("held") / block)).otherwise(F.ceil((F.col("mixed") + 1) / block))
    plan = shares.join(rest, bucket).select(*bucket, "root", F.when(large, F.col("root")).alias("pure"), count.alias("blocks"))
    salt = F.when(F.col("pure").isNull(), F.xxhash64("root")).otherwise(F.xxhash64("node"))
    dealt = stored(own.join(plan, [*bucket, "root"]).select(*bucket, "node", "root", "pure", F.pmod(salt, F.col("blocks")).alias("block")), "hot-blocks")
    heads = dealt.select(*bucket, "pure", "block").distinct()
    heads = heads.withColumn("at", F.struct(F.coalesce("pure", F.lit(0)).alias("p"), F.col("pure").isNull().alias("m"), "block"))
    a, b = heads.select(*bucket, F.col("at").alias("a"), F.col("pure").alias("pa")), heads.select(*bucket, F.col("at").alias("b"), F.col("pure").alias("pb"))
    meets = a.join(b, bucket).where((F.col("a") <= F.col("b")) & ~F.coalesce(F.col("pa") == F.col("pb"), F.lit(False)))  # pairs of blocks, not of texts
    placed = dealt.withColumn("at", F.struct(F.coalesce("pure", F.lit(0)).alias("p"), F.col("pure").isNull().alias("m"), "block")).select(*bucket, "node", "root", "at")
    sides = meets.select(*bucket, "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("at")).join(placed, [*bucket, "at"])
    full = sides.join(sets, "node").select(*bucket, "a", "b", "node", "root", "held")

    def compare(key, rows):
        found = joining_links([np.asarray(x, np.int64) for x in rows["held"]], rows["root"].tolist(), similarity)
        ids = rows["node"].to_numpy()
        import pandas as pd

        return pd.DataFrame({"u": [ids[i] for i, _ in found], "v": [ids[j] for _, j in found]}, columns=["u", "v"]).astype("int64")

    return full.groupBy(*bucket, "a", "b").applyInPandas(compare, "u bigint, v bigint")


def similar(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges whose ends' sets have at least that Jaccard similarity. An end with many edges has its set once for every few hundred of them."""
    made = edges
    for end in ("u", "v"):
        many = edges.groupBy(F.col(end).alias("node")).agg((F.count("*") / SALT_ROWS).cast("int").alias("s")).where("s > 0")
        many = broadcast_if(stored(many, "busy-nodes"), BROADCAST_ROWS)
        other = F.col("v" if end == "u" else "u")
        made = made.join(many.select(F.col("node").alias(end), "s"), end, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("s", F.lit(0)) + 1)).drop("s")
        copies = sets.join(many, "node", "left").select(F.col("node").alias(end), F.col("held").alias(f"held_{end}"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("s", F.lit(0)).cast("bigint"))).alias("salt"))
        made = made.join(copies, [end, "salt"]).drop("salt")
    both = F.size(F.array_intersect("held_u", "held_v"))
    return made.where(both >= similarity * (F.size("held_u") + F.size("held_v") - both)).select("u", "v")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = 3, hot: int = 32) -> DataFrame:
    """One row of ``docs`` for each group of texts connected by links: that of the least id, null ids last, ties by a hash of the text.

    Words are split at ASCII white space, ASCII letters without case. A text of fewer
    words than a shingle is one shingle. Null, empty and white texts are one group.
    """
    own = docs.select(*row_key(doc_id, text), F.col(text).alias("__t"))
    made = stored(map_texts(own, ["__id", "__h"], "__t", "node bigint, fp bigint, bands array<bigint>", lambda texts: keys_batch(texts, shingle)), "text-keys")
    order = F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("i"), F.col("__h").alias("h"))
    nodes = stored(made.groupBy("node").agg(F.min(order).alias("o"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "text-nodes")
    pairs, crowded = candidates(nodes, distance, hot)
    edges = stored(pairs, "candidates")
    ends = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    wanted = stored(nodes.join(ends, "node").select("node", F.col("o")["i"].alias("__wid"), F.col("o")["h"].alias("__wh")), "candidate-texts")
    side = broadcast_if(wanted, BROADCAST_ROWS)
    held = own.join(side, own["__id"].eqNullSafe(side["__wid"]) & (own["__h"] == side["__wh"])).select("node", "__t")
    sets = stored(map_texts(held, ["node"], "__t", "held array<bigint>", lambda texts: sets_batch(texts, shingle)).dropDuplicates(["node"]), "shingle-sets")
    links = stored(similar(edges, sets, similarity), "links")
    roots = components(links).toDF("node", "root")
    crowded = stored(crowded, "crowded")
    if not crowded.isEmpty():
        more = stored(hot_links(crowded, stored(roots, "groups"), sets, similarity), "hot-links")
        roots = components(links.union(more)).toDF("node", "root")
    heads = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("g")).agg(F.min("o").alias("o")).select(F.col("o")["i"].alias("__hid"), F.col("o")["h"].alias("__hh"))
    keyed = docs.select("*", *row_key(doc_id, text))
    kept = keyed.join(heads, keyed["__id"].eqNullSafe(heads["__hid"]) & (keyed["__h"] == heads["__hh"]), "left_semi")
    return kept.dropDuplicates(["__id", "__h"]).select(*docs.columns)
