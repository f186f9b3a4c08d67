"""Merkle manifest of a table: checkpointed levels, proofs from regenerated subtrees.

Leaves of a group are numbered in order and packed into aligned subtrees of 2**STRIDE
nodes, one row each. Only levels 0, STRIDE, 2 * STRIDE ... are written. A proof is read
off downwards: each packed row regenerates the interior nodes below its root from the
stored nodes, hands every node its siblings beside those of the root, and drops the rest.
A subtree is one row, so no group is gathered, however many leaves it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pickwright.llm.common import broadcast_if, stored

#: Two stored levels are so many levels apart.
STRIDE = 10


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def parents(nodes: list[str]) -> list[str]:
    return [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def climb(nodes: list[str], width: int, most: int) -> tuple[list[list[str]], int]:
    """Levels above ``nodes``, itself first, until ``most`` levels are made or the tree's level is one node wide; that width."""
    levels = [nodes]
    while width > 1 and len(levels) <= most:
        levels.append(parents(levels[-1]))
        width = (width + 1) // 2
    return levels, width


def sibling(levels: list[list[str]], at: int) -> Iterator[str]:
    """Siblings of node ``at`` of the lowest level, upwards. A lone last node has none."""
    for nodes in levels[:-1]:
        if at ^ 1 < len(nodes):
            yield nodes[at ^ 1]
        at >>= 1


def fold(leaf: str, proof: list[str], steps: list[tuple[int, int]]) -> str:
    """The root from a leaf and its siblings; ``steps`` are (place, width of the tree's lowest level) of each tree on the way."""
    left = iter(proof)
    for at, width in steps:
        while width > 1:
            if at ^ 1 < width:
                other = next(left)
                leaf = digest(other, leaf) if at & 1 else digest(leaf, other)
            else:
                leaf = digest(leaf)
            at, width = at >> 1, (width + 1) // 2
    return leaf


def field(c: Column, text: bool) -> Column:
    own = c if text else c.cast("string")
    return F.coalesce(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own), F.lit("-"))


def leaf_of(*fields: Column) -> Column:
    return F.sha2(F.concat(*fields), 256)


def _numbered(nodes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``nodes`` beside ``at``, the place in the group by ``order``, and ``width``, the group's size. Nulls come first.

    Rows are dealt by ranges of group and order, so a group may cover any number of
    partitions; a place is the partition's offset in the group and a count in the partition.
    """
    keep = nodes.columns
    sorted_ = nodes.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    slots = [keep.index(c) for c in group]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for key in zip(*[batch.column(s).to_pylist() for s in slots], strict=True):
                n, last = (n + 1 if key == last else 0), key
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*keep, "__part", "__n"])

    out = T.StructType([*nodes.schema, T.StructField("__part", T.IntegerType()), T.StructField("__n", T.LongType())])
    placed = stored(sorted_.mapInArrow(count, out), "leaves")
    sizes = placed.groupBy(*group, "__part").agg(F.count("*").alias("__size"))  # a row for each group and partition that meet
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # a group has at most as many rows here as the shuffle has partitions
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).withColumn("width", F.sum("__size").over(Window.partitionBy(*group)))
    offsets = offsets.select(*[F.col(c).alias(f"__g{k}") for k, c in enumerate(group)], F.col("__part").alias("__p"), "__before", "width")
    same = [F.col(c).eqNullSafe(F.col(f"__g{k}")) for k, c in enumerate(group)]
    joined = placed.join(broadcast_if(offsets, 200_000), [*same, F.col("__part") == F.col("__p")])
    return joined.select(*keep, (F.col("__before") + F.col("__n")).alias("at"), "width")


class Manifest:
    """Trees over the groups of a table, and a tree over their roots.

    ``nodes``: ``group``, ``order``, ``leaf`` (hex digest) and payload columns. ``trees`` has a
    row per group: the group, ``subroot``, its place among the groups and the ``path`` from it
    to the root, which is a column too. Equal rows are leaves of their own, in order of the digest.
    """

    def __init__(self, nodes: DataFrame, group: str, order: list[str], payload: list[str], stride: int = STRIDE):
        self.group, self.stride = group, stride
        self.levels = self._built(nodes.select(group, "leaf", *payload), [group], [*order, "leaf"], payload)
        tops = self._tops(self.levels, [group])
        upper = self._built(tops.select(F.lit(0).alias("__all"), F.col(group).alias("__name"), F.col("node").alias("leaf")), ["__all"], ["__name"], ["__name"])
        root = self._tops(upper, ["__all"]).select("__all", F.col("node").alias("root"), F.array().cast("array<string>").alias("path"))
        told = self._paths(upper, ["__all"], root.select("__all", "path", "root"), ["root"])
        below = told.select("root", "width", F.inline(F.arrays_zip("at", "leaves", "__name", "proofs")))
        trees = below.select(F.col("__name").alias(group), F.col("leaves").alias("subroot"), "root", F.array(F.struct("at", "width")).alias("above"), F.col("proofs").alias("path"))
        self.trees = stored(trees, "trees")

    def _built(self, nodes: DataFrame, group: list[str], order: list[str], payload: list[str]) -> list[DataFrame]:
        """Packed rows of levels 0, STRIDE, ...: group, ``block``, ``width`` (of the level), ``leaves`` and, at level 0, payload lists."""
        stride, levels = self.stride, []
        now = _numbered(nodes, group, order)
        while True:
            extra = payload if not levels else []
            packed = now.groupBy(*group, F.shiftright("at", stride).alias("block")).agg(F.first("width").alias("width"), F.array_sort(F.collect_list(F.struct("at", "leaf", *extra))).alias("__all_rows"))  # at most 2**stride rows
            cols = [F.col("__all_rows.leaf").alias("leaves"), *[F.col(f"__all_rows.{c}").alias(c) for c in extra]]
            levels.append(stored(packed.select(*group, "block", "width", *cols), "level"))
            above = self._above(levels[-1], group)
            if above.where("width > 1").limit(1).count() == 0:
                return levels
            now = above.where("width > 1").select(*group, F.col("block").alias("at"), "width", F.col("node").alias("leaf"))

    def _above(self, level: DataFrame, group: list[str]) -> DataFrame:
        """The root of every packed row, and the width of its level."""
        stride = self.stride
        rows = level.select(*group, "block", "width", "leaves")
        fields = level.select(*group).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tops, widths = [], []
                for nodes, width in zip(batch.column("leaves"), batch.column("width").to_pylist(), strict=True):
                    levels, left = climb(nodes.as_py(), width, stride)
                    tops.append(levels[-1][0])
                    widths.append(left)
                cols = [batch.column(i) for i in range(len(fields) + 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(widths, pa.int64()), pa.array(tops, pa.string())], names=[*fields.names, "block", "width", "node"])

        out = T.StructType([*fields, T.StructField("block", T.LongType()), T.StructField("width", T.LongType()), T.StructField("node", T.StringType())])
        return rows.mapInArrow(run, out)

    def _tops(self, levels: list[DataFrame], group: list[str]) -> DataFrame:
        """(group, node): the root of every group; its level is the first whose rows reach a width of one."""
        found = None
        for level in levels:
            top = self._above(level, group).where("width = 1").select(*group, "node")
            found = top if found is None else found.unionByName(top)
        return found

    def _paths(self, levels: list[DataFrame], group: list[str], tops: DataFrame, carried: list[str]) -> DataFrame:
        """Level 0 beside ``proofs``, for every leaf its siblings and those of the nodes above up to ``tops.path``; ``at`` is a leaf's place.

        ``tops``: group, ``path`` and ``carried`` columns of every group. They are handed down level by
        level, one row to one packed row, so a group with most of the rows is no hot key.
        """
        names = [f"__g{k}" for k in range(len(group))]
        came = None  # (group, block, path, carried) for packed rows of the level at hand
        for depth in range(len(levels) - 1, -1, -1):
            level = levels[depth]
            widths = F.ceil(F.col("width") / float(1 << self.stride))  # packed rows of a group at this level
            single = level.where(widths <= 1)  # the whole level is one packed row, so its root is the group's
            start = tops.select(*[F.col(c).alias(n) for c, n in zip(group, names, strict=True)], *[c for c in tops.columns if c not in group])
            start_at = single.join(start, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(group, names, strict=True)]).drop(*names)
            if came is not None:
                renamed = came.select(*[F.col(c).alias(n) for c, n in zip(group, names, strict=True)], F.col("block").alias("__b"), "path", *carried)
                rest = level.where(widths > 1).join(renamed, [F.col("block") == F.col("__b"), *[F.col(c).eqNullSafe(F.col(n)) for c, n in zip(group, names, strict=True)]]).drop(*names, "__b")
                start_at = start_at.unionByName(rest)
            told = self._told(start_at)
            if depth == 0:
                return told
            down = told.select(*group, *carried, F.inline(F.arrays_zip("at", "proofs")))
            came = stored(down.select(*group, F.col("at").alias("block"), F.col("proofs").alias("path"), *carried), "paths")
        raise AssertionError("there is always a level 0")

    def _told(self, rows: DataFrame) -> DataFrame:
        """``rows`` (packed, with ``path``) beside ``at`` and ``proofs`` lists; interior nodes live only inside this map."""
        stride, names = self.stride, [c for c in rows.columns if c != "path"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):  # a packed row at a time: its proofs are the largest thing held
                    one = batch.slice(i, 1)
                    nodes, block = one.column("leaves")[0].as_py(), one.column("block")[0].as_py()
                    levels, _ = climb(nodes, one.column("width")[0].as_py(), stride)
                    path = one.column("path")[0].as_py()
                    proofs = [[*sibling(levels, k), *path] for k in range(len(nodes))]
                    at = [(block << stride) + k for k in range(len(nodes))]
                    yield pa.RecordBatch.from_arrays([*[one.column(c) for c in names], pa.array([at], pa.list_(pa.int64())), pa.array([proofs], pa.list_(pa.list_(pa.string())))], names=[*names, "at", "proofs"])

        out = T.StructType([*rows.select(*names).schema, *T._parse_datatype_string("at array<bigint>, proofs array<array<string>>")])
        return rows.mapInArrow(run, out)

    def proofs(self, payload: list[str]) -> DataFrame:
        """A row per leaf: group, payload, ``leaf``, ``subroot``, ``root``, ``steps`` (place and width in both trees) and ``proof``, siblings upwards."""
        told = self._paths(self.levels, [self.group], self.trees.select(self.group, "path", "subroot", "root", "above"), ["subroot", "root", "above"])
        flat = told.select(self.group, "subroot", "root", "above", "width", F.inline(F.arrays_zip("at", F.col("leaves").alias("leaf"), *payload, F.col("proofs").alias("proof"))))
        return flat.withColumn("steps", F.concat(F.array(F.struct("at", "width")), "above")).drop("above", "at", "width")


def _row_leaf(n_chars: Column) -> Column:
    return leaf_of(field(F.col("doc_id"), False), field(F.col("source"), True), field(F.col("lang"), True), field(n_chars, False), field(F.col("text"), True))


def manifest(docs: DataFrame, stride: int = STRIDE) -> Manifest:
    """The manifest of ``documents``: a tree per lang, leaves by doc_id, nulls first; other columns are ignored.

    Rows of one doc_id are leaves of their own, ordered by digest. ``tampered`` is the leaf
    with one added to n_chars where seven divides the crc32 of the doc_id, and null elsewhere.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    own = docs.select("doc_id", "lang", _row_leaf(F.col("n_chars")).alias("leaf"), F.when(chosen, _row_leaf(F.col("n_chars").cast("decimal(20,0)") + 1)).alias("tampered"))
    return Manifest(stored(own, "digests"), "lang", ["doc_id"], ["doc_id", "tampered"], stride)


def verified(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``leaf``, ``subroot``, ``root``, ``proof`` (siblings upwards), ``folded_root``, ``verified``.

    ``folded_root`` is recomputed from the tampered leaf, or else the leaf, and the untampered
    siblings. A null n_chars stays null, so such a row verifies. An empty table has no rows.
    """
    rows = manifest(docs, stride).proofs(["doc_id", "tampered"]).drop("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("leaf", "tampered", "proof", "steps")}
            folded = [fold(t or x, p, [(s["at"], s["width"]) for s in steps]) for x, t, p, steps in zip(c["leaf"], c["tampered"], c["proof"], c["steps"], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("doc_id", "leaf", "subroot", "root", "proof")], pa.array(folded, pa.string())], names=["doc_id", "leaf", "subroot", "root", "proof", "folded_root"])

    kinds = rows.schema
    out = T.StructType([*[kinds[n] for n in ("doc_id", "leaf", "subroot", "root", "proof")], T.StructField("folded_root", T.StringType())])
    return rows.mapInArrow(run, out).withColumn("verified", F.col("folded_root") == F.col("root"))
