"""Repeated-substring dedup over all suffixes of the corpus.

Every byte covered by a string of ``span`` bytes that starts anywhere else is removed.
Suffixes are compared through a sample, as in difference-cover sorting, but the cover is
set by content: in each window of ``span`` bytes the least of its ``GRAM``-byte grams is
sampled, so equal windows sample the same place whatever their position.

1. Starts with the same sample form a run. Runs whose sampled gram is unique are done.
2. A run's whole stretch gets a name; equal names mean that all its starts repeat.
3. Where a gram has several names, one run of each name is cut into blocks of up to
   ``BLOCK`` starts, aligned to the gram. The bytes that all starts of a block share,
   its core, take the place of the gram: blocks of unique core are done, blocks get
   names, and equal names mean that all their starts repeat.
4. Where a core has several names, the starts of one block of each name are compared
   by their own ``span`` bytes.

Names and windows are 96-bit hashes. No two rows of a group are paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pickwright.llm.common import broadcast_if, row_key, stored

SPAN, GRAM, BLOCK = 200, 64, 16
SLICE = 1 << 17
#: Rows that a Python worker holds before it hands them over.
HELD = 1 << 14
#: A table of lists by document is broadcast up to so many rows and, in all its lists, so many integers.
BROADCAST_ROWS, BROADCAST_INTS = 200_000, 8_000_000
_MASK = np.uint64((1 << 20) - 1)


def _table() -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.sha256(b"byte%d" % b).digest()[:8] for b in range(256)), "<u8").astype(np.uint64)


def _multipliers() -> list[np.uint64]:
    return [np.uint64(int.from_bytes(hashlib.sha256(b"step%d" % k).digest()[:8], "little") | 1) for k in range(6)]


_BYTE, _STEP = _table(), _multipliers()


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the 64 bytes from each place, by doubling."""
    h = _BYTE[b]
    for k, step in enumerate(_STEP):
        w = 1 << k
        h = h[:-w] * step + h[w:]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x9E3779B97F4A7C15)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, from block-wise running minima."""
    n = len(v) - w + 1
    full = np.full(-(-len(v) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(v)] = v
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def runs(data: bytes, span: int = SPAN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first start, number of starts, sampled gram's hash) of each run, slice by slice; a slice's end may cut a run, which only adds a name."""
    for at in range(0, len(data) - span + 1, SLICE):
        h = gram_hashes(np.frombuffer(data[at : at + SLICE + span - 1], np.uint8))
        packed = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
        sample = (sliding_min(packed, span - GRAM + 1) & _MASK).astype(np.int64)
        first = np.r_[0, np.flatnonzero(np.diff(sample)) + 1]
        yield at + first, np.diff(np.r_[first, len(sample)]), h[sample[first]].view(np.int64)


def _name(data: bytes) -> tuple[int, int]:
    """96 bits of a hash, as a signed 64-bit number and a non-negative 31-bit one (one bit is left out)."""
    from xxhash import xxh3_128_intdigest

    digest = xxh3_128_intdigest(data)
    hi = digest >> 64
    return hi - (hi >> 63 << 64), digest & 0x7FFFFFFF


def blocks(data: bytes, s: int, k: int, span: int = SPAN) -> Iterator[tuple[int, int, bytes]]:
    """(first start, number of starts, core) of each block of a run.

    A start lies 0 or more bytes before the run's gram; a block holds those of one
    multiple of ``BLOCK``, so its core depends on the bytes around the gram alone.
    """
    h = gram_hashes(np.frombuffer(data[s : s + span], np.uint8))
    gram = s + int(np.argmin(h & ~_MASK))
    block = min(BLOCK, span)
    for j in range((gram - s) // block, (gram - s - k + 1) // block - 1, -1):
        first, last = max(s, gram - j * block - block + 1), min(s + k - 1, gram - j * block)
        yield first, last - first + 1, data[gram - j * block : gram - j * block - block + 1 + span]


def _rows(df: DataFrame, keep: list[str], schema: str, make: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Columns ``keep`` beside the rows that ``make`` gives for the bytes of ``__t`` and any columns after it.

    ``make`` yields columns piece by piece, so a worker holds one Arrow batch of texts and few rows, however long a text is.
    """
    made = T._parse_datatype_string(schema)
    names, kinds = [*keep, *made.names], [to_arrow_type(f.dataType) for f in made]

    def handed(batch: pa.RecordBatch, pieces: list[tuple[int, tuple]]) -> pa.RecordBatch:
        at = np.repeat([n for n, _ in pieces], [len(cols[0]) for _, cols in pieces])
        keys = [batch.column(k).take(pa.array(at)) for k in range(len(keep))]
        cols = [pa.array(np.concatenate([np.asarray(cols[k], kind.to_pandas_dtype()) for _, cols in pieces])) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*keys, *cols], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, held = [], 0
            for n in range(batch.num_rows):
                text, *rest = (c[n].as_py() for c in batch.columns[len(keep) :])
                for cols in make(text.encode(), *rest):
                    pieces.append((n, cols))
                    held += len(cols[0])
                    if held >= HELD:
                        yield handed(batch, pieces)
                        pieces, held = [], 0
            if pieces:
                yield handed(batch, pieces)

    return df.mapInArrow(run, T.StructType([*df.select(*keep).schema, *made]))


def run_rows(data: bytes, span: int) -> Iterator[tuple]:
    """(g, a, b, s, k) of all runs: gram, name, first start, starts."""
    for start, n, gram in runs(data, span):
        named = [_name(data[s : s + k + span - 1]) for s, k in zip(start.tolist(), n.tolist(), strict=True)]
        yield gram, [a for a, _ in named], [b for _, b in named], start, n


def block_rows(data: bytes, todo: list[int], span: int) -> Iterator[tuple]:
    """(copies, g, a, b, s, k) of the blocks of the runs listed as (first start, starts, copies); g is a hash of the core."""
    for at, many, copies in zip(todo[::3], todo[1::3], todo[2::3], strict=True):
        for s, k, core in blocks(data, at, many, span):
            a, b = _name(data[s : s + k + span - 1])
            yield copies, _name(core)[0], a, b, s, k


def window_rows(data: bytes, todo: list[int], span: int) -> Iterator[tuple]:
    """(start, wa, wb) of the starts of the blocks listed likewise."""
    for at, many in zip(todo[::3], todo[1::3], strict=True):
        for s in range(at, at + many):
            yield s, *_name(data[s : s + span])


def _small(df: DataFrame, lists: str) -> DataFrame:
    """Hint a broadcast only within both bounds, counted; a larger table is left to a shuffled join."""
    ints = df.agg(F.sum(F.size(lists))).first()[0] or 0
    return broadcast_if(df, BROADCAST_ROWS) if ints <= BROADCAST_INTS else df


def _of_open(docs: DataFrame, still_open: DataFrame, schema: str, rows, span: int) -> DataFrame:
    """What ``rows`` makes of each document's text and its open stretches, beside __id and __h.

    Rows with equal id and text all give rows; their stretches are of repeated names, whose number beyond one plays no part.
    """
    listed = still_open.groupBy(F.col("i").alias("__cid"), F.col("h").alias("__ch")).agg(F.flatten(F.collect_list(F.array("s", "k", F.least("n", F.lit(2)).cast("int")))).alias("todo"))
    side = _small(stored(listed, "open"), "todo")
    held = docs.join(side, docs["__id"].eqNullSafe(side["__cid"]) & (docs["__h"] == side["__ch"])).select("__id", "__h", "__t", "todo")
    return _rows(held, ["__id", "__h"], schema, lambda data, todo: (tuple(zip(*part, strict=True)) for part in batched(rows(data, todo, span), HELD)))


def _settle(rows: DataFrame, span: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Stretches (__id, __h, start, stop) of repeated name, and one stretch (n, i, h, s, k) of each name whose key ``g`` has several names, not all of them repeated."""
    place = F.struct(F.col("__id").alias("i"), F.col("__h").alias("h"), "s", "k")
    names = stored(rows.groupBy("g", "a", "b").agg(F.sum("copies").alias("n"), F.min(place).alias("p")), label)
    mixed = names.groupBy(F.col("g").alias("__g")).agg(F.count("*").alias("names"), F.min("n").alias("least")).where("names > 1 and least = 1").select("__g")
    still_open = names.join(mixed, F.col("g") == F.col("__g"), "left_semi").select("n", "p.*")
    whole = names.where("n > 1").select(F.col("g").alias("__g"), F.col("a").alias("__a"), F.col("b").alias("__b"))
    full = rows.join(whole, (F.col("g") == F.col("__g")) & (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")), "left_semi")
    return full.select("__id", "__h", F.col("s").alias("start"), (F.col("s") + F.col("k") + span - 1).alias("stop")), still_open


def repeated(docs: DataFrame, span: int) -> DataFrame:
    """(__id, __h, start, stop) of stretches all of whose windows repeat. ``docs`` has __id, __h, __t, ``copies`` (rows that are this document)."""
    grams = _rows(docs.select("copies", "__t"), ["copies"], "g bigint", lambda data: ((gram,) for _, _, gram in runs(data, span)))
    often = grams.groupBy("g").agg(F.sum("copies").alias("n")).where("n > 1").select(F.col("g").alias("__g"))
    every = _rows(docs.select("__id", "__h", "copies", "__t"), ["__id", "__h", "copies"], "g bigint, a bigint, b int, s int, k int", lambda data: run_rows(data, span))
    some = stored(every.join(often, F.col("g") == F.col("__g"), "left_semi"), "runs")
    by_run, open_runs = _settle(some, span, "run-names")
    parts = stored(_of_open(docs, open_runs, "copies bigint, g bigint, a bigint, b int, s int, k int", block_rows, span), "blocks")
    by_block, open_blocks = _settle(parts, span, "block-names")
    windows = stored(_of_open(docs, open_blocks, "start int, wa bigint, wb int", window_rows, span), "windows")
    twice = windows.groupBy(F.col("wa").alias("__wa"), F.col("wb").alias("__wb")).agg(F.count("*").alias("n")).where("n > 1").select("__wa", "__wb")
    hits = windows.join(twice, (F.col("wa") == F.col("__wa")) & (F.col("wb") == F.col("__wb")), "left_semi")
    by_window = hits.select("__id", "__h", "start", (F.col("start") + span).alias("stop"))
    return by_run.unionByName(by_block).unionByName(by_window)


def merge(spans: list[tuple[int, int]]) -> list[int]:
    """Start and end of every maximal stretch, one after the other; stretches that touch are one."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def _merged(found: DataFrame) -> DataFrame:
    """(__cid, __ch, spans): the merged stretches of each document."""
    listed = found.groupBy(F.col("__id").alias("__cid"), F.col("__h").alias("__ch")).agg(F.collect_list("start").alias("a"), F.collect_list("stop").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merge(list(zip(a, b, strict=True))) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(spans, pa.list_(pa.int32()))], names=["__cid", "__ch", "spans"])

    kind = found.schema["__id"].dataType.simpleString()
    return listed.mapInArrow(run, f"__cid {kind}, __ch bigint, spans array<int>")


def cut(data: bytes, spans: list[int]) -> tuple[bytes, int, int]:
    """What is left, bytes removed, maximal removed stretches."""
    edges = [0, *spans, len(data)]
    left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return left, len(data) - len(left), len(spans) // 2


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary; a cut may split a character).

    Null and empty texts have no bytes. Rows with equal id and text are copies of each
    other like any two documents; null ids are values like any other; an empty table
    gives an empty result; other columns are ignored.
    """
    if span < GRAM + 1:
        raise ValueError(f"span must be more than {GRAM}")
    own = docs.select(F.col(doc_id).alias("doc_id"), *row_key(doc_id, text), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    copies = own.groupBy("__id", "__h").agg(F.count("*").alias("copies")).where("copies > 1")
    copies = broadcast_if(stored(copies.select(F.col("__id").alias("__cid"), F.col("__h").alias("__ch"), "copies"), "copies"), BROADCAST_ROWS)
    several = own.join(copies, own["__id"].eqNullSafe(copies["__cid"]) & (own["__h"] == copies["__ch"]), "left")
    found = repeated(several.select("__id", "__h", "__t", F.coalesce("copies", F.lit(1)).alias("copies")), span)
    by_doc = _small(stored(_merged(found), "repeats"), "spans")
    joined = own.join(by_doc, own["__id"].eqNullSafe(by_doc["__cid"]) & (own["__h"] == by_doc["__ch"]), "left").select("doc_id", "__t", "spans")
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rest = [], []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = t.encode()
                left, removed, count = cut(data, spans or [])
                sizes.append((len(data), removed, count))
                rest.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in sizes], pa.int64()) for k in range(3)], pa.array(rest, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
