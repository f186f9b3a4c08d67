"""Token counts: lengths only, in byte-balanced batches, long texts cut at safe boundaries.

A cut is safe before a single space with no white space on either side: the
pre-tokenizer never matches across it (a space only starts a match), and added
tokens hold no white space. The sum over the pieces is then the count of the text.
Word-sized pieces repeat, so each worker keeps a bounded table of their counts and
sends only unseen ones, in batches of bounded bytes, through the tokenizer.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwright.llm.common import map_texts, per_process

BATCH_BYTES = 1 << 18
TABLE_ENTRIES = 400_000
_ODD_SPACE = re.compile(r"\s[ ]|[ ]\s|\A[ ]|[ ]\Z")
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def pieces(text: str) -> list[str]:
    """Cut at every safe boundary; the pieces joined give the text."""
    if not _ODD_SPACE.search(text):
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]
    return _SAFE.split(text)


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def count_batch(texts: list[str | None], path: str, batch_bytes: int = BATCH_BYTES, entries: int = TABLE_ENTRIES) -> list[int]:
    """Token counts of whole texts."""
    tokenizer, table = per_process(f"count:{path}", lambda: (_tokenizer(path), {}))
    counts = []
    for text in texts:
        cut = pieces(text) if text else []
        unseen = [p for p in set(cut) if p not in table]
        if len(table) + len(unseen) > entries:
            table.clear()
            unseen = list(set(cut))
        batch, size = [], 0
        for p in [*unseen, None]:
            if batch and (p is None or size >= batch_bytes):
                table.update(zip(batch, map(len, tokenizer.encode_batch_fast(batch, add_special_tokens=False)), strict=True))
                batch, size = [], 0
            if p is not None:
                batch.append(p)
                size += 4 * len(p)
        counts.append(sum(map(table.__getitem__, cut)))
    return counts


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    Null and empty texts have 0 bytes and 0 tokens. Null ids stay null, repeated
    rows give repeated results, an empty table an empty result; other columns are ignored.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("__t"))
    counted = map_texts(base, ["doc_id", "n_bytes"], "__t", "n_tokens bigint", lambda texts: {"n_tokens": count_batch(texts, path)}, f"count:{path}")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
