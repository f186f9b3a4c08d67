"""The registered query of each operator, at production parameters over the whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwright.llm import bpe, conversation, decontam, language, line_dedup, merkle, pii, quality, secret_scan, simhash, suffix_dedup, token_counts, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_docs(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


OP1_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, l[i] AS x, l[i + 1] AS y, l[i + 2] AS z
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d)),
later AS (SELECT doc_id, i FROM w WHERE trim(x || y || z) <> '' QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, i) > 1),
cut AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM later),
lines AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL) AS text, count(*) AS n_lines, count(c.i) AS n_removed
  FROM lines l LEFT JOIN cut c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.l IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_docs(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_docs(spark, sf_dir))


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_docs(spark, sf_dir), _vocabulary("word_bpe_49k.json"), ["doc_id"])


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.private_spans(_docs(spark, sf_dir))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.PATTERNS]
    spans = F.concat("base", "terms")
    return found.select("doc_id", *counts, F.sha2(pii.joined_spans(F.col("base")), 256).alias("base_sha256"), pii.joined_spans(spans).alias("spans"))


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(_docs(spark, sf_dir))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_docs(spark, sf_dir))
    base = [r.kind for r in secret_scan.RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    counts = [F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in base]
    own = F.filter("found", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT p.doc_id, p.i, s.n, array_to_string(p.w[p.i:p.i + s.n - 1], ' ') AS phrase FROM p JOIN (SELECT DISTINCT n FROM win) s ON p.i + s.n - 1 <= len(p.w)),
m AS (SELECT g.doc_id, g.i, g.n, win.item FROM g JOIN win ON g.phrase = win.phrase AND g.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = merkle.verified(_docs(spark, sf_dir))
    return told.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hurt = conversation.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    told = conversation.digests(conversation.repair(hurt))
    return told.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_quality, op4_language, op5_bpe_roundtrip, op6_private_data, op7_repeated_bytes, op8_simhash, op9_secrets, op10_decontamination, op11_manifest, op12_conversations, op13_toxicity)}
ORACLES = {"op1_line_dedup": OP1_SQL, "op10_decontamination": OP10_SQL}
