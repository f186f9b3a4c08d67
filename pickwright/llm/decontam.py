"""Benchmark decontamination with a distributed positional inverted index.

DataFrame expressions only. Test windows are ``span`` consecutive words of an item, or
the whole of a shorter item. The corpus is counted for the terms of the test side; every
window then looks up its two rarest terms. Postings (term, document, position) are stored
for those terms, offset-adjusted lists of the rarest are intersected with the next, and
what survives is compared word by word where the document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwright.llm.common import ascii_lower, bound, broadcast_if, by_shuffle, row_key, stored

SPAN = 10
#: Word separators after lower-casing A-Z: ASCII other than digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Test-side tables of at most so many rows are broadcast, after counting; each row holds at most ``span`` words.
BROADCAST_ROWS = 200_000


def words(text: str) -> Column:
    return F.array_remove(F.split(ascii_lower(F.col(text)), SEPARATORS), "")


def test_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(phrase, n, items): every distinct window with its word count and the sorted ids (as text) of the items that have it.

    Null or wordless texts have no window; a null id is the empty text.
    """
    items = bound(benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("t")), w=words("t")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - span + 1, F.lit(1)))
    one = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, span))).alias("win"))
    return one.groupBy(F.array_join("win", " ").alias("phrase")).agg(F.max(F.size("win")).alias("n"), F.array_sort(F.collect_set("item")).alias("items"))


def term_counts(docs: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """(term, n): occurrences in all of ``docs`` of the given terms."""
    each = docs.select(F.explode(words(text)).alias("__w"))
    return each.join(broadcast_if(terms, BROADCAST_ROWS), F.col("__w") == F.col("term")).groupBy("term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, terms: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The index: (term, __id, __h, pos) for the given terms, positions from 0."""
    each = docs.select(*row_key(doc_id, text), F.posexplode(words(text)).alias("pos", "__w"))
    return each.join(broadcast_if(terms, BROADCAST_ROWS), F.col("__w") == F.col("term")).select("term", "__id", "__h", "pos")


def lookups(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows all of whose terms occur, with the rarest and the next rarest term and their offsets.

    Ties go by term, then offset. A window of one word looks itself up twice.
    """
    each = windows.select("phrase", "n", "items", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
    known = each.join(broadcast_if(counts.withColumnRenamed("n", "seen"), BROADCAST_ROWS), "term")
    ranked = known.groupBy("phrase").agg(F.max("n").alias("n"), F.max("items").alias("items"), F.array_sort(F.collect_list(F.struct("seen", "term", "off"))).alias("r"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.least(F.lit(1), F.size("r") - 1))
    return ranked.where(F.size("r") == F.col("n")).select(
        "phrase", "n", "items", first["term"].alias("t1"), first["off"].alias("o1"), second["term"].alias("t2"), second["off"].alias("o2")
    )


def meet(index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """(__id, __h, start, off_by, phrase, n, items): places where the two rarest terms stand as in the window, the second at most ``slop`` words off."""
    side = broadcast_if(windows, BROADCAST_ROWS)
    first = index.join(side, index["term"] == side["t1"]).select("__id", "__h", (F.col("pos") - F.col("o1")).alias("start"), "phrase", "n", "items", "t2", "o2")
    first = first.where("start >= 0")
    other = index.select(F.col("term").alias("__t"), F.col("__id").alias("__pid"), F.col("__h").alias("__ph"), F.col("pos").alias("__p"))
    same = (F.col("t2") == F.col("__t")) & F.col("__id").eqNullSafe(F.col("__pid")) & (F.col("__h") == F.col("__ph"))
    # every offset allowed is a join key, so a frequent term's places in one document don't meet pair by pair
    aimed = first.withColumn("off_by", F.explode(F.sequence(F.lit(-slop), F.lit(slop)))) if slop else first.withColumn("off_by", F.lit(0))
    place = F.col("start") + F.col("o2") + F.col("off_by")
    # postings of few terms are small files, not few rows
    return aimed.join(by_shuffle(other), same & (place == F.col("__p"))).select("__id", "__h", "start", "off_by", "phrase", "n", "items")


class Index:
    """Counts, lookups and stored postings of one corpus for one test set."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN):
        self.docs, self.doc_id, self.text = docs, doc_id, text
        windows = stored(test_windows(benchmark, item_id, item_text, span), "windows")
        terms = windows.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
        self.windows = stored(lookups(windows, stored(term_counts(docs, terms, text), "term-counts")), "lookups")
        wanted = self.windows.select(F.explode(F.array("t1", "t2")).alias("term")).distinct()
        self.index = stored(postings(docs, stored(wanted, "index-terms"), doc_id, text), "postings")

    def near(self, slop: int) -> DataFrame:
        """Proximity matches: ``doc_id``, ``start``, ``off_by``, ``phrase``, ``items``, one row per place and offset; off_by 0 is a place to verify."""
        found = meet(self.index, self.windows, slop)
        return found.distinct().select(F.col("__id").alias("doc_id"), "start", "off_by", "phrase", "items")

    def exact(self, keep: list[str] | None = None) -> DataFrame:
        """All rows of the documents: ``doc_id`` (or the columns ``keep``), ``n_words``, ``n_hit``, ``items`` (sorted), and ``spans`` of hit windows (start, n, phrase)."""
        place = F.struct("start", "n", "phrase", "items")
        by_doc = meet(self.index, self.windows).groupBy("__id", "__h").agg(F.collect_set(place).alias("__places"))
        by_doc = broadcast_if(stored(by_doc.select(F.col("__id").alias("__cid"), F.col("__h").alias("__ch"), "__places"), "places"), BROADCAST_ROWS // 10)
        ids = [F.col(c) for c in keep] if keep else [F.col(self.doc_id).alias("doc_id")]
        keep = keep or ["doc_id"]
        own = self.docs.select(*ids, *row_key(self.doc_id, self.text), words(self.text).alias("__w"))
        joined = own.join(by_doc, own["__id"].eqNullSafe(by_doc["__cid"]) & (own["__h"] == by_doc["__ch"]), "left")
        equal = F.filter("__places", lambda p: F.array_join(F.slice("__w", p["start"] + 1, p["n"]), " ") == p["phrase"])
        n_words = F.when(F.col("__w").isNull(), 0).otherwise(F.size("__w")).cast("long")
        seen = bound(joined.select(*keep, n_words.alias("n_words"), F.when(F.col("__places").isNotNull(), equal).alias("spans")), spans=F.coalesce("spans", F.array().cast("array<struct<start:int,n:int,phrase:string,items:array<string>>>")))
        hit = F.array_distinct(F.flatten(F.transform("spans", lambda p: F.sequence(p["start"], p["start"] + p["n"] - 1))))
        items = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda p: p["items"]))))
        return seen.select(*keep, "n_words", F.size(hit).cast("long").alias("n_hit"), items.alias("items"), F.transform("spans", lambda p: p.dropFields("items")).alias("spans"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: the columns of ``Index.exact`` and ``contaminated`` (n_hit > 0).

    Null, empty and wordless texts have no words and no hits. Null ids are values like
    any other, repeated rows give repeated results, an empty table on either side gives
    no hits; other columns are ignored.
    """
    return Index(docs, benchmark, doc_id, text, item_id, item_text, span).exact(keep).withColumn("contaminated", F.col("n_hit") > 0)
