"""Information-theoretic sanitisation of personal data.

DataFrame expressions only. Patterns find the protected entities (e-mail and network
addresses, card and phone numbers). The corpus then says how much a term gives an
entity away: over lines, PMI(term; entity) against IC(entity). Where the share
PMI / IC reaches ``generalise_at`` the term is generalised beside that entity, where it
reaches ``remove_at`` it is removed. There is no least number of lines: an entity seen once is
scored like any other, and a pair only has to be unlikely to meet so often by accident.
Joint counts are over distinct lines, so copies of a document are one witness; counts of a term are over all lines, less the copies of joint ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwright.llm.common import bound, broadcast_if, row_key, stored

#: kind, pattern, and a cheap necessary condition. A match starts where a run starts, or
#: right after the match before (\G); runs are possessive, so time is linear in the text.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+", r"[0-9]{4}|[0-9][ -][0-9]"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
}
KINDS = [*PATTERNS, "term"]
TERM = r"\p{L}{3,}+"
#: A pair that independent lines would bring together as often with at least this probability tells nothing.
CHANCE = 1e-3
GENERALISE_AT, REMOVE_AT = 0.9, 0.99
BROADCAST_ROWS = 200_000
_STEP = 512
SPAN_TYPE = "array<struct<kind:string,start:int,stop:int,value:string>>"


def running(lengths: Column) -> Column:
    """Sum of the elements before each one, in blocks of 512, so that an array of any length takes near-linear time."""
    blocks = F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)).cast("int"), F.lit(_STEP))
    fold = lambda part, first: F.aggregate(part, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    heads = F.transform(blocks, lambda b: F.aggregate(F.slice(lengths, b + 1, _STEP), F.lit(0), lambda acc, x: acc + x))
    firsts = fold(heads, F.lit(0))
    inner = F.transform(blocks, lambda b: F.slice(fold(F.slice(lengths, b + 1, _STEP), F.get(firsts, (b / _STEP).cast("int"))), 1, F.least(F.lit(_STEP), F.size(lengths) - b)))
    return F.when(F.size(lengths) > 0, F.flatten(inner)).otherwise(F.array().cast("array<int>"))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        short = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        value = lambda p: F.when(short(p), F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).cast("int")).otherwise(256)
        return F.forall(F.split(m, r"\."), lambda p: value(p) <= 255)
    if kind == "card":
        digits = F.regexp_replace(m, "[ -]", "")
        return F.call_function("luhn_check", F.when(F.length(digits).between(16, 19), digits).otherwise("1"))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def find(df: DataFrame, text: str, kinds: list[str], name: str = "spans") -> DataFrame:
    """``df`` with ``name``: the spans of ``kinds`` in ``text`` by kind as listed, then start, in code points, end exclusive.

    A match starts after the gaps and matches before it; both come from one pattern.
    """
    parts = {}
    for k in kinds:
        pattern, needed = PATTERNS[k] if k in PATTERNS else (TERM, r"\p{L}{3}")
        has = F.col(text).rlike(needed)
        parts[f"__m_{k}"] = F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        parts[f"__g_{k}"] = F.when(has, F.split(text, pattern)).otherwise(F.array().cast("array<string>"))
    df = bound(df, **parts)
    # what lies between two starts: the match before and the gap
    steps = {f"__l_{k}": F.transform(f"__m_{k}", lambda m, i: F.length(F.get(F.col(f"__g_{k}"), i)) + F.when(i > 0, F.length(F.get(F.col(f"__m_{k}"), i - 1))).otherwise(0)) for k in kinds}
    df = bound(df, **steps)
    df = bound(df, **{f"__s_{k}": F.transform(running(F.col(f"__l_{k}")), lambda s, i: s + F.get(F.col(f"__l_{k}"), i)) for k in kinds})
    spans = [
        F.filter(
            F.transform(f"__m_{k}", lambda m, i: F.struct(F.lit(k).alias("kind"), F.get(F.col(f"__s_{k}"), i).alias("start"), (F.get(F.col(f"__s_{k}"), i) + F.length(m)).alias("stop"), m.alias("value"))),
            lambda s: _valid(k, s["value"]),
        ).cast(SPAN_TYPE)
        for k in kinds
    ]
    kept = [c for c in df.columns if not c.startswith("__m_") and not c.startswith("__g_") and not c.startswith("__l_") and not c.startswith("__s_")]
    return bound(df, **{name: F.concat(*spans)}).select(*kept, name)


def entity_lines(found: DataFrame) -> DataFrame:
    """(__id, __h, at, line, own): lines that hold an entity, with their start in the text and their spans. No pattern crosses a newline."""
    some = bound(found.where("size(base) > 0").select("__id", "__h", "__t"), ls=F.split("__t", "\n"))
    some = bound(some.select("__id", "__h", "ls"), at=running(F.transform("ls", lambda x: F.length(x) + 1)))
    each = some.select("__id", "__h", F.inline(F.arrays_zip(F.col("at"), F.col("ls").alias("line"))))
    each = each.toDF("__id", "__h", "at", "line")
    return find(each, "line", list(PATTERNS), "own").where("size(own) > 0")


def _terms(line: Column, own: Column) -> Column:
    """Distinct lower-case terms of a line beside its entities."""
    bare = F.aggregate(own, line, lambda t, s: F.replace(t, s["value"], F.lit(" ")))
    return F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(TERM), F.lit(0)))


def held_entities(lines: DataFrame) -> DataFrame:
    """(line, copies, words, e): each distinct line once for each entity in it, with the terms beside its entities."""
    distinct = lines.groupBy("line").agg(F.first("own").alias("own"), F.count("*").alias("copies"))
    entities = F.array_distinct(F.transform("own", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))
    return distinct.select("line", "copies", _terms(F.col("line"), F.col("own")).alias("words"), F.explode(entities).alias("e"))


def disclosures(docs: DataFrame, lines: DataFrame, text: str, chance: float, generalise_at: float) -> DataFrame:
    """(kind, value, term, share): terms whose PMI with an entity is at least that share of the entity's information.

    Every entity counts, with all its distinct lines. The probability that independent
    lines bring a pair together so often (Chernoff's bound, exact for an entity that
    never lacks the term) must be below ``chance``.
    """
    held = held_entities(lines)
    often = held.groupBy("e").agg(F.count("*").alias("n_e"))
    met = held.select("e", "copies", F.explode("words").alias("term")).groupBy("e", "term").agg(F.count("*").alias("n_te"), F.sum("copies").alias("all_te"))
    joint = stored(met.join(often, "e"), "joint-counts")
    terms = joint.select(F.col("term").alias("__w")).distinct()
    each_line = docs.select(F.explode(F.split(text, "\n")).alias("line"))
    total = stored(docs.agg(F.sum(F.size(F.split(text, "\n")).cast("long")).alias("n")), "line-count")
    each = each_line.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(TERM), F.lit(0)))).alias("__w"))
    # many terms: words are counted first, so that only counts meet them
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    each = each.join(F.broadcast(terms), "__w", "left_semi") if few else each
    seen = each.groupBy(F.col("__w").alias("term")).agg(F.count("*").alias("n_t"))
    n = F.lit(total.first()["n"] or 0)
    # a line of the pair counts once on this side too
    n_t = F.greatest(F.col("n_t") - F.col("all_te") + F.col("n_te"), F.col("n_te"))
    ic, pmi = F.log(n / F.col("n_e")), F.log(F.col("n_te") * n / (F.col("n_e") * n_t))
    share = F.when(ic > 0, pmi / ic)
    without, lacking = F.col("n_e") - F.col("n_te"), n - n_t
    evidence = F.col("n_te") * pmi + F.when(without > 0, without * F.log(without * n / (F.col("n_e") * lacking))).otherwise(0.0)
    kept = (F.col("share") >= generalise_at) & (F.col("evidence") > -math.log(chance))
    scored = joint.join(seen, "term").select(F.col("e")["kind"].alias("kind"), F.col("e")["value"].alias("value"), "term", share.alias("share"), evidence.alias("evidence"))
    return scored.where(kept).drop("evidence")


def private_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chance: float = CHANCE, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the text, ``base`` (entities) and ``terms`` (disclosing terms with their share in ``value``, as text).

    Null and empty texts have no spans. Rows with equal id and text are one document;
    null ids are values like any other; an empty table gives an empty result; other
    columns are ignored. A term is marked in lines that hold the entity it discloses.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), *row_key(doc_id, text), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    found = find(own, "__t", list(PATTERNS), "base")
    lines = stored(entity_lines(found).distinct(), "entity-lines")
    told = broadcast_if(stored(disclosures(docs, lines, text, chance, generalise_at), "disclosures"), BROADCAST_ROWS)
    # a line meets only what its own terms tell, so rows stay linear in an entity's lines
    pairs = held_entities(lines).select("line", F.col("e")["kind"].alias("kind"), F.col("e")["value"].alias("value"), F.explode("words").alias("term"))
    by_line = pairs.join(told, ["kind", "value", "term"]).groupBy("line").agg(F.collect_set(F.struct("term", "share")).alias("told"))
    hot = lines.join(broadcast_if(stored(by_line, "told-lines"), BROADCAST_ROWS // 10), "line")
    marked = find(hot, "line", ["term"], "words")
    clear = lambda w: ~F.exists("own", lambda s: (s["start"] < w["stop"]) & (w["start"] < s["stop"]))
    share = lambda w: F.array_max(F.transform(F.filter("told", lambda t: t["term"] == F.lower(w["value"])), lambda t: t["share"]))
    placed = F.transform(
        F.filter("words", lambda w: clear(w) & share(w).isNotNull()),
        lambda w: F.struct(F.lit("term").alias("kind"), (w["start"] + F.col("at")).alias("start"), (w["stop"] + F.col("at")).alias("stop"), share(w).cast("string").alias("value")),
    ).cast(SPAN_TYPE)
    by_doc = marked.select("__id", "__h", placed.alias("p")).groupBy("__id", "__h").agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("__p"))
    by_doc = broadcast_if(stored(by_doc.select(F.col("__id").alias("__cid"), F.col("__h").alias("__ch"), "__p"), "term-spans"), BROADCAST_ROWS // 10)
    joined = found.join(by_doc, found["__id"].eqNullSafe(by_doc["__cid"]) & (found["__h"] == by_doc["__ch"]), "left")
    return joined.select("doc_id", F.col("__t").alias("text"), "base", F.coalesce("__p", F.array().cast(SPAN_TYPE)).alias("terms"))


def sanitised(spans: DataFrame, remove_at: float = REMOVE_AT) -> DataFrame:
    """``doc_id`` and ``clean``: entities become [kind], disclosing terms [term] or, from ``remove_at`` on, nothing. Of overlapping spans the first stays."""
    label = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), s["kind"], F.lit("]"))).when(s["value"].cast("double") >= remove_at, "").otherwise("[term]")
    order = F.array_sort(F.transform(F.concat("base", "terms"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), label(s).alias("label"))))
    put = bound(spans.select("doc_id", "text", "base", "terms"), cuts=order)
    piece = lambda acc, s: F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), s["label"])
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(piece(acc, s).alias("done"), s["stop"].alias("at"))).otherwise(acc)
    zero = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    clean = F.aggregate("cuts", zero, step, lambda acc: F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return put.select("doc_id", clean.alias("clean"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
