"""Secret scans through a trigram inverted index.

From each rule's regex the trigrams that every match must hold are derived as a Boolean
query. The corpus is indexed for exactly the trigrams that some query names: postings
(trigram, document). A rule's candidates are the documents that its query leaves; rules
without mandatory trigrams scan everything. Candidates are verified with the regex.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as C  # noqa: PLC2701  the standard library's own parse of a regex
from re import _parser  # noqa: PLC2701

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwright.llm.common import row_key

#: A query is None (anything may match), or alternatives (sets of trigrams) of which one must be there in full.
Query = list[frozenset[str]] | None
MOST_STRINGS, MOST_ALTERNATIVES = 64, 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] | None = None


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
)
#: Further public token formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)


def _either(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return None
    got = sorted({*a, *b}, key=sorted)
    got = [x for x in got if not any(y < x for y in got)]
    return got if len(got) <= MOST_ALTERNATIVES else None


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _either([x | y for x in a for y in b], []) if len(a) * len(b) <= 4096 else a


def _of_strings(strings: set[str]) -> Query:
    """One of these strings must be there."""
    if any(len(s) < 3 for s in strings):
        return None
    q: Query = []
    for s in strings:
        q = _either(q, [frozenset(s[k : k + 3] for k in range(len(s) - 2))])
    return q


def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case, that every match of the regex holds. Case is given up on both sides, which only widens the candidates."""

    def one(op, arg) -> tuple[set[str] | None, Query]:
        if op is C.LITERAL:
            return {chr(arg).lower()}, None
        if op is C.SUBPATTERN:
            return sequence(arg[3])
        if op is C.BRANCH:
            exact: set[str] | None = set()
            query: Query = []
            for branch in arg[1]:
                strings, demand = sequence(branch)
                whole = _both(demand, _of_strings(strings) if strings is not None else None)
                query = _either(query, whole)
                exact = None if strings is None or exact is None else exact | strings
            return (exact, None) if exact is not None and len(exact) <= MOST_STRINGS else (None, query)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, body = arg
            strings, demand = sequence(body)
            if least == 0:
                return ((strings | {""}) if strings is not None and most == 1 else None), None
            if strings is not None and least == most == 1:
                return strings, demand
            return None, _both(demand, _of_strings(strings) if strings is not None else None)
        if op is C.IN:
            chars = {chr(v).lower() for kind, v in arg if kind is C.LITERAL}
            if all(kind is C.LITERAL for kind, _ in arg) and len(chars) <= 8:
                return chars, None
            return None, None
        if op in (C.AT, C.ASSERT_NOT, C.ASSERT):
            return {""}, None
        return None, None

    def sequence(nodes) -> tuple[set[str] | None, Query]:
        """Exact strings if the whole is a small set of them, else None and the demand of its known stretches."""
        stretches: list[set[str]] = [{""}]
        query: Query = None
        whole = True
        for op, arg in nodes:
            strings, demand = one(op, arg)
            query = _both(query, demand)
            if strings is None:
                whole = False
                stretches.append({""})
            elif len(stretches[-1]) * len(strings) <= MOST_STRINGS:
                stretches[-1] = {a + b for a in stretches[-1] for b in strings}
            else:
                whole = False
                stretches.append(strings)
        if whole:
            return stretches[0], query
        for s in stretches:
            query = _both(query, _of_strings(s))
        return None, query

    strings, demand = sequence(_parser.parse(pattern))
    return _both(demand, _of_strings(strings) if strings is not None else None)


def trigrams_of(texts: list[str | None], wanted: list[str]) -> list[list[str]]:
    """Which of the wanted trigrams each text holds, ASCII case aside."""
    found = []
    for t in texts:
        low = (t or "").encode().lower()
        found.append([w for w in wanted if w.encode() in low])
    return found


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """The index: (gram, __id, __h), one row per wanted trigram and distinct document. ``docs`` has __id, __h, __t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = trigrams_of(batch.column("__t").to_pylist(), wanted)
            take = pa.array([k for k, g in enumerate(held) for _ in g], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x for g in held for x in g], pa.string()), batch.column("__id").take(take), batch.column("__h").take(take)], names=["gram", "__id", "__h"])

    kind = docs.schema["__id"].dataType.simpleString()
    return docs.select("__id", "__h", "__t").mapInArrow(run, f"gram string, __id {kind}, __h bigint").distinct()


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(__id, __h, kinds): documents whose posting lists meet in some alternative of a rule's query. Each document's list is at most as long as the wanted trigrams."""
    held = index.groupBy("__id", "__h").agg(F.collect_set("gram").alias("g"))

    def answers(q: Query):
        alternatives = [F.size(F.array_except(F.array(*map(F.lit, sorted(a))), F.col("g"))) == 0 for a in q]
        any_of = alternatives[0]
        for a in alternatives[1:]:
            any_of = any_of | a
        return any_of

    kinds = [F.when(answers(q), F.lit(kind)) for kind, q in queries.items() if q is not None]
    return held.select("__id", "__h", F.array_compact(F.array(*kinds)).alias("kinds")).where("size(kinds) > 0")


def spans(text: str, kinds: set[str], rules: tuple[Rule, ...]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rules in ``kinds``, leftmost without overlap per rule, failing matches dropped; by start, then rule order."""
    order = {r.kind: k for k, r in enumerate(rules)}
    found = [
        (m.start(), m.end(), r.kind)
        for r in rules
        if r.kind in kinds
        for m in re.finditer(r.pattern, text, re.ASCII)
        if r.keep is None or r.keep(m)
    ]
    return sorted(found, key=lambda s: (s[0], order[s[2]]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES + MORE_RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``found``, an array of (kind, start, stop) by start, then rule order; code points, end exclusive.

    Null and empty texts have none. Rows with equal id and text are one document in the
    index; null ids are values like any other; an empty table gives an empty result;
    other columns are ignored.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    everywhere = {k for k, q in queries.items() if q is None}
    wanted = sorted({g for q in queries.values() if q is not None for a in q for g in a})
    own = docs.select(F.col(doc_id).alias("doc_id"), *row_key(doc_id, text), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    if wanted:
        cand = candidates(postings(own, wanted), queries)
        cand = cand.select(F.col("__id").alias("__cid"), F.col("__h").alias("__ch"), "kinds")
        own = own.join(cand, own["__id"].eqNullSafe(cand["__cid"]) & (own["__h"] == cand["__ch"]), "left").select("doc_id", "__t", "kinds")
    else:
        own = own.select("doc_id", "__t", F.array().cast("array<string>").alias("kinds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "stop": b} for a, b, k in spans(t, everywhere.union(kinds or ()), rules)]
                for t, kinds in zip(batch.column("__t").to_pylist(), batch.column("kinds").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind_of)], names=["doc_id", "found"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, found array<struct<kind:string,start:int,stop:int>>")
