"""Conversation repair against exhaustive search and a plain dynamic programme."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from pickwright.llm import conversation, queries
from pickwright.llm.conversation import BLANK, DUPLICATE, FINE, TRUNCATED, Solver

SCHEMA = "conv_id bigint, turn bigint, role string, text string, piece int, audit string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")
WHITE = " \t\n\x0b\x0c\r"


def priced(audit, rows):
    """(cost, repaired roles and texts) of an audit, or None where it isn't allowed."""
    at = cost = 0
    out = []
    for e in audit:
        after = "".join(r[:1] for r, _ in out)
        turn = "assistant" if after.endswith("u") else "user"
        if e == "I":
            out.append((turn, ""))
            cost += 2
            continue
        role, text, fault = rows[at]
        at += 1
        if e == "D":
            cost += 3
            continue
        if fault in (BLANK, DUPLICATE):
            return None
        cost += (2 if e == "R" else 0) + (fault == TRUNCATED)
        out.append((turn if e == "R" else role or "?", text))  # a row without an initial fits nowhere
        legal = "".join(r[:1] for r, _ in out)
        if not re.match(r"(s?(ua)*u?)\Z", legal):
            return None
    return (cost, out) if LEGAL.match("".join(r[:1] for r, _ in out)) else None


def exhaustive(rows):
    best = None
    for ops in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(("", "I", "II"), repeat=len(rows) + 1):
            audit = "".join(g + o for g, o in zip(gaps, [*ops, ""]))
            got = priced(audit, rows)
            if got is not None:
                best = min(best or (10**9, "~", None), (got[0], audit, got[1]))
    return best


def programme(rows):
    """Least (cost, audit) by state, row by row; strings are kept whole."""
    follow = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    insert = {0: 2, 1: 2, 2: 3, 3: 2}

    def opened(best):
        out = {}
        for s, (c, a) in best.items():
            for k in range(3):
                out[s] = min(out.get(s, (10**9, "~")), (c + 2 * k, a + "I" * k))
                yield s, (c + 2 * k, a + "I" * k)
                s = insert[s]

    now = {0: (0, "")}
    for role, _, fault in rows:
        new = {}
        for s, (c, a) in opened(now):
            ways = [(s, 3, "D")]
            if fault not in (BLANK, DUPLICATE):
                more = int(fault == TRUNCATED)
                ways.append((insert[s], 2 + more, "R"))
                if s in follow.get(role[:1], {}):
                    ways.append((follow[role[:1]][s], more, "K"))
            for t, x, e in ways:
                new[t] = min(new.get(t, (10**9, "~")), (c + x, a + e))
        now = new
    return min(v for s, v in opened(now) if s in (0, 3))


def plain(rows):
    """The whole contract for one conversation's rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, known = set(), []
    for _, role, text in rows:
        left = text.rstrip(WHITE)
        fault = BLANK if not left else DUPLICATE if (role, text) in seen else FINE if left[-1] in ".!?" else TRUNCATED
        seen.add((role, text))
        known.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = programme(known)
    again, out = priced(audit, known)
    assert again == cost
    count = [sum(f == k for _, _, f in known) for k in (BLANK, DUPLICATE, TRUNCATED)]
    return gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def hurt(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own.extend([(turn, "user" if code == 4 else role, text)] * (1 + (code == 3)))
    return out


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    return {r["conv_id"]: tuple(r[n] for n in NAMES[1:]) for r in df.collect()}


def random_rows(n, seed, roles=("system", "user", "assistant", "tool", "")):
    rnd = random.Random(seed)
    return [(rnd.choice(roles), rnd.choice(["Hi.", "No", "", "Well? "]) if rnd.random() < 0.6 else f"t{k}.", rnd.choice([FINE, FINE, FINE, BLANK, DUPLICATE, TRUNCATED])) for k in range(n)]


def solved(rows, solver=None):
    solver = solver or Solver()
    state, cost = solver.end(solver.joined([solver.row(r[:1], f)[1] for r, _, f in rows]))
    audit, out = solver.edited(rows, 0, state, True)
    return cost, audit, [(t["role"], t["text"]) for t in out]


def test_equals_exhaustive_search():
    for seed in range(60):
        rows = random_rows(seed % 4, seed)
        assert solved(rows) == exhaustive(rows), rows


def test_equals_a_plain_programme_on_longer_lists():
    solver = Solver()
    for seed in range(300):
        rows = random_rows(seed % 40, seed, ("system", "user", "assistant") if seed % 2 else ("system", "user", "assistant", "tool"))
        cost, audit, out = solved(rows, solver)
        assert (cost, audit) == programme(rows) and priced(audit, rows) == (cost, out)


def test_blocks_join_to_the_same_answer():
    solver = Solver()
    for seed in range(60):
        rows = random_rows(30, seed, ("system", "user", "assistant"))
        cuts = [rows[i : i + 7] for i in range(0, 30, 7)]
        tables = [solver.joined([solver.row(r[:1], f)[1] for r, _, f in c]) for c in cuts]
        end, cost = solver.end(solver.joined(tables))
        state, audit = 0, ""
        for k, (c, after) in enumerate(zip(cuts, solver.crossings(tables, 0, end))):
            audit += solver.edited(c, state, after, k == len(cuts) - 1)[0]
            state = after
        assert (cost, audit) == programme(rows)


def table(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(parts)


def made(seed=1, n=120):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.randint(1, 12)):
            role = "system" if turn == 0 and rnd.random() < 0.3 else rnd.choice(["user", "assistant"]) if rnd.random() < 0.1 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, rnd.choice(["Fine.", "Yes!", "What", " \t", f"Text {turn}.", "Größe? \n"])))
    rows += [(None, 0, "user", "Hi."), (None, None, None, None), (900, None, "user", "A."), (900, None, "user", "A."), (900, 2, "user", "A."), (900, 9, "assistant", "B")]
    rows += [(901, 5, "user", "x" * 100_000 + "."), (901, 6, "assistant", "ok."), (902, -3, "tool", "t."), (902, 4, "", "e."), (903, 2, "assistant", "Same."), (903, 2, "assistant", "Other."), (903, 2, "Assistant", "Same.")]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (gone, 0, "user", "Dropped.")]


def test_whole_operator_equals_plain(spark):
    rows = made()
    want = {c: plain(own) for c, own in hurt(rows).items()}
    got = found(conversation.digests(conversation.repair(conversation.damage(table(spark, rows)))))
    assert got == want
    assert any(not own for own in hurt(rows).values())


@pytest.mark.parametrize("block", [1, 3])
def test_one_conversation_with_most_rows_is_cut(spark, block):
    rnd = random.Random(4)
    rows = made(2, 12) + [(5000, t, rnd.choice(["user", "assistant"]), rnd.choice(["Same.", f"T{t}.", "cut", ""])) for t in range(400)]
    pieces = conversation.repair(conversation.damage(table(spark, rows)), block_rows=block)
    assert max(len(r["audit"]) for r in pieces.select("audit").collect()) <= 3 * block + 2
    assert found(conversation.digests(pieces)) == {c: plain(own) for c, own in hurt(rows).items()}


def test_one_turn_with_all_rows(spark):
    rows = [(1, 3, "user", f"T{k % 50}.") for k in range(300)] + [(2, None, "assistant", "A.") for _ in range(50)]
    plainly = {1: plain([r[1:] for r in rows[:300]]), 2: plain([r[1:] for r in rows[300:]])}
    assert found(conversation.digests(conversation.repair(table(spark, rows), block_rows=16))) == plainly


def test_empty_table(spark):
    assert conversation.digests(conversation.repair(conversation.damage(table(spark, made(1, 1)).limit(0)))).count() == 0


def test_query_equals_plain(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    got = queries.op12_conversations(spark, "/root/testdata/sf0.01")
    assert got.columns == NAMES
    assert found(got) == {c: plain(own) for c, own in hurt(rows).items()}
