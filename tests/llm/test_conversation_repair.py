"""Conversation repair against a search over all edits, and long conversations cut into parts."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetaudit.llm import conversation_repair as repair
from fleetaudit.llm import queries
from fleetaudit.session import work_dir

SPACE = " \t\n\v\f\r"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    """The rows of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.strip(SPACE)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Cheapest (cost, audit, repaired rows) by dynamic programming over the written pattern, state by state.

    States: nothing yet, after s, user wanted (after a pair), assistant wanted.
    """
    go = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "p", ("p", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    best = {"0": (0, "", ())}

    def better(table, state, value):
        if state is not None and (state not in table or value[:2] < table[state][:2]):
            table[state] = value

    def inserted(table):
        for _ in range(4):
            for state, (cost, audit, out) in list(table.items()):
                for x, name in names.items():
                    better(table, go.get((state, x)), (cost + 5, audit + "I", (*out, f"{name}:")))
        return table

    best = inserted(best)
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        after = {}
        more = 5 if fault == "truncated" else 0
        for state, (cost, audit, out) in best.items():
            better(after, state, (cost + 2, audit + "D", out))
            if fault in ("", "truncated"):
                better(after, go.get((state, role[:1])), (cost + more, audit + "K", (*out, f"{role}:{text}")))
                for x, name in names.items():
                    better(after, go.get((state, x)), (cost + more + 1, audit + "R", (*out, f"{name}:{text}")))
        best = inserted(after)
    return min((best[s] for s in "0p" if s in best), key=lambda v: v[:2])


def every_repair(rows):
    """Cheapest (cost, audit) over all edit strings with up to two insertions between rows."""
    marks, found = faults(rows), None
    options = [[("D", None, 2)] if m in ("blank", "duplicate") else
               [("D", None, 2), ("K", r[1][:1], 5 * (m == "truncated")), ("R", "u", 1 + 5 * (m == "truncated")), ("R", "a", 1 + 5 * (m == "truncated"))]
               for r, m in zip(rows, marks, strict=True)]
    gaps = [g for n in range(3) for g in itertools.product("ua", repeat=n)]
    for edits in itertools.product(*options):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            roles = list(put[0])
            audit, cost = "I" * len(put[0]), 5 * sum(map(len, put))
            for (letter, x, c), more in zip(edits, put[1:], strict=True):
                roles += ([] if x is None else [x]) + list(more)
                audit += letter + "I" * len(more)
                cost += c
            if all(roles) and LEGAL.match("".join(roles)) and (found is None or (cost, audit) < found):
                found = (cost, audit)
    return found


def expected(conv, rows):
    rows = damage(rows)
    marks = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, out = plain_repair(rows)
    return {
        "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{k: marks.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def test_automaton_reads_the_pattern():
    machine = repair.Automaton()
    for n in range(7):
        for roles in itertools.product("sua", repeat=n):
            stack = 0
            for x in roles:
                stack = None if stack is None else machine.step[stack].get(x)
            assert (stack in machine.accepts) == bool(LEGAL.match("".join(roles)))


ROWS = st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "system", "tool", ""]),
                          st.sampled_from(["a.", "b!", "cut", " ", "x? "])), max_size=8)


@settings(deadline=None, max_examples=300)
@given(ROWS)
def test_parser_as_the_plain_table(rows):
    machine = repair.Automaton()
    rows = [(t, r, x) for t, (_, r, x) in enumerate(rows)]
    parser = repair.Parser(machine, 0)
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        parser.row(role, text, ["", "blank", "duplicate", "truncated"].index(fault))
    best = min((w for top, w in parser.tops.items() if top in machine.accepts), key=lambda w: (w.cost, w.audit))
    cost, audit, out = plain_repair(rows)
    assert (best.cost, best.audit, best.hash.hexdigest()) == (cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    assert list(repair.repaired_rows(machine, audit, [(r, x) for _, r, x in rows])) == list(out)


@pytest.mark.parametrize("seed", range(12))
def test_plain_table_as_all_edit_strings(seed):
    rnd = random.Random(seed)
    rows = [(t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "cut", " ", "b."])) for t in range(seed % 3 + 1)]
    assert plain_repair(rows)[:2] == every_repair(rows)


def conversations(rnd, sizes):
    rows = []
    for conv, n in sizes:
        for t in range(n):
            turn = rnd.choice([t, t, t, t + 1, None]) if rnd.random() < 0.1 else t
            rows.append((conv, turn, rnd.choice(["system", "tool", None, "assistant"]) if rnd.random() < 0.15 else ["user", "assistant"][t % 2],
                         rnd.choice(["Yes.", "No!", "why", "", None, f"long {t} text."])))
    return rows


def compare(spark, rows, folder_rows=repair.PARSED, parts=3):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    got = {r["conv_id"]: r.asDict() for r in repair.repair_conversations(table, work_dir(spark), folder_rows).collect()}
    by = {}
    for row in rows:
        by.setdefault(row[0], []).append(row)
    assert got == {conv: expected(conv, group) for conv, group in by.items()}


def test_small_and_null_conversations(spark):
    rnd = random.Random(7)
    compare(spark, conversations(rnd, [(k, rnd.randrange(1, 9)) for k in range(300)] + [(None, 12)]))


@pytest.mark.parametrize("cut", [1, 7, 1024])
def test_a_conversation_with_most_rows_in_many_parts(spark, cut):
    rnd = random.Random(9)
    compare(spark, conversations(rnd, [(1, 3), (2, 700), (3, 2), (4, 0), (5, 40)]), cut)


def test_many_copies_of_one_row(spark):
    compare(spark, [(8, 1, "user", "Same.")] * 60 + [(8, 2, "assistant", "Ok.")] + [(9, None, None, None)] * 5, 16)


def test_query_as_the_plain_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = {}
    for row in rows:
        by.setdefault(row[0], []).append(row)
    got = {r["conv_id"]: r.asDict() for r in queries.op13(spark, "/root/testdata/sf0.01").collect()}
    assert got == {conv: expected(conv, group) for conv, group in by.items()}


def test_all_rows_dropped_empty_table_and_other_columns(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    table = spark.createDataFrame([(1, turn, "user", "x.", "n", 5)], "conv_id long, turn long, role string, text string, audit string, number long")
    row = repair.repair_conversations(table, work_dir(spark)).first()
    assert (row["cost"], row["audit"], row["gaps"], row["repaired_sha256"]) == (0, "", 0, hashlib.sha256().hexdigest())
    assert repair.repair_conversations(table.limit(0), work_dir(spark)).count() == 0


def test_very_long_text(spark):
    turns = [t for t in range(60) if zlib.crc32(f"3:{t}".encode()) % 20 > 4][:2]
    compare(spark, [(3, turns[0], "user", "word " * 400_000 + "."), (3, turns[1], "assistant", "ok.")])
