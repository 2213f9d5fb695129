"""Repair of conversation structure: a generalised LR parser with edits over a role grammar.

Rows get an order within their conversation, faults are flagged, and a parser reads the role initials.  Its stacks
form a graph: all ways to repair the rows so far are kept as stack tops, and equal tops are merged, the one of the
smallest (cost, audit) stays.  A row may be kept, given another role or deleted, and empty rows may be inserted
before and after it.  The audit names the edits in order by their initials K, R, D, I.

How it runs on Spark:

1. equal rows become one row with a number of copies; later duplicates are told by joining each row with the first
   turn of its (conversation, role, text);
2. rows are sorted by conversation and turn into range partitions, so a conversation of any size is spread over
   neighbouring partitions, and stored;
3. each task parses its runs of neighbouring rows.  Only the first conversation of a run may have begun before it, so
   that one is parsed from every possible stack; what is known of it is a table from stack to stack.  Conversations
   of more than `PARSED` rows are parsed in parts of that size.  A conversation within a run is done;
4. the parts of the others are joined by composing their tables, in order, one part at a time;
5. the rows of conversations of more than one part are read once more, in order, for the hash of the repaired rows.

A task holds the audits of one run, or the rows of one Arrow batch; a hash over all texts of a conversation cannot
be taken in parts, so step 5 streams each such conversation through one task.

Edge cases: a null conv_id is a conversation of its own; null turns come first; null roles and texts are one space;
rows with equal turn are taken by role and then by the SHA-256 of the text, rows equal in all of these are copies
and stand together; a conversation without rows after damage has zeros, an empty audit and the hash of nothing; a
text of any length is read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import stored

#: Roles by initial; a conversation is one of these rules.  Terminals are the initials of rows.
GRAMMAR = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "ua"), ("P", "Pua"))
#: Roles that an edit can give, by initial.
GIVEN = {"u": "user", "a": "assistant"}
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
#: What an undeleted truncated row costs besides its edit.
TRUNCATED = 5
BLANK, DUPLICATE, CUT = 1, 2, 3
RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
SEGMENT = ("first long, n_rows long, turn_first long, turn_last long, turns long, initial_first string, "
           "initial_last string, blank long, duplicate long, truncated long, illegal long, "
           "ways array<struct<entry: int, top: int, cost: long, audit: string, sha256: string>>")
#: Either the result of a whole conversation or a part of one.
PARSE = f"conv_id long, result struct<{RESULT}>, part struct<{SEGMENT}>"
#: Rows that are parsed in one go.
PARSED = 1024


class Automaton:
    """SLR parser of a grammar as steps from stack to stack; a stack is a tuple of states.

    `step[stack][initial]` is the stack after a row, reductions done, for the initials that are allowed there;
    `accepts` holds the stacks at which the input may end.  Stacks are numbered; 0 is the empty one.
    """

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR, stacks: int = 64):
        self.grammar = (("S", grammar[0][0]), *grammar)
        self.heads = {head for head, _ in self.grammar}
        self.terminals = sorted({x for _, body in grammar for x in body} - self.heads)
        self.follow = self._follow()
        found = [(self._closure({(0, 0)}),)]
        self.step, self.accepts = [], set()
        for stack in found:  # grows while it is read
            steps = {}
            for x in self.terminals:
                after = self._read(stack, x)
                if after is not None:
                    if after not in found:
                        found.append(after)
                    steps[x] = found.index(after)
            if self._read(stack, "") is not None:
                self.accepts.add(len(self.step))
            self.step.append(steps)
            if len(found) > stacks:
                raise ValueError("the stacks of this grammar are not bounded")

    def _closure(self, items: Iterable[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        items = set(items)
        while more := {(k, 0) for rule, dot in items for body in [self.grammar[rule][1]] if dot < len(body)
                       for k, (head, _) in enumerate(self.grammar) if head == body[dot]} - items:
            items |= more
        return frozenset(items)

    def _goto(self, state: frozenset[tuple[int, int]], x: str) -> frozenset[tuple[int, int]] | None:
        return self._closure(moved) if (moved := {
            (rule, dot + 1) for rule, dot in state if self.grammar[rule][1][dot:dot + 1] == x}) else None

    def _starts(self, x: str) -> set[str]:
        """Terminals that can begin a symbol; "" if it can be empty (needed for rules that end in such a head)."""
        starts, seen, todo = set(), set(), [x]
        while todo:
            x = todo.pop()
            if x not in self.heads:
                starts.add(x)
                continue
            for head, body in self.grammar:
                if head == x and body[:1] not in seen:
                    seen.add(body[:1])
                    todo.append(body[:1])
        return starts

    def _follow(self) -> dict[str, set[str]]:
        follow: dict[str, set[str]] = {head: set() for head in self.heads}
        follow["S"].add("")
        size = -1
        while size != (size := sum(map(len, follow.values()))):
            for head, body in self.grammar:
                for k, x in enumerate(body):
                    if x in self.heads:
                        next_ = self._starts(body[k + 1]) if k + 1 < len(body) else {""}
                        follow[x] |= (next_ - {""}) | (follow[head] if "" in next_ else set())
        return follow

    def _reduced(self, stack: tuple, x: str) -> tuple:
        """The stack after all reductions that the next initial allows."""
        while rules := [rule for rule, dot in stack[-1] if rule and dot == len(self.grammar[rule][1])
                        and x in self.follow[self.grammar[rule][0]]]:
            if len(rules) > 1:
                raise ValueError("the grammar is ambiguous")
            head, body = self.grammar[rules[0]]
            stack = stack[:len(stack) - len(body)]
            stack = (*stack, self._goto(stack[-1], head))
        return stack

    def _read(self, stack: tuple, x: str) -> tuple | None:
        stack = self._reduced(stack, x)
        if not x:
            return stack if (0, 1) in stack[-1] else None
        state = self._goto(stack[-1], x)
        if state is None:
            return None
        stack = (*stack, state)
        # A state of one finished rule leaves no choice: it is reduced at once, so that equal stacks look equal.
        while len(stack[-1]) == 1 and (item := next(iter(stack[-1])))[1] == len(self.grammar[item[0]][1]) and item[0]:
            head, body = self.grammar[item[0]]
            stack = stack[:len(stack) - len(body)]
            stack = (*stack, self._goto(stack[-1], head))
        return stack


@dataclass
class Way:
    """The cheapest way from an entry stack to a stack top; the hash is that of the repaired rows on it."""

    cost: int
    audit: str
    hash: object | None

    def before(self, cost: int, audit: str) -> bool:
        return self.cost < cost or self.cost == cost and self.audit <= audit


class Parser:
    """Graph-structured stack from one entry stack: the cheapest way to each top, row by row."""

    def __init__(self, automaton: Automaton, entry: int):
        self.step = automaton.step
        # The hash is kept only where a conversation begins.
        self.tops: dict[int, Way] = {entry: Way(0, "", hashlib.sha256() if entry == 0 else None)}
        self._insert()

    @staticmethod
    def _with(hash_, text: bytes, audit: str):
        if hash_ is None:
            return None
        hash_ = hash_.copy()
        # A separator stands before every repaired row but the first.
        hash_.update(text if not audit.strip("D") else b"\n" + text)
        return hash_

    def _insert(self) -> None:
        """Adds the tops that insertions reach; each pass lets them reach one further."""
        todo = list(self.tops)
        while todo:
            top = todo.pop()
            way = self.tops[top]
            for x, role in GIVEN.items():
                after = self.step[top].get(x)
                if after is None:
                    continue
                cost, audit = way.cost + COSTS["I"], way.audit + "I"
                if after not in self.tops or not self.tops[after].before(cost, audit):
                    self.tops[after] = Way(cost, audit, self._with(way.hash, f"{role}:".encode(), way.audit))
                    todo.append(after)

    def row(self, role: str, text: str, fault: int) -> None:
        initial, more = role[:1], TRUNCATED if fault == CUT else 0
        best: dict[int, tuple[int, str, Way, str | None]] = {}

        def offer(after: int | None, cost: int, edit: str, way: Way, given: str | None) -> None:
            if after is None:
                return
            there = best.get(after)
            if there is None or cost < there[0] or cost == there[0] and way.audit + edit < there[1]:
                best[after] = (cost, way.audit + edit, way, given)

        for top, way in self.tops.items():
            offer(top, way.cost + COSTS["D"], "D", way, None)
            if fault in (0, CUT):
                offer(self.step[top].get(initial), way.cost + COSTS["K"] + more, "K", way, role)
                for x, given in GIVEN.items():
                    offer(self.step[top].get(x), way.cost + COSTS["R"] + more, "R", way, given)
        self.tops = {
            after: Way(cost, audit, way.hash if given is None else self._with(way.hash, f"{given}:{text}".encode(), way.audit))
            for after, (cost, audit, way, given) in best.items()}
        self._insert()

    def ways(self, entry: int) -> list[dict]:
        return [{"entry": entry, "top": top, "cost": w.cost, "audit": w.audit, "sha256": w.hash and w.hash.hexdigest()}
                for top, w in self.tops.items()]


def illegal_pair(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


class Segment:
    """Counts and parsers of neighbouring rows of one conversation."""

    def __init__(self, automaton: Automaton, number: int, entries: Iterable[int]):
        self.first, self.n_rows, self.turns, self.illegal = number, 0, 0, 0
        self.turn_first = self.turn_last = None
        self.initial_first = self.initial_last = ""
        self.faults = [0, 0, 0, 0]
        self.parsers = {entry: Parser(automaton, entry) for entry in entries}

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if self.n_rows == 0:
            self.initial_first = role[:1]
        else:
            self.illegal += illegal_pair(self.initial_last, role[:1])
        self.initial_last = role[:1]
        self.n_rows += 1
        self.faults[fault] += 1
        if turn is not None:
            self.turn_first = turn if self.turn_first is None else self.turn_first
            self.turns += self.turn_last != turn
            self.turn_last = turn
        for parser in self.parsers.values():
            parser.row(role, text, fault)

    def record(self) -> dict:
        return {
            **{k: getattr(self, k) for k in ("first", "n_rows", "turn_first", "turn_last", "turns", "initial_first", "initial_last", "illegal")},
            "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[CUT],
            "ways": [way for entry, parser in self.parsers.items() for way in parser.ways(entry)]}


def joined(a: dict | None, b: dict) -> dict:
    """Two neighbouring segments as one; the hash of the repaired rows is lost."""
    if a is None:
        return b
    ways: dict[tuple[int, int], dict] = {}
    for x in a["ways"]:
        for y in b["ways"]:
            if x["top"] != y["entry"]:
                continue
            key, cost = (x["entry"], y["top"]), x["cost"] + y["cost"]
            there = ways.get(key)
            if there is None or cost <= there["cost"]:
                audit = x["audit"] + y["audit"]
                if there is None or cost < there["cost"] or audit < there["audit"]:
                    ways[key] = {"entry": key[0], "top": key[1], "cost": cost, "audit": audit, "sha256": None}
    same = a["turn_last"] is not None and a["turn_last"] == b["turn_first"]
    return {
        "first": a["first"], "n_rows": a["n_rows"] + b["n_rows"], "turns": a["turns"] + b["turns"] - same,
        "turn_first": b["turn_first"] if a["turn_first"] is None else a["turn_first"],
        "turn_last": a["turn_last"] if b["turn_last"] is None else b["turn_last"],
        "initial_first": a["initial_first"], "initial_last": b["initial_last"],
        "illegal": a["illegal"] + b["illegal"] + illegal_pair(a["initial_last"], b["initial_first"]),
        **{k: a[k] + b[k] for k in ("blank", "duplicate", "truncated")}, "ways": list(ways.values())}


def finished(segment: dict, accepts: set[int]) -> dict:
    """The result of a whole conversation."""
    best = min((w for w in segment["ways"] if w["entry"] == 0 and w["top"] in accepts), key=lambda w: (w["cost"], w["audit"]))
    span = 0 if segment["turn_first"] is None else segment["turn_last"] - segment["turn_first"] + 1
    return {"gaps": span - segment["turns"], "cost": best["cost"], "audit": best["audit"], "repaired_sha256": best["sha256"],
            **{k: segment[k] for k in ("blank", "duplicate", "truncated", "illegal")}}


def fault_of(text: str, duplicate: bool) -> int:
    end = text.rstrip(" \t\n\v\f\r")
    return BLANK if not end else DUPLICATE if duplicate else 0 if end[-1] in ".!?" else CUT


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after the damage of the contract; a row stands `copies` times.

    crc32 of `conv_id:turn`, null being one space, divided by 20 leaves 0: dropped, 1: text empty, 2: without `.!?`,
    3: repeated, 4: role user.
    """
    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    return rows.filter(kind != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"))


def flagged(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with the sum of `copies`, `digest` of the text, and `again`: role and text stand on an earlier turn."""
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", F.sha2("text", 256))
    # Nulls come before all turns.
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.coalesce("turn", F.lit(0)).alias("at"))
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first_place"), F.max(place).alias("last_place"))
    first = first.filter("first_place < last_place").select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first_place")
    match = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return rows.join(first, match, "left").select(
        *rows.columns, F.coalesce(F.col("first_place") < place, F.lit(False)).alias("again"))


ORDER = ("conv_id", "turn", "role", "digest")
READ = ("number", "conv_id", "turn", "role", "text", "copies", "again")


def in_order(rows: DataFrame, folder: str) -> DataFrame:
    """Rows by conversation, turn, role and digest in range partitions, numbered in this order, stored."""
    keys = [F.col(c).asc_nulls_first() for c in ORDER]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # Numbers rise by one within a partition and jump between two.
    return stored(placed.select(F.monotonically_increasing_id().alias("number"), *READ[1:]), f"{folder}/ordered")


def records(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[batch.column(c).to_pylist() for c in batch.schema.names], strict=True)


def parsed(ordered: DataFrame, automaton: Automaton, rows: int = PARSED) -> DataFrame:
    """Results of conversations that lie within a run, and parts of the others."""
    entries, schema = range(len(automaton.step)), to_arrow_schema(StructType.fromDDL(PARSE))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = conv = None
        segment: Segment | None = None  # the rows since the last cut
        part: dict | None = None  # the rows of the same conversation before
        whole = False  # the conversation began in this run
        out: list[dict] = []

        def close(ended: bool) -> None:
            nonlocal part
            if segment is None:
                return
            record = joined(part, segment.record())
            done = finished(record, automaton.accepts) if ended and whole else None
            if done and done["repaired_sha256"] is not None:
                out.append({"conv_id": conv, "result": done, "part": None})
            else:
                out.append({"conv_id": conv, "result": None, "part": record})
            part = None

        for batch in batches:
            for number, conv_id, turn, role, text, copies, again in records(batch):
                broken = before is None or number != before + 1
                if segment is None or broken or conv_id != conv:
                    close(ended=not broken)
                    conv, whole = conv_id, not broken
                    segment = Segment(automaton, number, (0,) if whole else entries)
                for copy in range(copies):
                    if segment.n_rows == rows:
                        part = joined(part, segment.record())
                        segment = Segment(automaton, number, entries)
                    segment.row(turn, role, text, fault_of(text, again or copy > 0))
                before = number
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        close(ended=False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return ordered.select(*READ).mapInArrow(parse, PARSE)


def composed(parts: DataFrame, automaton: Automaton) -> DataFrame:
    """conv_id and result of the conversations that came in parts; those of several parts have no hash yet."""
    schema = to_arrow_schema(StructType.fromDDL(f"conv_id long, result struct<{RESULT}>"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, whole = False, None, None
        for batch in batches:
            out = []
            for conv_id, part in records(batch):
                if begun and conv_id != conv:
                    out.append({"conv_id": conv, "result": finished(whole, automaton.accepts)})
                    whole = None
                begun, conv = True, conv_id
                if whole is None:
                    part = part | {"ways": [w for w in part["ways"] if w["entry"] == 0]}
                whole = joined(whole, part)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if begun:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "result": finished(whole, automaton.accepts)}], schema)

    # `number` rises with the place in the order; cuts inside copies of a row share it, so they are joined before.
    kept = parts.select("conv_id", "part", F.col("part.first").alias("first")).repartition("conv_id").sortWithinPartitions("conv_id", "first")
    return kept.select("conv_id", "part").mapInArrow(compose, f"conv_id long, result struct<{RESULT}>")


def repaired_rows(automaton: Automaton, audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[str]:
    """`role:text` of the rows of a conversation after the edits of an audit."""
    stack, edits = 0, iter(audit)

    def given() -> str:
        return next(x for x in GIVEN if x in automaton.step[stack])

    for role, text in rows:
        while (edit := next(edits)) == "I":
            x = given()
            stack = automaton.step[stack][x]
            yield f"{GIVEN[x]}:"
        if edit == "D":
            continue
        x = role[:1] if edit == "K" else given()
        stack = automaton.step[stack][x]
        yield f"{role if edit == 'K' else GIVEN[x]}:{text}"
    for _ in edits:
        x = given()
        stack = automaton.step[stack][x]
        yield f"{GIVEN[x]}:"


def hashes(ordered: DataFrame, audits: DataFrame, automaton: Automaton) -> DataFrame:
    """conv_id and hash of the repaired rows, for the conversations of `audits`."""
    schema = to_arrow_schema(StructType.fromDDL("conv_id long, hash string"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in records(batch))
        # The audit of a conversation comes first, then its rows.
        row = next(stream, None)
        while row is not None:
            conv, audit, row = row[0], row[5], None

            def rows(conv=conv) -> Iterator[tuple[str, str]]:
                nonlocal row
                for row in stream:
                    if row[0] != conv or row[5] is not None:
                        return
                    yield from [(row[2], row[3])] * row[4]
                row = None

            hash_, first = hashlib.sha256(), True
            for text in repaired_rows(automaton, audit, rows()):
                hash_.update(text.encode() if first else b"\n" + text.encode())
                first = False
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "hash": hash_.hexdigest()}], schema)

    wanted = audits.select(F.col("conv_id").alias("wanted"))
    rows = ordered.join(wanted, F.col("conv_id").eqNullSafe(F.col("wanted")), "left_semi").select(
        "conv_id", "number", "role", "text", "copies", F.lit(None).cast("string").alias("audit"))
    heads = audits.selectExpr("conv_id", "-1L AS number", "'' AS role", "'' AS text", "0L AS copies", "result.audit AS audit")
    placed = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "number")
    return placed.mapInArrow(digest, "conv_id long, hash string")


def repair(rows: DataFrame, folder: str, parsed_rows: int = PARSED) -> DataFrame:
    """conv_id and the columns of `RESULT` for each conversation of rows with conv_id, turn, role, text, copies."""
    automaton = Automaton()
    ordered = in_order(flagged(rows), folder)
    found = stored(parsed(ordered, automaton, parsed_rows), f"{folder}/parsed")
    late = stored(composed(found.filter("part IS NOT NULL"), automaton), f"{folder}/late")
    # Of one part with its hash, or of several without.
    open_ = late.filter("result.repaired_sha256 IS NULL")
    full = open_.join(hashes(ordered, open_, automaton).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", F.col("result").withField("repaired_sha256", F.col("hash")).alias("result"))
    whole = found.filter("result IS NOT NULL").select("conv_id", "result").unionByName(
        late.filter("result.repaired_sha256 IS NOT NULL")).unionByName(full)
    return whole.select("conv_id", "result.*")


def repair_conversations(rows: DataFrame, folder: str, parsed_rows: int = PARSED) -> DataFrame:
    """The contract: damage first, then one row for each conv_id of the given rows."""
    found = repair(damaged(rows.select("conv_id", "turn", "role", "text")), folder, parsed_rows).withColumnRenamed("conv_id", "c")
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(nothing.get(c, 0))).alias(c) for c in found.columns[1:]])
