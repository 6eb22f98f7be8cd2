"""Conversation structure repair by Hirschberg's divide and conquer over a four-state chain.

A conversation's rows are kept (cost 0), given another role (2) or deleted (3), and empty turns are inserted (2),
until the roles read ``(s?(ua)+)?``. States: 0 nothing yet, 1 after a system turn, 2 a reply is due, 3 a pair is
complete. The initials of the edits are the audit; of the cheapest repairs the one whose audit is least in ASCII
order is taken. The next state follows from state and edit, so an audit fixes the repair.

Forward costs from the start state and backward costs from the end state meet in the middle of the rows. Beside
each forward cost the rank of its least audit among those of the four states is carried: audits of equally
many rows are never prefixes of each other (a row's edits are inserts and then one letter for the row), so ranks
pass from row to row, and the crossing with the least audit is known without spelling it. Both
halves are solved the same way, in linear space.

Rows are dealt by ranges of (conversation, order), so a conversation of any length is cut. What begins and
ends inside a range is repaired there. The others are chained: each piece gives its 4 x 4 costs and ranks,
the states between the pieces are found by the same divide and conquer over the pieces, and every piece is
repaired between its two states. Only the hash of the repaired text reads such a conversation in one stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage

WHITE = " \t\n\x0b\x0c\r"
STATES = range(4)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: bytes of text of one conversation that are held while its end is looked for
HELD = 32 << 20
#: characters of a text that take part in the order of rows of one turn; beyond them a hash decides
PREFIX = 256

Table = dict[tuple[int, int], tuple[float, object]]  # from state, to state: cost, and its place among those of the same start


def turned(state: int) -> int:
    """The state after a user or assistant turn, whichever is due."""
    return 3 if state == 2 else 2


def kept(state: int, initial: str) -> int | None:
    """The state after a turn with this initial; a turn without a role leaves it."""
    if initial == "":
        return state
    allowed = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    return allowed.get((initial, state))


def row_table(initial: str, fault: int) -> Table:
    """The cheapest edits of one row, inserts before it included, between any two states."""
    out: Table = {}
    for start in STATES:
        state, inserts = start, ""
        for _ in range(3):
            after = [(DELETE, state, "D")]
            if fault not in (BLANK, DUPLICATE):
                extra = int(fault == TRUNCATED)
                after.append((REROLE + extra, turned(state), "R"))
                if (to := kept(state, initial)) is not None:
                    after.append((KEEP + extra, to, "K"))
            for cost, to, letter in after:
                found = (cost + INSERT * len(inserts), inserts + letter)
                out[start, to] = min(out.get((start, to), found), found)
            state, inserts = turned(state), inserts + "I"
    return out


def ending(state: int) -> tuple[int, str]:
    """The cheapest inserts after the last row."""
    return {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}[state]


class Chain:
    """Tables in a row; costs are kept relative to the least, so that a step seen before is looked up."""

    def __init__(self, tables: dict):
        self.tables = tables
        self.ahead: dict = {}
        self.behind: dict = {}

    def forward(self, codes, start: int, lo: int, hi: int) -> tuple[list[float], tuple[int, ...]]:
        """Cost of reaching each state from ``start``, and the ranks of the least audits."""
        state, base = (tuple(0 if s == start else inf for s in STATES), (0, 0, 0, 0)), 0
        for k in range(lo, hi):
            key = (state, codes[k])
            if key not in self.ahead:
                self.ahead[key] = self.step(state, self.tables[codes[k]])
            state, more = self.ahead[key]
            base += more
        return [base + c for c in state[0]], state[1]

    @staticmethod
    def step(state: tuple, table: Table) -> tuple[tuple, float]:
        costs, ranks = state
        best: list = [(inf, 0, 0)] * 4
        for (a, b), (cost, order) in table.items():
            if costs[a] < inf and (best[b][0] == inf or (costs[a] + cost, ranks[a], order) < best[b]):
                best[b] = (costs[a] + cost, ranks[a], order)
        reached = sorted({x[1:] for x in best if x[0] < inf})
        least = min(x[0] for x in best)
        return (tuple(x[0] - least for x in best), tuple(reached.index(x[1:]) if x[0] < inf else 0 for x in best)), least

    def backward(self, codes, end: int, lo: int, hi: int) -> list[float]:
        """Cost of reaching ``end`` from each state."""
        costs, base = tuple(0 if s == end else inf for s in STATES), 0
        for k in range(hi - 1, lo - 1, -1):
            key = (costs, codes[k])
            if key not in self.behind:
                new = [inf] * 4
                for (a, b), (cost, _) in self.tables[codes[k]].items():
                    new[a] = min(new[a], cost + costs[b])
                self.behind[key] = (tuple(c - min(new) for c in new), min(new))
            costs, more = self.behind[key]
            base += more
        return [base + c for c in costs]

    def crossings(self, codes, start: int, end: int) -> list[int]:
        """The state after each code on the cheapest way from ``start`` to ``end`` with the least audit."""
        out, open_parts = [end] * len(codes), [(0, len(codes), start, end)]
        while open_parts:
            lo, hi, a, b = open_parts.pop()
            if hi - lo < 2:
                continue
            mid = (lo + hi) // 2
            costs, ranks = self.forward(codes, a, lo, mid)
            rest = self.backward(codes, b, mid, hi)
            s = min((s for s in STATES if costs[s] + rest[s] < inf), key=lambda s: (costs[s] + rest[s], ranks[s]))
            out[mid - 1] = s
            open_parts += [(lo, mid, a, s), (mid, hi, s, b)]
        return out

    def last(self, codes) -> tuple[int, int]:
        """Cost of the whole repair, and the state after the last code."""
        costs, ranks = self.forward(codes, 0, 0, len(codes))
        best = min((costs[s] + ending(s)[0], ranks[s], s) for s in STATES if costs[s] < inf)
        return int(best[0]), best[2]


ROWS = {(initial, fault): row_table(initial, fault) for initial in ("s", "u", "a", "", "?") for fault in (FINE, BLANK, DUPLICATE, TRUNCATED)}


def code_of(role: str, fault: int) -> tuple[str, int]:
    initial = role[:1]
    return (initial if initial in ("s", "u", "a", "") else "?", fault)


def edits(chain: Chain, codes: list, start: int, end: int) -> list[str]:
    """The edits of each row between two states."""
    out, state = [], start
    for code, after in zip(codes, chain.crossings(codes, start, end)):
        out.append(chain.tables[code][state, after][1])
        state = after
    return out


class Repaired:
    """The repaired turns of a conversation, hashed as they come."""

    def __init__(self):
        self.state, self.hash, self.begun = 0, hashlib.sha256(), False

    def turn(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def due(self) -> str:
        role = "assistant" if self.state == 2 else "user"
        self.state = turned(self.state)
        return role

    def edit(self, token: str, role: str = "", text: str = "") -> None:
        for letter in token:
            if letter == "I":
                self.turn(self.due(), "")
            elif letter == "R":
                self.turn(self.due(), text)
            elif letter == "K":
                self.turn(role, text)
                self.state = kept(self.state, role[:1])


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def gaps(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repaired(rows: list[tuple]) -> tuple:
    """Counts, audit and hash of a whole conversation: rows of (turn, role, text, blank, truncated) in order."""
    seen, faults = set(), []
    for _, role, text, blank, truncated in rows:
        fault = BLANK if blank else DUPLICATE if (role, text) in seen else TRUNCATED if truncated else FINE
        seen.add((role, text))
        faults.append(fault)
    codes = [code_of(r[1], f) for r, f in zip(rows, faults)]
    chain = Chain(ROWS)
    cost, end = chain.last(codes)
    out, tokens = Repaired(), edits(chain, codes, 0, end)
    for token, row in zip(tokens, rows):
        out.edit(token, row[1], row[2])
    out.edit(ending(end)[1])
    audit = "".join(tokens) + ending(end)[1]
    counts = [gaps([r[0] for r in rows]), *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal([r[1][:1] for r in rows]), cost]
    return (*counts, audit, out.hash.hexdigest())


def ordered(conversations: DataFrame, conv_column: str, turn_column: str, role_column: str, text_column: str, gone: Column) -> DataFrame:
    """Rows dealt by ranges of conversation and order, sorted: conv_id, key, turn, role, text, blank, truncated, gone."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(" "))
    end = F.rtrim(text, F.lit(WHITE))
    conv = F.col(conv_column)
    rows = conversations.select(
        conv.alias("conv_id"), F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")).alias("key"), F.col(turn_column).cast("long").alias("turn"),
        F.coalesce(F.col(role_column).cast("string"), F.lit(" ")).alias("role"), F.when(gone, F.lit("")).otherwise(text).alias("text"),
        (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"), gone.alias("gone"),
    )
    # rows of one turn: by role and text; equal rows have no order and may be cut anywhere
    order = ["key", F.asc_nulls_first("turn"), "role", F.substring("text", 1, PREFIX), F.xxhash64("text")]
    spread = F.xxhash64(F.monotonically_increasing_id())
    return rows.repartitionByRange(*order, spread).sortWithinPartitions(*order)


PIECE = ["segment", "pos", "turn", "role", "text", "fault", "digest", "fresh"]


def pass_schema(conv: T.DataType) -> T.StructType:
    longs, texts = T.LongType(), T.StringType()
    kinds = dict(segment=longs, pos=longs, turn=longs, role=texts, text=texts, fault=T.IntegerType(), digest=T.BinaryType(), fresh=T.BooleanType())
    return T.StructType(
        [T.StructField("conv_id", conv), T.StructField("key", texts), T.StructField("done", T.BooleanType()), *(T.StructField(c, longs) for c in COUNTS)]
        + [T.StructField("audit", texts), T.StructField("repaired_sha256", texts), *(T.StructField(c, kinds[c]) for c in PIECE)]
    )


class Sweep:
    """One range of rows: conversations that end inside it are repaired, rows of the others are handed on."""

    def __init__(self, segment: int):
        self.segment, self.key, self.conv, self.pos = segment, None, None, 0
        self.first, self.held, self.bytes, self.spans = True, [], 0, True
        self.seen: set[bytes] = set()
        self.out: list[tuple] = []

    def row(self, conv, key: str, turn, role: str, text: str, blank: bool, truncated: bool, gone: bool) -> None:
        if key != self.key:
            if self.key is not None:
                self.close(False)
            # the first conversation of a range may have begun in the one before
            self.spans, self.key, self.conv, self.held, self.bytes, self.seen = self.first, key, conv, [], 0, set()
            self.first = False
        self.held.append((turn, role, text, blank, truncated, gone))
        self.bytes += len(text)
        if self.spans or self.bytes > HELD:
            self.spans = True
            self.hand_on()

    def hand_on(self) -> None:
        for turn, role, text, blank, truncated, gone in self.held:
            mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            fault = None if gone else BLANK if blank else TRUNCATED if truncated else FINE
            fresh = not gone and mark not in self.seen
            if fresh:
                self.seen.add(mark)
            self.out.append((self.conv, self.key, False, *[None] * 8, self.segment, self.pos, turn, role, text, fault, mark, fresh))
            self.pos += 1
        self.held, self.bytes = [], 0

    def close(self, last: bool) -> None:
        """The end of a conversation; the last one of a range may go on in the next."""
        if self.spans or last:
            self.hand_on()
        else:
            self.out.append((self.conv, self.key, True, *repaired([r[:5] for r in self.held if not r[5]]), *[None] * len(PIECE)))


def sweep(rows: DataFrame) -> DataFrame:
    schema = pass_schema(rows.schema["conv_id"].dataType)
    arrow = to_arrow_schema(schema)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for *row, segment in zip(*columns):
                state = state or Sweep(segment)
                state.row(*row)
                if len(state.out) >= 4096:
                    yield made(state.out)
                    state.out = []
        if state is not None:
            state.close(True)
            if state.out:
                yield made(state.out)

    names = ["conv_id", "key", "turn", "role", "text", "blank", "truncated", "gone"]
    return rows.select(*names, F.spark_partition_id().cast("long").alias("segment")).mapInArrow(run, schema)


SUMMARY = "key string, segment long, codes array<string>, table array<int>, blank long, duplicate long, truncated long, illegal long, initials array<string>, low long, high long, distinct long, ends array<long>"
PLAN = "key string, segment long, start int, end int, closing string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def summed(pieces: DataFrame) -> DataFrame:
    """One row per piece of a conversation: its codes, its 4 x 4 costs and ranks, and what its counts need."""
    arrow = to_arrow_schema(T._parse_datatype_string(SUMMARY))

    def one(key: tuple, table: pa.Table) -> pa.Table:
        rows = [r for r in table.sort_by("pos").to_pylist() if r["fault"] is not None]
        faults = [BLANK if r["fault"] == BLANK else DUPLICATE if r["again"] or not r["fresh"] else r["fault"] for r in rows]
        codes, chain = [code_of(r["role"], f) for r, f in zip(rows, faults)], Chain(ROWS)
        found = []
        for start in STATES:
            costs, ranks = chain.forward(codes, start, 0, len(codes))
            found += [x for c, k in zip(costs, ranks) for x in (int(c) if c < inf else -1, k)]
        turns, initials = [r["turn"] for r in rows if r["turn"] is not None], [r["role"][:1] for r in rows]
        row = dict(
            key=key[0].as_py(), segment=key[1].as_py(), codes=[f"{c}{f}" for c, f in codes], table=found, blank=faults.count(BLANK), duplicate=faults.count(DUPLICATE),
            truncated=faults.count(TRUNCATED), illegal=illegal(initials), initials=[initials[0], initials[-1]] if rows else [], low=min(turns, default=None), high=max(turns, default=None),
            distinct=len(set(turns)), ends=[turns[0], turns[-1]] if turns else [],
        )
        return pa.Table.from_pylist([row], schema=arrow)

    return pieces.groupBy("key", "segment").applyInArrow(one, SUMMARY)


def planned(summaries: DataFrame) -> DataFrame:
    """States before and after each piece of a conversation, and with its first piece the counts of the whole."""
    arrow = to_arrow_schema(T._parse_datatype_string(PLAN))

    def one(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("segment").to_pylist()  # one row per range that the conversation touches
        tables = {}
        for k, r in enumerate(rows):
            values = list(zip(r["table"][::2], r["table"][1::2]))
            tables[k] = {(i // 4, i % 4): x for i, x in enumerate(values) if x[0] >= 0}
        chain, codes = Chain(tables), list(range(len(rows)))
        cost, end = chain.last(codes)
        states = [0, *chain.crossings(codes, 0, end)]
        filled = [r for r in rows if r["initials"]]
        dated = [r for r in rows if r["ends"]]
        distinct = sum(r["distinct"] for r in dated) - sum(a["ends"][1] == b["ends"][0] for a, b in zip(dated, dated[1:]))
        totals = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
        totals["illegal"] += sum(illegal([a["initials"][1], b["initials"][0]]) for a, b in zip(filled, filled[1:]))
        totals["gaps"] = max(r["high"] for r in dated) - min(r["low"] for r in dated) + 1 - distinct if dated else 0
        totals["cost"] = cost
        out = [dict(key=key[0].as_py(), segment=r["segment"], start=a, end=b, closing="") for r, a, b in zip(rows, states, states[1:])]
        out[0] |= totals
        out[-1]["closing"] = ending(end)[1]
        return pa.Table.from_pylist(out, schema=arrow)

    return summaries.drop("codes").groupBy("key").applyInArrow(one, PLAN)


def edited(summaries: DataFrame, plan: DataFrame) -> DataFrame:
    """The edits of every piece between its two states: key, segment, audit, and the counts that ride on the first."""
    rows = summaries.select("key", "segment", "codes").join(plan, ["key", "segment"])
    names = ["key", "segment", "audit", *COUNTS]
    schema = T.StructType([rows.schema[c] if c != "audit" else T.StructField(c, T.StringType()) for c in names])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                codes = [(c[:-1], int(c[-1])) for c in r["codes"]]
                r["audit"] = "".join(edits(Chain(ROWS), codes, r["start"], r["end"])) + r["closing"]
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in names}], schema=arrow)

    return rows.mapInArrow(run, schema)


def streamed(pieces: DataFrame, audits: DataFrame) -> DataFrame:
    """The results of the conversations that were cut: their rows in order, hashed as they come."""
    fields = ["conv_id", "key", *COUNTS, "audit", "repaired_sha256"]
    schema = T.StructType([pieces.schema[c] for c in fields])
    arrow = to_arrow_schema(schema)
    parts = pieces.select("conv_id", "key", "segment", "pos", "role", "text", (F.col("fault").isNull()).alias("gone"))
    both = parts.unionByName(audits.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts, out, audit, tokens, rest, conv = None, None, Repaired(), [], iter(()), "", None

        def close() -> pa.RecordBatch:
            out.edit(rest)
            row = dict(conv_id=conv, key=key, audit="".join(audit), repaired_sha256=out.hash.hexdigest(), **counts)
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for r in batch.to_pylist():
                if r["key"] != key:
                    if key is not None:
                        yield close()
                    key, counts, out, audit, rest = r["key"], None, Repaired(), [], ""
                if r["pos"] == -1:
                    audit.append(r["audit"])
                    tokens = iter(re.findall("I*[KRD]", r["audit"]))
                    rest = re.search("I*$", r["audit"]).group()
                    counts = counts or {c: r[c] for c in COUNTS}
                    continue
                conv = r["conv_id"]
                if not r["gone"]:
                    out.edit(next(tokens), r["role"], r["text"])
        if key is not None:
            yield close()

    return both.repartition("key").sortWithinPartitions("key", "segment", "pos").mapInArrow(run, schema)


def repair(
    conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", gone: Column | None = None,
) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (nulls first; within a turn by role and text). Rows where ``gone`` holds are not
    there, but their conversation is in the result. A null role or text is one space, so such a text is blank; a row without a
    role has no initial and may stay anywhere, one with another role than s, u or a... must be given one or go. A null
    conversation id is a conversation of its own. Repeated rows are duplicates. A conversation without rows has zeros, an empty audit and
    the hash of the empty string. An empty table gives an empty result. Duplicates across ranges are found by
    128-bit hashes of role and text.
    """
    rows = ordered(conversations, conv_column, turn_column, role_column, text_column, F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False))
    swept = cut_lineage(sweep(rows))
    result = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    done = swept.where("done").select(*result)
    pieces = swept.where("NOT done")
    if pieces.isEmpty():
        return done
    # texts that an earlier piece of their conversation has: one row per piece and text
    fresh = pieces.where("fresh").select("key", "digest", "segment")
    first = fresh.groupBy("key", "digest").agg(F.min("segment").alias("first"))
    again = fresh.join(first, ["key", "digest"]).where("segment > first").select("key", "segment", "digest", F.lit(True).alias("again"))
    narrow = pieces.select("key", "segment", "pos", "turn", "role", "fault", "digest", "fresh")
    marked = narrow.join(again, ["key", "segment", "digest"], "left").withColumn("again", F.coalesce("again", F.lit(False))).drop("digest")
    summaries = cut_lineage(summed(marked))
    return done.unionByName(streamed(pieces, edited(summaries, planned(summaries))).select(*result))


def damaged(conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """conv_id, turn, role, text and gone: a fixed fifth of the rows dropped, emptied, cut, repeated or given the role user."""
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in (conv_column, turn_column))
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in (role_column, text_column))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    return conversations.select(
        F.col(conv_column).alias("conv_id"), F.col(turn_column).cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
