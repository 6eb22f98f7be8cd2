import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string"
VALID = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Uniform-cost search over (rows done, roles so far): cost, audit, repaired turns of the least audit."""
    queue = [(0, "", 0, ())]
    while queue:
        cost, audit, k, turns = heapq.heappop(queue)
        initials = "".join(t[0][:1] for t in turns)
        if k == len(rows) and VALID.fullmatch(initials):
            return cost, audit, turns
        if not any(VALID.fullmatch(initials + more) for more in ("", "a", "ua")):
            continue
        if not audit.endswith("III"):
            for role in ("user", "assistant"):
                heapq.heappush(queue, (cost + 2, audit + "I", k, (*turns, (role, ""))))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(queue, (cost + 3, audit + "D", k + 1, turns))
            if fault not in (1, 2):
                extra = int(fault == 3)
                heapq.heappush(queue, (cost + extra, audit + "K", k + 1, (*turns, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 2 + extra, audit + "R", k + 1, (*turns, (new, text))))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        out.append(1 if not stripped else 2 if (role, text) in seen else 3 if stripped[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def plain(rows):
    """Rows of (conv, turn, role, text, gone)."""
    convs = {}
    for conv, turn, role, text, gone in rows:
        kept = convs.setdefault(conv, [])
        if not gone:
            kept.append((turn is not None, turn or 0, turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0], r[1], r[3], r[4]))
        pairs = [r[3:] for r in kept]
        found = faults(pairs)
        cost, audit, turns = cheapest([(*p, f) for p, f in zip(pairs, found)])
        known = [r[2] for r in kept if r[2] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in turns)
        out.append((conv, gaps, found.count(1), found.count(2), found.count(3), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def collected(frame, **options):
    return sorted((tuple(r) for r in dialogue.repair(frame, **options).collect()), key=str)


def made(spark, rows, partitions=3):
    frame = spark.createDataFrame([r[:4] + (r[4],) for r in rows], f"{SCHEMA}, gone boolean").repartition(partitions)
    for name in ("key", "segment", "pos", "fault", "digest", "fresh", "audit", "done", "cost", "copy", "blank", "_text"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame


def some(n, longest, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "Why?", "so", " ", "", None, f"Turn {turn}.", f"é{turn}? \n"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, text, rng.random() < 0.1))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_a_search_over_all_repairs(spark, seed):
    rows = some(25, 7, seed)
    assert collected(made(spark, rows), gone=F.col("gone")) == plain(rows)


@pytest.mark.parametrize("partitions", [2, 9, 40])
def test_conversations_cut_at_any_place(spark, partitions):
    """Few rows in many ranges: nearly every conversation is cut, some into many pieces."""
    rows = some(6, 8, 7) + [(90, t, r, x, False) for t, (r, x) in enumerate([("user", "Hi."), ("assistant", "Hi.")] * 4)] + [(None, None, "user", "A.", False)] * 5 + [(91, 3, "user", "B.", True)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert collected(made(spark, rows), gone=F.col("gone")) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_texts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "HELD", 20)
    rows = some(12, 7, 11) + [(500, 0, "user", "long " * 20_000 + ".", False), (500, 1, "assistant", "long " * 20_000, False)]
    assert collected(made(spark, rows, 1), gone=F.col("gone")) == plain(rows)


def test_long_chain_against_all_states(spark):
    """Divide and conquer against one pass that spells every audit."""
    rng = random.Random(2)
    codes = [(rng.choice("sua?") if rng.random() < 0.95 else "", rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(400)]
    best = {0: (0, "")}
    for code in codes:
        new = {}
        for (a, b), (cost, token) in dialogue.ROWS[code].items():
            if a in best:
                new[b] = min(new.get(b, (10**9, "")), (best[a][0] + cost, best[a][1] + token))
        best = new
    want = min((c + dialogue.ending(s)[0], audit + dialogue.ending(s)[1]) for s, (c, audit) in best.items())
    chain = dialogue.Chain(dialogue.ROWS)
    cost, end = chain.last(codes)
    assert (cost, "".join(dialogue.edits(chain, codes, 0, end)) + dialogue.ending(end)[1]) == want


def test_row_tables_hold_the_cheapest_edits():
    for initial, fault, start in itertools.product(("s", "u", "a", "", "?"), range(4), range(4)):
        for (a, _), (cost, token) in dialogue.ROWS[initial, fault].items():
            if a == start:
                letter = token[-1]
                assert cost == 2 * token.count("I") + {"K": 0, "R": 2, "D": 3}[letter] + (fault == 3 and letter != "D")


def test_damage_and_whole_query(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"Text {t}. Is it? Yes") for c in range(8) for t in range(6)] + [(None, None, None, None), (3, None, None, "x")]
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    table = dialogue.damaged(spark.createDataFrame(rows, SCHEMA).withColumn("copy", F.lit(1)).withColumn("gone", F.lit(1)))
    assert collected(table, gone=F.col("gone")) == plain(want)


def test_empty_table(spark):
    assert dialogue.repair(spark.createDataFrame([], SCHEMA)).collect() == []
