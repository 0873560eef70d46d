"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from scholium.llm import conversations, queries

BLANKS = " \t\n\v\f\r"


def faults(rows):
    seen, found = set(), []
    for row in rows:
        shown = row[1].strip(BLANKS)
        found.append("blank" if not shown else "duplicate" if row in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add(row)
    return found


def repaired(rows):
    """``(cost, audit, digest)`` by uniform-cost search over edit strings."""
    found, heap, best, results = faults(rows), [(0, "", 0, ())], None, []
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if best is not None and cost > best:
            break
        initials = "".join(r[:1] or "-" for r, _ in out)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = cost
            results.append((audit, out))
            continue
        if len(out) > len(rows) + 4 or not re.fullmatch("s?(ua)*u?", initials):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, (*out, (role, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if found[i] not in ("blank", "duplicate"):
                extra = 3 * (found[i] == "truncated")
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + extra + 3, audit + "R", i + 1, (*out, (new, text))))
    audit, out = min(results)
    return best, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


@pytest.mark.parametrize("block", [2, 3, 1 << 16])
def test_cheapest_edits(monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "", "u"]), rng.choice(["A.", "b", "", "c!", " d ", "e?"])) for _ in range(rng.randint(0, 5))]
        one = conversations.Conversation(rng.choice([3, 1 << 20]), rng.choice([1, 2, 100]))
        for turn, row in enumerate(rows):
            one.add(turn, *row)
        found = faults(rows)
        assert one.report()[1:4] == tuple(found.count(k) for k in ("blank", "duplicate", "truncated"))
        assert one.report()[5:] == repaired(rows)


def test_digests_beyond_memory():
    few, all_ = conversations.Seen(7), set()
    rng = random.Random(1)
    for _ in range(3000):
        digest = bytes([rng.choice([0, 7]), rng.randrange(256), rng.randrange(3)]) + bytes(13)
        assert few.add(digest) == (digest not in all_)
        all_.add(digest)
        assert len(few.fresh) < 7


def plain_report(rows):
    """The contract's columns for ``rows (turn, role, text)`` of one conversation in order."""
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [(r, x) for _, r, x in rows]
    found = faults(pairs)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, *repaired(pairs))


def test_query_on_damaged_rows(spark, sf_dir):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        kind, role, text = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20, r["role"], r["text"]
        rows = by[r["conv_id"]]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows.extend([(r["turn"], "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    got = {r[0]: tuple(r)[1:] for r in queries.op12_conversations(spark, sf_dir).collect()}
    assert got == {conv: plain_report(sorted(rows)) for conv, rows in by.items()}


def test_odd_rows(spark):
    schema = "conv_id string, turn int, role string, text string, conv string, present string, numbered int"
    rows = [
        ("a", None, "system", "S."), ("a", None, None, None), ("a", 3, "user", "Hi."), ("a", 3, "user", "Hi."), ("a", 9, "assistant", "x" * 3_000_000),
        (None, 1, "user", "Q?"), (None, 2, "assistant", "A."), ("", 5, "user", ""), ("b", 2**31 - 1, "", "é. \n"),
    ]
    df = spark.createDataFrame([(*r, "c", "p", 1) for r in rows], schema)
    got = {r[0]: tuple(r)[1:] for r in conversations.repair_report(df).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert got == {conv: plain_report(sorted(own, key=key)) for conv, own in by.items()}
    turns = conversations.repaired_turns(df).orderBy("conv_id", "position").collect()
    for conv in by:
        lines = "\n".join(f"{r['role']}:{r['text']}" for r in turns if r["conv_id"] == conv)
        assert hashlib.sha256(lines.encode()).hexdigest() == got[conv][-1]
    assert conversations.repair_report(df.filter("turn < 0")).count() == 0
    gone = conversations.repair_report(df, df["present"] == "q").collect()
    assert {tuple(r)[1:] for r in gone} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(gone) == 4


def test_a_giant_conversation(spark):
    n = 40_000
    rows = spark.range(n).selectExpr(
        "7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', if(id % 500 = 1, 'tool', 'assistant')) AS role", "concat('t', id, '.') AS text"
    )
    (row,) = conversations.repair_report(rows).collect()
    assert (row["gaps"], row["duplicate"], row["illegal"]) == (0, 0, 2 * n // 500)
    assert row["cost"] == 3 * n // 500 and row["audit"].count("R") == n // 500 and len(row["audit"]) == n
