"""Repair of conversations against a plain search over strings of edits, block by block and whole, and against the SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from reelgrid.llm import conversation_repair as C

ROWS = "conv_id long, turn long, role string, text string"


def damage(rows):
    for conv, turn, role, text in rows:
        told = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20, told(role), told(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def plain(rows):
    """One conversation's rows after damage: all results, by keeping for each state the least (cost, audit, repaired)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    ways = {"": (0, "", [])}

    def inserted(ways):
        for _ in range(3):
            for state, (cost, audit, out) in list(ways.items()):
                to = "a" if state == "u" else "u"
                new = (cost + 3, audit + "I", out + [{"u": "user:", "a": "assistant:"}[to]])
                ways[to] = min(ways.get(to, new), new)
        return ways

    for (_, _, role, text), fault in zip(rows, faults):
        new = {}

        def offer(state, way):
            new[state] = min(new.get(state, way), way)

        for state, (cost, audit, out) in inserted(ways).items():
            offer(state, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more, to = 3 * (fault == "truncated"), "a" if state == "u" else "u"
            if role[:1] == to or (role[:1] == "s" and state == ""):
                offer(role[:1], (cost + more, audit + "K", out + [f"{role}:{text}"]))
            offer(to, (cost + 3 + more, audit + "R", out + [f"{'user' if to == 'u' else 'assistant'}:{text}"]))
        ways = new
    ways = inserted(ways)
    cost, audit, out = min(ways[s] for s in ("", "a") if s in ways)
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    n = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *n, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute(rows):
    by = {}
    for r in damage(rows):
        by.setdefault(r[0], []).append(r)
    return {conv: plain(by.get(conv, [])) for conv in {r[0] for r in rows}}


def told(df):
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len({r[0] for r in out})
    return {r[0]: r[1:] for r in out}


def made(n, seed, longest):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(1, longest)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "sudo", None, ""])
            rows.append((conv if conv else None, r.choice([turn, turn, turn, None, turn // 2]), role, r.choice(["Yes.", "Why?", "no", " \n", None, "Done! \t\n", "x", f"t{turn}.", "é.\x85"])))
    return rows


@pytest.mark.parametrize(("block", "bytes_"), [(1024, 4 << 20), (3, 4 << 20), (8, 64)])
def test_made_conversations(spark, block, bytes_):
    rows = made(120, block, 24)
    assert told(C.repairs(spark.createDataFrame(rows, ROWS), block, bytes_)) == brute(rows)


def test_one_long_conversation(spark):
    """Many blocks of one conversation, which holds most rows."""
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice(["a.", f"{t}.", f"{t}"])) for t in range(5000)] + [(8, 0, "user", "Hi.")]
    assert told(C.repairs(spark.createDataFrame(rows, ROWS), 256)) == brute(rows)


def test_table_and_sql(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = told(C.repairs(spark.read.parquet(f"{sf}/conversations.parquet")))
    assert got == brute(rows)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
        assert {r[0]: r[1:] for r in db.execute(C.ORACLE).fetchall()} == got


def test_sql_on_odd_rows(spark):
    rows = made(60, 9, 12)
    with duckdb.connect() as db:
        db.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        assert {r[0]: r[1:] for r in db.execute(C.ORACLE).fetchall()} == brute(rows)


def test_empty_dropped_and_clashing(spark):
    assert told(C.repairs(spark.createDataFrame([], ROWS))) == {}
    gone = next((c, 0) for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(*gone, "user", "Hi."), (None, None, None, None)]
    odd = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS + ", _block string, end long")
    assert told(C.repairs(odd)) == brute(rows)
    assert brute(rows)[gone[0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_very_long_text(spark):
    rows = [(3, 1, "user", "word " * 400_000 + "."), (3, 2, "assistant", "ok." * 300_000), (3, 3, "user", "again")]
    assert told(C.repairs(spark.createDataFrame(rows, ROWS))) == brute(rows)
