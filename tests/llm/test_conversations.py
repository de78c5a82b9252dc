"""Conversation repair against an enumeration of all edits, and over blocks."""

import hashlib
import itertools
import random
import zlib

import pytest

from tracewell.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\f\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """By trying every alignment with every legal sequence of roles that can be of use."""
    kinds, n = faults(rows), len(rows)
    found = []
    for opening, pairs in itertools.product((0, 1), range(n // 2 + 2)):
        goal = "s" * opening + "ua" * pairs
        if opening and not pairs:
            continue

        def walk(i, j, cost, audit, lines, goal=goal):
            if i == n and j == len(goal):
                found.append((cost, audit, "\n".join(lines)))
            if j < len(goal) and goal[j] != "s":
                walk(i, j + 1, cost + 5, audit + "I", [*lines, {"u": "user:", "a": "assistant:"}[goal[j]]])
            if i < n:
                walk(i + 1, j, cost + 2, audit + "D", lines)
                if j < len(goal) and kinds[i] not in ("blank", "duplicate"):
                    more = 5 * (kinds[i] == "truncated")
                    if rows[i][0][:1] == goal[j]:
                        walk(i + 1, j + 1, cost + more, audit + "K", [*lines, ":".join(rows[i])])
                    if goal[j] != "s":
                        walk(i + 1, j + 1, cost + 1 + more, audit + "R", [*lines, {"u": "user", "a": "assistant"}[goal[j]] + ":" + rows[i][1]])

        walk(0, 0, 0, "", [])
    return min(found)


def ordered(rows):
    return [r[1:] for r in sorted(((t is not None, t or 0), " " if role is None else role, " " if text is None else text) for t, role, text in rows)]


def made(rng, n):
    return [(rng.choice([None, 0, 1, 1, 2, 3, 4, 5, 9]), rng.choice(["user", "assistant", "system", "tool", "", None, "u", "Assistant"]), rng.choice(["One.", "Two?", "Three", "", "  \n", "Two? ", "Four!\x85", "Fünf 日", None, "a\nb."])) for _ in range(n)]


def test_every_alignment(spark):
    rng = random.Random(3)
    talks = {i: made(rng, i % 5) for i in range(220)}
    talks[None] = made(rng, 4)
    rows = [(i, *r) for i, rs in talks.items() for r in rs]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "'x' AS fault", "0 AS list", "0 AS best", "0 AS at")
    got = {r["conv_id"]: r for r in conversations.repair_conversations(df).collect()}
    assert got.keys() == {i for i, rs in talks.items() if rs}
    for i, r in got.items():
        own = ordered(talks[i])
        kinds, turns = faults(own), [t for t, _, _ in talks[i] if t is not None]
        pairs = [a[:1] + b[:1] for (a, _), (b, _) in itertools.pairwise(own)]
        assert (r["cost"], r["audit"], r["repaired"]) == cheapest(own), own
        assert (r["turns"], r["gaps"], r["illegal"]) == (len(own), max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, sum(p not in ("su", "ua", "au") for p in pairs))
        assert [r[k] for k in ("blank", "duplicate", "truncated")] == [kinds.count(k) for k in ("blank", "duplicate", "truncated")]


def test_blocks_fold_as_the_whole(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No.", "Why", f"{t}.", f"{t}!", ""])) for i in range(6) for t in range(rng.choice([1, 7, 40, 90]))]
    rows += [(6, t, "user", "again.") for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, conversations.repair_conversations(df).collect()))
    monkeypatch.setattr(conversations, "CHUNK", 7)
    assert sorted(map(tuple, conversations.repair_conversations(df).collect())) == whole
    assert whole[-1][8].count("D") == 700


def test_damage(spark):
    rng = random.Random(5)
    rows = [(rng.choice([*range(60), None]), rng.choice([*range(9), None]), rng.choice(["user", "assistant", None]), rng.choice(["One. Two!", None, "", "Why?"])) for _ in range(400)]
    left, seen = [], set()
    for i, t, role, text in rows:
        c = zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
        seen.add(i)
        role, text = " " if role is None else role, " " if text is None else text
        row = (i, t, "user" if c == 4 else role, "" if c == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if c == 2 else text)
        left += [row] * (0 if c == 0 else 2 if c == 3 else 1)
    damaged = conversations.damage(spark.createDataFrame(rows, SCHEMA))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:4] for r in damaged.where("present").collect()), key=key) == sorted(left, key=key)
    assert {r["conv_id"] for r in conversations.repair_conversations(damaged).collect()} == seen


def test_nothing_left_and_no_rows(spark):
    gone = spark.createDataFrame([(1, 1, "user", "a.", False), (2, -(1 << 63), "user", "a.", True), (2, (1 << 63) - 1, "assistant", "b.", True)], SCHEMA + ", present boolean")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair_conversations(gone).collect()}
    assert got == {1: (0,) * 7 + ("", ""), 2: (2, (1 << 63) - 1, 0, 0, 0, 0, 0, "KK", "user:a.\nassistant:b.")}
    assert conversations.repair_conversations(conversations.damage(spark.createDataFrame([], SCHEMA))).collect() == []


def test_query_has_the_hash_of_the_lines(spark):
    from tracewell.llm import queries

    got = queries.op13_conversation_repair(spark, "/root/testdata/sf0.001").collect()
    want = conversations.repair_conversations(conversations.damage(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))).collect()
    assert {(r["conv_id"], r["repaired_sha256"]) for r in got} == {(r["conv_id"], hashlib.sha256(r["repaired"].encode()).hexdigest()) for r in want}


@pytest.mark.parametrize("n", [100_000])
def test_one_conversation_of_many_turns(spark, n):
    df = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat(id, '.') AS text")
    r = conversations.repair_conversations(df).collect()[0]
    assert (r["cost"], r["audit"] == "K" * n, r["repaired"].count("\n")) == (0, True, n - 1)
