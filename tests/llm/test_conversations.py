"""Repair of conversations against a table of all cheapest edits."""

import hashlib
import random
import zlib
from collections import defaultdict

from prismill.llm import conversations, queries
from prismill.llm.conversations import _FILL, _NEXT, crossing, solve

FAR = (10**9, "")


def by_hand(rows):
    """Faults, cost, edits and digest of a conversation's messages (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)
    best = [[FAR] * 4 for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for place in range(4):
            moves = [(0, "")] if i == n and place in (0, 3) else []
            if i < n:
                initial, extra = rows[i][1][:1], 3 if faults[i] == "truncated" else 0
                add = lambda c, e, to: moves.append((c + best[i + 1][to][0], e + best[i + 1][to][1]))
                add(4, "D", place)
                if faults[i] not in ("blank", "duplicate"):
                    add(3 + extra, "R", _FILL[place])
                    if initial in _NEXT[place]:
                        add(extra, "K", _NEXT[place][initial])
            best[i][place] = min(moves, default=FAR)
        for _ in range(4):
            for place in range(4):
                there = best[i][_FILL[place]]
                best[i][place] = min(best[i][place], (there[0] + 3, "I" + there[1]))
    cost, audit = best[0][0]
    at, place, out = 0, 0, []
    for edit in audit:
        role = ("user", "user", "assistant", "user")[place]
        if edit == "K":
            role = rows[at][1]
        if edit != "D":
            out.append(f"{role}:{'' if edit == 'I' else rows[at][2]}")
            place = _NEXT[place][role[:1]]
        at += edit != "I"
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def repaired(spark, rows):
    schema = "conv_id string, turn long, role string, text string, conv string, position long, segment string"
    messages = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema)
    summary, edits = conversations.find_edits(messages)
    hashes = {r["conv"]: r["sha256"] for r in conversations.digests(conversations.repaired_messages(messages, edits)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r["conv"]: (*list(r.asDict().values())[1:], hashes.get(r["conv"], empty)) for r in summary.collect()}


def compare(spark, rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn, " " if role is None else role, " " if text is None else text))
    got = repaired(spark, rows)
    assert set(got) == set(own)
    for conv, messages in own.items():
        assert got[conv] == by_hand(messages), conv


def some(luck, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None]
    texts = ["Yes.", "No!", "Why? ", "cut off", "", " \n", None, "Fine.\x0b", "a b c."]
    return [(luck.choice([None, i, i, i, i + 1]), luck.choice(roles), luck.choice(texts) if luck.random() < 0.5 else f"{i} {luck.choice(['says.', 'said'])}") for i in range(n)]


def test_small_conversations(spark):
    luck = random.Random(1)
    rows = [(f"c{c:03d}", *m) for c in range(150) for m in some(luck, luck.randrange(1, 9))]
    compare(spark, rows + [(None, *m) for m in some(luck, 5)] + [("", 1, "user", "x " * 50_000 + ".")])


def test_conversations_over_many_segments(spark, monkeypatch):
    """The whole, and its segments, blocks and places between them."""
    monkeypatch.setattr(conversations, "SEGMENT", 7)
    monkeypatch.setattr(conversations, "_BLOCK", 3)
    luck = random.Random(2)
    rows = [("long", *m) for m in some(luck, 120)] + [(f"c{c}", *m) for c in range(20) for m in some(luck, 6)]
    compare(spark, rows)


def test_search_in_blocks_and_costs_between_segments():
    luck = random.Random(3)
    for _ in range(60):
        codes = [luck.choice("sssuuuaaat") + luck.choice("000123") for _ in range(luck.randrange(1, 40))]
        over = crossing(codes)
        for end in range(4):
            rest = [50, 50, 50, 50]
            rest[end] = 0
            found = solve(codes, rest)
            for start in range(4):
                assert found[start].cost == min(over[4 * start + q] + rest[q] for q in range(4))


def test_no_messages(spark):
    assert repaired(spark, []) == {}


def test_query_on_the_given_conversations(spark):
    folder = "/root/testdata/sf0.001"
    own, every = defaultdict(list), set()
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        every.add(r["conv_id"])
        harm = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if harm == 1 else r["text"].translate({ord(c): None for c in ".!?"}) if harm == 2 else r["text"]
        own[r["conv_id"]] += [(r["turn"], "user" if harm == 4 else r["role"], text)] * {0: 0, 3: 2}.get(harm, 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, folder).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: by_hand(own[c]) if own[c] else empty for c in every}
    assert sum(g[5] for g in got.values()) > 0
