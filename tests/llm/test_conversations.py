"""Conversation repair against a plain search over all edits, whole and in pieces."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()
STEP = {"": "su", "s": "u", "u": "a", "a": "u"}


def order(row):
    return (row[0] is not None, row[0] or 0, row[1], row[2])


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Dijkstra over (cost, audit): the first end reached is the cheapest with the least audit."""
    kinds = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(lines)
        for new in ("user", "assistant"):
            if new[0] in STEP[state]:
                heapq.heappush(heap, (cost + 5, audit + "I", at, new[0], (*lines, new + ":")))
        if at == len(rows):
            continue
        _, role, text = rows[at]
        heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, lines))
        if kinds[at] in ("blank", "duplicate"):
            continue
        more = 5 * (kinds[at] == "truncated")
        for label, own in (("K", role), ("R", "user"), ("R", "assistant")):
            if own[:1] and own[0] in STEP[state]:
                heapq.heappush(heap, (cost + more + (label == "R"), audit + label, at + 1, own[0], (*lines, f"{own}:{text}")))


def plain(rows):
    rows = sorted(rows, key=order)
    kinds, turns = faults(rows), {r[0] for r in rows if r[0] is not None}
    cost, audit, text = cheapest(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def made(seed, conversations=40, most=14):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, most)):
            turn = rng.choice([t, t, t, None, t + 3])
            rows.append((c, turn, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "ä"]), rng.choice(["a.", "b", "", " \t", "long text!", "c?\n", f"t{t}."])))
    return rows


def by_conversation(rows):
    out = {}
    for c, *row in rows:
        out.setdefault(c, []).append(tuple(row))
    return out


def values(row):
    return tuple(row[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


@pytest.mark.parametrize("seed", range(4))
def test_whole_conversations_match_the_plain_search(seed):
    own = [sorted(rows, key=order) for rows in by_conversation(made(seed, 300)).values()]
    for rows, found in zip(own, conversations.solve(own), strict=True):
        assert (*found[:7], hashlib.sha256(found[7].encode()).hexdigest()) == plain(rows), rows


def test_ties_go_to_the_least_audit():
    rows = [(0, "user", "a."), (1, "user", "b."), (2, "assistant", "c.")]
    assert next(conversations.solve([rows]))[5:7] == (2, "DKK")
    assert next(conversations.solve([[]]))[5:] == (0, "", "")


@pytest.mark.parametrize("long", [dict(), dict(long_rows=0, piece_rows=3), dict(long_rows=5, piece_rows=4)])
def test_frames_match_the_plain_search(spark, long):
    rows = made(9, 30) + [(None, 1, "user", "x."), (None, 2, "assistant", "y."), (77, 1, "user", "z.")] + [(78, 5, "user", "same.")] * 25
    rows += [(99, i, ["user", "assistant"][(i + i // 7) % 2], f"{'text' if i % 5 else ''} {i % 11}{'.' if i % 3 else ''}") for i in range(60)]
    got = {r.conv_id: values(r) for r in conversations.repair(spark.createDataFrame(rows, SCHEMA), **long).collect()}
    assert got == {c: plain(own) for c, own in by_conversation(rows).items()}


def test_null_values_extra_columns_and_empty_table(spark):
    table = spark.createDataFrame([(1, None, None, None), (1, 0, "user", None)], SCHEMA).selectExpr("*", "1 AS conv", "2 AS part", "'x' AS audit")
    assert [values(r) for r in conversations.repair(table).collect()] == [(0, 2, 0, 0, 1, 4, "DD", EMPTY)]
    assert conversations.repair(table.limit(0)).collect() == []


def damage(rows):
    out = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(ch for ch in text if ch not in ".!?")
        out += [(c, t, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def test_query_over_the_written_table(spark, tmp_path):
    rows = made(3, 120) + [(None, None, None, None), (None, 3, "user", "hi."), (500, None, "user", "x")]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    result = queries.op11_conversation_repair(spark, str(tmp_path))
    assert result.dtypes[1:7] == [(c, "bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    want = {c: (0, 0, 0, 0, 0, 0, "", EMPTY) for c, *_ in rows} | {c: plain(own) for c, own in by_conversation(damage(rows)).items()}
    assert {r.conv_id: values(r) for r in result.collect()} == want and want[dropped][7] == EMPTY


def test_costs_of_a_long_run_are_found_in_pieces():
    rng = np.random.default_rng(0)
    initial, forced, cut = rng.integers(0, 4, 400), rng.random(400) < 0.2, rng.random(400) < 0.2
    whole = conversations.Runs(initial, forced, cut, np.array([400]), conversations.LAST[None])
    right = conversations.Runs(initial[150:], forced[150:], cut[150:], np.array([250]), conversations.LAST[None])
    left = conversations.Runs(initial[:150], forced[:150], cut[:150], np.array([150]), right.cost[0][None])
    assert left.cost[0].tolist() == whole.cost[0].tolist()
    ((head, state),) = left.audits([0])[0]
    ((tail, _),) = right.audits([state])[0]
    assert head + tail == whole.audits([0])[0][0][0]
