"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import random
import re

import pytest

from cellweave.llm import conversations
from cellweave.llm.conversations import MATRICES, Path, block_states

SCHEMA = "conv long, turn long, role string, text string"


def brute(rows):
    """Faults, cost, audit and text of one conversation's ordered ``(turn, role, text)`` by cheapest-first search."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "fine" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    queue = [(0, "", 0, "")]
    done = set()
    while queue:
        cost, audit, i, roles = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            break
        state = (i, roles[-1:] if len(roles) != 1 or roles != "s" else "s")
        if state in done:
            continue
        done.add(state)
        nexts = "ua" if not roles or roles[-1] != "u" else "a"
        nexts = {"": "u", "s": "u", "u": "a", "a": "u"}[roles[-1:]]
        heapq.heappush(queue, (cost + 5, audit + "I", i, roles + nexts))
        if i < len(rows):
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, roles))
            if faults[i] in ("fine", "truncated"):
                more = 5 * (faults[i] == "truncated")
                role = rows[i][1][:1]
                if role == nexts or (role == "s" and not roles):
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, roles + role))
                if role != nexts:
                    heapq.heappush(queue, (cost + 1 + more, audit + "R", i + 1, roles + nexts))
    out, i, last = [], 0, ""
    for letter in audit:
        other = "assistant" if last == "u" else "user"
        if letter == "I":
            out.append((other, ""))
        else:
            _, role, text = rows[i]
            i += 1
            if letter == "D":
                continue
            out.append((other if letter == "R" else role, text))
        last = out[-1][0][0]
    text = "\n".join(f"{r}:{t}" for r, t in out)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, hashlib.sha256(text.encode()).hexdigest(),
    )


def cases(seed=5, n=120):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "tool", "", "ua"], ["Fine.", "cut", "", " \t", "Yes!", "why?\n", "x", "É"]
    rows = []
    for conv in range(n):
        for k in range(rng.choice([1, 2, 3, 5, 9, 40])):
            turn = rng.choice([None, k, k, k, rng.randrange(6)])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts) + rng.choice(["", f" {rng.randrange(4)}."])))
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, 2, "assistant", "b.")]
    rows += [(-1, 7, "user", "Same.")] * 700  # whole rows that occur again
    return rows


def expected(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, role, text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: brute(sorted(rs, key=key)) for c, rs in by_conv.items()}


@pytest.mark.parametrize("partitions", [1, 13])
def test_edits_by_brute_force(spark, partitions):
    """Many partitions cut conversations into blocks; the result is the same."""
    rows = cases()
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = conversations.report(turns.select("conv"), turns).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(rows)


def test_blocks_agree_with_one_run():
    """Blocks of any size give the path of the undivided run."""
    rng = random.Random(3)
    path = Path()
    for _ in range(300):
        codes = bytes(rng.choice([0, 3, 4, 7, 8, 11, 12, 15, 1, 6]) for _ in range(rng.randrange(1, 40)))
        step = rng.randrange(1, 9)
        pieces = [codes[i : i + step] for i in range(0, len(codes), step)]
        grid = lambda flat: [flat[4 * p : 4 * p + 4] for p in range(4)]
        sums = [tuple(map(grid, path.summary(p))) for p in pieces]
        ends = (0, 10, 5, 0)
        cost, at = block_states(sums, ends)
        whole, states = block_states([MATRICES[c] for c in codes], ends)
        assert cost == whole and at[-1] == states[-1]
        assert "".join(path.audit(p, at[i], at[i + 1]) for i, p in enumerate(pieces)) == path.audit(codes, 0, states[-1])


def test_awkward_inputs(spark):
    schema = "conv_id long, turn long, role string, text string, cost long, audit string"
    rows = [(1, None, None, None, 1, "x"), (2, 1, "user", "Hi.", 2, "y"), (2, 2, "assistant", "a " * 200_000 + "end.", 3, "z"), (None, 3, "user", None, 4, None)]
    given = spark.createDataFrame(rows, schema)
    turns = conversations.plain(given)
    got = {r.conv_id: r for r in conversations.report(turns.select("conv"), turns).collect()}
    assert got[1].blank == 1 and got[1].audit == "D" and got[None].audit == "D" and got[2].audit == "KK" and got[2].cost == 0
    said = conversations.repaired(turns, conversations.edits(turns).select("conv", "audit")).collect()
    assert [(r.conv, r.role, len(r.text)) for r in said] == [(2, "user", 3), (2, "assistant", 400_004)]
    empty = conversations.damaged(given.limit(0))
    assert conversations.report(empty.select("conv"), empty).count() == 0
    dropped = conversations.report(turns.select("conv"), turns.limit(0)).collect()
    assert len(dropped) == 3 and {(r.cost, r.audit, r.repaired_sha256) for r in dropped} == {(0, "", hashlib.sha256(b"").hexdigest())}
