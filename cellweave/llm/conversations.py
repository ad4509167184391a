"""Repair of conversations: the cheapest edits that make the roles alternate.

A conversation should read ``(system? (user assistant)+)?``. Rows are kept (0), given the
role user or assistant (1), deleted (2, a must for blank rows and repeats), and empty user
or assistant rows are inserted (5); a truncated row that stays costs 5 more. Of the
cheapest edits those with the least string of initials (D, I, K, R) are chosen.

The method is Hirschberg's: four states (nothing yet, after system, after user, after
assistant), a forward vector of costs up to the middle, a backward one from the end, the
crossing of least cost and, among ties, of least audit, then the same for both halves. A
step's string is any inserts and one letter for its row, so the strings of a half are
never prefixes of each other and a rank per state is all that the comparison needs; no
table of back pointers is kept.

Rows are numbered by one range sort over all conversations, so a long conversation is
cut into blocks (its rows of one sorted partition). Every block becomes a 4 x 4 step of
costs and ranks; the same recursion finds the crossings between the blocks of a
conversation, then those inside each block, so no task holds more than a block. Repeats
are found by a grouped minimum of a digest. Only writing out the repaired rows, whose
digest is a sequential hash, streams a conversation through one task, from disk.

Defined cases: a null role or text is one space, so such a row is blank or has no legal
role; a null conversation id is a conversation; null turns come first; rows of one turn
go by role, then text, by bytes; whole rows that occur again are repeats; a conversation
without rows has cost 0, no audit and no repaired rows; an empty table gives an empty
result. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import materialize

# Costs of the edits.
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States, and how many inserts lead from one to another without a row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
INSERTS = {(p, p): 0 for p in range(4)} | {
    (NOTHING, USER): 1, (NOTHING, ASSISTANT): 2, (SYSTEM, USER): 1, (SYSTEM, ASSISTANT): 2, (USER, ASSISTANT): 1, (ASSISTANT, USER): 1,
}
FAR = 1 << 40

#: Role classes by initial, and faults; a row's code is ``4 * role + fault``.
ROLES = "sua"
FINE, BLANK, REPEATED, CUT = range(4)
SPACES = " \t\n\x0b\x0c\r"
PART_BITS = 33  # of the row numbers: rows of one partition

FAULTS = ("blank", "duplicate", "truncated")


def _row_steps(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest cost, then least string, of a row's step between two states."""
    role, fault = divmod(code, 4)
    after = {}
    for p in range(4):
        after[p, p] = (DELETE, "D")
    if fault not in (BLANK, REPEATED):
        stays = TRUNCATED if fault == CUT else 0
        for p, q in ((NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
            after[p, q] = (stays, "K") if role == q - USER + 1 else (stays + RELABEL, "R")
        if role == 0:
            after[NOTHING, SYSTEM] = (stays, "K")
    steps: dict[tuple[int, int], tuple[int, str]] = {}
    for (p, m), n in INSERTS.items():
        for (m2, q), (cost, letter) in after.items():
            if m == m2:
                new = (INSERT * n + cost, "I" * n + letter)
                steps[p, q] = min(steps.get((p, q), new), new)
    return steps


STEPS = [_row_steps(code) for code in range(16)]
TAIL = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def _matrix(steps: dict[tuple[int, int], tuple[int, str]]):
    """Rows of costs and of ranks of the strings among the targets of a state."""
    costs = [[steps.get((p, q), (FAR, ""))[0] for q in range(4)] for p in range(4)]
    ranks = [[0] * 4 for _ in range(4)]
    for p in range(4):
        for rank, q in enumerate(sorted((q for q in range(4) if (p, q) in steps), key=lambda q: steps[p, q][1])):
            ranks[p][q] = rank
    return costs, ranks


#: One step per row code.
MATRICES = [_matrix(s) for s in STEPS]

START = tuple(tuple((0 if q == p else FAR, 0) for q in range(4)) for p in range(4))


def forward(vector: tuple, matrix) -> tuple:
    """``(cost, rank)`` of every state after a step; ranks order the least strings that reach the states."""
    costs, ranks = matrix
    chosen = []
    for q in range(4):
        best = (FAR, 0, 0)
        for p in range(4):
            cost = vector[p][0] + costs[p][q]
            if cost < FAR:
                best = min(best, (cost, vector[p][1], ranks[p][q]))
        chosen.append(best)
    order = {key: i for i, key in enumerate(sorted({c[1:] for c in chosen if c[0] < FAR}))}
    return tuple((c[0], order[c[1:]]) if c[0] < FAR else (FAR, 0) for c in chosen)


def backward(costs_after: tuple, matrix) -> tuple:
    costs = matrix[0]
    return tuple(min(FAR, min(costs[p][q] + costs_after[q] for q in range(4))) for p in range(4))


class Path:
    """Crossings of a run of steps by divide and conquer; vectors of row codes are remembered.

    Vectors are kept relative to their least cost. Only few differ, so a step over a row
    code is one look-up.
    """

    def __init__(self):
        self.ahead: dict = {}
        self.back: dict = {}

    def after(self, vector: tuple, codes) -> tuple[int, tuple]:
        """Least cost so far and the relative vector after rows of the given codes."""
        total, ahead = 0, self.ahead
        for code in codes:
            found = ahead.get((vector, code))
            if found is None:
                new = forward(vector, MATRICES[code])
                least = min(c for c, _ in new)
                found = ahead[vector, code] = (least, tuple((c - least, r) if c < FAR else (FAR, 0) for c, r in new))
            total += found[0]
            vector = found[1]
        return total, vector

    def before(self, costs: tuple, codes) -> tuple:
        """Relative costs before the rows, up to a constant."""
        back = self.back
        for code in reversed(codes):
            found = back.get((costs, code))
            if found is None:
                new = backward(costs, MATRICES[code])
                least = min(new)
                found = back[costs, code] = tuple(c - least if c < FAR else FAR for c in new)
            costs = found
        return costs

    def states(self, codes: bytes, start: int, end: int) -> list[int]:
        """The state before each row and after the last."""
        found = [start] * len(codes) + [end]
        spans = [(0, len(codes))]
        while spans:
            lo, hi = spans.pop()
            if hi - lo < 2:
                continue
            mid = (lo + hi) // 2
            _, left = self.after(START[found[lo]], codes[lo:mid])
            right = self.before(tuple(0 if q == found[hi] else FAR for q in range(4)), codes[mid:hi])
            found[mid] = crossing(left, right)
            spans += [(lo, mid), (mid, hi)]
        return found

    def audit(self, codes: bytes, start: int, end: int) -> str:
        at = self.states(codes, start, end)
        return "".join(STEPS[code][at[i], at[i + 1]][1] for i, code in enumerate(codes))

    def summary(self, codes: bytes) -> tuple[list[int], list[int]]:
        """The 4 x 4 costs and ranks of all rows as one step."""
        costs, ranks = [], []
        for start in START:
            total, vector = self.after(start, codes)
            costs += [total + c if c < FAR else FAR for c, _ in vector]
            ranks += [r for _, r in vector]
        return costs, ranks


def crossing(left: tuple, right: tuple) -> int:
    """The state of least cost in both vectors, ties by the left string."""
    return min((left[q][0] + right[q], left[q][1], q) for q in range(4) if left[q][0] < FAR and right[q] < FAR)[2]


def block_states(matrices: list, end_costs: tuple) -> tuple[int, list[int]]:
    """Cost of the best way through the blocks of a conversation and the states between them."""
    vector = START[NOTHING]
    for m in matrices:
        vector = forward(vector, m)
    end = crossing(vector, end_costs)
    found = [NOTHING] * len(matrices) + [end]
    spans = [(0, len(matrices))]
    while spans:
        lo, hi = spans.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        left = START[found[lo]]
        for m in matrices[lo:mid]:
            left = forward(left, m)
        right = tuple(0 if q == found[hi] else FAR for q in range(4))
        for m in reversed(matrices[mid:hi]):
            right = backward(right, m)
        found[mid] = crossing(left, right)
        spans += [(lo, mid), (mid, hi)]
    return vector[end][0] + end_costs[end], found


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text)`` with a fixed share of rows dropped, emptied, cut, repeated or given another role."""
    space = F.lit(" ")
    name = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(name(conv), F.lit(":"), name(turn))) % 20
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), name(role).alias("role"), name(text).alias("text"), kind.alias("kind")
    ).filter("kind <> 0")
    return rows.select(
        "conv",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def plain(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text)`` of the rows as they are, nulls of role and text as one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), name(role), name(text)).toDF("conv", "turn", "role", "text")


def numbered(turns: DataFrame) -> DataFrame:
    """Every row's number in the order of all conversations, its role class, faults seen in the row alone, and a digest.

    Equal rows are told apart by their place in the input, so any number of them spreads over the partitions.
    """
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(end == "", BLANK).when(end.isin(".", "!", "?"), FINE).otherwise(CUT)
    whose = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("null"))
    order = ["conv", "turn", "role", "text"]
    placed = turns.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*order, "spread").sortWithinPartitions(*order)
    return materialize(
        placed.select(
            "conv",
            "turn",
            F.monotonically_increasing_id().alias("row"),
            role.cast("tinyint").alias("role"),
            fault.cast("tinyint").alias("fault"),
            F.unhex(F.md5(F.concat_ws("\x00", whose, "role", "text"))).alias("digest"),
        ),
        "turns",
    )


def blocks(rows: DataFrame) -> DataFrame:
    """``(conv, part, codes)``: row codes of a conversation's rows of one sorted partition, in order."""
    first = rows.filter(F.col("fault") != BLANK).groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1")
    marked = rows.join(first.select("digest", "first"), "digest", "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("row") > F.col("first")), REPEATED).otherwise(F.col("fault"))
    code = F.struct("row", (F.col("role") * 4 + fault).cast("tinyint").alias("code"))
    return marked.groupBy("conv", F.shiftright("row", PART_BITS).alias("part")).agg(F.array_sort(F.collect_list(code)).alias("c")).select(
        "conv", "part", F.col("c.code").alias("codes")
    )


def _illegal(roles: np.ndarray) -> int:
    """Neighbours other than system-user, user-assistant and assistant-user."""
    a, b = roles[:-1], roles[1:]
    return int((~(((a == 0) | (a == 2)) & (b == 1) | (a == 1) & (b == 2))).sum())


SUMMARY = "conv {0}, part long, codes array<byte>, costs array<long>, ranks array<long>, first int, last int, blank long, duplicate long, truncated long, illegal long"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path = Path()
    for batch in batches:
        out = {k: [] for k in ("costs", "ranks", "first", "last", *FAULTS, "illegal")}
        lists = batch.column(2)
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for lo, hi in zip(ends[:-1], ends[1:]):
            codes = flat[lo:hi].astype(np.uint8)
            costs, ranks = path.summary(codes.tobytes())
            role, fault = codes >> 2, codes & 3
            row = (costs, ranks, int(role[0]), int(role[-1]), *(int((fault == f).sum()) for f in (BLANK, REPEATED, CUT)), _illegal(role))
            for k, v in zip(out, row):
                out[k].append(v)
        types = [pa.list_(pa.int64())] * 2 + [pa.int32()] * 2 + [pa.int64()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), lists, *(pa.array(v, t) for v, t in zip(out.values(), types))],
            names=["conv", "part", "codes", *out],
        )


PATHS = "conv {0}, cost long, illegal long, tail string, ways array<struct<part: long, begin: int, end: int>>"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    end_costs = tuple(INSERT * len(TAIL[q]) for q in range(4))
    for batch in batches:
        costs, tails, ways, illegal = [], [], [], []
        for parts in batch.column(1).to_pylist():
            matrices = [
                ([x["costs"][4 * p : 4 * p + 4] for p in range(4)], [x["ranks"][4 * p : 4 * p + 4] for p in range(4)]) for x in parts
            ]
            cost, at = block_states(matrices, end_costs)
            costs.append(cost)
            tails.append(TAIL[at[-1]])
            illegal.append(sum(_illegal(np.array([a["last"], b["first"]])) for a, b in zip(parts, parts[1:])))
            ways.append([{"part": x["part"], "begin": at[i], "end": at[i + 1]} for i, x in enumerate(parts)])
        way = pa.list_(pa.struct([("part", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(costs, pa.int64()), pa.array(illegal, pa.int64()), pa.array(tails, pa.string()), pa.array(ways, way)],
            names=["conv", "cost", "illegal", "tail", "ways"],
        )


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path = Path()
    for batch in batches:
        lists = batch.column(2)
        flat, ends = lists.flatten().to_numpy().astype(np.uint8), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        found = [
            path.audit(flat[lo:hi].tobytes(), b, e)
            for lo, hi, b, e in zip(ends[:-1], ends[1:], batch.column(3).to_pylist(), batch.column(4).to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["conv", "part", "audit"])


def edits(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``(conv, turn, role, text)``: gaps, faults, illegal neighbours, cost and audit."""
    kind = turns.schema["conv"].dataType.simpleString()
    rows = numbered(turns)
    spans = (
        rows.groupBy("conv", "turn").agg(F.count("*").alias("n")).groupBy("conv")
        .agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    )
    whole = materialize(blocks(rows).mapInArrow(_summaries, SUMMARY.format(kind)), "conversation-blocks")
    parts = F.array_sort(F.collect_list(F.struct("part", "costs", "ranks", "first", "last")))
    ways = whole.groupBy("conv").agg(parts.alias("parts")).mapInArrow(_paths, PATHS.format(kind))
    ways = materialize(ways, "conversation-paths")
    each = ways.select("conv", F.explode("ways").alias("w")).select(F.col("conv").alias("c"), "w.*")
    inside = whole.join(each, F.col("conv").eqNullSafe(F.col("c")) & (whole.part == each.part)).select(
        "conv", whole.part, "codes", "begin", "end"
    )
    audits = inside.mapInArrow(_audits, f"conv {kind}, part long, audit string").groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("part", "audit"))).alias("a")
    )
    sums = whole.groupBy("conv").agg(*(F.sum(c).alias(c) for c in FAULTS), F.sum("illegal").alias("inner"))
    found = sums
    for more in (spans, ways.drop("ways"), audits):
        more = more.withColumnRenamed("conv", "c")
        found = found.join(more, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    return materialize(
        found.select(
            "conv",
            F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"),
            *FAULTS,
            (F.col("inner") + F.col("illegal")).alias("illegal"),
            "cost",
            F.concat(F.array_join("a.audit", ""), "tail").alias("audit"),
        ),
        "conversation-edits",
    )


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply the audits to rows that come sorted by conversation, the audit first."""
    audit, at, last = "", 0, ""

    def inserted(conv, out):
        nonlocal at, last
        while at < len(audit) and audit[at] == "I":
            last = "assistant" if last == "u" else "user"
            out.append((conv, last, ""))
            last = last[0]
            at += 1

    open_conv, started = None, False
    for batch in batches:
        out: list[tuple] = []
        for conv, letters, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if letters is not None:
                if started:
                    inserted(open_conv, out)
                audit, at, last, open_conv, started = letters, 0, "", conv, True
                continue
            inserted(conv, out)
            letter = audit[at]
            at += 1
            if letter == "D":
                continue
            if letter == "R":
                role = "assistant" if last == "u" else "user"
            last = role[:1]
            out.append((conv, role, text))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], batch.schema.field((0, 2, 3)[i]).type) for i in range(3)], names=["conv", "role", "text"])
    if started:
        out = []
        inserted(open_conv, out)
        types = (batch.schema.field(0).type, batch.schema.field(2).type, batch.schema.field(3).type)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], types[i]) for i in range(3)], names=["conv", "role", "text"])


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """``(conv, role, text)`` of the repaired conversations, each whole and in order within one partition."""
    kind = turns.schema["conv"].dataType.simpleString()
    kinds = {f.name: f.dataType for f in turns.schema}
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    heads = audits.select("conv", F.lit(0).alias("is_row"), "audit", none("turn", kinds["turn"]), none("role", "string"), none("text", "string"))
    rows = turns.select("conv", F.lit(1).alias("is_row"), none("audit", "string"), "turn", "role", "text")
    ordered = heads.union(rows).repartition("conv").sortWithinPartitions("conv", "is_row", "turn", "role", "text")
    return ordered.select("conv", "audit", "role", "text").mapInArrow(_repaired, f"conv {kind}, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_conv, state = None, None
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        done: list[tuple] = []
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if state is None or conv != open_conv:
                if state is not None:
                    done.append((open_conv, state.hexdigest()))
                open_conv, state = conv, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], names=["conv", "sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_conv], kind), pa.array([state.hexdigest()])], names=["conv", "sha256"])


def digests(rows: DataFrame) -> DataFrame:
    """``(conv, sha256)`` of the newline-joined ``role:text`` of rows as ``repaired`` gives them."""
    return rows.mapInArrow(_digests, f"conv {rows.schema['conv'].dataType.simpleString()}, sha256 string")


def report(originals: DataFrame, turns: DataFrame) -> DataFrame:
    """The edits of every conversation of ``originals(conv)`` after ``turns``, with the digest of its repaired rows."""
    found = edits(turns)
    hashed = digests(repaired(turns, found.select("conv", "audit"))).withColumnRenamed("conv", "h")
    every = originals.select(F.col("conv").alias("conv_id")).distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(
        hashed, F.col("conv_id").eqNullSafe(F.col("h")), "left"
    )
    number = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return joined.select(
        "conv_id",
        *(number(c) for c in ("gaps", *FAULTS, "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
