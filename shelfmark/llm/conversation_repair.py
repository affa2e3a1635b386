"""Repair of the structure of conversations by Hirschberg's divide and conquer.

The roles of a repaired conversation read ``(s?(ua)+)?``, which an automaton of four states accepts: nothing yet,
after a system turn, after a user turn, after an assistant turn. A row is kept, gets another role or is deleted, and
empty turns are inserted before it, so a row is a step from state to state with a cost and edit letters. A forward
vector of four costs runs from the start to the middle row and a backward vector from the end; the states where
their sum is least are the optimal crossings, and the halves on both sides are solved in the same way. Only vectors
are held, not the table of all rows and states.

Several crossings may be optimal. The forward vector carries, next to the costs, the order of the four states by
their least edit letters. The letters up to a state end with the letter of the last row, so none is the beginning of
another, and the order after a row follows from the order before it. The least of the optimal crossings therefore
lies on the path with the least letters of all.

Conversations are cut into blocks of rows by their place in the sorted input. A block is a step with costs and an
order, too, so a conversation of many blocks is first solved over its blocks, and then each block between the states
where the path enters and leaves it. No task holds more than the letters of a block, and four by four numbers for
each block of a conversation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import joined_sha256, small_batches
from shelfmark.session import stored

#: Rows of a block are those with equal place above so many bits.
BLOCK_BITS = 16
# White space of the contract, ends of a sentence, costs of the edits.
BLANKS = " \t\n\x0b\x0c\r"
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_COST = 1

NEW, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state after an empty turn is inserted, or a row gets the only role that may follow.
FOLLOWING = {NEW: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {("s", NEW): SYSTEM, ("u", NEW): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: What is inserted at the end to get from a state to an accepted one.
END = {NEW: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60

#: A row's letter: its role (s, u, a, other) and its first fault (none, truncated, blank, duplicate).
ROLES, FAULTS = "sua?", "otbd"
LETTERS = {chr(ord("A") + 4 * i + k): (r, f) for i, r in enumerate(ROLES) for k, f in enumerate(FAULTS)}


class Step:
    """Costs from state to state, and of each first state the order of the states it leads to by their letters."""

    def __init__(self, costs: Sequence[Sequence[int]], order: Sequence[Sequence[int]]):
        self.costs, self.order = costs, order
        self.into = [[(s, costs[s][t]) for s in range(4) if costs[s][t] < NEVER] for t in range(4)]
        self.out = [[(t, costs[s][t]) for t in range(4) if costs[s][t] < NEVER] for s in range(4)]


def edits_of(role: str, fault: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Least cost and letters from state to state over one row."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for first in range(4):
        state = first
        for inserts in range(3):
            ways = [("D", state)]
            if fault in "ot":
                ways.append(("R", FOLLOWING[state]))
                if (role, state) in KEPT:
                    ways.append(("K", KEPT[role, state]))
            for edit, last in ways:
                cost = COST["I"] * inserts + COST[edit] + TRUNCATED_COST * (fault == "t" and edit != "D")
                way = cost, "I" * inserts + edit
                found[first, last] = min(found.get((first, last), way), way)
            state = FOLLOWING[state]
    return found


def ranked(texts: list[str | None]) -> list[int]:
    known = sorted(t for t in texts if t is not None)
    return [known.index(t) if t is not None else 4 for t in texts]


EDITS = {letter: edits_of(*kind) for letter, kind in LETTERS.items()}
STEPS = {
    letter: Step(
        [[edits.get((s, t), (NEVER, ""))[0] for t in range(4)] for s in range(4)],
        [ranked([edits.get((s, t), (0, None))[1] for t in range(4)]) for s in range(4)],
    )
    for letter, edits in EDITS.items()
}
END_COSTS = [COST["I"] * len(END[s]) for s in range(4)]


def forward(steps: Sequence[Step], lo: int, hi: int, state: int) -> tuple[list[int], list[int]]:
    """Costs from ``state`` before step ``lo`` to each state after step ``hi - 1``, and the order of these states
    by the least letters that reach them at that cost."""
    costs, order = [NEVER] * 4, [0] * 4
    costs[state] = 0
    for i in range(lo, hi):
        step = steps[i]
        now, keys = [NEVER] * 4, [(9, 9)] * 4
        for t in range(4):
            best, place = NEVER, 9
            for s, c in step.into[t]:
                c += costs[s]
                if c < best or c == best < NEVER and order[s] < place:
                    best, place, now[t], keys[t] = c, order[s], c, (order[s], step.order[s][t])
        costs = now
        line = sorted(keys)
        order = [line.index(k) for k in keys]
    return costs, order


def backward(steps: Sequence[Step], lo: int, hi: int, ends: list[int]) -> list[int]:
    """Costs from each state before step ``lo`` to the end, where each state costs what ``ends`` says."""
    costs = ends
    for i in range(hi - 1, lo - 1, -1):
        costs = [min([c + costs[t] for t, c in steps[i].out[s]], default=NEVER) for s in range(4)]
    return costs


def least(costs: list[int], rest: list[int], order: list[int]) -> int:
    """The optimal crossing with the least letters before it."""
    return min(range(4), key=lambda s: (costs[s] + rest[s], order[s]))


def crossings(steps: Sequence[Step], first: int, last: int | None = None) -> list[int]:
    """The states before, between and after all steps on the cheapest way with the least letters."""
    n = len(steps)
    states = [first] * (n + 1)
    if last is None and n:
        costs, order = forward(steps, 0, n, first)
        last = least(costs, END_COSTS, order)
    if last is not None:
        states[n] = last
    halves = [(0, n)]
    while halves:
        lo, hi = halves.pop()
        if hi - lo < 2:
            continue
        middle = (lo + hi) // 2
        costs, order = forward(steps, lo, middle, states[lo])
        rest = backward(steps, middle, hi, [0 if s == states[hi] else NEVER for s in range(4)])
        states[middle] = least(costs, rest, order)
        halves += [(lo, middle), (middle, hi)]
    return states


def roles_of(role: str, state: int, letters: str) -> list[str | None]:
    """The role that each edit of a row gives: of inserted turns and of a row with a new role."""
    out: list[str | None] = []
    for letter in letters:
        if letter in "IR":
            state = FOLLOWING[state]
        elif letter == "K":
            state = KEPT[role, state]
        out.append(ROLE[state] if letter in "IR" else None)
    return out


def plain_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text``, a NULL role or text as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", text("role"), text("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by checksum of conversation and turn: of twenty, 0 drops the row, 1 empties its text,
    2 takes the ends of sentences out, 3 repeats it, 4 makes it the user's. NULL counts as one space."""
    rows = plain_rows(conversations)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    return (
        rows.withColumn("kind", kind).filter("kind <> 0")
        .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")).alias("text"),
        )
    )


def placed(rows: DataFrame) -> DataFrame:
    """Stored ``conv, turn, role, text, place, initial, fault, content``: rows in order of conversation, turn, role
    and hash of the text, with one number that ascends in this order and is gapless for the rows of a conversation in a
    partition. Equal rows are told apart by their place in the input, so that any number of them is dealt out."""
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role"]
    ends = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(ends == "", "b").when(F.substring(ends, -1, 1).isin(".", "!", "?"), "o").otherwise("t")
    ranged = (
        plain_rows(rows).withColumn("input", F.monotonically_increasing_id())
        .repartitionByRange(*keys, F.xxhash64("text"), "input")
        .sortWithinPartitions(*keys, F.xxhash64("text"), "text", "input")
    )
    return stored(
        ranged.select(
            F.struct("conv_id").alias("conv"), "turn", "role", "text", F.monotonically_increasing_id().alias("place"),
            F.substring("role", 1, 1).alias("initial"), fault.alias("fault"),
            F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256).alias("content"),
        ),
        "conversation-rows",
    )


def letter(initial: Column, fault: Column) -> Column:
    """The letter of a row."""
    role = F.coalesce(F.nullif(F.instr(F.lit(ROLES[:3]), initial), F.lit(0)), F.lit(4))
    role = F.when(initial == "", 4).otherwise(role)
    return F.char(F.lit(ord("A") - 5) + 4 * role + F.instr(F.lit(FAULTS), fault))


def blocks(rows: DataFrame, block_bits: int) -> DataFrame:
    """Stored ``conv, block, first_place, letters``: of each conversation the letters of the rows of a block."""
    first = rows.groupBy("conv", "content").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    told = rows.select("conv", "place", "initial", "fault").join(first, "place", "left")
    fault = F.when((F.col("fault") != "b") & F.col("first").isNull(), "d").otherwise(F.col("fault"))
    lettered = told.select("conv", "place", letter(F.col("initial"), fault).alias("letter"))
    in_order = F.array_sort(F.collect_list(F.struct("place", "letter")))
    return stored(
        lettered.groupBy("conv", F.shiftright("place", block_bits).alias("block")).agg(
            F.min("place").alias("first_place"), F.array_join(F.transform(in_order, lambda x: x["letter"]), "").alias("letters")
        ),
        "conversation-blocks",
    )


def between(pieces: DataFrame) -> DataFrame:
    """``conv, block, enters, leaves, ends, before``: where the best way of a conversation of several blocks enters
    and leaves each, whether it ends there, and the role before it."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, order, last = [], [], []
            for letters in batch.column(2).to_pylist():
                steps = [STEPS[x] for x in letters]
                found = [forward(steps, 0, len(steps), s) for s in range(4)]
                costs.append([c for row, _ in found for c in row])
                order.append([o for _, row in found for o in row])
                last.append(LETTERS[letters[-1]][0])
            columns = [batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64())), pa.array(order, pa.list_(pa.int32())), pa.array(last)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv", "block", "costs", "order", "last"])

    def chain(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        square = lambda x: [list(x[4 * s:4 * s + 4]) for s in range(4)]
        states = crossings([Step(square(c), square(o)) for c, o in zip(blocks["costs"], blocks["order"], strict=True)], NEW)
        blocks["enters"], blocks["leaves"] = states[:-1], states[1:]
        blocks["ends"] = [False] * (len(blocks) - 1) + [True]
        blocks["before"] = ["", *blocks["last"][:-1]]
        return blocks[["conv", "block", "enters", "leaves", "ends", "before"]]

    conv = pieces.schema["conv"].dataType.simpleString()
    narrow = pieces.select("conv", "block", "letters").mapInArrow(
        matrices, f"conv {conv}, block bigint, costs array<bigint>, `order` array<int>, last string"
    )
    # The struct of a key may hold NULL, which a group of pandas rows would lose; its text is told apart.
    name = F.coalesce(F.col("conv.conv_id").cast("string"), F.lit("NULL"))
    out = narrow.withColumn("conv", name).groupBy("conv").applyInPandas(
        chain, "conv string, block bigint, enters int, leaves int, ends boolean, before string"
    )
    return out.withColumnRenamed("conv", "conv_name")


def solved(pieces: DataFrame) -> DataFrame:
    """``conv, block, audit, cost, blank, duplicate, truncated, illegal, edits`` of ``conv, block, first_place,
    letters, enters, leaves, ends, before``; ``edits`` has the place, number, letter and new role of each edit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, block, place, letters, enters, leaves, ends, before in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                steps = [STEPS[x] for x in letters]
                states = crossings(steps, enters, leaves)
                audit, edits, cost = [], [], 0
                for i, (x, s, t) in enumerate(zip(letters, states[:-1], states[1:], strict=True)):
                    paid, way = EDITS[x][s, t]
                    if ends and i == len(letters) - 1:
                        paid, way = paid + END_COSTS[t], way + END[t]
                    cost += paid
                    audit.append(way)
                    for n, (edit, role) in enumerate(zip(way, roles_of(LETTERS[x][0], s, way), strict=True)):
                        edits.append({"place": place + i, "n": n, "edit": edit, "new_role": role})
                kinds = [LETTERS[x] for x in letters]
                faults = [sum(f == x for _, f in kinds) for x in "bdt"]
                roles = [*([before] if before else []), *[r for r, _ in kinds]]
                illegal = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
                rows.append((block, "".join(audit), cost, *faults, illegal, edits))
            kept = pa.schema([(f.name, f.type) for f in batch.schema][:1])
            edit = pa.struct([("place", pa.int64()), ("n", pa.int32()), ("edit", pa.string()), ("new_role", pa.string())])
            types = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.list_(edit)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            names = ["block", "audit", "cost", "blank", "duplicate", "truncated", "illegal", "edits"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[*kept.names, *names])

    conv = pieces.schema["conv"].dataType.simpleString()
    return pieces.select("conv", "block", "first_place", "letters", "enters", "leaves", "ends", "before").mapInArrow(
        run,
        f"conv {conv}, block bigint, audit string, cost bigint, blank bigint, duplicate bigint, truncated bigint, "
        "illegal bigint, edits array<struct<place: bigint, n: int, edit: string, new_role: string>>",
    )


def plans(rows: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Stored result of ``solved`` for all blocks of ``placed`` rows."""
    small_batches(rows.sparkSession)
    pieces = blocks(rows, block_bits)
    # A conversation goes on in a block only from the block's first place; a block has one such conversation.
    going_on = pieces.filter(F.col("first_place") % (1 << block_bits) == 0).select("conv").distinct()
    alone = pieces.join(going_on, "conv", "left_anti").select(
        "*", F.lit(NEW).alias("enters"), F.lit(None).cast("int").alias("leaves"), F.lit(True).alias("ends"), F.lit("").alias("before")
    )
    many = stored(pieces.join(going_on, "conv", "left_semi"), "conversation-blocks")
    ways = stored(between(many), "block-ways")
    name = F.coalesce(F.col("conv.conv_id").cast("string"), F.lit("NULL"))
    joined = many.withColumn("conv_name", name).join(ways, ["conv_name", "block"]).drop("conv_name")
    return stored(solved(alone.unionByName(joined)), "conversation-plans")


def repaired_rows(rows: DataFrame, solution: DataFrame) -> DataFrame:
    """``conv, place, n, edit, turn, role, text`` of all turns that stand after the repair."""
    edits = solution.select(F.explode("edits").alias("e")).select("e.*").filter("edit <> 'D'")
    inserted = F.col("edit") == "I"
    return edits.join(rows.select("conv", "turn", "role", "text", "place"), "place").select(
        "conv", "place", "n", "edit", F.when(~inserted, F.col("turn")).alias("turn"),
        F.coalesce("new_role", "role").alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"),
    )


def repaired(conversations: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``conv_id, position, edit, turn, role, text``: every conversation with the cheapest repair, rows in order.

    ``position`` ascends within a conversation. Rows are ordered by turn, NULL first; ties go by
    role and the 64-bit hash of the text, so equal rows stand together. A NULL role or text is one space. Blank rows and rows that repeat role and text of an earlier one go, other rows stay,
    stay under another role, or go; empty turns are put in where that is cheaper. A role is judged by its first
    character, an empty one has none and cannot stay. Rows with a NULL ``conv_id`` are one conversation. Texts of
    any length pass; an empty table gives no rows; other columns are not read.
    """
    rows = placed(conversations)
    found = repaired_rows(rows, plans(rows, block_bits))
    # At most two turns are inserted before a row and two at the end, so eight numbers for a place suffice.
    return found.select(
        "conv.conv_id", (F.col("place") * 8 + F.col("n")).alias("position"), "edit", "turn", "role", "text"
    )


def digests(turns: DataFrame) -> DataFrame:
    """``conv, repaired_sha256`` over the lines ``role:text``."""
    return joined_sha256(turns, "conv", ["place", "n"], F.concat("role", F.lit(":"), "text"), "\n", "repaired_sha256")


def verdicts(original: DataFrame, rows: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for every ``conv_id``
    of ``original``, of which ``rows`` are the turns. A conversation without rows has zeros and empty texts."""
    small_batches(original.sparkSession)
    rows = placed(rows)
    solution = plans(rows, block_bits)
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    audits = F.array_sort(F.collect_list(F.struct("block", "audit")))
    sums = solution.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in counts], F.array_join(F.transform(audits, lambda x: x["audit"]), "").alias("audit")
    )
    gaps = rows.select("conv", "turn").distinct().groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")
    )
    hashes = digests(repaired_rows(rows, solution))
    ids = original.select(F.struct("conv_id").alias("conv")).distinct()
    return (
        ids.join(gaps, "conv", "left").join(sums, "conv", "left").join(hashes, "conv", "left")
        .select(
            "conv.conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ["gaps", *counts]],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
        )
    )
