from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import conversation_repair as repair
from shelfmark.llm import queries

ROWS = "conv_id bigint, turn bigint, role string, text string"
WELL_FORMED = re.compile(r"(s?(ua)+)?")


def exhaustive(kinds):
    """Cost and least letters over all ways with up to two inserted turns in a gap, by the rule itself."""
    options = []
    for role, fault in kinds:
        ways = [("D", "", 3)]
        if fault in "ot":
            extra = fault == "t"
            ways += [("K", role, extra), ("R", "u", 2 + extra), ("R", "a", 2 + extra)]
        options.append(ways)
    best = None
    gaps = [""] + ["u", "a"] + ["ua", "au", "uu", "aa"]
    for ways in itertools.product(*options):
        for inserts in itertools.product(gaps, repeat=len(kinds) + 1):
            roles = inserts[0] + "".join(w[1] + i for w, i in zip(ways, inserts[1:], strict=True))
            if not WELL_FORMED.fullmatch(roles):
                continue
            cost = sum(w[2] for w in ways) + 2 * sum(map(len, inserts))
            letters = "I" * len(inserts[0]) + "".join(w[0] + "I" * len(i) for w, i in zip(ways, inserts[1:], strict=True))
            best = min(best or (cost, letters), (cost, letters))
    return best


def table_of_states(kinds):
    """The same by a table of all rows and states that holds whole letters."""
    states = {"": (0, "", "")}  # last role -> cost, letters, roles

    def inserted(states):
        out, work = dict(states), list(states.items())
        while work:
            last, (cost, letters, roles) = work.pop()
            role = "a" if last == "u" else "u"
            way = (cost + 2, letters + "I", roles + role)
            if role not in out or way[:2] < out[role][:2]:
                out[role] = way
                work.append((role, way))
        return out

    legal = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    for role, fault in kinds:
        nxt = {}
        for last, (cost, letters, roles) in inserted(states).items():
            ways = [("D", last, cost + 3, "")]
            if fault in "ot":
                more = cost + (fault == "t")
                if (last, role) in legal:
                    ways.append(("K", role, more, role))
                other = "a" if last == "u" else "u"
                ways.append(("R", other, more + 2, other))
            for letter, state, paid, kept in ways:
                way = (paid, letters + letter, roles + kept)
                if state not in nxt or way[:2] < nxt[state][:2]:
                    nxt[state] = way
        states = nxt
    final = inserted(states)
    return min(final[s][:2] for s in ("", "a") if s in final)


def by_hirschberg(kinds):
    letter = {kind: x for x, kind in repair.LETTERS.items()}
    row = [letter[k] for k in kinds]
    states = repair.crossings([repair.STEPS[x] for x in row], repair.NEW)
    pairs = [repair.EDITS[x][s, t] for x, s, t in zip(row, states, states[1:], strict=False)]
    return sum(c for c, _ in pairs) + repair.END_COSTS[states[-1]], "".join(w for _, w in pairs) + repair.END[states[-1]]


KINDS = [(r, f) for r in "sua?" for f in "otbd"]


def test_all_short_conversations_match_the_exhaustive_search():
    for n in range(3):
        for kinds in itertools.product([k for k in KINDS if k[1] != "d"], repeat=n):
            assert by_hirschberg(kinds) == exhaustive(kinds) == table_of_states(kinds)


@pytest.mark.parametrize("seed", range(4))
def test_random_conversations_match(seed):
    rnd = random.Random(seed)
    for _ in range(15):
        kinds = [rnd.choice(KINDS[:12]) for _ in range(3)]
        assert by_hirschberg(kinds) == exhaustive(kinds)
    for _ in range(300):
        kinds = [rnd.choice(KINDS[:12] if rnd.random() < 0.8 else KINDS) for _ in range(rnd.randrange(60))]
        assert by_hirschberg(kinds) == table_of_states(kinds)


def faults_of(turns):
    seen, out = set(), []
    for role, text in turns:
        ends = text.rstrip(repair.BLANKS)
        fault = "b" if not ends else "d" if (role, text) in seen else "o" if ends[-1] in ".!?" else "t"
        seen.add((role, text))
        out.append((role[:1] if role[:1] in ("s", "u", "a") else "?", fault))
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(rows, turns_of):
    """The contract's row of every conversation, with the edits applied one after the other."""
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(
            ((t, r, x) for c, t, r, x in turns_of if c == conv),
            key=lambda r: (r[0] is not None, r[0] or 0, r[1], signed(xxhash.xxh64_intdigest(r[2].encode(), 42)), r[2]),
        )
        kinds = faults_of([(r, x) for _, r, x in own])
        cost, audit = table_of_states(kinds)
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        heads = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False))
        lines, last, at = [], "", 0
        for letter in audit:
            role = "assistant" if last == "u" else "user"
            if letter == "I":
                lines.append(f"{role}:")
                last = role[0]
                continue
            _, name, text = own[at]
            at += 1
            if letter != "D":
                role = name if letter == "K" else role
                lines.append(f"{role}:{text}")
                last = role[0]
        assert at == len(own)
        faults = [f for _, f in kinds]
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha))
    return sorted(out, key=str)


def plain(rows):
    space = lambda x: " " if x is None else x
    return [(c, t, space(r), space(x)) for c, t, r, x in rows]


def damaged(rows):
    out = []
    for c, t, role, text in plain(rows):
        name = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(name.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(c, t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def made(seed, convs=40, most=9):
    rnd = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rnd.randrange(most + 1)):
            turn = rnd.choice([turn, turn, turn, None, 3, turn * 5])
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "U"])
            text = rnd.choice(["one.", "two!", "three", " \n", "", None, "same?", "end. ", "x. \t\n", "été"])
            rows.append((conv, turn, role, text))
    return rows


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_bits", [1, 2, 16])
def test_verdicts_match_brute_force(spark, block_bits):
    rows = made(block_bits)
    df = spark.createDataFrame(rows, ROWS)
    found = repair.verdicts(df, df, block_bits)
    assert result(found) == brute(rows, plain(rows))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_the_query_matches_brute_force(spark, tmp_path):
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [*made(7, convs=200), (dropped, 0, "user", "gone.")]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    found = result(queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)))
    assert found == brute(rows, damaged(rows))
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in found


def test_the_query_on_given_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.QUERIES["op12_conversation_repair"](spark, sf)) == brute(rows, damaged(rows))


def test_a_long_conversation_over_many_blocks(spark):
    rnd = random.Random(3)
    rows = [(5, i // 2, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b", "c!", ""]) + str(i % 97)) for i in range(900)]
    rows += [(6, 0, "user", "only.")]
    df = spark.createDataFrame(rows, ROWS)
    assert result(repair.verdicts(df, df, 4)) == brute(rows, plain(rows))


def test_equal_rows_are_dealt_out_and_all_but_one_go(spark):
    rows = [(1, 0, "user", "again.")] * 300 + [(1, 1, "assistant", "yes.")]
    df = spark.createDataFrame(rows, ROWS)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        assert repair.placed(df).select(F.shiftright("place", 33).alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset(coalesce)
    assert result(repair.verdicts(df, df, 3)) == brute(rows, rows)


def test_repaired_turns_are_well_formed(spark):
    rows = made(11)
    turns = defaultdict(list)
    for r in repair.repaired(spark.createDataFrame(rows, ROWS), 2).orderBy("position").collect():
        turns[r.conv_id].append(r)
    for own in turns.values():
        assert WELL_FORMED.fullmatch("".join(r.role[0] for r in own))
        assert all(r.text == "" and r.turn is None for r in own if r.edit == "I")


def test_empty_tables_and_extra_columns(spark):
    names = {c: F.lit("x") for c in ("conv", "place", "letter", "block", "kind", "copy", "n", "edit", "input", "fault")}
    df = spark.createDataFrame([(1, 0, "user", "hi."), (1, 1, "assistant", "yes.")], ROWS).withColumns(names)
    assert result(repair.verdicts(df, df))[0][:8] == (1, 0, 0, 0, 0, 0, 0, "KK")
    assert repair.verdicts(df.filter("false"), df.filter("false")).count() == 0
    assert result(repair.verdicts(df, df.filter("false"))) == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
