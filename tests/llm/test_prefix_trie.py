from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import prefix_trie as trie
from shelfmark.llm import queries
from tests.compare import connect, differences

ROWS = "conv_id bigint, turn bigint, role string, text string"


def content(turn):
    return hashlib.sha256(f"{len(turn[0])}:{turn[0]}:{turn[1]}".encode()).digest()


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], content(t[1:])))
    out = {}
    for conv, turns in own.items():
        head = zlib.crc32(str(conv).encode()) % 4
        out[conv] = tuple(t[1:] for t in own.get(conv - conv % 20, [])[:head] + turns[head:])
    return out


def brute(rows):
    """Every prefix of every rebuilt conversation, with its members, children and subtree written out."""
    convs = rebuilt(rows)
    members = defaultdict(set)
    for conv, turns in convs.items():
        for depth in range(len(turns) + 1):
            members[turns[:depth]].add(conv)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = []
    for node, convs_of in members.items():
        below = [other for other in members if other[:len(node)] == node]
        saved = sum((len(members[v]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", v[-1][1])) for v in below if v)
        ends = ",".join(str(c) for c in sorted(c for c in convs_of if convs[c] == node))
        out.append((
            min(convs_of), len(node), min(members[node[:-1]]) if node else None, len(convs_of), len(children[node]),
            sum(not children[v] for v in below), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def made(seed, convs=60):
    rnd = random.Random(seed)
    rows = []
    for conv in rnd.sample(range(4 * convs), convs):
        for turn in range(rnd.choice([0, 1, 2, 3, 5, 7])):
            turn = rnd.choice([turn, turn, turn, None, 2])
            rows.append((conv, turn, rnd.choice(["user", "assistant", "", None]), rnd.choice(["a b", "a  b", "c", "", None, "é\tü x"])))
    rows += [(None, 0, "user", "no number")] * 2
    rnd.shuffle(rows)
    return rows


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard_turns", [1, 7, trie.SHARD_TURNS])
def test_nodes_match_brute_force(spark, shard_turns):
    rows = made(shard_turns % 100)
    assert result(trie.prefix_trie(spark.createDataFrame(rows, ROWS), shard_turns)) == brute(rows)


def test_large_groups_of_copies_over_many_shards(spark):
    rows = [(conv, turn, "user", f"same {turn}") for conv in range(200) for turn in range(4)]
    rows += [(300 + i, 0, "user", "first") for i in range(60)] + [(300 + i, 1, "assistant", f"own {i % 7}") for i in range(60)]
    assert result(trie.prefix_trie(spark.createDataFrame(rows, ROWS), 40)) == brute(rows)


def test_a_long_conversation_and_its_copy(spark):
    rows = [(conv, turn, "user", f"t{turn % 5}") for conv in (0, 2000, 1) for turn in range(1500)]
    found = result(trie.prefix_trie(spark.createDataFrame(rows, ROWS), 100))
    convs = rebuilt(rows)
    assert len(found) == len({turns[:d] for turns in convs.values() for d in range(len(turns) + 1)})
    assert {r[3] for r in found if r[1] == 0} == {3}


def test_heads_without_their_first_conversation_and_without_own_turns(spark):
    long_head = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(long_head, 0, "user", "a"), (long_head, 1, "user", "b"), (41, 0, "user", "x"), (40, 0, "user", "y")]
    assert result(trie.prefix_trie(spark.createDataFrame(rows, ROWS))) == brute(rows)
    assert (long_head, 0) == brute([(long_head, 0, "user", "a")])[0][:2]


def test_bitsets_of_a_shard():
    import pyarrow as pa

    turns = [(3, 1, b"a", 1), (3, 2, b"b", 2), (5, 1, b"a", 1), (7, 1, b"c", 4), *[(c, 0, None, 0) for c in (3, 5, 7, 9)]]
    columns = [pa.array(c) for c in zip(*[(0, *t) for t in turns], strict=True)]
    nodes = trie.shard_trie(pa.table(columns, names=["shard", "conv_id", "depth", "content", "words"])).to_pylist()
    assert [(n["depth"], n["members"], n["smallest"], n["ends"]) for n in sorted(nodes, key=lambda n: (n["depth"], n["smallest"]))] == [
        (0, 4, 3, "9"), (1, 2, 3, "5"), (1, 1, 7, "7"), (2, 1, 3, "3"),
    ]
    assert all(n["parent"] is None or n["parent"] < n["node"] for n in nodes)


def test_empty_table_and_clashing_names(spark):
    names = {c: F.lit("x") for c in ("shard", "node", "key", "depth", "pos", "input", "words", "content", "head", "first", "own", "used")}
    rows = made(5)
    df = spark.createDataFrame(rows, ROWS).withColumns(names)
    assert result(trie.prefix_trie(df)) == brute(rows)
    assert trie.prefix_trie(df.filter("false")).count() == 0


def test_the_query_matches_sql_and_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    found = queries.QUERIES["op13_prefix_trie"](spark, sf)
    assert differences(found, connect(sf), queries.ORACLES["op13_prefix_trie"]) == []
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(found) == brute(rows)
