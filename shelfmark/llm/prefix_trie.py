"""Prefix trie of conversations by vertical bitmaps.

A shard is a range of conversations with a bounded number of turns. Its index maps (position, turn) to the bitset of
the shard's conversations that have this turn at this position. The trie is walked depth first: the bitset of a node
intersected with a posting of the next position is a child, its popcount the number of conversations, and the
members that have no further turn are the end list.

Nodes of all shards are then one by one the same where their chained digests are: member counts and smallest members
are added up over the shards. What a node adds to the nodes above it is counted in one shard only, the one that
holds its smallest member, where all nodes above it are found, too; sums over subtrees are taken in each shard and
added up. So a turn, prefix or conversation that any share of the conversations has is one row of each shard, there
is no step for each depth, and no text leaves the task that reads it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import WORD, joined_sha256
from shelfmark.operators.spread import positions, running_offsets
from shelfmark.session import stored

#: Turns of a shard; it has one conversation more at most.
SHARD_TURNS = 1 << 16
# Fixed values of the contract: conversations in a row with a common head, and lengths of heads.
FAMILY = 20
HEADS = 4
ROOT = b"\x00" * 32


def turns_of(conversations: DataFrame) -> DataFrame:
    """Stored ``conv_id, pos, content, words``: the turns of each conversation, numbered from 1 in order of turn,
    NULL first; ties go by role and content. ``content`` is the digest of role and text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    content = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), content.alias("content"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"), F.monotonically_increasing_id().alias("input"),
    )
    numbered = positions(rows, ["conv_id"], ["turn", "role", "content", "input"])
    return stored(numbered.select("conv_id", "pos", "content", "words"), "conversation-turns")


def rebuilt(turns: DataFrame, shard_turns: int) -> tuple[DataFrame, DataFrame]:
    """Stored members ``conv_id, shard, n_turns`` and their turns ``shard, conv_id, depth, content, words``, where
    each conversation begins with the head of the first of its family.

    A conversation's head is joined to at most the conversations of its family, so no key of that join is large; own
    turns meet one row of their conversation.
    """
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    told = lengths.select(
        "conv_id", "own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"),
        (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("head"),
    )
    firsts = lengths.select(F.col("conv_id").alias("first"), F.col("own").alias("first_own"))
    joined = told.join(firsts, "first", "left").withColumn("used", F.least("head", F.coalesce("first_own", F.lit(0))))
    counted = joined.withColumn("n_turns", F.col("used") + F.greatest(F.col("own") - F.col("head"), F.lit(0)))
    offsets = running_offsets(counted, [], ["conv_id"], F.col("n_turns") + 1)
    members = stored(offsets.withColumn("shard", F.floor(F.col("offset") / shard_turns).cast("bigint")).drop("offset"), "members")
    heads = turns.filter(F.col("pos") < HEADS).withColumnRenamed("conv_id", "first")
    head = members.join(heads, "first").filter("pos <= head").withColumn("depth", F.col("pos"))
    own = turns.join(members, "conv_id").filter("pos > head").withColumn("depth", F.col("pos") - F.col("head") + F.col("used"))
    columns = ["shard", "conv_id", "depth", "content", "words"]
    return members.select("conv_id", "shard", "n_turns"), head.select(*columns).unionByName(own.select(*columns))


def shard_trie(rows: pa.Table) -> pa.Table:
    """The nodes of one shard in depth-first order, a parent before its children; ``rows`` are turns, and for each
    conversation one row of depth 0."""
    turns: dict[int, list[tuple]] = {}
    for conv, depth, content, words in zip(*[rows.column(c).to_pylist() for c in ("conv_id", "depth", "content", "words")], strict=True):
        turns.setdefault(conv, []).append((depth, content, words))
    convs = sorted(turns)
    sequences = [sorted(turns.pop(conv), key=lambda t: t[0]) for conv in convs]
    postings: dict[tuple[int, bytes], int] = {}
    ending: dict[int, int] = {}
    for i, sequence in enumerate(sequences):
        for depth, content, _ in sequence[1:]:
            postings[depth, content] = postings.get((depth, content), 0) | 1 << i
        ending[len(sequence) - 1] = ending.get(len(sequence) - 1, 0) | 1 << i

    out: list[tuple] = []
    stack = [((1 << len(convs)) - 1, 0, None, ROOT)]
    while stack:
        members, depth, parent, key = stack.pop()
        node, low = len(out), (members & -members).bit_length() - 1
        ends = members & ending.get(depth, 0)
        listed, rest = [], ends
        while rest:
            i = (rest & -rest).bit_length() - 1
            listed.append(str(convs[i]))
            rest &= rest - 1
        out.append((node, parent, key, depth, members.bit_count(), convs[low], sequences[low][depth][2], len(listed), ",".join(listed)))
        rest = members & ~ends
        while rest:
            i = (rest & -rest).bit_length() - 1
            content = sequences[i][depth + 1][1]
            child = members & postings[depth + 1, content]
            stack.append((child, depth + 1, node, hashlib.sha256(key + content).digest()))
            rest &= ~child
    shard = rows.column("shard")[0].as_py()
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["node", "parent", "key", "depth", "members", "smallest", "words", "n_ends", "ends"]
    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
    return pa.table([pa.array([shard] * len(out), pa.int64()), *columns], names=["shard", *names])


TRIE = (
    "shard bigint, node bigint, parent bigint, key binary, depth bigint, members bigint, smallest bigint, words bigint, "
    "n_ends bigint, ends string"
)


def shard_sums(rows: pa.Table) -> pa.Table:
    """Of each node of a shard what the nodes below it that the shard counts add: children, leaves and tokens."""
    columns = ["node", "parent", "key", "depth", "smallest", "words", "conv_id", "n_convs", "all_ends"]
    nodes = sorted(zip(*[rows.column(c).to_pylist() for c in columns], strict=True))
    n = len(nodes)
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    out = []
    for node, parent, key, depth, smallest, words, conv_id, n_convs, all_ends in reversed(nodes):
        counted = smallest == conv_id
        if counted:
            leaves[node] += n_convs == all_ends
            saved[node] += (n_convs - 1) * words
        if parent is not None:
            children[parent] += counted
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
        if counted or children[node] or leaves[node] or saved[node]:
            above = None if parent is None else nodes[parent][6]
            out.append((key, depth, conv_id, above, n_convs, children[node], leaves[node], saved[node]))
    names = ["key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    # A shard of copies alone counts nothing.
    values = list(zip(*out, strict=True)) or [()] * len(names)
    return pa.table([pa.array(v, t) for v, t in zip(values, [pa.binary(), *[pa.int64()] * 7], strict=True)], names=names)


SUMS = (
    "key binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint"
)


def shard_tries(conversations: DataFrame, shard_turns: int) -> DataFrame:
    """Stored nodes of the trie of each shard."""
    members, turns = rebuilt(turns_of(conversations), shard_turns)
    tops = members.select(
        "shard", "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("content"), F.lit(0).cast("bigint").alias("words")
    )
    return stored(turns.unionByName(tops).groupBy("shard").applyInArrow(shard_trie, TRIE), "shard-tries")


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node.

    A node is a different sequence of first turns (role and text) of the rebuilt conversations, the root is the
    empty one; ``conv_id`` is the smallest member. Turns are ordered by ``turn``, NULL first, ties by role and
    digest of the content; repeated rows are turns of their own. A NULL role or text is empty, texts of any length
    count whole. Rows with a NULL ``conv_id`` belong to no conversation, as they have no number to be rebuilt by.
    An empty table has no nodes; other columns are not read.
    """
    tries = shard_tries(conversations, shard_turns)
    nodes = stored(
        tries.groupBy("key").agg(
            F.sum("members").alias("n_convs"), F.min("smallest").alias("conv_id"), F.sum("n_ends").alias("all_ends")
        ),
        "trie-nodes",
    )
    told = tries.select("shard", "node", "parent", "key", "depth", "smallest", "words").join(nodes, "key")
    sums = told.groupBy("shard").applyInArrow(shard_sums, SUMS)
    same = [F.max(c).alias(c) for c in ("depth", "conv_id", "parent_conv_id", "n_convs")]
    added = [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    # Shards are ranges of conversations, so their end lists one after the other ascend.
    ends = joined_sha256(tries.filter("n_ends > 0"), "key", ["shard"], F.col("ends"), ",", "ends_sha256")
    return sums.groupBy("key").agg(*same, *added).join(ends, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
