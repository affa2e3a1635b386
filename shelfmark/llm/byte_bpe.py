"""Byte-level BPE encoding and decoding with public vocabularies.

A pre-token that is in the vocabulary is resolved in one step by a minimal perfect hash: n tokens, n slots,
no gaps, one comparison. Any other pre-token is merged from its bytes, kept as a linked list, with a heap of
the possible merges. The codec is built on the driver from a vocabulary file of fixed size and broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import small_batches, text_of

#: Pre-tokens whose merged ids a task remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
#: Characters of text that are split at a time, whole documents; bounds the memory of a task.
CHUNK_CHARS = 2_000_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ids from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in lines if line.strip()))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in ranked]


def key_halves(tokens: list) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit halves of a 64-bit hash of each token, as 64-bit numbers."""
    boxed = np.empty(len(tokens), dtype=object)
    boxed[:] = tokens
    codes = pd.util.hash_array(boxed, categorize=False)
    return codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)


def spread(high, shift):
    """A 64-bit mix of a token's half and a displacement, for Python numbers and unsigned arrays alike."""
    numbers = isinstance(high, int)
    wrap = (lambda x: x & 0xFFFFFFFFFFFFFFFF) if numbers else (lambda x: x)
    of = int if numbers else np.uint64
    x = wrap((high + wrap(shift * of(0x9E3779B97F4A7C15))) * of(0x2545F4914F6CDD1D))
    return wrap((x ^ (x >> of(29))) * of(0xBF58476D1CE4E5B9)) >> of(16)


class PerfectHash:
    """Minimal perfect hash by displacement: tokens fall into buckets, and each bucket, large ones first,
    gets the first displacement that puts its tokens on free slots; single tokens take what is left."""

    def __init__(self, tokens: list[str]):
        n = self.n = len(tokens)
        self.buckets = max(1, n // 3)
        low, high = key_halves(tokens)
        members: dict[int, list[int]] = {}
        for i, b in enumerate((low % np.uint64(self.buckets)).tolist()):
            members.setdefault(b, []).append(i)
        high = high.tolist()
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        slot_of, free = [-1] * n, [True] * n
        for b, group in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(group) == 1:
                break
            if len({high[i] for i in group}) < len(group):
                raise ValueError("tokens with equal hash")
            shift = 0
            while True:
                slots = [spread(high[i], shift) % n for i in group]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                shift += 1
            self.shift[b] = shift
            for i, s in zip(group, slots, strict=True):
                slot_of[i], free[s] = s, False
        rest = iter([s for s in range(n) if free[s]])
        for b, group in members.items():
            if len(group) == 1:
                slot_of[group[0]] = next(rest)
                self.shift[b] = -1 - slot_of[group[0]]
        self.at = np.empty(n, dtype=np.int64)
        self.at[slot_of] = np.arange(n)

    def candidates(self, tokens: list) -> np.ndarray:
        """The only index each token can have; the caller compares."""
        low, high = key_halves(tokens)
        shift = self.shift[(low % np.uint64(self.buckets)).astype(np.int64)]
        moved = spread(high, np.maximum(shift, 0).astype(np.uint64)) % np.uint64(self.n)
        return self.at[np.where(shift < 0, -1 - shift, moved.astype(np.int64))]


class Codec:
    """Encoder and decoder of one vocabulary; small and immutable, made once and broadcast."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.rank = {token: i for i, token in enumerate(tokens)}
        # Tokens that are whole texts, as only these can be pre-tokens.
        self.whole_ids = [i for i, t in enumerate(tokens) if t.decode("utf-8", "ignore").encode() == t and t]
        self.whole = np.empty(len(self.whole_ids), dtype=object)
        self.whole[:] = [tokens[i].decode() for i in self.whole_ids]
        self.ids = np.array(self.whole_ids, dtype=np.uint32)
        self.index = PerfectHash(list(self.whole)) if len(self.whole) else None
        self.split = None
        self.remembered: dict[str, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"split": None, "remembered": {}}

    def merged(self, token: bytes) -> list[int]:
        """Ids of a token by repeated merges of the pair with the lowest rank, the leftmost of equals."""
        rank, n = self.rank, len(token)
        if n == 1:
            return [rank[token]]
        end = list(range(1, n + 1))  # end of the piece that starts here, 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(token[i:i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two pieces has changed since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                r = rank.get(token[i:end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i:
                left = before[i]
                r = rank.get(token[left:stop])
                if r is not None:
                    heapq.heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(rank[token[i:end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit numbers, without special tokens."""
        ids, borders = self.encode_all(texts)
        return [ids[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text begins and the last one ends."""
        if self.split is None:
            self.split = regex.compile(self.pattern)
        pieces = [self.split.findall(t) for t in texts]
        counts = np.array([len(p) for p in pieces], dtype=np.int64)
        flat = np.empty(int(counts.sum()), dtype=object)
        flat[:] = [x for p in pieces for x in p]
        codes, words = pd.factorize(flat)
        lengths = np.ones(len(words), dtype=np.int64)
        first = np.zeros(len(words), dtype=np.uint32)
        if len(words) and self.index is not None:
            at = self.index.candidates(words)
            known = self.whole[at] == words
            first[known] = self.ids[at[known]]
        else:
            known = np.zeros(len(words), dtype=bool)
        if len(self.remembered) > REMEMBERED:
            self.remembered = {}
        merged = []
        for word in words[~known]:
            ids = self.remembered.get(word)
            if ids is None:
                ids = self.remembered[word] = np.array(self.merged(word.encode()), dtype=np.uint32).tobytes()
            merged.append(ids)
        lengths[~known] = [len(ids) // 4 for ids in merged]
        # All words' ids in one array, then gathered in the order of the texts.
        starts = np.concatenate([[0], np.cumsum(lengths)])
        pool = np.zeros(int(starts[-1]), dtype=np.uint32)
        pool[starts[:-1][known]] = first[known]
        pool[np.repeat(~known, lengths)] = np.frombuffer(b"".join(merged), dtype=np.uint32)
        sizes = lengths[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.repeat(starts[codes] - (ends - sizes), sizes) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()])


def load_codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def slices(texts: pa.Array, most_chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of whole documents of about ``most_chars`` bytes with their texts; a longer text is a range of
    its own. Only one range at a time becomes Python strings."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).tolist()
    start = size = 0
    for i, own in enumerate([*sizes, most_chars + 1]):
        if i == len(sizes) or size and size + own > most_chars:
            if i > start:
                yield start, i, texts.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += own


def encoded(
    docs: DataFrame, codec: Codec, column: str = "text", out: str = "ids", proof: str | None = None
) -> DataFrame:
    """``docs`` with the ids of the whole text as ``out`` (array of int) instead of the text column.

    A NULL text has no ids. Rows keep their other columns, whatever their names, except that a column named
    ``out`` is replaced; repeated rows are encoded each; an empty table gives no rows. With ``proof`` the ids are
    decoded, and a column of this name, replaced too, tells whether that gives the bytes of the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name.lower() not in (column.lower(), out.lower(), (proof or out).lower())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in slices(batch.column(batch.num_columns - 1)):
                ids, borders = shared.value.encode_all(texts)
                lists = pa.ListArray.from_arrays(borders.astype(np.int32), ids.view(np.int32))
                others = [c.slice(start, stop - start) for c in batch.columns[:-1]]
                columns, names = [*others, lists], [*batch.schema.names[:-1], out]
                if proof:
                    same = [
                        shared.value.decode(ids[a:b]) == text.encode()
                        for text, a, b in zip(texts, borders[:-1], borders[1:], strict=True)
                    ]
                    columns, names = [*columns, pa.array(same, pa.bool_())], [*names, proof]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], text_of(column).alias(column))
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType()))])
    if proof:
        schema = schema.add(proof, T.BooleanType())
    return rows.mapInArrow(run, schema)


def decoded(tokens: DataFrame, codec: Codec, column: str = "ids", out: str = "bytes") -> DataFrame:
    """``tokens`` with the bytes of the ids as ``out`` instead of the ids; NULL ids give no bytes."""
    shared = tokens.sparkSession.sparkContext.broadcast(codec)
    kept = [c for c in tokens.columns if c.lower() not in (column.lower(), out.lower())]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.decode(ids) for ids in batch], dtype=object)

    to_bytes = F.pandas_udf(run, "binary")
    ids = F.coalesce(F.col(column), F.array().cast("array<int>"))
    return tokens.select(*[F.col(f"`{c}`") for c in kept], to_bytes(ids).alias(out))


def round_trip(docs: DataFrame, codec: Codec) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row: the ids as little-endian unsigned
    32-bit numbers and the bytes that decoding them gives, as digests. NULL texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, names = shared.value, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        for batch in batches:
            for start, stop, texts in slices(batch.column(1)):
                own = codec.encode(texts)
                columns = [
                    batch.column(0).slice(start, stop - start),
                    pa.array([len(ids) for ids in own], pa.int64()),
                    pa.array([hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in own], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(ids)).hexdigest() for ids in own], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    digests = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([docs.schema["doc_id"], *digests])
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def token_rows(docs: DataFrame, codec: Codec) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` and ``intact`` in place of the text: the rows a trainer reads, and
    whether decoding the ids gives the bytes of the text."""
    ids, size, proof = "ids", "n_tokens", "intact"
    rows = encoded(docs, codec, proof=proof)
    kept = [c for c in rows.columns if c.lower() not in (ids, size, proof)]
    return rows.select(*[F.col(f"`{c}`") for c in kept], ids, F.size(ids).cast("bigint").alias(size), proof)
