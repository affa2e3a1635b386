"""Hierarchical packing of documents into training sequences of several lengths.

Documents become token ids and a closing id. Whole windows of the longest context are cut off, what is left is
routed to the tier with the shortest window that holds it. Tiers are packed from the longest to the shortest: a
piece opens a window, and the gap is filled with the longest pieces of shorter tiers that fit. A gap that no piece
fits takes the head of the shortest longer piece, whose rest is routed again, so every window is full. Windows of
a tier are dealt out to step groups of equal token numbers, the costly ones first, each to the cheapest group.

Every task packs the documents of its own split in pools of bounded size, so no text and no id is shuffled and a
source or group of any share of the rows is packed where it lies. What is left at the end of a task is cut into
windows whose lengths are powers of two. Padding is therefore none; a task has at most ten such short windows.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.byte_bpe import slices
from shelfmark.llm.common import small_batches, text_of

#: Window lengths, powers of two, from the longest to the shortest.
TIERS = (1024, 512, 256, 128, 64)
#: Tokens of a step group.
STEP_TOKENS = 16_384
#: Tokens that a task holds before it packs them.
POOL_TOKENS = 1 << 20
#: Characters that are encoded at a time.
SLICE_CHARS = 1 << 20
#: Pieces that leave the Python worker at a time.
BATCH_PIECES = 4096
#: The id that closes every document.
CLOSING_ID = 0

# A blank between two characters that are not white space: no pre-token reaches over its left side.
CUT = regex.compile(r"(?<=\S) (?=\S)")


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 signs stand for
    themselves, the other bytes for the signs from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of a byte-level BPE vocabulary in its JSON form, made once from its text and broadcast.

    Ids are those of the tokenizer library that wrote the file, special tokens in a text included; the merges run
    in the library for rank files, which takes a seventh of the time.
    """

    def __init__(self, text: str, pattern: str):
        self.text, self.pattern, self.made = text, pattern, None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def library(self):
        if self.made is None:
            import tiktoken

            model, signs = json.loads(self.text), byte_of_sign()
            special = {t["content"]: t["id"] for t in model["added_tokens"]}
            ranks = {bytes(signs[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
            self.made = tiktoken.Encoding("vocabulary", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=special)
        return self.made

    def ids(self, text: str) -> np.ndarray:
        """Ids of the whole text and the closing id; long texts are encoded in slices that end where no
        pre-token does."""
        start, parts = 0, []
        while len(text) - start > SLICE_CHARS and (cut := CUT.search(text, start + SLICE_CHARS)):
            parts.append(text[start:cut.start()])
            start = cut.start()
        encode = self.library().encode_to_numpy
        found = [encode(p, allowed_special="all", disallowed_special=()) for p in [*parts, text[start:]]]
        return np.concatenate([*found, np.array([CLOSING_ID], dtype=np.uint32)])


def load_encoder(path: str, pattern: str) -> Encoder:
    with open(path, encoding="utf-8") as file:
        return Encoder(file.read(), pattern)


@dataclass
class Window:
    """A sequence in the making: pieces ``(document, start, length)`` and its length."""

    size: int
    pieces: list[tuple[int, int, int]] = field(default_factory=list)

    def cost(self) -> int:
        """Pairs of tokens that attend to each other."""
        return sum(n * n for _, _, n in self.pieces)


class Pool:
    """Pieces by length, with a bit for each length that has some."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers, self.lengths = tiers, 0
        self.pieces: dict[int, list[tuple[int, int, int]]] = defaultdict(list)

    def put(self, document: int, start: int, length: int) -> None:
        self.pieces[length].append((document, start, length))
        self.lengths |= 1 << length

    def take(self, length: int) -> tuple[int, int, int]:
        found = self.pieces[length].pop()
        if not self.pieces[length]:
            self.lengths &= ~(1 << length)
        return found

    def longest(self, most: int) -> int:
        """The longest length up to ``most`` that a piece has; 0 if there is none."""
        return max((self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1, 0)

    def shortest_over(self, length: int) -> int:
        above = self.lengths >> (length + 1)
        return length + (above & -above).bit_length() if above else 0

    def windows(self) -> Iterator[Window]:
        """Full windows, tier by tier; the pieces of a last window that cannot be filled stay in the pool."""
        for size, shorter in zip(self.tiers, [*self.tiers[1:], 0], strict=True):
            while (length := self.longest(size)) > shorter:
                window, gap = Window(size, [self.take(length)]), size - length
                while gap:
                    if fits := self.longest(gap):
                        window.pieces.append(self.take(fits))
                        gap -= fits
                    elif over := self.shortest_over(gap):
                        document, start, length = self.take(over)
                        window.pieces.append((document, start, gap))
                        self.put(document, start + gap, length - gap)
                        gap = 0
                    else:
                        for piece in window.pieces:
                            self.put(*piece)
                        return
                yield window

    def rest(self) -> Iterator[Window]:
        """All that is left, in windows of falling powers of two."""
        left = sum(n * len(p) for n, p in self.pieces.items())
        while left:
            size = gap = min(1 << (left.bit_length() - 1), self.tiers[0])
            window = Window(size)
            while gap:
                document, start, length = self.take(self.longest(self.tiers[0]))
                window.pieces.append((document, start, min(length, gap)))
                if length > gap:
                    self.put(document, start + gap, length - gap)
                gap -= min(length, gap)
            left -= size
            yield window


def balanced(windows: list[Window], in_group: int) -> list[list[Window]]:
    """Groups of ``in_group`` windows with costs as equal as dealing out the costly ones first makes them."""
    groups: list[list[Window]] = [[] for _ in range(-(-len(windows) // in_group))]
    heap = [(0, i) for i in range(len(groups))]
    for window in sorted(windows, key=Window.cost, reverse=True):
        cost, i = heapq.heappop(heap)
        groups[i].append(window)
        if len(groups[i]) < in_group:
            heapq.heappush(heap, (cost + window.cost(), i))
    return groups


def mixed_groups(windows: list[Window], most_tokens: int) -> list[list[Window]]:
    """The windows that are left over, long ones first, in groups of at most ``most_tokens``."""
    groups, tokens = [], most_tokens
    for window in sorted(windows, key=lambda w: -w.size):
        if tokens + window.size > most_tokens:
            groups.append([])
            tokens = 0
        groups[-1].append(window)
        tokens += window.size
    return groups


class Packer:
    """Packs the documents of one task; holds one pool, and fewer windows of a tier than a step group has."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, pool_tokens: int):
        self.tiers, self.step_tokens, self.pool_tokens = tiers, max(step_tokens, tiers[0]), pool_tokens
        self.pool, self.waiting = Pool(tiers), {size: [] for size in tiers}
        self.documents: dict[int, tuple[object, np.ndarray]] = {}
        self.added = self.held = 0

    def add(self, doc_id: object, ids: np.ndarray) -> bool:
        """Whether the pool is full now."""
        self.documents[self.added] = doc_id, ids
        whole = len(ids) - len(ids) % self.tiers[0]
        for start in range(0, whole, self.tiers[0]):
            self.waiting[self.tiers[0]].append(Window(self.tiers[0], [(self.added, start, self.tiers[0])]))
        if whole < len(ids):
            self.pool.put(self.added, whole, len(ids) - whole)
        self.added += 1
        self.held += len(ids)
        return self.held >= self.pool_tokens

    def groups(self, last: bool) -> Iterator[list[Window]]:
        for window in self.pool.windows():
            self.waiting[window.size].append(window)
        for size in self.tiers:
            in_group, windows = self.step_tokens // size, self.waiting[size]
            ready = len(windows) - len(windows) % in_group
            yield from balanced(windows[:ready], in_group)
            self.waiting[size] = windows[ready:]
        if last:
            over = [w for size in self.tiers for w in self.waiting[size]] + list(self.pool.rest())
            yield from mixed_groups(over, self.step_tokens)
            return
        used = {d for windows in self.waiting.values() for w in windows for d, _, _ in w.pieces}
        used |= {d for pieces in self.pool.pieces.values() for d, _, _ in pieces}
        self.documents = {d: self.documents[d] for d in used}
        self.held = 0


def packed(
    docs: DataFrame, encoder: Encoder, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS,
    pool_tokens: int = POOL_TOKENS,
) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, sequence_tokens, step_id, ids``: one row a piece.

    Each id of each document lies in one piece, and pieces fill their sequence from offset 0 to its length, a
    power of two up to the first tier. ``ids`` are little-endian unsigned 32-bit numbers. A step group has
    ``step_tokens`` tokens and windows of one tier, but for the last ones of a task. A NULL or empty text is a
    document of its closing id alone. Rows that repeat an id or a text are documents of their own; NULL ids are
    kept. Texts of any length are taken whole. An empty table gives no rows; other columns are not read.
    Sequence and step ids are unique, not gapless: they begin with the number of the task.
    """
    if list(tiers) != sorted(tiers, reverse=True) or any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be falling powers of two")
    shared = docs.sparkSession.sparkContext.broadcast(encoder)
    small_batches(docs.sparkSession)
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()), T.StructField("sequence_tokens", T.IntegerType()),
        T.StructField("step_id", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, id_type = Packer(tiers, step_tokens, pool_tokens), None
        base = TaskContext.get().partitionId() << 33
        sequence = step = base

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, step
            out: list[tuple] = []
            for group in packer.groups(last):
                for window in group:
                    offset = 0
                    for document, start, length in window.pieces:
                        doc_id, ids = packer.documents[document]
                        cut = ids[start:start + length].astype("<u4").tobytes()
                        out.append((doc_id, start, length, len(ids), sequence, offset, window.size, step, cut))
                        offset += length
                    sequence += 1
                step += 1
                if len(out) >= BATCH_PIECES:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        for batch in batches:
            id_type = batch.schema.field(0).type
            doc_ids = batch.column(0).to_pylist()
            for first, _, texts in slices(batch.column(1)):
                for i, text in enumerate(texts):
                    if packer.add(doc_ids[first + i], shared.value.ids(text)):
                        yield from rows(last=False)
        if id_type is not None:
            yield from rows(last=True)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def crc_of_ids() -> Column:
    """Checksum of the ids of a piece."""
    return F.crc32("ids").alias("ids_crc32")


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, step_id, sequence_tokens, ids, documents``: the rows a trainer reads. ``documents`` has
    ``(offset, length, doc_id, start)`` of each piece in order, from which attention masks and positions follow.
    A sequence has at most as many pieces as tokens, so a group is bounded."""
    piece = F.struct("offset", "length", "doc_id", "start", "ids")
    grouped = pieces.groupBy("sequence_id", "step_id", "sequence_tokens").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda all_ids, p: F.concat(all_ids, p["ids"]))
    documents = F.transform("p", lambda p: F.struct(p["offset"], p["length"], p["doc_id"], p["start"]))
    return grouped.select("sequence_id", "step_id", "sequence_tokens", joined.alias("ids"), documents.alias("documents"))
