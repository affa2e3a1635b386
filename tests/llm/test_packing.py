from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import packing, queries
from tests.llm.rows import AWKWARD, DOCS, docs_of, empty_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.load_encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


TEXTS = [r[1] or "" for r in AWKWARD] + [
    "a <|endoftext|> b", "it's  we'll\r\n\t x", "   ", "   x", "ⅷ½ 12ab", "a" * 3000, " " * 500 + "x", "\U0001f600" * 50,
]


def test_ids_are_those_of_the_tokenizer_library(encoder, library):
    for text in TEXTS:
        assert encoder.ids(text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_slices_of_long_texts_give_the_same_ids(encoder, library, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_CHARS", 7)
    for text in [t[:5000] for t in TEXTS]:
        assert encoder.ids(text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def held(rows, ids_of, tiers=packing.TIERS):
    """The rules of a packing, for rows of one piece each; ``ids_of`` has the ids of each document."""
    assert Counter(i for i, parts in documents(rows).items() for _ in parts) == Counter(list(ids_of))
    sizes, offsets = {}, defaultdict(list)
    for r in rows:
        sizes[r.sequence_id] = r.sequence_tokens
        offsets[r.sequence_id].append((r.offset, r.length))
    for sequence, parts in offsets.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        size = sizes[sequence]
        assert at == size <= tiers[0] and size & (size - 1) == 0


def documents(rows):
    """Of each id its documents, as the list of ids, put together from pieces that share no token."""
    out = defaultdict(list)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    for doc_id, parts in by_id.items():
        for start in [p for p in parts if p.start == 0]:
            ids, at = np.frombuffer(start.ids, "<u4").tolist(), start.length
            while at < start.doc_tokens:
                nxt = next(p for p in parts if p.start == at and p.doc_tokens == start.doc_tokens)
                parts.remove(nxt)
                ids += np.frombuffer(nxt.ids, "<u4").tolist()
                at += nxt.length
            out[doc_id].append(ids)
    return out


@pytest.mark.parametrize("tiers", [packing.TIERS, (64, 8, 4)])
def test_awkward_documents_lie_whole_in_full_sequences(spark, encoder, library, tiers):
    rows = packing.packed(docs_of(spark), encoder, tiers, step_tokens=256, pool_tokens=300).collect()
    held(rows, [r[0] for r in AWKWARD], tiers)
    wanted = defaultdict(list)
    for doc_id, text, *_ in AWKWARD:
        wanted[doc_id].append([*library.encode(text or "", add_special_tokens=False).ids, 0])
    got = documents(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in wanted.items()}


def test_an_empty_table_gives_no_rows(spark, encoder):
    assert packing.packed(empty_of(docs_of(spark)), encoder).count() == 0


def test_tiers_must_be_powers_of_two(spark, encoder):
    with pytest.raises(ValueError):
        packing.packed(docs_of(spark), encoder, (1000, 10))


def test_gaps_are_filled_from_shorter_tiers_before_anything_is_cut():
    pool = packing.Pool((16, 8, 4))
    for document, length in enumerate([10, 6, 5, 3, 4, 4]):
        pool.put(document, 0, length)
    windows = list(pool.windows())
    assert [(w.size, [n for _, _, n in w.pieces]) for w in windows] == [(16, [10, 6]), (8, [5, 3]), (4, [4]), (4, [4])]


def test_a_gap_that_nothing_fits_takes_the_head_of_the_shortest_longer_piece():
    pool = packing.Pool((16, 8))
    for document, length in enumerate([13, 12, 7]):
        pool.put(document, 0, length)
    assert [w.pieces for w in pool.windows()] == [[(0, 0, 13), (2, 0, 3)], [(1, 0, 12), (2, 3, 4)]]


@pytest.mark.parametrize("seed", range(5))
def test_random_pools_lose_nothing(seed):
    rnd = random.Random(seed)
    packer = packing.Packer((64, 16, 4), 128, 500)
    lengths, groups = [], []
    for i in range(400):
        lengths.append(rnd.choice([1, 2, 3, 5, 17, 40, 63, 64, 65, 200]))
        if packer.add(i, np.zeros(lengths[-1], dtype=np.uint32)):
            groups += list(packer.groups(last=False))
            assert sum(n * len(p) for n, p in packer.pool.pieces.items()) < 64
    full = len(groups)
    groups += list(packer.groups(last=True))
    covered = Counter()
    for i, group in enumerate(groups):
        assert sum(w.size for w in group) == 128 if i < full else sum(w.size for w in group) <= 128
        assert i >= full or len({w.size for w in group}) == 1
        for window in group:
            assert sum(n for _, _, n in window.pieces) == window.size
            for document, start, n in window.pieces:
                covered.update((document, start + k) for k in range(n))
    assert covered == Counter((d, k) for d, n in enumerate(lengths) for k in range(n))


def test_costs_of_step_groups_are_balanced():
    rnd = random.Random(1)
    windows = []
    for _ in range(64):
        cuts = sorted(rnd.sample(range(1, 64), rnd.choice([0, 1, 5, 30])))
        borders = [0, *cuts, 64]
        windows.append(packing.Window(64, [(0, a, b - a) for a, b in zip(borders, borders[1:], strict=False)]))
    dealt = [sum(w.cost() for w in g) for g in packing.balanced(windows, 8)]
    naive = [sum(w.cost() for w in sorted(windows, key=packing.Window.cost)[i:i + 8]) for i in range(0, 64, 8)]
    assert max(dealt) < 1.2 * min(dealt) and max(naive) > 2 * min(naive)


def test_sequences_hold_the_ids_of_their_pieces(spark, encoder):
    pieces = packing.packed(docs_of(spark), encoder).persist()
    by_sequence = defaultdict(list)
    for r in pieces.collect():
        by_sequence[r.sequence_id].append((r.offset, bytes(r.ids), r.doc_id))
    rows = packing.sequences(pieces).collect()
    assert len(rows) == len(by_sequence)
    for r in rows:
        parts = sorted(by_sequence[r.sequence_id], key=lambda p: p[0])
        assert bytes(r.ids) == b"".join(p[1] for p in parts) and len(r.ids) == 4 * r.sequence_tokens
        assert [d.doc_id for d in r.documents] == [p[2] for p in parts]


def test_the_query_packs_every_document(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {d: [*e.ids, 0] for d, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    rows = queries.QUERIES["op11_packing"](spark, sf).orderBy("doc_id", "start").collect()
    at = Counter()
    for r in rows:
        cut = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert r.start == at[r.doc_id] and r.ids_crc32 == zlib.crc32(cut) and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
    assert at == {d: len(x) for d, x in ids.items()}
    by_sequence = Counter()
    for r in rows:
        by_sequence[r.sequence_id] += r.length
    padded = sum(n if n & (n - 1) == 0 else 1024 for n in by_sequence.values())
    assert padded == sum(at.values())


def test_rows_with_clashing_names_and_nulls_pass(spark, encoder):
    docs = spark.createDataFrame([(None, None, "x", "y", 1)], DOCS).withColumns({c: F.lit(1) for c in ("ids", "start", "offset", "step_id")})
    row = packing.packed(docs, encoder).first()
    assert (row.doc_id, row.start, row.length, row.doc_tokens, row.sequence_tokens) == (None, 0, 1, 1, 1)
