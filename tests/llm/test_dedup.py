from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import exact_dedup, jaccard_join, line_dedup
from tests.llm.rows import AWKWARD, DOCS, collected, docs_of, empty_of


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_exact(rows):
    """Multiset of results, ids of equal texts in order, NULL last."""
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[norm(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    return out


def plain(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("block_chars", [4, 1024])
def test_exact_groups_match_brute_force(spark, block_chars):
    rows = exact_dedup.exact_groups(docs_of(spark), block_chars)
    assert collected(rows, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == plain(brute_exact(AWKWARD))


def test_equal_codes_of_different_blocks_lead_to_another_seed(spark, monkeypatch):
    code, seeds = exact_dedup.block_code, set()

    def weak(block, seed):
        seeds.add(seed)
        return code(block, seed) % 2 if seed == 0 else code(block, seed)

    monkeypatch.setattr(exact_dedup, "block_code", weak)
    rows = exact_dedup.exact_groups(docs_of(spark), 8)
    assert collected(rows, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == plain(brute_exact(AWKWARD))
    assert seeds == {0, 1}


def test_one_changed_block_is_another_text(spark):
    base = "ab" * 500
    texts = [base, base[:-1] + "c", "c" + base[1:], base + "a", base[:500] + "ä" + base[501:], base]
    rows = exact_dedup.exact_groups(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS), 16)
    assert {r.doc_id: r.keep_id for r in rows.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 0}


def test_drop_copies_keeps_one_whole_row(spark):
    docs = docs_of(spark)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert collected(kept, "doc_id", "text") == plain(
        [(1, AWKWARD[0][1]), (3, None), (5, AWKWARD[6][1]), (None, AWKWARD[7][1]), (7, AWKWARD[9][1])]
        + [(r[0], r[1]) for r in AWKWARD[11:15]]
    )


def test_empty_tables(spark):
    docs = empty_of(docs_of(spark))
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.drop_copies(docs).columns == docs.columns
    assert jaccard_join.near_duplicates(docs).count() == 0
    assert jaccard_join.drop_near_copies(docs).count() == 0
    assert line_dedup.drop_repeated_lines(docs).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return frozenset()
    size = min(5, len(words))
    return frozenset((size, *words[i:i + size]) for i in range(len(words) - size + 1))


def brute_links(rows):
    """Links and class of each row by its place."""
    sets = [shingles(r[1]) for r in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    label = list(range(n))
    for i in range(n):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        label[i] = min((rows[j][0] is None, rows[j][0] or 0) for j in seen)
    return [(r[0], None if label[i][0] else label[i][1], len(near[i])) for i, r in enumerate(rows)]


def near_rows(seed=5, families=25):
    """Families of texts with a few words changed, so that similarities lie on both sides of 0.8."""
    rng, rows = random.Random(seed), []
    for family in range(families):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(rng.choice([6, 12, 40, 150, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 30))):
                words[rng.randrange(len(words))] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(words), "en", "s", 0))
    return rows


def test_large_groups_are_compared_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_BUCKET", 3)
    monkeypatch.setattr(jaccard_join, "TILE_CLASSES", 7)
    base = [f"w{i}" for i in range(120)]
    rng, rows = random.Random(9), near_rows(3, 12)
    for _ in range(90):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(120)] = f"c{rng.randrange(9)}"
        rows.append((len(rows), " ".join(words), "en", "s", 0))
    found = jaccard_join.near_duplicates(docs_of(spark, rows))
    assert collected(found, "doc_id", "class_id", "n_links") == plain(brute_links(rows))


@pytest.mark.parametrize("rows", [AWKWARD, near_rows(), near_rows(11, 40)])
def test_near_duplicates_match_brute_force(spark, rows):
    found = jaccard_join.near_duplicates(docs_of(spark, rows))
    assert collected(found, "doc_id", "class_id", "n_links") == plain(brute_links(rows))


def test_chain_of_links_is_one_class(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        if i:
            words[4 * i] = f"c{i}"
        rows.append((i, " ".join(words), "en", "s", 0))
    found = jaccard_join.near_duplicates(docs_of(spark, rows))
    assert collected(found, "doc_id", "class_id", "n_links") == plain(brute_links(rows))
    assert {r.class_id for r in found.collect()} == {0}


def test_copies_are_counted_not_paired(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, text, "en", "s", 0) for i in range(3000)] + [(3000, text + " more", "en", "s", 0)]
    found = jaccard_join.near_duplicates(docs_of(spark, rows, clashes=False))
    assert {(r.class_id, r.n_links) for r in found.collect()} == {(0, 3000)}
    assert [r.doc_id for r in jaccard_join.drop_near_copies(docs_of(spark, rows)).collect()] == [0]


def test_pruning_keeps_pairs_at_the_threshold():
    limits = jaccard_join.least_matches(0.8, 1e-6)
    assert [n for n, _ in limits][-1] == jaccard_join.HASHES
    assert all(0 < least < 0.8 * n for n, least in limits)




def test_repeated_runs_go_and_first_ones_stay(spark):
    run = ["alpha one", "beta two", "gamma three", "delta four"]
    long = " ".join(f"long{i}" for i in range(60))
    rows = [
        (1, "\n".join(["intro", *run, "end of one"]), "", "", 0),
        (2, "\n".join(["other", *run, "", "end of two"]), "", "", 0),
        (3, "\n".join(["x", long, "y"]), "", "", 0),
        (4, "\n".join(["p", long, "alpha one", "beta two", "q"]), "", "", 0),
        (5, "\n".join(run), "", "", 0),
        (6, "\n".join(["solo", *run[:2], "mid", *run[2:]]), "", "", 0),
        (7, "\n".join(["a", "b", "c", "a", "b", "c", "a", "b", "c"]), "", "", 0),
        (8, None, "", "", 0),
        (None, "alone", "", "", 0),
    ]
    found = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.drop_repeated_lines(docs_of(spark, rows)).collect()}
    assert found[1] == (rows[0][1], 0)
    assert found[2] == ("other\n\nend of two", 4)
    assert found[3] == (rows[2][1], 0)
    assert found[4] == ("p\nalpha one\nbeta two\nq", 1)
    assert found[5] == ("", 4)
    assert found[6] == (rows[5][1], 0)
    assert found[7] == ("a\nb\nc", 6)
    assert found[8] == ("", 0) and found[None] == ("alone", 0)


def test_line_dedup_of_random_texts(spark):
    """No line is lost everywhere, every deleted line lies in a repeated run, and long repeats are gone."""
    rng, rows = random.Random(3), []
    shared = [[f"s{k} {i}" for i in range(rng.randrange(3, 9))] for k in range(6)]
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            lines += rng.choice(shared) if rng.random() < 0.6 else [f"own {rng.random()}" for _ in range(rng.randrange(1, 4))]
        rows.append((i, "\n".join(lines), "", "", 0))
    found = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs_of(spark, rows, clashes=False)).collect()}
    first = {}
    for doc_id, text, *_ in rows:
        lines = text.split("\n")
        kept = found[doc_id].text.split("\n")
        assert len(kept) + found[doc_id].n_removed == len(lines) or not found[doc_id].text
        for i, line in enumerate(lines):
            first.setdefault(line, doc_id)
        for line in set(lines):
            if first[line] == doc_id:
                assert line in kept
    # A shared run is at least three lines: after its first document, each of its whole copies is gone.
    for run in shared:
        holders = [d for d, text, *_ in rows if "\n".join(run) in text]
        for d in holders[1:]:
            assert "\n".join(run) not in found[d].text


def letters(seed, most=14):
    rng = random.Random(seed)
    return [(i, "\n".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, most))), "", "", 0) for i in range(120)]


def repeated(rows, size):
    """Of each document the lines in runs of ``size`` lines that came before."""
    seen, out = set(), {}
    for doc_id, text, *_ in rows:
        lines = text.split("\n")
        out[doc_id] = set()
        for i in range(len(lines) - size + 1):
            if tuple(lines[i:i + size]) in seen:
                out[doc_id] |= set(range(i, i + size))
            seen.add(tuple(lines[i:i + size]))
    return out


def test_every_repeated_gram_goes_if_each_is_selected(spark):
    """Of few different lines, most are common on their own; exactly the runs that came before are gone."""
    rows = letters(11)
    gone = repeated(rows, 3)
    expected = {i: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i])) for i, t, *_ in rows}
    found = line_dedup.drop_repeated_lines(docs_of(spark, rows), window=1).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in found} == expected


def removed_places(spark, rows, window=line_dedup.WINDOW):
    lines = line_dedup.hashed_lines(docs_of(spark, rows, clashes=False), line_dedup.GRAM, line_dedup.LONG_WORDS)
    prints = line_dedup.fingerprints(lines, line_dedup.GRAM, window)
    return {r.doc_id: set(r.removed) for r in line_dedup.repeated_places(prints).collect()}, prints


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_guarantee_of_winnowing(spark, seed):
    """All lines of repeated runs of four lines go, none outside of repeated runs of three or copies of short texts."""
    rows = letters(seed, most=20)
    must, may = repeated(rows, 4), repeated(rows, 3)
    seen = set()
    for doc_id, text, *_ in rows:
        lines = text.split("\n") if text else []
        if 3 <= len(lines) < 4:
            may[doc_id] |= set(range(len(lines))) if text in seen else set()
            must[doc_id] |= set(range(len(lines))) if text in seen else set()
            seen.add(text)
    found, prints = removed_places(spark, rows)
    for doc_id, text, *_ in rows:
        assert must[doc_id] <= found.get(doc_id, set()) <= may[doc_id], (doc_id, text)
    assert any(len(m) for m in must.values())
    n_lines = sum(len(t.split("\n")) for _, t, *_ in rows)
    assert prints.count() < 0.8 * n_lines
    assert prints.count() == prints.select("doc_id", "tkey", "pos").distinct().count()


def test_borders_of_a_run_are_found_by_extension(spark, monkeypatch):
    """A later run has lines on both sides of its outer fingerprints."""
    runs = [[f"r{k} line {i}" for i in range(9)] for k in range(12)]
    rows = [(k, "\n".join([f"in {k}", *run, f"out {k}"]), "", "", 0) for k, run in enumerate(runs)]
    rows += [(100 + k, "\n".join([f"other {k}", *run, f"end {k}"]), "", "", 0) for k, run in enumerate(runs)]
    # An earlier document that has the inner lines only, and so hides the borders from a join by grams alone.
    rows += [(-1 - k, "\n".join([f"x {k}", *run[1:8], f"y {k}"]), "", "", 0) for k, run in enumerate(runs)]
    found, _ = removed_places(spark, rows)
    assert all(found[100 + k] == set(range(1, 10)) for k in range(12))
    assert all(found[k] == set(range(2, 9)) for k in range(12))
    monkeypatch.setattr(line_dedup, "extended", lambda *a: F.lit(0))
    plain, _ = removed_places(spark, rows)
    assert any(plain[100 + k] != found[100 + k] for k in range(12))


def test_long_lines_are_always_selected(spark):
    long = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(1, "\n".join(long), "", "", 0)] + [(2 + k, "\n".join([f"p {k}", x, f"q {k}"]), "", "", 0) for k, x in enumerate(long)]
    found, _ = removed_places(spark, rows)
    assert found == {2 + k: {1} for k in range(4)}


def test_repeats_of_few_lines_go_by_their_words(spark):
    """Two lines of over 50 words together, and whole documents of one or two lines."""
    two = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("u", 43), ("v", 49))]
    rows = [
        (1, "\n".join(["one", *two, "end"]), "", "", 0), (2, "\n".join(["two", two[0], "", two[1], "last"]), "", "", 0),
        (3, "\n".join([two[0], "between", two[1]]), "", "", 0), (4, "a short text here\nof two lines", "", "", 0),
        (5, "a short text here\n\nof two lines", "", "", 0), (6, "x\na short text here\nof two lines\ny", "", "", 0),
        (7, "one line of text", "", "", 0), (8, "one line of text", "", "", 0), (9, "a b", "", "", 0), (10, "a b", "", "", 0),
    ]
    found = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.drop_repeated_lines(docs_of(spark, rows)).collect()}
    gone = {2: ("two\n\nlast", 2), 5: ("", 2), 8: ("", 1)}
    assert found == {r[0]: gone.get(r[0], (r[1], 0)) for r in rows}


def test_line_dedup_takes_awkward_rows(spark):
    found = line_dedup.drop_repeated_lines(docs_of(spark))
    assert found.count() == len(AWKWARD)
    # The one line of the long text is over 50 words, so its copy goes.
    texts = {r.doc_id: r.text for r in found.collect() if r.doc_id in (7, 8)}
    assert texts == {7: AWKWARD[9][1], 8: ""}
