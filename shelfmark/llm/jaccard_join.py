"""Near-duplicate join on word shingles with Bayesian pruning of MinHash comparisons.

Texts with equal shingle sets form one class before anything is compared, so exact copies never meet in pairs.
Each class has ``HASHES`` MinHash values. Classes that agree on one of the bands of values are candidates
(at similarity 0.8 a pair is missed by all bands with chance 5e-7). Candidates are compared value by value, in
steps; after each step a pair is dropped if the posterior probability that its similarity reaches the
threshold is below the tolerance. What is left is verified on the whole shingle sets.

A group of g near copies has about g * g / 2 links, which never become rows. Classes that meet in a band bucket
of more than ``SMALL_BUCKET`` classes form a block; a block is cut into tiles of bounded size, and a task that
compares two tiles returns a row for each class: how many it is linked with and whom it hangs together with.
Only pairs from small buckets that are not in one block become rows, a bounded number for each class.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import WORD, rows_by_key, small_batches, text_key, text_of
from shelfmark.session import stored

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 48, 6
HASHES = BANDS * BAND_ROWS
STEP = 32
#: Buckets of more classes than this are compared in tiles; bounds of a tile in classes and in shingles.
SMALL_BUCKET, TILE_CLASSES, TILE_CODES = 16, 512, 500_000
TOLERANCE = 1e-6
CHUNK_CHARS = 2_000_000
_WORDS = re.compile(WORD)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted set of 64-bit shingle codes of each text. A text with some words, but fewer than a shingle
    has, is one shingle; a text without words has none."""
    start = 0
    while start < len(texts):
        stop, chars = start, 0
        while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= CHUNK_CHARS):
            chars += len(texts[stop])
            stop += 1
        split = [_WORDS.findall(t) for t in texts[start:stop]]
        flat = np.empty(sum(map(len, split)), dtype=object)
        flat[:] = [w for s in split for w in s]
        codes = pd.util.hash_array(flat) if len(flat) else np.zeros(0, dtype=np.uint64)
        at = 0
        for s in split:
            own = codes[at:at + len(s)]
            at += len(s)
            size = min(words, len(s))
            if not size:
                yield own
                continue
            sums = np.zeros(len(own) - size + 1, dtype=np.uint64)
            for k in range(size):
                sums = sums * _ODD + own[k:k + len(sums)]
            yield np.unique(mixed(sums + np.uint64(size)))
        start = stop


@cache
def permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * _ODD)
    return (seeds[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[HASHES:] >> np.uint64(32)).astype(np.uint32)


def minhashes(codes: np.ndarray) -> np.ndarray:
    """Smallest value of each permutation over the set, in pieces that fit the cache."""
    factor, offset = permutations()
    x = (codes >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, (x[i:i + 512, None] * factor + offset).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.astype(np.uint64).reshape(BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = mixed(key * _ODD + rows[:, k])
    return key.view(np.int64)


def sketched(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for codes in shingle_sets(batch["text"].tolist(), words):
            if not len(codes):
                rows.append((0, None, None, None))
                continue
            least = minhashes(codes)
            key = hashlib.blake2b(codes.tobytes(), digest_size=16).digest()
            rows.append((len(codes), key, band_keys(least), ((least >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes()))
        out = pd.DataFrame(rows, columns=["n", "set_key", "bands", "sketch"])
        out.insert(0, "tkey", batch["tkey"].array)
        out.insert(0, "doc", batch["doc"].array)
        yield out


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, tkey, n, set_key, bands, sketch`` of every row; NULL key, bands and sketch without words."""
    plain = docs.select(F.col("doc_id").cast("string").alias("doc"), text_key().alias("tkey"), text_of().alias("text"))
    made = plain.mapInPandas(
        lambda batches: sketched(batches, words),
        "doc string, tkey bigint, n int, set_key binary, bands array<bigint>, sketch binary",
    )
    kind = docs.schema["doc_id"].dataType
    return stored(made.withColumn("doc_id", F.col("doc").cast(kind)).drop("doc"), "sketches")


def set_classes(rows: DataFrame) -> DataFrame:
    """``set_id, set_key, n, copies, doc_id, tkey, bands, sketch``: one row for each different shingle set,
    with its smallest document (NULL ids last)."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tkey")
    groups = (
        rows.filter("n > 0")
        .groupBy("set_key")
        .agg(
            F.min(order).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"),
            F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        )
    )
    return stored(
        groups.select(
            F.monotonically_increasing_id().alias("set_id"), "set_key", "n", "copies", "rep.doc_id", "rep.tkey", "bands",
            "sketch",
        ),
        "shingle-sets",
    )


def bucket_members(sets: DataFrame) -> DataFrame:
    """``band, set_id, n, size, center``: the classes in band buckets of two and more, with the bucket's size
    and smallest class."""
    keyed = sets.select(F.explode("bands").alias("band"), "set_id", "n")
    shared = keyed.groupBy("band").agg(F.count("*").alias("size"), F.min("set_id").alias("center")).filter("size > 1")
    return stored(keyed.join(stored(shared, "buckets"), "band"), "bucket-members")


def candidates(members: DataFrame, blocks: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: classes that agree in a small bucket and whose sizes allow the threshold, each pair once,
    without the pairs inside a block."""
    small = members.filter(F.col("size") <= SMALL_BUCKET).select("band", F.col("set_id").alias("a"), F.col("n").alias("n_a"))
    other = small.toDF("band", "b", "n_b")
    close = (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")) & (F.col("a") < F.col("b"))
    pairs = small.join(other, "band").filter(close).select("a", "b").distinct()
    return (
        pairs.join(blocks.toDF("a", "block_a"), "a", "left")
        .join(blocks.toDF("b", "block_b"), "b", "left")
        .filter("block_a is null or block_b is null or block_a <> block_b")
        .select("a", "b")
    )


def tiled(sets: DataFrame, blocks: DataFrame) -> DataFrame:
    """``block, low, high, tile, set_id``: each class of a block in its tile, once for every pair of tiles."""
    sized = blocks.toDF("set_id", "block").join(sets.select("set_id", "n"), "set_id")
    tiles = sized.groupBy("block").agg(
        F.ceil(F.greatest(F.count("*") / TILE_CLASSES, F.sum("n") / TILE_CODES)).cast("int").alias("tiles")
    )
    placed = sized.join(tiles, "block").withColumn("tile", F.pmod(F.xxhash64("set_id"), F.col("tiles")).cast("int"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "set_id"
    )


def compared_tiles(rows: pd.DataFrame, limits: list[tuple[int, int]], threshold: float) -> pd.DataFrame:
    """``set_id, linked, root``: for the classes of two tiles (or of one, against itself) the number of
    documents in linked classes, and the smallest class they hang together with through these links."""
    low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
    rows = rows.sort_values("set_id", kind="stable")
    ids, copies, tile = rows["set_id"].to_numpy(), rows["copies"].to_numpy(), rows["tile"].to_numpy()
    sketch = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(-1, HASHES)
    sizes = np.array([len(c) for c in rows["codes"]], dtype=np.int64)
    _, codes = np.unique(np.concatenate(list(rows["codes"])), return_inverse=True)
    ends = np.cumsum(sizes)
    linked, root = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
    flags = np.zeros(int(codes.max()) + 1, dtype=np.int32)
    for a in np.flatnonzero(tile == low).tolist():
        partners = np.flatnonzero(tile == high)
        if low == high:
            partners = partners[partners > a]
        close = np.minimum(sizes[partners], sizes[a]) >= threshold * np.maximum(sizes[partners], sizes[a])
        partners = partners[close]
        partners = partners[likely(sketch[a:a + 1], sketch[partners], limits)]
        if not len(partners):
            continue
        flags[codes[ends[a] - sizes[a]:ends[a]]] = 1
        sums = np.concatenate([[0], np.cumsum(flags[codes], dtype=np.int64)])
        both = sums[ends[partners]] - sums[ends[partners] - sizes[partners]]
        flags[codes[ends[a] - sizes[a]:ends[a]]] = 0
        partners = partners[both >= threshold * (sizes[a] + sizes[partners] - both)]
        linked[a] += copies[partners].sum()
        linked[partners] += copies[a]
        joined = np.unique(root[np.append(partners, a)])
        if len(joined) > 1:
            root[np.isin(root, joined)] = joined[0]
    return pd.DataFrame({"set_id": ids, "linked": linked, "root": ids[root]})


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """For each number of compared values, the fewest agreements that keep a pair.

    The similarity has a uniform prior; values are compared by 8 bits, so that different values agree with
    chance 1/256 and an agreement has probability s + (1 - s) / 256 at similarity s.
    """
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    steps = [*range(STEP, HASHES, STEP), HASHES]
    out = []
    for n in steps:
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        reach = weight[:, s >= threshold].sum(axis=1) / weight.sum(axis=1)
        out.append((n, int(np.argmax(reach >= tolerance))))
    return out


def likely(x: np.ndarray, y: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Places of the rows of ``y`` that are left when compared with ``x`` (a row each, or one for all): compare
    the next values, drop the unlikely pairs, go on."""
    alive, agreed, done = np.arange(len(y)), np.zeros(len(y), dtype=np.int64), 0
    for n, least in limits:
        own = x[:, done:n] if len(x) == 1 else x[alive, done:n]
        agreed = agreed + (own == y[alive, done:n]).sum(axis=1)
        left = agreed >= least
        alive, agreed, done = alive[left], agreed[left], n
    return alive


def pruned(batches: Iterator[pd.DataFrame], limits: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), 8192):
            part = batch.iloc[start:start + 8192]
            x, y = (np.frombuffer(b"".join(part[c]), dtype=np.uint8).reshape(-1, HASHES) for c in ("x", "y"))
            yield part.iloc[likely(x, y, limits)][["a", "b"]]


def whole_sets(docs: DataFrame, sets: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``set_id, codes``: the shingle sets of the given classes, from the whole text of their first document."""
    reps = ids.join(sets.select("set_id", "doc_id", "tkey"), "set_id").select(
        "set_id", F.col("doc_id").alias("rep_id"), F.col("tkey").alias("rep_key")
    )
    texts = docs.select("doc_id", text_of().alias("text"), text_key().alias("tkey"))
    found = texts.join(reps, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("tkey") == F.col("rep_key")))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = [c.view(np.int64) for c in shingle_sets(batch["text"].tolist(), words)]
            yield pd.DataFrame({"set_id": batch["set_id"].array, "codes": pd.Series(codes, dtype=object).array})

    codes = found.select("set_id", "text").mapInPandas(whole, "set_id bigint, codes array<bigint>")
    # A first document that is repeated gives its set as often.
    return stored(codes.dropDuplicates(["set_id"]), "candidate-sets")


def links(
    docs: DataFrame, sets: DataFrame, threshold: float, tolerance: float, words: int
) -> tuple[DataFrame, DataFrame]:
    """``a, b``: edges that connect all linked classes; ``set_id, linked``: the number of documents in the other
    classes each is linked with. All links are found, pruned and verified; those inside blocks stay in tasks."""
    limits = least_matches(threshold, tolerance)
    sketch = sets.select("set_id", "sketch")
    members = bucket_members(sets)
    stars = members.filter(F.col("size") > SMALL_BUCKET).filter("set_id <> center").select("center", "set_id").distinct()
    blocks = components(stored(stars.toDF("a", "b"), "stars"))
    pairs = stored(
        candidates(members, blocks, threshold)
        .join(sketch.toDF("a", "x"), "a")
        .join(sketch.toDF("b", "y"), "b")
        .mapInPandas(lambda batches: pruned(batches, limits), "a bigint, b bigint"),
        "likely-pairs",
    )
    ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).union(blocks.select("node")).distinct()
    wholes = whole_sets(docs, sets, ids, words)
    both = F.size(F.array_intersect("x", "y"))
    verified = stored(
        pairs.join(wholes.toDF("a", "x"), "a")
        .join(wholes.toDF("b", "y"), "b")
        .filter(both >= F.lit(threshold) * (F.size("x") + F.size("y") - both))
        .select("a", "b"),
        "links",
    )
    kernel = (
        tiled(sets, blocks)
        .join(sets.select("set_id", "copies", "sketch"), "set_id")
        .join(wholes, "set_id")
        .groupBy("block", "low", "high")
        .applyInPandas(lambda rows: compared_tiles(rows, limits, threshold), "set_id bigint, linked bigint, root bigint")
    )
    inside = stored(kernel, "block-links")
    copies = sets.select(F.col("set_id").alias("v"), "copies")
    degree = verified.union(verified.select("b", "a")).toDF("set_id", "v").join(copies, "v").select(
        "set_id", F.col("copies").alias("linked")
    )
    edges = verified.union(inside.filter("root <> set_id").select("root", "set_id").distinct())
    counted = inside.select("set_id", "linked").union(degree.select("set_id", "linked"))
    return stored(edges, "link-edges"), counted.groupBy("set_id").agg(F.sum("linked").alias("linked"))


def components(pairs: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each connected component, by passing labels along the edges and
    following labels of labels until nothing changes."""
    edges = stored(pairs.union(pairs.select("b", "a")).toDF("u", "v"), "edges")
    labels = stored(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")), "labels")
    while True:
        near = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("least"))
        lower = labels.join(near, F.col("node") == F.col("u")).select(
            "node", F.col("label").alias("was"), F.least("label", "least").alias("label")
        )
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = stored(
            lower.join(of, "label").select("node", "was", F.least("label", "further").alias("label")), "labels"
        )
        if labels.filter("was <> label").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = SHINGLE_WORDS, tolerance: float = TOLERANCE
) -> DataFrame:
    """``doc_id, class_id, copy_id, n_copies, n_links, tkey`` for every row of ``docs``.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is at least the
    threshold. ``copy_id`` is the smallest id with an equal set and ``n_copies`` their number, ``class_id``
    the smallest id that links lead to, ``n_links`` the number of documents a document is linked with, its
    copies included. Copies are counted, not paired. A text with one to four words has one shingle, all its
    words; a text without words (or NULL) has no links and is a class of its own. NULL ids count as larger
    than any other. Rows that repeat id and text are copies of each other. An empty table gives no rows; other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = sketches(docs, words)
    sets = set_classes(rows)
    edges, degree = links(docs, sets, threshold, tolerance, words)
    label = components(edges)
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tkey")
    labelled = (
        sets.select("set_id", "set_key", "copies", "doc_id", "tkey")
        .join(label, F.col("set_id") == F.col("node"), "left")
        .withColumn("label", F.coalesce("label", "set_id"))
        .join(degree, "set_id", "left")
    )
    reps = labelled.groupBy("label").agg(F.min(first).alias("rep"))
    classes = labelled.join(reps, "label").select(
        "set_key", F.col("doc_id").alias("copy_id"), F.col("copies").alias("n_copies"), F.col("rep.doc_id").alias("class_id"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("rep.tkey").alias("class_key"),
    )
    worded = rows.filter("n > 0").select("doc_id", "tkey", "set_key").join(classes, "set_key").drop("set_key")
    empty = rows.filter("n = 0").select(
        "doc_id", "tkey", F.col("doc_id").alias("copy_id"), F.lit(1).cast("bigint").alias("n_copies"),
        F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("tkey").alias("class_key"),
    )
    return worded.unionByName(empty).select(
        "doc_id", "class_id", "copy_id", "n_copies", "n_links", "tkey", "class_key"
    )


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each class, that with the smallest id, with all columns."""
    rows = near_duplicates(docs, threshold)
    chosen = rows.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("tkey") == F.col("class_key")))
    return rows_by_key(docs, chosen.select("doc_id", F.col("tkey").alias("key")).distinct(), text_key())
