from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import nearest as N
from shelfmark.operators import retrieval as RT
from shelfmark.plans.notebooks import chunk_table
from shelfmark.session import BATCH_BYTES

SCHEMA = "group bigint, id bigint, vec array<float>"


def table(spark, groups, vecs):
    return spark.createDataFrame([(g, i, v.tolist()) for i, (g, v) in enumerate(zip(groups, vecs))], SCHEMA)


def rows(df):
    return sorted((r.group, r.query_id, r["rank"], r.id, r.similarity) for r in df.collect())


@pytest.mark.parametrize("k", [1, 4, 60])
def test_rows_of_the_search_over_all_tiles(spark, monkeypatch, k):
    # Ties, vectors and queries without length, a hot group, a group of fewer than k vectors.
    monkeypatch.setattr(N, "LEAF_ROWS", 7)
    monkeypatch.setattr(N, "PACK_ROWS", 16)
    rng = np.random.default_rng(5)
    vecs = rng.integers(-2, 3, (500, 4)).astype(np.float32)
    asked = rng.integers(-2, 3, (60, 4)).astype(np.float32)
    vecs[:20], asked[:2] = 0, 0
    vectors = table(spark, [1 if i % 3 else i % 11 for i in range(500)], vecs).repartition(3)
    vectors = vectors.unionByName(spark.createDataFrame([(1, 999, None)], SCHEMA))
    queries = table(spark, [i % 4 for i in range(60)], asked)
    # All numbers are strings in the rows, so that a missing similarity equals itself.
    assert [str(r) for r in rows(N.nearest_top_k(queries, vectors, k))] == [str(r) for r in rows(RT.tile_top_k(queries, vectors, k))]


def test_tiles_of_other_clusters_are_not_scored(spark):
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(40, 32))
    vecs = np.repeat(middles, 100, axis=0) + rng.normal(scale=0.05, size=(4000, 32))
    rng.shuffle(vecs)
    asked = middles + rng.normal(scale=0.05, size=middles.shape)
    vectors, queries = table(spark, [0] * 4000, vecs.astype(np.float32)).coalesce(1), table(spark, [0] * 40, asked.astype(np.float32))
    leaves = N.leaves_of(vectors)
    pairs = N.candidates(queries, leaves).agg(F.sum(F.size("q_ids"))).first()[0]
    assert 40 <= pairs < 0.3 * 40 * leaves.count()
    assert rows(N.search_leaves(queries, leaves)) == rows(RT.tile_top_k(queries, vectors))


def test_no_vector_is_closer_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF_ROWS", 16)
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(300, 6)).astype(np.float32)
    q = rng.normal(size=6)
    q /= np.linalg.norm(q)
    for leaf in N.leaves_of(table(spark, [0] * 300, vecs)).collect():
        assert 1 <= leaf.n == len(leaf.ids) <= 16
        centre = np.array(leaf.centre, dtype=float)
        angle = np.arccos(q @ centre / np.linalg.norm(centre))
        own = vecs[list(leaf.ids)].astype(float)
        best = (own @ q / np.linalg.norm(own, axis=1)).max()
        assert best <= np.cos(max(0.0, angle - leaf.spread)) + N.SLACK


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], SCHEMA), table(spark, [0], np.ones((1, 2), dtype=np.float32))
    for queries, vectors in ((none, one), (one, none), (none, none)):
        found = N.nearest_top_k(queries, vectors)
        assert found.columns == ["group", "query_id", "rank", "id", "similarity"] and found.count() == 0
    assert rows(N.nearest_top_k(one, one)) == [(0, 0, 1, 0, 1.0)]


def test_python_gets_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    one = table(spark, [0], np.ones((1, 2), dtype=np.float32))
    sources = spark.createDataFrame(
        [(1, 1, "u", "t", "some words", "success")], "id long, notebook_id long, url string, title string, content string, status string"
    )
    calls = [
        lambda: RT.tile_top_k(one, one),
        lambda: N.leaves_of(one),
        lambda: N.candidates(one, N.leaves_of(one)),
        lambda: chunk_table(sources),
    ]
    try:
        for call in calls:
            spark.conf.set(name, "64m")
            call().count()
            assert spark.conf.get(name) == f"{BATCH_BYTES}b"
    finally:
        spark.conf.set(name, before)


def test_words_are_counted_some_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(RT, "EMBED_ROWS", 3)
    texts = ["a b a", "", None, "b", " c\n", *[f"w{i} w{i % 3}" for i in range(20)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").coalesce(1)
    found = [r.vec for r in rows.select("n", RT.embed(F.col("text")).alias("vec")).orderBy("n").collect()]

    def bucket(word):
        return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % RT.DIMS

    for text, vec in zip(texts, found, strict=True):
        expected = np.zeros(RT.DIMS)
        for word in (text or "").split():
            expected[bucket(word)] += 1
        assert vec == expected.tolist()
