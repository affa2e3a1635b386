"""Ranking of notebook windows for tables of questions, and the contexts made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import is_blank
from shelfmark.operators.spread import spread_lookup
from shelfmark.operators.store import SEPARATOR
from shelfmark.session import small_batches, stored

Encoder = Callable[[list[str]], np.ndarray]
Search = Callable[[DataFrame, DataFrame, int], DataFrame]

# Fixed values of the question step: windows per context, texts per call of a model, texts whose words are
# counted at once, digits of a similarity, the wording of the prompt and of the answer for an empty notebook.
TOP_K = 5
EMBED_BATCH = 50
EMBED_ROWS = 1024
DIGITS = 6
DIMS = 256
PROMPT = (
    "Anda adalah Asisten Pengetahuan spesifik untuk Notebook ini. Anda harus menjawab pertanyaan "
    "secara akurat HANYA berdasarkan konteks yang diberikan.\n\nKonteks Sumber Data:\n{context}"
    "\n\nPertanyaan: {query}\n\nJawaban:"
)
EMPTY_ANSWER = (
    "Notebook ini belum memiliki dokumen atau data yang berhasil diimpor. Silakan tambahkan sumber "
    "pengetahuan terlebih dahulu."
)

# A pair of tiles has at most TILE_ROWS ** 2 similarities; a task starts with TILES_A_SALT tiles of vectors.
TILE_BYTES = 1 << 20
TILE_ROWS = 1024
TILES_A_SALT = 16
TILE = "group bigint, ids array<bigint>, matrix binary"
SCORED = "group bigint, query_id bigint, id bigint, similarity double"


def hashed_counts(text: Column, dims: int = DIMS) -> Column:
    """Counts of words by hash bucket; stands in for a model and needs no download.

    Words and buckets are found by built-in functions; only bucket numbers reach Python, which counts ``EMBED_ROWS``
    texts at once.
    """
    most = EMBED_ROWS
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r\f]+"), F.lit(0))
    buckets = F.transform(
        words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(dims)).cast("int")
    )

    @F.pandas_udf("array<float>")
    def counts(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in series:
            vecs = []
            for start in range(0, len(batch), most):
                rows = batch.iloc[start : start + most]
                sizes = np.array([len(r) for r in rows], dtype=np.int64)
                cells = np.repeat(np.arange(len(rows)) * dims, sizes)
                cells += np.concatenate([np.zeros(0, dtype=np.int64), *rows]).astype(np.int64, copy=False)
                matrix = np.bincount(cells, minlength=len(rows) * dims).reshape(len(rows), dims)
                vecs.extend(matrix.astype(np.float32))
            yield pd.Series(vecs, dtype=object)

    return counts(buckets)


def embed(text: Column, encoder: Encoder | None = None, batch: int = EMBED_BATCH) -> Column:
    """A vector per text. ``encoder`` maps a list of texts to a matrix, ``batch`` at a time; without one, word
    counts by hash bucket."""
    if encoder is None:
        return hashed_counts(text)

    @F.pandas_udf("array<float>")
    def vectors(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            values = texts.fillna("").tolist()
            rows = []
            for start in range(0, len(values), batch):
                rows.extend(encoder(values[start : start + batch]))
            yield pd.Series(rows, dtype=object)

    return vectors(text)


def _tiles(vectors: DataFrame) -> DataFrame:
    """Vectors of one group packed into matrices of at most ``TILE_BYTES`` and ``TILE_ROWS``, batch by batch."""
    limit, most_rows = TILE_BYTES, TILE_ROWS

    def pack(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for group, part in pdf.groupby("group", sort=False):
                size = min(most_rows, max(1, limit // max(1, 4 * len(part["vec"].iloc[0]))))
                for start in range(0, len(part), size):
                    rows = part.iloc[start : start + size]
                    matrix = np.stack(rows["vec"].to_list()).astype(np.float32)
                    yield pd.DataFrame(
                        {"group": [group], "ids": [rows["id"].to_numpy()], "matrix": [matrix.tobytes()]}
                    )

    return vectors.filter(F.col("vec").isNotNull()).select("group", "id", "vec").mapInPandas(pack, TILE)


def meeting(asked: DataFrame, tiles: DataFrame) -> DataFrame:
    """Each tile of queries with each stored tile of its group; the salts of a group follow from its tiles."""
    salts = tiles.groupBy("group").agg(F.ceil(F.count("*") / TILES_A_SALT).alias("salts"))
    salted = spread_lookup(tiles, salts, ["group"], "inner", ["ids"]).withColumn(
        "salt", F.pmod(F.xxhash64("ids"), F.col("salts"))
    )
    repeated = asked.join(salts, "group").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    return salted.drop("salts").join(repeated.drop("salts"), ["group", "salt"])


def scorer(k: int):
    """For ``mapInPandas`` over ``group, ids, matrix, q_ids, q_matrix``: the ``k`` best of each pair of tiles."""
    digits = 10**DIGITS

    def score(batches):
        import numpy as np
        import pandas as pd

        def unpack(ids, matrix):
            values = np.frombuffer(matrix, dtype=np.float32).reshape(len(ids), -1).astype(np.float64)
            return np.asarray(ids), values, np.sqrt((values * values).sum(axis=1))

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                q_ids, q, q_norm = unpack(row.q_ids, row.q_matrix)
                v_ids, v, v_norm = unpack(row.ids, row.matrix)
                with np.errstate(divide="ignore", invalid="ignore"):
                    exact = (q @ v.T) / (q_norm[:, None] * v_norm[None, :])
                similarity = np.sign(exact) * np.floor(np.abs(exact) * digits + 0.5) / digits
                ranked = np.where(np.isfinite(similarity), similarity, -np.inf)
                keep = min(k, len(v_ids))
                least = np.partition(ranked, -keep, axis=1)[:, -keep]
                line, column = np.nonzero(ranked >= least[:, None])
                order = np.lexsort((v_ids[column], -ranked[line, column], line))
                starts = np.searchsorted(line, np.arange(len(q_ids)))
                best = column[order[(starts[:, None] + np.arange(keep)).ravel()]]
                asked_by = np.repeat(np.arange(len(q_ids)), keep)
                yield pd.DataFrame(
                    {
                        "group": row.group,
                        "query_id": q_ids[asked_by],
                        "id": v_ids[best],
                        "similarity": np.where(np.isfinite(ranked), similarity, np.nan)[asked_by, best],
                    }
                )

    return score


def tile_top_k(queries: DataFrame, vectors: DataFrame, k: int = TOP_K) -> DataFrame:
    """The ``k`` nearest vectors by cosine for each query of the same group, exactly:
    ``group, query_id, rank, id, similarity``.

    Both sides have ``group, id, vec``. Vectors are packed into tiles where they lie; a tile of
    queries meets a tile of vectors as two matrices, and only its ``k`` best per query leave the
    task. Nothing is collected. The salts of a group follow from its number of tiles: a small group
    meets one copy of its queries, a large one is spread over as many tasks as it needs. Ties keep
    the order of ``id``; a vector without length has no similarity and comes last.
    """
    small_batches(vectors.sparkSession)
    asked = _tiles(queries).select(
        "group", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")
    )
    pairs = meeting(asked, stored(_tiles(vectors), "tiles")).select("group", "ids", "matrix", "q_ids", "q_matrix")
    return top_k(pairs.mapInPandas(scorer(k), SCORED), ["group", "query_id"], k).select(
        "group", "query_id", "rank", "id", "similarity"
    )


def top_k(scored: DataFrame, by: list[str], k: int = TOP_K) -> DataFrame:
    """The ``k`` best rows per key with their ``rank``; ties keep the order of ``id``."""
    order = Window.partitionBy(*by).orderBy(F.col("similarity").desc_nulls_last(), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def retrieve(
    queries: DataFrame, chunks: DataFrame, k: int = TOP_K, encoder: Encoder | None = None, search: Search = tile_top_k
) -> DataFrame:
    """The best windows for every question: ``notebook_id, query_id, rank, chunk_no, similarity, text``.

    ``queries`` has ``notebook_id, query_id, query``. Windows that already carry a ``vec`` are
    not embedded again; store them once and ask often. ``search`` ranks the vectors; each gives the same rows.
    """
    small_batches(chunks.sparkSession)
    # Sorted out by notebook first, so that tiles are full, and embedded once afterwards.
    ranged = queries.repartitionByRange("notebook_id", "query_id")
    asked = ranged.select(
        F.col("notebook_id").alias("group"), F.col("query_id").alias("id"), embed(F.col("query"), encoder).alias("vec")
    )
    vec = F.col("vec") if "vec" in chunks.columns else embed(F.col("text"), encoder)
    held = chunks.select(F.col("notebook_id").alias("group"), F.col("chunk_no").alias("id"), vec.alias("vec"))
    best = search(asked, held, k).select(
        F.col("group").alias("notebook_id"), "query_id", "rank", F.col("id").alias("chunk_no"), "similarity"
    )
    window = ["notebook_id", "chunk_no"]
    # A window may be among the best for any share of the questions.
    used = chunks.select(*window, "text").join(best.select(*window).distinct(), window, "left_semi")
    return spread_lookup(best, used, window, how="inner", spread_by=["query_id"], salts=4).select(
        "notebook_id", "query_id", "rank", "chunk_no", "similarity", "text"
    )


def assemble_context(retrieved: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """The windows of each question, at most ``k``, joined in rank order."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return retrieved.groupBy("notebook_id", "query_id").agg(
        F.array_join(F.transform(ranked, lambda r: r["text"]), separator).alias("context")
    )


def assemble_prompt(
    contexts: DataFrame, queries: DataFrame, template: str = PROMPT, system: str = ""
) -> DataFrame:
    """``template`` with ``{context}`` and ``{query}`` filled in, after the text ``system`` if there is one."""
    before, rest = (f"{system}\n\n" if system else "") + template.split("{context}")[0], template.split("{context}")[1]
    between, after = rest.split("{query}")
    prompt = F.concat(F.lit(before), F.col("context"), F.lit(between), F.col("query"), F.lit(after))
    return contexts.join(queries, ["notebook_id", "query_id"]).select(
        "notebook_id", "query_id", "context", prompt.alias("prompt")
    )


def guard_empty(queries: DataFrame, corpus: DataFrame, answer: str = EMPTY_ANSWER) -> DataFrame:
    """The fixed answer for questions to notebooks without text."""
    holding = corpus.filter(~is_blank(F.col("text"))).select("notebook_id").distinct()
    unanswered = spread_lookup(queries, holding, ["notebook_id"], how="left_anti", spread_by=["query_id"])
    return unanswered.select("notebook_id", "query_id", "query", F.lit(answer).alias("answer"))
