"""Windows, vectors, ranking and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.catalog import inputs as I
from shelfmark.catalog.registry import query
from shelfmark.catalog.store import SOURCES
from shelfmark.functions import vectors as V
from shelfmark.operators import chunks as C
from shelfmark.operators import retrieval as R
from shelfmark.operators.nearest import nearest_top_k
from shelfmark.operators.spread import spread_lookup
from shelfmark.operators.store import notebook_corpus
from shelfmark.plans.notebooks import chunk_table

TOKEN = r"[ \t\n\r\f]*[^ \t\n\r\f]+|[ \t\n\r\f]+"
WORD = r"[^ \t\n\r\f]+"

CHUNKS = f"""{SOURCES}, joined AS (
  SELECT notebook_id, id, CASE WHEN row_number() OVER w > 1 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END
         || 'Title: ' || title || chr(10) || 'URL: ' || url || chr(10) || 'Content: ' || content AS text
  FROM sources WINDOW w AS (PARTITION BY notebook_id ORDER BY id)
), words AS (
  SELECT notebook_id, id, unnest(regexp_extract_all(text, '{TOKEN}')) AS word,
         generate_subscripts(regexp_extract_all(text, '{TOKEN}'), 1) AS place FROM joined
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY notebook_id ORDER BY id, place) - 1 AS n FROM words
), chunks AS (
  SELECT notebook_id, n // 500 AS chunk_no, string_agg(word, '' ORDER BY n) AS text, count(*) AS n_tokens
  FROM numbered GROUP BY ALL
)"""

VECTORS = f"""{CHUNKS}, chunk_words AS (
  SELECT notebook_id, chunk_no, unnest(regexp_extract_all(text, '{WORD}')) AS word FROM chunks
), chunk_vec AS (
  SELECT notebook_id, chunk_no, ('0x' || substr(md5(word), 1, 8))::BIGINT % 256 AS bucket, count(*) AS tf
  FROM chunk_words GROUP BY ALL
)"""


def scored(cap: str) -> str:
    return f"""{VECTORS}, query_words AS (
  SELECT item_id AS query_id, unnest(regexp_extract_all(text, '{WORD}')) AS word FROM benchmark
), query_vec AS (
  SELECT query_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 256 AS bucket, count(*) AS tf FROM query_words GROUP BY ALL
), chunk_norm AS (
  SELECT notebook_id, chunk_no, sqrt(sum(tf * tf)::DOUBLE) AS len FROM chunk_vec WHERE {cap} GROUP BY ALL
), query_norm AS (SELECT query_id, sqrt(sum(tf * tf)::DOUBLE) AS len FROM query_vec GROUP BY ALL),
dots AS (
  SELECT query_id, notebook_id, chunk_no, sum(q.tf * c.tf)::DOUBLE AS dot
  FROM query_vec q JOIN chunk_vec c USING (bucket) WHERE {cap} GROUP BY ALL
), sims AS (
  SELECT query_id, notebook_id, chunk_no, round(coalesce(dot, 0) / (q.len * c.len), 6) AS similarity
  FROM query_norm q CROSS JOIN chunk_norm c LEFT JOIN dots USING (query_id, notebook_id, chunk_no)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY notebook_id, query_id ORDER BY similarity DESC, chunk_no) AS rank FROM sims
), best AS (
  SELECT notebook_id, query_id, rank, chunk_no, similarity, text FROM ranked JOIN chunks USING (notebook_id, chunk_no)
  WHERE rank <= 5
), contexts AS (
  SELECT notebook_id, query_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM best GROUP BY ALL
)"""


RANKED = scored("true")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return notebook_corpus(I.sources(spark, sf))


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    best = R.retrieve(I.questions(spark, sf), chunk_table(I.sources(spark, sf)))
    return R.assemble_context(best)


@query(f"WITH {CHUNKS} SELECT notebook_id, chunk_no, text, n_tokens FROM chunks")
def chunk_notebook(spark, sf):
    return C.chunk_notebook(corpus(spark, sf))


@query(
    f"""WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN}')) AS word,
         generate_subscripts(regexp_extract_all(text, '{TOKEN}'), 1) - 1 AS n FROM documents
)
SELECT doc_id, (n // 500)::BIGINT AS chunk_no, string_agg(word, '' ORDER BY n) AS text, count(*) AS n_tokens
FROM words GROUP BY doc_id, n // 500"""
)
def chunk_document(spark, sf):
    return C.chunk_document(I.documents(spark, sf).select("doc_id", "text"))


@query(f"WITH {CHUNKS} SELECT notebook_id, chunk_no, n_tokens FROM chunks WHERE chunk_no < 100")
def cap_chunks(spark, sf):
    return C.cap_chunks(C.chunk_notebook(corpus(spark, sf))).select("notebook_id", "chunk_no", "n_tokens")


@query(f"WITH {VECTORS} SELECT notebook_id, chunk_no, bucket, tf FROM chunk_vec")
def hashed_embed(spark, sf):
    chunks = C.chunk_notebook(corpus(spark, sf))
    vectors = chunks.select("notebook_id", "chunk_no", R.embed(F.col("text")).alias("vec"))
    cells = vectors.select("notebook_id", "chunk_no", F.posexplode("vec").alias("bucket", "tf")).filter("tf > 0")
    return cells.select(
        "notebook_id", "chunk_no", F.col("bucket").cast("bigint").alias("bucket"), F.col("tf").cast("bigint").alias("tf")
    )


MEANS = """cells AS (
  SELECT label::BIGINT AS label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings
), means AS (SELECT label, dim, avg(x)::FLOAT::DOUBLE AS m FROM cells GROUP BY ALL)"""

CENTROIDS = f"""{MEANS}, sims AS (
  SELECT label, vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS similarity
  FROM cells JOIN means USING (label, dim) GROUP BY ALL
)"""


@query(f"WITH {CENTROIDS} SELECT label, vec_id, similarity FROM sims")
def cosine_scores(spark, sf):
    """Every vector against the mean of its label."""
    means = I.centroids(spark, sf).select("group", F.col("vec").alias("mean"))
    pairs = spread_lookup(I.vectors(spark, sf), means, ["group"], spread_by=["id"])
    return pairs.select(
        F.col("group").alias("label"),
        F.col("id").alias("vec_id"),
        F.round(V.cosine(F.col("vec"), F.col("mean")), R.DIGITS).alias("similarity"),
    )


@query(
    f"""WITH {CENTROIDS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM sims
)
SELECT label, rank, vec_id, similarity FROM ranked WHERE rank <= 5"""
)
def cosine_top_k(spark, sf):
    """The vectors nearest to the mean of each label."""
    best = R.tile_top_k(I.centroids(spark, sf), I.vectors(spark, sf))
    return best.select(F.col("group").alias("label"), "rank", F.col("id").alias("vec_id"), "similarity")


@query(
    f"""WITH {MEANS}, sims AS (
  SELECT means.label, vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS similarity
  FROM cells JOIN means USING (dim) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM sims
)
SELECT label, rank, vec_id, similarity FROM ranked WHERE rank <= 5"""
)
def cosine_search(spark, sf):
    """The vectors of any label nearest to the mean of each label."""
    everything = F.lit(0).cast("bigint").alias("group")
    asked = I.centroids(spark, sf).select(everything, "id", "vec")
    best = nearest_top_k(asked, I.vectors(spark, sf).select(everything, "id", "vec"))
    return best.select(F.col("query_id").alias("label"), "rank", F.col("id").alias("vec_id"), "similarity")


@query(f"WITH {RANKED} SELECT notebook_id, query_id, rank, chunk_no, similarity FROM best")
def retrieve_nearest(spark, sf):
    """The five best windows by the search that leaves tiles out."""
    best = R.retrieve(I.questions(spark, sf), chunk_table(I.sources(spark, sf)), search=nearest_top_k)
    return best.drop("text")


@query(f"WITH {RANKED} SELECT notebook_id, query_id, rank, chunk_no, similarity, text FROM best")
def retrieve_context(spark, sf):
    """The five best windows of each notebook for each benchmark text."""
    return R.retrieve(I.questions(spark, sf), chunk_table(I.sources(spark, sf)))


@query(f"WITH {scored('true')} SELECT notebook_id, query_id, rank, chunk_no, similarity FROM best")
def retrieve_batch(spark, sf):
    """The same without the texts."""
    best = R.retrieve(I.questions(spark, sf), chunk_table(I.sources(spark, sf)))
    return best.drop("text")


@query(f"WITH {RANKED} SELECT notebook_id, query_id, context FROM contexts")
def assemble_context(spark, sf):
    return contexts(spark, sf)


@query(
    f"""WITH {RANKED}
SELECT notebook_id, c.query_id,
       'Anda adalah Asisten Pengetahuan spesifik untuk Notebook ini. Anda harus menjawab pertanyaan secara akurat HANYA '
       || 'berdasarkan konteks yang diberikan.' || chr(10) || chr(10) || 'Konteks Sumber Data:' || chr(10) || context
       || chr(10) || chr(10) || 'Pertanyaan: ' || b.text || chr(10) || chr(10) || 'Jawaban:' AS prompt
FROM contexts c JOIN benchmark b ON b.item_id = c.query_id"""
)
def assemble_prompt(spark, sf):
    return R.assemble_prompt(contexts(spark, sf), I.questions(spark, sf)).drop("context")


@query(
    """SELECT 5::BIGINT AS notebook_id, item_id AS query_id, text AS query,
       'Notebook ini belum memiliki dokumen atau data yang berhasil diimpor. '
       || 'Silakan tambahkan sumber pengetahuan terlebih dahulu.' AS answer
FROM benchmark"""
)
def guard_empty(spark, sf):
    return R.guard_empty(I.questions(spark, sf), corpus(spark, sf))
