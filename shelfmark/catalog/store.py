"""Notebooks, sources and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.catalog import inputs as I
from shelfmark.catalog.registry import ORACLES, query
from shelfmark.operators import report as R
from shelfmark.operators import store as K
from shelfmark.plans import notebooks as N
from shelfmark.session import run_folder
from shelfmark.sources.readers import read_kb, read_pages, write_kb

NOTEBOOK = "CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 ELSE 4 END::BIGINT"

SOURCES = f"""sources AS (
  SELECT doc_id + 1 AS id, {NOTEBOOK} AS notebook_id, 'doc://' || doc_id AS url, 'doc://' || doc_id AS title,
         text AS content, 'success' AS status, '2024-01-01' AS last_updated FROM documents
)"""

CHANGES = f"""{SOURCES}, labelled AS (SELECT s.*, quality, toxic FROM sources s JOIN labels l ON l.doc_id + 1 = s.id),
changes AS (
  SELECT notebook_id, url, 'v2' AS title, 'second ' || content AS content, 'success' AS status, '2024-02-01' AS last_updated
  FROM labelled WHERE quality = 1
  UNION ALL SELECT notebook_id, url, '', '', 'failed', '2024-03-01' FROM labelled WHERE toxic = 1
  UNION ALL SELECT 2, 'item://' || item_id, 'item://' || item_id, text, 'success', '2024-02-01' FROM benchmark
), newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY notebook_id, url ORDER BY last_updated DESC) AS n FROM changes)
  WHERE n = 1
), good AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY notebook_id, url ORDER BY last_updated DESC) AS n FROM changes WHERE status <> 'failed'
  ) WHERE n = 1
), added AS (
  SELECT n.*, (SELECT max(id) FROM sources) + row_number() OVER (ORDER BY n.notebook_id, n.url) AS id
  FROM newest n WHERE (n.notebook_id, n.url) NOT IN (SELECT (notebook_id, url) FROM sources)
)"""


def upserted(values: str) -> str:
    return f"""WITH {CHANGES}
SELECT s.id, s.notebook_id, s.url, coalesce(v.title, s.title) AS title, coalesce(v.content, s.content) AS content,
       coalesce(v.status, s.status) AS status, coalesce(n.last_updated, s.last_updated) AS last_updated
FROM sources s LEFT JOIN newest n ON n.notebook_id = s.notebook_id AND n.url = s.url
LEFT JOIN {values} v ON v.notebook_id = s.notebook_id AND v.url = s.url
UNION ALL SELECT id, notebook_id, url, title, content, status, last_updated FROM added"""


def day(df: DataFrame, column: str = "last_updated") -> DataFrame:
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd"))


HOSTS = r"""hosts AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS name FROM pages),
notebooks AS (SELECT row_number() OVER (ORDER BY name) AS id, name FROM hosts WHERE name LIKE '%.com'),
later AS (
  SELECT row_number() OVER (ORDER BY name) + (SELECT coalesce(max(id), 0) FROM notebooks) AS id, name
  FROM hosts WHERE name NOT LIKE '%.com'
)"""

CHATS = r"""pairs AS (
  SELECT u.conv_id AS notebook_id, u.turn, u.text AS query, a.text AS answer FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'
), first_pairs AS (
  SELECT row_number() OVER (ORDER BY notebook_id, turn) AS id, * FROM pairs WHERE turn <= 1
), later_pairs AS (
  SELECT row_number() OVER (ORDER BY notebook_id, turn) + (SELECT coalesce(max(id), 0) FROM first_pairs) AS id, *
  FROM pairs WHERE turn > 1
), logs AS (
  SELECT id, notebook_id, query, answer, '2024-01-01' AS created_at FROM first_pairs
  UNION ALL SELECT id, notebook_id, query, answer, '2024-02-01' FROM later_pairs
)"""


@query(
    f"""WITH {HOSTS}
SELECT id, name, '2024-01-01' AS created_at FROM notebooks UNION ALL SELECT id, name, '2024-02-01' FROM later"""
)
def append_notebooks(spark, sf):
    names = I.host_names(spark, sf).filter(~F.col("name").endswith(".com"))
    blank = names.select(F.lit(" ").alias("name")).distinct()
    added = K.append_notebooks(I.notebooks(spark, sf), names.unionByName(blank), I.ts(I.SECOND))
    return day(added, "created_at")


@query(f"WITH {HOSTS} SELECT id, name, '2024-01-01' AS created_at FROM notebooks ORDER BY id DESC")
def list_notebooks(spark, sf):
    return day(K.list_notebooks(I.notebooks(spark, sf)), "created_at")


@query(upserted("newest"))
def upsert_sources(spark, sf):
    """A failed refetch blanks the text."""
    return day(K.upsert_sources(I.sources(spark, sf), I.source_changes(spark, sf), keep_on_fail=False))


@query(upserted("good"))
def upsert_keep_on_fail(spark, sf):
    """A failed refetch leaves the text that was there."""
    return day(K.upsert_sources(I.sources(spark, sf), I.source_changes(spark, sf)))


@query(
    f"""WITH {SOURCES}
SELECT notebook_id, id, url, title, status, last_updated FROM sources ORDER BY notebook_id, last_updated DESC, id DESC"""
)
def list_sources(spark, sf):
    return day(K.list_sources(I.sources(spark, sf)))


@query(
    f"""WITH {SOURCES}
SELECT id, url, title, content, status, last_updated FROM sources
WHERE id IN (SELECT doc_id + 1 FROM labels WHERE toxic = 1) AND notebook_id = 2"""
)
def source_detail(spark, sf):
    """Details wanted for the toxic documents, as if all were in the English notebook."""
    wanted = I.table(spark, sf, "labels").filter("toxic = 1")
    keys = wanted.select((F.col("doc_id") + 1).alias("id"), F.lit(2).cast("bigint").alias("notebook_id"))
    return day(K.source_detail(I.sources(spark, sf), keys))


@query(
    f"""WITH {SOURCES}
SELECT id, notebook_id, url, title, content, status, last_updated FROM sources
WHERE id NOT IN (SELECT doc_id + 1 FROM labels WHERE quality = 0) OR notebook_id <> 2"""
)
def delete_sources(spark, sf):
    poor = I.table(spark, sf, "labels").filter("quality = 0")
    keys = poor.select((F.col("doc_id") + 1).alias("id"), F.lit(2).cast("bigint").alias("notebook_id"))
    return day(K.delete_sources(I.sources(spark, sf), keys))


@query(
    f"""WITH {SOURCES}, {CHATS}, doomed AS (SELECT notebook_id FROM sources GROUP BY 1 HAVING count(*) < 0.2 * (SELECT count(*) FROM sources))
SELECT 'notebooks' AS kind, id, '' AS url FROM (SELECT DISTINCT notebook_id AS id FROM sources)
WHERE id NOT IN (FROM doomed)
UNION ALL SELECT 'sources', id, url FROM sources WHERE notebook_id NOT IN (FROM doomed)
UNION ALL SELECT 'chat_logs', id, query FROM logs WHERE notebook_id NOT IN (FROM doomed)"""
)
def delete_cascade(spark, sf):
    """Language notebooks with less than a fifth of all sources go, with what belongs to them."""
    sources = I.sources(spark, sf)
    counts = R.source_counts(sources)
    fifth = sources.agg(F.count("*") * 0.2).scalar()
    logs = K.append_chats(I.chat_logs(spark, sf), I.later_chats(spark, sf), I.ts(I.SECOND), ["notebook_id", "turn"])
    tables = {
        "notebooks": counts.select(F.col("notebook_id").alias("id")),
        "sources": sources,
        "chat_logs": logs,
    }
    left = K.delete_notebooks(tables, counts.filter(F.col("n_sources") < fifth).select(F.col("notebook_id").alias("id")))
    shown = {"notebooks": F.lit(""), "sources": F.col("url"), "chat_logs": F.col("query")}
    parts = [left[t].select(F.lit(t).alias("kind"), "id", c.alias("url")) for t, c in shown.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""WITH {SOURCES}
SELECT notebook_id, id, 'Title: ' || title || chr(10) || 'URL: ' || url || chr(10) || 'Content: ' || content AS text
FROM sources"""
)
def notebook_corpus(spark, sf):
    return K.notebook_corpus(I.sources(spark, sf))


@query(f"WITH {CHATS} SELECT id, notebook_id, query, answer, created_at FROM logs")
def append_chats(spark, sf):
    logs = I.chat_logs(spark, sf)
    return day(K.append_chats(logs, I.later_chats(spark, sf), I.ts(I.SECOND), ["notebook_id", "turn"]), "created_at")


@query(f"WITH {CHATS} SELECT notebook_id, id, query, answer, created_at FROM logs ORDER BY notebook_id, created_at, id")
def chat_history(spark, sf):
    logs = K.append_chats(I.chat_logs(spark, sf), I.later_chats(spark, sf), I.ts(I.SECOND), ["notebook_id", "turn"])
    return day(K.chat_history(logs), "created_at")


@query(
    f"""WITH {SOURCES}
SELECT c.id AS notebook_id, count(s.id) AS n_sources FROM (SELECT DISTINCT conv_id AS id FROM conversations) c
LEFT JOIN sources s ON s.notebook_id = c.id GROUP BY 1"""
)
def source_counts(spark, sf):
    """Conversations as notebooks; most have no sources."""
    notebooks = I.table(spark, sf, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return R.source_counts(I.sources(spark, sf), notebooks)


@query(
    f"""{upserted("newest").replace("SELECT s.id,", "SELECT * FROM (SELECT s.id,", 1)})"""
    .replace("WITH", "WITH final AS (WITH", 1)
    + """) SELECT id, url, CASE status WHEN 'success' THEN 'TERSIMPAN' ELSE 'GAGAL' END AS badge,
       CASE title WHEN '' THEN 'Dokumen Tanpa Judul' ELSE title END AS shown_title FROM final"""
)
def display_status(spark, sf):
    current = K.upsert_sources(I.sources(spark, sf), I.source_changes(spark, sf), keep_on_fail=False)
    return R.display_status(current)


@query("SELECT page_id, url, html FROM pages", name="read_pages")
def pages_scan(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages(spark, f"{sf}/pages.parquet")


@query(f"WITH {SOURCES} SELECT * FROM sources", name="read_kb")
def kb_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Sources written as a knowledge table and read back with its fixed schema."""
    folder = run_folder(spark, "kb")
    write_kb(I.sources(spark, sf), folder, "sources")
    return day(read_kb(spark, folder, "sources"))


def stored_sources(spark: SparkSession, sf: str) -> str:
    folder = run_folder(spark, "kb")
    write_kb(I.sources(spark, sf), folder, "sources")
    return folder


@query(ORACLES["upsert_keep_on_fail"])
def upsert_stored(spark, sf):
    """Changes upserted into the stored table, whose other buckets stay."""
    folder = stored_sources(spark, sf)
    N.upsert_stored(I.source_changes(spark, sf), folder)
    return day(read_kb(spark, folder, "sources"))


@query(
    f"""WITH {SOURCES}
SELECT notebook_id, id, url, title, status, last_updated FROM sources WHERE notebook_id = 2 ORDER BY last_updated DESC, id DESC"""
)
def list_stored_sources(spark, sf):
    """The English notebook of the stored table; other buckets are not read."""
    english = I.table(spark, sf, "documents").filter("lang = 'en'").select(I.language_notebook(F.col("lang")).alias("notebook_id"))
    return day(K.list_sources(read_kb(spark, stored_sources(spark, sf), "sources", english), 2))


@query(ORACLES["delete_sources"])
def delete_stored_sources(spark, sf):
    folder = stored_sources(spark, sf)
    poor = I.table(spark, sf, "labels").filter("quality = 0")
    keys = poor.select((F.col("doc_id") + 1).alias("id"), F.lit(2).cast("bigint").alias("notebook_id"))
    N.delete_stored_sources(keys, folder)
    return day(read_kb(spark, folder, "sources"))
