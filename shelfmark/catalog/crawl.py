"""Discovery from robots files, sitemaps and links; fetch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.catalog import inputs as I
from shelfmark.catalog.registry import ORACLES, query
from shelfmark.catalog.urls import HOST_STATE, SITE_URLS
from shelfmark.operators import discovery as D
from shelfmark.operators import fetchlog as L
from shelfmark.operators import robots as RB
from shelfmark.operators.spread import positions
from shelfmark.session import durable, run_folder
from shelfmark.sources import readers as S

#: Page ids of one checkpoint file, which is one JSON value.
PER_CHECKPOINT = 10_000

LISTED = rf"""{SITE_URLS}, mapped AS (
  SELECT site, url, page_id, page_id // 1000 AS block, page_id // 1000000 AS idx FROM listed WHERE site NOT LIKE '%.net'
)"""

ENTRIES = f"""{LISTED}, entries AS (
  SELECT site || '/pages-' || block || '.xml' AS sitemap_url, 'page' AS kind, url AS loc, page_id AS n FROM mapped
  UNION SELECT site || '/index-' || idx || '.xml', 'sitemap', site || '/pages-' || block || '.xml', block FROM mapped
  UNION SELECT site || '/sitemap.xml', 'sitemap', site || '/index-' || idx || '.xml', idx FROM mapped
)"""

HOSTS = f"""{SITE_URLS}, hosts AS (
  SELECT site, host, {HOST_STATE} AS kind FROM (SELECT DISTINCT site, replace(site, 'https://', '') AS host FROM listed)
)"""

HOME_LINKS = r"""home AS (
  SELECT 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site, arg_min(html, page_id) AS html
  FROM pages GROUP BY 1
), hrefs AS (
  SELECT site, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
         generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS place FROM home
), links AS (SELECT site, site || href AS url, place FROM hrefs WHERE starts_with(href, '/'))"""


def declared(spark: SparkSession, sf: str) -> DataFrame:
    found = RB.robots_sitemaps(I.robots(spark, sf), keep_empty=True)
    return found.select(F.concat(F.lit("https://"), "host").alias("site"), "sitemap_url", "pos")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    parsed = D.parse_sitemaps(I.sitemap_docs(spark, sf))
    children = parsed.filter(F.col("kind") == "sitemap")
    return durable(children.select(F.col("sitemap_url").alias("parent"), F.col("loc").alias("child"), "pos"))


def stored_files(rows: DataFrame, key: str, text: str) -> str:
    """The folder in which each text is a file of its own, below ``key=value``."""
    folder = run_folder(rows.sparkSession, key)
    rows.select(key, F.col(text).alias("value")).write.partitionBy(key).text(folder)
    return folder


@query(
    f"""WITH {ENTRIES}
SELECT sitemap_url, kind, row_number() OVER (PARTITION BY sitemap_url ORDER BY n) - 1 AS pos, loc FROM entries"""
)
def read_sitemaps(spark, sf):
    """Entries of sitemaps that were stored as files."""
    return D.parse_sitemaps(S.read_sitemaps(spark, stored_files(I.sitemap_docs(spark, sf), "sitemap_url", "xml")))


@query(ORACLES["robots_rules"])
def read_robots(spark, sf):
    """Rules of robots files that were stored where the fetch succeeded."""
    fetched = I.robots(spark, sf).filter("status_code = 200")
    return RB.robots_rules(S.read_robots(spark, stored_files(fetched, "host", "body")))


@query(
    """SELECT DISTINCT url, CASE WHEN contains(url, '?') THEN 'success' ELSE 'failed' END AS status FROM pages
WHERE contains(url, '?') OR contains(url, '#')"""
)
def read_progress(spark, sf):
    """Checkpoints of the old format, one for every ``PER_CHECKPOINT`` page ids."""
    first = I.pages(spark, sf).groupBy("url").agg(F.min("page_id").alias("page_id"))
    rows = I.progress(spark, sf).distinct().join(first, "url")
    blocks = rows.groupBy(F.floor(F.col("page_id") / PER_CHECKPOINT).alias("block")).agg(
        F.map_from_entries(F.collect_list(F.struct("url", "status"))).alias("completed")
    )
    files = blocks.select("block", F.to_json(F.struct("completed")).alias("body"))
    return S.read_progress(spark, stored_files(files, "block", "body"))


def root_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Every site at its usual place, as if no robots file declared anything."""
    sites = I.sites(spark, sf)
    nothing = sites.select("site", F.col("site").alias("sitemap_url"), F.lit(0).alias("pos")).filter("false")
    return D.seed_sitemaps(sites, nothing)


@query(
    f"""WITH {HOSTS}
SELECT site, CASE WHEN kind = 'org' THEN '' ELSE site || '/sitemap.xml' END AS sitemap_url,
       CASE kind WHEN 'com' THEN 11 WHEN 'org' THEN 6 ELSE 0 END::BIGINT AS pos FROM hosts"""
)
def seed_sitemaps(spark, sf):
    return D.seed_sitemaps(I.sites(spark, sf), declared(spark, sf))


@query(
    f"""WITH {HOSTS}, places(place, n) AS (VALUES ('/sitemap.xml', 0), ('/sitemap_index.xml', 1), ('/wp-sitemap.xml', 2))
SELECT site, site || place AS sitemap_url, CASE WHEN kind = 'com' AND n = 0 THEN 11 ELSE 1000000000 + n END::BIGINT AS pos
FROM hosts CROSS JOIN places UNION ALL SELECT site, '', 6 FROM hosts WHERE kind = 'org'"""
)
def seed_sitemaps_always(spark, sf):
    return D.seed_sitemaps(I.sites(spark, sf), declared(spark, sf), mode="always")


@query(
    f"""WITH {ENTRIES}
SELECT sitemap_url, kind, row_number() OVER (PARTITION BY sitemap_url ORDER BY n) - 1 AS pos, loc FROM entries"""
)
def sitemap_roundtrip(spark, sf):
    return D.parse_sitemaps(I.sitemap_docs(spark, sf))


@query(
    f"""WITH {ENTRIES}
SELECT sitemap_url, count(*) FILTER (kind = 'page') AS n_pages, count(*) FILTER (kind = 'sitemap') AS n_children
FROM entries GROUP BY sitemap_url"""
)
def sitemap_stats(spark, sf):
    docs = I.sitemap_docs(spark, sf)
    return D.sitemap_stats(docs, D.parse_sitemaps(docs))


REACHED = f"""{ENTRIES}, reached AS (
  SELECT DISTINCT site, site || '/sitemap.xml' AS sitemap_url, 0::BIGINT AS level, 0::BIGINT AS a, 0::BIGINT AS b FROM listed
  UNION SELECT site, site || '/index-' || idx || '.xml', 1, idx, 0 FROM mapped
  UNION SELECT site, site || '/pages-' || block || '.xml', 2, idx, block FROM mapped
)"""


@query(f"WITH {REACHED} SELECT site, sitemap_url, level FROM reached")
def sitemap_frontier(spark, sf):
    reached = D.expand_frontier(root_seeds(spark, sf), edges(spark, sf))
    return reached.select("site", "sitemap_url", "level")


@query(
    f"""WITH {REACHED}, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY level, a, b) AS n FROM reached
)
SELECT site, sitemap_url, level FROM ordered WHERE n <= 3"""
)
def sitemap_budget(spark, sf):
    """No site may read more than three sitemaps."""
    reached = D.expand_frontier(root_seeds(spark, sf), edges(spark, sf), max_sitemaps=3)
    return reached.select("site", "sitemap_url", "level")


@query(
    r"""
WITH found AS (
  SELECT page_id, 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site,
         unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
         generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM pages
)
SELECT page_id, site, pos::BIGINT AS pos, site || href AS link FROM found WHERE starts_with(href, '/')"""
)
def extract_links(spark, sf):
    rows = I.pages(spark, sf).select("page_id", I.host_root(F.col("url")).alias("site"), "html")
    return D.extract_links(rows)


@query(
    r"""
WITH found AS (
  SELECT 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site, page_id,
         unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages
)
SELECT site, site || href AS link, min(page_id) AS pos FROM found WHERE starts_with(href, '/') GROUP BY ALL"""
)
def dedup_first_seen(spark, sf):
    rows = I.pages(spark, sf).select("page_id", I.host_root(F.col("url")).alias("site"), "html")
    return D.dedup_first_seen(D.extract_links(rows), ["site", "link"], "page_id").withColumnRenamed("page_id", "pos")


@query(
    f"""WITH {SITE_URLS}
SELECT site AS base_url, count(*) OVER (PARTITION BY site) AS total_urls,
       row_number() OVER (PARTITION BY site ORDER BY url) AS pos, url FROM (SELECT DISTINCT site, url FROM listed)"""
)
def discovery_result(spark, sf):
    return D.discovery_result(I.site_urls(spark, sf))


@query(
    f"""WITH {HOSTS}, {HOME_LINKS}, found AS (
  SELECT l.site, l.url, min(page_id) AS place FROM listed l JOIN hosts h USING (site)
  WHERE l.site NOT LIKE '%.net' AND h.kind <> 'org' GROUP BY ALL
  UNION ALL
  SELECT k.site, k.url, min(k.place) FROM links k JOIN hosts h USING (site)
  WHERE k.site LIKE '%.net' OR h.kind = 'org' GROUP BY ALL
)
SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY place) AS pos FROM found"""
)
def discover_first_seen(spark, sf):
    """Batch run: an empty declaration stops the fallback to the usual place, links step in."""
    found = D.discover(I.sites(spark, sf), I.robots(spark, sf), I.sitemap_docs(spark, sf), I.home_pages(spark, sf))
    return positions(found.withColumnRenamed("pos", "place"), ["site"], ["place"]).select("site", "url", "pos")


@query(
    f"""WITH {HOSTS}, {HOME_LINKS}, found AS (
  SELECT site, url FROM listed WHERE site NOT LIKE '%.net' UNION SELECT site, url FROM links WHERE site LIKE '%.net'
), every AS (
  SELECT site, url FROM found UNION SELECT site, site FROM hosts WHERE site NOT IN (SELECT site FROM found)
)
SELECT site AS base_url, count(*) OVER (PARTITION BY site) AS total_urls,
       row_number() OVER (PARTITION BY site ORDER BY url) AS pos, url FROM every"""
)
def discover_sorted(spark, sf):
    """Discovery for the notebook import: usual places always tried."""
    found = D.discover(
        I.sites(spark, sf), I.robots(spark, sf), I.sitemap_docs(spark, sf), I.home_pages(spark, sf),
        mode="always", include_base=True,
    )
    return D.discovery_result(found)


ATTEMPTS = r"""
log AS (
  SELECT p.url, e.event_type AS kind, e.value < 5 AS small,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt
  FROM events e JOIN pages p ON p.page_id = e.user_id
), attempts AS (
  SELECT url, attempt,
         CASE WHEN kind IN ('error', 'click') THEN 'retry' WHEN kind = 'view' OR (kind = 'purchase' AND small) THEN 'failed'
              ELSE 'success' END AS outcome,
         CASE WHEN kind = 'error' AND small THEN 'timed out' WHEN kind = 'error' THEN 'Retryable status 503'
              WHEN kind = 'click' THEN 'Retryable status 429' WHEN kind = 'view' THEN 'Status 404'
              WHEN kind = 'purchase' AND small THEN 'connection refused' END AS error
  FROM log
), first_final AS (
  SELECT url, min(attempt) FILTER (outcome <> 'retry') AS final, max(attempt) AS last FROM attempts
  WHERE attempt <= 3 GROUP BY url
), resolved AS (
  SELECT a.url, CASE WHEN f.final IS NULL THEN 'failed' ELSE a.outcome END AS status, a.attempt AS attempts,
         coalesce(a.error, '') AS error
  FROM attempts a JOIN first_final f ON a.url = f.url AND a.attempt = coalesce(f.final, f.last)
)"""


@query(f"WITH {ATTEMPTS} SELECT url, attempt, outcome, error FROM attempts")
def classify_attempt(spark, sf):
    return L.classify_attempt(I.attempts(spark, sf)).select("url", "attempt", "outcome", "error")


@query(f"WITH {ATTEMPTS} SELECT url, status, attempts, error FROM resolved")
def resolve_fetch(spark, sf):
    return L.resolve_fetch(I.attempts(spark, sf))


@query(
    f"""WITH {ATTEMPTS}
SELECT url, CASE coalesce(final, last + 1) WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 6 END::BIGINT AS backoff_seconds
FROM first_final"""
)
def backoff_seconds(spark, sf):
    return L.backoff_seconds(I.attempts(spark, sf))
