"""URL columns, filters, selections and resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.catalog import inputs as I
from shelfmark.catalog.registry import query
from shelfmark.functions import urls as U
from shelfmark.model import CrawlConfig
from shelfmark.operators import filters as X
from shelfmark.operators import output as O
from shelfmark.operators import report as R
from shelfmark.operators import robots as RB

PARTS = r"""
parts AS (
  SELECT page_id, url,
         regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
         regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS netloc,
         regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
)"""

DOMAIN = r"regexp_extract(netloc, '([^.]+\.example\.[a-z]+)$', 1)"
LANG = r"regexp_extract(path, '^/([a-z][a-z])([_-][a-zA-Z]{2,4})?/', 1)"

# What the robots files of the inputs say, written out rule by rule. `target` is everything
# after the host.
HOST_STATE = r"""
CASE WHEN host LIKE '%spam-farm%' THEN 'missing'
     WHEN host LIKE 'www.%.org' THEN 'deny'
     WHEN host LIKE 'blog.%.org' THEN 'allow'
     WHEN host LIKE 'm.%.org' THEN 'missing'
     WHEN host LIKE '%.com' THEN 'com'
     WHEN host LIKE '%.net' THEN 'net'
     ELSE 'org' END"""


def robots_case(on_missing: str) -> str:
    return rf"""
CASE {HOST_STATE}
  WHEN 'missing' THEN {on_missing}
  WHEN 'deny' THEN false
  WHEN 'allow' THEN true
  WHEN 'com' THEN CASE WHEN starts_with(target, '/en/1') THEN false
                       WHEN starts_with(target, '/en') THEN true
                       WHEN starts_with(target, '/e') THEN false
                       WHEN starts_with(target, '/fr') THEN false
                       ELSE true END
  WHEN 'net' THEN true
  WHEN 'org' THEN CASE WHEN starts_with(target, '/es/') THEN true
                       WHEN starts_with(target, '/e') THEN false
                       ELSE true END
END"""


CLASSIFIED = rf"""
{PARTS},
targets AS (
  SELECT *, netloc AS host, regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS target FROM parts
),
verdicts AS (
  SELECT *, {robots_case('true')} AS allowed FROM targets
),
classified AS (
  SELECT url, 'https://' || {DOMAIN} AS base_url,
         CASE WHEN netloc <> {DOMAIN} THEN 'domain'
              WHEN NOT allowed THEN 'robots'
              WHEN {LANG} <> '' AND {LANG} <> 'en' THEN 'lang'
              WHEN NOT contains(path, '.html') THEN 'path' END AS drop_reason
  FROM verdicts
)"""

PROGRESS = r"""
progress AS (
  SELECT url, CASE WHEN contains(url, '?') THEN 'success' ELSE 'failed' END AS status
  FROM pages WHERE contains(url, '?') OR contains(url, '#')
)"""

IN_ENGLISH = rf"""
{PARTS},
kept AS (SELECT url FROM parts WHERE {LANG} = 'en')"""

SITE_URLS = r"""
listed AS (
  SELECT 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site, url, page_id FROM pages
)"""

CONFIG = CrawlConfig(base_url="", lang_filter="en", path_filter=".html")


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return X.classify_urls(I.seed_urls(spark, sf), CONFIG, I.robots(spark, sf))


def kept_english(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.site_urls(spark, sf).select("url", F.concat(U.site(F.col("url"))).alias("base_url"))
    return X.kept_urls(X.classify_urls(rows, CrawlConfig(base_url="", lang_filter="en"))).select("url")


@query(f"WITH {PARTS} SELECT url, scheme, netloc, path FROM parts")
def url_parts(spark, sf):
    return I.pages(spark, sf).select("url", U.url_parts(F.col("url")).alias("p")).select("url", "p.*")


@query(
    r"""
WITH raw AS (
  SELECT page_id, CASE WHEN url LIKE 'https:%' THEN '  ' || regexp_replace(url, '^https://', '') || '// '
                       ELSE url || chr(160) END AS seed FROM pages
), trimmed AS (
  SELECT page_id, seed, trim(replace(seed, chr(160), ' ')) AS t FROM raw
)
SELECT page_id, rtrim(CASE WHEN t LIKE 'http://%' THEN t ELSE 'https://' || t END, '/') AS base_url FROM trimmed"""
)
def normalize_seed(spark, sf):
    """Addresses without scheme, with white space and closing slashes."""
    bare = F.concat(F.lit("  "), F.regexp_replace("url", "^https://", ""), F.lit("// "))
    seed = F.when(F.col("url").startswith("https:"), bare).otherwise(F.concat("url", F.lit("\u00a0")))
    return I.pages(spark, sf).select("page_id", U.normalize_seed(seed).alias("base_url"))


@query(f"WITH {PARTS} SELECT url, 'https://' || {DOMAIN} AS base_url, netloc = {DOMAIN} AS same FROM parts")
def same_domain(spark, sf):
    same = U.same_domain(F.col("url"), F.col("base_url"))
    return I.seed_urls(spark, sf).select("url", "base_url", same.alias("same"))


@query(f"WITH {PARTS} SELECT url, {LANG} AS prefix, {LANG} NOT IN ('', 'en') AS excluded FROM parts")
def lang_filter(spark, sf):
    path = U.path(F.col("url"))
    return I.pages(spark, sf).select(
        "url", U.lang_prefix(path).alias("prefix"), U.lang_excluded(path, "en").alias("excluded")
    )


@query(f"WITH {PARTS} SELECT url, path FROM parts WHERE contains(path, '/en/4')")
def path_filter(spark, sf):
    path = U.path(F.col("url"))
    return I.pages(spark, sf).filter(U.path_contains(path, "/en/4")).select("url", path.alias("path"))


ROBOTS_SQL = r"""
WITH targets AS (
  SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
         regexp_replace(url, '^[a-z]+://[^/?#]*', '') AS target FROM pages
)
SELECT url, {verdict} AS allowed FROM targets"""


@query(ROBOTS_SQL.format(verdict=robots_case("true")))
def robots_allowed(spark, sf):
    return RB.robots_allowed(I.pages(spark, sf).select("url"), I.robots(spark, sf), "shelfmark/1.0")


@query(ROBOTS_SQL.format(verdict=robots_case("false")))
def robots_allowed_strict(spark, sf):
    """The same where hosts without readable rules are off limits."""
    return RB.robots_allowed(I.pages(spark, sf).select("url"), I.robots(spark, sf), "shelfmark/1.0", "deny")


@query(
    rf"""
WITH hosts AS (
  SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages
), kinds AS (SELECT host, {HOST_STATE} AS kind FROM hosts),
rules(kind, group_no, agent, rule_no, allow, prefix) AS (VALUES
  ('com', 1, '*', 2, false, '/de/'), ('com', 1, '*', 3, true, '/'),
  ('com', 2, 'otherbot', 7, false, '/en/1'), ('com', 2, 'otherbot', 8, true, '/en'),
  ('com', 2, 'otherbot', 9, false, '/e'), ('com', 2, 'otherbot', 10, false, '/fr'),
  ('com', 2, 'shelfmark', 7, false, '/en/1'), ('com', 2, 'shelfmark', 8, true, '/en'),
  ('com', 2, 'shelfmark', 9, false, '/e'), ('com', 2, 'shelfmark', 10, false, '/fr'),
  ('net', 1, '*', 3, true, ''), ('net', 1, '*', 4, false, '/es/'),
  ('org', 1, 'otherbot', 1, false, '/'),
  ('org', 2, '*', 4, true, '/es/'), ('org', 2, '*', 5, false, '/e'))
SELECT host, group_no::BIGINT AS group_no, agent, rule_no::BIGINT AS rule_no, allow, prefix
FROM kinds JOIN rules USING (kind)"""
)
def robots_rules(spark, sf):
    return RB.robots_rules(I.robots(spark, sf))


@query(
    rf"""
WITH hosts AS (
  SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages
), kinds AS (SELECT host, {HOST_STATE} AS kind FROM hosts)
SELECT host, 11::BIGINT AS pos, 'https://' || host || '/sitemap.xml' AS sitemap_url FROM kinds WHERE kind = 'com'
UNION ALL SELECT host, 6, '' FROM kinds WHERE kind = 'org'"""
)
def robots_sitemaps(spark, sf):
    return RB.robots_sitemaps(I.robots(spark, sf), keep_empty=True)


@query(f"WITH {CLASSIFIED} SELECT url, base_url, drop_reason FROM classified")
def classify_urls(spark, sf):
    return classified(spark, sf)


@query(
    f"""WITH {CLASSIFIED}
SELECT base_url, count(*) FILTER (drop_reason = 'domain') AS n_domain,
       count(*) FILTER (drop_reason = 'robots') AS n_robots, count(*) FILTER (drop_reason = 'lang') AS n_lang,
       count(*) FILTER (drop_reason = 'path') AS n_path, count(*) FILTER (drop_reason IS NULL) AS n_remaining
FROM classified GROUP BY base_url"""
)
def filter_stats(spark, sf):
    return X.filter_stats(classified(spark, sf), ["base_url"])


@query(f"WITH {IN_ENGLISH}, {PROGRESS} SELECT url FROM kept WHERE url NOT IN (SELECT url FROM progress)")
def pending_urls(spark, sf):
    return X.pending_urls(kept_english(spark, sf), I.progress(spark, sf))


@query(
    f"""WITH {IN_ENGLISH}, {PROGRESS}
SELECT url FROM kept WHERE url NOT IN (SELECT url FROM progress WHERE status = 'success')"""
)
def pending_with_retries(spark, sf):
    return X.pending_urls(kept_english(spark, sf), I.progress(spark, sf), retry_failed=True)


@query(f"WITH {IN_ENGLISH}, {PROGRESS} SELECT count(*) AS skipped FROM kept WHERE url IN (SELECT url FROM progress)")
def skipped_count(spark, sf):
    return X.skipped_count(kept_english(spark, sf), I.progress(spark, sf))


@query(
    rf"""WITH {PROGRESS}, later AS (
  SELECT url, CASE WHEN contains(url, 'page=') THEN 'failed' ELSE 'success' END AS status
  FROM pages WHERE contains(url, '/en/')
)
SELECT coalesce(l.url, p.url) AS url, coalesce(l.status, p.status) AS status
FROM progress p FULL JOIN later l ON l.url = p.url"""
)
def merge_progress(spark, sf):
    return O.merge_progress(I.progress(spark, sf), I.later_progress(spark, sf))


@query(f"WITH {SITE_URLS} SELECT site, url FROM listed WHERE contains(lower(url), 'blog.th')")
def search_urls(spark, sf):
    return X.search_urls(I.site_urls(spark, sf), "  BLOG.Th ").select("site", "url")


@query(
    f"""WITH {SITE_URLS}
SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY url) <= 10 AS selected FROM listed"""
)
def select_top_n(spark, sf):
    return X.select_preset(I.site_urls(spark, sf).select("site", "url"), X.PRESET_SIZES[0])


SELECT_MATCHING = f"""{SITE_URLS}, ranked AS (
  SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY url) <= 10 AS selected,
         contains(lower(url), '/fr/') AS match,
         bool_or(contains(lower(url), '/fr/')) OVER (PARTITION BY site) AS hit FROM listed
), selection AS (SELECT site, url, CASE WHEN hit THEN match ELSE selected END AS selected FROM ranked)"""


def matching_selection(spark: SparkSession, sf: str) -> DataFrame:
    preset = X.select_preset(I.site_urls(spark, sf).select("site", "url"), X.PRESET_SIZES[0])
    return X.select_matching(preset, "/fr/")


@query(f"WITH {SELECT_MATCHING} SELECT site, url, selected FROM selection")
def select_matching(spark, sf):
    return matching_selection(spark, sf)


@query(
    f"""WITH {SELECT_MATCHING}
SELECT site, count(*) AS n_listed, count(*) FILTER (selected) AS n_selected,
       count(*) FILTER (selected) > 0 AS can_import FROM selection GROUP BY site"""
)
def selection_summary(spark, sf):
    return X.selection_summary(matching_selection(spark, sf))


@query(f"WITH {SELECT_MATCHING} SELECT site, url FROM selection WHERE selected")
def import_list(spark, sf):
    return X.import_list(matching_selection(spark, sf))


@query(
    f"""WITH {SITE_URLS}, placed AS (
  SELECT site, row_number() OVER (PARTITION BY site ORDER BY url) AS pos, count(*) OVER (PARTITION BY site) AS total
  FROM listed
)
SELECT site, ((pos + 5) // 6)::BIGINT AS batch_no, count(*) AS n, max(pos) AS completed, any_value(total) AS total,
       floor(max(pos) / any_value(total) * 100 + 0.5)::BIGINT AS percent
FROM placed GROUP BY site, (pos + 5) // 6"""
)
def batch_progress(spark, sf):
    return R.batch_progress(I.site_urls(spark, sf))


SLUGS = rf"""{PARTS}, slugs AS (
  SELECT url, substr(trim(regexp_replace(regexp_replace(netloc || rtrim(path, '/'), '[^\p{{L}}\p{{N}}_-]', '_', 'g'),
         '_+', '_', 'g'), '_'), 1, 200) AS slug FROM parts
)"""


@query(f"WITH {SLUGS} SELECT url, slug FROM slugs")
def url_slug(spark, sf):
    return I.pages(spark, sf).select("url", U.url_slug(F.col("url")).alias("slug"))


@query(
    f"""WITH {SLUGS}
SELECT slug, count(*) AS n, min(url) AS first_url, max(url) AS last_url FROM slugs GROUP BY slug"""
)
def slug_groups(spark, sf):
    return O.slug_groups(I.pages(spark, sf))


@query(
    f"""WITH {PARTS}, slugs AS (SELECT netloc AS slug, netloc, url FROM parts)
SELECT slug, n, url FROM (
  SELECT replace(slug, '.', '_') AS slug, count(*) OVER (PARTITION BY slug) AS n, 'https://' || netloc || '?' || url AS url
  FROM slugs) WHERE n > 1"""
)
def slug_members(spark, sf):
    """Addresses that only differ in their query share the slug of their host."""
    queried = F.concat(I.host_root(F.col("url")), F.lit("?"), "url")
    return O.slug_members(I.pages(spark, sf).select(queried.alias("url")))
