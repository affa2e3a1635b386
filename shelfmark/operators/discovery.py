"""From robots files, sitemaps and links held as tables to the URLs of each site."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import urls as U
from shelfmark.functions.html import hrefs
from shelfmark.functions.text import or_empty, strip
from shelfmark.model import SITEMAP_XML
from shelfmark.operators.robots import robots_sitemaps
from shelfmark.operators.spread import positions, spread_lookup
from shelfmark.session import durable, stored

# The sitemap namespace and the usual places of a sitemap.
SITEMAP_NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
ROOT_PLACE = "/sitemap.xml"
USUAL_PLACES = ("/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml")
AFTER_DECLARED = 1_000_000_000


def seed_sitemaps(sites: DataFrame, declared: DataFrame, mode: str = "if_none") -> DataFrame:
    """Sitemaps to start from: ``site, sitemap_url, pos``.

    ``if_none`` tries the host root only for sites that declare nothing; ``always`` adds the
    usual places after the declared ones.
    """
    own = declared.select("site", "sitemap_url", F.col("pos").cast("bigint").alias("pos"))
    if mode == "if_none":
        missing = sites.join(own.select("site").distinct(), "site", "left_anti")
        added = missing.select(
            "site",
            F.concat(U.site(F.col("site")), F.lit(ROOT_PLACE)).alias("sitemap_url"),
            F.lit(0).cast("bigint").alias("pos"),
        )
    elif mode == "always":
        places = F.array(*[F.lit(p) for p in USUAL_PLACES])
        added = (
            sites.select("site", F.posexplode(places).alias("i", "place"))
            .select(
                "site",
                F.concat("site", "place").alias("sitemap_url"),
                (F.col("i") + AFTER_DECLARED).cast("bigint").alias("pos"),
            )
            .join(own.select("site", "sitemap_url"), ["site", "sitemap_url"], "left_anti")
        )
    else:
        raise ValueError(f"unknown mode: {mode}")
    return own.unionByName(added)


def parse_sitemaps(docs: DataFrame) -> DataFrame:
    """Entries of sitemap documents: ``sitemap_url, kind, pos, loc``.

    The root tag decides whether the entries are child sitemaps or pages. Documents that are
    not XML, or not of the sitemap namespace, have no entries.
    """
    body = F.regexp_replace(or_empty(F.col("xml")), r"(?s)<!--.*?(?:-->|\z)", "")
    root = F.regexp_extract(body, r"<[A-Za-z_][^>]*>", 0)
    is_index = F.regexp_extract(root, r"^<([^ \t\n\r\f/>]*)", 1).contains("sitemapindex")
    parsed = docs.select(
        "sitemap_url",
        F.when(is_index, "sitemap").otherwise("page").alias("kind"),
        root.contains(SITEMAP_NAMESPACE).alias("known"),
        F.from_xml(F.col("xml"), SITEMAP_XML, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("doc"),
    ).filter("known")
    entries = F.when(F.col("kind") == "sitemap", F.col("doc.sitemap.loc")).otherwise(F.col("doc.url.loc"))
    return (
        parsed.select("sitemap_url", "kind", F.posexplode(entries).alias("pos", "loc"))
        .select("sitemap_url", "kind", F.col("pos").cast("bigint").alias("pos"), strip(F.col("loc")).alias("loc"))
        .filter(F.col("loc") != "")
    )


def sitemap_stats(docs: DataFrame, parsed: DataFrame) -> DataFrame:
    """Pages and child sitemaps per document, also for those without any."""
    counts = parsed.groupBy("sitemap_url").agg(
        F.count_if(F.col("kind") == "page").alias("n_pages"),
        F.count_if(F.col("kind") == "sitemap").alias("n_children"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        docs.select("sitemap_url")
        .join(counts, "sitemap_url", "left")
        .select(
            "sitemap_url",
            F.coalesce("n_pages", zero).alias("n_pages"),
            F.coalesce("n_children", zero).alias("n_children"),
        )
    )


def _order_key(pos) -> F.Column:
    """Text of fixed width in the order of any BIGINT, negative ones included."""
    return F.lpad(F.hex(pos.cast("bigint").bitwiseXOR(F.lit(-(2**63)))), 16, "0")


def expand_frontier(seeds: DataFrame, edges: DataFrame, max_sitemaps: int | None = None) -> DataFrame:
    """All sitemaps reachable from the seeds, each once: ``site, sitemap_url, level, order_key``.

    ``edges`` has ``parent, child, pos`` and is read in each round: pass a stored table. A round
    joins the newest level with the edges and drops what was visited before, so cycles end.
    ``(level, order_key)`` is breadth-first order. With ``max_sitemaps`` a site stops at exactly that many sitemaps. Levels are written
    to the shared folder; a lost executor costs a task, not the rounds before it.
    """
    level = (
        seeds.groupBy("site", "sitemap_url")
        .agg(F.min(_order_key(F.col("pos"))).alias("order_key"))
        .withColumn("level", F.lit(0).cast("bigint"))
    )
    visited: list[DataFrame] = []
    while True:
        if max_sitemaps is not None:
            level = _within_budget(level, visited, max_sitemaps)
        level = durable(level.select("site", "sitemap_url", "level", "order_key"))
        if level.isEmpty():
            break
        visited.append(level)
        seen = reduce(DataFrame.unionByName, visited).select("site", "sitemap_url")
        parents = level.withColumnRenamed("sitemap_url", "parent")
        level = (
            spread_lookup(edges.select("parent", "child", "pos"), parents, ["parent"], "inner", ["child"])
            .groupBy("site", F.col("child").alias("sitemap_url"))
            .agg(
                F.min(F.concat_ws(".", "order_key", _order_key(F.col("pos")))).alias("order_key"),
                (F.min("level") + 1).alias("level"),
            )
            .join(seen, ["site", "sitemap_url"], "left_anti")
        )
    return reduce(DataFrame.unionByName, visited) if visited else level


def _within_budget(level: DataFrame, visited: list[DataFrame], budget: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("site").orderBy("order_key"))
    # The constant bound lets Spark drop surplus rows before the shuffle.
    ranked = level.withColumn("rank", rank).filter(F.col("rank") <= budget)
    if not visited:
        return ranked
    used = reduce(DataFrame.unionByName, visited).groupBy("site").agg(F.count("*").alias("used"))
    return ranked.join(used, "site", "left").filter(F.col("rank") <= budget - F.coalesce("used", F.lit(0)))


def frontier_pages(visited: DataFrame, parsed: DataFrame) -> DataFrame:
    """Pages listed by the visited sitemaps, in breadth-first order: ``site, url, pos``."""
    pages = parsed.filter(F.col("kind") == "page")
    place = F.concat_ws(
        "/", _order_key(F.col("level")), "order_key", _order_key(F.col("pos"))
    )
    placed = spread_lookup(pages, visited, ["sitemap_url"], "inner", ["pos"])
    return placed.select("site", F.col("loc").alias("url"), place.alias("pos"))


def extract_links(pages: DataFrame, strict: bool = True) -> DataFrame:
    """Internal links of ``pages(site, html)``: ``site, pos, link``.

    ``/x`` is appended to the site address, path and all; an address that begins with it is
    kept; everything else goes. ``strict`` also asks for the end of the host there, so that
    ``https://a.org`` does not claim ``https://a.organic``.
    """
    found = pages.select("*", F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))
    base, href = F.col("site"), F.col("href")
    inside = href.startswith(base)
    if strict:
        after = F.substring(href, F.length(base) + 1, F.lit(1))
        inside = inside & after.isin("", "/", "?", "#")
    target = F.when(href.startswith("/") & ~href.startswith("//"), F.concat(base, href)).when(inside, href)
    kept = [c for c in pages.columns if c != "html"]
    return (
        found.select(*kept, F.col("pos").cast("bigint").alias("pos"), target.alias("link"))
        .filter(F.col("link").isNotNull())
    )


def dedup_first_seen(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """One row per key with its first position."""
    return df.groupBy(*keys).agg(F.min(pos).alias(pos))


def discovery_result(urls: DataFrame) -> DataFrame:
    """Distinct URLs of each site in code point order: ``base_url, total_urls, pos, url``.

    Rows instead of one array per site, so that a site may be of any size.
    """
    distinct = urls.select(F.col("site").alias("base_url"), "url").distinct()
    placed = positions(distinct, ["base_url"], ["url"])
    # The last position is the total; it comes from the stored rows, not from the URLs again.
    totals = placed.groupBy("base_url").agg(F.max("pos").alias("total_urls"))
    return spread_lookup(placed, totals, ["base_url"], spread_by=["url"]).select(
        "base_url", "total_urls", "pos", "url"
    )


def discover(
    sites: DataFrame,
    robots: DataFrame,
    sitemap_docs: DataFrame,
    home_pages: DataFrame,
    mode: str = "if_none",
    max_sitemaps: int | None = None,
    include_base: bool = False,
    strict: bool = True,
) -> DataFrame:
    """URLs of every site in first-seen order: ``site, url, pos``.

    Sitemaps come first; links of the home page only for sites whose sitemaps list nothing;
    the site address itself, if asked for, only where there are still no URLs.
    """
    declared = robots_sitemaps(robots, keep_empty=mode == "if_none")
    by_host = sites.withColumn("host", U.netloc(F.col("site")))
    own = by_host.join(declared, "host").select("site", "sitemap_url", "pos")
    parsed = stored(parse_sitemaps(sitemap_docs), "sitemap-entries")
    # The few entries of index files lie apart, so that no round reads the pages again.
    edges = durable(
        parsed.filter(F.col("kind") == "sitemap").select(
            F.col("sitemap_url").alias("parent"), F.col("loc").alias("child"), "pos"
        )
    )
    visited = expand_frontier(seed_sitemaps(sites, own, mode), edges, max_sitemaps)
    # Read three times: which sites have none, the rows, and which sites still have none.
    listed = stored(frontier_pages(visited, parsed), "listed")
    lacking = sites.join(listed.select("site").distinct(), "site", "left_anti")
    links = extract_links(lacking.join(home_pages, "site"), strict).select(
        "site", F.col("link").alias("url"), _order_key(F.col("pos")).alias("pos")
    )
    found = listed.unionByName(links)
    if include_base:
        bare = sites.join(found.select("site").distinct(), "site", "left_anti")
        found = found.unionByName(bare.select("site", F.col("site").alias("url"), F.lit("0").alias("pos")))
    return dedup_first_seen(found, ["site", "url"])
