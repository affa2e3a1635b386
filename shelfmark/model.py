"""Schemas of the tables and the parameters of a crawl."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


TEXT, LONG, TIME = T.StringType(), T.LongType(), T.TimestampType()

PAGES = _struct(("page_id", LONG), ("url", TEXT), ("html", TEXT))
PAGE_RESULTS = _struct(
    ("url", TEXT), ("title", TEXT), ("language", TEXT), ("content", TEXT),
    ("scraped_at", TIME), ("status", TEXT), ("error", TEXT),
)
NOTEBOOKS = _struct(("id", LONG), ("name", TEXT), ("created_at", TIME))
SOURCES = _struct(
    ("id", LONG), ("notebook_id", LONG), ("url", TEXT), ("title", TEXT),
    ("content", TEXT), ("status", TEXT), ("last_updated", TIME),
)
CHAT_LOGS = _struct(
    ("id", LONG), ("notebook_id", LONG), ("query", TEXT), ("answer", TEXT), ("created_at", TIME),
)
PROGRESS_FILE = _struct(("completed", T.MapType(TEXT, TEXT)))
SITEMAP_XML = "struct<sitemap:array<struct<loc:string>>,url:array<struct<loc:string>>>"

KB_TABLES = {"notebooks": NOTEBOOKS, "sources": SOURCES, "chat_logs": CHAT_LOGS}
#: What the tables are bucketed by.
KB_KEYS = {"notebooks": "id", "sources": "notebook_id", "chat_logs": "notebook_id"}

SUCCESS, FAILED = "success", "failed"


@dataclass(frozen=True)
class CrawlConfig:
    """What one run keeps. An empty filter is off."""

    base_url: str
    lang_filter: str | None = None
    path_filter: str | None = None
    agent: str = "shelfmark/1.0"
    robots_on_missing: str = "allow"
