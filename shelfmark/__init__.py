"""Web pages to knowledge base on Spark: discovery, extraction, storage, retrieval."""

from shelfmark.model import CrawlConfig

__all__ = ["CrawlConfig"]
