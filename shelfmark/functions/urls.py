"""URL columns: parts, seeds, prefixes, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import literal, strip

# Scheme, authority, path, query and fragment as in RFC 3986, appendix B.
URL_PATTERN = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
# The form of a language prefix and the longest slug.
LANG_PREFIX = r"^/([a-z]{2})(?:[_-][a-zA-Z]{2,4})?/"
SLUG_LENGTH = 200


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_PATTERN, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, URL_PATTERN, 2)


def path(url: Column) -> Column:
    """The path without the ``;parameters`` of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, URL_PATTERN, 3), r";[^/]*\z", "")


def site(url: Column) -> Column:
    """``scheme://netloc``, the root that a relative link or robots file belongs to."""
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def request_target(url: Column) -> Column:
    """Everything after the authority; ``/`` when there is nothing."""
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", "")
    return F.when(F.length(rest) == 0, F.lit("/")).otherwise(rest)


def url_parts(url: Column) -> Column:
    return F.struct(scheme(url).alias("scheme"), netloc(url).alias("netloc"), path(url).alias("path"))


def with_scheme(url: Column) -> Column:
    """Trim, and add ``https://`` where no http scheme is given."""
    trimmed = strip(url)
    return F.when(trimmed.rlike(r"^https?://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))


def normalize_seed(url: Column) -> Column:
    """A full address without closing slashes."""
    return F.regexp_replace(with_scheme(url), r"/+\z", "")


def same_domain(url: Column, base: Column | str) -> Column:
    """Exact equality of authorities: port, user part and ``www.`` all matter."""
    return netloc(url) == netloc(literal(base))


def lang_prefix(url_path: Column) -> Column:
    """Primary language of a prefix such as ``/en/`` or ``/pt-BR/``; empty without one."""
    return F.regexp_extract(url_path, LANG_PREFIX, 1)


def lang_excluded(url_path: Column, lang: Column | str) -> Column:
    prefix = lang_prefix(url_path)
    return (prefix != "") & (prefix != literal(lang))


def path_contains(url_path: Column, needle: Column | str) -> Column:
    return url_path.contains(literal(needle))


def url_slug(url: Column) -> Column:
    """A file name of letters, digits, ``_`` and ``-`` from authority and path."""
    slug = F.regexp_replace(F.concat(netloc(url), path(url)), r"^/+|/+\z", "")
    slug = F.regexp_replace(slug, r"[^\p{L}\p{N}_-]", "_")
    slug = F.regexp_replace(slug, r"_+", "_")
    slug = F.regexp_replace(slug, r"^_+|_+\z", "")
    return F.substring(slug, 1, SLUG_LENGTH)
