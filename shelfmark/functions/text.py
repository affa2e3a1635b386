"""Text helpers on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space in Unicode text.
SPACE = (
    r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


NO_SPACE = SPACE.replace("[", "[^", 1)


def strip(col: Column) -> Column:
    """Remove white space of any kind at both ends; SQL ``trim`` only knows the blank."""
    return F.regexp_replace(col, rf"^{SPACE}+|{SPACE}+\z", "")


def is_blank(col: Column) -> Column:
    """Whether nothing but white space is there; a text is read up to its first other character."""
    return ~F.coalesce(col, F.lit("")).rlike(NO_SPACE)


def or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def literal(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def once(col: Column, use: Callable[[Column], Column]) -> Column:
    """``use(col)`` with ``col`` computed a single time however often ``use`` mentions it.

    Long chains of regular expressions double their cost with every second mention that
    Spark does not recognise as a common subexpression.
    """
    return F.get(F.transform(F.array(col), use), F.lit(0))


def first_nonempty(*cols: Column) -> Column:
    """The first text that is neither NULL nor empty, else the empty string."""
    return F.coalesce(F.get(F.filter(F.array(*cols), lambda c: c != ""), F.lit(0)), F.lit(""))


def percent_decode(col: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone and keeps text it cannot decode."""
    return once(col, lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c))
