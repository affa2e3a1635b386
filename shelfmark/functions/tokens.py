"""Lossless tokens: a word with the white space before it; closing white space is its own token.

Quantifiers are possessive: they match in a loop, without backtracking or recursion, so the
patterns hold for texts and windows of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import literal, once

TOKEN = r"(?:[ \t\n\r\f]*+[^ \t\n\r\f]++|[ \t\n\r\f]++)"
WINDOW = 500
RUN = 32


def token_count(text: Column) -> Column:
    """Tokens of a text, counted in runs so that few strings are made."""

    def count(runs: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        alone = F.size(F.regexp_extract_all(last, F.lit(TOKEN), F.lit(0)))
        return F.when(F.size(runs) == 0, 0).otherwise((F.size(runs) - 1) * RUN + alone)

    return once(windows(text, RUN), count).cast("bigint")


def _run(size: Column | int) -> Column:
    """Pattern of up to ``size`` tokens in a row."""
    return F.concat(F.lit(TOKEN + "{1,"), literal(size).cast("string"), F.lit("}+"))


def first_tokens(text: Column, count: Column | int) -> Column:
    """The first ``count`` tokens of a text as they stand."""
    return F.call_function("regexp_extract", text, _run(count), F.lit(0))


def windows(text: Column, size: int = WINDOW) -> Column:
    """The text cut after every ``size`` tokens; joined again the pieces give the text."""
    return F.regexp_extract_all(text, F.lit(f"{TOKEN}{{1,{size}}}+"), F.lit(0))


def cut(text: Column, start: Column, size: int = WINDOW) -> Column:
    """A text whose first token is number ``start``, cut where a multiple of ``size`` begins."""
    head = first_tokens(text, size - F.pmod(start, F.lit(size)))

    def split(parts: Column) -> Column:
        rest = F.substring(parts["text"], F.length(parts["head"]) + 1, F.length(parts["text"]))
        return F.concat(F.array(parts["head"]), windows(rest, size))

    return once(F.struct(text.alias("text"), head.alias("head")), split)


class Codec(Protocol):
    """The tokenizer of a model."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, tokens: list[int]) -> str: ...


def codec_count(text: Column, load: Callable[[], Codec]) -> Column:
    """Tokens of a text by a codec that each task loads for itself."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = load()
        for texts in batches:
            yield texts.map(lambda t: len(codec.encode(t)))

    return count(text)


def codec_cut(text: Column, start: Column, load: Callable[[], Codec], size: int = WINDOW) -> Column:
    """``cut`` by the tokens of a codec."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        codec = load()

        def pieces(text: str, begin: int) -> list[str]:
            tokens = codec.encode(text)
            borders = [0, *range(size - begin % size, len(tokens), size), len(tokens)]
            return [codec.decode(tokens[a:b]) for a, b in zip(borders, borders[1:])]

        for texts, starts in batches:
            yield pd.Series([pieces(t, int(b)) for t, b in zip(texts, starts)], dtype=object)

    return split(text, start)
