"""Awkward inputs that every corpus operator must take."""

from __future__ import annotations

from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that operators use inside, as extra columns of the input.
CLASHES = (
    "row name key kept level pos place chosen_id chosen_key tkey norm tokens probability ids n_tokens bytes lang_pred score "
    "host words lines set_id bands n topic weight shard slot number gone of_id of_key value file start _guess"
).split()

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
PROSE = "the quick brown fox jumps over the lazy dog and runs away from the angry bear in the old forest"
AWKWARD = [
    (1, PROSE, "en", "a", 10),
    (2, PROSE.replace(" ", "\n\t"), "en", "a", 10),
    (2, PROSE, "en", "a", 10),
    (2, PROSE, "en", "a", 10),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \n\t ", "en", None, 3),
    (None, PROSE + " today", "en", "b", 1),
    (None, None, None, None, None),
    (7, LONG, "xx", "b", len(LONG)),
    (8, LONG, None, "b", len(LONG)),
    (9, "word", "en", "c", 4),
    (10, "été \U0001f600\U0001f600 naïve 你好世界 \u0000 x", "fr", "c", 4),
    (11, "12 34 56 !!", "en", "c", 4),
    (12, "a b c d", "en", "c", 4),
    (13, "a b c d", "en", "d", 4),
]


def docs_of(spark, rows=AWKWARD, clashes=True):
    df = spark.createDataFrame(rows, DOCS)
    if clashes:
        df = df.withColumns({c: F.lit(f"extra {c}") for c in CLASHES})
    return df


def empty_of(df):
    return df.filter("false")


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
