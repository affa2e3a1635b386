"""Removal of repeated runs of lines by winnowing.

Every line with a word has a hash. A gram is the shortest run of lines from a line on that has ``GRAM`` lines or
``LONG_WORDS`` words, hashed as a whole to 128 bits. In each window of ``WINDOW`` consecutive grams the one with the
smallest hash (the rightmost of equal ones) is selected; grams of ``LONG_WORDS`` words are selected always. Only
selected grams become fingerprints, once for each place. So every repeated run of ``GRAM + WINDOW - 1`` lines, and
every one that holds a gram of ``LONG_WORDS`` words, shares a fingerprint with its earlier occurrence. A whole
document with fewer lines and words is one gram of its own kind.

A fingerprint is joined with its first place in document order. As that place may lie in a shorter run that hides a
longer one, it is also joined with the first place that has the line before it, too, and with the first that has the
line after it. From there the match is extended line by line both ways over what lies between two fingerprints, so
a fingerprint carries the hashes of a few lines on its sides and no document is compared as a whole. Later runs are
deleted; a deleted line always has an equal one before it, so the first occurrence of a line stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import WORD, text_key, text_of
from shelfmark.session import stored

GRAM = 3
WINDOW = 2
LONG_WORDS = 50
#: Lines at each side of a fingerprint to which its match can be extended.
SIDE = max(WINDOW, GRAM) - 1


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def hashed_lines(docs: DataFrame, gram: int, long_words: int) -> DataFrame:
    """``doc_id, tkey, at, hashes, others, reach, long``: places and two hashes of the lines with a word, for each line
    the number of lines of its gram (0 if there is none), and whether that has ``long_words`` words."""
    lines = F.filter(
        F.transform(
            lines_of(F.col("text")),
            lambda line, i: F.struct(
                i.alias("at"), F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("o"),
                F.regexp_count(line, F.lit(WORD)).alias("n"),
            ),
        ),
        lambda x: x["n"] > 0,
    )
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("tkey", F.xxhash64("text"))
    found = texts.select("doc_id", "tkey", lines.alias("lines"))

    def reach(i: Column) -> Column:
        words, found = F.lit(0), F.lit(0)
        for k in range(1, gram + 1):
            words = words + F.get(F.col("lines"), i + (k - 1))["n"]
            found = F.when((found == 0) & (words >= long_words), k).otherwise(found)
        # Below zero where the gram has its lines, not its words.
        return F.when((found == 0) & (i + gram <= F.size("lines")), -gram).otherwise(found)

    words = F.aggregate("lines", F.lit(0).cast("bigint"), lambda n, x: n + x["n"])
    told = found.select(
        "doc_id", "tkey", F.col("lines.at").alias("at"), F.col("lines.h").alias("hashes"), F.col("lines.o").alias("others"),
        F.transform("lines", lambda x, i: reach(i)).alias("reach"), words.alias("words"),
    )
    return stored(
        told.select(
            "doc_id", "tkey", "at", "hashes", "others", F.transform("reach", F.abs).alias("reach"),
            F.transform("reach", lambda k: k > 0).alias("long"), "words",
        ).dropDuplicates(["doc_id", "tkey"]),
        "line-hashes",
    )


def fingerprints(lines: DataFrame, gram: int, window: int, side: int = SIDE) -> DataFrame:
    """``doc_id, tkey, pos, size, a, b, before, after, at``: the selected grams with two hashes, the hashes of the
    lines on both sides, the nearest first, and the places of all these lines in the text."""
    def run(column: str, start: Column, size: Column) -> Column:
        return F.slice(column, start + 1, size)

    grams = F.transform(
        F.filter(F.transform("reach", lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda x: x["k"] > 0),
        lambda x: F.struct(
            F.xxhash64(run("hashes", x["i"], x["k"])).alias("a"), (-x["i"]).alias("back"), x["k"].alias("k"),
            F.xxhash64(run("others", x["i"], x["k"])).alias("b"), F.get("long", x["i"]).alias("long"),
        ),
    )
    # Grams of consecutive lines have consecutive places, except that the last lines of a text may have none.
    starts = F.when(F.size("grams") >= window, F.sequence(F.lit(1), F.size("grams") - window + 1)).otherwise(
        F.array().cast("array<int>")
    )
    minima = F.transform("starts", lambda s: F.array_min(F.slice("grams", s, F.lit(window))))
    chosen = F.array_distinct(F.concat(minima, F.filter("grams", lambda g: g["long"])))
    # A document too short for a window is one gram; the zero keeps it apart from the same lines in longer ones.
    whole = F.struct(
        F.xxhash64(F.lit(0), F.col("hashes")).alias("a"), F.lit(0).alias("back"), F.size("hashes").alias("k"),
        F.xxhash64(F.lit(0), F.col("others")).alias("b"), F.lit(False).alias("long"),
    )
    brief = (F.size("hashes") < gram + window - 1) & (F.col("words") >= gram)
    rows = lines.withColumn("grams", grams).withColumn("starts", starts).withColumn("chosen", chosen)
    picked = F.when((F.size("chosen") == 0) & brief, F.array(whole)).otherwise(F.col("chosen"))
    told = rows.select("doc_id", "tkey", "hashes", "at", F.explode(picked).alias("g")).withColumn("pos", -F.col("g.back"))
    lead = F.least(F.col("pos"), F.lit(side))
    stop = F.col("pos") + F.col("g.k")
    trail = F.least(F.size("hashes") - stop, F.lit(side))
    return told.select(
        "doc_id", "tkey", "pos", F.col("g.k").alias("size"), "g.a", "g.b",
        F.reverse(run("hashes", F.col("pos") - lead, lead)).alias("before"), run("hashes", stop, trail).alias("after"),
        run("at", F.col("pos") - lead, lead + F.col("g.k") + trail).alias("at"),
    )


def keyed(prints: DataFrame) -> DataFrame:
    """Each fingerprint under its own key, and under those with the line before and the line after it."""
    near = lambda kind, line: F.struct(F.lit(kind).alias("kind"), line.alias("line"))
    keys = F.filter(
        F.array(near(0, F.lit(0).cast("bigint")), near(1, F.get("before", F.lit(0))), near(2, F.get("after", F.lit(0)))),
        lambda x: x["line"].isNotNull(),
    )
    return prints.select("*", F.inline(keys))


def extended(own: str, other: str, side: int = SIDE) -> Column:
    """How many of the nearest lines are equal."""
    count, going = F.lit(0), F.lit(True)
    for k in range(side):
        going = going & F.coalesce(F.get(own, F.lit(k)) == F.get(other, F.lit(k)), F.lit(False))
        count = count + F.when(going, 1).otherwise(0)
    return count


def repeated_places(prints: DataFrame) -> DataFrame:
    """``doc_id, tkey, removed``: the places, in the original text, of the lines to delete.

    Grams that occur once go first, on their hashes alone. Map tasks send one row a key for the first places, and a
    key of any share of the rows is split by the joins.
    """
    again = stored(prints.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b"), "repeated-grams")
    rows = keyed(stored(prints.join(again, ["a", "b"], "left_semi"), "repeated-fingerprints"))
    key = ["a", "b", "kind", "line"]
    place = F.struct("doc_id", "tkey", "pos", F.col("before").alias("b0"), F.col("after").alias("a0"))
    first = stored(
        rows.groupBy(*key).agg(F.min(place).alias("src"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first-places"
    )
    same = F.struct("doc_id", "tkey", "pos").eqNullSafe(F.struct("src.doc_id", "src.tkey", "src.pos"))
    matches = rows.join(first, key).filter(~same)
    ahead, behind = extended("before", "src.b0"), extended("after", "src.a0")
    start = F.size("before") - ahead
    gone = F.slice("at", start + 1, ahead + F.col("size") + behind)
    places = matches.select("doc_id", "tkey", F.explode(gone).alias("at"))
    return places.groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_set("at")).alias("removed"))


def drop_repeated_lines(
    docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long_words: int = LONG_WORDS
) -> DataFrame:
    """``doc_id, text, n_lines, n_removed`` for every row: the text without later repeats of line runs.

    A run goes for certain if it has ``gram + window - 1`` lines, or in fewer lines ``long_words`` words; beside a
    line of so many words up to ``gram - 1`` short lines at the end of the run may stay. No run goes that has neither
    ``gram`` lines nor ``long_words`` words, except that a text of fewer lines goes whole if an earlier one has just
    these lines and it has at least ``gram`` words.

    Documents come in the order of ``doc_id`` (NULL first), then of a hash of the text. Lines are the pieces
    between ``\\n``; lines without a word are skipped in matching and stay, unless no line with a word is left:
    then the text is empty. NULL texts count as empty. Rows that repeat id and text are one document and get
    the same result. Repeats inside a document count too. An empty table gives no rows; other columns are not
    read.
    """
    prints = fingerprints(hashed_lines(docs, gram, long_words), gram, window)
    removed = repeated_places(stored(prints, "line-fingerprints"))
    texts = docs.select("doc_id", text_of().alias("text"), text_key().alias("tkey"))
    gone = removed.select(F.col("doc_id").alias("gone_id"), F.col("tkey").alias("gone_key"), "removed")
    joined = texts.join(
        gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("tkey") == F.col("gone_key")), "left"
    )
    cut = joined.withColumn("lines", lines_of(F.col("text"))).withColumn(
        "left",
        F.transform(
            F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed")), lambda i: F.col("lines")[i]
        ),
    )
    left = F.array_join("left", "\n")
    return cut.select(
        "doc_id",
        F.when(F.col("removed").isNull(), F.col("text")).when(left.rlike(WORD), left).otherwise("").alias("text"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
