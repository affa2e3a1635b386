"""Mixing documents to target weights by iterative proportional fitting.

Tokens are summed by cell of source, language and topic. The cells' weights are raked: scaled to the target
shares of one dimension after the other until all marginals fit. How often a document is wanted follows from the
weight of its cell: whole-number repeats, and a fixed hash of its id decides on the fraction. So the tokens of
all copies have the target shares, also where a cell has too few tokens of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import WORD, fresh, text_of
from shelfmark.session import stored

DIMENSIONS = ("source", "lang", "topic")
TEMPERATURE = 0.7
BUDGET_SHARE = 0.8
MOST_ROUNDS = 50
CLOSE = 1e-6
SEED = 17


def topic_of(text: Column, tokens: Column) -> Column:
    """Topic of a document without one: by its form, a table, a note, an article or a long work."""
    bars = F.regexp_count(text, F.lit(r"\|"))
    return F.when(bars * 4 > tokens, "table").when(tokens < 100, "note").when(tokens < 1000, "article").otherwise("long")


def measured(docs: DataFrame, source: str, lang: str, topic: Column | None) -> DataFrame:
    """``doc_id, luck, source, lang, topic, tokens``: narrow rows; NULL values are the empty name."""
    texts = docs.select(
        "doc_id", F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), text_of().alias("text"),
        *([topic.alias("topic")] if topic is not None else []),
    ).withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("bigint"))
    if topic is None:
        texts = texts.withColumn("topic", topic_of(F.col("text"), F.col("tokens")))
    return texts.select(
        "doc_id", luck(F.col("doc_id"), F.col("text")).alias("luck"), "source", "lang",
        F.coalesce(F.col("topic").cast("string"), F.lit("")).alias("topic"), "tokens",
    )


def luck(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) fixed by seed, id and text."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.crc32(text))
    return F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") / float(16**12)


def tempered(cells: DataFrame, dim: str, temperature: float) -> DataFrame:
    """Default targets: each value's share of the tokens to the power of ``temperature``."""
    sums = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temperature)).alias("target"))
    return sums


def raked(cells: DataFrame, targets: dict[str, DataFrame], most_rounds: int = MOST_ROUNDS, close: float = CLOSE) -> DataFrame:
    """``cells`` with ``weight``, whose sums over each dimension have the target shares.

    Targets are relative to each other and to the tokens in the cells: values without a cell are left out,
    and a cell whose value has no target gets weight 0. A round scales each dimension once; rounds end when
    no marginal was off by more than ``close``, or after ``most_rounds`` if the targets contradict each other.
    """
    for dim, target in targets.items():
        cells = cells.join(target.select(dim), dim, "left_semi")
    cells = stored(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    total = cells.agg(F.sum("weight")).first()[0]
    if not total:
        return cells
    for dim, target in targets.items():
        there = target.join(cells.select(dim).distinct(), dim, "left_semi")
        whole = there.agg(F.sum("target")).first()[0]
        cells = cells.join(there.select(dim, (F.col("target") / whole * total).alias(f"goal_{dim}")), dim)
    cells = stored(cells, "cells")
    for _ in range(most_rounds):
        for dim in targets:
            sums = cells.groupBy(dim).agg(F.sum("weight").alias("sum"))
            factor = F.coalesce(F.try_divide(f"goal_{dim}", "sum"), F.lit(1.0))
            cells = cells.join(sums, dim).withColumns(
                {"weight": F.col("weight") * factor, f"off_{dim}": F.abs(factor - 1)}
            ).drop("sum")
        off = [f"off_{dim}" for dim in targets]
        cells = stored(cells, "cells")
        worst = cells.agg(*[F.max(c) for c in off]).first()
        cells = cells.drop(*off)
        if max(worst) <= close:
            break
    return cells.drop(*[f"goal_{dim}" for dim in targets])


def with_probability(cells: DataFrame, budget_share: float) -> DataFrame:
    """``cells`` with ``rate``, the expected copies of a document, and ``probability``, the chance of one or more.

    The rate is weight over tokens with one scale for all cells, so the copies keep the raked shares. The scale
    is such that the expected tokens of different documents are the share ``budget_share`` of all: cells of a
    rate above 1 are taken whole and the scale goes up for the rest. Repeats come on top of this budget."""
    ratio = F.try_divide("weight", "tokens")
    sums = cells.agg(F.sum("tokens"), F.sum("weight")).first()
    scale, budget = (budget_share, budget_share * float(sums[0])) if sums[1] else (0.0, 0.0)
    while scale:
        taken = F.col("weight") * scale >= F.col("tokens")
        whole, left = cells.agg(
            F.sum(F.when(taken, F.col("tokens")).otherwise(0)), F.sum(F.when(~taken, F.col("weight")).otherwise(0.0))
        ).first()
        further = (budget - whole) / left if left else scale
        if further <= scale * (1 + 1e-12):
            break
        scale = further
    rate = F.coalesce(ratio * scale, F.lit(1.0 if scale else 0.0))
    return cells.withColumns({"rate": rate, "probability": F.least(rate, F.lit(1.0))})


def copies_of(luck: Column, rate: Column) -> Column:
    """Copies of a document: the whole part of the rate, and one more if its number is below the fraction."""
    return (F.floor(rate) + (luck < rate - F.floor(rate)).cast("int")).cast("bigint")


def calibrated(rows: DataFrame, targets: dict[str, DataFrame] | None, temperature: float, budget_share: float) -> DataFrame:
    cells = stored(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "token-cells")
    goals = {dim: (targets or {}).get(dim) or tempered(cells, dim, temperature) for dim in DIMENSIONS}
    return stored(with_probability(raked(cells, goals), budget_share), "probabilities")


def mixed(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: float = TEMPERATURE,
    budget_share: float = BUDGET_SHARE, source: str = "source", lang: str = "lang", topic: Column | None = None,
) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, weight, probability, sampled, copies`` for every row of ``docs``.

    ``targets`` has for a dimension the shares of its values (columns of its name and ``target``); without,
    the tokens' shares to the power of ``temperature``. ``weight`` is the wanted share of a token over its
    share now, ``probability`` the chance of the document, ``sampled`` the decision by a hash of id and text:
    the same on every run. ``copies`` tells how often a sampled document is taken, 0 for the others; the tokens
    of the copies have the target shares. NULL in a dimension is the value with the empty name; a NULL text has no tokens;
    documents without tokens take the chance 1 unless their cell has no weight target. Repeated rows are
    decided alike. An empty table gives no rows; other columns are not read.
    """
    rows = stored(measured(docs, source, lang, topic), "mixing-rows")
    cells = calibrated(rows, targets, temperature, budget_share)
    chances = cells.select(*DIMENSIONS, F.try_divide("weight", "tokens").alias("weight"), "rate", "probability")
    chance, rate = F.coalesce("probability", F.lit(0.0)), F.coalesce("rate", F.lit(0.0))
    return rows.join(chances, list(DIMENSIONS), "left").select(
        "doc_id", *DIMENSIONS, "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"),
        chance.alias("probability"), (F.col("luck") < chance).alias("sampled"),
        copies_of(F.col("luck"), rate).alias("copies"),
    )


def sample_mix(
    docs: DataFrame, temperature: float = TEMPERATURE, budget_share: float = BUDGET_SHARE, repeats: bool = False
) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns; with ``repeats`` each as often as it has copies."""
    cells = calibrated(stored(measured(docs, "source", "lang", None), "mixing-rows"), None, temperature, budget_share)
    s, la, t, n, r, c, k = fresh(docs, "of_source", "of_lang", "of_topic", "tokens", "rate", "copies", "copy")
    rates = cells.select(
        F.col("source").alias(s), F.col("lang").alias(la), F.col("topic").alias(t), F.col("rate").alias(r)
    )
    own = docs.withColumn(n, F.regexp_count(text_of(), F.lit(WORD)).cast("bigint"))
    same = (
        (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col(s))
        & (F.coalesce(F.col("lang").cast("string"), F.lit("")) == F.col(la))
        & (topic_of(text_of(), F.col(n)) == F.col(t))
    )
    found = own.join(rates, same).withColumn(c, copies_of(luck(F.col("doc_id"), text_of()), F.col(r))).filter(F.col(c) > 0)
    if repeats:
        found = found.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(c))))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
