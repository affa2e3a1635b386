"""Notebooks, sources and chat logs: what they are after changes, and lists of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import is_blank, literal, or_empty, strip
from shelfmark.model import FAILED, SUCCESS
from shelfmark.operators.spread import positions, spread_lookup
from shelfmark.session import stored

# Fixed value: what stands between two sources, and between two windows of a context.
SEPARATOR = "\n\n---\n\n"
SOURCE_KEY = ["notebook_id", "url"]


def _next_ids(rows: DataFrame, order: list[str], existing: DataFrame) -> DataFrame:
    """Ids that go on from the largest one, in the given order."""
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).scalar()
    return positions(rows, [], order, out="_pos").withColumn("id", F.col("_pos") + last).drop("_pos")


def append_notebooks(notebooks: DataFrame, names: DataFrame, created_at) -> DataFrame:
    """``notebooks`` and one more per name; blank names are refused. Names are distinct."""
    added = names.filter(~is_blank(F.col("name"))).select(strip(F.col("name")).alias("name"))
    numbered = _next_ids(added, ["name"], notebooks).withColumn(
        "created_at", literal(created_at).cast("timestamp")
    )
    return notebooks.unionByName(numbered)


def list_notebooks(notebooks: DataFrame) -> DataFrame:
    return notebooks.orderBy(F.desc("created_at"), F.desc("id"))


def _numbered(batch: DataFrame) -> DataFrame:
    """The batch stored with a number for each row, so that rows can be chosen on narrow columns; as it is if its
    rows have a fixed place (``_row``) already."""
    return batch if "_row" in batch.columns else stored(batch.withColumn("_row", F.monotonically_increasing_id()), "batch")


def _newest(batch: DataFrame, order: list[str]) -> DataFrame:
    """For each notebook and URL the newest change and the newest that is no failure, without their texts.

    At the same time a success is newer than a failure; what is still equal is told apart by a hash of title and
    text, and by the place in the batch where that is equal, too.
    """
    narrow = batch.select(
        *SOURCE_KEY, *order, "last_updated", "status", F.xxhash64("title", "content").alias("_code"), "_row",
        is_blank(F.col("content")).alias("_blank"),
    )
    change = F.struct(*order, "last_updated", "status", "_code", "_row", "_blank")
    return narrow.groupBy(*SOURCE_KEY).agg(
        F.max(change).alias("_newest"), F.max(F.when(F.col("status") != FAILED, change)).alias("_good"),
        *[F.min(c).alias("_first") for c in order[:1]],
    )


def decisive_changes(batch: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The changes of a batch that later ones cannot do without: for each notebook and URL the newest, and the
    newest that is no failure."""
    batch = _numbered(batch)
    both = _newest(batch, order or [])
    rows = both.select(F.explode(F.array_compact(F.array_distinct(F.array("_newest._row", "_good._row")))).alias("_row"))
    return batch.join(rows, "_row", "left_semi").drop("_row")


def _decisions(
    current: DataFrame, batch: DataFrame, keep_on_fail: bool, order: list[str], numbered: DataFrame | None
) -> DataFrame:
    """Stored and narrow, one row a source that the batch names: ``notebook_id, url, id, _known, _row, _time``.
    ``_row`` is the row of the batch whose text the source has from now on, NULL if it keeps its own."""
    changes = _newest(batch, order)

    def holds_text(row: str) -> Column:
        return (F.col(f"{row}.status") == SUCCESS) & ~F.col(f"{row}._blank")

    # What is left after a success: its text, or, if it had none, the failure that came later.
    left = F.when(holds_text("_good"), F.col("_good")).otherwise(F.col("_newest")) if keep_on_fail else F.col("_newest")
    changes = changes.withColumn("_left", F.coalesce(left, F.col("_newest")))
    held = current.select(
        *SOURCE_KEY, "id", ((F.col("status") == SUCCESS) & ~is_blank(F.col("content"))).alias("_held"), F.lit(True).alias("_known")
    )
    kept = F.col("_good").isNull() & F.coalesce("_held", F.lit(False)) if keep_on_fail else F.lit(False)
    told = stored(
        changes.join(held, SOURCE_KEY, "left").select(
            *SOURCE_KEY, "id", F.coalesce("_known", F.lit(False)).alias("_known"),
            F.when(~kept, F.col("_left._row")).alias("_row"), F.col("_newest.last_updated").alias("_time"),
            *(["_first"] if order else []),
        ),
        "decisions",
    )
    numbering = [*(["_first"] if order else []), *SOURCE_KEY]
    taken = current if numbered is None else numbered
    ids = _next_ids(told.filter("NOT _known").select(*numbering), numbering, taken).select("id", *SOURCE_KEY)
    added = told.filter("NOT _known").drop("id").join(ids, SOURCE_KEY)
    return stored(told.filter("_known").unionByName(added).drop("_first"), "decisions")


COLUMNS = ["id", *SOURCE_KEY, "title", "content", "status", "last_updated"]


def _replaced(batch: DataFrame, decisions: DataFrame) -> DataFrame:
    """Sources with a text of the batch."""
    texts = batch.select("_row", "title", "content", "status")
    return texts.join(decisions.filter("_row IS NOT NULL").withColumnRenamed("_time", "last_updated"), "_row").select(*COLUMNS)


def changed_sources(
    current: DataFrame, batch: DataFrame, keep_on_fail: bool = True, order: list[str] | None = None,
    numbered: DataFrame | None = None,
) -> DataFrame:
    """The sources that ``upsert_sources`` changes or adds, as they are afterwards; the others are left out."""
    batch = _numbered(batch)
    decisions = _decisions(current, batch, keep_on_fail, order or [], numbered)
    named = decisions.filter("_row IS NULL").select(*SOURCE_KEY, F.col("_time"))
    kept = current.join(named, SOURCE_KEY).withColumn("last_updated", F.col("_time"))
    return _replaced(batch, decisions).unionByName(kept.select(*COLUMNS))


def upsert_sources(
    current: DataFrame, batch: DataFrame, keep_on_fail: bool = True, order: list[str] | None = None,
    numbered: DataFrame | None = None,
) -> DataFrame:
    """``current`` after the batch: known sources change and keep their id, others are added.

    The result is that of the changes applied one by one in the order of ``order`` (none by default) and time,
    however they are cut into batches. With ``keep_on_fail`` a failed refetch does not blank text that was
    fetched before. New sources are numbered by the first of ``order`` and the key, after the ids of
    ``numbered`` if ``current`` is only a part of the table.

    What becomes of each source is decided on keys, times and row numbers and stored; the texts then meet that
    narrow table once, or stay where they are if it is small enough for Spark to broadcast.
    """
    batch = _numbered(batch)
    decisions = _decisions(current, batch, keep_on_fail, order or [], numbered)
    named = decisions.filter("_known").select(*SOURCE_KEY, "_row", "_time", F.lit(True).alias("_named"))
    left = current.join(named, SOURCE_KEY, "left").filter("_named IS NULL OR _row IS NULL")
    left = left.withColumn("last_updated", F.coalesce("_time", "last_updated"))
    return left.select(*COLUMNS).unionByName(_replaced(batch, decisions))


def list_sources(sources: DataFrame, notebook_id: int | Column | None = None) -> DataFrame:
    """Sources without their text, newest first; all notebooks when none is named."""
    chosen = sources if notebook_id is None else sources.filter(F.col("notebook_id") == notebook_id)
    return chosen.select("notebook_id", "id", "url", "title", "status", "last_updated").orderBy(
        "notebook_id", F.desc("last_updated"), F.desc("id")
    )


def source_detail(sources: DataFrame, keys: DataFrame) -> DataFrame:
    """Whole rows for the wanted ``id, notebook_id`` pairs; unknown pairs give nothing."""
    wanted = keys.select("id", "notebook_id").distinct()
    return sources.join(wanted, ["id", "notebook_id"]).select(
        "id", "url", "title", "content", "status", "last_updated"
    )


def delete_sources(sources: DataFrame, keys: DataFrame) -> DataFrame:
    """``sources`` without the ``id, notebook_id`` pairs; a pair that matches nothing is no error."""
    return sources.join(keys.select("id", "notebook_id"), ["id", "notebook_id"], "left_anti")


def delete_notebooks(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Notebooks go with their sources and chat logs. ``ids`` has a column ``id``."""
    gone = ids.select("id").distinct()

    def without(table: str, column: str) -> DataFrame:
        rows = tables[table]
        left = spread_lookup(rows, gone.withColumnRenamed("id", column), [column], "left_anti", ["id"])
        return left.select(rows.columns)

    return {
        "notebooks": without("notebooks", "id"),
        "sources": without("sources", "notebook_id"),
        "chat_logs": without("chat_logs", "notebook_id"),
    }


def notebook_corpus(sources: DataFrame) -> DataFrame:
    """Text of each successful source, a row each: ``notebook_id, id, text``."""
    text = F.concat(
        F.lit("Title: "), or_empty(F.col("title")),
        F.lit("\nURL: "), F.col("url"),
        F.lit("\nContent: "), or_empty(F.col("content")),
    )
    return sources.filter(F.col("status") == SUCCESS).select("notebook_id", "id", text.alias("text"))


def append_chats(logs: DataFrame, batch: DataFrame, created_at, order: list[str]) -> DataFrame:
    """``logs`` and the new questions with answers, numbered by ``order``, unique in ``batch``; a chat
    without notebook is one like any other."""
    keys = _next_ids(batch.select(*order), order, logs).withColumnsRenamed({c: f"_{c}" for c in order})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order])
    added = keys.join(batch, same).withColumn("created_at", literal(created_at).cast("timestamp"))
    return logs.unionByName(added.select(logs.columns))


def chat_history(logs: DataFrame, notebook_id: int | None = None) -> DataFrame:
    """Questions and answers, oldest first."""
    chosen = logs if notebook_id is None else logs.filter(F.col("notebook_id") == notebook_id)
    return chosen.select("notebook_id", "id", "query", "answer", "created_at").orderBy(
        "notebook_id", "created_at", "id"
    )
