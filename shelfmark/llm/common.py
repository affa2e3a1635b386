"""Helpers shared by the corpus operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.session import small_batches

# White space and words of the corpus contracts.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(column: str = "text") -> Column:
    """A 64-bit number that tells rows of one ``doc_id`` with different texts apart."""
    return F.xxhash64(text_of(column))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def rows_by_key(docs: DataFrame, chosen: DataFrame, key: Column) -> DataFrame:
    """One row of ``docs`` for each ``(doc_id, key)`` of ``chosen``, all columns kept.

    Rows that repeat a document id and key count once; the first by its other plain columns stays,
    cut down to one on the map side already.
    """
    k, place, chosen_id, chosen_key = fresh(docs, "key", "place", "chosen_id", "chosen_key")
    wanted = chosen.select(F.col("doc_id").alias(chosen_id), F.col("key").alias(chosen_key))
    keyed = docs.withColumn(k, key)
    found = keyed.join(
        wanted, F.col("doc_id").eqNullSafe(F.col(chosen_id)) & (F.col(k) == F.col(chosen_key)), "left_semi"
    )
    plain = [f.name for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name != "doc_id"]
    first = Window.partitionBy("doc_id", k).orderBy(*[F.col(f"`{c}`") for c in plain] or [F.lit(0)])
    return found.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


def joined_sha256(rows: DataFrame, key: str, order: list[str], line: Column, separator: str, out: str) -> DataFrame:
    """``key, out``: the digest of the lines of each key in order, joined by ``separator``.

    A digest is one pass over its lines by definition. Rows are sorted and streamed, so a task holds an Arrow batch
    and no group.
    """
    small_batches(rows.sparkSession)

    def digested(keys: list, hexes: list, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(hexes, pa.string())], names=[key, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = digest = kind = None
        between = separator.encode()
        for batch in batches:
            kind, keys, hexes = batch.schema.field(0).type, [], []
            for now, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is not None and now == current:
                    digest.update(between + text.encode())
                    continue
                if digest is not None:
                    keys.append(current)
                    hexes.append(digest.hexdigest())
                current, digest = now, hashlib.sha256(text.encode())
            if keys:
                yield digested(keys, hexes, kind)
        if digest is not None:
            yield digested([current], [digest.hexdigest()], kind)

    sorted_rows = rows.select(key, line.alias("line"), *order).repartition(key).sortWithinPartitions(key, *order)
    return sorted_rows.select(key, "line").mapInArrow(run, T.StructType([rows.schema[key], T.StructField(out, T.StringType())]))
