"""Tables kept as a log of changes, resolved when they are read.

A table is plain Parquet below ``change=N/bucket=B``. A change holds rows that are new or replace those of the same
``id``, and ids that are deleted; it costs its own size. A row without id starts its bucket anew. Readers filter by
bucket, which Spark turns into partition filters, and keep the newest change of each id. ``compact`` writes the
resolved rows to a new path. A table has one writer at a time; a write that was stopped and is done again gets the
next number and replaces what the first one left.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.session import stored

#: Buckets of a table. Stored tables depend on it.
BUCKETS = 64


def read_or_none(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """Parquet rows, or None where nothing was written yet; a store that cannot be read is an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def log_schema(schema: T.StructType) -> T.StructType:
    more = [("deleted", T.BooleanType()), ("change", T.LongType()), ("bucket", T.IntegerType())]
    return T.StructType([*schema.fields, *[T.StructField(name, kind) for name, kind in more]])


def bucket_of(key: Column) -> Column:
    """The bucket of a key; NULL has one, too."""
    return F.pmod(F.xxhash64(key.cast("bigint")), F.lit(BUCKETS)).cast("int")


def buckets_of(keys: DataFrame, key: str) -> list[int]:
    """The buckets of all keys, at most ``BUCKETS`` numbers."""
    return sorted(r[0] for r in keys.select(bucket_of(F.col(key))).distinct().collect())


def read_log(spark: SparkSession, path: str, schema: T.StructType, only: list[int] | None = None) -> DataFrame:
    """All changes of a table or of the buckets ``only``."""
    full = log_schema(schema)
    rows = read_or_none(spark, path, full)
    if rows is None:
        rows = spark.createDataFrame([], full)
    return rows if only is None else rows.filter(F.col("bucket").isin(only))


def append_change(
    rows: DataFrame, path: str, schema: T.StructType, key: str, deleted: DataFrame | None = None,
    anew: list[int] | None = None,
) -> int:
    """Write the next change: rows that are new or replaced, ids that go (``deleted`` with id and ``key``), and
    buckets that hold nothing but these rows from now on."""
    spark = rows.sparkSession
    last = read_log(spark, path, schema).agg(F.max("change")).first()[0]
    number = 0 if last is None else last + 1
    full = log_schema(schema)
    change = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], F.lit(False).alias("deleted"))
    if deleted is not None:
        change = change.unionByName(deleted.select(*dict.fromkeys(["id", key])).distinct().withColumn("deleted", F.lit(True)), allowMissingColumns=True)
    change = change.withColumn("bucket", bucket_of(F.col(key)))
    if anew:
        marks = spark.createDataFrame([(b,) for b in anew], "bucket int").withColumn("deleted", F.lit(True))
        change = change.unionByName(marks, allowMissingColumns=True)
    # A large bucket is dealt out to several files.
    change = change.select(*[f.name for f in full.fields if f.name != "change"]).hint("rebalance", "bucket")
    change.write.mode("overwrite").partitionBy("bucket").parquet(f"{path.rstrip('/')}/change={number}")
    return number


def read_table(spark: SparkSession, path: str, schema: T.StructType, only: list[int] | None = None) -> DataFrame:
    """The rows of a table, or of its buckets ``only``: of each id the newest change, unless that deletes it.

    Which ids were changed again is found on numbers alone and stored, so that Spark sees how small it is and the
    texts stay where they are.
    """
    log = read_log(spark, path, schema, only)
    places = log.select("id", "bucket", "change")
    begun = F.max(F.when(F.col("id").isNull(), F.col("change")))
    begins = stored(places.groupBy("bucket").agg(F.coalesce(begun, F.lit(-1)).alias("begins")), "log-begins")

    def valid(rows: DataFrame) -> DataFrame:
        return rows.filter("id IS NOT NULL").join(begins, "bucket").filter("change >= begins")

    again = stored(
        valid(places).groupBy("id").agg(F.max("change").alias("newest"), F.count("*").alias("times")).filter("times > 1").select("id", "newest"),
        "log-newest",
    )
    newest = valid(log).join(again, "id", "left").filter("coalesce(newest, change) = change AND NOT deleted")
    return newest.select(*schema.names)


def compact(spark: SparkSession, path: str, schema: T.StructType, key: str, out: str) -> None:
    """Write the resolved rows of a table as the only change of a table at ``out``."""
    append_change(read_table(spark, path, schema), out, schema, key)
