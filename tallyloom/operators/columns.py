"""Statistics and key structure of columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def column_statistics(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column, rows, low, high, distinct_values, is_unique, domain, spread) a column, from one pass.

    ``exact`` counts distinct values exactly; otherwise by sketch, which needs
    no shuffle of the values.
    """
    count = F.count_distinct if exact else F.approx_count_distinct
    names = df.columns
    row = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(names) for x in (F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}"), count(F.col(c)).alias(f"d{i}"))])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("rows"), F.col(f"l{i}").cast("long").alias("low"), F.col(f"h{i}").cast("long").alias("high"), F.col(f"d{i}").alias("distinct_values")) for i, c in enumerate(names)])
    out = row.select(F.explode(parts).alias("s")).select("s.*")
    domain = F.col("high") - F.col("low") + 1
    return out.withColumn("is_unique", F.col("rows") == F.col("distinct_values")).withColumn("domain", domain).withColumn("spread", domain / F.col("distinct_values"))


def existence(df: DataFrame, column: str) -> DataFrame:
    """The values that occur, once each."""
    return df.select(F.col(column).alias("key")).where("key is not null").distinct()


def key_counts(df: DataFrame, column: str) -> DataFrame:
    """(key, n): how often each value occurs."""
    return df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))


def aggregate_index(df: DataFrame, column: str, sums: list[str]) -> DataFrame:
    """(key, n, one sum a column): what a join needs of a relation that only adds up."""
    return df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums])


def duplication(df: DataFrame, column: str) -> DataFrame:
    """(rows, distinct_values, duplicates): the mean rows a value."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(column).alias("distinct_values")).withColumn("duplicates", F.col("rows") / F.col("distinct_values"))


def key_containment(foreign: DataFrame, column: str, keyed: DataFrame, key: str) -> DataFrame:
    """(key_is_unique, missing): whether ``key`` is unique, and rows of ``foreign`` whose value isn't a key."""
    missing = foreign.select(F.col(column).alias("v")).join(keyed.select(F.col(key).alias("v")), "v", "left_anti").agg(F.count("*").alias("missing"))
    unique = keyed.agg((F.count(key) == F.count_distinct(key)).alias("key_is_unique"))
    return unique.join(F.broadcast(missing))  # one row and one row


def sort_order(df: DataFrame, column: str, position: str) -> DataFrame:
    """(ascending, descending): whether ``column`` is sorted along ``position``.

    Rows are dealt by ranges of ``position`` (from a sample, so skewed places spread) and
    each task looks at its own neighbours; its two ends, one row a task, are
    compared with the next task's.
    """
    pairs = df.select(F.col(position).cast("long").alias("p"), F.col(column).cast("long").alias("v"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        up = down = True
        for batch in batches:
            v = batch.column(1).to_numpy()
            if not len(v):
                continue
            whole = v if last is None else np.concatenate([[last], v])
            up &= bool((whole[1:] >= whole[:-1]).all())
            down &= bool((whole[1:] <= whole[:-1]).all())
            first, last = (int(v[0]) if first is None else first), int(v[-1])
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"task": TaskContext.get().partitionId(), "first": first, "last": last, "up": up, "down": down}])

    ranged = pairs.repartitionByRange("p").sortWithinPartitions("p")
    ends = ranged.mapInArrow(look, "task long, first long, last long, up boolean, down boolean")
    before = F.lag("last").over(Window.orderBy("task"))  # one row a task
    flags = ends.withColumn("u", before).select((F.col("up") & (F.col("u").isNull() | (F.col("u") <= F.col("first")))).alias("up"), (F.col("down") & (F.col("u").isNull() | (F.col("u") >= F.col("first")))).alias("down"))
    return flags.agg(F.coalesce(F.bool_and("up"), F.lit(True)).alias("ascending"), F.coalesce(F.bool_and("down"), F.lit(True)).alias("descending"))


def semi_reduce(df: DataFrame, column: str, keyed: DataFrame, key: str) -> DataFrame:
    """Rows whose value occurs among the keys; columns of the keyed side aren't read."""
    return df.join(keyed.select(F.col(key).alias(column)), column, "left_semi")


def counted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of ``columns`` with their number: (..., n)."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def range_partitions(df: DataFrame, column: str, parts: int) -> DataFrame:
    """(part, low, high, rows) of equal-width ranges of the column."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    width = max(1, -(-(int(high or 0) - int(low or 0) + 1) // parts))
    part = F.floor((F.col(column) - int(low or 0)) / width).cast("long")
    return df.groupBy(part.alias("part")).agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("rows"))

