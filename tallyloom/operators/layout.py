"""Stored layouts: sorted files with statistics and Bloom filters, buckets, narrow columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a sorted file or bucket holds on average at most: what one task sorts.
ROWS_A_PART = 1_000_000
_WIDTHS = (("byte", 1 << 7), ("short", 1 << 15), ("int", 1 << 31))


def parts(least: int, *frames: DataFrame) -> int:
    """Files or buckets for frames of any size: ``least``, and more where one frame has over ``ROWS_A_PART`` rows for each.

    Frames that are to be joined by their buckets need the same number, which the
    largest of them sets.  Counting reads no columns of Parquet.
    """
    most = int(frames[0].sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return max(least, min(most, -(-max(df.count() for df in frames) // ROWS_A_PART)))


def write_sorted(df: DataFrame, path: str, by: str, bloom: tuple[str, ...] = (), files: int | None = None, rows_a_group: int = 200_000) -> DataFrame:
    """``df`` as Parquet in ranges of ``by``, sorted inside: range and point filters on it skip files and row groups.

    ``bloom``: further columns that get Bloom filters, for point filters.  The
    ranges come from a sample of the column, so skewed values spread over files.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(files, by) if files else df.repartitionByRange(by)
    writer = ranged.sortWithinPartitions(by).write.option("parquet.block.row.count.limit", str(rows_a_group))
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, table: str, by: str, buckets: int, path: str | None = None) -> DataFrame:
    """``df`` as a table in hash buckets of ``by``, sorted inside: joins and groupings on it need no shuffle."""
    writer = df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).format("parquet").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def narrowest(low: int | None, high: int | None) -> str:
    """The narrowest signed type that holds both ends of a range."""
    if low is None or high is None:
        return "byte"
    return next((name for name, limit in _WIDTHS if -limit <= low and high < limit), "long")


def compressed(df: DataFrame) -> DataFrame:
    """Integral columns in the narrowest type that their values need, from one pass over minima and maxima."""
    names = df.columns
    ends = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("l", F.min), ("h", F.max))]).first()
    return df.select(*[F.col(c).cast(narrowest(ends[f"l{i}"], ends[f"h{i}"])).alias(c) for i, c in enumerate(names)])

