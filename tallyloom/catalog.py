"""Relations by number, their statistics and the keys found in them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Statistics:
    rows: int
    low: tuple[int | None, ...]
    high: tuple[int | None, ...]
    distinct: tuple[int, ...]
    unique: tuple[bool, ...]


class Catalog:
    """Registered relations r0, r1, ...; statistics are computed once per relation, when first asked for.

    ``reuse`` keeps counts and sums per join key that plans ask for, so that later
    queries of a session join them instead of the rows.  ``explore`` looks for
    unique columns and contained keys in the data; without it only what
    :meth:`declare_unique` and :meth:`declare_contained` say is used, and planning
    costs one aggregation without a shuffle a relation.
    """

    def __init__(self, spark: SparkSession, reuse: bool = False, explore: bool = True):
        self.spark, self.reuse, self.explore = spark, reuse, explore
        self._frames: dict[int, DataFrame] = {}
        self._narrow: dict[int, Callable[[list[int]], DataFrame]] = {}
        self._statistics: dict[int, Statistics] = {}
        self._contained: dict[tuple, bool] = {}
        self._squares: dict[tuple[int, int], float] = {}
        self._aggregated: dict[tuple[int, int], DataFrame] = {}
        self._declared: set[tuple[int, int]] = set()

    def register(self, relation: int, df: DataFrame, view: bool = True, narrow: Callable[[list[int]], DataFrame] | None = None) -> DataFrame:
        """Columns become c0, c1, ... by position.

        ``narrow`` loads only the columns at some positions, for sources that don't prune by themselves.
        """
        self.drop(relation)
        df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        self._frames[relation] = df
        if narrow is not None:
            self._narrow[relation] = narrow
        if view:
            df.createOrReplaceTempView(f"r{relation}")
        return df

    def drop(self, relation: int) -> None:
        """Forget a relation, its view, statistics and stored aggregates."""
        if relation in self._frames:
            self.spark.catalog.dropTempView(f"r{relation}")
        self._frames.pop(relation, None)
        self._narrow.pop(relation, None)
        self._statistics.pop(relation, None)
        self._contained = {k: v for k, v in self._contained.items() if relation not in (k[0][0], k[1][0])}
        self._squares = {k: v for k, v in self._squares.items() if k[0] != relation}
        self._declared = {k for k in self._declared if k[0] != relation}
        for key in [k for k in self._aggregated if k[0] == relation]:
            self._aggregated.pop(key).unpersist()

    def store(self, relation: int, path: str, by: int = 0, bloom: tuple[int, ...] = ()) -> DataFrame:
        """Write a relation sorted along one column (with Bloom filters on others) and go on with the stored one."""
        from .operators.layout import write_sorted

        known = self._statistics.get(relation)
        stored = write_sorted(self.frame(relation), path, f"c{by}", tuple(f"c{i}" for i in bloom))
        self.register(relation, stored)
        if known is not None:
            self._statistics[relation] = known  # the same rows
        return self.frame(relation)

    def declare_unique(self, relation: int, position: int) -> None:
        self._declared.add((relation, position))
        self._statistics.pop(relation, None)

    def declare_contained(self, foreign: tuple[int, int], key: tuple[int, int]) -> None:
        """Every value of ``foreign`` occurs in the unique column ``key``."""
        self.declare_unique(*key)
        self._contained[foreign, key] = True

    def add(self, df: DataFrame) -> int:
        """Register under the next number, which is the order of loading."""
        relation = max(self._frames, default=-1) + 1
        self.register(relation, df)
        return relation

    def frame(self, relation: int, positions: list[int] | None = None) -> DataFrame:
        """The relation, or of one that was registered with ``narrow`` only the columns at ``positions``."""
        if relation not in self._frames:
            raise KeyError(f"no relation {relation}")
        if positions is not None and relation in self._narrow:
            return self._narrow[relation](positions).toDF(*[f"c{i}" for i in positions])
        return self._frames[relation]

    def squares(self, relation: int, position: int) -> float:
        """The sum over a column's values of their squared number of rows."""
        if (relation, position) not in self._squares:
            counts = self.frame(relation, [position]).groupBy(f"c{position}").agg(F.count("*").cast("double").alias("n"))
            self._squares[relation, position] = counts.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0
        return self._squares[relation, position]

    def aggregated(self, relation: int, position: int) -> DataFrame | None:
        """(key, n, sum_c0, ...): counts and sums a value of a column, computed when first used and kept; None without ``reuse``.

        Only where values repeat and no sum can leave the range of a long.
        """
        if not self.reuse:
            return None
        if (relation, position) not in self._aggregated:
            stats = self.statistics(relation)
            if 2 * stats.distinct[position] > stats.rows or any((high or 0) * stats.rows >= 1 << 63 for high in stats.high):
                return None
            sums = [F.sum(F.col(f"c{i}").cast("long")).alias(f"sum_c{i}") for i in range(self.width(relation))]
            kept = self.frame(relation).where(F.col(f"c{position}").isNotNull()).groupBy(F.col(f"c{position}").alias("key")).agg(F.count("*").alias("n"), *sums)
            self._aggregated[relation, position] = kept.persist()
        return self._aggregated[relation, position]

    def width(self, relation: int) -> int:
        return len(self.frame(relation).columns)

    def statistics(self, relation: int) -> Statistics:
        """Rows, and per column minimum, maximum, distinct values (a sketch) and uniqueness.

        One pass without a shuffle; only a column whose sketch comes near the
        number of rows is looked at again for a value that comes twice.
        """
        if relation not in self._statistics:
            df = self.frame(relation)
            n = len(df.columns)
            row = df.agg(F.count(F.lit(1)), *[f(f"c{i}") for i in range(n) for f in (F.min, F.max, F.approx_count_distinct)]).first()
            rows, rest = row[0], row[1:]
            near = [i for i in range(n) if self.explore and rows and rest[3 * i + 2] >= 0.8 * rows and (relation, i) not in self._declared]
            # a column at a time: a value that comes twice ends it, and no row is repeated for each column
            counted = {i: rows for i in near if df.groupBy(f"c{i}").agg(F.count("*").alias("n")).where(f"n > 1 OR c{i} IS NULL").isEmpty()}
            counted |= {i: rows for r, i in self._declared if r == relation}
            whole = lambda v: None if v is None else int(v)
            self._statistics[relation] = Statistics(rows, tuple(whole(rest[3 * i]) for i in range(n)), tuple(whole(rest[3 * i + 1]) for i in range(n)), tuple(counted.get(i, rest[3 * i + 2]) for i in range(n)), tuple(counted.get(i) == rows and rows > 0 for i in range(n)))
        return self._statistics[relation]

    def range_of(self, relation: int, position: int) -> tuple[int, int] | None:
        stats = self.statistics(relation)
        low, high = stats.low[position], stats.high[position]
        return None if low is None else (low, high)

    def contained(self, foreign: tuple[int, int], key: tuple[int, int]) -> bool:
        """Whether ``key`` = (relation, position) is unique and holds every value of ``foreign``; found from the data."""
        if (foreign, key) not in self._contained:
            out = self.explore and self.statistics(key[0]).unique[key[1]]
            if out:
                inner, outer = self.range_of(*foreign), self.range_of(*key)
                out = inner is None or outer is not None and outer[0] <= inner[0] and inner[1] <= outer[1]
            if out:
                left = self.frame(foreign[0]).select(F.col(f"c{foreign[1]}").alias("v"))
                right = self.frame(key[0]).select(F.col(f"c{key[1]}").alias("v"))
                out = left.where("v is null").isEmpty() and left.join(right, "v", "left_anti").isEmpty()
            self._contained[foreign, key] = out
        return self._contained[foreign, key]
