"""The request protocol: relation files, ``Done``, then batches of queries that ``F`` ends."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .functions.unsigned import shown
from .plans.build import plan_query
from .plans.order import estimate_cost
from .plans.spec import parse_query


def result_line(df: DataFrame) -> DataFrame:
    """The sums of a query as one text column ``value``, separated by blanks."""
    return df.select(F.concat_ws(" ", *[shown(F.col(c)) for c in df.columns]).alias("value"))


class BatchSession:
    """Answers queries over a catalog; a batch's queries run together and come back in order.

    Queries of a batch are jobs of one scheduler pool each, so with fair
    scheduling a short query doesn't wait behind a long one.  They are submitted
    longest first, by estimated rows, so that the longest doesn't run on alone at
    the end.  Relations load together, and keep the numbers of their order.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, parallel: int = 8, strategy: str = "auto", load: Callable[[SparkSession, str], DataFrame] | None = None):
        self.spark, self.catalog, self.parallel, self.strategy = spark, catalog or Catalog(spark, reuse=True), parallel, strategy
        if load is None:
            from .sources.files import read_relation

            load = read_relation
        self.load = load

    def answer(self, line: str) -> str:
        return result_line(plan_query(parse_query(line), self.catalog, self.strategy)).first()[0]

    def batch(self, lines: list[str]) -> list[str]:
        """Answers in the order of the queries."""
        if len(lines) < 2:
            return [self.answer(x) for x in lines]
        wanted = sorted({r for x in lines for r in parse_query(x).relations})
        with ThreadPoolExecutor(self.parallel) as pool:
            list(pool.map(self.catalog.statistics, wanted))  # once, before the queries race for it
        order = sorted(range(len(lines)), key=lambda i: -self._cost(lines[i]))
        with ThreadPoolExecutor(min(self.parallel, len(lines))) as pool:
            answers = dict(zip(order, pool.map(self._pooled, ((i, lines[i]) for i in order))))
        return [answers[i] for i in range(len(lines))]

    def _cost(self, line: str) -> float:
        spec = parse_query(line)
        spec.check(self.catalog.width)
        return estimate_cost(spec, self.catalog)

    def _pooled(self, item: tuple[int, str]) -> str:
        out: list = []

        def work() -> None:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"query-{item[0] % self.parallel}")
            try:
                out.append((self.answer(item[1]), None))
            except Exception as e:  # noqa: BLE001  handed to the caller's thread
                out.append((None, e))

        thread = InheritableThread(target=work)
        thread.start()
        thread.join()
        answer, error = out[0]
        if error is not None:
            raise error
        return answer

    def run(self, lines: Iterable[str]) -> Iterator[str]:
        """Read names up to ``Done``, then answer each batch when its ``F`` comes (or the input ends)."""
        loading, queries, names = True, [], []
        for line in (x.strip() for x in lines):
            if not line:
                continue
            if loading:
                if line != "Done":
                    names.append(line)
                    continue
                loading = False
                with ThreadPoolExecutor(self.parallel) as pool:
                    for loaded in pool.map(lambda name: self.load(self.spark, name), names):
                        self.catalog.add(loaded)
            elif line == "F":
                yield from self.batch(queries)
                queries = []
            else:
                queries.append(line)
        if queries:
            yield from self.batch(queries)
