"""``python -m tallyloom.cli sql`` turns queries on stdin into SQL; ``run`` speaks the request protocol; ``explain`` and ``dot`` read the protocol and tell the queries' plans."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from .plans.spec import parse_query


def to_sql(lines: Iterable[str]) -> Iterator[str]:
    for line in lines:
        if line.strip() and line.strip() != "F":
            yield parse_query(line).to_sql()


def main(argv: list[str]) -> int:
    if argv == ["sql"]:
        for out in to_sql(sys.stdin):
            print(out)
        return 0
    if argv == ["run"]:
        from pyspark.sql import SparkSession

        from .session import BatchSession

        spark = SparkSession.builder.appName("tallyloom").config("spark.scheduler.mode", "FAIR").getOrCreate()
        for out in BatchSession(spark).run(sys.stdin):
            print(out, flush=True)
        return 0
    if argv in (["explain"], ["dot"]):
        from pyspark.sql import SparkSession

        from .catalog import Catalog
        from .plans.explain import explain, to_dot
        from .sources.files import read_relation

        spark = SparkSession.builder.appName("tallyloom").getOrCreate()
        catalog, show, names = Catalog(spark), explain if argv == ["explain"] else to_dot, True
        for line in filter(None, map(str.strip, sys.stdin)):
            if names and line != "Done":
                catalog.add(read_relation(spark, line))
            elif not names and line != "F":
                print(show(parse_query(line), catalog), flush=True)
            names = names and line != "Done"
        return 0
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
