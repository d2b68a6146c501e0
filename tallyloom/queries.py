"""The driver's tables as relations, and its queries with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .operators import columns as ops
from .operators import layout
from .plans.build import plan_query
from .plans.spec import parse_query
from .session import result_line
from .sources import files
from .sources.shared import file_marks, fresh_path

#: Relation number = position; the integral columns of each table.
TABLES = [
    ("region", ["r_regionkey"]),
    ("nation", ["n_nationkey", "n_regionkey"]),
    ("customer", ["c_custkey", "c_nationkey"]),
    ("supplier", ["s_suppkey", "s_nationkey"]),
    ("part", ["p_partkey", "p_size"]),
    ("orders", ["o_orderkey", "o_custkey"]),
    ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]),
    ("events", ["event_id", "user_id"]),
    ("documents", ["doc_id", "n_chars"]),
    ("labels", ["doc_id", "quality", "toxic"]),
    ("conversations", ["conv_id", "turn"]),
    ("embeddings", ["vec_id", "label"]),
    ("pages", ["page_id"]),
    ("benchmark", ["item_id"]),
]
_catalogs: dict[tuple[str, str], tuple[tuple, Catalog]] = {}


def relation(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    name, names = TABLES[number]
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*[F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(names)])


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The tables of a folder, with statistics as they are asked for; loaded anew where a file has changed."""
    marks = tuple(m for name, _ in TABLES for m in file_marks(spark, f"{sf_dir}/{name}.parquet"))
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _catalogs or _catalogs[key][0] != marks:
        found = Catalog(spark)
        for number in range(len(TABLES)):
            found.register(number, relation(spark, sf_dir, number), view=False)
        _catalogs[key] = (marks, found)
    return _catalogs[key][1]


#: name -> (query, strategy, rewrite, hint)
TEXTS: dict[str, tuple[str, str, bool, str | None]] = {
    "scan_sum": ("6||0.0 0.1", "auto", True, None),
    "filter_eq": ("6|0.1=10|0.0", "auto", True, None),
    "filter_lt": ("6|0.0<1000|0.1", "auto", True, None),
    "filter_gt": ("6|0.0>1000|0.1", "auto", True, None),
    "filter_range": ("6|0.0>100&0.0<2000|0.2", "auto", True, None),
    "range_reduction": ("6|0.0>100&0.0>300&0.0<5000&0.0<2000|0.2 0.3", "auto", True, None),
    "hash_join": ("6 5|0.0=1.0|0.1 1.1", "naive", True, None),
    "merge_join": ("6 5|0.0=1.0|0.1 1.1", "naive", False, "merge"),
    "broadcast_join": ("6 3|0.2=1.0|0.1 1.1", "naive", False, "broadcast"),
    "shuffle_hash_join": ("6 5|0.0=1.0|0.1 1.1", "naive", False, "shuffle_hash"),
    "residual_filter": ("6 5 2|0.0=1.0&1.1=2.0&0.3=2.1|0.0", "naive", True, None),
    "multi_key_join": ("6 6|0.0=1.0&0.3=1.3|0.1 1.2", "naive", True, None),
    "self_relation_join": ("1 1|0.1=1.1|0.0 1.0", "naive", True, None),
    "same_binding_filter": ("4 6|0.0=0.1&0.0=1.1|1.0", "auto", True, None),
    "star_4way": ("6 5 4 3|0.0=1.0&0.1=2.0&0.2=3.0|0.0 1.1", "auto", True, None),
    "star_filtered": ("6 5 4 3|0.0=1.0&0.1=2.0&0.2=3.0&2.1<10&3.1=3|0.0 1.1 2.0", "naive", True, None),
    "chain_4way": ("6 5 2 1|0.0=1.0&1.1=2.0&2.1=3.0|3.1", "naive", True, None),
    "cyclic": ("2 3 1|0.1=1.1&1.1=2.0&0.1=2.0|0.0 1.0", "naive", True, None),
    "permuted_predicates": ("1 2 5 6|2.0=3.0&0.0=1.1&2.1=1.0|3.1 0.1", "naive", True, None),
    "empty_null": ("6 5|0.0=1.0&0.0>1000000000|0.0", "auto", True, None),
    "empty_null_unrewritten": ("6 5|0.0=1.0&0.0>1000000000|0.0", "naive", False, None),
    "contradiction": ("6 5|0.0=1.0&0.0<3&1.0>3|1.0", "auto", True, None),
    "impossible_constant": ("6|0.3=5000000|0.0 0.1", "auto", True, None),
    "unsigned_constant": ("6|0.0<18446744073709551615&0.0>0|0.1", "auto", True, None),
    "zero_sum": ("0|0.0=0|0.0", "auto", True, None),
    "dup_selection": ("6 5|0.0=1.0|0.1 0.1", "auto", True, None),
    "dup_predicate": ("6 5|0.0=1.0&1.0=0.0|0.1", "auto", True, None),
    "equal_columns_sum": ("6 5|0.0=1.0|0.0 1.0 0.1", "auto", True, None),
    "constant_propagation": ("5 6|0.0=1.0&0.0=7|1.1 0.1", "auto", True, None),
    "transitive_filter": ("6 5 2|0.0=1.0&1.1=2.0&2.0<50|0.1 2.1", "naive", True, None),
    "fk_elimination": ("6 5|0.0=1.0|0.1", "auto", True, None),
    "fk_elimination_filter": ("6 5|0.0=1.0&1.0<500|0.1 1.0", "auto", True, None),
    "multiway_factorized": ("2 3 1|0.1=1.1&0.1=2.0|0.0 1.0 2.1", "factorized", True, None),
    "multiway_naive": ("2 3 1|0.1=1.1&0.1=2.0|0.0 1.0 2.1", "naive", True, None),
    "chain_factorized": ("6 5 2 1|0.0=1.0&1.1=2.0&2.1=3.0|3.1 0.1 1.0", "factorized", False, None),
    "fkpk_scan_aggregate": ("4 6|0.0=1.1&0.0=15|0.1 1.0", "factorized", False, None),
    "tree_factorized": ("2 3 1 5|0.1=1.1&1.1=2.0&0.0=3.1|1.0 3.0 0.0", "factorized", False, None),
    "many_to_many_factorized": ("2 3|0.1=1.1|0.0 1.0", "factorized", False, None),
    "many_to_many_naive": ("2 3|0.1=1.1|0.0 1.0", "naive", False, None),
    "labels_documents": ("8 9|0.0=1.0&1.1=1|0.1 1.2", "auto", True, None),
}


def _dialect(text: str, strategy: str, rewrite: bool, hint: str | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = plan_query(parse_query(text), catalog(spark, sf_dir), strategy, rewrite, hint)
        return df.select(*[F.col(c).cast("long").alias(c) for c in df.columns])

    return run


def with_relations(sql: str) -> str:
    """SQL over r0, r1, ... as SQL over the driver's tables."""
    parts = [f"r{i} AS (SELECT {', '.join(f'CAST({c} AS BIGINT) AS c{k}' for k, c in enumerate(names))} FROM {name})" for i, (name, names) in enumerate(TABLES)]
    return f"WITH {', '.join(parts)} {sql.rstrip(';')}"


def _r(number: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: relation(spark, sf_dir, number)


def _result_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = result_line(plan_query(parse_query("6 5|0.0=1.0|0.1 1.1"), catalog(spark, sf_dir)))
    two = result_line(plan_query(parse_query("6 5|0.0=1.0&0.0>1000000000|0.1 1.1"), catalog(spark, sf_dir)))
    return one.withColumn("query", F.lit(0)).unionByName(two.withColumn("query", F.lit(1)))


def _written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through the binary format: written as files of their own columns, read back with two columns and a filter."""
    path = fresh_path(spark, "binary").removeprefix("file://")
    files.write_binary_parts(relation(spark, sf_dir, 5), path, part_rows=5_000)
    return files.read_binary(spark, path, columns=[0, 1]).where("c0 > 100 AND c0 < 4000").select("c1", "c0")


def _delimited_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "delimited")
    files.write_delimited(relation(spark, sf_dir, 2), path)
    return files.read_delimited(spark, path, 2)


def _sorted_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem stored along its first key with a Bloom filter on the second: a range and a point filter."""
    lineitem = relation(spark, sf_dir, 6)
    stored = layout.write_sorted(lineitem, fresh_path(spark, "sorted"), "c0", ("c1",), files=layout.parts(8, lineitem))
    return stored.where("c0 > 1000 AND c0 < 1400").select(F.lit("range").alias("filter"), "c0", "c1", "c3").unionByName(stored.where("c1 = 77").select(F.lit("point").alias("filter"), "c0", "c1", "c3"))


def _bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem and orders in buckets of the order key: joined and grouped without a shuffle."""
    frames = [relation(spark, sf_dir, n) for n in (6, 5)]
    buckets = layout.parts(8, *frames)
    left, right = (layout.write_bucketed(df, f"tallyloom_bucketed_{uuid.uuid4().hex}", "c0", buckets, fresh_path(spark, "bucketed")) for df in frames)
    return left.alias("l").join(right.alias("o"), F.col("l.c0") == F.col("o.c0")).groupBy(F.col("o.c0").alias("key")).agg(F.count("*").alias("n"), F.sum("l.c1").alias("parts"))


def _stored_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A many-to-many join answered from counts and sums a key that the catalog keeps."""
    found = Catalog(spark, reuse=True)
    for number in range(len(TABLES)):
        found.register(number, relation(spark, sf_dir, number), view=False)
    df = plan_query(parse_query("2 3|0.1=1.1|0.0 1.0"), found, "factorized")
    return df.select(*[F.col(c).cast("long").alias(c) for c in df.columns])


def _statistics_sql() -> str:
    parts = [f"SELECT 'c{k}' AS \"column\", count(*) AS rows, min(c{k}) AS low, max(c{k}) AS high, count(DISTINCT c{k}) AS distinct_values FROM r6" for k in range(4)]
    return f"SELECT *, rows = distinct_values AS is_unique, high - low + 1 AS domain, CAST(high - low + 1 AS DOUBLE) / distinct_values AS spread FROM ({' UNION ALL '.join(parts)})"


HELPERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "column_pruned_scan": (lambda s, d: relation(s, d, 6).select("c0", "c3"), "SELECT c0, c3 FROM r6"),
    "filtered_rows": (lambda s, d: relation(s, d, 6).where("c0 > 100 AND c0 < 400 AND c3 = 2"), "SELECT * FROM r6 WHERE c0 > 100 AND c0 < 400 AND c3 = 2"),
    "stats_columns": (lambda s, d: ops.column_statistics(relation(s, d, 6)), _statistics_sql()),
    "unique_check": (lambda s, d: ops.column_statistics(relation(s, d, 5)).select("column", "is_unique"), "SELECT 'c0' AS \"column\", count(*) = count(DISTINCT c0) AS is_unique FROM r5 UNION ALL SELECT 'c1', count(*) = count(DISTINCT c1) FROM r5"),
    "pkfk_check": (lambda s, d: ops.key_containment(relation(s, d, 6), "c0", relation(s, d, 5), "c0"), "SELECT (SELECT count(*) = count(DISTINCT c0) FROM r5) AS key_is_unique, count(*) AS missing FROM r6 WHERE c0 NOT IN (SELECT c0 FROM r5)"),
    "existence_map": (lambda s, d: ops.existence(relation(s, d, 6), "c1"), "SELECT DISTINCT c1 AS key FROM r6"),
    "key_count_vector": (lambda s, d: ops.key_counts(relation(s, d, 6), "c1"), "SELECT c1 AS key, count(*) AS n FROM r6 GROUP BY 1"),
    "aggregate_index": (lambda s, d: ops.aggregate_index(relation(s, d, 6), "c0", ["c1", "c2"]), "SELECT c0 AS key, count(*) AS n, CAST(sum(c1) AS BIGINT) AS sum_c1, CAST(sum(c2) AS BIGINT) AS sum_c2 FROM r6 GROUP BY 1"),
    "duplication": (lambda s, d: ops.duplication(relation(s, d, 6), "c2"), "SELECT count(*) AS rows, count(DISTINCT c2) AS distinct_values, CAST(count(*) AS DOUBLE) / count(DISTINCT c2) AS duplicates FROM r6"),
    "sort_order_check": (lambda s, d: ops.sort_order(relation(s, d, 5), "c0", "c0"), "SELECT true AS ascending, count(*) <= 1 AS descending FROM r5"),
    "semi_join_reduction": (lambda s, d: ops.semi_reduce(relation(s, d, 5), "c1", relation(s, d, 2).where("c1 = 3"), "c0").select("c0", "c1"), "SELECT c0, c1 FROM r5 WHERE c1 IN (SELECT c0 FROM r2 WHERE c1 = 3)"),
    "counted_relation": (lambda s, d: ops.counted(relation(s, d, 6), ["c2", "c3"]), "SELECT c2, c3, count(*) AS n FROM r6 GROUP BY 1, 2"),
    "range_partitions": (lambda s, d: ops.range_partitions(relation(s, d, 6), "c0", 8), "WITH b AS (SELECT min(c0) AS lo, greatest(1, (max(c0) - min(c0) + 8) // 8) AS w FROM r6) SELECT (c0 - lo) // w AS part, min(c0) AS low, max(c0) AS high, count(*) AS rows FROM r6, b GROUP BY 1"),
    "binary_round_trip": (_written_and_read, "SELECT c1, c0 FROM r5 WHERE c0 > 100 AND c0 < 4000"),
    "delimited_round_trip": (_delimited_and_read, "SELECT c0, c1 FROM r2"),
    "sorted_layout": (_sorted_layout, "SELECT 'range' AS filter, c0, c1, c3 FROM r6 WHERE c0 > 1000 AND c0 < 1400 UNION ALL SELECT 'point', c0, c1, c3 FROM r6 WHERE c1 = 77"),
    "bucketed_join": (_bucketed_join, "SELECT y.c0 AS key, count(*) AS n, CAST(sum(x.c1) AS BIGINT) AS parts FROM r6 x, r5 y WHERE x.c0 = y.c0 GROUP BY 1"),
    "stored_aggregates": (_stored_aggregates, "SELECT CAST(sum(x.c0) AS BIGINT) AS s0, CAST(sum(y.c0) AS BIGINT) AS s1 FROM r2 x, r3 y WHERE x.c1 = y.c1"),
    "compressed_columns": (lambda s, d: layout.compressed(relation(s, d, 6).where("c0 < 500")).select("c0", "c3"), "SELECT CAST(c0 AS SMALLINT) AS c0, CAST(c3 AS TINYINT) AS c3 FROM r6 WHERE c0 < 500"),
    "result_lines": (_result_line, "SELECT concat_ws(' ', coalesce(CAST(a AS VARCHAR), 'NULL'), coalesce(CAST(b AS VARCHAR), 'NULL')) AS value, query FROM (SELECT sum(x.c1) AS a, sum(y.c1) AS b, 0 AS query FROM r6 x, r5 y WHERE x.c0 = y.c0 UNION ALL SELECT sum(x.c1), sum(y.c1), 1 FROM r6 x, r5 y WHERE x.c0 = y.c0 AND x.c0 > 1000000000)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _dialect(*spec) for name, spec in TEXTS.items()} | {name: run for name, (run, _) in HELPERS.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: with_relations(parse_query(spec[0]).to_sql(aliases=True, cast="BIGINT")) for name, spec in TEXTS.items()}
    for name, (_, sql) in HELPERS.items():
        base = with_relations("").rstrip()
        out[name] = f"{base}, {sql[5:]}" if sql.startswith("WITH ") else f"{base} {sql}"
    return out
