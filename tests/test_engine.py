import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyloom import queries as engine
from tallyloom.catalog import Catalog
from tallyloom.functions.unsigned import times
from tallyloom.operators import columns as ops
from tallyloom.plans.build import plan_query
from tallyloom.plans.normalize import normalize
from tallyloom.plans.order import order_bindings
from tallyloom.plans.spec import QueryError, parse_query
from tallyloom.session import BatchSession
from tallyloom.sources import files

STRATEGIES = [("naive", True), ("naive", False), ("factorized", True), ("factorized", False), ("auto", True)]


@pytest.fixture(scope="module")
def identity(spark):
    session = BatchSession(spark)
    for _ in range(5):
        session.catalog.add(files.generated(spark, 10, 3))
    return session


CASES = [
    ("1 2|0.0=1.1|1.2", "45"),
    ("0 2 3|0.0=1.1&1.2=2.0|2.2", "45"),
    ("0 1 4|0.0=1.1&1.2=2.0&1.1=4|1.0 2.2", "4 4"),
    ("0 1 2|0.0=1.1&1.2=2.0&1.1=100|1.0 2.2", "NULL NULL"),
    ("0 0|0.0=1.1|1.0", "45"),
    ("0 1 2|0.0=1.1&1.1=2.0&2.2=0.1|1.0", "45"),
    ("0 1 2 3|0.0=1.1&1.1=2.0&2.2=3.1|1.0", "45"),
    ("0 1 2 3|0.0=1.1&2.1=3.0&0.2=2.1|1.0", "45"),
    ("0 1|0.0=1.1&0.0=3&1.0=3|1.0", "3"),
    ("0 1|0.0=1.1&0.0<3&1.0>3|1.0", "NULL"),
    ("0 1|0.0=1.1&0.0>1&0.0<3|1.0", "2"),
    ("0|0.0=0|0.1", "0"),
    ("0||0.1 0.1", "45 45"),
    ("0|0.0=0.1&0.0>7|0.2", "17"),
    ("0 1|0.0=1.1&1.1=0.0|1.0", "45"),
]


@pytest.mark.parametrize("line,expected", CASES)
def test_small_joins(identity, line, expected):
    from tallyloom.session import result_line

    for strategy, rewrite in STRATEGIES:
        assert result_line(plan_query(parse_query(line), identity.catalog, strategy, rewrite)).first()[0] == expected


def test_disconnected(identity):
    with pytest.raises(QueryError):
        identity.answer("0 1|0.0=3|0.0")


def test_protocol(spark, tmp_path):
    for i in range(2):
        files.write_binary(files.generated(spark, 10, 3), str(tmp_path / f"r{i}"))
    lines = [str(tmp_path / "r0"), str(tmp_path / "r1"), "Done", "0 1|0.0=1.1|1.2", "0|0.0>100|0.0 0.1", "F", "1|0.0=4|0.0", "F"]
    assert list(BatchSession(spark).run(lines)) == ["45", "NULL NULL", "4"]


def test_unsigned(spark):
    top = (1 << 64) - 1
    df = spark.createDataFrame([(str(top), "1"), (str(top - 1), "2"), (str(1 << 63), "1")], "a string, b string").select(*[F.col(c).cast("decimal(20,0)").alias(c) for c in "ab"])
    catalog = Catalog(spark)
    catalog.add(df)
    catalog.add(spark.createDataFrame([(1,), (1,), (2,)], "k long"))
    for strategy, rewrite in STRATEGIES:
        row = plan_query(parse_query("0 1|0.1=1.0|0.0 1.0"), catalog, strategy, rewrite).first()
        assert int(row[0]) == (2 * top + top - 1 + 2 * (1 << 63)) % (1 << 64) and int(row[1]) == 6
        row = plan_query(parse_query(f"0|0.0>{1 << 63}|0.1"), catalog, strategy, rewrite).first()
        assert int(row[0]) == 3
    product = df.select(times(F.col("a"), F.col("a")).alias("p")).first()[0]
    assert int(product) == top * top % (1 << 64)


def test_random_queries(spark):
    rng = random.Random(5)
    catalog, con = Catalog(spark), duckdb.connect()
    for r in range(4):
        rows = [tuple(rng.randrange(6) for _ in range(3)) for _ in range(rng.randrange(1, 14))]
        if r == 3:
            rows = [(i, rng.randrange(6), rng.randrange(3)) for i in range(6)]  # c0 is a key
        catalog.add(spark.createDataFrame(rows, "a long, b long, c long"))
        con.execute(f"CREATE TABLE r{r} (c0 BIGINT, c1 BIGINT, c2 BIGINT)")
        con.executemany(f"INSERT INTO r{r} VALUES (?, ?, ?)", rows)
    for _ in range(25):
        n = rng.randrange(1, 5)
        relations = [rng.randrange(4) for _ in range(n)]
        joins = [f"{rng.randrange(b)}.{rng.randrange(3)}={b}.{rng.randrange(3)}" for b in range(1, n)]
        if n > 2 and rng.random() < 0.3:
            joins.append(f"0.{rng.randrange(3)}={n - 1}.{rng.randrange(3)}")
        filters = [f"{rng.randrange(n)}.{rng.randrange(3)}{rng.choice('<>=')}{rng.randrange(6)}" for _ in range(rng.randrange(3))]
        spec = parse_query(f"{' '.join(map(str, relations))}|{'&'.join(joins + filters)}|{' '.join(f'{rng.randrange(n)}.{rng.randrange(3)}' for _ in range(2))}")
        expected = con.execute(spec.to_sql(aliases=True, cast="BIGINT")).fetchall()[0]
        for strategy, rewrite in (("naive", False), ("auto", True), ("factorized", True)):
            got = plan_query(spec, catalog, strategy, rewrite).first()
            assert tuple(None if v is None else int(v) for v in got) == expected, (spec.to_text(), strategy)


def test_elimination_is_found_in_the_data(spark):
    catalog = Catalog(spark)
    catalog.add(spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "k long, v long"))
    catalog.add(spark.createDataFrame([(1,), (2,), (3,)], "k long"))
    catalog.add(spark.createDataFrame([(1,), (3,)], "k long"))
    assert normalize(parse_query("0 1|0.0=1.0&1.0<2|0.1 1.0"), catalog).dropped == [1]
    assert normalize(parse_query("0 2|0.0=1.0|0.1"), catalog).dropped == []
    assert normalize(parse_query("0 1|0.0=1.0&0.1>100|0.1"), catalog).impossible
    assert set(order_bindings(parse_query("0 1 2|0.0=1.0&1.0=2.0|0.1"), catalog)) == {0, 1, 2}


def test_binary_files(spark, tmp_path):
    path = str(tmp_path / "r")
    df = files.generated(spark, 1000, 5)
    files.write_binary(df, path)
    assert files.read_header(path) == (1000, 5)
    assert sorted(files.read_binary(spark, path, split_rows=300).collect()) == sorted(df.collect())
    files.write_binary(files.generated(spark, 0, 0).select(F.lit(1).alias("c0")).where("c0 = 2"), path)
    assert files.read_binary(spark, path).count() == 0
    big = str(tmp_path / "big")
    with open(big, "wb") as f:
        f.write(struct.pack("<QQQQ", 2, 1, (1 << 64) - 1, 7))
    assert sorted(int(r[0]) for r in files.read_binary(spark, big).collect()) == [7, (1 << 64) - 1]
    with open(big, "wb") as f:
        f.write(b"short")
    with pytest.raises(files.FormatError):
        files.read_header(big)


def test_text_files(spark, tmp_path):
    files.store_all(files.generated(spark, 20, 2), str(tmp_path), 3)
    lines = sorted((r[0] for r in spark.read.text(str(tmp_path / "r3.tbl")).collect()), key=lambda x: int(x.split("|")[0]))
    assert lines == [f"{i}|{i}|" for i in range(20)]
    assert files.read_relation(spark, str(tmp_path / "r3.tbl")).agg(F.sum("c1")).first()[0] == 190
    assert open(tmp_path / "r3.sql").read() == "CREATE TABLE r3 (c0 bigint,c1 bigint);\ncopy r3 from 'r3.tbl' delimiter '|';\n"


def test_operators(spark):
    df = spark.createDataFrame([(1, 4), (2, 4), (3, 5)], "a long, b long")
    assert [tuple(r) for r in ops.column_statistics(df).select("column", "low", "high", "distinct_values", "is_unique").collect()] == [("a", 1, 3, 3, True), ("b", 4, 5, 2, False)]
    assert tuple(ops.sort_order(df, "b", "a").first()) == (True, False)
    assert tuple(ops.key_containment(df, "b", df, "a").first()) == (True, 3)


def test_streamed_requests(spark, identity, tmp_path):
    from tallyloom.streaming.requests import request_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1 2|0.0=1.1|1.2\nF\n0|0.0=3|0.1\n")
    request_stream(identity, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r["answer"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["3", "45"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["s0", "s1", "s2"]
    assert set(engine.oracle_sql()) == set(engine.queries())


def test_queries_without_the_training_data_folders(tmp_path):
    """The entry works where the training-data folders, and with or without them their pipeline, are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/tallyloom", tmp_path / "tallyloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path / name)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) == set(q) and 'pipeline' not in q, q; print(len(q))"
    for _ in range(2):
        ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
        assert ran.returncode == 0, ran.stderr
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_columns_and_filters_reach_the_binary_reader(spark, tmp_path):
    path = str(tmp_path / "parts")
    df = files.generated(spark, 1000, 3).select("c0", (F.col("c1") * 2).alias("c1"), F.expr("CAST(18446744073709551615 AS DECIMAL(20,0)) - c2").alias("c2"))
    files.write_binary_parts(df, path, part_rows=300)
    assert len(files.relation_files(path)) >= 4
    read = files.read_binary(spark, path)
    assert dict(read.dtypes) == {"c0": "bigint", "c1": "bigint", "c2": "decimal(20,0)"}
    assert sorted(map(tuple, read.collect())) == sorted(tuple(r) for r in df.collect())
    assert sorted(r[0] for r in files.read_binary(spark, path, columns=[1], unsigned=False).where("c1 > 10 AND c1 < 20").collect()) == [12, 14, 16, 18]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = files.read_binary(spark, path, columns=[1, 0]).where("c1 > 10 AND c1 < 20 AND c0 <> 8")
        assert "c1 > 10" not in pushed._jdf.queryExecution().executedPlan().toString().split("Filter")[1].split("\n")[0]
        assert sorted(r[0] for r in pushed.collect()) == [12, 14, 18]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="whole numbers"):
        files.write_binary(spark.createDataFrame([(-1,)], "a long"), str(tmp_path / "negative"))


def test_layouts(spark, tmp_path):
    from tallyloom.operators import layout

    df = spark.range(20_000).select(F.col("id").alias("c0"), (F.col("id") % 97).alias("c1"))
    stored = layout.write_sorted(df, str(tmp_path / "sorted"), "c0", ("c1",), files=4)
    narrow = stored.where("c0 > 100 AND c0 < 200")
    assert "GreaterThan(c0,100)" in narrow._jdf.queryExecution().executedPlan().toString() and narrow.count() == 99
    lows = sorted(r[0] for r in stored.groupBy(F.input_file_name()).agg(F.min("c0"), F.max("c0")).select("min(c0)").collect())
    assert len(lows) == 4 and lows[1] > 200  # three files of four hold nothing of the range
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = (layout.write_bucketed(df, f"bucketed_{n}", "c0", 4, str(tmp_path / f"b{n}")) for n in "ab")
        joined = a.join(b, "c0").groupBy("c0").count()
        assert joined.count() == 20_000 and "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [t for _, t in layout.compressed(df.where("c0 < 300")).dtypes] == ["smallint", "tinyint"]


def test_files_and_buckets_follow_the_rows(spark, monkeypatch):
    """What one task sorts doesn't grow with the table."""
    from tallyloom.operators import layout

    monkeypatch.setattr(layout, "ROWS_A_PART", 100, raising=False)
    written = {}
    for name, at in (("write_bucketed", 3), ("write_sorted", None)):
        plain = getattr(layout, name)
        monkeypatch.setattr(layout, name, lambda df, *a, plain=plain, at=at, **b: written.setdefault(a[at - 1] if at else b["files"], []).append(df.count()) or plain(df, *a, **b))
    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    sql = "SELECT l_orderkey, count(*), sum(l_partkey)::BIGINT FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"
    assert sorted(map(tuple, engine.queries()["bucketed_join"](spark, folder).collect())) == sorted(con.execute(sql).fetchall())
    (buckets, rows), = written.items()  # the same number for both
    assert len(rows) == 2 and max(rows) <= 100 * buckets
    written.clear()
    assert engine.queries()["sorted_layout"](spark, folder).where("filter = 'point'").count() == con.execute("SELECT count(*) FROM lineitem WHERE l_partkey = 77").fetchall()[0][0]
    (files_, rows), = written.items()
    assert max(rows) <= 100 * files_
    assert layout.parts(8, spark.range(799)) == 8 and layout.parts(8, spark.range(10), spark.range(901)) == 10


def test_catalog_keeps_and_forgets(spark, tmp_path):
    catalog = Catalog(spark, reuse=True)
    many = spark.range(400).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    catalog.add(many)
    catalog.add(many.limit(300))
    spec = parse_query("0 1|0.0=1.0|0.1 1.1")
    expected = tuple(map(int, plan_query(spec, catalog, "naive").first()))
    for _ in range(2):
        assert tuple(map(int, plan_query(spec, catalog, "factorized").first())) == expected
    assert catalog._aggregated and "InMemoryTableScan" in plan_query(spec, catalog, "factorized")._jdf.queryExecution().executedPlan().toString()
    catalog.store(0, str(tmp_path / "stored"), by=1, bloom=(0,))
    assert tuple(map(int, plan_query(spec, catalog).first())) == expected
    catalog.drop(1)
    with pytest.raises(KeyError):
        catalog.frame(1)
    assert not [k for k in catalog._aggregated if k[0] == 1] and not spark.catalog.tableExists("r1")
    plain = Catalog(spark, explore=False)
    plain.add(spark.createDataFrame([(1, 5), (2, 6)], "k long, v long"))
    plain.add(spark.createDataFrame([(1,), (2,)], "k long"))
    assert normalize(parse_query("0 1|0.0=1.0|0.1"), plain).dropped == []
    plain.declare_contained((0, 0), (1, 0))
    assert normalize(parse_query("0 1|0.0=1.0|0.1"), plain).dropped == [1]


def test_skewed_key_is_factorized(spark):
    """One hot key below a mean of two rows a key still multiplies."""
    from tallyloom.plans.build import rows_bound, worth_factorizing
    from tallyloom.plans.normalize import Classes

    catalog = Catalog(spark)
    for _ in range(2):
        catalog.add(spark.range(600).select(F.when(F.col("id") < 500, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("v")).select(F.abs("k").alias("k"), "v"))
    spec = parse_query("0 1|0.0=1.0|0.1 1.1")
    assert worth_factorizing(spec, catalog)
    unique = parse_query("0 1|0.1=1.1|0.0 1.0")
    assert not worth_factorizing(unique, catalog) and rows_bound(unique, catalog, Classes(unique.joins)) == 600
    assert rows_bound(spec, catalog, Classes(spec.joins)) == 360_000


def made_rows(spark, df):
    """What a plan answers, and the rows of its largest join."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        answer, todo, made = df.collect()[0], [df._jdf.queryExecution().executedPlan()], [0]
        while todo:
            plan = todo.pop()
            if "Join" in plan.nodeName():
                made.append(plan.metrics().apply("numOutputRows").value())
            todo += [plan.children().apply(i) for i in range(plan.children().size())]
        return tuple(None if v is None else int(v) for v in answer), max(made)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_naive_joins_do_not_multiply(spark):
    """Equal keys on both sides meet once, in trees and in cyclic graphs, and with a hint."""
    catalog, con = Catalog(spark), duckdb.connect()
    for r, (rows, keys) in enumerate(((900, 5), (700, 5), (600, 4), (5, 5))):
        # few keys; c2 has nulls and one side a key that is null
        catalog.add(spark.range(rows).selectExpr(f"if(id = 50, null, id % {keys}) AS a", f"id div {keys} % 3 AS b", "if(id % 10 = 0, null, id) AS c"))
        con.execute(f"CREATE TABLE r{r} AS SELECT CASE WHEN id <> 50 THEN id % {keys} END AS c0, id // {keys} % 3 AS c1, CASE WHEN id % 10 <> 0 THEN id END AS c2 FROM range({rows}) x(id)")
    for line in ("0 1|0.0=1.0|0.2 1.2 0.1", "0 3 1|0.0=1.0&0.0=2.0|0.2 2.2 1.2", "0 1 2|0.0=1.0&1.1=2.1&2.0=0.0|0.2 1.2 2.2", "0 1 2|0.0=1.0&1.1=2.0&2.1=0.1|0.2 1.2 2.2", "0 1|0.0=1.0&0.2<0|0.2"):
        spec = parse_query(line)
        expected = con.execute(spec.to_sql(aliases=True, cast="BIGINT")).fetchall()[0]
        for hint in (None, "merge"):
            answer, made = made_rows(spark, plan_query(spec, catalog, "naive", False, hint))
            assert answer == expected and made <= 900, (line, hint, made)  # no more than the largest side


def test_statistics_follow_the_files(spark, tmp_path):
    for name, names in engine.TABLES:
        spark.createDataFrame([tuple(1 for _ in names)], ", ".join(f"{c} long" for c in names)).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert engine.queries()["scan_sum"](spark, str(tmp_path)).first()[0] == 1
    assert engine.catalog(spark, str(tmp_path)).range_of(6, 0) == (1, 1)
    spark.createDataFrame([(5, 1, 1, 1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long").write.mode("append").parquet(str(tmp_path / "lineitem.parquet"))
    assert engine.catalog(spark, str(tmp_path)).range_of(6, 0) == (1, 5)


def test_explain(spark, identity):
    from tallyloom.plans.explain import explain, to_dot

    text = explain(parse_query("0 1 2|0.0=1.1&1.2=2.0&0.1<7|1.2"), identity.catalog)
    assert "rewritten" in text and "at most" in text
    dot = to_dot(parse_query("0 1 2|0.0=1.1&1.2=2.0&0.1<7|1.2"), identity.catalog)
    assert dot.startswith("graph query {") and dot.count(" -- ") == 2
    assert to_dot(parse_query("0 1 2|0.0=1.0&1.1=2.1&2.2=0.2|1.0"), identity.catalog).count(" -- ") == 3


def test_many_bindings(identity):
    """Beyond the exhaustive orders: fourteen bindings."""
    chain = "&".join(f"{i}.0={i + 1}.0" for i in range(13))
    assert identity.answer(f"{' '.join(str(i % 5) for i in range(14))}|{chain}&0.1<4|13.1") == "6"


def test_sort_order_over_tasks(spark):
    df = spark.range(5000).select(F.col("id").alias("p"), F.floor(F.col("id") / 3).alias("v"), (-F.col("id")).alias("w"), (F.col("id") % 7).alias("x")).repartition(5)
    assert [tuple(ops.sort_order(df, c, "p").first()) for c in "vwx"] == [(True, False), (False, True), (False, False)]
    assert tuple(ops.sort_order(df.limit(0), "v", "p").first()) == (True, True)


@pytest.mark.skipif("WORKLOAD_DIR" not in __import__("os").environ, reason="WORKLOAD_DIR names no folder with *.init, *.work and *.result")
def test_workload(spark):
    """Every query of a workload whose relations are there, in its batches, against its stored answers."""
    import glob
    import os

    folder = os.environ["WORKLOAD_DIR"]
    read = lambda ending: open(glob.glob(f"{folder}/*.{ending}")[0]).read().split("\n")
    names, answers = [x.strip() for x in read("init") if x.strip()], iter(x.strip() for x in read("result") if x.strip())
    there = {i: f"{folder}/{n}.tbl" for i, n in enumerate(names) if n != "Done" and os.path.exists(f"{folder}/{n}.tbl")}
    session = BatchSession(spark)
    for number, path in there.items():
        session.catalog.register(number, files.read_relation(spark, path))
    batch, wanted, seen = [], [], 0
    for line in (x.strip() for x in read("work") if x.strip()):
        if line == "F":
            assert session.batch(batch) == wanted
            seen += len(batch)
            batch, wanted = [], []
        else:
            answer = next(answers)
            if set(parse_query(line).relations) <= set(there):
                batch.append(line)
                wanted.append(answer)
    assert seen + len(batch) > 0 and (not batch or session.batch(batch) == wanted)
    print(seen, "answers")
