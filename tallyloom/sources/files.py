"""Relation files: the binary column format, delimited text, DDL and generated relations.

Binary: rows and columns as unsigned 64-bit little-endian numbers, then each
column's values as one array.  A table is read as partitions of row ranges, each
seeking its slice of the wanted columns; only the header is read on the driver.
It is written by tasks that each fill their own slices of one file, or as a
folder of such files, one a task, which no two tasks share.

Paths are local, or addresses of a file system that Arrow knows (s3://, hdfs://,
gs://, file://).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, InputPartition, LessThan

from .shared import delete_path, fresh_path

HEADER, HEADER_SIZE = "<QQ", 16  # rows, columns


class FormatError(ValueError):
    """A file isn't a relation."""


def _located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def relation_files(path: str) -> list[str]:
    """The files of a relation: itself, or those of a folder in the order of their names."""
    system, place = _located(path)
    info = system.get_file_info(place)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FormatError(f"{path}: no such file")
    if info.type != pyarrow.fs.FileType.Directory:
        return [path]
    inside = system.get_file_info(pyarrow.fs.FileSelector(place))
    head = path[: len(path) - len(place)] if "://" in path else ""
    return [head + x.path for x in sorted(inside, key=lambda x: x.path) if x.is_file and not x.base_name.startswith(("_", "."))]


def read_header(path: str) -> tuple[int, int]:
    """(rows, columns) of one file, checked against its size."""
    system, place = _located(path)
    size = system.get_file_info(place).size or 0
    if size < HEADER_SIZE:
        raise FormatError(f"{path}: {size} bytes are no header")
    with system.open_input_file(place) as f:
        rows, columns = struct.unpack(HEADER, f.read(HEADER_SIZE))
    if size != HEADER_SIZE + 8 * rows * columns:
        raise FormatError(f"{path}: {rows} x {columns} values don't fit {size} bytes")
    return rows, columns


class _Rows(InputPartition):
    def __init__(self, path: str, rows: int, begin: int, end: int):
        self.path, self.rows, self.begin, self.end = path, rows, begin, end


class _BinaryReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, places: list[int], split_rows: int):
        self.path, self.schema, self.places, self.split_rows = path, schema, places, split_rows
        self.tests: list[tuple[int, str, int]] = []  # (position in the schema, comparison, value)

    def partitions(self) -> list[_Rows]:
        parts = []
        for path in relation_files(self.path):
            rows, _ = read_header(path)
            parts += [_Rows(path, rows, a, min(a + self.split_rows, rows)) for a in range(0, rows, self.split_rows)]
        return parts or [_Rows(self.path, 0, 0, 0)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        if part.begin == part.end:
            return
        system, place = _located(part.path)
        with system.open_input_file(place) as f:
            for begin in range(part.begin, part.end, 1 << 16):
                n = min(1 << 16, part.end - begin)
                values = [np.frombuffer(f.read_at(8 * n, HEADER_SIZE + 8 * (i * part.rows + begin)), "<u8") for i in self.places]
                if self.tests:
                    kept = np.ones(n, bool)
                    for k, op, value in self.tests:
                        if value >= 1 << 64:
                            kept &= op == "<"
                        else:
                            v = np.uint64(value)
                            kept &= values[k] == v if op == "=" else values[k] > v if op == ">" else values[k] < v
                    values = [v[kept] for v in values]
                arrays = [pa.array(v.view("<i8")) if isinstance(field.dataType, T.LongType) else pa.array(v, pa.uint64()).cast(pa.decimal128(20, 0)) for v, field in zip(values, self.schema.fields)]
                yield pa.RecordBatch.from_arrays(arrays, names=self.schema.names)


class _FilteringReader(_BinaryReader):
    """For sessions that push filters into Python sources; others refuse a reader that takes them."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a column with a number are done before rows leave the reader; other filters are given back."""
        known = {EqualTo: "=", GreaterThan: ">", LessThan: "<"}
        for f in filters:
            op = known.get(type(f))
            if op and len(f.attribute) == 1 and f.attribute[0] in self.schema.names and isinstance(f.value, int) and f.value >= 0:
                self.tests.append((self.schema.names.index(f.attribute[0]), op, f.value))
            else:
                yield f


class BinaryRelation(DataSource):
    """``spark.read.format("binary_relation").load(path)``; options: columns (positions to read, all by default), wide (positions of decimal(20,0) columns, or all), splitRows, pushFilters.

    The schema comes from the header alone.  ``pushFilters`` is for sessions with
    ``spark.sql.python.filterPushdown.enabled``; :func:`read_binary` looks.
    """

    @classmethod
    def name(cls) -> str:
        return "binary_relation"

    def _positions(self, option: str, count: int) -> list[int]:
        text = self.options.get(option, "")
        return list(range(count)) if text == "all" else [int(x) for x in text.split(",") if x]

    def schema(self) -> T.StructType:
        _, count = read_header(relation_files(self.options["path"])[0])
        wide = set(self._positions("wide", count))
        return T.StructType([T.StructField(f"c{i}", T.DecimalType(20, 0) if i in wide else T.LongType(), False) for i in self._positions("columns", count) or range(count)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kind = _FilteringReader if self.options.get("pushFilters") == "true" else _BinaryReader
        return kind(self.options["path"], schema, [int(name[1:]) for name in schema.names], int(self.options.get("splitRows", 4_000_000)))


def read_binary(spark: SparkSession, path: str, unsigned: bool | None = None, split_rows: int = 4_000_000, columns: list[int] | None = None) -> DataFrame:
    """A relation, or its columns at some positions.

    Columns are longs, or with ``unsigned`` decimal(20,0).  By default those are
    decimal whose values need it, found by a distributed pass.
    """
    spark.dataSource.register(BinaryRelation)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()

    def load(wide: str) -> DataFrame:
        reader = spark.read.format("binary_relation").option("splitRows", str(split_rows)).option("wide", wide).option("pushFilters", push)
        return (reader.option("columns", ",".join(map(str, columns))) if columns is not None else reader).load(path)

    if unsigned is not None:
        return load("all" if unsigned else "")
    longs = load("")
    least = longs.agg(*[F.min(c).alias(c) for c in longs.columns]).first()  # a value of 2^63 or more reads as a negative long
    wide = [c[1:] for c in longs.columns if (least[c] or 0) < 0]
    return load(",".join(wide)) if wide else longs


def _unsigned(column: pa.Array) -> np.ndarray:
    """A decimal(20,0) column of values below 2^64 as unsigned integers, without Python numbers."""
    words = np.frombuffer(column.buffers()[1], "<u8")[2 * column.offset : 2 * (column.offset + len(column))]
    if column.null_count or words[1::2].any():
        raise FormatError("only whole numbers from 0 to 2^64 - 1 can be written")
    return words[::2]


def _pinned(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as decimals c0, c1, ... in a table of its own, whose partitions are the same in each pass."""
    spark = df.sparkSession
    path = fresh_path(spark, "relation")
    df.select(*[F.col(f"`{c}`").cast("decimal(20,0)").alias(f"c{i}") for i, c in enumerate(df.columns)]).write.parquet(path)
    return spark.read.parquet(path), path


def write_binary(df: DataFrame, path: str) -> None:
    """One file of the binary format on a local file system that all tasks share; rows keep the order of the table that is written first."""
    spark, names = df.sparkSession, df.columns
    pinned, table = _pinned(df)
    source = pinned.withColumn("_part", F.spark_partition_id())
    starts, rows = {}, 0
    for r in sorted(source.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        starts[r["_part"]] = rows
        rows += r["n"]
    with open(path, "wb") as f:
        f.write(struct.pack(HEADER, rows, len(names)))
        f.truncate(HEADER_SIZE + 8 * rows * len(names))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(len(names))[0].as_py()
            with open(path, "r+b") as f:
                for i in range(len(names)):
                    f.seek(HEADER_SIZE + 8 * (i * rows + starts[part] + done))
                    f.write(_unsigned(batch.column(i)).tobytes())
            done += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["done"])

    written = source.mapInArrow(fill, "done long").agg(F.sum("done")).first()[0]
    delete_path(spark, table)
    if (written or 0) != rows:
        raise OSError(f"{path}: {written} of {rows} rows written")


def write_binary_parts(df: DataFrame, path: str, part_rows: int = 4_000_000) -> None:
    """A folder of files of the binary format, of at most ``part_rows`` rows each; a task that is run again writes the same files again.

    For file systems of Arrow's that can't write into the middle of a file, and for tables of any size.
    """
    pinned, table = _pinned(df)
    count = len(df.columns)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, n, total = TaskContext.get().partitionId(), 0, [], 0, 0
        system, place = _located(path)

        def close():
            nonlocal number, held, n
            if n:
                system.create_dir(place, recursive=True)
                with system.open_output_stream(f"{place}/part-{task:06d}-{number:04d}") as f:
                    f.write(struct.pack(HEADER, n, count))
                    for i in range(count):
                        for columns in held:
                            f.write(columns[i].tobytes())
            number, held, n = number + 1, [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, part_rows):
                piece = batch.slice(at, part_rows)
                if n + piece.num_rows > part_rows:
                    close()
                held.append([_unsigned(piece.column(i)).copy() for i in range(count)])
                n += piece.num_rows
                total += piece.num_rows
        close()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["done"])

    pinned.mapInArrow(store, "done long").agg(F.sum("done")).collect()
    delete_path(df.sparkSession, table)


def read_delimited(spark: SparkSession, path: str, columns: int, unsigned: bool = False) -> DataFrame:
    """``v|v|...|`` lines, with the delimiter also at the end."""
    kind = T.DecimalType(20, 0) if unsigned else T.LongType()
    fields = [T.StructField(f"c{i}", kind) for i in range(columns)]
    schema = T.StructType([*fields, T.StructField("_end", T.StringType())])
    return spark.read.csv(path, sep="|", schema=schema, mode="FAILFAST").drop("_end")


def delimited_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in df.columns]), F.lit("|")).alias("value"))


def write_delimited(df: DataFrame, path: str) -> None:
    """A folder of text files, one a partition."""
    delimited_lines(df).write.text(path)


def ddl(relation: int, columns: int) -> str:
    """Statements that create the relation elsewhere and load its delimited file."""
    body = ",".join(f"c{i} bigint" for i in range(columns))
    return f"CREATE TABLE r{relation} ({body});\ncopy r{relation} from 'r{relation}.tbl' delimiter '|';\n"


def store_all(df: DataFrame, folder: str, relation: int) -> None:
    """The relation as binary file, delimited text and statements, under r<relation> in ``folder``."""
    pyarrow.fs.LocalFileSystem().create_dir(folder, recursive=True)
    write_binary(df, f"{folder}/r{relation}")
    write_delimited(df, f"{folder}/r{relation}.tbl")
    with open(f"{folder}/r{relation}.sql", "w") as f:
        f.write(ddl(relation, len(df.columns)))


def generated(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """Every column holds 0 .. rows-1."""
    return spark.range(rows).select(*[F.col("id").alias(f"c{i}") for i in range(columns)])


def read_relation(spark: SparkSession, path: str) -> DataFrame:
    """By the name's ending: .parquet, .tbl (columns counted on the first line) or the binary format."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".tbl"):
        first = spark.read.text(path).first()
        return read_delimited(spark, path, first[0].count("|") if first else 0)
    return read_binary(spark, path)
