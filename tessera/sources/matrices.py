"""Matrix and dictionary files as tables.

A binary matrix has a header with its shape and number type, then its rows one after another: a
task seeks to the first of its rows, so one file is read by many tasks, and of a row only the columns
that are asked for become values. Files are opened through Arrow's file systems, so any store that they know will do.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = b"\x93NUMPY"


@dataclass(frozen=True)
class Header:
    kind: np.dtype
    rows: int
    columns: int
    data: int  # where the first row begins
    by_columns: bool


def _open(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(place)


def read_header(path: str) -> Header:
    """The header of a matrix of one or two dimensions; one dimension is a column."""
    with _open(path) as f:
        start = f.read(12)
        if not start.startswith(MAGIC) or start[6] not in (1, 2, 3):
            raise ValueError(f"{path} is no binary matrix")
        size, begin = (int.from_bytes(start[8:10], "little"), 10) if start[6] == 1 else (int.from_bytes(start[8:12], "little"), 12)
        f.seek(begin)
        found = ast.literal_eval(f.read(size).decode("latin-1" if start[6] < 3 else "utf-8"))
    kind, shape = np.dtype(found["descr"]), found["shape"]
    if kind.hasobject or kind.kind not in "biuf" or len(shape) not in (1, 2):
        raise ValueError(f"{path} does not hold a matrix of numbers")
    return Header(kind, shape[0], shape[1] if len(shape) == 2 else 1, begin + size, bool(found["fortran_order"]) and len(shape) == 2)


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class MatrixSource(DataSource):
    """``matrix``: (row, values) of a binary matrix file, in ranges of rows.

    Options: ``path``; ``columns``, numbers from 0 with commas between, all without it; ``bytes``, the size of a range (64 MB).
    """

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return "row long, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Matrix(dict(self.options))


class _Matrix(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.header = read_header(self.path)
        self.columns = [int(c) for c in options["columns"].split(",")] if options.get("columns") else list(range(self.header.columns))
        if any(not 0 <= c < self.header.columns for c in self.columns):
            raise ValueError(f"columns are numbers from 0 to {self.header.columns - 1}")
        self.step = max(1, int(options.get("bytes", 64 << 20)) // max(1, self.header.kind.itemsize * self.header.columns))

    def partitions(self) -> list[Rows]:
        return [Rows(a, min(a + self.step, self.header.rows)) for a in range(0, self.header.rows, self.step)] or [Rows(0, 0)]

    def _block(self, f, first: int, last: int) -> np.ndarray:
        h = self.header
        if not h.by_columns:
            f.seek(h.data + first * h.columns * h.kind.itemsize)
            body = f.read((last - first) * h.columns * h.kind.itemsize)
            return np.frombuffer(body, dtype=h.kind).reshape(last - first, h.columns)[:, self.columns]
        parts = []
        for c in self.columns:  # a column is a run of its own: the others are not read
            f.seek(h.data + (c * h.rows + first) * h.kind.itemsize)
            parts.append(np.frombuffer(f.read((last - first) * h.kind.itemsize), dtype=h.kind))
        return np.column_stack(parts) if parts else np.zeros((last - first, 0))

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        many = max(1, (4 << 20) // max(1, 8 * self.header.columns))
        with _open(self.path) as f:
            for a in range(partition.first, partition.last, many):
                b = min(partition.last, a + many)
                values = self._block(f, a, b).astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * len(self.columns)), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), lists], names=["row", "values"])


def read_matrix(spark: SparkSession, path: str, columns: Sequence[int] | None = None, size: int = 64 << 20) -> DataFrame:
    """(row, values) of a binary matrix; values are those of columns, in that order. A file that ends too soon is an error."""
    spark.dataSource.register(MatrixSource)
    reader = spark.read.format("matrix").option("bytes", str(size))
    if columns is not None:
        reader = reader.option("columns", ",".join(map(str, columns)))
    return reader.load(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(term_id, term, df) of a dictionary in text: lines of an id, a term and its documents with tabs between; a first line with the number of documents alone is none."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(parts) == 3)
    return rows.select(parts[0].cast("long").alias("term_id"), parts[1].alias("term"), parts[2].cast("long").alias("df"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(position, value) of numbers in text, with blanks or commas between, in order of lines: a shift or bias vector of any length.

    One line or one number a line. Lines are numbered as Spark reads them, file by file.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"[\s,]+").alias("parts"))
    values = lines.select("line", F.posexplode("parts").alias("place", "v")).where("v <> ''")
    from pyspark.sql import Window

    order = Window.orderBy("line", "place")  # a vector, not a table
    return values.select((F.row_number().over(order) - 1).alias("position"), F.col("v").cast("double").alias("value"))
