"""A data source of the variables of MATLAB 5 files, each file a partition.

    spark.dataSource.register(MatFile); spark.read.format("mat_file").option("paths", "a.mat,b.mat").load()

A file is a header and tagged elements, which may be deflated. A matrix gives a row for each of its elements, by its
place; a cell holds a text or number, or another matrix, whose elements then have its place before their own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabulon.errors import RefusedInput
from tabulon.sources.store import opened

# Fixed values of the format: types of stored numbers, and classes of matrices.
_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
_MATRIX, _DEFLATED, _TEXTS = 14, 15, {16: "utf-8", 17: "utf-16", 18: "utf-32"}
_CELL, _STRUCT, _OBJECT, _CHAR, _SPARSE = 1, 2, 3, 4, 5


def _element(data: bytes, at: int, order: str) -> tuple[int, bytes, int]:
    """(type, content, where the next element begins): up to four bytes may stand in the tag itself."""
    if at + 8 > len(data):
        raise RefusedInput("an element ends before its tag does")
    kind, size = struct.unpack_from(f"{order}II", data, at)
    if kind >> 16:  # small
        kind, size = kind & 0xFFFF, kind >> 16
        if size > 4:
            raise RefusedInput("a small element is too long")
        return kind, data[at + 4 : at + 4 + size], at + 8
    end = at + 8 + size
    if end > len(data):
        raise RefusedInput("an element ends after its file")
    return kind, data[at + 8 : end], end if kind == _DEFLATED else end + -size % 8


def _numbers(kind: int, content: bytes, order: str) -> np.ndarray:
    if kind not in _TYPES:
        raise RefusedInput(f"numbers of an unknown type: {kind}")
    dtype = np.dtype(order + _TYPES[kind])
    if len(content) % dtype.itemsize:
        raise RefusedInput("numbers that aren't whole")
    return np.frombuffer(content, dtype=dtype)


def _text(kind: int, content: bytes, order: str) -> str:
    if kind in _TEXTS:
        name = _TEXTS[kind]
        return content.decode(name if kind == 16 else f"{name}-{'le' if order == '<' else 'be'}")
    return "".join(map(chr, _numbers(kind, content, order).tolist()))


def _matrix(data: bytes, order: str) -> Iterator[tuple[str, list[int], float | None, str | None]]:
    """(name, place from 1, number, text) of a matrix's elements, in the order of its columns."""
    if not data:  # an empty cell
        return
    _, flags, at = _element(data, 0, order)
    if len(flags) < 8:
        raise RefusedInput("a matrix has no flags")
    kind = struct.unpack_from(f"{order}I", flags)[0] & 0xFF
    how, sizes, at = _element(data, at, order)
    shape = _numbers(how, sizes, order).tolist()
    if len(shape) < 2 or min(shape) < 0:
        raise RefusedInput("a matrix has fewer than two dimensions")
    how, name, at = _element(data, at, order)
    name = name.decode("latin-1")
    n = int(np.prod(shape))
    place = lambda k: [int(x) + 1 for x in np.unravel_index(k, shape, order="F")]
    if kind == _CELL:
        for k in range(n):
            inner, content, at = _element(data, at, order)
            if inner != _MATRIX:
                raise RefusedInput("a cell holds no matrix")
            some = list(_matrix(content, order))
            for _, more, number, text in some:
                yield name, place(k) + ([] if len(some) == 1 else more), number, text
    elif kind == _CHAR:
        how, content, at = _element(data, at, order)
        letters = _text(how, content, order)
        rows = shape[0]
        for k in range(rows):  # a text for each row, stored by columns
            yield name, [k + 1, 1], None, letters[k::rows]
    elif kind in (_STRUCT, _OBJECT, _SPARSE):
        raise RefusedInput(f"{name!r} is a struct, an object or a sparse matrix")
    else:
        how, content, at = _element(data, at, order)
        values = _numbers(how, content, order)
        if len(values) != n:
            raise RefusedInput(f"{name!r} has {len(values)} numbers instead of {n}")
        for k, value in enumerate(values.tolist()):
            yield name, place(k), float(value), None


def variables(data: bytes) -> Iterator[tuple[str, list[int], float | None, str | None]]:
    """(variable, place, number, text) of all elements of a file's matrices."""
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise RefusedInput("no MATLAB 5 file")
    order, at = ("<" if data[126:128] == b"IM" else ">"), 128
    while at < len(data):
        kind, content, at = _element(data, at, order)
        if kind == _DEFLATED:
            try:
                content = zlib.decompress(content)
            except zlib.error as error:
                raise RefusedInput("a deflated element is damaged") from error
            kind, content, _ = _element(content, 0, order)
        if kind == _MATRIX:
            yield from _matrix(content, order)


class MatFile(DataSource):
    """file, variable, place (array of ints, from 1), number, text."""

    @classmethod
    def name(cls) -> str:
        return "mat_file"

    def schema(self) -> str:
        return "file string, variable string, place array<int>, number double, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["paths"].split(","))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        with opened(partition.value) as file:
            for found in variables(file.read()):
                yield partition.value, *found


def names(found: DataFrame, variable: str) -> DataFrame:
    """id (from 1), name: a variable's texts by their row, or by their column where there is one row only."""
    some = found.filter(F.col("variable") == variable)
    at = F.greatest(F.get("place", F.lit(0)), F.get("place", F.lit(1)))
    return some.select(at.alias("id"), F.trim("text").alias("name"))


def table(found: DataFrame, variable: str, columns: list[str]) -> DataFrame:
    """A variable's rows, with a column for each of its columns: texts where they are, else numbers as texts."""
    some = found.filter(F.col("variable") == variable)
    whole = F.when(F.col("number") == F.floor("number"), F.col("number").cast("long").cast("string")).otherwise(F.col("number").cast("string"))
    value = F.coalesce("text", whole)
    cells = [F.max(F.when(F.get("place", F.lit(1)) == k, value)).alias(c) for k, c in enumerate(columns, 1)]
    return some.groupBy("file", F.get("place", F.lit(0)).alias("row")).agg(*cells).select("row", *columns)


def _stored(kind: int, content: bytes) -> bytes:
    return struct.pack("<II", kind, len(content)) + content + b"\0" * (-len(content) % 8)


def cell_file(variables_: dict[str, list[str]], deflate: bool = False) -> bytes:
    """A file of variables that are columns of texts, as cells."""
    def matrix(kind: int, shape: tuple[int, int], body: bytes, name: str = "") -> bytes:
        return _stored(_MATRIX, _stored(6, struct.pack("<II", kind, 0)) + _stored(5, struct.pack("<2i", *shape)) + _stored(1, name.encode("latin-1")) + body)

    text = lambda t: matrix(_CHAR, (1, len(t.encode("utf-16-le")) // 2) if t else (0, 0), _stored(17, t.encode("utf-16-le")))
    found = [matrix(_CELL, (len(texts), 1), b"".join(map(text, texts)), name) for name, texts in variables_.items()]
    packed = [struct.pack("<II", _DEFLATED, len(z)) + z for z in map(zlib.compress, found)] if deflate else found
    return b"MATLAB 5.0 MAT-file".ljust(124, b" ") + b"\0\1IM" + b"".join(packed)
