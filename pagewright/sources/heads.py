"""A data source of the beginnings of files: what telling their kind, size and name needs, without reading them.

    register(spark)
    spark.read.format("file_heads").load("hdfs://…/uploads").where("length <= 20971520 AND path LIKE '%.png'")

Conditions on length and path reach the source, so files that fail them are never opened. Of each other file only ``headBytes``
bytes (64) are read, from its first byte that is not white space on; white space before it is passed over in pieces. Folders are
read with all that is below them; names that begin with a dot or an underscore are left out, as Spark does. Empty files keep a
row, unlike in Spark's own source. Paths are told as the store has them, without a scheme. A file that goes away after the listing is an error, as in Spark.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

WHITE = b" \t\n\r\x0b\x0c"
PIECE = 64 << 10
Test = Callable[[str | int], bool]

#: What conditions of a column come to; all others stay with Spark.
TESTS: dict[type[Filter], Callable[[object], Test]] = {
    IsNotNull: lambda v: lambda x: True,
    EqualTo: lambda v: lambda x: x == v,
    LessThan: lambda v: lambda x: x < v,
    LessThanOrEqual: lambda v: lambda x: x <= v,
    GreaterThan: lambda v: lambda x: x > v,
    GreaterThanOrEqual: lambda v: lambda x: x >= v,
    In: lambda v: lambda x: x in v,
    StringStartsWith: lambda v: lambda x: x.startswith(v),
    StringEndsWith: lambda v: lambda x: x.endswith(v),
    StringContains: lambda v: lambda x: v in x,
}


@dataclass
class Files(InputPartition):
    """Some files with their lengths."""

    files: list[tuple[str, int]]


class HeadsReader(DataSourceReader):
    def __init__(self, path: str, head_bytes: int, files_a_task: int):
        self.path, self.head_bytes, self.files_a_task = path, head_bytes, files_a_task
        self.tests: list[tuple[int, Test]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes conditions on path and length, and gives back the others."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if type(f) in TESTS and column in (("path",), ("length",)):
                self.tests.append((("path", "length").index(column[0]), TESTS[type(f)](getattr(f, "value", None))))
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = opened(self.path)
        found = store.get_file_info(root)
        infos = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        shown = lambda path: not any(x[0] in "._" for x in path[len(root) :].split("/") if x)
        files = sorted((x.path, x.size) for x in infos if x.type == fs.FileType.File and shown(x.path))
        kept = [f for f in files if all(test(f[at]) for at, test in self.tests)]
        return [Files(kept[k : k + self.files_a_task]) for k in range(0, len(kept), self.files_a_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, int, bytes]]:
        store, _ = opened(self.path)
        for path, length in partition.files:
            with store.open_input_file(path) as file:
                yield path, length, self.head(file)

    def head(self, file) -> bytes:
        if not self.head_bytes:
            return b""
        while piece := file.read(max(self.head_bytes, 64) if file.tell() == 0 else PIECE):
            if begun := piece.lstrip(WHITE):
                return (begun + file.read(max(0, self.head_bytes - len(begun))))[: self.head_bytes]
        return b""


class FileHeads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, length long, head binary"

    def reader(self, schema) -> HeadsReader:
        return HeadsReader(self.options["path"], int(self.options.get("headBytes", 64)), int(self.options.get("filesPerTask", 1000)))


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI, or of a local path, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, and lets conditions reach sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileHeads)
