"""Characters of pages as a Spark data source, batch and stream: ``spark.read.format("page_characters").load(folder)``.

The folder holds JSON files, a page a line: ``{"doc_id", "page", "lines": [{"paragraph", "spans": [{"font", "size", "chars":
[{"c", "bbox": [x0, y0, x1, y1]}]}]}]}``. Executors open the files through pyarrow (local or any file system it knows by scheme),
a file a partition, and read it line by line, so a page is what a task holds. A line that is no page gives one row with
``error`` and the number of the line, and nothing else, so bad pages are kept apart and the others are read.

As a stream, files are taken in the order of their names: a new file's name has to come after those before it, and a file has to
be moved into the folder whole. The offset is the last name, so a query that is begun again on its checkpoint reads each
file once. A batch is all that is new, a file a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "doc_id bigint, page bigint, line bigint, paragraph bigint, span bigint, place bigint, c string, x0 double, y0 double, x1 double, y1 double, font string, size double, error string"
WIDTH = len(SCHEMA.split(", "))


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)


def _names(folder: str) -> list[str]:
    fs, base = _opened(folder)
    found = fs.get_file_info(pafs.FileSelector(base, recursive=False))
    return sorted(f.base_name for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))


@dataclass
class File(InputPartition):
    name: str


def page_rows(page: dict) -> Iterator[tuple]:
    """A page's characters; lines, spans and characters are numbered from 0, characters over the whole page."""
    place, spans = 0, 0
    for n, line in enumerate(page["lines"]):
        for span in line["spans"]:
            for char in span["chars"]:
                x0, y0, x1, y1 = map(float, char["bbox"])
                size = span.get("size")
                yield (int(page["doc_id"]), int(page["page"]), n, line.get("paragraph"), spans, place, char["c"], x0, y0, x1, y1, span.get("font"), None if size is None else float(size), None)
                place += 1
            spans += 1


def rows_of(folder: str, name: str) -> Iterator[tuple]:
    fs, base = _opened(folder)
    with fs.open_input_stream(f"{base}/{name}") as stream:
        rest, number = b"", 0
        while True:
            block = stream.read(1 << 20)
            *lines, rest = (rest + block).split(b"\n")
            if not block and rest:
                lines, rest = [rest], b""
            for line in lines:
                number += 1
                if line.strip():
                    try:
                        rows = list(page_rows(json.loads(line)))
                    except (ValueError, KeyError, TypeError, AttributeError) as e:
                        rows = [(*[None] * (WIDTH - 1), f"{name}:{number}: {type(e).__name__}: {e}")]
                    yield from rows
            if not block:
                return


class _Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return [File(n) for n in _names(self.folder)] or [File("")]

    def read(self, partition):
        if partition.name:
            yield from rows_of(self.folder, partition.name)


class _Stream(DataSourceStreamReader):
    """Holds nothing between calls: an offset is the last name there is."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self):
        return {"after": ""}

    def latestOffset(self):
        return {"after": max(_names(self.folder), default="")}

    def partitions(self, start, end):
        return [File(n) for n in _names(self.folder) if start["after"] < n <= end["after"]]

    def read(self, partition):
        yield from rows_of(self.folder, partition.name)


class PageCharacters(DataSource):
    @classmethod
    def name(cls):
        return "page_characters"

    def schema(self):
        return SCHEMA

    def _folder(self) -> str:
        if "path" not in self.options:
            raise ValueError("page_characters reads a folder: load(folder)")
        return self.options["path"].rstrip("/")

    def reader(self, schema):
        return _Batch(self._folder())

    def streamReader(self, schema):
        return _Stream(self._folder())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageCharacters)
