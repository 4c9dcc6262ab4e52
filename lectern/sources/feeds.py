"""Data sources for JSON that other programs leave in folders: chunks of a document parser, and release feeds.

    feeds.register(spark)
    spark.read.format("parsed_chunks").load(folder).where("file_id = 7")
    spark.readStream.format("parsed_chunks").load(folder)

A folder's files are the partitions; filters on columns are applied before rows are made, where the session lets them be pushed
down (spark.sql.python.filterPushdown.enabled). As a stream, files come in the order of their names: a program that adds
files must name them in a growing order, and offsets are the last name taken. Files are found and read by any
file system that Arrow knows, in the tasks.

Lines that aren't JSON, or lack their list, give no rows; unknown kinds are text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

KINDS = ("text", "title", "list", "table", "code", "note", "metadata", "image")
CHUNKS = "file_id bigint, chunk_idx int, text string, contextual_text string, page_start int, page_end int, kind string"
RELEASES = "id string, version string, build bigint, platform string, architecture string, channel string"
#: Rows of a batch.
ROWS = 4096


def _files(path: str) -> list[str]:
    """Data files of a folder by name, or the file itself."""
    system, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
    return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def _lines(path: str, name: str) -> Iterator[Any]:
    """What a file's lines say, broken ones left out."""
    system, _ = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    with system.open_input_stream(name) as raw:
        rest = b""
        while block := raw.read(1 << 20):
            *lines, rest = (rest + bytes(block)).split(b"\n")
            yield from (x for line in lines if (x := _loaded(line)) is not None)
        if (x := _loaded(rest)) is not None:
            yield x


def _loaded(line: bytes) -> Any:
    try:
        return json.loads(line)
    except ValueError:
        return None


def _chunks(said: Any) -> Iterator[tuple]:
    if isinstance(said, dict) and isinstance(said.get("chunks"), list):
        for k, c in enumerate(said["chunks"]):
            if isinstance(c, dict):
                yield said.get("file_id"), k, c.get("text"), c.get("contextual_text"), c.get("page_start"), c.get("page_end"), c.get("kind") if c.get("kind") in KINDS else "text"


def _releases(said: Any) -> Iterator[tuple]:
    if isinstance(said, dict) and isinstance(said.get("releases"), list):
        yield from (tuple(r.get(c) for c in ("id", "version", "build", "platform", "architecture", "channel")) for r in said["releases"] if isinstance(r, dict))


#: Of the filters that can be pushed down: whether a value, which isn't null, meets one.
_MEETS: dict[type, Callable[[Any, Any], bool]] = {
    ds.EqualTo: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b,
    ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b, ds.In: lambda a, b: a in b, ds.StringStartsWith: lambda a, b: a.startswith(b),
}


class _Reading:
    """Rows of files that meet what was pushed down, in batches."""

    def __init__(self, schema: str, rows: Callable[[Any], Iterator[tuple]], path: str) -> None:
        self.names = [c.split()[0] for c in schema.split(", ")]
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        self.schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
        self.rows, self.path = rows, path
        self.pushed: list[tuple[int, type, Any]] = []

    def push(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Takes the filters that it can apply; gives back the others."""
        for f in filters:
            if isinstance(f, ds.IsNotNull) and len(f.attribute) == 1:
                self.pushed.append((self.names.index(f.attribute[0]), ds.IsNotNull, None))
            elif type(f) in _MEETS and len(f.attribute) == 1 and getattr(f, "value", None) is not None:
                self.pushed.append((self.names.index(f.attribute[0]), type(f), f.value))
            else:
                yield f

    def batches(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for name in names:
            for said in _lines(self.path, name):
                for row in self.rows(said):
                    if all(row[i] is not None and (kind is ds.IsNotNull or _MEETS[kind](row[i], v)) for i, kind, v in self.pushed):
                        held.append(row)
                    if len(held) >= ROWS:
                        yield self._batch(held)
                        held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)


class _Part(ds.InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class _Reader(ds.DataSourceReader):
    def __init__(self, reading: _Reading) -> None:
        self.reading = reading

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        return self.reading.push(filters)

    def partitions(self) -> list[ds.InputPartition]:
        return [_Part([name]) for name in _files(self.reading.path)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        return self.reading.batches(partition.names)


class _StreamReader(ds.DataSourceStreamReader):
    def __init__(self, reading: _Reading) -> None:
        self.reading = reading

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(_files(self.reading.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[ds.InputPartition]:
        return [_Part([name]) for name in _files(self.reading.path) if start["after"] < name <= end["after"]]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        return self.reading.batches(partition.names)


class ParsedChunks(ds.DataSource):
    """Chunks of a document parser's lines {file_id, chunks: [{text, kind, ...}]}."""

    SCHEMA, ROWS_OF = CHUNKS, staticmethod(_chunks)

    @classmethod
    def name(cls) -> str:
        return "parsed_chunks"

    def schema(self) -> str:
        return self.SCHEMA

    def _reading(self) -> _Reading:
        return _Reading(self.SCHEMA, type(self).ROWS_OF, self.options["path"])

    def reader(self, schema) -> ds.DataSourceReader:
        return _Reader(self._reading())

    def streamReader(self, schema) -> ds.DataSourceStreamReader:
        return _StreamReader(self._reading())


class ReleaseFeed(ParsedChunks):
    """Releases of lines {releases: [{id, version, ...}]}."""

    SCHEMA, ROWS_OF = RELEASES, staticmethod(_releases)

    @classmethod
    def name(cls) -> str:
        return "release_feed"


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ParsedChunks, ReleaseFeed):
        spark.dataSource.register(source)
