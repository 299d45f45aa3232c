"""Packages as a data source of Spark: ``spark.read.format("lamina").option("kind", "runs").load(path)`` and ``df.write.format("lamina").save(path)``.

A task reads files of some bounded number of bytes. Filters on ``path`` (equal, in, starts with) choose files before any is opened, filters on ``part`` choose parts before any is
decoded (kind `parts`), and a given schema says which columns are made at all. A write leaves files under names of its own until Spark commits it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from lamina.sources.package import ERRORS, SCANS, Package, as_lists

#: Bytes of packages that a task reads, and the ending of packages.
TASK_BYTES, ENDING = 64 << 20, ".docx"


def file_system(path: str):
    """pyarrow's file system of a Hadoop-style path, and the path below it."""
    from pyarrow import fs

    scheme, mark, rest = path.partition(":")
    if not mark:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


@dataclass
class Files(InputPartition):
    paths: list[str]


class PackageReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.kind, self.root = schema, options.get("kind", "elements"), options["path"]
        self.most = int(options.get("taskBytes", TASK_BYTES))
        self.paths: set[str] | None = None
        self.starts: list[str] = []
        self.parts: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on path, and on part where rows are parts; the others go back to Spark."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == "path" and values is not None:
                self.paths = values if self.paths is None else self.paths & values
            elif column == "path" and isinstance(f, StringStartsWith):
                self.starts.append(f.value)
            elif column == "part" and self.kind == "parts" and values is not None:
                self.parts = values if self.parts is None else self.parts & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, place = file_system(self.root)
        prefix = self.root.removesuffix(place)
        info = system.get_file_info(place)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
        out, held = [], 0
        for x in sorted((x for x in found if x.type == fs.FileType.File and x.path.endswith(ENDING)), key=lambda x: x.path):
            path = prefix + x.path
            if (self.paths is not None and path not in self.paths) or not all(path.startswith(s) for s in self.starts):
                continue
            if not out or held + x.size > self.most:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(path)
            held += x.size
        return out or [Files([])]

    def rows(self, path: str) -> tuple[list[dict], str | None]:
        """The rows of one package, and what kept it from being read."""
        system, place = file_system(path)
        try:
            with system.open_input_file(place) as f:
                package = Package(f.read())
            if self.kind == "parts" and self.parts is not None:
                package.names &= self.parts | {"[Content_Types].xml"}
            found = list(SCANS[self.kind][0](package)) if self.kind != "errors" else []
            if self.kind == "parts" and self.parts is not None:
                found = [r for r in found if r["part"] in self.parts]
            return found, "; ".join(package.broken.values()) or None
        except Exception as e:  # one damaged file must not end the read
            return [], f"{type(e).__name__}: {e}"

    def read(self, partition: Files) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kind = pa.list_(pa.struct([(f.name, to_arrow_type(f.dataType)) for f in self.schema]))
        for path in partition.paths:
            found, error = self.rows(path)
            if self.kind == "errors":
                found = [{"kind": "package", "message": error}] if error else []
            if found:
                whole = [{k: list(v.items()) if isinstance(v, dict) else v for k, v in r.items()} | {"path": path} for r in found]
                yield pa.RecordBatch.from_struct_array(as_lists([whole], kind).flatten())


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class PackageWriter(DataSourceWriter):
    """Rows of (name, content). A task's files lie in a folder of its own; the commit gives them their names, an abort takes them away."""

    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator) -> Written:
        system, place = file_system(self.root)
        folder, moves = f"{place}/_attempt-{uuid.uuid4().hex}", []
        system.create_dir(folder, recursive=True)
        try:
            for i, row in enumerate(rows):
                if row[1] is None:
                    raise ValueError(f"{row[0]} has no content")
                with system.open_output_stream(f"{folder}/{i}", compression=None) as f:
                    f.write(bytes(row[1]))
                name = str(row[0]) if str(row[0]).endswith(ENDING) else f"{row[0]}{ENDING}"
                moves.append((f"{folder}/{i}", f"{place}/{name}"))
        except BaseException:
            system.delete_dir(folder)
            raise
        return Written([(folder, ""), *moves])

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.root)
        names = [b for m in messages if m for _, b in m.moves if b]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two packages of one name")
        for m in filter(None, messages):
            for a, b in m.moves[1:]:
                system.move(a, b)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.root)
        for m in filter(None, messages):
            system.delete_dir(m.moves[0][0])


class PackageSource(DataSource):
    """Options: ``path`` (a file or folder), ``kind`` (any of the package scan's, or `errors`), ``taskBytes``."""

    @classmethod
    def name(cls) -> str:
        return "lamina"

    def schema(self) -> str:
        kind = self.options.get("kind", "elements")
        return "path string, " + (ERRORS if kind == "errors" else SCANS[kind][1])

    def reader(self, schema: StructType) -> PackageReader:
        return PackageReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> PackageWriter:
        if len(schema) != 2:
            raise ValueError("packages are written from two columns: name and content")
        return PackageWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackageSource)
