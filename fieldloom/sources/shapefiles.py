"""Shapefiles of any size as a Spark data source: ranges of records are read by tasks of their own, tasks write sets of files.

A set of files is opened at the records a task is to read: the index gives where shapes stand, the attributes have one
length. What many tasks write is a folder of sets and a manifest of those that Spark committed, so sets of a task that
failed or ran twice are never read. The folder must be one that pyarrow's file systems reach.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from fieldloom.sources import binary, sinks

FORMAT, MANIFEST = "fieldloom_shapefiles", "manifest.json"
#: A task reads at most so many records and about so many bytes; a set of files holds at most so many rows and coordinates.
RANGE_RECORDS, RANGE_BYTES, SET_ROWS, SET_POINTS = 200_000, 64 << 20, 50_000, 2_000_000
CHUNK = 1_000
SCHEMA = "row_no long, cells map<string,string>, kind string, parts array<array<struct<x:double,y:double>>>"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


@dataclass
class Range(InputPartition):
    """Records first to last (exclusive) of a set, whose record 0 is row `base` of all."""

    name: str
    first: int
    last: int
    base: int


@dataclass
class Written(WriterCommitMessage):
    sets: list[dict]


class Shapefiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("records", RANGE_RECORDS)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema.names, self.options["kind"], self.options["reference"], int(self.options.get("rows", SET_ROWS)))


class Reader(DataSourceReader):
    def __init__(self, path: str, records: int):
        self.path, self.records = path, records

    def _sets(self, system: fs.FileSystem, root: str) -> list[str]:
        if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
            return [root]  # a single set, named without its ending
        with system.open_input_stream(f"{root}/{MANIFEST}") as f:
            return [f"{root}/{x['name']}" for x in json.loads(f.read())["sets"]]

    def partitions(self) -> list[Range]:
        system, root = _filesystem(self.path)
        out, base = [], 0
        for name in self._sets(system, root):
            count = (system.get_file_info(f"{name}.shx").size - 100) // 8
            with system.open_input_file(f"{name}.dbf") as f:
                (told,) = struct.unpack_from("<I", f.read(8), 4)
            if told != count:
                raise ValueError(f"{name} has {count} shapes and {told} rows of attributes")
            each = max(1, min(self.records, RANGE_BYTES * count // max(1, system.get_file_info(f"{name}.shp").size)))
            out += [Range(name, k, min(k + each, count), base) for k in range(0, count, each)]
            base += count
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        system, _ = _filesystem(self.path)
        if part is None:  # nothing was written
            return
        with system.open_input_file(f"{part.name}.shx") as index, system.open_input_file(f"{part.name}.shp") as shapes, system.open_input_file(f"{part.name}.dbf") as table:
            head, size = struct.unpack_from("<HH", table.read(32), 8)
            fields = table.read(head - 32)
            fields = [(fields[k : k + 11].split(b"\0")[0].decode("latin-1"), fields[k + 16]) for k in range(0, len(fields) - 31, 32)]
            for first in range(part.first, part.last, CHUNK):
                n = min(CHUNK, part.last - first)
                index.seek(100 + 8 * first)
                places = [(2 * at, 8 + 2 * words) for at, words in struct.iter_unpack(">2i", index.read(8 * n))]
                table.seek(head + first * size)
                rows = table.read(n * size)
                for k, (at, length) in enumerate(places):
                    shapes.seek(at)
                    yield part.base + first + k, self._cells(fields, rows[k * size : (k + 1) * size]), *binary.shape(shapes.read(length))

    @staticmethod
    def _cells(fields: list[tuple[str, int]], record: bytes) -> dict:
        cells, at = {}, 1
        for name, width in fields:
            cells[name] = record[at : at + width].decode("utf-8", "replace").strip() or None
            at += width
        return cells


class Writer(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], kind: str, reference: str, rows: int):
        self.path, self.kind, self.reference, self.rows = path, kind, reference, rows
        self.names = sinks.shapefile_names(columns, kind)

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        sets, held, points = [], [], 0

        def put() -> None:
            name = f"part-{task.partitionId():05d}-{len(sets):04d}-{task.taskAttemptId()}"
            for end, content in sinks.shapefile_bytes(held, self.names, self.kind, self.reference).items():
                with system.open_output_stream(f"{root}/{name}{end}") as out:
                    out.write(content)
            sets.append({"name": name, "rows": len(held), "order": [task.partitionId(), len(sets)]})

        for row in iterator:
            more = sum(len(p) for p in row["parts"] or [])
            if held and (len(held) == self.rows or points + more > SET_POINTS):
                put()
                held, points = [], 0
            held.append(row)
            points += more
        if held:
            put()
        return Written(sets)

    def commit(self, messages: list) -> None:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        sets = sorted((x for m in messages if m is not None for x in m.sets), key=lambda x: x["order"])
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"sets": sets}).encode())

    def abort(self, messages: list) -> None:
        system, root = _filesystem(self.path)
        for x in (x for m in messages if m is not None for x in m.sets):
            for end in (".shp", ".shx", ".dbf", ".prj", ".cpg"):
                system.delete_file(f"{root}/{x['name']}{end}")


def write(df: DataFrame, path: str, kind: str, reference: str = sinks.WGS84, rows: int = SET_ROWS) -> None:
    """df(parts, ...) as sets of files in the folder path, which goes first if it is there; each task writes its own rows.

    kind: point, line or polygon. A set holds at most `rows` rows, in the order of df's partitions; rows without parts are
    null shapes. Attributes of over 254 bytes, and names alike in ten characters, are errors, and then nothing can be read.
    """
    spark, names = df.sparkSession, sinks.shapefile_names(df.columns, kind)
    if sinks.exists(spark, path):
        sinks.remove(spark, path)
    spark.dataSource.register(Shapefiles)
    plain = df.select("parts", *[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    plain.write.format(FORMAT).option("kind", kind).option("reference", reference).option("rows", rows).mode("append").save(path)


def read(spark: SparkSession, path: str, records: int = RANGE_RECORDS) -> DataFrame:
    """row_no, cells, kind and parts of a folder of sets, or of a single set named without its ending, by ranges of records."""
    spark.dataSource.register(Shapefiles)
    return spark.read.format(FORMAT).option("records", records).load(path)
