"""Formats that are whole files: GeoPackage, shapefile and workbook, read through Spark's binary files.

Each file is one row to Spark, so many files spread over the executors; values come out as text and
geometry as parts of points, to be cast by the caller's schema.
"""

from __future__ import annotations

import io
import re
import sqlite3
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, layer string, row_no long, cells map<string,string>, kind string, parts array<array<struct<x:double,y:double>>>"


def _read(spark: SparkSession, path: str, parse) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = [(name, *r) for r in parse(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", "layer", "row_no", "cells", "kind", "parts"])

    return files.mapInPandas(run, ROWS)


def _points(data: bytes, at: int, n: int, order: str) -> list[dict]:
    flat = struct.unpack_from(f"{order}{2 * n}d", data, at)
    return [{"x": flat[2 * k], "y": flat[2 * k + 1]} for k in range(n)]


def parse_wkb(data: bytes, at: int = 0) -> tuple[str, list[list[dict]], int]:
    """Kind, parts and end of a two-dimensional geometry in the binary form of simple features."""
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    if code == 1:
        return "point", [_points(data, at, 1, order)], at + 16
    (n,) = struct.unpack_from(order + "I", data, at)
    at += 4
    if code == 2:
        return "line", [_points(data, at, n, order)], at + 16 * n
    parts: list[list[dict]] = []
    if code == 3:
        for _ in range(n):
            (m,) = struct.unpack_from(order + "I", data, at)
            parts.append(_points(data, at + 4, m, order))
            at += 4 + 16 * m
        return "polygon", parts, at
    kind = {4: "point", 5: "line", 6: "polygon"}.get(code)
    if kind is None:
        raise ValueError(f"geometry code {code} is not a two-dimensional one")
    for _ in range(n):
        _, more, at = parse_wkb(data, at)
        parts += more
    return f"multi{kind}", parts, at


def _geopackage(layer: str | None):
    def parse(content: bytes):
        db = sqlite3.connect(":memory:")
        db.deserialize(content)
        for table, column in db.execute("select table_name, column_name from gpkg_geometry_columns order by 1").fetchall():
            if layer not in (None, table):
                continue
            cursor = db.execute(f'select * from "{table}"')
            names = [d[0] for d in cursor.description]
            for k, row in enumerate(cursor):
                cells, shape = dict(zip(names, row)), None
                blob = cells.pop(column, None)
                if blob:
                    skip = 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
                    shape = parse_wkb(blob, skip)
                yield table, k, {n: None if v is None else str(v) for n, v in cells.items()}, shape and shape[0], shape and shape[1]

    return parse


def geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """All layers' rows, or one layer's."""
    return _read(spark, path, _geopackage(layer))


def shape(record: bytes) -> tuple[str | None, list[list[dict]] | None]:
    """Kind and parts of a shapefile's record, its own head of eight bytes included."""
    (kind,) = struct.unpack_from("<i", record, 8)
    if kind == 1:
        return "point", [_points(record, 12, 1, "<")]
    if kind not in (3, 5):
        return None, None
    n, m = struct.unpack_from("<2i", record, 44)
    starts = [*struct.unpack_from(f"<{n}i", record, 52), m]
    points = _points(record, 52 + 4 * n, m, "<")
    return "polygon" if kind == 5 else "line", [points[a:b] for a, b in zip(starts, starts[1:])]


def _shapes(content: bytes):
    at, k = 100, 0
    while at + 8 <= len(content):
        (words,) = struct.unpack_from(">i", content, at + 4)
        yield "shp", k, {}, *shape(content[at : at + 8 + 2 * words])
        at, k = at + 8 + 2 * words, k + 1


def _attributes(content: bytes):
    rows, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while content[at] != 13:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("latin-1"), content[at + 16]))
        at += 32
    for k in range(rows):
        record, start, cells = content[head + k * size : head + (k + 1) * size], 1, {}
        for name, width in fields:
            cells[name] = record[start : start + width].decode("utf-8", "replace").strip() or None
            start += width
        yield "dbf", k, cells, None, None


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """path without its ending: shapes with their attributes, matched by position."""
    shapes = _read(spark, f"{path}.shp", _shapes).select("row_no", "kind", "parts")
    return shapes.join(_read(spark, f"{path}.dbf", _attributes).select("row_no", "cells"), "row_no")


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _place(reference: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", reference).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


def _workbook(content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        texts = ["".join(t.text or "" for t in si.iter(_MAIN + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_MAIN + "sheet")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n)), key=lambda n: int(re.findall("[0-9]+", n)[-1]))
        for title, sheet in zip(titles, sheets):
            root, grid = ElementTree.fromstring(z.read(sheet)), {}
            for c in root.iter(_MAIN + "c"):
                value = "".join(t.text or "" for t in c.iter(_MAIN + "t")) if c.get("t") == "inlineStr" else c.findtext(_MAIN + "v")
                grid[_place(c.get("r"))] = texts[int(value)] if c.get("t") == "s" and value is not None else value
            for merge in root.iter(_MAIN + "mergeCell"):
                (r0, c0), (r1, c1) = (_place(x) for x in merge.get("ref").split(":"))
                for cell in ((r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)):
                    if grid.get(cell) is None:
                        grid[cell] = grid.get((r0, c0))
            width = max((c for _, c in grid), default=-1) + 1
            for r in range(max((r for r, _ in grid), default=-1) + 1):
                yield title, r, {f"c{c}": grid.get((r, c)) for c in range(width)}, None, None


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """Every sheet's rows as cells c0, c1, ..., merged ranges filled where they are empty."""
    return _read(spark, path, _workbook).select("path", F.col("layer").alias("sheet"), "row_no", "cells")


def row_kind(cells) -> F.col:
    """What a sheet's row is: blank, control_total, footnote, note or data."""
    filled = F.filter(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")
    first = F.lower(F.get(filled, 0))
    return (
        F.when(F.size(filled) == 0, "blank").when(first.isin("total", "totals", "grand total", "sum"), "control_total")
        .when(first.rlike(r"^(\*|note\b|notes\b|source\b|nb\b)"), "footnote").when((F.size(filled) == 1) & (F.length(F.get(filled, 0)) > 40), "note").otherwise("data")
    )
