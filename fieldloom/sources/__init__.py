"""Readers and writers of the formats that field data come in."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions import geo


def text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV whose cells all stay text, a byte order mark on the first name tolerated."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=True)


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV read by a schema, matched by name whatever the order of its columns; a byte order mark is no part of a name.

    Cells that are not of their type are null, and `_unread` holds such a row's text.
    """
    names = spark.read.csv(path, header=True).columns
    wanted = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}
    lost = set(wanted) - {n.lstrip("\ufeff") for n in names}
    if lost:
        raise ValueError(f"{path} lacks {sorted(lost)}")
    fields = [T.StructField(n.lstrip("\ufeff"), wanted.get(n.lstrip("\ufeff"), T.StringType())) for n in names]
    whole = spark.read.schema(T.StructType([*fields, T.StructField("_unread", T.StringType())])).csv(path, header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_unread")
    return whole.select(*wanted, "_unread")


def staged(df, name: str, spark: SparkSession) -> DataFrame:
    """A frame, of pandas or of Spark, as a view of that name for SQL."""
    view = df if isinstance(df, DataFrame) else spark.createDataFrame(df)
    view.createOrReplaceTempView(name)
    return spark.table(name)


def replace_table(df: DataFrame, name: str, format: str = "parquet") -> DataFrame:
    """The table of that name made anew from df, which may not read it."""
    df.write.format(format).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def csv_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several CSV files by column name, whatever their order; names that a file lacks are null."""
    parts = []
    for path in paths:
        part = spark.read.csv(path, header=True)
        parts.append(part.toDF(*[c.lstrip("﻿") for c in part.columns]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """A row per feature: properties as JSON text, geometry type, coordinates as JSON text."""
    whole = spark.read.text(path, wholetext=True)
    features = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    f = F.col("feature")
    return whole.select(F.explode(features).alias("feature")).select(
        F.get_json_object(f, "$.properties").alias("properties"), F.get_json_object(f, "$.geometry.type").alias("kind"), F.get_json_object(f, "$.geometry.coordinates").alias("coordinates")
    )


def xform_binds(spark: SparkSession, path: str) -> DataFrame:
    """The bind elements of a form definition: nodeset, type, constraint, relevant, required, calculate."""
    whole = spark.read.text(path, wholetext=True)
    binds = F.regexp_extract_all("value", F.lit(r"(?s)<(?:\w+:)?bind\b[^>]*>"), F.lit(0))
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    attribute = lambda n: F.nullif(plain(F.regexp_extract("bind", rf'(?s)\b{n}="([^"]*)"', 1)), F.lit("")).alias(n)
    return whole.select(F.explode(binds).alias("bind")).select(*[attribute(n) for n in ("nodeset", "type", "constraint", "relevant", "required", "calculate")])


def xform_choices(spark: SparkSession, path: str) -> DataFrame:
    """(nodeset, list, choice_filter) of each question whose choices come from a list: the list's name and the filter on its rows."""
    whole = spark.read.text(path, wholetext=True)
    selects = F.regexp_extract_all("value", F.lit(r"(?s)<(?:\w+:)?select1?\b[^>]*>.*?</(?:\w+:)?select1?>"), F.lit(0))
    plain = lambda c: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")], c)
    rows = whole.select(F.explode(selects).alias("s")).select(plain(F.regexp_extract("s", r'^[^>]*?\bref="([^"]*)"', 1)).alias("nodeset"), plain(F.regexp_extract("s", r'(?s)<(?:\w+:)?itemset\b[^>]*?\bnodeset="([^"]*)"', 1)).alias("rows"))
    found = rows.select("nodeset", F.regexp_extract("rows", r"instance\('([^']+)'\)", 1).alias("list"), F.regexp_extract("rows", r"(?s)\[(.*)\]\s*$", 1).alias("choice_filter"))
    return found.where("list <> ''")


def _lines(spark: SparkSession, path: str, keep: Column, name: str) -> DataFrame:
    """(n, name): the kept lines of a text, numbered from 0 in their order; each split of a file numbers its own.

    Only the count of lines per split meets in one place, so a file of any size is read by as many tasks as it has splits.
    """
    split = ["_file", "_block"]
    told = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias(name)).where(keep)
    sizes = told.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*split, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = told.withColumn("_at", F.row_number().over(Window.partitionBy(*split).orderBy("_id")))
    return placed.join(F.broadcast(starts), split).select((F.col("_start") + F.col("_at") - 1).alias("n"), name)


def mif_points(spark: SparkSession, path: str, names: list[str], delimiter: str = ",", coordinates: str | None = None, degrees: bool = False) -> DataFrame:
    """A MapInfo pair of points: the n-th `Point x y` line of .mif with the n-th line of .mid.

    coordinates: what the header's CoordSys line must begin with; another system, or none, is an error.
    degrees: x and y become longitude and latitude by the projection that the header names (geo.header_system).
    """
    system, unit = None, 1.0
    if coordinates is not None or degrees:
        told = spark.read.text(f"{path}.mif").select(F.regexp_extract("value", r"(?i)^\s*CoordSys\s+(.*?)\s*$", 1).alias("s")).where("s <> ''").first()
        found = told[0] if told else ""
        if coordinates is not None and not found.lower().startswith(coordinates.lower()):
            raise ValueError(f"{path}.mif is in {found!r}, not in {coordinates!r}")
        if degrees:
            system, unit = geo.header_system(found)
    points = _lines(spark, f"{path}.mif", F.col("p").rlike(r"(?i)^\s*Point\s+\S+\s+\S+"), "p")
    lines = _lines(spark, f"{path}.mid", F.trim("line") != "", "line")
    row = F.from_csv("line", ", ".join(f"`{c}` string" for c in names), {"sep": delimiter})
    part = lambda k: F.regexp_extract("p", r"(?i)^\s*Point\s+(\S+)\s+(\S+)", k).try_cast("double") * unit
    out = points.join(lines, "n").select(row.alias("r"), part(1).alias("x"), part(2).alias("y"))
    if system is not None:
        out = out.select("r", system.inverse(F.col("x"), F.col("y")).alias("_at")).select("r", F.col("_at.lon").alias("x"), F.col("_at.lat").alias("y"))
    return out.select("r.*", "x", "y")


def markdown(df: DataFrame, formats: dict[str, str] | None = None, rows: int = 1000) -> str:
    """A table of at most `rows` rows for a report, more are an error; numbers by format, null as nothing."""
    show = lambda c, v: "" if v is None or v != v else (formats or {}).get(c, "{}").format(v)
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows are no table for a report")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(show(c, v).replace("|", "\\|") for c, v in zip(df.columns, r)) + " |" for r in found]
    return "\n".join(lines)


def write_layers(layers: dict[str, DataFrame], folder: str) -> None:
    """One parquet folder per layer; a layer is overwritten alone and its siblings stay."""
    for name, df in layers.items():
        if not re.fullmatch(r"[A-Za-z0-9_]+", name):
            raise ValueError(f"not a layer name: {name}")
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_sidecar(spark: SparkSession, facts: dict, path: str) -> None:
    """A small JSON document beside an output."""
    spark.range(1).select(F.lit(json.dumps(facts, sort_keys=True)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def catalogue_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """The tables and views that the session knows: name, database, kind, temporary."""
    rows = [(t.name, ".".join(t.namespace or []), t.tableType or "", bool(t.isTemporary)) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "name string, database string, kind string, temporary boolean")
