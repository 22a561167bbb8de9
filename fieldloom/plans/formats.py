"""Queries that write a table in some format and read it back; registered beside those of queries."""

from __future__ import annotations

import sqlite3
import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom import sources
from fieldloom.functions import geo
from fieldloom.operators import forms, quality, transfer
from fieldloom.plans.queries import query
from fieldloom.session import shared_root, table
from fieldloom.sources import binary, shapefiles, sinks


def _folder(spark, name: str) -> str:
    return f"{shared_root(spark)}/formats-{uuid.uuid4().hex}/{name}"


@query("select cast(c_custkey as varchar) c_custkey, c_name, c_mktsegment from customer")
def csv_text_round_trip(spark, sf_dir):
    path, names = _folder(spark, "customer"), ["c_custkey", "c_name", "c_mktsegment"]
    sources.write_csv(table(spark, sf_dir, "customer").select(*names), path)
    return sources.text_csv(spark, path, names)


@query("select o_orderkey, case when o_orderkey % 7 <> 0 then o_custkey end o_custkey, o_orderkey % 7 = 0 unread from orders")
def csv_typed_round_trip(spark, sf_dir):
    """Columns in another order, a byte order mark on the first name, and cells that are no numbers."""
    path, key = _folder(spark, "orders"), F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.when(key % 7 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string")).alias("﻿o_custkey"), "o_orderkey")
    sources.write_csv(o, path)
    return sources.typed_csv(spark, path, "o_orderkey bigint, o_custkey bigint").select("o_orderkey", "o_custkey", F.col("_unread").isNotNull().alias("unread"))


@query("select cast(s_suppkey as varchar) s_suppkey, s_name, case when s_suppkey % 2 = 1 then cast(s_nationkey as varchar) end s_nationkey from supplier")
def csv_union_by_name(spark, sf_dir):
    s, paths = table(spark, sf_dir, "supplier"), [_folder(spark, n) for n in ("odd", "even")]
    sources.write_csv(s.where("s_suppkey % 2 = 1").select("s_suppkey", "s_name", "s_nationkey"), paths[0])
    sources.write_csv(s.where("s_suppkey % 2 = 0").select("s_name", "s_suppkey"), paths[1])
    return sources.csv_union(spark, paths)


@query("select n_name as \"name\", 'Point' kind, '[' || n_nationkey || ',' || n_regionkey || ']' coordinates from nation")
def geojson_scan(spark, sf_dir):
    path, n = _folder(spark, "nations.geojson"), table(spark, sf_dir, "nation")
    point = F.struct(F.lit("Point").alias("type"), F.array("n_nationkey", "n_regionkey").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("n_name").alias("name")).alias("properties"), point.alias("geometry"))
    whole = n.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))  # nation has 25 rows at any scale
    whole.write.text(path)
    return sources.geojson(spark, path).select(F.get_json_object("properties", "$.name").alias("name"), "kind", "coordinates")


@query("select cast(n_nationkey as varchar) code, n_name as \"name\", n_nationkey * 0.5::double x, n_regionkey * 1.5::double y from nation")
def mapinfo_scan(spark, sf_dir):
    path, rows = _folder(spark, "nations"), table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows at any scale
    head = 'Version 300\r\nDelimiter ","\r\nCoordSys Earth Projection 1, 104\r\nColumns 2\r\n  code Char(4)\r\n  name Char(30)\r\nData\r\n\r\n'
    sinks.put(spark, f"{path}.mif", (head + "".join(f"Point {x.n_nationkey * 0.5} {x.n_regionkey * 1.5}\r\n    Symbol (34,0,9)\r\n" for x in rows)).encode())
    sinks.put(spark, f"{path}.mid", "".join(f'"{x.n_nationkey}","{x.n_name}"\r\n' for x in rows).encode())
    return sources.mif_points(spark, path, ["code", "name"], coordinates="Earth Projection 1")


_TM = geo.TransverseMercator(9, 0, 0.9996, 500_000, 0)


@query("select cast(c_custkey as varchar) code, c_name as \"name\", round(3 + c_custkey % 120 / 10, 6) x, round(4 + c_custkey % 97 / 10, 6) y from customer")
def mapinfo_projected(spark, sf_dir):
    """A pair in a transverse system, written by many tasks, comes back in degrees."""
    path, k = _folder(spark, "customers"), F.col("c_custkey")
    at = _TM.forward(3 + k % 120 / 10, 4 + k % 97 / 10)
    c = table(spark, sf_dir, "customer").select(k.alias("k"), at.alias("p"), F.format_string('"%d","%s"', k, "c_name").alias("mid"))
    place = lambda v: F.format_string("%.4f", v)
    head = spark.createDataFrame([(-1, 'Version 300\nDelimiter ","\nCoordSys Earth Projection 8, 104, "m", 9, 0, 0.9996, 500000, 0\nColumns 2\n  code Char(9)\n  name Char(30)\nData\n')], "k long, value string")
    rows = c.select("k", F.concat(F.lit("Point "), place("p.x"), F.lit(" "), place("p.y"), F.lit("\n    Symbol (34,0,9)")).alias("value"))
    head.unionByName(rows).orderBy("k").select("value").write.text(f"{path}.mif")
    c.orderBy("k").select("mid").write.text(f"{path}.mid")
    return sources.mif_points(spark, path, ["code", "name"], degrees=True).select("code", "name", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("select 'Areas' sheet, r_regionkey + 3 row_no, r_name as \"name\", cast(r_regionkey as varchar) code, '' extra, 'data' kind from region union all select 'Areas', (select count(*) from region) + 3, 'Total', null, '', 'control_total'")
def workbook_header_scan(spark, sf_dir):
    """Of three sheets the one to trust, its header found below a title, its columns by known name, slug or number."""
    path, reg = _folder(spark, "areas.xlsx"), table(spark, sf_dir, "region")
    lines = reg.select(F.col("r_regionkey").alias("n"), F.col("r_name").alias("a"), F.col("r_regionkey").cast("string").alias("b"), F.lit("").alias("c"))
    top = spark.createDataFrame([(-2, "List of areas", None, None), (-1, "Area", "Area code", "")], "n long, a string, b string, c string")
    last = reg.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit("Total").alias("a"), F.lit(None).cast("string").alias("b"), F.lit("").alias("c"))
    sheet = top.unionByName(lines).unionByName(last).orderBy("n").drop("n")
    old = spark.createDataFrame([("SUPERSEDED, see Areas", "", "", "")], "a string, b string, c string, d string")
    sinks.write_workbook(spark, {"Areas": sheet, "Old": old, "Notes": old.select("b")}, path)
    cells = binary.workbook(spark, path)
    held = cells.join(F.broadcast(transfer.authority_sheet(cells).select("sheet")), "sheet")
    named = transfer.named_cells(held, transfer.header_row(held, ["area", "area code"]), {"area": "name"})
    wide = named.groupBy("sheet", "row_no").pivot("name", ["name", "area_code", "unnamed_2"]).agg(F.first("value"))
    values = F.array("name", "area_code", "unnamed_2")
    return wide.select("sheet", "row_no", "name", F.nullif("area_code", F.lit("")).alias("code"), F.coalesce("unnamed_2", F.lit("")).alias("extra"), binary.row_kind(values).alias("kind"))


@query("select cast(s_suppkey as varchar) id, s_name as \"name\", 'point' kind, (s_suppkey * 7919) % 1009 * 1.0::double x, (s_suppkey * 104729) % 1013 * 1.0::double y from supplier")
def shapefile_round_trip(spark, sf_dir):
    path, k = _folder(spark, "suppliers"), F.col("s_suppkey")
    xy = F.struct(((k * 7919) % 1009).cast("double").alias("x"), ((k * 104729) % 1013).cast("double").alias("y"))
    sinks.write_shapefile(table(spark, sf_dir, "supplier").select(F.array(F.array(xy)).alias("parts"), k.alias("id"), F.col("s_name").alias("name")), path, "point")
    p = F.col("parts")[0][0]
    return binary.shapefile(spark, path).select(F.col("cells")["id"].alias("id"), F.col("cells")["name"].alias("name"), "kind", p["x"].alias("x"), p["y"].alias("y"))


@query("select rn row_no, cast(o_orderkey as varchar) id, o_orderstatus status, 'line' kind, 2::bigint points, o_custkey * 1.0::double x, o_orderkey % 90 * 1.0::double y from (select *, row_number() over (order by o_orderkey) - 1 rn from orders) o")
def shapefile_sets(spark, sf_dir):
    """All orders as lines, written as sets of files by many tasks and read by ranges of records, in their order."""
    path, k = _folder(spark, "orders-shapes"), F.col("o_orderkey")
    at = lambda d: F.struct((F.col("o_custkey") + d).cast("double").alias("x"), (k % 90 + d).cast("double").alias("y"))
    o = table(spark, sf_dir, "orders").select(F.array(F.array(at(0), at(1))).alias("parts"), k.alias("id"), F.col("o_orderstatus").alias("status"))
    shapefiles.write(o.orderBy(o["id"]), path, "line")
    p = F.col("parts")[0]
    return shapefiles.read(spark, path, 5_000).select("row_no", F.col("cells")["id"].alias("id"), F.col("cells")["status"].alias("status"), "kind", F.size(p).cast("long").alias("points"), p[0]["x"].alias("x"), p[0]["y"].alias("y"))


@query("select 'regions' layer, cast(r_regionkey as varchar) code, r_name as \"name\", 'polygon' kind, 5 corners, r_regionkey * 2.0::double minx from region union all select 'places', cast(n_nationkey as varchar), n_name, 'point', 1, n_nationkey * 1.0::double from nation")
def geopackage_layers(spark, sf_dir):
    """Two layers of a GeoPackage that is made here of the two tables whose size is fixed."""
    db = sqlite3.connect(":memory:")
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z integer, m integer)")
    head = b"GP\x00\x01" + struct.pack("<i", 4326)
    shapes = {
        "regions": [(x.r_regionkey, x.r_name, struct.pack("<BIII", 1, 3, 1, 5) + b"".join(struct.pack("<2d", 2.0 * x.r_regionkey + a, b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))) for x in table(spark, sf_dir, "region").collect()],
        "places": [(x.n_nationkey, x.n_name, struct.pack("<BI2d", 1, 1, x.n_nationkey, x.n_regionkey)) for x in table(spark, sf_dir, "nation").collect()],
    }
    for layer, rows in shapes.items():
        db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'GEOMETRY', 4326, 0, 0)", (layer,))
        db.execute(f"create table {layer} (code integer, name text, geom blob)")
        db.executemany(f"insert into {layer} values (?, ?, ?)", [(k, name, head + wkb) for k, name, wkb in rows])
    db.commit()
    path, first = _folder(spark, "areas.gpkg"), F.col("parts")[0]
    sinks.put(spark, path, db.serialize())
    return binary.geopackage(spark, path).select("layer", F.col("cells")["code"].alias("code"), F.col("cells")["name"].alias("name"), "kind", F.size(first).alias("corners"), F.array_min(F.transform(first, lambda p: p["x"])).alias("minx"))


_FORM = """<h:html><h:head><model>
<bind nodeset="/data/visit/size" type="int" constraint=". &gt;= 1 and . &lt;= 40" required="true()"/>
<bind nodeset="/data/visit" relevant="/data/result = '1'"/>
<bind nodeset="/data/result" type="string"/>
<bind nodeset="/data/day" type="date"/>
<bind nodeset="/data/double_size" calculate="/data/visit/size * 2"/>
</model></h:head></h:html>"""


def _form(spark, text: str) -> DataFrame:
    path = _folder(spark, "form.xml")
    sinks.put(spark, path, text.encode())
    return sources.xform_binds(spark, path)


@query("select * from (values (1, 'size', 'visit', 'submission', 'integer', 'constraint', ''), (2, 'result', '', 'submission', 'text', 'none', '1; 2; 3'), (3, 'day', '', 'submission', 'date', 'none', ''), (4, 'double_size', '', 'submission', 'derived', 'derived', '')) v(position, field, section, table_name, \"storage\", enforcement, value_set)")
def form_codebook(spark, sf_dir):
    return forms.codebook(spark, forms.load(_form(spark, _FORM)), choices={"result": ["1", "2", "3"]})


@query("select * from (values ('/data/visit/size', 'constraint', '. >= 1 and . <= 40', '. >= 1 and . <= 30'), ('/data/day', 'type', 'date', 'string')) v(nodeset, attribute, a, b)")
def form_variants(spark, sf_dir):
    """What differs between two variants of a form, but for the field that may."""
    other = _FORM.replace("&lt;= 40", "&lt;= 30").replace('type="date"', 'type="string"').replace("size * 2", "size * 3")
    return forms.differences(_form(spark, _FORM), _form(spark, other), ["double_size"])


@query("select * from (values ('unknown', 1), ('twice', 1), ('constant', 1)) v(field, problems)")
def form_lint(spark, sf_dir):
    form = [*forms.load(_form(spark, _FORM)), forms.Bind("/data/unknown", calculate="count(/data/none)"), forms.Bind("/data/twice"), forms.Bind("/data/twice"), forms.Bind("/data/constant", constraint="1 = 1")]
    return forms.lint(spark, form).groupBy("field").agg(F.count(F.lit(1)).cast("int").alias("problems"))


@query("select o_orderstatus status, count(*) n, round(sum(o_totalprice), 2) total from orders group by 1")
def staged_view(spark, sf_dir):
    name = f"staged_{uuid.uuid4().hex}"
    sources.staged(table(spark, sf_dir, "orders"), name, spark)
    return spark.sql(f"select o_orderstatus status, count(*) n, round(sum(o_totalprice), 2) total from {name} group by 1")


@query("select * from (values ('TEMPORARY', true, 2)) v(kind, \"temporary\", n)")
def catalogue_scan(spark, sf_dir):
    prefix = f"scan_{uuid.uuid4().hex}"
    for t in ("region", "nation"):
        sources.staged(table(spark, sf_dir, t), f"{prefix}_{t}", spark)
    return sources.catalogue_tables(spark).where(F.col("name").startswith(prefix)).groupBy("kind", "temporary").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("select s_suppkey, s_name, true kept from supplier where s_suppkey % 3 = 0")
def table_replaced(spark, sf_dir):
    """A table made, then made anew with other columns and fewer rows; what it holds then, its siblings as they were."""
    s, folder = table(spark, sf_dir, "supplier"), _folder(spark, "layers")
    sources.write_layers({"suppliers": s, "nations": table(spark, sf_dir, "nation")}, folder)
    sources.write_layers({"suppliers": s.where("s_suppkey % 3 = 0").select("s_suppkey", "s_name")}, folder)
    other = spark.read.parquet(f"{folder}/nations").agg((F.count(F.lit(1)) == 25).alias("kept"))
    return spark.read.parquet(f"{folder}/suppliers").crossJoin(F.broadcast(other))  # one row


@query("select 1 step, 'added' outcome, (select count(*) from customer where c_custkey % 2 = 0) n union all select 2, 'refused', 0 union all select 3, 'refused', 0 union all select 4, 'added', (select count(*) from customer where c_custkey % 2 = 1) union all select 5, 'held', (select count(*) from customer)")
def checked_appends(spark, sf_dir):
    """Appends in turn: good rows, the same again, rows without a parent, the rest."""
    c, path = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), _folder(spark, "customer")
    rules = quality.Catalogue([quality.Constraint("pk", "customer", "primary_key", ("c_custkey",)), quality.Constraint("fk", "customer", "foreign_key", ("c_nationkey",), parent="nation", parent_columns=("n_nationkey",))])
    even, odd, up, rows = c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1"), {"nation": table(spark, sf_dir, "nation")}, []
    for step, batch in enumerate((even, even, odd.withColumn("c_nationkey", F.col("c_nationkey") + 1000), odd), 1):
        try:
            rows.append((step, "added", sinks.append_checked(batch, path, "customer", rules, up)))
        except quality.ViolationError:
            rows.append((step, "refused", 0))
    held = spark.read.parquet(path).agg(F.lit(5).alias("step"), F.lit("held").alias("outcome"), F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame(rows, "step int, outcome string, n long").unionByName(held)


@query("select * from (values (1, true), (2, false), (3, true)) v(step, wrote)")
def writes_of_changes(spark, sf_dir):
    s, path = table(spark, sf_dir, "supplier"), _folder(spark, "supplier")
    turns = (s, s.orderBy(F.desc("s_suppkey")), s.withColumn("s_acctbal", F.col("s_acctbal") + 1))
    return spark.createDataFrame([(k, sinks.write_if_changed(df, path)) for k, df in enumerate(turns, 1)], "step int, wrote boolean")


@query("select count(*) suppliers, round(sum(s_acctbal), 2) balance from supplier")
def sidecar_round_trip(spark, sf_dir):
    path, one = _folder(spark, "facts.json"), table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).cast("double").alias("b")).first()
    sources.write_sidecar(spark, {"suppliers": one.n, "balance": one.b}, path)
    return spark.read.text(path).select(F.get_json_object("value", "$.suppliers").cast("long").alias("suppliers"), F.get_json_object("value", "$.balance").cast("double").alias("balance"))


@query("select 0 line, '| r_name | n | share |' as \"text\" union all select 1, '|---|---|---|' union all select 2 + row_number() over (order by r_name) - 1, printf('| %s | %d | %.1f |', r_name, n, 4.0 * n) from (select r_name, count(*) n from region join nation on n_regionkey = r_regionkey group by 1) q")
def markdown_table(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per = n.groupBy("r_name").agg(F.count(F.lit(1)).alias("n")).withColumn("share", 4.0 * F.col("n").cast("double")).orderBy("r_name")
    return spark.createDataFrame(list(enumerate(sources.markdown(per, {"share": "{:.1f}"}).split("\n"))), "line int, text string")


@query("select * from (values (1, 'read', 'done'), (2, 'check', 'failed'), (3, 'write', 'not run')) v(position, stage, status)")
def stage_run(spark, sf_dir):
    def check():
        raise ValueError("outputs missing") if sinks.missing_outputs(spark, [_folder(spark, "none")]) else None

    return sinks.run_stages(spark, [("read", lambda: table(spark, sf_dir, "region").count()), ("check", check), ("write", check)]).select("position", "stage", "status")


@query("select 'region' table_name, 1 place, 1 creates, 0 parents, 0 spatial union all select 'nation', 2, 1, 1, 1")
def ddl_of_tables(spark, sf_dir):
    """Statements for two tables: parents first, a foreign key on the child, an index on its geometry."""
    tables = {"nation": table(spark, sf_dir, "nation").withColumn("geom", F.lit(None).cast("string")), "region": table(spark, sf_dir, "region")}
    rules = quality.Catalogue([quality.Constraint("fk", "nation", "foreign_key", ("n_regionkey",), parent="region", parent_columns=("r_regionkey",)), quality.Constraint("pk", "region", "primary_key", ("r_regionkey",))])
    text = quality.schema_ddl(tables, rules, {"nation": ("geom", "Point", 4326)})
    rows = [(t, 1 if text.index(f"CREATE TABLE {t} ") < text.index(f"CREATE TABLE {'region' if t == 'nation' else 'nation'} ") else 2, text.count(f"CREATE TABLE {t} "), sum(s.startswith(f"ALTER TABLE {t} ") and "REFERENCES" in s for s in text.split("\n")), text.count(f"ON {t} USING GIST")) for t in ("region", "nation")]
    return spark.createDataFrame(rows, "table_name string, place int, creates int, parents int, spatial int")


@query("with a as (select (select sum(o_totalprice) from orders) e, (select count(*) from orders) n) select 'orders' \"check\", cast(n as double) expected, cast(n as double) actual, 'PASS' verdict from a union all select 'priced', cast(n as double), cast((select count(*) from orders where o_totalprice > 1000000) as double), 'FAIL' from a")
def control_totals(spark, sf_dir):
    o, n = table(spark, sf_dir, "orders"), F.count(F.lit(1))
    whole = o.agg(n)
    return transfer.control_totals([("orders", whole, o.groupBy("o_orderstatus").agg(n.alias("n")).agg(F.sum("n"))), ("priced", whole, o.where("o_totalprice > 1000000").agg(n))])
