"""Attributes that move from one table to another: by key, by place, from the nearer or the fuller source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.geo import bbox, edge_distance, edges
from fieldloom.functions.text import slug
from fieldloom.operators.ordering import small


def transferred(target: DataFrame, source: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """target with columns of source by key; of repeated keys the row last in order counts."""
    last = source.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in columns])
    return target.drop(*columns).join(last, key, "left")


def one_to_one(left: DataFrame, right: DataFrame, key: str, suffix: str = "_right") -> DataFrame:
    """A left join that a repeated key on either side stops; columns of both sides get a suffix on the right."""
    for name, df in (("left", left), ("right", right)):
        many = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col(key).isNotNull()).limit(3).collect()
        if many:
            raise ValueError(f"keys repeat on the {name}: {', '.join(str(r[key]) for r in many)}")
    shared = [c for c in right.columns if c != key and c in left.columns]
    return left.join(right.withColumnsRenamed({c: c + suffix for c in shared}), key, "left")


def box_join(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """points(x, y, ...) with polygons(ring, ...) whose bounding box holds them, box edges included."""
    cell = lambda c: F.floor(c / size).cast("long")
    dealt = polygons.withColumn("_b", bbox(F.col("ring")))
    dealt = dealt.withColumn("_cx", F.explode(F.sequence(cell(F.col("_b.minx")), cell(F.col("_b.maxx")))))
    dealt = dealt.withColumn("_cy", F.explode(F.sequence(cell(F.col("_b.miny")), cell(F.col("_b.maxy"))))).drop("ring")
    held = F.col("x").between(F.col("_b.minx"), F.col("_b.maxx")) & F.col("y").between(F.col("_b.miny"), F.col("_b.maxy"))
    return points.join(dealt, (cell(F.col("x")) == F.col("_cx")) & (cell(F.col("y")) == F.col("_cy")) & held).drop("_b", "_cx", "_cy")


def category_score(rows: DataFrame, by: list[str], category: str, weights: dict[str, int]) -> DataFrame:
    """(by..., score, n): the sum of the categories' weights over all rows, uncategorised ones included."""
    value = reduce(lambda acc, kv: acc.when(F.col(category) == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 0)).otherwise(0)
    return rows.groupBy(*by).agg((F.sum(value) / F.count(F.lit(1))).alias("score"), F.count(F.lit(1)).alias("n"))


def snapped(outside: DataFrame, polygons: DataFrame, reach: float, rounds: int = 40, ties: bool = False) -> DataFrame:
    """outside(id, x, y) with the nearest of polygons(zone, ring), its distance, and what a ledger says of it.

    Of polygons equally near the least zone counts; with ties each of them gives a row.

    Polygons are dealt to the cells of their box; a point looks in rings of cells that double until
    the nearest is no farther than the ring, so neither side is paired with all of the other.
    """
    from fieldloom.session import cut

    found, open_, far = [], outside.select("id", "x", "y"), reach
    if polygons.isEmpty():
        return open_.limit(0).select("id", F.lit(None).cast("string").alias("zone"), F.lit(0.0).alias("distance"), F.lit("").alias("outcome"), F.lit(0.0).alias("confidence"))
    kept = cut(polygons.select("zone", bbox(F.col("ring")).alias("_b"), edges(F.col("ring")).alias("_edges")))
    for _ in range(rounds):
        cell = lambda c, d=far: F.floor(c / d).cast("long")
        dealt = kept.withColumn("_cx", F.explode(F.sequence(cell(F.col("_b.minx") - far), cell(F.col("_b.maxx") + far))))
        dealt = dealt.withColumn("_cy", F.explode(F.sequence(cell(F.col("_b.miny") - far), cell(F.col("_b.maxy") + far))))
        placed = open_.withColumn("_cx", cell(F.col("x"))).withColumn("_cy", cell(F.col("y")))
        pairs = placed.join(dealt, ["_cx", "_cy"]).select("id", "zone", edge_distance(F.col("_edges"), F.col("x"), F.col("y")).alias("distance")).where(F.col("distance") <= far)
        if ties:
            least = pairs.groupBy("id").agg(F.min("distance").alias("_d"))
            near = cut(pairs.join(least, "id").where(F.col("distance") == F.col("_d")).drop("_d"))
        else:
            near = cut(pairs.groupBy("id").agg(F.min(F.struct("distance", "zone")).alias("_m")).select("id", "_m.zone", "_m.distance"))
        found.append(near)
        open_ = cut(open_.join(near.select("id"), "id", "left_anti"))
        if open_.isEmpty():
            break
        far *= 2
    else:
        raise ValueError(f"no polygon within {far} after {rounds} rounds; take a larger reach")
    whole = reduce(DataFrame.unionByName, found)
    return whole.withColumn("outcome", F.lit("resolved_review")).withColumn("confidence", F.lit(0.7))


def preferred(full: DataFrame, other: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """full(key, value) kept as it is, and a ledger of where other(key, value) lacks it or differs after rounding."""
    both = full.join(other.select(key, F.col(value).alias("_o")), key, "left")
    missing, differs = F.col("_o").isNull(), F.bround("_o", 0) != F.bround(value, 0)
    entry = both.where(missing | differs).select(
        F.col(key).cast("string").alias("entity_id"), F.lit(value).alias("field"), F.col("_o").cast("string").alias("raw_value"), F.col(value).cast("string").alias("resolved_value"),
        F.lit("prefer_complete_source").alias("method"), F.when(missing, 1.0).otherwise(0.9).alias("confidence"), F.when(missing, "resolved").otherwise("resolved_review").alias("outcome"),
    )
    return both.drop("_o"), entry


def overridden(rows: DataFrame, declared: str, found: str, key: str) -> tuple[DataFrame, DataFrame]:
    """rows whose declared place gives way to where they were found, and a ledger of the mismatches."""
    differs = F.col(found).isNotNull() & ~F.col(declared).eqNullSafe(F.col(found))
    entry = rows.where(differs).select(F.col(key).cast("string").alias("entity_id"), F.lit(declared).alias("field"), F.col(declared).cast("string").alias("raw_value"), F.col(found).cast("string").alias("resolved_value"), F.lit("spatial_override").alias("method"), F.lit(0.95).alias("confidence"), F.lit("resolved").alias("outcome"))
    return rows.withColumn(declared, F.coalesce(found, declared)), entry


def header_row(cells: DataFrame, tokens: list[str], first: int = 25) -> DataFrame:
    """cells(sheet, row_no, cells map) -> (sheet, header_no, hits): of the first rows the one with most known names, the earlier on ties; at least two."""
    lower = F.transform(F.map_values("cells"), lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    hits = F.size(F.filter(lower, lambda c: c.isin(tokens)))
    counted = cells.where(F.col("row_no") < first).select("sheet", "row_no", hits.alias("hits"))
    best = counted.groupBy("sheet").agg(F.max(F.struct("hits", (-F.col("row_no")).alias("_n"))).alias("_m"))
    return best.where("_m.hits >= 2").select("sheet", (-F.col("_m._n")).alias("header_no"), "_m.hits")


def named_cells(cells: DataFrame, headers: DataFrame, names: dict[str, str]) -> DataFrame:
    """The rows below each sheet's header, their cells keyed by the known name of the column, its slug, or unnamed_<n>."""
    heads = cells.join(headers, "sheet").where("row_no = header_no").select("sheet", "header_no", F.col("cells").alias("_head"))
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<string,string>")

    def name(k: Column, v: Column) -> Column:
        text = F.lower(F.trim(F.coalesce(v, F.lit(""))))
        return F.coalesce(F.try_element_at(pairs, text), F.nullif(slug(text), F.lit("")), F.concat(F.lit("unnamed_"), F.substring(k, 2, 9)))

    labelled = heads.withColumn("_names", F.map_from_entries(F.transform(F.map_entries("_head"), lambda e: F.struct(e["key"].alias("key"), name(e["key"], e["value"]).alias("value")))))
    below = cells.join(small(labelled.drop("_head")), "sheet").where("row_no > header_no")
    entries = F.filter(F.map_entries("cells"), lambda e: F.try_element_at(F.col("_names"), e["key"]).isNotNull())
    grouped = F.transform(entries, lambda e: F.struct(F.element_at(F.col("_names"), e["key"]).alias("name"), F.trim(e["value"]).alias("value")))
    return below.select("sheet", "row_no", F.explode(grouped).alias("_c")).select("sheet", "row_no", "_c.*")


#: Words by which a sheet says that another has replaced it.
SUPERSEDED = ("superseded", "do not use", "obsolete", "deprecated", "archive")


def authority_sheet(cells: DataFrame, top: int = 4, width: int = 3, markers: tuple[str, ...] = SUPERSEDED) -> DataFrame:
    """(sheet, width, filled) of the sheet to trust: not marked in its first rows, wide enough, then widest, then fullest."""
    values = F.filter(F.transform(F.map_values("cells"), lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))), lambda c: c != "")
    marked = F.exists(values, lambda c: reduce(lambda a, b: a | b, [c.contains(m) for m in markers])) & (F.col("row_no") < top)
    per = cells.groupBy("sheet").agg(F.max(F.size(values)).alias("width"), F.count_if(F.size(values) > 0).alias("filled"), F.max(marked).alias("_old"))
    return per.where(~F.col("_old") & (F.col("width") >= width)).orderBy(F.desc("width"), F.desc("filled"), "sheet").limit(1).drop("_old")


def control_totals(checks: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(check, expected, actual, verdict) of (name, one expected number, one actual number)."""
    rows = []
    for name, expected, actual in checks:
        e, a = (df.toDF("v").select(F.col("v").cast("double")) for df in (expected, actual))
        one = e.withColumnRenamed("v", "expected").crossJoin(a.withColumnRenamed("v", "actual"))  # one row each
        rows.append(one.select(F.lit(name).alias("check"), "expected", "actual", F.when(F.col("expected").eqNullSafe(F.col("actual")), "PASS").otherwise("FAIL").alias("verdict")))
    return reduce(DataFrame.unionByName, rows)


def lookup_problems(codes: DataFrame, reserved: tuple[str, ...] = ("96", "98", "99")) -> DataFrame:
    """(code, problem): codes that a lookup repeats, and those kept for other, unknown and refused."""
    repeated = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("code").cast("string").alias("code"), F.lit("repeated").alias("problem"))
    kept = codes.where(F.col("code").cast("string").isin(*reserved)).select(F.col("code").cast("string").alias("code"), F.lit("reserved").alias("problem")).distinct()
    return repeated.unionByName(kept)
