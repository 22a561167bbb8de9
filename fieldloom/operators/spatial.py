"""Spatial operators over grid cells: joins, neighbours, hot spots, catchments, networks."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.geo import bbox, edges, intersects, representative_point, within
from fieldloom.operators.networks import components, travel_times  # noqa: F401
from fieldloom.operators.ordering import numbered
from fieldloom.session import Rounds, cut


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def _cells(df: DataFrame, x: Column, y: Column, reach: Column | float, size: float) -> DataFrame:
    """df with a row for each cell within reach of (x, y)."""
    span = lambda c: F.sequence(_cell(c - reach, size), _cell(c + reach, size))
    return df.withColumn("_cx", F.explode(span(x))).withColumn("_cy", F.explode(span(y)))


def polygon_join(points: DataFrame, polygons: DataFrame, size: float, how: str = "inner", boundary: bool = True) -> DataFrame:
    """points(x, y, ...) with polygons(ring, ...) that hold them: cells as an equi-join, then the exact test.

    A polygon is dealt to the cells of its box, so points only meet polygons near by and either side may be large.
    """
    box = bbox(F.col("ring"))
    dealt = polygons.withColumn("_b", box).withColumn("_edges", edges(F.col("ring")))
    dealt = dealt.withColumn("_cx", F.explode(F.sequence(_cell(F.col("_b.minx"), size), _cell(F.col("_b.maxx"), size))))
    dealt = dealt.withColumn("_cy", F.explode(F.sequence(_cell(F.col("_b.miny"), size), _cell(F.col("_b.maxy"), size)))).drop("_b", "ring")
    placed = points.withColumn("_px", _cell(F.col("x"), size)).withColumn("_py", _cell(F.col("y"), size))
    test = (intersects if boundary else within)(F.col("_edges"), F.col("x"), F.col("y"))
    joined = placed.join(dealt, (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & test, how)
    return joined.drop("_px", "_py", "_cx", "_cy", "_edges")


def within_distance(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs (i, j, dist2) of left(i, x, y) and right(j, x, y) at most radius apart; cells have the radius's size."""
    near = _cells(right.select("j", F.col("x").alias("_x"), F.col("y").alias("_y")), F.col("_x"), F.col("_y"), radius, radius)
    placed = left.select("i", "x", "y").withColumn("_cx", _cell(F.col("x"), radius)).withColumn("_cy", _cell(F.col("y"), radius))
    dist2 = (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y"))
    return placed.join(near, ["_cx", "_cy"]).withColumn("dist2", dist2).where(F.col("dist2") <= radius * radius).select("i", "j", "dist2")


#: Points that a cell of the first ring may hold; a fuller one makes the ring, and the leaves, smaller.
CELL_POINTS = 4096
#: Points of the fullest cell that one leaf may hold, if points lie evenly in the cell.
LEAF_POINTS = 64


def _squared(x: Column, y: Column) -> Column:
    return x * x + y * y


def _outside(low: Column, high: Column, a: Column, b: Column) -> Column:
    """How far the span (a, b) lies outside (low, high)."""
    return F.greatest(low - b, a - high, F.lit(0.0))


def _reach(low: Column, high: Column, a: Column, b: Column) -> Column:
    return F.greatest(high - a, b - low)


def _placed(df: DataFrame) -> DataFrame:
    """df with x and y as doubles, without the rows that have no place."""
    df = df.withColumns({c: F.col(c).cast("double") for c in ("x", "y")})
    return df.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in ("x", "y")))


def _fullest(points: DataFrame, size: float) -> tuple[int, int]:
    """Points in the fullest cell of that size, and points in all."""
    found = points.groupBy(_cell(F.col("x"), size), _cell(F.col("y"), size)).count().agg(F.max("count"), F.sum("count")).first()
    return found[0] or 0, found[1] or 0


class _Leaves:
    """right(j, x, y) in leaves, small cells with the box of what they hold.

    The first ring is the caller's radius, quartered (16 times at most) until no cell of that size holds more than
    CELL_POINTS points; of many points at one place only the first k by j can count, so no others are kept.
    """

    def __init__(self, right: DataFrame, k: int, radius: float):
        points = _placed(right.select("j", "x", "y"))
        fullest, every = _fullest(points, radius)
        self.k, self.start, self.total = k, radius, min(k, every)
        if fullest > LEAF_POINTS:
            at = Window.partitionBy("x", "y").orderBy("j")
            points = points.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= k).drop("_n")
            fullest, n = _fullest(points, radius)[0], 0
            while fullest > CELL_POINTS and n < 16:
                self.start, n = self.start / 4, n + 1
                fullest = _fullest(points, self.start)[0]
        self.side = next((n for n in (1, 2, 4) if n * n * LEAF_POINTS >= fullest), 8)
        size = self.start / self.side
        self.points = points.select("j", F.col("x").alias("_x"), F.col("y").alias("_y"), _cell(F.col("x"), size).alias("_fx"), _cell(F.col("y"), size).alias("_fy"))

    @cached_property
    def leaves(self) -> DataFrame:
        ends = [f(c).alias(f"{c}{n}") for c in ("_x", "_y") for f, n in ((F.min, "0"), (F.max, "1"))]
        return cut(self.points.groupBy("_fx", "_fy").agg(F.count(F.lit(1)).alias("_n"), *ends))

    def _near(self, pairs: DataFrame, by: list[str], x: tuple[Column, Column], y: tuple[Column, Column], far: float) -> DataFrame:
        """pairs of a box of searchers and a leaf, less those beyond the distance within which the others hold k points.

        Differences, squares and sums are rounded monotonically, so a leaf's bounds hold for the rounded distances of its points too.
        """
        box = [F.col(c) for c in ("_x0", "_x1", "_y0", "_y1")]
        low = _squared(_outside(*box[:2], *x), _outside(*box[2:], *y))
        high = _squared(_reach(*box[:2], *x), _reach(*box[2:], *y))
        so_far = F.sum("_n").over(Window.partitionBy(*by).orderBy("_high"))
        inside = pairs.withColumns({"_low": low, "_high": high}).where(F.col("_low") <= far * far).withColumn("_held", so_far)
        limit = F.min(F.when(F.col("_held") >= self.k, F.col("_high"))).over(Window.partitionBy(*by))
        return inside.withColumn("_limit", limit).where(F.col("_limit").isNull() | (F.col("_low") <= F.col("_limit"))).drop("_low", "_high", "_held", "_limit")

    def ranked(self, left: DataFrame, far: float) -> DataFrame:
        """(i, j, dist2, rank): of right the k nearest to each of left that are at most far away, ties by j.

        Blocks of searchers meet the leaves around them, then each searcher the leaves left to its block, and only then points.
        Where a cell of the first ring holds no more than a leaf may, searchers meet the points of the cells at once, up to twice that ring.
        """
        order = Window.partitionBy("i").orderBy("dist2", "j")
        rank = F.row_number().over(order)
        if self.side == 1 and far <= 2 * self.start:
            points = self.points.select("j", F.col("_x").alias("x"), F.col("_y").alias("y"))
            return within_distance(_placed(left.select("i", "x", "y")), points, far).withColumn("rank", rank).where(F.col("rank") <= self.k)
        cell, side = [_cell(F.col(c), far) for c in ("x", "y")], far / 8
        keys = ["_cx", "_cy", "_sx", "_sy"]
        placed = _placed(left.select("i", "x", "y")).select("i", "x", "y", *[c.alias(n) for c, n in zip([*cell, _cell(F.col("x"), side), _cell(F.col("y"), side)], keys)])
        ends = [f(c).alias(f"_{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "a"), (F.max, "b"))]
        blocks = placed.groupBy(*keys).agg(*ends)
        around = lambda c: F.explode(F.sequence(_cell(F.col(f"{c}0") - far, far), _cell(F.col(f"{c}1") + far, far)))
        dealt = self.leaves.withColumn("_cx", around("_x")).withColumn("_cy", around("_y"))
        met = self._near(blocks.join(dealt, ["_cx", "_cy"]), keys, (F.col("_a_x"), F.col("_b_x")), (F.col("_a_y"), F.col("_b_y")), far)
        own = placed.join(met.select(*keys, "_fx", "_fy", "_n", "_x0", "_x1", "_y0", "_y1"), keys)
        own = self._near(own, ["i"], (F.col("x"), F.col("x")), (F.col("y"), F.col("y")), far).select("i", "x", "y", "_fx", "_fy")
        pairs = own.join(self.points, ["_fx", "_fy"]).withColumn("dist2", _squared(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")))
        return pairs.where(F.col("dist2") <= far * far).select("i", "j", "dist2").withColumn("rank", rank).where(F.col("rank") <= self.k)


def nearest(left: DataFrame, right: DataFrame, k: int, radius: float, rounds: int = 40) -> DataFrame:
    """The k nearest of right(j, x, y) to each of left(i, x, y), ties by j: rings that double until k are proven near.

    Points lie in leaves, cells so small that few share one; a searcher meets the points of those leaves alone that
    may hold one of its k, so a dense cell costs no more than a sparse one. Rows without a finite place have no
    neighbours and are none. i is unique in left.
    """
    rounds_, open_ = Rounds(left.sparkSession), _placed(left.select("i", "x", "y"))
    leaves = _Leaves(right, k, radius)
    found, far, lacking, total = [], leaves.start, open_.count(), leaves.total
    while total and lacking:
        whole = F.max("rank").over(Window.partitionBy("i")) == total
        pairs = rounds_.keep(f"pairs{len(found)}", leaves.ranked(open_, far).withColumn("_whole", whole).where("_whole").drop("_whole"))
        found.append(pairs)
        lacking -= pairs.where(F.col("rank") == total).count()
        if lacking:
            open_ = rounds_.keep("open", open_.join(pairs.where(F.col("rank") == total).select("i"), "i", "left_anti"))
            far *= 4 if far < radius else 2
            if far >= radius * 2.0**rounds:
                raise ValueError(f"no {k} neighbours within {far / 2} after {rounds} rounds; take a larger radius")
    return reduce(DataFrame.unionByName, found) if found else leaves.ranked(left.limit(0), radius)


def connectors(left: DataFrame, right: DataFrame, k: int, limit: float, radius: float) -> DataFrame:
    """The k nearest of right to each of left, none further than limit; rings go no further than that."""
    leaves = _Leaves(right, k, min(radius, limit))
    near = leaves.ranked(left, min(radius, limit))
    if radius >= limit:
        return near
    full = near.where(F.col("rank") == k).select("i")
    rest = left.join(full, "i", "left_anti")
    return near.join(full, "i", "left_semi").unionByName(leaves.ranked(rest, limit))


def misplaced(points: DataFrame, polygons: DataFrame, key: str) -> DataFrame:
    """points(key, x, y) that do not lie within the polygon (key, ring) that they name."""
    named = points.join(polygons.select(key, edges(F.col("ring")).alias("_e")), key)
    return named.where(~within(F.col("_e"), F.col("x"), F.col("y"))).drop("_e")


def counterfactual(run, sites: DataFrame, state: str = "state", to: str = "adequate") -> DataFrame:
    """run(sites) as things are and, by the same function, with every site raised to one state; `scenario` tells them apart."""
    base = run(sites).withColumn("scenario", F.lit("base"))
    return base.unionByName(run(sites.withColumn(state, F.lit(to))).withColumn("scenario", F.lit("upgraded")))


def _variants(distance: DataFrame, grid: list[tuple]) -> list[Column]:
    """For each (threshold, kmh, treatment, counts), whether a point with metres to the nearest `adequate` and `unknown` site is covered."""
    minutes = lambda c, kmh: F.col(c) / 1000 / kmh * 60
    hit = lambda t, s, u: F.coalesce(minutes("adequate", s) <= t, F.lit(False)) | (F.coalesce(minutes("unknown", s) <= t, F.lit(False)) if u else F.lit(False))
    return [hit(t, s, u) for t, s, _, u in grid]


def _nearest_by_state(distance: DataFrame, keep: list[str]) -> DataFrame:
    of = lambda s: F.min(F.when(F.col("state") == s, F.col("metres"))).alias(s)
    return distance.groupBy("i").agg(of("adequate"), of("unknown"), *[F.first(c).alias(c) for c in keep])


def _stacked(df: DataFrame, grid: list[tuple], columns: list[str], values: list[list[Column]]) -> DataFrame:
    """df's rows once for each of grid, with its own values; made after the sums, so few rows are multiplied."""
    rows = [F.struct(F.lit(t).alias("threshold"), F.lit(s).alias("kmh"), F.lit(n).alias("treatment"), *[c.alias(k) for k, c in zip(columns, v)]) for (t, s, n, _), v in zip(grid, values)]
    return df.select(*df.columns, F.inline(F.array(*rows)))


def access_sweep(distance: DataFrame, zones: DataFrame, thresholds: list[float], speeds: list[float], unknown: dict[str, bool]) -> DataFrame:
    """distance(i, metres, state, pop, zone): the share of people covered for every threshold, speed and treatment of unknown sites.

    distance holds each demand point's nearest adequate and nearest unassessed site (state 'adequate' or
    'unknown'); distances are measured once, and each setting is a sum under a condition.
    """
    grid = [(float(t), float(s), n, u) for t in thresholds for s in speeds for n, u in unknown.items()]
    sums = [F.sum(F.when(h, F.col("pop")).otherwise(0.0)).alias(f"_v{n}") for n, h in enumerate(_variants(distance, grid))]
    # the sums are of one row
    one = _nearest_by_state(distance, ["pop"]).agg(*sums).crossJoin(F.broadcast(zones.agg(F.sum("pop").alias("all"))))
    out = _stacked(one, grid, ["covered"], [[F.coalesce(F.col(f"_v{n}"), F.lit(0.0))] for n in range(len(grid))])
    return out.select("threshold", "kmh", "treatment", "covered", F.try_divide("covered", "all").alias("share"))


def access_table(distance: DataFrame, zones: DataFrame, settings: list[tuple[float, float, str, bool]]) -> DataFrame:
    """distance(i, metres, state, weight, zone) and zones(zone, pop, young, source): what is covered in each setting, over all zones and over those of each source.

    A setting is (threshold, kmh, the treatment's name, whether unassessed sites count). A zone's people are spread over its
    demand points by weight; a zone without points, or without weight, is not covered. Rows are multiplied by settings only as
    zones, and sources are told apart there, so a second population source costs no second pass. `denominator` is ALL or the source.
    """
    grid = [(float(t), float(s), n, u) for t, s, n, u in settings]
    hits = _variants(distance, grid)
    sums = [F.sum(F.when(h, F.col("weight")).otherwise(0.0)).alias(f"_v{n}") for n, h in enumerate(hits)]
    per = _nearest_by_state(distance, ["weight", "zone"]).groupBy("zone").agg(F.sum("weight").alias("_w"), *sums)
    whole = zones.join(per, "zone", "left")
    share = lambda n: F.coalesce(F.try_divide(f"_v{n}", "_w"), F.lit(0.0))
    rows = _stacked(whole, grid, ["part"], [[share(n)] for n in range(len(grid))])
    rows = rows.withColumn("denominator", F.explode(F.array(F.lit("ALL"), F.coalesce("source", F.lit("unknown")))))
    percent = lambda c: 100 * F.sum(F.col(c) * F.col("part")) / F.greatest(F.sum(c), F.lit(1))
    return rows.groupBy("threshold", "kmh", "treatment", "denominator").agg(
        F.count(F.lit(1)).alias("zones"), F.sum("pop").alias("people"), F.sum(F.col("pop") * F.col("part")).alias("covered"), percent("pop").alias("percent"),
        percent("young").alias("percent_young"), F.count_if(F.col("part") == 0).alias("zones_without"), F.count_if(F.col("part") < 0.5).alias("zones_below_half"),
    )


def hot_spots(points: DataFrame, neighbours: DataFrame, k: int) -> DataFrame:
    """Getis-Ord Gi* of points(id, v) over neighbours(i, j), each with k, itself among them."""
    world = points.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    local = neighbours.join(points.select(F.col("id").alias("j"), "v"), "j").groupBy("i").agg(F.sum("v").alias("total"))
    spread = F.col("s") * F.sqrt((F.col("n") * k - k * k) / (F.col("n") - 1))
    z = F.when(spread == 0, F.lit(0.0)).otherwise((F.col("total") - k * F.col("m")) / spread)
    label = F.when(F.col("z") > 1.96, "hot").when(F.col("z") < -1.96, "cold").otherwise("none")
    return local.crossJoin(F.broadcast(world)).select(F.col("i").alias("id"), z.alias("z")).withColumn("label", label)


def two_step_catchment(reach: DataFrame, demand: DataFrame, supply: DataFrame) -> DataFrame:
    """reach(i, j), demand(i, pop, zone), supply(j, cap) -> each zone's access, weighted by people."""
    served = reach.join(demand.select("i", "pop"), "i").groupBy("j").agg(F.sum("pop").alias("people"))
    ratio = supply.join(served, "j").select("j", F.try_divide("cap", "people").alias("r"))
    access = reach.join(ratio, "j").groupBy("i").agg(F.sum("r").alias("a"))
    return _zone_access(demand, access)


def _zone_access(demand: DataFrame, access: DataFrame) -> DataFrame:
    total = F.sum(F.col("pop") * F.coalesce("a", F.lit(0.0)))
    return demand.join(access, "i", "left").groupBy("zone").agg(F.coalesce(F.try_divide(total, F.sum("pop")), F.lit(0.0)).alias("access"))


#: Cells of sums along a radius.
SUM_CELLS = 16


def sums_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(i, total): the sum of v over right(j, x, y, v) at most radius from each of left(i, x, y), for those that have any.

    Both sides lie in small cells with the box of what they hold. A cell wholly in reach of another gives its sum once; only
    points of cells on the rim meet one by one, less those that a whole cell reaches or misses. The smaller side meets
    cells first, so no pairs are shuffled.
    """
    far, size = radius * radius, radius / SUM_CELLS
    mine = _placed(left.select("i", "x", "y")).withColumns({"_bx": _cell(F.col("x"), size), "_by": _cell(F.col("y"), size)})
    theirs = _placed(right.select("x", "y", "v")).withColumns({"_fx": _cell(F.col("x"), size), "_fy": _cell(F.col("y"), size)})
    theirs = theirs.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("v").alias("_v"), "_fx", "_fy")
    ends = lambda x, y, to: [f(c).alias(f"{to}{n}{k}") for n, c in (("x", x), ("y", y)) for f, k in ((F.min, 0), (F.max, 1))]
    blocks = mine.groupBy("_bx", "_by").agg(*ends("x", "y", "_b")).withColumns({"_cx": _cell(F.col("_bx0"), radius), "_cy": _cell(F.col("_by0"), radius)})
    # a block is no wider than its cell, so its least corner is at most that much further away
    around = lambda c: F.explode(F.sequence(_cell(F.col(f"{c}0") - radius - 2 * size, radius), _cell(F.col(f"{c}1") + radius, radius)))
    leaves = theirs.groupBy("_fx", "_fy").agg(F.sum("_v").alias("_s"), *ends("_x", "_y", "_f")).withColumn("_cx", around("_fx")).withColumn("_cy", around("_fy"))
    span = lambda a, b: [F.col(a), F.col(b or a)]
    block, leaf = (span("_bx0", "_bx1"), span("_by0", "_by1")), (span("_fx0", "_fx1"), span("_fy0", "_fy1"))
    least = lambda a, b: _squared(_outside(*b[0], *a[0]), _outside(*b[1], *a[1])) <= far
    most = lambda a, b: _squared(_reach(*b[0], *a[0]), _reach(*b[1], *a[1])) <= far
    # few rows that meet many: their number of tasks must not follow their size
    context = left.sparkSession.sparkContext
    pairs = blocks.repartition(8 * context.defaultParallelism, "_cx", "_cy").join(leaves, ["_cx", "_cy"]).where(least(block, leaf)).withColumn("_whole", most(block, leaf))
    whole, rim = pairs.where("_whole").select("_bx", "_by", "_s"), pairs.where("not _whole")
    if mine.count() <= theirs.count():
        place = (span("x", None), span("y", None))
        own = rim.join(mine, ["_bx", "_by"]).where(least(place, leaf)).withColumn("_whole", most(place, leaf))
        sums = own.where("_whole").select("i", "_s")
        met = own.where("not _whole").select("i", "x", "y", "_fx", "_fy").join(theirs, ["_fx", "_fy"])
    else:
        place = (span("_x", None), span("_y", None))
        own = rim.join(theirs, ["_fx", "_fy"]).where(least(block, place)).withColumn("_whole", most(block, place))
        whole, sums = whole.unionByName(own.where("_whole").select("_bx", "_by", F.col("_v").alias("_s"))), None
        met = own.where("not _whole").select("_bx", "_by", "_x", "_y", "_v").join(mine, ["_bx", "_by"])
    near = met.where(_squared(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) <= far).select("i", F.col("_v").alias("_s"))
    every = near.unionByName(whole.groupBy("_bx", "_by").agg(F.sum("_s").alias("_s")).join(mine, ["_bx", "_by"]).select("i", "_s"))
    return (every.unionByName(sums) if sums is not None else every).groupBy("i").agg(F.sum("_s").alias("total"))


def catchment_access(demand: DataFrame, supply: DataFrame, radius: float) -> DataFrame:
    """two_step_catchment over all pairs at most radius apart, of demand(i, x, y, pop, zone) and supply(j, x, y, cap), by sums of cells."""
    people = sums_within(supply.withColumnRenamed("j", "i"), demand.withColumnRenamed("pop", "v"), radius)
    ratio = cut(supply.join(people.withColumnRenamed("i", "j"), "j").select("j", "x", "y", F.try_divide("cap", "total").alias("v")))
    return _zone_access(demand, sums_within(demand, ratio, radius).withColumnRenamed("total", "a"))


def coverage(demand: DataFrame, minutes: DataFrame, thresholds: list[float]) -> DataFrame:
    """demand(i, pop, zone), minutes(i, minutes) -> people covered per zone and threshold, distances used once."""
    limits = demand.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    joined = demand.join(minutes, "i", "left").crossJoin(F.broadcast(limits))
    hit = F.coalesce(F.col("minutes") <= F.col("threshold"), F.lit(False))
    people = F.sum(F.when(hit, F.col("pop")).otherwise(0.0))
    return joined.groupBy("zone", "threshold").agg(people.alias("covered"), F.coalesce(F.try_divide(people, F.sum("pop")), F.lit(0.0)).alias("fraction"))


def gap_types(zones: DataFrame, served: float = 0.5, lever: float = 0.25) -> DataFrame:
    """Zones with coverage, upgraded, n_adequate, n_inadequate, n_unassessed, uncovered -> closure, type and rank."""
    closure = F.least(F.greatest((F.col("upgraded") - F.col("coverage")) / F.greatest(1 - F.col("coverage"), F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
    unknown = (F.col("n_unassessed") > 0) & (F.col("n_adequate") == 0) & (F.col("n_inadequate") == 0)
    kind = F.when(F.col("coverage") >= served, "served").when(unknown, "unassessed_only").when(F.col("closure") >= lever, "staffing").otherwise("no_facility")
    ranked = zones.withColumn("closure", closure).withColumn("gap_type", kind)
    return numbered(ranked, [F.desc("uncovered"), "zone"], "priority_rank")


def road_edges(segments: DataFrame) -> DataFrame:
    """Segments (x1, y1, x2, y2, minutes) -> undirected edges between points snapped to a metre, the fastest of parallel ones."""
    node = lambda a, b: F.concat_ws(":", F.round(a).cast("long").cast("string"), F.round(b).cast("long").cast("string"))
    ends = segments.select(node(F.col("x1"), F.col("y1")).alias("u"), node(F.col("x2"), F.col("y2")).alias("v"), "minutes").where("u <> v")
    return ends.groupBy(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).agg(F.min("minutes").alias("minutes"))


def demand_grid(zones: DataFrame) -> DataFrame:
    """zones(zone, ring in metres, km2) -> sample points (zone, x, y), spacing by area, a point surely inside where none falls there."""
    step = F.least(F.greatest(F.sqrt(F.col("km2") / 30) * 1000, F.lit(700.0)), F.lit(12000.0))
    z = zones.withColumn("_s", step).withColumn("_b", bbox(F.col("ring"))).withColumn("_e", edges(F.col("ring"))).withColumn("_c", representative_point(F.col("ring")))
    along = lambda low, high: F.transform(F.sequence(F.lit(0), F.floor((F.col(high) - F.col(low)) / F.col("_s")).cast("int")), lambda i: F.col(low) + F.col("_s") * (i + 0.5))
    grid = z.withColumn("x", F.explode(along("_b.minx", "_b.maxx"))).withColumn("y", F.explode(along("_b.miny", "_b.maxy")))
    kept = grid.where(within(F.col("_e"), F.col("x"), F.col("y"))).select("zone", "x", "y")
    lacking = z.join(kept.select("zone").distinct(), "zone", "left_anti").select("zone", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"))
    return kept.unionByName(lacking)
