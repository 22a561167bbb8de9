"""Networks: connected components and travel times, in rounds that don't follow the number of edges on a way.

Components come from star contraction: every node points to the smallest of its neighbours, large ones first, then
small ones; the number of rounds grows with the logarithm of the longest way.

Travel times first contract ways: a node with two neighbours that is no source only lies between two others. Each
edge learns where such a way ends and how long it is by pointer jumping, which doubles its reach in each round. What is
left are the crossings, dead ends and sources. Their times come in buckets of distance: of the nodes whose time has
fallen since they last passed it on, those within `width` of the least one do so. Only these meet the edges. At the end the nodes between take the better of their two ends.

All tables of a round replace those of the round before in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import Rounds


def _star(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) with a the larger end, without loops and repeats."""
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _said(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edge: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) of edge(src, dst): the smallest node that each is tied to. A node tied only to itself is one of its own."""
    kept = Rounds(edge.sparkSession)
    pairs = edge.select(F.col("src").alias("a"), F.col("dst").alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = kept.keep("nodes", pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    now = kept.keep("now", _star(pairs))
    before = _said(now)
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = kept.keep("large", _star(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))))
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.withColumnRenamed("a", "u").join(least, "u").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = kept.keep("now", _star(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))))
        after = _said(now)
        if after == before:
            break
        before = after
    else:
        raise ValueError(f"still changing after {rounds} rounds")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _ways(kept: Rounds, arcs: DataFrame, stops: DataFrame) -> DataFrame:
    """(src, stop, minutes) for each of arcs(src, dst, minutes): the first of stops(node) on the way that begins with it.

    Between stops every node has two neighbours. A ring of nodes without a stop has no way to one and no row.
    """
    stop = F.broadcast(stops) if stops.limit(200_001).count() <= 200_000 else stops
    told = arcs.join(stop.select(F.col("node").alias("dst"), F.lit(True).alias("ends")), "dst", "left").select("src", "dst", "minutes", F.coalesce("ends", F.lit(False)).alias("ends"))
    onward = arcs.select(F.col("src").alias("dst"), F.col("dst").alias("onto"))
    after = told.where(~F.col("ends")).join(onward, "dst").where("onto <> src").select("src", "dst", F.col("dst").alias("at_src"), F.col("onto").alias("at_dst"), "minutes")
    # a dead end is a stop, so each open arc has one arc after it
    done = kept.keep("done", told.where("ends").select("src", "dst", F.col("dst").alias("stop"), "minutes"))
    live = kept.keep("live", after)
    left = live.count()
    while left:
        reach = done.select(F.col("src").alias("at_src"), F.col("dst").alias("at_dst"), F.col("stop").alias("stop2"), F.lit(None).cast(live.schema["at_src"].dataType).alias("src2"), F.lit(None).cast(live.schema["at_src"].dataType).alias("dst2"), F.col("minutes").alias("more"))
        ahead = live.select(F.col("src").alias("at_src"), F.col("dst").alias("at_dst"), F.lit(None).cast(live.schema["at_src"].dataType).alias("stop2"), F.col("at_src").alias("src2"), F.col("at_dst").alias("dst2"), F.col("minutes").alias("more"))
        jumped = live.join(reach.unionByName(ahead), ["at_src", "at_dst"]).select("src", "dst", "stop2", "src2", "dst2", (F.col("minutes") + F.col("more")).alias("minutes"))
        jumped = kept.keep("jumped", jumped)
        done = kept.keep("done", done.unionByName(jumped.where("stop2 is not null").select("src", "dst", F.col("stop2").alias("stop"), "minutes")))
        live = kept.keep("live", jumped.where("stop2 is null").select("src", "dst", F.col("src2").alias("at_src"), F.col("dst2").alias("at_dst"), "minutes"))
        before, left = left, live.count()
        if left == before:  # every open way that leads to a stop gets nearer in each round: these are rings
            break
    return done.select("src", "stop", "minutes")


def travel_times(edge: DataFrame, sources: DataFrame, width: float | None = None, rounds: int = 100_000) -> DataFrame:
    """(node, minutes) from the nearest of sources(node, minutes), whatever their number, over edge(src, dst, minutes) both ways.

    Of parallel edges the fastest counts; loops and edges without an end or a time are left out; a negative time is an
    error. width is how far the nodes that pass on together may be apart, 4 mean ways where none is given: it changes the
    number of rounds, never a result. Nodes that no source reaches have no row; a source without an edge has its own time.
    """
    kept = Rounds(edge.sparkSession)
    fair = edge.select("src", "dst", F.col("minutes").cast("double").alias("minutes")).where("src <> dst and minutes is not null")
    both = fair.unionByName(fair.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "minutes"))
    arcs = kept.keep("arcs", both.groupBy("src", "dst").agg(F.min("minutes").alias("minutes")))
    if not arcs.where("minutes < 0").isEmpty():
        raise ValueError("an edge has a negative time")
    start = kept.keep("start", sources.where("node is not null and minutes is not null").groupBy("node").agg(F.min(F.col("minutes").cast("double")).alias("minutes")))
    crossings = arcs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n <> 2").select("node")
    stops = kept.keep("stops", crossings.unionByName(start.select("node")).distinct())
    ways = kept.keep("ways", _ways(kept, arcs, stops))
    kept.drop("done", "live", *[n for n in ("jumped",) if n in kept.at])
    from_stops = ways.join(stops.withColumnRenamed("node", "src"), "src", "left_semi").where("src <> stop")
    links = kept.keep("links", from_stops.groupBy("src", "stop").agg(F.min("minutes").alias("cost")))
    if width is None:
        width = 4 * (links.agg(F.avg("cost")).first()[0] or 1.0)
    now = kept.keep("now", start.withColumn("fresh", F.lit(True)))  # fresh: not yet passed on
    for _ in range(rounds):
        low = now.where("fresh").agg(F.min("minutes")).first()[0]
        if low is None:
            break
        passing = F.col("fresh") & (F.col("minutes") <= low + width)
        sent = now.where(passing).join(links, now["node"] == links["src"]).select(F.col("stop").alias("node"), F.lit(None).cast("double").alias("old"), (F.col("minutes") + F.col("cost")).alias("new"), F.lit(False).alias("waits"))
        had = now.select("node", F.col("minutes").alias("old"), F.lit(None).cast("double").alias("new"), (F.col("fresh") & ~passing).alias("waits"))
        met = had.unionByName(sent).groupBy("node").agg(F.min("old").alias("old"), F.min("new").alias("new"), F.max("waits").alias("waits"))
        better = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old")))
        now = kept.keep("now", met.select("node", F.least("old", "new").alias("minutes"), (better | F.col("waits")).alias("fresh")))
    else:
        raise ValueError(f"still changing after {rounds} rounds")
    best = now.select("node", "minutes")
    between = ways.join(stops.withColumnRenamed("node", "src"), "src", "left_anti").join(best.select(F.col("node").alias("stop"), F.col("minutes").alias("there")), "stop")
    return best.unionByName(between.groupBy(F.col("src").alias("node")).agg(F.min(F.col("minutes") + F.col("there")).alias("minutes")))
