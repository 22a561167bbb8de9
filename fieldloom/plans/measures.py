"""Queries over measures, reports and parameter sweeps, and SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldloom.functions import geo
from fieldloom.functions.numeric import exact_mean, exact_sum
from fieldloom.operators import measures, quality, reconcile, spatial, survey
from fieldloom.operators.ordering import numbered
from fieldloom.plans.queries import _SITES, _sites, query, r
from fieldloom.session import table


@query(r"""select c.c_custkey, case when a.k is not null then 'V' when b.k is not null then 'V' else 'NV' end vis_status, case when a.k is not null then 'GTS' when b.k is not null then 'eTally' else 'Non' end vis_source from customer c left join (select distinct o_custkey k from orders where o_orderstatus = 'F') a on a.k = c.c_custkey left join (select distinct o_custkey k from orders where o_orderstatus = 'O') b on b.k = c.c_custkey""")
def visitation_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey")
    return measures.visitation(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", {"GTS": of("F"), "eTally": of("O")})


@query(r"""select n.n_name ward, count(*) total, count(case when c.c_acctbal > 0 then 1 end) visited, round(cast(100 as double) * count(case when c.c_acctbal > 0 then 1 end) / count(*), 2) percent from customer c join nation n on n.n_nationkey = c.c_nationkey group by n.n_name""")
def ward_coverage(spark, sf_dir):
    named = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return measures.percent_of(named.withColumnRenamed("n_name", "ward"), ["ward"], F.col("c_acctbal") > 0)


@query(r"""with a as (select l_suppkey, sum(l_quantity) x, sum(l_discount) y from lineitem group by l_suppkey), b as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 ry from a) select round(corr(rx, ry), 6) rho from b""")
def spearman(spark, sf_dir):
    """Sums of cents, exact ones: in doubles their last bits, which the order of rows decides, would part equal ranks."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(exact_sum(F.col("l_quantity")).alias("x"), exact_sum(F.col("l_discount")).alias("y"))
    return measures.spearman(per, "x", "y").select(r(F.col("rho")).alias("rho"))


_RANKS = "select screen, count(*) n, round(corr(rx, ry), 6) rho from (select screen, rank() over (partition by screen order by x) + (count(*) over (partition by screen, x) - 1) / 2.0 rx, rank() over (partition by screen order by y) + (count(*) over (partition by screen, y) - 1) / 2.0 ry from a) group by screen"


@query(f"with b as (select l_suppkey, count(*) x, sum(l_quantity) y from lineitem group by 1), a as (select 'unscreened' screen, x, y from b union all select 'screened', x, y from b where l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0)) {_RANKS}")
def screened_spearman(spark, sf_dir):
    """The correlation over suppliers with and without those in debt."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("x"), F.sum("l_quantity").alias("y"))
    out = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return measures.screened_spearman(per, "x", "y", "l_suppkey", out).select("screen", "n", r(F.col("rho")).alias("rho"))


@query(r"""select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_intercept(l_extendedprice, l_quantity), 3) icept from lineitem group by l_returnflag""")
def ols_slope(spark, sf_dir):
    out = measures.ols(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", r(F.col("slope"), 4).alias("slope"), r(F.col("icept"), 3).alias("icept"))


@query(r"""with m as (select min(p_retailprice) lo, (max(p_retailprice) - min(p_retailprice)) / 3 s from part) select p.p_partkey, case when p.p_retailprice <= lo + s then 'low' when p.p_retailprice <= lo + 2 * s then 'medium' else 'high' end class from part p cross join m""")
def equal_interval_class(spark, sf_dir):
    return measures.equal_interval(table(spark, sf_dir, "part"), "p_retailprice").select("p_partkey", "class")


@query(r"""select conv_id, turn, role, row_number() over (partition by conv_id order by turn) line, lag(role) over (partition by conv_id order by turn) before_role from conversations""")
def conversation_sequence(spark, sf_dir):
    by = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(by).alias("line"), F.lag("role").over(by).alias("before_role"))


@query(r"""select n.n_name, count(case when o.o_orderstatus = 'F' then 1 end) f, count(case when o.o_orderstatus = 'O' then 1 end) o, count(case when o.o_orderstatus = 'P' then 1 end) p from orders o join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey group by n.n_name""")
def pivot_supply(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    named = o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return measures.pivot_counts(named, "n_name", "o_orderstatus", {"F": "f", "O": "o", "P": "p"})


@query(r"""select d.lang, count(*) docs, count(l.quality) labelled, round(avg(l.quality), 6) quality, round(avg(cast(case when l.doc_id is null then 1 else 0 end as double)), 6) unlabelled from documents d left join labels l on l.doc_id = d.doc_id group by d.lang""")
def doc_quality_profile(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    joined = d.join(l.withColumn("_l", F.lit(1)), "doc_id", "left").groupBy("lang")
    return joined.agg(F.count(F.lit(1)).alias("docs"), F.count("quality").alias("labelled"), r(F.avg("quality")).alias("quality"), r(F.avg(F.col("_l").isNull().cast("double"))).alias("unlabelled"))


@query(r"""select l_linestatus, l_returnflag, count(*) n, round(sum(l_quantity), 2) qty from lineitem group by grouping sets ((), (l_linestatus), (l_linestatus, l_returnflag))""")
def grouping_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").rollup("l_linestatus", "l_returnflag")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query(r"""select c_custkey, c_acctbal, row_number() over (order by c_acctbal desc, c_custkey) priority_rank from customer order by c_acctbal desc, c_custkey limit 25""")
def top_k_deficit(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return measures.top(c, [F.desc("c_acctbal"), F.asc("c_custkey")], 25)


@query(r"""select c_nationkey k, 'both' side from customer c intersect select s_nationkey, 'both' from supplier s union all (select c_nationkey, 'customer' from customer c except select s_nationkey, 'customer' from supplier s)""")
def set_operations(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return measures.key_sides(c, s, ("both", "customer", "supplier"))


@query(r"""select doc_id, n_copies from (select doc_id, count(*) over (partition by text) n_copies, row_number() over (partition by text order by doc_id) rn from documents) q where rn = 1""")
def dedup_exact(spark, sf_dir):
    return measures.first_copies(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(r"""select s_nationkey, coalesce(round(sum(s_acctbal * s_suppkey) / nullif(sum(s_suppkey), 0), 4), 0) w_avg from supplier group by s_nationkey""")
def weighted_average(spark, sf_dir):
    out = measures.weighted_mean(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", "s_suppkey")
    return out.select("s_nationkey", r(F.col("w_avg"), 4).alias("w_avg"))


@query(r"""with m(cat, need) as (select * from (values ('PROMO', 20), ('STANDARD', 30), ('ECONOMY', 10)) q(cat, need)) select p.p_partkey, case when m.cat is null then 'unknown' when p.p_size >= m.need then 'adequate' else 'inadequate' end state, case when p.p_size < m.need then concat(m.cat, ':', cast(p.p_size as varchar(9)), '/', cast(m.need as varchar(9))) else '' end shortfall from part p left join m on p.p_type like concat(m.cat, '%')""")
def staffing_norms(spark, sf_dir):
    return measures.staffing(table(spark, sf_dir, "part"), {"PROMO": 20, "STANDARD": 30, "ECONOMY": 10}, "p_type", "p_size").select("p_partkey", "state", "shortfall")


@query(r"""with a as (select l_orderkey k, count(*) n from lineitem group by l_orderkey), b as (select o_orderkey k, o_orderkey % 7 + 1 m from orders) select coalesce(a.k, b.k) k, coalesce(n, 0) n, coalesce(m, 0) m from a full outer join b on a.k = b.k where coalesce(n, 0) <> coalesce(m, 0)""")
def totals_reconciliation(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return measures.totals_differ(a, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7 + 1).alias("m")))


@query(r"""select take, cast(floor(1800.0 / take) as bigint) clusters, round(cast(1 as double) + (take - 1) / cast(20 as double), 4) deff, round(cast(1800 as double) / (1 + (take - 1) / cast(20 as double)), 2) n_eff from (values (30), (20), (16), (12), (8), (6)) q(take)""")
def reallocation(spark, sf_dir):
    return measures.reallocation(spark, [30, 20, 16, 12, 8, 6], 1800.0, 1 / 20)


@query(r"""with z as (select c_nationkey zone, sum(case when c_acctbal > 0 then c_acctbal else 0 end) deficit, cast(avg(case when c_acctbal > 4000 then 1.0 else 0.0 end) as double) closure from customer group by c_nationkey) select k cutoff, count(case when closure >= k then 1 end) staffing, count(case when closure < k then 1 end) absent, round(sum(case when closure >= k then deficit else 0 end), 2) by_staffing from z cross join (values (cast(0.10 as double)), (cast(0.15 as double)), (cast(0.25 as double)), (cast(0.40 as double)), (cast(0.60 as double))) c(k) group by k""")
def cutoff_sweep(spark, sf_dir):
    b = F.col("c_acctbal")
    zones = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("zone")).agg(F.sum(F.when(b > 0, b).otherwise(0)).alias("deficit"), F.avg((b > 4000).cast("double")).alias("closure"))
    out = measures.cutoff_sweep(zones, [0.10, 0.15, 0.25, 0.40, 0.60])
    return out.withColumn("by_staffing", r(F.col("by_staffing"), 2))


@query(r"""with z as (select s_nationkey zone, avg(s_acctbal) staff, count(*) n from supplier group by s_nationkey), p as (select percentile_cont(0.1) within group (order by staff) p10 from z) select zone, round(staff, 6) staff from z cross join p where n >= 1 and staff <= p10""")
def crowded_covered(spark, sf_dir):
    zones = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("zone")).agg(F.avg("s_acctbal").alias("staff"), F.count(F.lit(1)).alias("n"))
    return measures.crowded(zones, F.col("n") >= 1).select("zone", r(F.col("staff")).alias("staff"))


@query(r"""with d as (select o_orderkey k, o_totalprice / 1000 direct, o_custkey % 60 walk, o_orderkey % 200 net from orders) select k, round(least(direct, walk + net), 6) as minutes, case when walk + net < direct then 'network' else 'direct' end how from d""")
def hybrid_travel(spark, sf_dir):
    minutes, how = measures.hybrid_minutes(F.col("o_totalprice") / 1000, F.col("o_custkey") % 60, F.col("o_orderkey") % 200)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), r(minutes).alias("minutes"), how.alias("how"))


# --- counts, orders and blocks -----------------------------------------------------------------


@query("select p_brand, min(p_size) \"mode\" from (select p_brand, p_size, count(*) n, max(count(*)) over (partition by p_brand) m from part group by 1, 2) q where n = m group by 1")
def mode_of_ties(spark, sf_dir):
    return measures.mode_least(table(spark, sf_dir, "part"), ["p_brand"], "p_size")


@query("with m as (select cast(min(c_acctbal) as double) lo, cast(max(c_acctbal) as double) hi from customer), c as (select least(cast(floor((c_acctbal - lo) / ((hi - lo) / 34)) as bigint), 33) bin, count(*) n from customer, m group by 1) select range bin, round(lo + range * (hi - lo) / 34, 6) low, coalesce(n, 0) n from range(34) cross join m left join c on c.bin = range")
def weight_histogram(spark, sf_dir):
    out = measures.histogram(table(spark, sf_dir, "customer"), "c_acctbal", 34)
    return out.withColumn("low", r(F.col("low")))


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) k from orders) q where k % 7 = 1")
def every_seventh(spark, sf_dir):
    return measures.every_kth(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query("with z as (select c_nationkey zone, round(avg(c_acctbal), 4) v from customer group by 1), k as (select *, row_number() over (order by v, zone) a, row_number() over (order by v desc, zone desc) b from z) select zone, v, case when a <= 3 then 'lowest' else 'highest' end side from k where a <= 3 or b <= 3")
def lowest_highest(spark, sf_dir):
    z = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("zone")).agg(r(F.avg("c_acctbal"), 4).alias("v"))
    return measures.ends(z, ["v", "zone"], 3)


@query("with b as (select o_custkey who, o_orderkey lo, o_orderkey + o_orderkey % 5 hi from orders), n as (select *, lead(lo) over (partition by who order by lo, hi) next_lo from b) select *, next_lo = hi + 1 contiguous from n")
def block_contiguity(spark, sf_dir):
    k = F.col("o_orderkey")
    return measures.contiguity(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("who"), k.alias("lo"), (k + k % 5).alias("hi")), "who")


@query("select l_suppkey cluster, count(*) households, round(avg(n), 6) mean_size from (select l_suppkey, l_orderkey, count(*) n from lineitem group by 1, 2) q group by 1")
def cluster_mean_size(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster"), "l_orderkey")
    return measures.cluster_means(rows, "l_orderkey", "cluster").withColumn("mean_size", r(F.col("mean_size")))


@query("with m as (select l_suppkey cluster, l_linestatus stratum, round(avg(l_discount), 9) mean, count(l_discount) size from lineitem group by 1, 2) select *, cluster in (3, 7) flagged, row_number() over (order by mean, cluster, stratum) place from m")
def caterpillar(spark, sf_dir):
    """Means of cents, exact before they are rounded: a mean on its half, as of 256 rows, would fall by the order of rows, and move places."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster"), F.col("l_linestatus").alias("stratum"), "l_discount")
    means = rows.groupBy("cluster", "stratum").agg(exact_mean(F.col("l_discount"), 9).alias("mean"), F.count("l_discount").alias("size"))
    return numbered(means.withColumn("flagged", F.col("cluster").isin(3, 7)), [F.asc_nulls_last(c) for c in ("mean", "cluster", "stratum")], "place")


@query("with a as (select c_nationkey k, count(*) v from customer where c_acctbal > 0 group by 1), b as (select s_nationkey k, count(*) v from supplier group by 1), c as (select n_nationkey k, n_regionkey v from nation where n_nationkey % 5 <> 2) select k, a.v customers, b.v suppliers, c.v region from a join b using (k) join c using (k)")
def aligned_series(spark, sf_dir):
    of = lambda t, k: table(spark, sf_dir, t).groupBy(F.col(k).alias("k"))
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    n = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 2").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("v"))
    return measures.aligned("k", customers=a, suppliers=of("supplier", "s_nationkey").agg(F.count(F.lit(1)).alias("v")), region=n)


@query("select c_custkey, c_nationkey, s_nationkey other_c_nationkey from customer join supplier on s_suppkey = c_custkey where c_nationkey is distinct from s_nationkey")
def mixed_values(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"))
    return measures.mixed_values(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), s, ["c_custkey"], "c_nationkey")


@query("select o_orderpriority, place, round(avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end), 6) full_share, round(avg(case when o_totalprice > 150000 then 1.0 else 0.0 end), 6) dear_share from orders join (values (0, '5-LOW'), (1, '3-MEDIUM'), (2, '1-URGENT'), (3, 'none')) q(place, p) on p = o_orderpriority group by 1, 2")
def conditional_shares(spark, sf_dir):
    hits = {"full_share": F.col("o_orderstatus") == "F", "dear_share": F.col("o_totalprice") > 150000}
    out = measures.conditional_shares(table(spark, sf_dir, "orders"), "o_orderpriority", ["5-LOW", "3-MEDIUM", "1-URGENT", "none"], hits)
    return out.select("o_orderpriority", "place", *[r(F.col(h)).alias(h) for h in hits])


@query("select c_custkey, n_nationkey code from customer join nation on n_nationkey = c_nationkey")
def coded_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    named = table(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.col("n_name").alias("place"))
    return measures.coded(named, "place", n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("code"))).select("c_custkey", "code")


@query("with x as (select c_custkey k, c_nationkey % 5 rg, c_nationkey nt, c_custkey % 40 + 1 st from customer) select k, case when not exists (select 1 from nation where n_nationkey = nt and n_regionkey = rg) then 'nation' when not exists (select 1 from supplier where s_suppkey = st and s_nationkey = nt) then 'site' end broken_at from x")
def cascading_choice(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), (n % 5).alias("region"), n.alias("nation"), (k % 40 + 1).alias("site"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("parent"))
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("parent"))
    return measures.chained_lookup(rows, [("nation", "region", nations), ("site", "nation", sites)]).select("k", "broken_at")


@query("select source, count(*) n, count(lang) told from (select case when doc_id % 9 = 0 then null else source end source, lang from documents) q group by 1")
def null_groups(spark, sf_dir):
    """Rows without a group are one of their own; groupBy keeps it."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 9 != 0, F.col("source")).alias("source"), "lang")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("lang").alias("told"))


# --- dates, flags and registers ----------------------------------------------------------------


@query("select o_orderkey, case when trim(o_orderstatus) = 'F' then 1 else 0 end full_flag, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else 'other' end state, cast(dayofyear(cast(o_orderdate as date)) as integer) doy, cast(date_diff('day', cast(o_orderdate as date), date '1998-12-31') as integer) \"days\", round(case when o_orderkey % 40 < 24 and o_orderkey % 2 = 0 then 60 + 0.7 when o_orderkey % 40 >= 24 and o_orderkey % 2 = 1 then 60 - 0.7 else 60 end, 4) size from orders")
def cell_rules(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", measures.flag_equal(F.col("o_orderstatus"), "F").alias("full_flag"), measures.mapped(F.col("o_orderstatus"), {"F": "finished", "O": "open"}, "other").alias("state"),
        F.dayofyear(day).alias("doy"), F.datediff(F.lit(datetime(1998, 12, 31)).cast("date"), day).alias("days"),
        F.round(measures.at_24_months(F.lit(60.0), k % 2 == 1, k % 40), 4).alias("size"),
    )


@query("select event_id, cast(trunc(epoch_us(timestamp '2030-01-01 00:00:00' - cast(ts as timestamp)) / 60000000.0) as integer) \"minutes\" from events")
def minutes_open(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", measures.minutes_since(F.col("ts"), F.lit(datetime(2030, 1, 1))).alias("minutes"))


@query("select event_id from (select event_id, event_id % 1000 / 10000.0 x, event_id % 700 / 10000.0 y from events) q where abs(x - 0.03) > 0.05 or abs(y - 0.03) > 0.05")
def gps_far(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").where(measures.gps_far(k % 1000 / 10000, k % 700 / 10000, F.lit(0.03), F.lit(0.03))).select("event_id")


@query("with h as (select o_orderkey hh, o_orderkey % 50 mins, o_orderkey % 3 cards, o_orderkey % 4 children, o_orderkey % 6 roster, o_orderkey % 5 listed, o_orderkey % 2 specimens, o_orderkey % 3 due, o_orderkey % 11 temperature from orders), f as (select hh, mins < 15 a, children > 0 and cards = 0 b, roster <> listed c, specimens < due d, not temperature between 2 and 8 e from h) select hh, concat_ws(';', case when a then 'short' end, case when b then 'no_cards' end, case when c then 'roster_corrected' end, case when d then 'specimen_shortfall' end, case when e then 'cold_chain' end) flags from f")
def visit_flags(spark, sf_dir):
    k = F.col("o_orderkey")
    parts = {"minutes": 50, "cards": 3, "children": 4, "roster": 6, "listed": 5, "specimens": 2, "due": 3, "temperature": 11}
    return measures.qa_flags(table(spark, sf_dir, "orders").select(k.alias("hh"), *[(k % n).alias(c) for c, n in parts.items()])).select("hh", "flags")


@query("select 'orphan_lines' \"check\", case when n > 0 then 'critical' else 'info' end severity, n n_affected from (select count(*) n from lineitem where l_orderkey not in (select o_orderkey from orders)) q union all select 'late_receipts', case when n > 0 then 'minor' else 'info' end, n from (select count(*) n from lineitem where l_discount > 0.08) q union all select 'negative_prices', case when n > 0 then 'material' else 'info' end, n from (select count(*) n from orders where o_totalprice < 0) q")
def integrity_ledger(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    orphans = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return measures.integrity_ledger([("orphan_lines", "critical", orphans), ("late_receipts", "minor", l.where("l_discount > 0.08")), ("negative_prices", "material", o.where("o_totalprice < 0"))])


@query("select * from (values ('A01', 'weights', 'clusters answer alike', 'response within cluster', 'estimate'), ('A02', 'variance', 'first stage with replacement', 'sampling fraction below 5 %', 'interval')) q(id, area, assumption, basis, bears_on)")
def assumption_register(spark, sf_dir):
    return measures.assumptions(spark, [("weights", "clusters answer alike", "response within cluster", "estimate"), ("variance", "first stage with replacement", "sampling fraction below 5 %", "interval")])


# --- reconciliation ----------------------------------------------------------------------------

_FIELDS = "select c_custkey, n_name, r_name, case c_custkey % 4 when 0 then n_name when 1 then lower(n_name) || ' state' when 2 then '  ' || n_name || ' LGA District' else n_name || '.' end nation_raw, case when c_custkey % 7 = 0 then 'QXQX ZZZZ JJJJ' when c_custkey % 3 = 1 then lower(r_name) || ' local govt area' else r_name end region_raw from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey"


def _fields(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    nation = F.when(k % 4 == 0, F.col("n_name")).when(k % 4 == 1, F.concat(F.lower("n_name"), F.lit(" state"))).when(k % 4 == 2, F.concat(F.lit("  "), "n_name", F.lit(" LGA District"))).otherwise(F.concat("n_name", F.lit(".")))
    region = F.when(k % 7 == 0, F.lit("QXQX ZZZZ JJJJ")).when(k % 3 == 1, F.concat(F.lower("r_name"), F.lit(" local govt area"))).otherwise(F.col("r_name"))
    return c.select("c_custkey", nation.alias("nation_raw"), region.alias("region_raw"))


def _authorities(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))


@query(f"with f as ({_FIELDS}) select c_custkey, n_name name_nation_raw, case when c_custkey % 7 <> 0 then r_name end name_region_raw, case when c_custkey % 7 = 0 then 'unresolved' else 'exact' end match_method, case when c_custkey % 7 = 0 then 'unresolved' else 'resolved' end match_outcome from f")
def reconcile_worst(spark, sf_dir):
    nations, regions = _authorities(spark, sf_dir)
    out = reconcile.reconcile_rows(_fields(spark, sf_dir), {"nation_raw": nations, "region_raw": regions})
    return out.select("c_custkey", "name_nation_raw", "name_region_raw", "match_method", "match_outcome")


@query(f"with f as ({_FIELDS}), n as (select distinct nation_raw, n_name from f), g as (select distinct region_raw, r_name from f where c_custkey % 7 <> 0 union select 'QXQX ZZZZ JJJJ', null), e as (select 'crosswalk' stage, 'nation' field, case when trim(nation_raw, ' .') = n_name then 'exact' else 'normalised' end \"method\" from n union all select 'crosswalk', 'region', case when r_name is null then 'unresolved' when region_raw = r_name then 'exact' else 'normalised' end from g) select stage, field, \"method\", case when \"method\" = 'unresolved' then 'unresolved' else 'resolved' end outcome, count(*) n from e group by 1, 2, 3, 4")
def ledger_summary(spark, sf_dir):
    rows, (nations, regions) = _fields(spark, sf_dir), _authorities(spark, sf_dir)
    of = lambda c, a, n: reconcile.ledger(reconcile.cascade(rows.select(F.col(c).alias("raw")), a), "crosswalk", n)
    return reconcile.ledger_summary(reconcile.ledger_union([of("nation_raw", nations, "nation"), of("region_raw", regions, "region")]))


# --- space -------------------------------------------------------------------------------------


@query(f"with {_SITES}, k as (select i, j, d, row_number() over (partition by i order by round(d*d), j) r from p where d <= 120) select i, j, r \"rank\", cast(round(d*d) as bigint) dist2 from k where r <= 3")
def road_connectors(spark, sf_dir):
    demand, supply = _sites(spark, sf_dir)
    out = spatial.connectors(demand.select("i", "x", "y"), supply.select("j", "x", "y"), 3, 120.0, 50.0)
    return out.select("i", "j", F.col("rank").cast("long").alias("rank"), F.col("dist2").cast("long").alias("dist2"))


_ZONES = [(1, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]), (2, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (8.0, 10.0), (8.0, 2.0), (2.0, 2.0), (2.0, 10.0), (0.0, 10.0)]), (3, [(0.0, 0.0), (4.0, 0.0), (2.0, 6.0)])]


def _zones(spark):
    return spark.createDataFrame(_ZONES, "zone int, ring array<struct<x:double,y:double>>")


@query("select * from (values (1, 4.5, 4.5), (2, 1.0, 6.0), (3, 2.0, 3.0)) q(zone, x, y)")
def representative_points(spark, sf_dir):
    p = geo.representative_point(F.col("ring"))
    return _zones(spark).select("zone", r(p["x"], 4).alias("x"), r(p["y"], 4).alias("y"))


_FIXES = "select event_id, cast(event_id % 2 + 1 as int) zone, (event_id * 37 % 1000) / 90.0 + 0.0003 x, (event_id * 91 % 1000) / 90.0 + 0.0007 y from events"


def _fixes(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", (k % 2 + 1).cast("int").alias("zone"), ((k * 37 % 1000) / 90 + 0.0003).alias("x"), ((k * 91 % 1000) / 90 + 0.0007).alias("y"))


@query(f"with f as ({_FIXES}) select event_id, zone from f where (zone = 1 and not (x > 0 and x < 9 and y > 0 and y < 9)) or (zone = 2 and not (x > 0 and x < 10 and y > 0 and y < 10 and not (x >= 2 and x <= 8 and y >= 2)))")
def misplaced_fixes(spark, sf_dir):
    return spatial.misplaced(_fixes(spark, sf_dir), _zones(spark), "zone").select("event_id", "zone")


@query(f"with f as ({_FIXES}), g(held, x0, y0, x1, y1) as (values (1, 0.0, 0.0, 6.0, 6.0), (2, 3.0, 3.0, 10.0, 8.0)) select event_id, held from f left join g on x > x0 and x < x1 and y > y0 and y < y1")
def within_left(spark, sf_dir):
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    areas = spark.createDataFrame([(1, box(0.0, 0.0, 6.0, 6.0)), (2, box(3.0, 3.0, 10.0, 8.0))], "held int, ring array<struct<x:double,y:double>>")
    return spatial.polygon_join(_fixes(spark, sf_dir), areas, 2.0, "left", boundary=False).select("event_id", "held")


@query(f"with {_SITES}, u as (select j, case when cap >= 4000 then 'adequate' else 'unknown' end state from s), n as (select p.i, u.state, min(p.d) * 100 metres from p join u using (j) group by 1, 2), g(threshold, kmh, treatment, counts) as (select t, k, w, c from (values (30.0), (60.0), (90.0)) a(t), (values (4.0), (8.0), (15.0)) b(k), (values ('none', false), ('all', true)) d(w, c)), m as (select threshold, kmh, treatment, n.i, min(metres/1000/kmh*60) m from n, g where state = 'adequate' or counts group by 1, 2, 3, 4) select threshold, kmh, treatment, round(sum(case when m <= threshold then pop else 0 end), 2) covered, round(sum(case when m <= threshold then pop else 0 end) / (select sum(pop) from c), 6) share from m join c using (i) group by 1, 2, 3")
def access_sweep(spark, sf_dir):
    demand, supply = _sites(spark, sf_dir)
    parts = []
    for state, sites in (("adequate", supply.where("cap >= 4000")), ("unknown", supply.where("cap < 4000"))):
        near = spatial.nearest(demand, sites, 1, 100.0).select("i", (F.sqrt("dist2") * 100).alias("metres"), F.lit(state).alias("state"))
        parts.append(near.join(demand.select("i", "pop", "zone"), "i"))
    out = spatial.access_sweep(parts[0].unionByName(parts[1]), demand, [30, 60, 90], [4, 8, 15], {"none": False, "all": True})
    return out.select("threshold", "kmh", "treatment", r(F.col("covered"), 2).alias("covered"), r(F.col("share")).alias("share"))


_SETTINGS = [(30.0, 5.0, "not", False), (60.0, 5.0, "not", False), (90.0, 5.0, "not", False), (60.0, 8.0, "not", False), (60.0, 15.0, "not", False), (60.0, 5.0, "as adequate", True)]
_SETTING_ROWS = ", ".join(f"({t}, {s}, '{n}', {str(u).lower()})" for t, s, n, u in _SETTINGS)


@query(f"with {_SITES}, g(threshold, kmh, treatment, counts) as (values {_SETTING_ROWS}), n as (select p.i, case when cap >= 4000 then 'adequate' else 'unknown' end state, min(d) * 100 metres from p join s using (j) group by 1, 2), h as (select threshold, kmh, treatment, n.i, bool_or((state = 'adequate' or counts) and metres/1000/kmh*60 <= threshold) hit from n, g group by 1, 2, 3, 4), z as (select threshold, kmh, treatment, zone, sum(case when hit then 1.0 else 0.0 end) / count(*) part from h join c using (i) group by 1, 2, 3, 4), w as (select c_nationkey zone, sum(c_acctbal + 2000) pop, sum(case when c_mktsegment = 'BUILDING' then c_acctbal + 2000 else 0.0 end) young, case when c_nationkey % 3 = 0 then 'estimate' else 'count' end source from customer group by c_nationkey), f as (select z.*, w.pop, w.young, d.denominator from z join w using (zone) cross join lateral (select unnest(['ALL', w.source]) denominator) d) select threshold, kmh, treatment, denominator, count(*) zones, round(sum(pop), 2) people, round(sum(pop * part), 2) covered, round(100 * sum(pop * part) / greatest(sum(pop), 1), 5) percent, round(100 * sum(young * part) / greatest(sum(young), 1), 5) percent_young, count(*) filter (part = 0) zones_without, count(*) filter (part < 0.5) zones_below_half from f group by 1, 2, 3, 4")
def access_denominators(spark, sf_dir):
    """The access figure under six settings, over all zones and by where a zone's population comes from."""
    demand, supply = _sites(spark, sf_dir)
    near = lambda sites, state: spatial.nearest(demand, sites, 1, 100.0).select("i", (F.sqrt("dist2") * 100).alias("metres"), F.lit(state).alias("state"))
    distance = near(supply.where("cap >= 4000"), "adequate").unionByName(near(supply.where("cap < 4000"), "unknown"))
    distance = distance.join(demand.select("i", "zone", F.lit(1.0).alias("weight")), "i")
    people = F.col("c_acctbal") + 2000
    zones = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("zone")).agg(F.sum(people).alias("pop"), F.sum(F.when(F.col("c_mktsegment") == "BUILDING", people).otherwise(0.0)).alias("young"))
    zones = zones.withColumn("source", F.when(F.col("zone") % 3 == 0, "estimate").otherwise("count"))
    out = spatial.access_table(distance, zones, _SETTINGS)
    return out.withColumns({"people": r(F.col("people"), 2), "covered": r(F.col("covered"), 2), "percent": r(F.col("percent"), 5), "percent_young": r(F.col("percent_young"), 5)})


@query(f"with {_SITES}, z(scenario, least) as (values ('base', 4000), ('upgraded', -10000)), n as (select scenario, p.i, min(p.d) d from p join s using (j) cross join z where s.cap >= z.least group by 1, 2) select scenario, zone, round(sum(case when d <= 60 then pop else 0 end) / sum(pop), 6) covered from c join n using (i) group by 1, 2")
def counterfactual_coverage(spark, sf_dir):
    demand, supply = _sites(spark, sf_dir)

    def covered(sites):
        near = spatial.nearest(demand, sites.where("state = 'adequate'"), 1, 100.0).select("i", "dist2")
        return demand.join(near, "i").groupBy("zone").agg(r(F.sum(F.when(F.col("dist2") <= 3600, F.col("pop")).otherwise(0)) / F.sum("pop")).alias("covered"))

    return spatial.counterfactual(covered, supply.withColumn("state", F.when(F.col("cap") >= 4000, "adequate").otherwise("inadequate")))


# --- survey ------------------------------------------------------------------------------------


@query("with a as (select p_size age from part), c as (select range + 5 age, count(a.age) n from range(41) left join a on a.age = range + 5 group by 1), s as (select *, median(n) over (order by age rows between 2 preceding and 2 following) m, sum(n) over () t from c), w as (select *, sum(m) over () mt from s) select cast(max(t) as bigint) n, round((select sum(abs(100.0 * coalesce(x, 0) / (select sum(n) from c) - 100.0 / 12)) / 2 from range(12) left join (select age % 12 k, sum(n) x from c group by 1) q on k = range), 6) residue_index, round(sum(case when age in (12, 24, 36) then n else 0 end) / (max(t) * 3 / 41), 6) anchor_index, round(sum((n - t / 41) * (n - t / 41) / (t / 41)), 6) chi2, round(sum(abs(n / t - m / mt)) / 2, 6) dissimilarity, cast(sum(case when age = 45 then n else 0 end) as bigint) n_at_end, round(sum(case when age = 45 then n else 0 end) / (sum(case when age between 40 and 43 then n else 0 end) / 4.0), 6) end_excess, (select count(*) from a where age < 5) n_below, (select count(*) from a where age > 45) n_above from w")
def age_heaping_indices(spark, sf_dir):
    out = quality.age_heaping(table(spark, sf_dir, "part").select(F.col("p_size").alias("age")), 5, 45, (12, 24, 36))
    return out.select("n", "n_at_end", "n_below", "n_above", *[r(F.col(c)).alias(c) for c in ("residue_index", "anchor_index", "chi2", "dissimilarity", "end_excess")])


#: Variant, its y, its weight and which rows it keeps, as SQL that both engines read.
_Y, _Q = "case when l_discount >= 0.05 then 1.0 else 0.0 end", "l_quantity"
_VARIANTS = {
    "00 headline": (_Y, _Q, "l_tax > 0"), "01 unweighted": (_Y, "1.0", "l_tax > 0"), "02 self-weighting": (_Y, "case when l_linestatus = 'F' then 3.0 else 2.0 end", "l_tax > 0"),
    "03 no adjustment": (_Y, f"{_Q} / 2.0", "l_tax > 0"), "04 coarse class": (_Y, f"{_Q} * (1 + l_linenumber)", "l_tax > 0"), "05 vacant as silent": (_Y, f"{_Q} * (2 + l_linenumber)", "l_tax > 0"),
    "06 no contact ineligible": (_Y, f"{_Q} * (3 + l_linenumber)", "l_tax > 0"), "07 trimmed": (_Y, f"least({_Q}, 30.0)", "l_tax > 0"), "08 all ages": (_Y, _Q, "1 = 1"),
    "09 unknown as yes": (f"case when l_returnflag = 'N' then 1.0 else {_Y} end", _Q, "l_tax > 0"), "10 unknown as no": (f"case when l_returnflag = 'N' then 0.0 else {_Y} end", _Q, "l_tax > 0"),
    "11 in the window": (_Y, _Q, "l_tax > 0 and l_returnflag <> 'A'"), "12 as submitted": (_Y, _Q, "l_tax >= 0"), "13 silent 10 points lower": (f"({_Y}) * 0.9", _Q, "l_tax > 0"), "14 silent 20 points lower": (f"({_Y}) * 0.8", _Q, "l_tax > 0"),
}
_VARIANT_SQL = "with o as ({rows}), t as (select domain, sum(w*y)/sum(w) p, sum(w) sw, count(*) n from o group by domain), z as (select o.domain, h, i, sum(w*(y-p)/sw) z from o join t using (domain) group by o.domain, h, i), v as (select domain, h, count(*) nh, case when count(*)>1 then count(*)*var_samp(z) else 0.0 end vh from z group by domain, h), d as (select domain, sum(vh) v from v group by domain) select domain, round(p,6) p, round(sqrt(v),6) se, n, round(100*(p - (select p from t where domain = '00 headline')), 4) shift_pp from d join t using (domain)"


@query(_VARIANT_SQL.format(rows=" union all ".join(f"select '{k}' domain, l_linestatus h, l_suppkey i, {y} y, cast({w} as double) w from lineitem where {keep}" for k, (y, w, keep) in _VARIANTS.items())))
def sensitivity_table(spark, sf_dir):
    """The fifteen variants of a sensitivity table in one pass over the rows."""
    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_linestatus": "h", "l_suppkey": "i"}).withColumn("l_linestatus", F.col("h"))
    out = survey.sensitivity(rows, {k: (F.expr(keep), F.expr(y), F.expr(w)) for k, (y, w, keep) in _VARIANTS.items()}, "00 headline", 0.95)
    return out.select("domain", r(F.col("p")).alias("p"), r(F.col("se")).alias("se"), "n", r(F.col("shift_pp"), 4).alias("shift_pp"))


@query("with c as (select l_suppkey cluster, count(*) listed, sum(l_quantity) census from lineitem group by 1) select cluster, round(listed / 0.02 / 20, 6) w_base, round(listed / census, 6) listing_ratio from c")
def weight_chain(spark, sf_dir):
    frame = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cluster")).agg(F.count(F.lit(1)).alias("listed"), F.sum("l_quantity").alias("census"), F.lit(0.02).alias("p1"))
    out = survey.base_weights(frame)
    return out.select("cluster", r(F.col("w_base")).alias("w_base"), r(F.col("listing_ratio")).alias("listing_ratio"))


@query("with o as (select l_linestatus h, l_suppkey i, case when l_returnflag='R' then 1.0 else 0.0 end y, l_quantity w from lineitem), t as (select sum(w*y)/sum(w) p, sum(w) sw from o), z as (select h, i, sum(w*(y-p)/sw) z from o, t group by 1, 2), v as (select h, count(*)*var_samp(z)*(1 - case when h = 'F' then 0.25 else 0.1 end) vh from z group by h) select round(max(p), 6) p, round(sqrt(sum(vh)), 6) se, round(2.8*sqrt(2)*sqrt(sum(vh)), 6) mde from v, t")
def svy_fpc(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), F.col("l_quantity").alias("w"), F.col("l_linestatus").alias("h"), F.col("l_suppkey").alias("i"), F.lit("National").alias("domain"))
    out = survey.proportions(rows, spark.createDataFrame([("F", 0.25), ("O", 0.1)], "h string, f double"))
    return out.select(r(F.col("p")).alias("p"), r(F.col("se")).alias("se"), r(measures.detectable(F.col("se"))).alias("mde"))
