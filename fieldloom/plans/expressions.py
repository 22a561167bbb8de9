"""Queries that apply single expressions and small operators to whole tables; registered beside those of queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldloom import streaming
from fieldloom.functions import geo, numeric, text
from fieldloom.operators import fieldwork, forms, measures, ordering, quality, reconcile, response, rules, spatial, survey, transfer
from fieldloom.plans.queries import _SVY, _estimates, _sample, query, r
from fieldloom.session import shared_root, table

# --- names and texts ---------------------------------------------------------------------------


@query("select p_partkey, trim(regexp_replace(p_name, ' +', ' ', 'g')) clean from part")
def clean_names(spark, sf_dir):
    """Names written with full-width letters, hard blanks and marks at their ends come back plain."""
    wide = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", "".join(chr(0xFF41 + k) for k in range(26)))
    raw = F.concat(F.lit(" ;"), F.regexp_replace(wide, " ", "  "), F.lit(" - "))
    return table(spark, sf_dir, "part").select("p_partkey", text.clean_text(raw, unicode_forms=True).alias("clean"))


@query("select c_custkey, array_to_string(list_transform(string_split(lower(c_mktsegment || ' of-' || c_name), ' '), lambda w: array_to_string(list_transform(string_split(w, '-'), lambda x: upper(x[1]) || x[2:]), '-')), ' ') title from customer")
def title_case_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.title_case_admin(F.upper(F.concat("c_mktsegment", F.lit("  of-"), "c_name"))).alias("title"))


@query("select o_orderkey, trim(regexp_replace(lower(o_orderpriority || ' / ' || o_orderstatus), '[^a-z0-9]+', '_', 'g'), '_') slug from orders")
def header_slugs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.slug(F.concat("o_orderpriority", F.lit(" / "), "o_orderstatus")).alias("slug"))


@query("select p_partkey, case when p_size >= 10 then p_size when p_partkey between 10 and 999999 then p_partkey end number from part")
def last_numbers(spark, sf_dir):
    raw = F.concat(F.lit("plate "), F.col("p_partkey").cast("string"), F.lit(", house "), F.col("p_size").cast("string"), F.lit(" x7"))
    return table(spark, sf_dir, "part").select("p_partkey", text.last_number(raw).cast("long").alias("number"))


@query("with l as (select l_orderkey, string_agg(cast(l_linenumber as varchar), ' ' order by l_linenumber) c from lineitem group by 1) select l_orderkey, len(string_split(c, ' ')) n, list_contains(string_split(c, ' '), '3') third from l")
def chosen_options(spark, sf_dir):
    lines = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")))
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("c"))
    return per.select("l_orderkey", text.count_selected(F.col("c")).cast("long").alias("n"), text.selected(F.col("c"), "3").alias("third"))


@query("select l_returnflag, l_linestatus, printf('%.1f (%.1f-%.1f)', 100 * avg(d), 100 * min(d), 100 * max(d)) said from (select l_returnflag, l_linestatus, cast(l_discount as double) d from lineitem) q group by 1, 2")
def percent_intervals(spark, sf_dir):
    d = F.col("l_discount").cast("double")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(text.percent_ci(F.avg(d), F.min(d), F.max(d)).alias("said"))


@query("select c_custkey, case when c_custkey % 5 <> 4 then 'BSN' end prefix, case when c_custkey % 5 <> 4 then lpad(cast(c_custkey as varchar), 6, '0') end serial, case when c_custkey % 5 <> 4 then 'X' end \"check\" from customer")
def label_parts(spark, sf_dir):
    serial, k = F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.col("c_custkey") % 5
    raw = F.when(k == 4, F.concat(F.lit("BSN"), serial)).otherwise(F.concat(F.lit(" bsn "), serial, F.lit(" - x")))
    return table(spark, sf_dir, "customer").select("c_custkey", numeric.parse_label(raw).alias("p")).select("c_custkey", "p.prefix", "p.serial", F.col("p.check").alias("check"))


@query("select case when c_custkey % 2 = 0 then p || 'Ward ' || k else p || 'WARD' || k end raw, 'Ward ' || k resolved, case when c_custkey % 2 = 0 then 'exact' else 'normalised' end \"method\", 1.0::double confidence, case when c_custkey % 2 = 0 then 0 else 1 end in_ledger from (select c_custkey, lpad(cast(c_custkey as varchar), 7, '0') k, '' p from customer) q")
def facility_names(spark, sf_dir):
    """The cascade of facilities, and whether the ledger takes a decision: it leaves the exact ones out."""
    k = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("Ward "), k).alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Ward "), k)).otherwise(F.concat(F.lit("WARD"), k)).alias("raw"))
    found, taken = reconcile.facilities(c.select("raw"), c.select("name"))
    return found.join(taken.select("raw", F.lit(1).alias("_t")), "raw", "left").select("raw", "resolved", "method", "confidence", F.coalesce("_t", F.lit(0)).alias("in_ledger"))


@query("select key, count(*) names from (select distinct upper(regexp_replace(n, '[^A-Za-z0-9]+', '', 'g')) key, n from (select o_orderpriority || case when o_orderkey % 2 = 0 then ' x' else '-X' end n from orders) q) z group by 1 having count(*) > 1")
def authority_collisions(spark, sf_dir):
    name = F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, " x").otherwise("-X"))
    return reconcile.key_collisions(table(spark, sf_dir, "orders").select(name.alias("name")))


# --- dates -------------------------------------------------------------------------------------


@query("select event_id, extract(doy from d)::bigint day_of_year, date_diff('day', date '2024-01-01', d) days_in, d > date '2024-01-20' late, not (d between date '2024-01-05' and date '2024-01-25') outside from (select event_id, cast(ts as date) d from events) q")
def visit_days(spark, sf_dir):
    day = F.to_date(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("event_id", day.alias("d"))
    on = lambda s: F.lit(s).cast("date")
    return e.select("event_id", F.dayofyear("d").cast("long").alias("day_of_year"), F.date_diff("d", on("2024-01-01")).cast("long").alias("days_in"), (F.col("d") > on("2024-01-20")).alias("late"), (~F.col("d").between(on("2024-01-05"), on("2024-01-25"))).alias("outside"))


# --- shapes ------------------------------------------------------------------------------------

_SHAPE = "select s_suppkey, (s_suppkey * 7919) % 1009 * 1.0::double x, (s_suppkey * 104729) % 1013 * 1.0::double y, 1.0::double + s_suppkey % 5 w, 2.0::double + s_suppkey % 3 h from supplier"


def _boxes(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", ((k * 7919) % 1009).cast("double").alias("x"), ((k * 104729) % 1013).cast("double").alias("y"), (1.0 + k % 5).alias("w"), (2.0 + k % 3).alias("h"))
    corner = lambda a, b: F.struct((F.col("x") + a * F.col("w")).alias("x"), (F.col("y") + b * F.col("h")).alias("y"))
    return s.withColumn("ring", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).withColumn("bow", F.array(corner(0, 0), corner(1, 1), corner(1, 0), corner(0, 1))).withColumn("flat", F.array(corner(0, 0), corner(1, 0), corner(0, 0)))


@query(f"select s_suppkey, round(w * h, 6) area, round(x + w / 2, 6) cx, round(y + h / 2, 6) cy, x minx, y + h maxy, round(2 * w + h, 6) length, 3::bigint sides, true valid, false flat_valid, false crosses, true bow_crosses from ({_SHAPE}) q")
def box_measures(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    ring, c, box = F.col("ring"), geo.centroid(F.col("ring")), geo.bbox(F.col("ring"))
    return b.select(
        "s_suppkey", r(geo.ring_area(ring)).alias("area"), r(c["x"]).alias("cx"), r(c["y"]).alias("cy"), box["minx"].alias("minx"), box["maxy"].alias("maxy"), r(geo.line_length(ring)).alias("length"),
        F.size(geo.segments(ring)).cast("long").alias("sides"), geo.valid_ring(ring).alias("valid"), geo.valid_ring(F.col("flat")).alias("flat_valid"), geo.crosses_itself(ring).alias("crosses"), geo.crosses_itself(F.col("bow")).alias("bow_crosses"),
    )


@query(f"with s as ({_SHAPE}), e as (select cast(cast(x as bigint) as varchar) || ':' || cast(cast(y as bigint) as varchar) u, cast(cast(x + w as bigint) as varchar) || ':' || cast(cast(y as bigint) as varchar) v, h m from s) select least(u, v) src, greatest(u, v) dst, min(m) as \"minutes\" from e group by 1, 2")
def road_segments(spark, sf_dir):
    """Segments whose ends lie up to 0.4 m off their node, some twice, and loops that snap onto one node."""
    b, x, y = _boxes(spark, sf_dir), F.col("x"), F.col("y")
    way = b.select((x + 0.4).alias("x1"), (y - 0.3).alias("y1"), (x + F.col("w") - 0.2).alias("x2"), (y + 0.1).alias("y2"), F.col("h").alias("minutes"))
    slow = way.withColumn("minutes", F.col("minutes") + 5)
    loop = b.select(x.alias("x1"), y.alias("y1"), (x + 0.2).alias("x2"), y.alias("y2"), F.lit(0.1).alias("minutes"))
    return spatial.road_edges(way.unionByName(slow).unionByName(loop))


_LONLAT = "3 + c_custkey % 120 / 10.0::double lon, 4 + c_custkey % 97 / 10.0::double lat"
_AUTHALIC = "(1-e2)*({0}/(1-e2*{0}*{0}) - ln((1-sqrt(e2)*{0})/(1+sqrt(e2)*{0}))/(2*sqrt(e2)))"


@query(f"""
with e as (select 6378137.0::double a, (1/298.257223563::double)*(2 - 1/298.257223563::double) e2, sin(radians(20)) s1, sin(radians(-23)) s2),
p as (select *, cos(radians(20))**2/(1-e2*s1*s1) m1, cos(radians(-23))**2/(1-e2*s2*s2) m2, {_AUTHALIC.format('s1')} q1, {_AUTHALIC.format('s2')} q2 from e),
c as (select *, (m1-m2)/(q2-q1) n from p), d as (select *, m1 + n*q1 c from c),
k as (select c_custkey, {_LONLAT} from customer), x as (select c_custkey, d.*, sin(radians(lat)) s, n*radians(lon-25) th from k cross join d),
y as (select *, a*sqrt(c - n*{_AUTHALIC.format('s')})/n rho from x)
select c_custkey, round(rho*sin(th), 3) x, round(a*sqrt(c)/n - rho*cos(th), 3) y from y
""")
def projected_points(spark, sf_dir):
    k = F.col("c_custkey")
    at = geo.project(3 + k % 120 / 10, 4 + k % 97 / 10)
    return table(spark, sf_dir, "customer").select("c_custkey", at.alias("p")).select("c_custkey", r(F.col("p.x"), 3).alias("x"), r(F.col("p.y"), 3).alias("y"))


# --- forms -------------------------------------------------------------------------------------


@query("select c_custkey, n_name nation, c_name[1:8] head, cast(length(c_name) as double) long_, c_mktsegment || '/' || c_nationkey place, case when c_mktsegment[1:1] in ('A', 'B') then 'early' else 'late' end part, case when c_acctbal < 0 then ceil(c_acctbal::double) else floor(c_acctbal::double) end whole from customer left join nation on n_nationkey = c_nationkey")
def form_functions(spark, sf_dir):
    """Calculated fields of a form over customers as submissions: a lookup pulled through, parts, lengths, choices of a value."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"), "c_acctbal")
    form = [
        forms.Bind("/data/nation", calculate="pulldata('nations', 'n_name', 'n_nationkey', ${c_nationkey})"), forms.Bind("/data/head", calculate="substr(${c_name}, 0, 8)"),
        forms.Bind("/data/long_", calculate="string-length(${c_name})"), forms.Bind("/data/place", calculate="concat(${c_mktsegment}, '/', ${c_nationkey})"),
        forms.Bind("/data/part", calculate="if(starts-with(${c_mktsegment}, 'A') or regex(${c_mktsegment}, 'B.*'), 'early', 'late')"), forms.Bind("/data/whole", calculate="int(${c_acctbal})"),
    ]
    return forms.derived(c, form, lookups={"nations": table(spark, sf_dir, "nation")}).select("c_custkey", *[b.name for b in form])


@query("""
with o as (select o_orderkey k, cast(cast(o_orderdate as date) as varchar) d, o_clerk c, round(o_totalprice / 1000, case when o_orderkey % 3 = 0 then 2 else 1 end) t from (select *, 'Clerk ' || (o_custkey % 1000) o_clerk from orders) q)
select k, 'd' field, 'constraint' violation from o where d > '1995-06-17' union all select k, 'c', 'constraint' from o where not regexp_full_match(c, 'Clerk [0-9]{1,2}') or length(c) > 7
union all select k, 't', 'constraint' from o where abs(t - round(t, 1)) > 0.001
""")
def form_constraints(spark, sf_dir):
    """No later than today, a whole-value pattern with a length, one decimal at most."""
    price = F.col("o_totalprice") / 1000
    # as SQL rounds: 128.605 * 100 lies below its half, whatever its digits say
    to = lambda n: F.round(price * 10.0**n) / 10.0**n
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").cast("string").alias("d"), F.concat(F.lit("Clerk "), (F.col("o_custkey") % 1000).cast("string")).alias("c"), F.when(F.col("o_orderkey") % 3 == 0, to(2)).otherwise(to(1)).alias("t"))
    form = [forms.Bind("/data/d", "date", ". <= today()"), forms.Bind("/data/c", constraint="regex(., 'Clerk [0-9]{1,2}') and string-length(.) <= 7"), forms.Bind("/data/t", "decimal", ". = round(., 1)")]
    return forms.violations(o, form, ["k"], as_of="1995-06-17").select("k", "field", "violation")


_GATES_SQL = """
with l as (select l_orderkey k, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_returnflag, l_suppkey)::int line, l_linenumber nr, l_quantity::double q, case when l_returnflag <> 'N' then l_returnflag end flag, l_suppkey serial, l_linenumber + l_orderkey % 2 rel from lineitem),
e as (select *, q between 10 and 40 elig, count(*) over (partition by k, serial) same from l),
n as (select k, count(*) n, count(*) filter (where elig) nelig from e group by 1),
o as (select o_orderkey k, o_orderstatus st, cast(cast(o_orderdate as date) as varchar) d, lpad(cast(o_custkey % 10000 + case when o_orderkey % 9 = 0 then 1 else 0 end as varchar), 4, '0') pin,
  o_custkey % 30 place, o_orderkey % 5 want, o_orderkey % 4 = 0 late, o_orderkey % 6 stated, coalesce(n, 0) n, coalesce(nelig, 0) nelig, c_custkey from orders left join n on n.k = o_orderkey left join customer on c_custkey = o_custkey),
p as (select o.*, n_regionkey reg from o left join nation on n_nationkey = place)
select k, null::int line, 'pin' field, 'constraint' violation from p where length(pin) <> 4 or pin <> coalesce(lpad(cast(c_custkey % 10000 as varchar), 4, '0'), '')
union all select k, null, 'day', 'constraint' from p where not (d >= '1992-03-01' and d <= '1998-01-01' and d <= '1997-06-17')
union all select k, null, 'place', 'not_a_choice' from p where reg is null or reg <> want
union all select k, null, 'late', 'answered_but_skipped' from p where st <> 'F' and late
union all select k, null, 'late', 'missing' from p where st = 'F' and not late
union all select k, null, 'stated', 'constraint' from p where not (stated = nelig or n > 4)
union all select k, line, 'rel', 'constraint' from e where line = 1 and rel <> 1
union all select k, line, 'serial', 'constraint' from e where same <> 1
union all select k, line, 'flag', 'missing' from e where elig and flag is null
union all select k, line, 'flag', 'answered_but_skipped' from e where not elig and flag is not null
union all select k, line, 'flag', 'constraint' from e where elig and flag <> 'R' and nr <= 3
"""


@query(_GATES_SQL)
def form_gates(spark, sf_dir):
    """A form's gates over whole submissions: orders with their lines as a repeat, lookups, choices by filter, serials counted among neighbours."""
    entry = F.struct(F.col("l_linenumber").alias("nr"), F.col("l_quantity").cast("double").alias("q"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), F.col("l_suppkey").alias("serial"), (F.col("l_linenumber") + F.col("l_orderkey") % 2).alias("rel"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_suppkey", entry.alias("e")))).alias("x")).select("k", F.transform("x", lambda v: v["e"]).alias("roster"))
    key, four = F.col("o_orderkey"), lambda c: F.lpad(c.cast("string"), 4, "0")
    homes = table(spark, sf_dir, "orders").select(
        key.alias("k"), F.col("o_custkey").cast("string").alias("cust"), F.col("o_orderstatus").alias("st"), F.to_date("o_orderdate").cast("string").alias("day"),
        four(F.col("o_custkey") % 10000 + (key % 9 == 0).cast("int")).alias("pin"), (F.col("o_custkey") % 30).cast("string").alias("place"), (key % 5).cast("string").alias("want"),
        F.when(key % 4 == 0, "late").alias("late"), (key % 6).alias("stated"),
    ).join(lines, "k", "left")
    lookups = {
        "staff": table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name"), four(F.col("c_custkey") % 10000).alias("pin")),
        "places": table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_regionkey").cast("string").alias("region")),
    }
    form = [
        forms.Bind("/data/pin", constraint="regex(., '^[0-9]{4}$') and . = pulldata('staff', 'pin', 'name', ${cust})", required="true()"),
        forms.Bind("/data/day", "date", ". >= date('1992-03-01') and . <= date('1998-01-01') and . <= today()", required="true()"),
        forms.Bind("/data/place", choices="places", choice_filter="region = ${want}", required="true()"),
        forms.Bind("/data/late", relevant="${st} = 'F'", required="true()"),
        forms.Bind("/data/roster/line", calculate="position(..)"), forms.Bind("/data/roster/elig", calculate="if(${q} >= 10 and ${q} <= 40, 1, 0)"),
        forms.Bind("/data/roster/rel", "int", "not(${line} = 1) or . = '1'"),
        forms.Bind("/data/roster/serial", constraint="count(/data/roster/serial[. = current()/.]) = 1"),
        forms.Bind("/data/roster/s4", relevant="${elig} = 1"), forms.Bind("/data/roster/s4/flag", constraint=". = 'R' or ${nr} > 3", required="true()"),
        forms.Bind("/data/n", calculate="count(${nr})"), forms.Bind("/data/nelig", calculate="count(${elig}[. = 1])"),
        forms.Bind("/data/stated", "int", ". = ${nelig} or ${n} > 4"),
    ]
    names = {"roster": ["nr", "q", "flag", "serial", "rel"]}
    return forms.checked(homes, form, ["k"], names, lookups, as_of="1997-06-17").select("k", "line", "field", "violation")


@query("select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_returnflag)::int line, l_linenumber number, l_returnflag flag from lineitem")
def repeat_entries(spark, sf_dir):
    """The entries of a repeat as rows of their own, numbered in their order."""
    entry = F.struct(F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("flag"))
    homes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("roster"))
    return forms.entries(homes, "roster").drop("roster")


# --- tables ------------------------------------------------------------------------------------


@query("select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderkey) rn from orders) q where rn = 1")
def first_rows(spark, sf_dir):
    return ordering.first_per_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


@query("select l_returnflag, round(quantile_cont(cast(l_extendedprice as double), 0.1), 6) low, round(quantile_cont(cast(l_extendedprice as double), 0.5), 6) middle from lineitem group by 1")
def group_quantiles(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("v"))
    at = {n: ordering.group_quantile(li, ["l_returnflag"], "v", q, n) for n, q in (("low", 0.1), ("middle", 0.5))}
    return at["low"].join(at["middle"], "l_returnflag").select("l_returnflag", r(F.col("low")).alias("low"), r(F.col("middle")).alias("middle"))


@query("select c_custkey k, c_name as \"name\", s_name name_right from customer left join supplier on s_suppkey = c_custkey")
def merged_once(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return transfer.one_to_one(c, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), "k")


_FOUND = "select c_custkey, c_nationkey declared, case when c_custkey % 6 = 0 then null when c_custkey % 4 = 0 then (c_nationkey + 1) % 25 else c_nationkey end found from customer"


@query(f"select c_custkey, coalesce(found, declared) ward, case when found <> declared then cast(declared as varchar) end was, case when found <> declared then 0.95::double end confidence from ({_FOUND}) q")
def spatial_override(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", n.alias("ward"), F.when(k % 6 == 0, None).when(k % 4 == 0, (n + 1) % 25).otherwise(n).alias("found"))
    rows, entries = transfer.overridden(c, "ward", "found", "c_custkey")
    told = entries.select(F.col("entity_id").cast("long").alias("c_custkey"), F.col("raw_value").alias("was"), "confidence")
    return rows.join(told, "c_custkey", "left").select("c_custkey", "ward", "was", "confidence")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def consented_export(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("consent", (F.col("o_orderstatus") == "F").cast("int"))
    return quality.exportable(o, "consent", ["o_orderkey", "o_totalprice"])


@query("select l_orderkey household, l_linenumber line, o_totalprice w from lineitem join orders on o_orderkey = l_orderkey")
def inherited_weights(spark, sf_dir):
    kids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("household"), F.col("l_linenumber").alias("line"))
    return fieldwork.inherited(kids, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("household"), F.col("o_totalprice").alias("w")), ["w"])


_GHOSTS = "with o as (select l_linestatus h, l_suppkey i, case when l_discount >= 0.05 then 1.0 else 0.0 end y, cast(l_quantity as double) w from lineitem), c as (select h, i, avg(y) c, avg(w) w, i % 4 m from o group by h, i) select 'National' domain, h, i, cast(y as double) y, w from o union all select 'National', h, i, least(greatest(c - 0.1, 0.0), 1.0), w * m * 1.5 from c where m > 0"


@query(_SVY.format(rows=_GHOSTS))
def nonignorable_response(spark, sf_dir):
    """The estimate with a record for those of each cluster who never answered, at its coverage less a tenth."""
    kids = _sample(spark, sf_dir, F.col("l_discount") >= 0.05).withColumn("w", F.col("w").cast("double"))
    cells = kids.groupBy("h", "i").agg(F.avg("y").alias("coverage"), F.avg("w").alias("w")).withColumn("n_missing", F.col("i") % 4).withColumn("kids", F.lit(1.5))
    return _estimates(survey.proportions(response.augmented(kids, cells, 0.1).withColumn("domain", F.lit("National"))))


@query("select * from (values ('C-1.06', 'structure', 'constraint', true), ('C-1.11', 'lat', 'constraint', false), ('C-3.01', 'hh_size', 'gate', true), ('C-3.01g', 'roster_gate', 'gate', false), ('C-5.03a', 'serial', 'gate', true), ('C-5.05', 'temp', 'gate', false)) v(rule_id, field, enforcement, required)")
def rule_register(spark, sf_dir):
    return rules.register(spark, rules.HOUSEHOLD).select("rule_id", "field", "enforcement", "required")


@query("select * from (values ('C-1.11', 'constraint', 'lat between 10.2 and 11.75', 'lat between 4.0 and 14.0'), ('C-5.05', 'field', 'temp', null), ('C-5.05', 'constraint', 'temp between -5.0 and 40.0 and temp = round(temp, 1)', null), ('C-5.05', 'relevant', 'obtained = 1', null), ('C-5.05', 'required', 'False', null), ('C-5.05', 'calculation', '', null)) v(rule_id, attribute, a, b)")
def rule_variants(spark, sf_dir):
    other = [rules.Rule(x.rule_id, x.field, "lat between 4.0 and 14.0" if x.field == "lat" else x.constraint, x.relevant, x.required, x.calculation, x.justified_by) for x in rules.HOUSEHOLD if x.field != "temp"]
    return rules.variant_diff(spark, rules.HOUSEHOLD, other)


@query("select l_orderkey, rank() over (order by l_orderkey) + (count(*) over (partition by l_orderkey) - 1) / 2.0::double as \"rank\", l_linenumber from lineitem")
def average_ranks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return measures.average_ranks(li, "l_orderkey", "rank").select("l_orderkey", F.col("rank").cast("double").alias("rank"), "l_linenumber")


# --- streams -----------------------------------------------------------------------------------


def _streamed(spark, df, mode="append"):
    """The rows of a stream run to the end of its input, as a table of files in the shared folder."""
    at = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    streaming.into_folder(df, f"{at}/rows", f"{at}/checkpoint", mode)
    return streaming.from_folder(spark, f"{at}/rows", df.schema)


def _events(spark, sf_dir):
    """events as a stream, whether the table is a file or a folder of them."""
    schema, path = table(spark, sf_dir, "events").schema, spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    files = spark.readStream.schema(schema)
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    found = files.parquet(f"{sf_dir}/events.parquet") if folder else files.option("pathGlobFilter", "events.parquet").parquet(f"{sf_dir}/")
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


@query("select distinct user_id, event_type from events")
def stream_without_repeats(spark, sf_dir):
    """One row for each pair within the span that devices may stay unsynchronised; the input is one batch here."""
    return _streamed(spark, streaming.without_repeats(_events(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type"))


@query("select event_id, value > 100 as \"R6\", event_type = 'error' as \"R7\" from events where coalesce(value > 100, false) or event_type = 'error'")
def stream_gate(spark, sf_dir):
    """Flagged submissions of a stream."""
    out = streaming.gated(_events(spark, sf_dir), {"R6": F.col("value") > 100, "R7": F.col("event_type") == "error"})
    return _streamed(spark, out.where("R6 or R7").select("event_id", "R6", "R7"))


@query("with a as (select event_id, user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) p from events) select event_id, user_id, round((epoch_us(ts)-epoch_us(p))/6e7, 4) gap from a where ts < p + interval '2' minute")
def stream_overlaps(spark, sf_dir):
    """Visits of a stream that follow too closely, the same rows as the batch form; the input is one batch, so nothing is late."""
    visits = _events(spark, sf_dir).select(F.col("user_id").alias("who"), F.col("ts").alias("start"), F.col("ts").alias("end"), F.col("event_id").alias("id"))
    out = _streamed(spark, streaming.overlaps(visits, 2, late="0 seconds"))
    return out.select(F.col("id").alias("event_id"), F.col("who").cast("long").alias("user_id"), r(F.col("gap"), 4).alias("gap"))
