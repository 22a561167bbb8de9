"""Queries over the input tables that apply the operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import geo, numeric, text
from fieldloom.operators import fieldwork, forms, ordering, quality, reconcile, spatial, survey, transfer
from fieldloom.session import shared_root, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r(c, n: int = 6):
    return F.round(c, n)


# --- survey estimation -------------------------------------------------------------------------

_SVY = """
with o as ({rows}),
t as (select domain, sum(w*y)/sum(w) p, sum(w) sw, count(*) n, sum(w*w) sww from o group by domain),
z as (select o.domain, h, i, sum(w*(y-p)/sw) z from o join t using (domain) group by o.domain, h, i),
v as (select domain, h, count(*) nh, case when count(*)>1 then count(*)*var_samp(z) else 0.0 end vh from z group by domain, h),
d as (select domain, sum(vh) v, cast(greatest(sum(nh)-count(*), 1) as bigint) df, sum(nh) m from v group by domain)
select domain, round(p,6) p, round(sqrt(v),6) se, n, df, round(v/(p*(1-p)/(n-1)),4) deff, round(n*sww/(sw*sw),4) kish from d join t using (domain)
"""


def _estimates(df: DataFrame) -> DataFrame:
    return df.select("domain", r(F.col("p")).alias("p"), r(F.col("se")).alias("se"), "n", "df", r(F.col("deff"), 4).alias("deff"), r(F.col("kish"), 4).alias("kish"))


def _sample(spark: SparkSession, sf_dir: str, y) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(y.cast("double").alias("y"), F.col("l_quantity").alias("w"), F.col("l_linestatus").alias("h"), F.col("l_suppkey").alias("i"), "l_returnflag", "l_discount")


@query(_SVY.format(rows="select 'National' domain, l_linestatus h, l_suppkey i, case when l_returnflag='R' then 1.0 else 0.0 end y, l_quantity w from lineitem"))
def svy_prop_national(spark, sf_dir):
    return _estimates(survey.proportions(_sample(spark, sf_dir, F.col("l_returnflag") == "R").withColumn("domain", F.lit("National"))))


@query(_SVY.format(rows="select 'flag='||l_returnflag domain, l_linestatus h, l_suppkey i, case when l_discount>=0.05 then 1.0 else 0.0 end y, l_quantity w from lineitem union all select 'National', l_linestatus, l_suppkey, case when l_discount>=0.05 then 1.0 else 0.0 end, l_quantity from lineitem"))
def svy_prop_by_domain(spark, sf_dir):
    rows = _sample(spark, sf_dir, F.col("l_discount") >= 0.05)
    return _estimates(survey.proportions_by(rows, {"": F.lit("National"), "flag": F.col("l_returnflag")}))


@query(_SVY.format(rows="select c.v domain, l_linestatus h, l_suppkey i, case when l_discount>=c.k then 1.0 else 0.0 end y, l_quantity w from lineitem cross join (values ('d02',0.02),('d05',0.05),('d08',0.08)) c(v,k)"))
def sensitivity_stack(spark, sf_dir):
    cuts = {"d02": 0.02, "d05": 0.05, "d08": 0.08}
    rows = _sample(spark, sf_dir, F.lit(0)).drop("y")
    return _estimates(survey.proportions_of_variants(rows, {d: (F.lit(True), F.col("l_discount") >= k, F.col("w")) for d, k in cuts.items()}))


@query(_SVY.format(rows="select printf('%.2f', r) domain, l_linestatus h, l_suppkey i, case when l_returnflag='R' then 1-r when l_returnflag='A' then 1.0 else 0.0 end y, l_quantity w from lineitem cross join (values (0.0),(0.1),(0.2),(0.3)) q(r)"))
def recall_sweep(spark, sf_dir):
    rows = _sample(spark, sf_dir, F.col("l_returnflag").isin("R", "A")).withColumn("recalled", F.col("l_returnflag") == "R")
    return _estimates(survey.proportions_of_variants(rows, survey.reported_sweep([0.0, 0.1, 0.2, 0.3])))


@query("select o_orderstatus scope, count(*) n, round(min(o_totalprice),4) least, round(median(o_totalprice),4) median_w, round(avg(o_totalprice),4) mean_w, round(max(o_totalprice),4) most, round(stddev_samp(o_totalprice)/avg(o_totalprice),6) cv, round(count(*)*sum(o_totalprice*o_totalprice)/(sum(o_totalprice)*sum(o_totalprice)),6) kish from orders group by 1")
def kish_weights(spark, sf_dir):
    w, o = F.col("w"), table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("scope"), F.col("o_totalprice").alias("w"))
    sums = o.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"), r(F.min(w), 4).alias("least"), r(F.avg(w), 4).alias("mean_w"), r(F.max(w), 4).alias("most"),
        r(F.stddev_samp(w) / F.avg(w)).alias("cv"), r(F.count(F.lit(1)) * F.sum(w * w) / (F.sum(w) * F.sum(w))).alias("kish"),
    )
    middle = ordering.group_quantile(o, ["scope"], "w", 0.5, "m").select("scope", r(F.col("m"), 4).alias("median_w"))
    return sums.join(middle, "scope")


@query("with a as (select l_linestatus h, l_extendedprice w, median(l_extendedprice) over (partition by l_linestatus) md, sum(l_extendedprice) over (partition by l_linestatus) t from lineitem), b as (select h, w, least(w, 2*md) c, t from a), d as (select h, w, c*t/sum(c) over (partition by h) x from b) select h, count(*) n, round(sum(x),2) total, round(max(x),4) most, round(sum(w),2) before from d group by h")
def weight_trim_rescale(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("h"), F.col("l_extendedprice").alias("w"))
    out = survey.trimmed(rows, 2.0)
    return out.groupBy("h").agg(F.count(F.lit(1)).alias("n"), r(F.sum("w_trimmed"), 2).alias("total"), r(F.max("w_trimmed"), 4).alias("most"), r(F.sum("w"), 2).alias("before"))


@query("with a as (select o_custkey % 50 cluster, o_totalprice w, o_orderstatus <> 'P' e, o_orderstatus = 'F' f from orders), b as (select cluster, sum(case when e then 1 else 0 end) ne, sum(case when e and f then 1 else 0 end) nf, sum(case when e and f then w end) sw from a group by cluster) select cluster, round(ne*1.0/nullif(nf,0),6) factor, round(sw*ne/nullif(nf,0),2) total from b")
def nonresponse_adjust(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("cluster"), F.col("o_totalprice").alias("w"), (F.col("o_orderstatus") != "P").alias("eligible"), (F.col("o_orderstatus") == "F").alias("responded"))
    out = survey.response_weights(rows)
    return out.groupBy("cluster").agg(r(F.first("nr_adjustment")).alias("factor"), r(F.sum("w_final"), 2).alias("total"))


@query()
def bootstrap_se(spark, sf_dir):
    return survey.bootstrap(_sample(spark, sf_dir, F.col("l_returnflag") == "R"), reps=500)


@query("with c as (select l_linestatus i, sum(case when l_returnflag = 'R' then l_quantity else 0 end) / sum(l_quantity) p from lineitem group by 1) select round(min(p), 6) low, round(max(p), 6) high, cast(400 as bigint) reps from c")
def bootstrap_pair(spark, sf_dir):
    """A stratum of two clusters: a replicate is one of them or the other, so the interval's ends are theirs."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.lit("all").alias("h"), F.col("l_linestatus").alias("i"), F.col("l_quantity").cast("double").alias("w"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    return survey.bootstrap(rows, reps=400).select(r(F.col("low")).alias("low"), r(F.col("high")).alias("high"), "reps")


_Z = "1.959963984540054::double"
#: Student's quantile in SQL: its expansion in 1/df around the normal one, below 1e-4 off from df 9 on.
_T = f"({_Z} + (power({_Z},3)+{_Z})/(4*df) + (5*power({_Z},5)+16*power({_Z},3)+3*{_Z})/(96.0*df*df) + (3*power({_Z},7)+19*power({_Z},5)+17*power({_Z},3)-15*{_Z})/(384.0*df*df*df) + (79*power({_Z},9)+776*power({_Z},7)+1482*power({_Z},5)-1920*power({_Z},3)-945*{_Z})/(92160.0*df*df*df*df))"
_BOTH = _SVY.format(rows="select unnest(['National', 'status='||l_linestatus]) domain, l_linestatus h, l_suppkey i, case when l_returnflag='R' then 1.0 else 0.0 end y, l_quantity w from lineitem").replace("round(p,6) p, round(sqrt(v),6) se, n, df", "p, sqrt(v) se, n, df")


@query(f"with e as ({_BOTH}), t as (select *, {_T} t from e), x as (select *, p > 0 and p < 1 and se > 0 lg, ln(p/nullif(1-p,0)) m, t*se/nullif(p*(1-p),0) k from t) select domain, round(p,6) p, round(se,6) se, df, round(case when lg then 1/(1+exp(k-m)) else greatest(p-t*se,0) end,4) low, round(case when lg then 1/(1+exp(-m-k)) else least(p+t*se,1) end,4) high, case when lg then 'logit' else 'wald' end ci_used from x")
def svy_intervals(spark, sf_dir):
    rows = survey.stack_domains(_sample(spark, sf_dir, F.col("l_returnflag") == "R"), {"": F.lit("National"), "status": F.col("h")})
    out = survey.with_intervals(survey.proportions(rows))
    return out.select("domain", r(F.col("p")).alias("p"), r(F.col("se")).alias("se"), "df", r(F.col("low"), 4).alias("low"), r(F.col("high"), 4).alias("high"), "ci_used")


@query("with a as (select l_suppkey id, avg(l_quantity) d, avg(case when l_returnflag='N' then 1.0 else 0 end) c, avg(l_discount) k, avg(case when l_linestatus='O' then 1.0 else 0 end) f from lineitem group by 1), m as (select median(d)*1.9 md, avg(k)*3 mk from a), s as (select id, d < 0.5*md r_short, c >= 0.99 r_perfect, k < 0.3*mk r_cards, f >= 0.5 r_complete from a cross join m), n as (select *, cast(r_short as int)+cast(r_perfect as int)+cast(r_cards as int)+cast(f2 as int) q from (select *, false f2 from s) z) select id, r_short, r_perfect, r_cards, case when q>=3 then 'EXCLUDE' when q>=1 then 'REVIEW' else 'OK' end verdict from n")
def falsification_screen(spark, sf_dir):
    share = lambda c: F.avg(c.cast("double"))
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.avg("l_quantity").alias("duration"), share(F.col("l_returnflag") == "N").alias("coverage"), F.avg("l_discount").alias("card_rate"))
    all_ = per.agg((F.percentile("duration", F.lit(0.5)) * 1.9).alias("median_duration"), (F.avg("card_rate") * 3).alias("all_card_rate"))
    out = survey.screen(per.withColumn("completion", F.lit(0.0)).crossJoin(F.broadcast(all_)))
    return out.select("id", "r_short", "r_perfect", "r_cards", "verdict")


# --- gates, constraints, screens ---------------------------------------------------------------

_LOW, _HIGH = "2024-01-05", "2024-01-25"


def _gated(spark, sf_dir, strict=False):
    e = table(spark, sf_dir, "events")
    rules = {
        "R3": F.col("value").isNull(), "R4": ~F.to_date("ts").between(F.lit(_LOW).cast("date"), F.lit(_HIGH).cast("date")),
        "R5": ~((F.hour("ts") >= 7) & (F.hour("ts") < 19)), "R6": F.col("value") > 100, "R7": F.col("event_type") == "error",
    }
    return quality.gate(e, rules, strict)


_GATE = f"select *, value is null R3, not (cast(ts as date) between date '{_LOW}' and date '{_HIGH}') R4, not (extract(hour from ts) >= 7 and extract(hour from ts) < 19) R5, value > 100 R6, event_type = 'error' R7 from events"
_FIRST = "case when R3 then 'R3' when R4 then 'R4' when R5 then 'R5' when R6 then 'R6' when R7 then 'R7' else 'PASS' end"


@query(f"with g as ({_GATE}) select event_id, R3, R4, R5, R6, R7, coalesce(not (R3 or R4 or R5 or R6 or R7), false) \"valid\", {_FIRST} gate from g")
def qa_gate_flags(spark, sf_dir):
    return _gated(spark, sf_dir).select("event_id", "R3", "R4", "R5", "R6", "R7", "valid", "gate")


@query(f"with g as ({_GATE}) select rule, broken from (select cast(count(*) filter (where R3) as bigint) R3, cast(count(*) filter (where R4) as bigint) R4, cast(count(*) filter (where R5) as bigint) R5, cast(count(*) filter (where R6) as bigint) R6, cast(count(*) filter (where R7) as bigint) R7 from g) unpivot (broken for rule in (R3,R4,R5,R6,R7))")
def qa_rule_report(spark, sf_dir):
    rules = ["R3", "R4", "R5", "R6", "R7"]
    counts = _gated(spark, sf_dir).agg(*[F.count_if(F.col(k)).alias(k) for k in rules])
    return counts.unpivot([], rules, "rule", "broken")


@query(f"with g as ({_GATE}), h as (select {_FIRST} gate from g) select gate, count(*) n, round(100.0*count(*)/sum(count(*)) over (), 2) percent from h group by gate")
def qa_partition(spark, sf_dir):
    n = _gated(spark, sf_dir).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


_RULES = quality.Catalogue([
    quality.Constraint("pk_orders", "orders", "primary_key", ("o_orderkey",)),
    quality.Constraint("pk_lineitem", "lineitem", "primary_key", ("l_orderkey", "l_linenumber")),
    quality.Constraint("nn_customer", "customer", "not_null", ("c_name", "c_nationkey")),
    quality.Constraint("uq_supplier", "supplier", "unique", ("s_name",)),
    quality.Constraint("ck_discount", "lineitem", "check", predicate="l_discount >= 0 and l_discount <= 0.08"),
    quality.Constraint("ck_status", "orders", "check", predicate="o_orderstatus in ('F','O')"),
    quality.Constraint("fk_orders", "orders", "foreign_key", ("o_custkey",), parent="customer", parent_columns=("c_custkey",)),
    quality.Constraint("fk_lineitem", "lineitem", "foreign_key", ("l_orderkey",), parent="orders", parent_columns=("o_orderkey",)),
    quality.Constraint("fk_nation", "customer", "foreign_key", ("c_nationkey",), parent="nation", parent_columns=("n_nationkey",)),
])


@query("""
select 'pk_orders' name, 'orders' table_name, 'primary_key' kind, count(*) violations from (select o_orderkey from orders group by 1 having count(*) > 1 or o_orderkey is null)
union all select 'pk_lineitem', 'lineitem', 'primary_key', count(*) from (select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) > 1)
union all select 'nn_customer', 'customer', 'not_null', count(*) from customer where c_name is null or c_nationkey is null
union all select 'uq_supplier', 'supplier', 'unique', count(*) from (select s_name from supplier where s_name is not null group by 1 having count(*) > 1)
union all select 'ck_discount', 'lineitem', 'check', count(*) from lineitem where not (l_discount >= 0 and l_discount <= 0.08)
union all select 'ck_status', 'orders', 'check', count(*) from orders where o_orderstatus not in ('F','O')
union all select 'fk_orders', 'orders', 'foreign_key', count(*) from orders where o_custkey is not null and o_custkey not in (select c_custkey from customer)
union all select 'fk_lineitem', 'lineitem', 'foreign_key', count(*) from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey)
union all select 'fk_nation', 'customer', 'foreign_key', count(*) from customer where c_nationkey not in (select n_nationkey from nation)
""")
def constraint_report(spark, sf_dir):
    return _RULES.report({t: table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "supplier", "nation")})


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def orphan_audit(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("with a as (select event_id, user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) p from events) select event_id, user_id, round((epoch_us(ts)-epoch_us(p))/6e7, 4) gap from a where ts < p + interval '2' minute")
def overlap_gap(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("who"), F.col("ts").alias("start"), F.col("ts").alias("end"), F.col("event_id").alias("id"))
    return quality.overlaps(e, 2).select(F.col("id").alias("event_id"), F.col("who").alias("user_id"), r(F.col("gap"), 4).alias("gap"))


@query("""
with e as (select user_id who, cast(ts as date) d, value m, event_type t, event_id % 7 la from events),
pt as (select who, max(n) same_point from (select who, la, count(*) n from e group by who, la) group by who),
p as (select who, count(*) n, quantile_cont(case when m > 0 then m end, 0.5) med, sum(case when t='click' then 1 else 0 end)*1.0/count(*) cr, count(*)*1.0/greatest(count(distinct d),1) per_day from e group by who having count(*) >= 5)
select who, n, round(med, 6) median_minutes, round(per_day, 6) per_day, same_point,
  concat_ws(',', case when med < 15 then 'too_quick' end, case when cr < 0.15 and n >= 5 then 'few_cards' end, case when per_day >= 8 then 'volume' end, case when same_point >= 14 then 'never_moved' end) reasons,
  case when coalesce(med < 15, false) and ((cr < 0.15 and n >= 5) or same_point >= 14) then 'INVESTIGATE' when med < 15 or (cr < 0.15 and n >= 5) or per_day >= 8 or same_point >= 14 then 'REVIEW' else 'OK' end verdict
from p join pt using (who)
""")
def enumerator_screen(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("user_id").alias("who"), F.to_date("ts").alias("day"), F.col("value").alias("minutes"), F.lit(1).alias("modules"), (F.col("event_type") == "click").cast("int").alias("cards"),
        F.lit(0).alias("eligible"), F.lit(0).alias("specimens"), (F.col("event_id") % 7).cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.lit(False).alias("overlap"),
    )
    out = quality.enumerator_screen(rows, cards=0.15, same_point=14)
    return out.select("who", "n", r(F.col("median_minutes")).alias("median_minutes"), r(F.col("per_day")).alias("per_day"), "same_point", "reasons", "verdict")


@query("with c as (select cast(floor(value) as bigint) % 10 digit, count(*) n from events where value is not null group by 1), f as (select d digit, coalesce(n, 0) n from range(10) q(d) left join c on d = digit), t as (select sum(n) t from f) select digit, cast(n as bigint) n, round(n*1.0/t, 8) share, round((n-t/10.0)*(n-t/10.0)/(t/10.0), 6) chi2_part from f cross join t")
def digit_preference(spark, sf_dir):
    return quality.digit_preference(table(spark, sf_dir, "events"), "value").select("digit", "n", r(F.col("share"), 8).alias("share"), r(F.col("chi2_part")).alias("chi2_part"))


@query("with m as (select median(s_acctbal) m from supplier), d as (select s_suppkey, s_acctbal, m, abs(s_acctbal-m) d from supplier cross join m), a as (select median(d) a from d) select s_suppkey, round(case when a > 0 then (s_acctbal-m)/(1.4826*a) end, 6) z from d cross join a")
def robust_z(spark, sf_dir):
    return quality.robust_z(table(spark, sf_dir, "supplier"), "s_acctbal").select("s_suppkey", r(F.col("z")).alias("z"))


@query("with c as (select p_size age, count(*) n from part group by 1), f as (select a age, coalesce(n, 0) n from range(1, 51) q(a) left join c on a = age), s as (select age, n, quantile_cont(n, 0.5) over (order by age rows between 2 preceding and 2 following) smooth from f) select age, cast(n as bigint) n, round(smooth, 4) smooth, cast(age % 12 as bigint) residue from s")
def age_heaping(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("age")).agg(F.count(F.lit(1)).alias("n"))
    full = spark.range(1, 51).withColumnRenamed("id", "age").join(counts, "age", "left").select("age", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    near = Window.orderBy("age").rowsBetween(-2, 2)  # one row per age
    return full.select("age", "n", F.round(F.percentile("n", F.lit(0.5)).over(near), 4).alias("smooth"), (F.col("age") % 12).alias("residue"))


# --- names, coordinates, digits ----------------------------------------------------------------

_KEY = "upper(regexp_replace({0}, '[^A-Za-z0-9]+', '', 'g'))"


def _stripped(c: str) -> str:
    ending = rf"\b(?:{'|'.join(text.ADMIN_SUFFIXES)})\b\s*$"
    s = f"trim(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' .,;:-')"
    for _ in range(6):
        s = f"trim(regexp_replace({s}, '{ending}', '', 'i'))"
    return s


_NAMES = "select p_partkey, case p_partkey % 5 when 0 then p_name when 1 then ' ' || p_name || ' Local Govt Area ' when 2 then p_name || '.State' when 3 then upper(p_name) || ' - LGA' else p_name || ' district LGA' end raw, p_name from part"


def _names(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 5
    raw = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit(" "), "p_name", F.lit(" Local Govt Area "))).when(k == 2, F.concat("p_name", F.lit(".State"))).when(k == 3, F.concat(F.upper("p_name"), F.lit(" - LGA"))).otherwise(F.concat("p_name", F.lit(" district LGA")))
    return p.select("p_partkey", raw.alias("raw"), "p_name")


@query(f"select p_partkey, {_KEY.format(_stripped('raw'))} key from ({_NAMES})")
def name_match_key(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", text.match_key(F.col("raw")).alias("key"))


@query(f"with n as ({_NAMES}), a as (select distinct trim(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), ' .,;:-') name from part), k as (select {_KEY.format('name')} key, max(name) by_key from a group by 1), q as (select distinct raw, trim(trim(regexp_replace(raw, '\\s+', ' ', 'g')), ' .,;:-') clean, {_KEY.format(_stripped('raw'))} key from n) select raw, coalesce(a.name, by_key) resolved, case when a.name is not null then 'exact' else 'normalised' end \"method\", 1.0 confidence from q left join a on a.name = clean left join k using (key)")
def match_cascade(spark, sf_dir):
    out = reconcile.cascade(_names(spark, sf_dir).select("raw"), table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))
    return out


_FUZZY = """with recursive s as (select s_suppkey ord, s_name name, upper(regexp_replace(s_name, '[^A-Za-z0-9]+', '', 'g')) key from supplier),
q as (select distinct left(s_name, 14) || 'x' || reverse(substr(s_name, 15, 4)) raw from supplier),
o as (select raw, upper(regexp_replace(raw, '[^A-Za-z0-9]+', '', 'g')) k from q),
piece as (
  select k, key, k a, key b, 0 m from o, s
  union all
  select k, key, unnest([left(a, i - 1), substr(a, i + l), '']), unnest([left(b, j - 1), substr(b, j + l), '']), unnest([0, 0, l])
  from (select k, key, a, b, l, i, strpos(b, substr(a, i, l)) j from (
    select k, key, a, b, best.l l, -best.n i from (
      select k, key, a, b, list_max(flatten([[{'l': y, 'n': -x} for y in range(1, length(a) - x + 2) if contains(b, substr(a, x, y))] for x in range(1, length(a) + 1)])) best
      from piece where a <> '' and b <> '') p where best is not null) p) p),
score as (select k, key, 2.0 * sum(m) / (length(k) + length(key)) v from piece group by k, key),
best as (select k, v, name, row_number() over (partition by k order by v desc, ord) r from score join s using (key))
select row_number() over (order by raw) ledger_id, 'crosswalk' stage, 'supplier' field, raw raw_value, case when v >= 0.75 then name end resolved_value,
  case when v >= 0.88 then 'fuzzy_accepted' when v >= 0.75 then 'fuzzy_review' else 'unresolved' end "method", v confidence,
  case when v >= 0.88 then 'resolved' when v >= 0.75 then 'resolved_review' else 'unresolved' end outcome
from o join best using (k) where r = 1"""


@query(_FUZZY)
def match_fuzzy(spark, sf_dir):
    """Every supplier's name with two digits turned round, against all names: ties are many, and the first counts."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"))
    turned = F.concat(F.substring("name", 1, 14), F.lit("x"), F.reverse(F.substring("name", 15, 4)))
    return reconcile.ledger(reconcile.cascade(names.select(turned.alias("raw")), names), "crosswalk", "supplier")


_COORD = "case o_orderkey % 6 when 0 then cast(5 + (o_orderkey % 700) / 100.0 as varchar) when 1 then '9,06' || lpad(cast(o_orderkey % 10000 as varchar), 4, '0') when 2 then cast(o_orderkey % 12 as varchar) || '°38''33.6\"E' when 3 then 'n/a' when 4 then 'abc' else cast(o_orderkey % 12 as varchar) || 'd15m0sS' end"


@query(f"with c as (select o_orderkey, {_COORD} raw, o_orderkey % 6 k from orders) select o_orderkey, case k when 0 then 'decimal' when 1 then 'comma_decimal' when 2 then 'dms' when 3 then 'missing' when 4 then 'unparseable' else 'dms' end \"method\", round(case k when 0 then cast(raw as double) when 1 then cast(replace(raw, ',', '.') as double) when 2 then o_orderkey % 12 + 38/60.0 + 33.6/3600 when 5 then -(o_orderkey % 12 + 0.25) end, 6) \"value\" from c")
def parse_coordinate(spark, sf_dir):
    k, key = F.col("o_orderkey") % 6, F.col("o_orderkey")
    raw = (
        F.when(k == 0, (5 + (key % 700) / 100).cast("string")).when(k == 1, F.concat(F.lit("9,06"), F.lpad((key % 10000).cast("string"), 4, "0")))
        .when(k == 2, F.concat((key % 12).cast("string"), F.lit("°38'33.6\"E"))).when(k == 3, F.lit("n/a")).when(k == 4, F.lit("abc")).otherwise(F.concat((key % 12).cast("string"), F.lit("d15m0sS")))
    )
    parsed = table(spark, sf_dir, "orders").select("o_orderkey", numeric.parse_coordinate(raw).alias("c"))
    return parsed.select("o_orderkey", F.col("c.method").alias("method"), r(F.col("c.value")).alias("value"))


_BOX = "({0} between 5.0 and 12.0 and {1} between 6.3 and 12.2)"


@query(f"with c as (select c_custkey, (c_custkey % 40 - 15) * 1.0 lon, (c_custkey % 37 - 12) * 1.0 lat from customer) select c_custkey, case when {_BOX.format('lon', 'lat')} then 'accepted' when {_BOX.format('lat', 'lon')} then 'repaired_axis_swap' when (lon < 0 or lat < 0) and {_BOX.format('abs(lon)', 'abs(lat)')} then 'repaired_sign' when (lon < 0 or lat < 0) and {_BOX.format('abs(lat)', 'abs(lon)')} then 'repaired_swap_and_sign' when {_BOX.format('lon/10', 'lat')} or {_BOX.format('lon', 'lat/10')} or {_BOX.format('lon/10', 'lat/10')} then 'repaired_scale' else 'quarantined_out_of_area' end status from c")
def repair_pair(spark, sf_dir):
    lon, lat = (F.col("c_custkey") % 40 - 15).cast("double"), (F.col("c_custkey") % 37 - 12).cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", numeric.repair_pair(lon, lat)["status"].alias("status"))


@query("with s as (select c_custkey, lpad(cast(c_custkey as varchar), 6, '0') s from customer), t as (select c_custkey, s, (7*cast(s[1] as int)+6*cast(s[2] as int)+5*cast(s[3] as int)+4*cast(s[4] as int)+3*cast(s[5] as int)+2*cast(s[6] as int)) % 11 d from s) select c_custkey, 'BSN' || s || '-' || case when d = 10 then 'X' else cast(d as varchar) end label from t")
def check_digit(spark, sf_dir):
    s = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("BSN"), s, F.lit("-"), numeric.check_digit(s)).alias("label"))


# --- space -------------------------------------------------------------------------------------

_SQUARES = [(1, 1.0, 1.0, 4.0, 5.0), (2, 3.0, 3.0, 8.0, 9.0), (3, 6.0, 0.5, 9.5, 2.5)]


@query("with p as (select event_id, (event_id * 37 % 1000) / 100.0 + 0.0003 x, (event_id * 91 % 1000) / 100.0 + 0.0007 y from events), g(zone, x0, y0, x1, y1) as (values (1, 1.0, 1.0, 4.0, 5.0), (2, 3.0, 3.0, 8.0, 9.0), (3, 6.0, 0.5, 9.5, 2.5)) select event_id, zone from p join g on x >= x0 and x <= x1 and y >= y0 and y <= y1")
def pip_join(spark, sf_dir):
    points = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 37 % 1000) / 100 + 0.0003).alias("x"), ((F.col("event_id") * 91 % 1000) / 100 + 0.0007).alias("y"))
    rows = [(z, [(a, b), (c, b), (c, d), (a, d)]) for z, a, b, c, d in _SQUARES]
    zones = spark.createDataFrame(rows, "zone int, ring array<struct<x:double,y:double>>")
    return spatial.polygon_join(points, zones, 2.0).select("event_id", "zone")


def _sites(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    supply = s.select(F.col("s_suppkey").alias("j"), ((F.col("s_suppkey") * 7919) % 1009).cast("double").alias("x"), ((F.col("s_suppkey") * 104729) % 1013).cast("double").alias("y"), (F.col("s_acctbal") + 2000).alias("cap"))
    demand = c.select(F.col("c_custkey").alias("i"), ((F.col("c_custkey") * 7907) % 1009).cast("double").alias("x"), ((F.col("c_custkey") * 104723) % 1013).cast("double").alias("y"), (F.col("c_acctbal") + 2000).alias("pop"), F.col("c_nationkey").alias("zone"))
    return demand, supply


_SITES = "s as (select s_suppkey j, (s_suppkey*7919)%1009*1.0 x, (s_suppkey*104729)%1013*1.0 y, s_acctbal+2000 cap from supplier), c as (select c_custkey i, (c_custkey*7907)%1009*1.0 x, (c_custkey*104723)%1013*1.0 y, c_acctbal+2000 pop, c_nationkey zone from customer), p as (select i, j, sqrt((c.x-s.x)*(c.x-s.x)+(c.y-s.y)*(c.y-s.y)) d from c cross join s)"


@query(f"with {_SITES}, k as (select i, j, d, row_number() over (partition by i order by round(d*d), j) r from p) select i, j, r \"rank\", cast(round(d*d) as bigint) dist2 from k where r <= 3")
def nearest_facilities(spark, sf_dir):
    demand, supply = _sites(spark, sf_dir)
    return spatial.nearest(demand, supply, 3, 100.0).select("i", "j", F.col("rank").cast("long").alias("rank"), F.col("dist2").cast("long").alias("dist2"))


@query("with s as (select s_suppkey id, (s_suppkey*7919)%1009*1.0 x, (s_suppkey*104729)%1013*1.0 y, s_acctbal v from supplier), n as (select a.id i, b.v, row_number() over (partition by a.id order by (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.id) r from s a cross join s b), w as (select count(*) n, avg(v) m, sqrt(avg(v*v)-avg(v)*avg(v)) d from s), z as (select i id, (sum(v)-8*max(m))/(max(d)*sqrt((max(w.n)*8.0-64)/(max(w.n)-1))) z from n cross join w where r <= 8 group by i) select id, round(z, 6) z, case when z > 1.96 then 'hot' when z < -1.96 then 'cold' else 'none' end label from z")
def knn_gi_star(spark, sf_dir):
    _, supply = _sites(spark, sf_dir)
    points = supply.select(F.col("j").alias("i"), "x", "y")
    near = spatial.nearest(points, supply, 8, 150.0)
    out = spatial.hot_spots(supply.select(F.col("j").alias("id"), (F.col("cap") - 2000).alias("v")), near, 8)
    return out.select("id", r(F.col("z")).alias("z"), "label")


@query(f"with {_SITES}, e as (select i, j from p where d <= 120), f as (select j, sum(pop) people from e join c using (i) group by j), g as (select s.j, cap/people r from s join f on f.j = s.j), a as (select i, sum(r) a from e join g using (j) group by i) select zone, round(sum(pop*coalesce(a,0))/sum(pop), 6) access from c left join a using (i) group by zone")
def two_step_fca(spark, sf_dir):
    demand, supply = _sites(spark, sf_dir)
    out = spatial.catchment_access(demand, supply, 120.0)
    return out.select("zone", r(F.col("access")).alias("access"))


_COVER = f"with {_SITES}, m as (select i, min(d)/1000/5.0*60 mins from p group by i), t(threshold) as (values (0.5), (0.8), (1.2)) select zone, threshold, sum(case when mins <= threshold then pop else 0 end) covered, sum(pop) pop from c join m using (i) cross join t group by zone, threshold"


@query(f"select zone, cast(threshold as double) threshold, round(covered, 2) covered, round(covered/pop, 6) fraction from ({_COVER})")
def coverage_sweep(spark, sf_dir):
    demand, supply = _sites(spark, sf_dir)
    near = spatial.nearest(demand, supply, 1, 60.0).select("i", geo.travel_minutes(F.sqrt("dist2"), 5.0).alias("minutes"))
    out = spatial.coverage(demand, near, [0.5, 0.8, 1.2])
    return out.select("zone", "threshold", r(F.col("covered"), 2).alias("covered"), r(F.col("fraction")).alias("fraction"))


_GAP = f"with q as ({_COVER}), a as (select zone, max(case when threshold=0.5 then covered/pop end) coverage, max(case when threshold=0.8 then covered/pop end) upgraded, max(case when threshold=0.5 then pop-covered end) uncovered from q group by zone), n as (select s_nationkey zone, count(*) filter (where s_acctbal>=5000) na, count(*) filter (where s_acctbal>=0 and s_acctbal<5000) ni, count(*) filter (where s_acctbal<0) nu from supplier group by 1), b as (select a.*, coalesce(na,0) na, coalesce(ni,0) ni, coalesce(nu,0) nu, least(greatest((upgraded-coverage)/greatest(1-coverage,1e-9),0),1) cl from a left join n using (zone)) select zone, round(cl,6) closure, case when coverage>=0.5 then 'served' when nu>0 and na=0 and ni=0 then 'unassessed_only' when cl>=0.25 then 'staffing' else 'no_facility' end gap_type, row_number() over (order by uncovered desc, zone) priority_rank from b"


@query(_GAP)
def gap_typology(spark, sf_dir):
    demand, supply = _sites(spark, sf_dir)
    near = spatial.nearest(demand, supply, 1, 60.0).select("i", geo.travel_minutes(F.sqrt("dist2"), 5.0).alias("minutes"))
    cover = spatial.coverage(demand, near, [0.5, 0.8])
    at = lambda t, c: F.max(F.when(F.col("threshold") == t, F.col(c)))
    wide = cover.groupBy("zone").agg(at(0.5, "fraction").alias("coverage"), at(0.8, "fraction").alias("upgraded"), at(0.5, "covered").alias("_c"))
    wide = wide.join(demand.groupBy("zone").agg(F.sum("pop").alias("_p")), "zone").withColumn("uncovered", F.col("_p") - F.col("_c"))
    b = F.col("s_acctbal")
    state = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("zone")).agg(F.count_if(b >= 5000).alias("n_adequate"), F.count_if((b >= 0) & (b < 5000)).alias("n_inadequate"), F.count_if(b < 0).alias("n_unassessed"))
    out = spatial.gap_types(wide.join(state, "zone", "left").na.fill(0, ["n_adequate", "n_inadequate", "n_unassessed"]))
    return out.select("zone", r(F.col("closure")).alias("closure"), "gap_type", F.col("priority_rank").cast("long").alias("priority_rank"))


_ROADS = "e as (select s_suppkey a, case when s_suppkey % 5 = 0 then -s_suppkey else s_suppkey // 2 end b, 1.0 + s_suppkey % 4 m from supplier)"


@query(f"with recursive {_ROADS}, u as (select a, b from e union select b, a from e), w(s, t) as (select a, a from u union select s, b from w join u on u.a = w.t) select cast(s as varchar) node, min(cast(t as varchar)) component from w group by s")
def road_components(spark, sf_dir):
    return spatial.components(_roads(spark, sf_dir))


def _roads(spark, sf_dir):
    n = F.col("s_suppkey")
    to = F.when(n % 5 == 0, -n).otherwise(F.floor(n / 2).cast("long"))
    return table(spark, sf_dir, "supplier").select(n.cast("string").alias("src"), to.cast("string").alias("dst"), (1.0 + n % 4).alias("minutes"))


@query(f"with recursive {_ROADS}, u as (select a, b, m from e union all select b, a, m from e), w(t, c, d) as (select 1::bigint, 0.0::double, 0 union select u.b, w.c+u.m, w.d+1 from w join u on u.a = w.t where w.d < 12) select cast(t as varchar) node, min(c) as \"minutes\" from w group by t")
def travel_time(spark, sf_dir):
    return spatial.travel_times(_roads(spark, sf_dir), spark.createDataFrame([("1", 0.0)], "node string, minutes double"))


@query("with o as (select row_number() over (order by o_orderkey) n, 1.0 + o_orderkey % 7 c from orders), s as (select n, coalesce(sum(c) over (order by n rows between unbounded preceding and 1 preceding), 0.0) f from o) select n node, cast(least(f, 5.0 + (select max(f) from s) - f) as double) \"minutes\" from s")
def road_way(spark, sf_dir):
    """All orders as the nodes of one long way, entered from both ends: rounds follow its logarithm."""
    orders = ordering.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "n")
    way = orders.select(F.col("n").alias("src"), (F.col("n") + 1).alias("dst"), (1.0 + F.col("o_orderkey") % 7).alias("minutes"))
    last = orders.agg(F.max("n").alias("n"))
    ends = spark.createDataFrame([(1, 0.0)], "node long, minutes double").unionByName(last.where("n is not null").select(F.col("n").alias("node"), F.lit(5.0).alias("minutes")))
    return spatial.travel_times(way.join(F.broadcast(last), way["dst"] <= last["n"]).select("src", "dst", "minutes"), ends)


@query(f"with g(zone, x0, y0, x1, y1) as (values {', '.join(str((z, 9000 * a, 9000 * b, 9000 * c, 9000 * d)) for z, a, b, c, d in _SQUARES)}), s as (select *, least(greatest(sqrt((x1-x0)*(y1-y0)/1e6/30)*1000, 700), 12000) s from g), a as (select zone, y0, y1, s, x0, x1, unnest(generate_series(0, cast(floor((x1-x0)/s) as bigint))) i from s), b as (select *, unnest(generate_series(0, cast(floor((y1-y0)/s) as bigint))) j from a) select zone, round(x0 + s*(i+0.5), 4) x, round(y0 + s*(j+0.5), 4) y from b where x0 + s*(i+0.5) < x1 and y0 + s*(j+0.5) < y1")
def demand_points(spark, sf_dir):
    rows = [(z, [(a * 9000, b * 9000), (c * 9000, b * 9000), (c * 9000, d * 9000), (a * 9000, d * 9000)], (c - a) * (d - b) * 81) for z, a, b, c, d in _SQUARES]
    points = spatial.demand_grid(spark.createDataFrame(rows, "zone int, ring array<struct<x:double,y:double>>, km2 double"))
    return points.select("zone", r(F.col("x"), 4).alias("x"), r(F.col("y"), 4).alias("y"))


# --- orders -----------------------------------------------------------------------------------

@query("select event_id, last_value(v ignore nulls) over (order by event_id rows between unbounded preceding and current row) filled from (select event_id, case when event_id % 7 = 0 then event_type end v from events) q")
def header_ffill(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.col("event_type")).alias("filled"))
    return ordering.filled_forward(e, ["event_id"], ["filled"])




@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_HH = "select o_orderkey hh, cast(o_orderkey % 1100 as int) structure, 10 + (o_orderkey % 200) / 100.0 lat, case when o_orderstatus = 'F' then 1 else 2 end result, cast(case when o_orderkey % 9 = 0 then null else o_custkey % 45 end as int) hh_size, o_orderkey % 3 obtained, case when o_orderkey % 3 = 1 then lpad(cast(480000 + o_orderkey % 1000 as varchar(9)), 6, '0') when o_orderkey % 30 = 0 then '480001' end serial, 480000 lo, 480899 hi, case when o_orderkey % 4 <> 0 then 1 end roster_gate, cast(o_custkey % 45 as int) + case when o_orderkey % 10 = 0 then 1 else 0 end n_roster, case when o_orderkey % 5 <> 0 then cast(o_orderkey % 500 as double) / 10 - 5 + case when o_orderkey % 50 = 1 then 0.05 else 0.0 end end temp from orders"


@query(f"""
with h as ({_HH}), v as (
  select hh, 'C-1.06' rule_id, 'structure' field, 'constraint' violation from h where not structure between 1 and 999
  union all select hh, 'C-1.11', 'lat', 'constraint' from h where not lat between 10.2 and 11.75
  union all select hh, 'C-3.01', 'hh_size', 'answered_but_skipped' from h where result <> 1 and hh_size is not null
  union all select hh, 'C-3.01', 'hh_size', 'missing' from h where result = 1 and hh_size is null
  union all select hh, 'C-3.01', 'hh_size', 'constraint' from h where result = 1 and not hh_size between 1 and 40
  union all select hh, 'C-3.01g', 'roster_gate', 'answered_but_skipped' from h where result <> 1 and roster_gate is not null
  union all select hh, 'C-3.01g', 'roster_gate', 'constraint' from h where result = 1 and roster_gate is not null and not coalesce(n_roster = hh_size, false)
  union all select hh, 'C-5.05', 'temp', 'answered_but_skipped' from h where obtained <> 1 and temp is not null
  union all select hh, 'C-5.05', 'temp', 'constraint' from h where obtained = 1 and temp is not null and not (temp between -5.0 and 40.0 and temp = round(temp, 1))
  union all select hh, 'C-5.03a', 'serial', 'answered_but_skipped' from h where obtained <> 1 and serial is not null
  union all select hh, 'C-5.03a', 'serial', 'missing' from h where obtained = 1 and serial is null
  union all select hh, 'C-5.03a', 'serial', 'constraint' from h where obtained = 1 and not (cast(serial as int) between lo and hi))
select rule_id, field, violation, count(*) n, min(hh) first_hh from v group by 1, 2, 3
""")
def rule_violations(spark, sf_dir):
    from fieldloom.operators.rules import HOUSEHOLD, violations

    k = F.col("o_orderkey")
    h = table(spark, sf_dir, "orders").select(
        k.alias("hh"), (k % 1100).cast("int").alias("structure"), (10 + (k % 200) / 100).alias("lat"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("result"),
        F.when(k % 9 != 0, (F.col("o_custkey") % 45).cast("int")).alias("hh_size"), (k % 3).alias("obtained"),
        F.when(k % 3 == 1, F.lpad((480000 + k % 1000).cast("string"), 6, "0")).when(k % 30 == 0, F.lit("480001")).alias("serial"), F.lit(480000).alias("lo"), F.lit(480899).alias("hi"),
        F.when(k % 4 != 0, 1).alias("roster_gate"), ((F.col("o_custkey") % 45).cast("int") + F.when(k % 10 == 0, 1).otherwise(0)).alias("n_roster"),
        F.when(k % 5 != 0, (k % 500).cast("double") / 10 - 5 + F.when(k % 50 == 1, 0.05).otherwise(0.0)).alias("temp"),
    )
    return violations(h, HOUSEHOLD, ["hh"]).groupBy("rule_id", "field", "violation").agg(F.count(F.lit(1)).alias("n"), F.min("hh").alias("first_hh"))


@query("with h as (select o_orderkey hh, o_orderkey % 7 + 1 hh_size from orders), p as (select l_orderkey hh, count(*) n, count(*) filter (where l_linenumber = 1) heads, count(l_partkey) s, count(distinct l_partkey) d from lineitem group by 1), j as (select h.hh, hh_size, coalesce(n,0) n, coalesce(heads,0) heads, coalesce(s,0) s, coalesce(d,0) d from h left join p using (hh)) select hh, n <> hh_size size_differs, heads <> 1 not_one_head, s <> d serial_repeats from j")
def roster_gates(spark, sf_dir):
    from fieldloom.operators.rules import roster_checks

    h = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hh"), (F.col("o_orderkey") % 7 + 1).alias("hh_size"))
    return roster_checks(h, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hh"), F.col("l_linenumber").alias("relation"), F.col("l_partkey").alias("serial")))


@query("with j as (select d.lang, d.source, l.quality, l.toxic from documents d left join labels l using (doc_id)) select lang, 'quality' \"column\", count(*) n, count(*) filter (where quality is null) missing, round(count(*) filter (where quality is null)*1.0/count(*), 6) share from j group by lang union all select lang, 'toxic', count(*), count(*) filter (where toxic is null), round(count(*) filter (where toxic is null)*1.0/count(*), 6) from j group by lang")
def missing_profile(spark, sf_dir):
    from fieldloom.operators.response import missing_profile as profile

    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return profile(rows, ["quality", "toxic"], ["lang"]).withColumn("share", r(F.col("share")))


@query()
def response_model(spark, sf_dir):
    from fieldloom.operators.response import response_model as model

    rows = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), "l_quantity", "l_discount", "l_linestatus")
    m = model(rows, "y", ["l_quantity", "l_discount"], ["l_linestatus"])
    return spark.createDataFrame([(float(m["mcfadden"]), float(m["lr_p"]), m["coefficients"])], "mcfadden double, lr_p double, coefficients array<double>")


_CLASS = "case when abs(v - a) <= abs(v - b) and abs(v - a) <= abs(v - c) then 1 when abs(v - b) <= abs(v - c) then 2 else 3 end"


@query(f"with recursive p as (select s_acctbal::double v from supplier), w(n, a, b, c) as (select 0, min(v), (min(v) + max(v)) / 2, max(v) from p union all select n + 1, coalesce(avg(v) filter (where k = 1), any_value(a)), coalesce(avg(v) filter (where k = 2), any_value(b)), coalesce(avg(v) filter (where k = 3), any_value(c)) from (select n, a, b, c, v, {_CLASS} k from w cross join p where n < 100) q group by n), e as (select * from w where n = 100) select {_CLASS} class, max(v) break from p cross join e group by 1")
def natural_breaks(spark, sf_dir):
    from fieldloom.operators.classify import natural_breaks as breaks

    return breaks(table(spark, sf_dir, "supplier"), "s_acctbal")


_RIVALS = """
with recursive s as (select c_custkey % 400 code, c_custkey ord, c_mktsegment d, c_custkey % 11 = 0 m, c_custkey % 3 = 0 a, row_number() over (partition by c_custkey % 400 order by c_custkey) rn from customer),
w as (select code, rn, ord, d, m, a, [ord][2:] lost, 'unique' why from s where rn = 1
  union all
  select code, rn, case when new then bo else ao end, case when new then bd else ad end, case when new then bm else am end, case when new then ba else aa end,
    case when why = 'conflict' then [ao, bo] when new then [ao] else [bo] end, why
  from (select *, why in ('conflict_transfer', 'conflict_authority') and case when bm <> am then bm else ba end new from (
    select s.code, s.rn, w.ord ao, w.d ad, w.m am, w.a aa, s.ord bo, s.d bd, s.m bm, s.a ba,
      case when s.d = w.d then 'duplicate' when s.m <> w.m then 'conflict_transfer' when s.a <> w.a then 'conflict_authority' else 'conflict' end why
    from w join s on s.code = w.code and s.rn = w.rn + 1) x) y),
l as (select code, unnest(lost) ord, rn, why from w), f as (select code, ord, arg_max(why, rn) why from l group by 1, 2)
select cast(s.code as varchar) code, s.ord, f.ord is null kept, coalesce(f.why, 'unique') outcome from s left join f on f.code = s.code and f.ord = s.ord
"""


@query(_RIVALS)
def adjudicate_dupes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = c.select((F.col("c_custkey") % 400).cast("string").alias("code"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("district"), F.when(F.col("c_custkey") % 11 == 0, "Transferred by gazette").alias("remark"), (F.col("c_custkey") % 3 == 0).alias("agrees"))
    return reconcile.adjudicate(rows)


@query("select cast(cast(ts as date) as varchar) \"day\", event_type, count(*) n from events group by 1, 2")
def stream_daily_counts(spark, sf_dir):
    """The streaming form run to the end of its input; the same rows as the batch form."""
    import uuid

    from fieldloom.streaming import daily_counts, from_folder, into_folder

    schema, path = table(spark, sf_dir, "events").schema, spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    files = spark.readStream.schema(schema)  # a stream reads folders, so a single file is picked by its name
    files = files.parquet(f"{sf_dir}/events.parquet") if folder else files.option("pathGlobFilter", "events.parquet").parquet(f"{sf_dir}/")
    counts = daily_counts(files.withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"])
    at = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    into_folder(counts, f"{at}/rows", f"{at}/checkpoint", "complete")
    return from_folder(spark, f"{at}/rows", counts.schema).select(F.col("day").cast("string").alias("day"), "event_type", "n")


# --- fieldwork ---------------------------------------------------------------------------------

_FLAG = "case when l_discount>=0.05 then 1.0 else 0.0 end"


@query(_SVY.format(rows=f"select 'A' domain, l_linestatus h, l_suppkey i, {_FLAG} y, l_quantity w from lineitem union all select 'B', l_linestatus, l_suppkey, {_FLAG}, l_quantity*100.0/k from lineitem join (select l_linestatus hh, count(distinct l_suppkey) k from lineitem where l_suppkey % 10 not in (3, 7) group by 1) on hh = l_linestatus where l_suppkey % 10 not in (3, 7)"))
def analysis_sets(spark, sf_dir):
    rows = _sample(spark, sf_dir, F.col("l_discount") >= 0.05).withColumn("who", F.col("i") % 10)
    both = fieldwork.analysis_sets(rows, spark.createDataFrame([(3,), (7,)], "who long"), 100, ["w"])
    return _estimates(survey.proportions(both.withColumnRenamed("analysis_set", "domain")))


@query("with a as (select o_orderkey, o_totalprice w, o_custkey % 3 h, o_custkey % 50 c, o_orderpriority s, case when o_orderstatus='F' then 1.0 else 0.0 end d, case when o_orderstatus='P' then 1.0 else 0.0 end e, case when o_orderstatus='O' and o_orderkey % 2 = 0 then 1.0 else 0.0 end n from orders), b as (select *, count(*) over (partition by c) cn, sum(d) over (partition by c) cd, sum(e) over (partition by c) ce, sum(n) over (partition by c) cx, count(*) over (partition by h, s) sn, sum(d) over (partition by h, s) sd, sum(e) over (partition by h, s) se from a) select o_orderkey, round(cast(w as double) * (cast((cn-ce) as double)/cast(cd as double)), 6) w_cluster, round(cast(w as double) * (cast((sn-se) as double)/cast(sd as double)), 6) w_cell, round(cast(w as double) * (cast(cn as double)/cast(cd as double)), 6) w_vacant, round(cast(w as double) * (cast((cn-ce-cx) as double)/cast(cd as double)), 6) w_no_contact from b where d = 1")
def alternative_weights(spark, sf_dir):
    o, status = table(spark, sf_dir, "orders"), F.col("o_orderstatus")
    homes = o.select("o_orderkey", (F.col("o_custkey") % 3).alias("h"), (F.col("o_custkey") % 50).alias("cluster"), F.col("o_orderpriority").alias("settlement"), F.col("o_totalprice").alias("w"), (status == "F").alias("completed"), (status == "P").alias("ineligible"), ((status == "O") & (F.col("o_orderkey") % 2 == 0)).alias("no_contact"))
    names = ("w_cluster", "w_cell", "w_vacant", "w_no_contact")
    return fieldwork.alternative_weights(homes).where("completed").select("o_orderkey", *[r(F.col(c)).alias(c) for c in names])


_EVIDENCE = f"select unnest(['National', 'stratum='||h])||'|'||q domain, h, i, y, w from (select q.q, h, i, w, case q.q when 'card_seen' then c when 'documented' then c*y when 'headline' then y when 'card_confirmed_of_cards' then case when c=1 then y end else case when c=0 then y end end y from (select l_linestatus h, l_suppkey i, l_quantity w, {_FLAG} y, case when l_linenumber % 2 = 0 then 1.0 else 0.0 end c from lineitem) cross join (values ('card_seen'), ('documented'), ('headline'), ('card_confirmed_of_cards'), ('recalled_of_no_cards')) q(q)) where y is not null"


@query(_SVY.format(rows=_EVIDENCE))
def evidence_decomposition(spark, sf_dir):
    kids = table(spark, sf_dir, "lineitem").select((F.col("l_discount") >= 0.05).cast("double").alias("y"), (F.col("l_linenumber") % 2 == 0).alias("card"), F.col("l_quantity").alias("w"), F.col("l_linestatus").alias("h"), F.col("l_suppkey").alias("i"))
    return _estimates(survey.proportions(fieldwork.evidence(kids)))


def _field_tables(spark, sf_dir):
    o, li, e = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "events"))
    homes = o.select((F.col("o_custkey") % 20).alias("who"), (F.col("o_custkey") % 50).alias("cluster"), F.col("o_orderkey").alias("household"), (F.col("o_orderstatus") == "F").alias("completed"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("minutes"), (F.col("o_orderkey") % 4).alias("n_children"), (F.col("o_orderdate") >= F.lit("1994-01-01").cast("timestamp")).alias("in_window"))
    kids = li.select((F.col("l_orderkey") % 20).alias("who"), (F.col("l_suppkey")).alias("cluster"), F.col("l_orderkey").alias("household"), (F.col("l_quantity") >= 3).cast("double").alias("y"), (F.col("l_returnflag") == "N").alias("card"))
    log = e.select((F.col("user_id") % 20).alias("who"), F.col("event_id").alias("day"), (F.col("event_id") % 24).alias("attempted"), (F.col("event_id") % 41 + 0).alias("clusters")).withColumn("clusters", F.when(F.col("clusters") == 40, 2).otherwise(1))
    return homes, kids, log


_FIELD = "h as (select o_custkey % 20 who, o_custkey % 50 cluster, o_orderkey household, o_orderstatus = 'F' completed, cast(floor(o_totalprice/10000) as double) as minutes, o_orderkey % 4 n_children, o_orderdate >= timestamp '1994-01-01' in_window from orders), c as (select l_orderkey % 20 who, l_suppkey cluster, l_orderkey household, case when l_quantity >= 3 then 1.0 else 0.0 end y, l_returnflag = 'N' card from lineitem), f as (select user_id % 20 who, event_id as \"day\", event_id % 24 attempted, case when event_id % 41 = 40 then 2 else 1 end clusters from events)"
_ZED = "(t.{0} - (select median({0}) from t)) / nullif(1.4826 * (select median(abs({0} - m)) from t cross join (select median({0}) m from t)), 0)"


@query(f"with {_FIELD}, hh as (select who, count(distinct cluster) n_clusters, count(*) n_households, count(*) filter (where completed) dn, avg(case when completed then 1.0 else 0.0 end) completion, median(case when completed then minutes end) median_minutes, avg(case when completed then minutes end) mean_minutes, stddev_samp(case when completed then minutes end) sd_minutes from h group by who), cc as (select who, count(*) n_children, avg(case when card then 1.0 else 0.0 end) card_rate, avg(y) coverage from c group by who), ff as (select who, count(distinct \"day\") as days, max(attempted) most_households, max(clusters) most_clusters from f group by who), t as (select cc.*, hh.* exclude (who), ff.* exclude (who) from cc left join hh using (who) left join ff using (who)) select who, n_children, n_clusters, n_households, days, most_households, cast(most_clusters as bigint) most_clusters, round(card_rate, 5) card_rate, round(coverage, 5) coverage, round(completion, 5) completion, round(median_minutes, 5) median_minutes, round(mean_minutes, 5) mean_minutes, round(sd_minutes, 5) sd_minutes, round(cast(n_children as double) / greatest(dn, 1), 5) per_household, round({_ZED.format('coverage')}, 3) z_coverage, round({_ZED.format('median_minutes')}, 3) z_median_minutes, round({_ZED.format('card_rate')}, 3) z_card_rate, round({_ZED.format('completion')}, 3) z_completion from t")
def interviewer_table(spark, sf_dir):
    out = fieldwork.interviewers(*_field_tables(spark, sf_dir))
    rounded = [r(F.col(c), 5).alias(c) for c in ("card_rate", "coverage", "completion", "median_minutes", "mean_minutes", "sd_minutes", "per_household")]
    zs = [r(F.col(c), 3).alias(c) for c in ("z_coverage", "z_median_minutes", "z_card_rate", "z_completion")]
    return out.select("who", "n_children", "n_clusters", "n_households", "days", "most_households", F.col("most_clusters").cast("long").alias("most_clusters"), *rounded, *zs)


def _pattern(name: str, source: str, hit: str, what: str = "'-'") -> str:
    listed = f"coalesce((select string_agg(x, ', ' order by x) from (select distinct cast({what} as varchar) x from {source} where {hit})), '')" if what != "'-'" else "'-'"
    return f"select '{name}' pattern, count(*) filter (where {hit}) n, count(*) \"of\", round(100.0 * count(*) filter (where {hit}) / nullif(count(*), 0), 6) share, {listed} found from {source}"


_PATTERNS = (
    _pattern("short_interview_with_children", "(select * from h where completed and n_children > 0) q", "minutes < 5", "who"),
    _pattern("cluster_without_variation", "(select cluster, min(y) least from c group by 1) q", "least = 1", "cluster"),
    _pattern("household_all_vaccinated", "(select household, min(y) least from c group by 1 having count(*) >= 2) q", "least = 1"),
    _pattern("over_20_households_a_day", "f", "attempted > 20", "who||' '||\"day\""), _pattern("several_clusters_a_day", "f", "clusters > 1", "who||' '||\"day\""),
    _pattern("outside_fieldwork_window", "(select * from h where completed) q", "not in_window", "who"), _pattern("completed_without_children", "(select * from h where completed) q", "n_children = 0"),
)


@query(f"with {_FIELD} {' union all '.join(_PATTERNS)}")
def pattern_report(spark, sf_dir):
    return fieldwork.patterns(*_field_tables(spark, sf_dir)).withColumn("share", r(F.col("share")))


@query("with f as (select c_nationkey h, c_custkey % 97 + 3 size, sum(c_custkey % 97 + 3) over (partition by c_nationkey) total, c_custkey % 10 = 0 sel, count(*) filter (where c_custkey % 10 = 0) over (partition by c_nationkey) n, c_custkey from customer), s as (select *, cast(n*size as double)/cast(total as double) + case when c_custkey % 30 = 0 then 0.01 else 0 end p1 from f where sel) select 'clusters_per_stratum' \"check\", count(distinct h) filter (where n <> 6) n_affected from s union all select 'selection_probability', count(*) filter (where abs(cast(n*size as double)/cast(total as double) - p1) > 1e-6) from s union all select 'stratum_totals', cast(0 as bigint)")
def selection_checks(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cluster"), F.col("c_nationkey").alias("h"), (F.col("c_custkey") % 97 + 3).alias("size"), (F.col("c_custkey") % 10 == 0).alias("selected"))
    per = c.groupBy("h").agg(F.sum("size").alias("stratum_size"), F.count_if("selected").alias("taken"))
    frame = c.join(per, "h").withColumn("p1", F.col("taken") * F.col("size") / F.col("stratum_size") + F.when(F.col("cluster") % 30 == 0, 0.01).otherwise(0))
    return fieldwork.selection_checks(frame, 6).drop("detail")


@query("with c as (select l_orderkey household, l_returnflag <> 'N' card, case when l_linenumber % 5 <> 0 and l_returnflag <> 'N' then 1 end a, case when l_linenumber % 3 = 0 then 1 end b from lineitem), h as (select o_orderkey household, o_orderstatus = 'F' completed, o_orderkey % 7 stated from orders where o_orderkey % 11 <> 0), n as (select household, count(*) n from c group by 1) select 'both_sources' \"check\", count(*) filter (where a is not null and b is not null) n_affected from c union all select 'card_answer_without_card', count(*) filter (where not card and a is not null) from c union all select 'recall_despite_card', count(*) filter (where card and b is not null) from c union all select 'status_missing', count(*) filter (where a is null and b is null) from c union all select 'roster_differs', count(*) filter (where completed and coalesce(n, 0) <> stated) from h left join n using (household) union all select 'child_without_household', count(*) from c where household not in (select household from h)")
def interview_checks(spark, sf_dir):
    card = F.col("l_returnflag") != "N"
    kids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("household"), card.alias("card"), F.when((F.col("l_linenumber") % 5 != 0) & card, 1).alias("on_card"), F.when(F.col("l_linenumber") % 3 == 0, 1).alias("recalled"))
    homes = table(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("household"), (F.col("o_orderstatus") == "F").alias("completed"), (F.col("o_orderkey") % 7).alias("stated"))
    return fieldwork.interview_checks(kids, homes)


@query("with a as (select distinct user_id, cast(ts as date) d from events where event_id % 2 = 0), b as (select distinct user_id, cast(ts as date) d from events where event_id % 2 = 1) select user_id, cast(d as varchar) \"day\", 'left' side from (select * from a except select * from b) union all select user_id, cast(d as varchar), 'right' from (select * from b except select * from a)")
def unmatched_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date(F.col("ts").cast("timestamp")).cast("string").alias("day"))
    return fieldwork.unmatched_pairs(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "day"])


@query("select case when p_size > 8 and p_size <= 11 then '9-11' when p_size > 11 and p_size <= 23 then '12-23' when p_size > 23 and p_size <= 35 then '24-35' when p_size > 35 and p_size <= 47 then '36-47' when p_size > 47 and p_size <= 59 then '48-59' end age_class, count(*) n from part group by 1")
def age_classes(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(fieldwork.age_class(F.col("p_size")).alias("age_class")).agg(F.count(F.lit(1)).alias("n"))


@query("with d as (select count(*) n, count(*) filter (where l.doc_id is null) unlabelled, cast(avg(case when l.quality = 0 then 100.0 when l.quality = 1 then 0.0 end) as double) low from documents d left join labels l using (doc_id)) select 'labels_missing' flag, 'material' severity, printf('%d of %d documents have no label', unlabelled, n) evidence, 'labelling' fixable_by from d where unlabelled > 0 union all select 'low_quality', 'minor', printf('%.2f %% of labels are low', low), 'screening' from d where low > 5")
def quality_flags(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").withColumn("has", F.lit(True)), "doc_id", "left")
    one = joined.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("has").isNull()).alias("unlabelled"), F.avg(F.when(F.col("quality") == 0, 100.0).when(F.col("quality") == 1, 0.0)).alias("low"))
    return fieldwork.flags(one, [("labels_missing", "material", "unlabelled > 0", "%d of %d documents have no label|unlabelled|n", "labelling"), ("low_quality", "minor", "low > 5", "%.2f %% of labels are low|low", "screening"), ("no_documents", "critical", "n = 0", "the table is empty", "source")])


# --- transfers ---------------------------------------------------------------------------------

_BOXES = tuple((z, 100 * a, 100 * b, 100 * c, 100 * d) for z, a, b, c, d in _SQUARES)


@query(f"with s as (select s_suppkey id, (s_suppkey*7919)%1009*1.0 x, (s_suppkey*104729)%1013*1.0 y from supplier), g(zone, x0, y0, x1, y1) as (values {', '.join(str(b) for b in _BOXES)}), d as (select id, zone, sqrt(power(greatest(x0-x, x-x1, 0), 2) + power(greatest(y0-y, y-y1, 0), 2)) d from s cross join g), n as (select id, zone, d, row_number() over (partition by id order by d, zone) r from d) select id, zone, round(d, 6) distance, 'resolved_review' outcome, 0.7 confidence from n where r = 1 and d > 0")
def snap_outside(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 7919) % 1009).cast("double").alias("x"), ((F.col("s_suppkey") * 104729) % 1013).cast("double").alias("y"))
    zones = spark.createDataFrame([(z, [(a, b), (c, b), (c, d), (a, d)]) for z, a, b, c, d in _BOXES], "zone int, ring array<struct<x:double,y:double>>")
    held = spatial.polygon_join(s, zones, 200.0).select("id").distinct()
    return transfer.snapped(s.join(held, "id", "left_anti"), zones, 100.0).withColumn("distance", r(F.col("distance")))


@query(f"with s as (select s_nationkey % 4 k, (s_suppkey*7919)%1009*1.0 x, (s_suppkey*104729)%1013*1.0 y from supplier), g(zone, x0, y0, x1, y1) as (values {', '.join(str(b) for b in _BOXES)}) select zone, round(cast(sum(case k when 0 then 3 when 1 then 2 when 2 then 1 else 0 end) as double)/count(*), 6) score, count(*) n from s join g on x between x0 and x1 and y between y0 and y1 group by zone")
def access_score(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 4).cast("string").alias("k"), ((F.col("s_suppkey") * 7919) % 1009).cast("double").alias("x"), ((F.col("s_suppkey") * 104729) % 1013).cast("double").alias("y"))
    zones = spark.createDataFrame([(z, [(a, b), (c, b), (c, d)]) for z, a, b, c, d in _BOXES], "zone int, ring array<struct<x:double,y:double>>")
    return transfer.category_score(transfer.box_join(s, zones, 200.0), ["zone"], "k", {"0": 3, "1": 2, "2": 1}).withColumn("score", r(F.col("score")))


@query("with l as (select c_nationkey, c_name, c_mktsegment, row_number() over (partition by c_nationkey order by c_custkey desc) r from customer) select n_nationkey, n_name, c_name, c_mktsegment from nation left join l on c_nationkey = n_nationkey and r = 1")
def attribute_transfer(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "customer")
    return transfer.transferred(n, c.withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey", ["c_name", "c_mktsegment"], "c_custkey")


@query("with a as (select c_custkey k, c_custkey * 10.0 v, case when c_custkey % 5 = 0 then null when c_custkey % 7 = 0 then c_custkey * 10.0 + 3 else c_custkey * 10.0 end o from customer) select cast(k as varchar) entity_id, 'people' field, cast(cast(o as bigint) as varchar) raw_value, cast(cast(v as bigint) as varchar) resolved_value, 'prefer_complete_source' \"method\", case when o is null then 1.0 else 0.9 end confidence, case when o is null then 'resolved' else 'resolved_review' end outcome from a where o is null or o <> v")
def preferred_source(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 10).alias("people"))
    other = c.where("c_custkey % 5 <> 0").withColumn("people", F.when(F.col("c_custkey") % 7 == 0, F.col("people") + 3).otherwise(F.col("people")))
    return transfer.preferred(c, other, "c_custkey", "people")[1]


@query("select cast(p_size as varchar) code, 'repeated' problem from part where p_size < 99 group by 1 having count(*) > 1 union all select distinct cast(p_size as varchar), 'reserved' from part where p_size in (46, 48, 49)")
def lookup_problems(spark, sf_dir):
    return transfer.lookup_problems(table(spark, sf_dir, "part").select(F.col("p_size").alias("code")), ("46", "48", "49"))




@query("with p as (select l_orderkey k, count(*) n, count(*) filter (where l_returnflag = 'R') back, count(distinct l_linenumber) lines from lineitem group by 1), h as (select o_orderkey, o_orderstatus s, o_orderpriority p, cast(o_orderdate as date) d, coalesce(n, 0) n, coalesce(back, 0) back from orders left join p on k = o_orderkey) select o_orderkey, 'size' field, 'constraint' enforcement, 'constraint' violation from h where not (n >= 1 and n <= 5) union all select o_orderkey, 'returns', 'gate', 'answered_but_skipped' from h where s <> 'F' and back > 0 union all select o_orderkey, 'returns', 'gate', 'missing' from h where s = 'F' and back = 0 union all select o_orderkey, 'returns', 'gate', 'constraint' from h where s = 'F' and back > 2 union all select o_orderkey, 'day', 'constraint', 'constraint' from h where not (d >= date '1993-01-01' and d <= date '1997-06-30')")
def form_rules(spark, sf_dir):
    """A form's rules over orders as submissions with their lines as a repeat."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"))).alias("roster"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.to_date(F.col("o_orderdate")).cast("string").alias("day"))
    repeats = {"roster": ["line", "flag"]}
    form = [
        forms.Bind("/data/size", "int", ". >= 1 and . <= 5", calculate="count(${line})"), forms.Bind("/data/returns", "int", ". <= 2", "${status} = 'F'", "true()", "if(count(${flag}[. = 'R']) > 0, count(${flag}[. = 'R']), '')"),
        forms.Bind("/data/day", "date", ". >= date('1993-01-01') and . <= date('1997-06-30')"),
    ]
    known = forms.derived(o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left"), form, repeats)
    return forms.violations(known, form, ["o_orderkey"], repeats)


@query()
def planted_fabricator(spark, sf_dir):
    """The screen over made-up submissions as it stood after each of the first three days."""
    from functools import reduce

    from fieldloom.sources.synthetic import submissions

    made = submissions(spark)
    days = [quality.daily_screen(made, f"2026-06-0{d}", least=3).select(F.lit(f"2026-06-0{d}").alias("as_of"), "who", "n", "reasons", "verdict") for d in (1, 2, 3)]
    return reduce(DataFrame.unionByName, days).where("verdict <> 'OK'")


@query("with m as (select n_nationkey, n_regionkey from nation), k as (select c_nationkey, row_number() over (order by count(*) desc, c_nationkey) rk from customer where c_nationkey <> 3 group by 1) select 'layer_keys_repeat' \"check\", cast(0 as bigint) n_affected, 'PASS' verdict union all select 'metric_keys_repeat', 0, 'PASS' union all select 'layer_unmatched', (select count(*) from m where n_nationkey not in (select c_nationkey from k)), case when exists (select 1 from m where n_nationkey not in (select c_nationkey from k)) then 'FAIL' else 'PASS' end union all select 'metrics_unmatched', 0, 'PASS' union all select 'ranks_repeat', 0, 'PASS' union all select 'rows_lost_or_gained', 0, 'PASS'")
def layer_checks(spark, sf_dir):
    per = table(spark, sf_dir, "customer").where("c_nationkey <> 3").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return quality.layer_checks(table(spark, sf_dir, "nation"), ordering.numbered(per, [F.desc("n"), "n_nationkey"], "rank"), "n_nationkey", "rank")


from fieldloom.plans import expressions, formats, measures  # noqa: E402,F401  they register their queries
