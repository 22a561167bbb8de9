"""Data quality: constraints that tables do not enforce, gates that label, screens that compare."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions.numeric import chi2_tail
from fieldloom.operators.ordering import group_quantile


@dataclass(frozen=True)
class Constraint:
    """kind: not_null, primary_key, unique, check (an SQL predicate that null passes) or foreign_key."""

    name: str
    table: str
    kind: str
    columns: tuple[str, ...] = ()
    predicate: str = ""
    parent: str = ""
    parent_columns: tuple[str, ...] = ()

    def violations(self, tables: dict[str, DataFrame]) -> DataFrame:
        """The offending keys or rows."""
        df = tables[self.table]
        if self.kind == "not_null":
            return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in self.columns]))
        if self.kind in ("primary_key", "unique"):
            many = df.groupBy(*self.columns).agg(F.count(F.lit(1)).alias("n"))
            null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in self.columns])
            return many.where((F.col("n") > 1) & ~null if self.kind == "unique" else (F.col("n") > 1) | null)
        if self.kind == "check":
            return df.where(~F.coalesce(F.expr(self.predicate), F.lit(True)))
        parent = tables[self.parent].select(*[F.col(p).alias(c) for p, c in zip(self.parent_columns, self.columns)]).distinct()
        given = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.columns])
        return df.where(given).join(parent, list(self.columns), "left_anti")

    def ddl(self) -> str:
        """The same rule for an engine that enforces it."""
        head = f"ALTER TABLE {self.table} "
        names = ", ".join(self.columns)
        if self.kind == "not_null":
            return "\n".join(f"{head}ALTER COLUMN {c} SET NOT NULL;" for c in self.columns)
        body = {"primary_key": f"PRIMARY KEY ({names})", "unique": f"UNIQUE ({names})", "check": f"CHECK ({self.predicate})"}.get(self.kind)
        return f"{head}ADD CONSTRAINT {self.name} {body or f'FOREIGN KEY ({names}) REFERENCES {self.parent} ({", ".join(self.parent_columns)})'};"


class ViolationError(ValueError):
    pass


@dataclass
class Catalogue:
    constraints: list[Constraint] = field(default_factory=list)

    def report(self, tables: dict[str, DataFrame]) -> DataFrame:
        """A row per constraint: name, table_name, kind, violations."""
        rows = [c.violations(tables).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(c.name).alias("name"), F.lit(c.table).alias("table_name"), F.lit(c.kind).alias("kind"), "violations") for c in self.constraints]
        return reduce(DataFrame.unionByName, rows)

    def enforce(self, tables: dict[str, DataFrame]) -> None:
        broken = self.report(tables).where("violations > 0").collect()
        if broken:
            raise ViolationError("; ".join(f"{r.name}: {r.violations}" for r in broken))

    def load_order(self) -> list[str]:
        """Parents before children."""
        names = sorted({c.table for c in self.constraints} | {c.parent for c in self.constraints if c.parent})
        needs = {n: {c.parent for c in self.constraints if c.table == n and c.kind == "foreign_key" and c.parent != n} for n in names}
        out: list[str] = []
        while needs:
            free = sorted(n for n, p in needs.items() if p <= set(out))
            if not free:
                raise ViolationError("foreign keys form a cycle")
            out += free
            needs = {n: p for n, p in needs.items() if n not in free}
        return out


def gate(rows: DataFrame, rules: dict[str, Column], strict: bool = False) -> DataFrame:
    """Labels, never drops: a boolean per rule (true: broken), valid, and the first broken rule as `gate`.

    A rule that is null leaves the row out of valid but labels it PASS, or UNEVALUABLE if strict.
    """
    out = rows
    for name, rule in rules.items():
        out = out.withColumn(name, rule)
    broken = reduce(lambda a, b: a | b, [F.col(n) for n in rules])
    first = reduce(lambda acc, n: acc.when(F.col(n), n), list(rules)[1:], F.when(F.col(next(iter(rules))), next(iter(rules))))
    first = first.when(broken.isNull(), "UNEVALUABLE") if strict else first
    return out.withColumn("valid", F.coalesce(~broken, F.lit(False))).withColumn("gate", first.otherwise("PASS"))


AGE_INDICES = (
    "n long, residue_index double, anchor_index double, chi2 double, chi2_p double, dissimilarity double,"
    " n_at_end long, end_excess double, n_below long, n_above long"
)


def overlaps(rows: DataFrame, gap_minutes: float) -> DataFrame:
    """rows(who, start, end, id): those that begin less than gap_minutes after the one before ended."""
    by = Window.partitionBy("who").orderBy("start", "id")
    gap = (F.unix_micros(F.col("start").cast("timestamp")) - F.unix_micros(F.lag("end").over(by).cast("timestamp"))) / 6e7
    return rows.withColumn("gap", gap).where(F.col("gap") < gap_minutes)


def enumerator_screen(rows: DataFrame, duration: float = 15, cards: float = 0.3, volume: float = 8, least: int = 5, same_point: int = 3, specimens: float = 0.4) -> DataFrame:
    """rows(who, day, minutes, modules, cards, eligible, specimens, lat, lon, overlap) -> a verdict and reasons per enumerator."""
    points = rows.groupBy("who", F.bround("lat", 4).alias("_a"), F.bround("lon", 4).alias("_b")).agg(F.count(F.lit(1)).alias("_n")).groupBy("who").agg(F.max("_n").alias("same_point"))
    per = rows.groupBy("who").agg(
        F.count(F.lit(1)).alias("n"), F.percentile(F.when(F.col("minutes") > 0, F.col("minutes")), F.lit(0.5)).alias("median_minutes"),
        F.sum("modules").alias("modules"), F.try_divide(F.sum("cards"), F.sum("modules")).alias("card_rate"),
        F.sum("eligible").alias("eligible"), F.try_divide(F.sum("specimens"), F.sum("eligible")).alias("specimen_rate"),
        (F.count(F.lit(1)) / F.greatest(F.count_distinct("day"), F.lit(1))).alias("per_day"), F.sum(F.col("overlap").cast("int")).alias("overlaps"),
    ).where(F.col("n") >= least).join(points, "who")
    quick, no_cards, still = F.col("median_minutes") < duration, (F.col("card_rate") < cards) & (F.col("modules") >= 5), F.col("same_point") >= same_point
    found = {"too_quick": quick, "few_cards": no_cards, "volume": F.col("per_day") >= volume, "never_moved": still, "overlaps": F.col("overlaps") > 0, "few_specimens": (F.col("specimen_rate") < specimens) & (F.col("eligible") >= 5)}
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in found.items()]))
    urgent = F.coalesce(quick & (F.coalesce(no_cards, F.lit(False)) | still), F.lit(False))
    return per.withColumn("reasons", F.array_join(reasons, ",")).withColumn("verdict", F.when(urgent, "INVESTIGATE").when(F.size(reasons) > 0, "REVIEW").otherwise("OK"))


def digit_preference(values: DataFrame, column: str, base: int = 10) -> DataFrame:
    """Counts of the last digit over the whole domain, and the chi-squared against equal shares."""
    spark: SparkSession = values.sparkSession
    digit = F.pmod(F.floor(F.col(column)).cast("long"), F.lit(base)).cast("long")
    counts = values.where(F.col(column).isNotNull()).groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
    full = spark.range(base).withColumnRenamed("id", "digit").join(counts, "digit", "left").select("digit", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    total = full.agg(F.sum("n").cast("double").alias("_t"))
    expected = F.col("_t") / base
    return full.crossJoin(F.broadcast(total)).select("digit", "n", F.try_divide("n", "_t").alias("share"), F.try_divide((F.col("n") - expected) * (F.col("n") - expected), expected).alias("chi2_part"))


def age_heaping(children: DataFrame, low: int = 9, high: int = 59, anchors: tuple[int, ...] = (12, 24, 36, 48)) -> DataFrame:
    """children(age in months) -> one row of indices: by remainder, at whole years, against equal shares, against a smooth curve, at the upper end.

    Only counts per month leave the table; the indices come from those few numbers.
    """
    counts = {int(r.age): r.n for r in children.where(F.col("age").isNotNull()).groupBy(F.col("age").cast("long").alias("age")).agg(F.count(F.lit(1)).alias("n")).where(F.col("age").between(low - 1200, high + 1200)).collect()}
    seen = np.array([counts.get(a, 0) for a in range(low, high + 1)], float)
    n, months = seen.sum(), high - low + 1
    if not n:
        return children.sparkSession.createDataFrame([], AGE_INDICES)
    parts = np.array([sum(c for a, c in counts.items() if low <= a <= high and a % 12 == r) for r in range(12)]) / n
    held = [a for a in anchors if low <= a <= high]
    at = sum(counts.get(a, 0) for a in held)
    chi2 = float(((seen - n / months) ** 2 / (n / months)).sum())
    smooth = np.array([np.median(seen[max(0, k - 2) : k + 3]) for k in range(months)])
    apart = float(np.abs(seen / n - smooth / smooth.sum()).sum() / 2) if smooth.sum() else None
    beside = float(seen[-6:-2].mean())
    row = (
        int(n), float(np.abs(100 * parts - 100 / 12).sum() / 2), float(at / (n * len(held) / months)) if held else None, chi2, chi2_tail(chi2, months - 1), apart,
        int(seen[-1]), float(seen[-1] / beside) if beside else None, sum(c for a, c in counts.items() if a < low), sum(c for a, c in counts.items() if a > high),
    )
    return children.sparkSession.createDataFrame([row], AGE_INDICES)


def robust_zs(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with a column per name of columns(name -> column): how far it is from the median in scaled median absolute deviations.

    All medians come from one aggregation and all deviations from another, which suits tables of a row per
    interviewer; null where the deviation is 0.
    """
    middle = rows.agg(*[F.percentile(c, F.lit(0.5)).alias(f"_m_{n}") for n, c in columns.items()])
    off = rows.crossJoin(F.broadcast(middle))
    spread = off.agg(*[F.percentile(F.abs(F.col(c) - F.col(f"_m_{n}")), F.lit(0.5)).alias(f"_d_{n}") for n, c in columns.items()])
    both = off.crossJoin(F.broadcast(spread))
    z = {n: F.when(F.col(f"_d_{n}") > 0, (F.col(c) - F.col(f"_m_{n}")) / (1.4826 * F.col(f"_d_{n}"))) for n, c in columns.items()}
    return both.withColumns(z).drop(*[f"_{k}_{n}" for n in columns for k in "md"])


def robust_z(rows: DataFrame, column: str) -> DataFrame:
    """rows with z, the robust distance of one column of a table of any size: both medians come from ranges, not from one task."""
    whole = [F.col(column).cast("double").alias("_v")]
    middle = group_quantile(rows.select(*whole), [], "_v", 0.5, "_m")
    off = F.abs(F.col("_v") - F.col("_m")).alias("_o")
    spread = group_quantile(rows.select(*whole).crossJoin(F.broadcast(middle)).select(off), [], "_o", 0.5, "_d")
    both = rows.crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(spread))  # one row each
    return both.withColumn("z", F.when(F.col("_d") > 0, (F.col(column) - F.col("_m")) / (1.4826 * F.col("_d")))).drop("_m", "_d")


def daily_screen(rows: DataFrame, as_of: str, gap_minutes: float = 2, **limits: float) -> DataFrame:
    """The enumerator screen over submissions(who, day, start, end, id, ...) up to a day, as it runs each evening."""
    known = rows.where(F.col("day") <= F.lit(as_of).cast("date"))
    by = Window.partitionBy("who").orderBy("start", "id")
    gap = (F.unix_micros("start") - F.unix_micros(F.lag("end").over(by))) / 6e7
    return enumerator_screen(known.withColumn("overlap", F.coalesce(gap < gap_minutes, F.lit(False))), **limits)


def exportable(rows: DataFrame, consent: str, columns: list[str], yes: str = "1") -> DataFrame:
    """Only who agreed, and only the columns that the receiver needs."""
    return rows.where(F.col(consent).cast("string") == yes).select(*columns)


def layer_checks(layer: DataFrame, metrics: DataFrame, key: str, rank: str) -> DataFrame:
    """(check, n_affected, verdict) for a ranked layer joined to its metrics: keys once on both sides, all met, ranks once, rows kept."""
    repeated = lambda df, c: df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    a, b = layer.select(key).distinct(), metrics.select(key).distinct()
    joined = layer.select(key).join(metrics.select(key, rank), key, "left")
    kept = layer.agg(F.count(F.lit(1)).alias("x")).crossJoin(joined.agg(F.count(F.lit(1)).alias("y"))).select(F.abs(F.col("x") - F.col("y")).alias("n"))  # one row each
    found = {
        "layer_keys_repeat": repeated(layer, key), "metric_keys_repeat": repeated(metrics, key), "layer_unmatched": a.join(b, key, "left_anti").agg(F.count(F.lit(1)).alias("n")),
        "metrics_unmatched": b.join(a, key, "left_anti").agg(F.count(F.lit(1)).alias("n")), "ranks_repeat": repeated(metrics, rank), "rows_lost_or_gained": kept,
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("check"), F.col("n").alias("n_affected"), F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("verdict")) for k, df in found.items()])


#: Types of another engine's columns; types not named are text.
DDL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE PRECISION", "float": "REAL", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMPTZ", "binary": "BYTEA"}


def schema_ddl(tables: dict[str, DataFrame], catalogue: Catalogue, geometry: dict[str, tuple[str, str, int]] | None = None) -> str:
    """Statements that make the tables with their constraints in an engine that enforces them, parents first.

    geometry names a table's geometry column, its kind and reference system; it gets a spatial index.
    """
    order = [*[t for t in catalogue.load_order() if t in tables], *sorted(t for t in tables if t not in catalogue.load_order())]
    out = []
    for t in order:
        g = (geometry or {}).get(t)
        columns = [f"    {n} " + (f"geometry({g[1]}, {g[2]})" if g and n == g[0] else DDL_TYPES.get(kind, f"NUMERIC{kind[7:]}" if kind.startswith("decimal") else "TEXT")) for n, kind in tables[t].dtypes]
        out.append(f"CREATE TABLE {t} (\n" + ",\n".join(columns) + "\n);")
        out += [c.ddl() for c in catalogue.constraints if c.table == t]
        if g:
            out.append(f"CREATE INDEX {t}_{g[0]}_gist ON {t} USING GIST ({g[0]});")
        out += [f"CREATE INDEX {t}_{'_'.join(c.columns)}_idx ON {t} ({', '.join(c.columns)});" for c in catalogue.constraints if c.table == t and c.kind == "foreign_key"]
    return "\n".join(out) + "\n"
