"""Form definitions as plans: expressions of a form's binds compiled to columns, then checked over submissions.

The expression language is the XPath subset that survey forms use. It has no null: an unanswered
question is the empty string, which as a number equals nothing. So every compiled condition is true
or false. References are `${name}` or a path, whose last step is the name; `.` is the value under
test. Repeats are array<struct> columns of a submission, lookups are tables by file name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.ordering import first_per_key, small

_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<string>'[^']*'|"[^"]*")|(?P<ref>\$\{[^}]+\})"""
    r"""|(?P<path>current\(\)/\.|(?:\.\.)?/[A-Za-z_][\w./-]*)|(?P<op><=|>=|!=|[-=<>+*()\[\],])|(?P<dots>\.\.|\.)"""
    r"""|(?P<name>[A-Za-z_][\w-]*))"""
)


class FormError(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormError(f"cannot read {text[at:at + 20]!r} in {text!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


@dataclass
class Value:
    """A compiled part: its column and whether that is a number, a string, a condition or an answer."""

    col: Column
    kind: str

    def number(self) -> Column:
        if self.kind == "bool":
            return self.col.cast("double")
        if self.kind == "num":
            return self.col
        text = F.btrim(self.col.cast("string"))
        return F.coalesce(text.try_cast("double"), F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), _days(text)))

    def string(self) -> Column:
        if self.kind == "num":  # whole numbers are written without a point
            return F.when(self.col == F.floor(self.col), F.floor(self.col).cast("string")).otherwise(F.coalesce(self.col.cast("string"), F.lit("")))
        return F.coalesce(self.col.cast("string"), F.lit(""))

    def truth(self) -> Column:
        if self.kind == "bool":
            return self.col
        return F.coalesce(self.col != 0, F.lit(False)) if self.kind == "num" else self.string() != ""


@dataclass
class Scope:
    """What names mean: columns of the submission, the entries of repeats, lookups, the day."""

    columns: set[str]
    repeats: dict[str, list[str]] = field(default_factory=dict)
    as_of: str = "1970-01-01"
    value: Column | None = None
    outer: Column | None = None
    pulls: list[tuple[str, str, str, Column]] = field(default_factory=list)
    position: Column | None = None
    entry: Column | None = None
    entry_names: frozenset[str] = frozenset()
    choice: tuple[str, Column] | None = None

    def look(self, name: str) -> Value:
        if name in self.entry_names:
            return Value(self.entry[name], "any")
        if name not in self.columns:
            raise FormError(f"unknown reference {name}")
        return Value(F.col(f"`{name}`"), "any")

    def entries(self, name: str) -> Column:
        for repeat, names in self.repeats.items():
            if name in names:
                return F.coalesce(F.transform(F.col(f"`{repeat}`"), lambda r: r[name].cast("string")), F.array().cast("array<string>"))
        raise FormError(f"{name} is in no repeat")


class _Parser:
    """One level of precedence per method; each returns a Value."""

    LEVELS = (("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod"))

    def __init__(self, text: str, scope: Scope):
        self.items, self.at, self.text, self.scope = tokens(text), 0, text, scope

    def peek(self) -> str | None:
        return self.items[self.at][1] if self.at < len(self.items) else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.items) or want not in (None, self.items[self.at][1]):
            raise FormError(f"expected {want or 'more'} in {self.text!r}")
        self.at += 1
        return self.items[self.at - 1]

    def whole(self) -> Value:
        out = self.level(0)
        if self.at != len(self.items):
            raise FormError(f"unexpected {self.peek()!r} in {self.text!r}")
        return out

    def level(self, n: int) -> Value:
        if n == len(self.LEVELS):
            return self.unary()
        left = self.level(n + 1)
        while self.peek() in self.LEVELS[n] and self.items[self.at][0] in ("op", "name"):
            op = self.take()[1]
            left = _combine(op, left, self.level(n + 1))
        return left

    def unary(self) -> Value:
        if self.peek() == "-":
            self.take()
            return Value(-self.unary().number(), "num")
        return self.primary()

    def primary(self) -> Value:
        kind, text = self.take()
        if kind == "number":
            return Value(F.lit(float(text)), "num")
        if kind == "string":
            return Value(F.lit(text[1:-1]), "str")
        if text == "(":
            inside = self.level(0)
            self.take(")")
            return inside
        if text == ".":
            if self.scope.value is None:
                raise FormError(f"no value for . in {self.text!r}")
            return Value(self.scope.value, "any")
        if text == "current()/.":
            return Value(self.scope.outer if self.scope.outer is not None else self.scope.value, "any")
        if kind in ("ref", "path"):
            return self.scope.look(_last(text))
        if kind == "name" and self.peek() == "(":
            return self.call(text)
        if kind == "name" and self.scope.choice is not None:  # in a choice filter a bare name is a column of the list
            return self.pulled(self.scope.choice[0], text, "name", self.scope.choice[1])
        raise FormError(f"unexpected {text!r} in {self.text!r}")

    def call(self, name: str) -> Value:
        self.take("(")
        if name in ("count", "sum", "min", "max") and self.items[self.at][0] in ("ref", "path"):
            return self.entries(name)
        if name == "position":
            self.take("..")
            self.take(")")
            if self.scope.position is None:
                raise FormError("position(..) outside a repeat")
            return Value(self.scope.position, "num")
        if name == "pulldata":
            return self.pull()
        args = []
        while self.peek() != ")":
            args.append(self.level(0))
            if self.peek() == ",":
                self.take()
        self.take(")")
        return _apply(name, args, self.scope, self.text)

    def pull(self) -> Value:
        """pulldata(file, column, key, value): the cell of a lookup, '' where there is none."""
        named = []
        for _ in range(3):
            kind, text = self.take()
            if kind != "string":
                raise FormError(f"pulldata takes names in quotes in {self.text!r}")
            named.append(text[1:-1])
            self.take(",")
        value = self.level(0)
        self.take(")")
        return self.pulled(*named, value.string())

    def pulled(self, file: str, column: str, key: str, value: Column) -> Value:
        if self.scope.entry is not None:
            raise FormError(f"a lookup inside a repeat is made on its own rows: {self.text!r}")
        self.scope.pulls.append((file, column, key, value))
        return Value(F.coalesce(F.col(f"_pull{len(self.scope.pulls) - 1}").cast("string"), F.lit("")), "any")

    def entries(self, name: str) -> Value:
        """An aggregate over the entries of a repeat, with or without a condition on them."""
        values = self.scope.entries(_last(self.take()[1]))
        if self.peek() == "[":
            start = self.at + 1
            depth, end = 1, start
            while depth:
                if end >= len(self.items):
                    raise FormError(f"[ is not closed in {self.text!r}")
                depth += {"[": 1, "]": -1}.get(self.items[end][1], 0)
                end += 1
            inner = self.items[start : end - 1]
            scope, text = self.scope, self.text

            def keep(x: Column) -> Column:
                parser = _Parser("", Scope(scope.columns, scope.repeats, scope.as_of, x, scope.value, entry=scope.entry, entry_names=scope.entry_names))
                parser.items, parser.text = inner, text
                return parser.whole().truth()

            values, self.at = F.filter(values, keep), end
        self.take(")")
        numbers = F.filter(F.transform(values, lambda x: x.try_cast("double")), lambda x: x.isNotNull())
        return Value({"count": lambda: F.size(values).cast("double"), "sum": lambda: F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x), "min": lambda: F.array_min(numbers), "max": lambda: F.array_max(numbers)}[name](), "num")


def _last(text: str) -> str:
    return text.strip("${}").strip().rstrip("/").split("/")[-1]


def _combine(op: str, a: Value, b: Value) -> Value:
    if op in ("and", "or"):
        return Value(a.truth() & b.truth() if op == "and" else a.truth() | b.truth(), "bool")
    if op in ("=", "!="):
        if "bool" in (a.kind, b.kind):
            same = a.truth() == b.truth()
        elif "num" in (a.kind, b.kind):
            same = F.coalesce(a.number() == b.number(), F.lit(False))
        elif "str" in (a.kind, b.kind):
            same = a.string() == b.string()
        else:  # two answers: by number where both are numbers, so 5 equals 5.0
            same = F.coalesce(a.number() == b.number(), a.string() == b.string())
        return Value(same if op == "=" else ~same, "bool")
    x, y = a.number(), b.number()
    if op in ("<", "<=", ">", ">="):
        test = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return Value(F.coalesce(test, F.lit(False)), "bool")
    return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "div": lambda: F.try_divide(x, y), "mod": lambda: F.when(y != 0, x % y)}[op](), "num")


def _days(c: Column) -> Column:
    """Days since 1970, as the language counts dates; a column may be a date, a timestamp or text."""
    return F.unix_micros(c.try_cast("timestamp")) / 86_400_000_000.0


def _apply(name: str, args: list[Value], scope: Scope, text: str) -> Value:
    choices = lambda v: F.filter(F.split(F.btrim(v.string()), r"\s+", -1), lambda x: x != "")
    table = {
        "regex": lambda s, p: Value(F.rlike(s.string(), F.concat(F.lit("^(?:"), p.string(), F.lit(")$"))), "bool"),
        "selected": lambda s, x: Value(F.array_contains(choices(s), x.string()), "bool"),
        "selected-at": lambda s, n: Value(F.coalesce(F.get(choices(s), n.number().cast("int")), F.lit("")), "str"),
        "count-selected": lambda s: Value(F.size(choices(s)).cast("double"), "num"),
        "string-length": lambda s: Value(F.length(s.string()).cast("double"), "num"),
        "substr": lambda s, a, b: Value(F.substring(s.string(), a.number().cast("int") + 1, (b.number() - a.number()).cast("int")), "str"),
        "contains": lambda s, x: Value(F.contains(s.string(), x.string()), "bool"),
        "starts-with": lambda s, x: Value(F.startswith(s.string(), x.string()), "bool"),
        "normalize-space": lambda s: Value(F.btrim(F.regexp_replace(s.string(), r"\s+", " ")), "str"),
        "concat": lambda *xs: Value(F.concat(*[x.string() for x in xs]), "str"),
        "string": lambda s: Value(s.string(), "str"),
        "number": lambda s: Value(s.number(), "num"),
        "int": lambda s: Value(F.when(s.number() < 0, F.ceil(s.number())).otherwise(F.floor(s.number())).cast("double"), "num"),
        "abs": lambda s: Value(F.abs(s.number()), "num"),
        "not": lambda s: Value(~s.truth(), "bool"),
        "true": lambda: Value(F.lit(True), "bool"),
        "false": lambda: Value(F.lit(False), "bool"),
        "if": lambda c, a, b: Value(F.when(c.truth(), a.number()).otherwise(b.number()), "num") if a.kind == b.kind == "num" else Value(F.when(c.truth(), a.string()).otherwise(b.string()), "any"),
        "coalesce": lambda a, b: Value(F.when(a.string() != "", a.string()).otherwise(b.string()), "any"),
        "today": lambda: Value(_days(F.lit(scope.as_of[:10])), "num"),
        "now": lambda: Value(_days(F.lit(scope.as_of)), "num"),
        "date": lambda s: Value(_days(s.col), "num"),
        "decimal-date-time": lambda s: s if s.kind == "num" else Value(_days(s.col), "num"),
    }
    if name == "round":
        digits = args[1] if len(args) == 2 else Value(F.lit(0.0), "num")
        scale = F.pow(F.lit(10.0), digits.number())  # halves go up; the sum is rounded first, as 2.675 is below its half
        return Value(F.floor(F.round(args[0].number() * scale, 9) + 0.5) / scale, "num")
    if name not in table:
        raise FormError(f"unknown function {name} in {text!r}")
    try:
        return table[name](*args)
    except TypeError as e:
        raise FormError(f"{name} does not take {len(args)} arguments in {text!r}") from e


def compiled(text: str, scope: Scope) -> Value:
    """The column of an expression; FormError where it cannot be read or names something unknown."""
    return _Parser(text, scope).whole()


@dataclass(frozen=True)
class Bind:
    """One question or group of a form: path, type, and its expressions."""

    path: str
    type: str = "string"
    constraint: str = ""
    relevant: str = ""
    required: str = ""
    calculate: str = ""
    choices: str = ""
    choice_filter: str = ""

    @property
    def name(self) -> str:
        return _last(self.path)

    @property
    def enforcement(self) -> str:
        if self.constraint and self.relevant:
            return "gate"
        return "constraint" if self.constraint else "skip" if self.relevant else "derived" if self.calculate else "required" if self.required else "none"


def load(binds: DataFrame, choices: DataFrame | None = None) -> list[Bind]:
    """The binds of a definition read by sources.xform_binds, with the lists of sources.xform_choices; a form has some hundreds."""
    lists = {} if choices is None else {r.nodeset: (r.list, r.choice_filter) for r in choices.collect()}
    return [Bind(r.nodeset, r.type or "string", r.constraint or "", r.relevant or "", r.required or "", r.calculate or "", *lists.get(r.nodeset, ())) for r in binds.collect()]


def _condition(form: list[Bind], bind: Bind) -> list[str]:
    """The skip conditions of a bind and of all groups around it."""
    return [b.relevant for b in form if b.relevant and (b.path == bind.path or bind.path.startswith(b.path + "/"))]


def _joined(records: DataFrame, scope: Scope, lookups: dict[str, DataFrame], first: int) -> DataFrame:
    """records with a column _pull<n> per lookup of the scope from the given one on; of repeated keys the least row counts."""
    for n, (file, column, key, value) in list(enumerate(scope.pulls))[first:]:
        if file not in lookups:
            raise FormError(f"no lookup table {file}")
        one = first_per_key(lookups[file].select(F.col(key).cast("string").alias(f"_key{n}"), F.col(column).cast("string").alias(f"_pull{n}")).where(f"_key{n} is not null"), [f"_key{n}"], [])
        records = records.withColumn(f"_at{n}", value).join(small(one), F.col(f"_at{n}") == F.col(f"_key{n}"), "left").drop(f"_at{n}", f"_key{n}")
    return records


def derived(records: DataFrame, form: list[Bind], repeats: dict[str, list[str]] | None = None, lookups: dict[str, DataFrame] | None = None, as_of: str = "1970-01-01") -> DataFrame:
    """records with the form's calculated fields, in the form's order; a repeat's fields are derived on its own rows."""
    scope = Scope(set(records.columns), repeats or {}, as_of)
    inside = {n for names in (repeats or {}).values() for n in names}
    for b in form:
        if not b.calculate or b.name in inside:
            continue
        had = len(scope.pulls)
        value = compiled(b.calculate, scope)
        records = _joined(records, scope, lookups or {}, had)
        records = records.withColumn(b.name, value.string() if value.kind == "any" else value.col)
        scope.columns.add(b.name)
    return records.drop(*[f"_pull{n}" for n in range(len(scope.pulls))])


def _home(bind: Bind, repeats: dict[str, list[str]]) -> str | None:
    """The repeat that a bind's path leads through."""
    return next((step for step in bind.path.strip("/").split("/")[:-1] if step in repeats), None)


def filled(records: DataFrame, form: list[Bind], repeats: dict[str, list[str]], lookups: dict[str, DataFrame] | None = None, as_of: str = "1970-01-01") -> DataFrame:
    """records with all calculated fields in the form's order, those of a repeat as fields of its entries.

    So counts over a repeat may ask for what was calculated in it, and no row is multiplied or shuffled but for lookups. A name
    that a repeat's path leads to and its list leaves out becomes a new field. A repeat that is null stays so.
    """
    known = {r: set(names) for r, names in repeats.items()}
    scope = Scope(set(records.columns), {r: list(names) for r, names in repeats.items()}, as_of)
    for b in form:
        if not b.calculate:
            continue
        home = _home(b, repeats)
        if home is None:
            had = len(scope.pulls)
            value = compiled(b.calculate, scope)
            records = _joined(records, scope, lookups or {}, had)
            records = records.withColumn(b.name, value.string() if value.kind == "any" else value.col)
            scope.columns.add(b.name)
            continue

        def with_field(e: Column, i: Column) -> Column:
            inside = Scope(scope.columns, scope.repeats, as_of, position=i + 1, entry=e, entry_names=frozenset(known[home]))
            value = compiled(b.calculate, inside)
            return e.withField(b.name, value.string() if value.kind == "any" else value.col)

        records = records.withColumn(home, F.transform(F.col(f"`{home}`"), with_field))
        known[home].add(b.name)
        scope.repeats[home] = sorted(known[home])
    return records.drop(*[f"_pull{n}" for n in range(len(scope.pulls))])


def entries(records: DataFrame, repeat: str, position: str = "line") -> DataFrame:
    """A row per entry of a repeat with the submission's own columns, numbered from 1."""
    rows = records.select("*", F.posexplode(repeat).alias("_n", "_e"))
    return rows.select(*[c for c in records.columns], (F.col("_n") + 1).alias(position), "_e.*")


def _broken(bind: Bind, form: list[Bind], own: Column, scope: Scope) -> list[Column]:
    """Per rule of a question a column that is its report where it is broken, else null."""
    given, found = F.coalesce(own.cast("string"), F.lit("")) != "", []
    scope.value = own
    conditions = _condition(form, bind)
    relevant = reduce(lambda a, c: a & c, [compiled(x, scope).truth() for x in conditions], F.lit(True))
    say = lambda what: F.struct(F.lit(bind.name).alias("field"), F.lit(bind.enforcement).alias("enforcement"), F.lit(what).alias("violation"))
    if conditions:
        found.append(F.when(~relevant & given, say("answered_but_skipped")))
    if bind.required and bind.required not in ("false()", "no"):
        needed = F.lit(True) if bind.required in ("yes", "true", "true()") else compiled(bind.required, scope).truth()
        found.append(F.when(relevant & needed & ~given, say("missing")))
    if bind.constraint:
        found.append(F.when(relevant & given & ~compiled(bind.constraint, scope).truth(), say("constraint")))
    if bind.choices:
        scope.choice = (bind.choices, Value(own, "any").string())
        listed = compiled("name != ''" + (f" and ({bind.choice_filter})" if bind.choice_filter else ""), scope).truth()
        scope.choice = None
        found.append(F.when(relevant & given & ~listed, say("not_a_choice")))
    return found


_REPORTS = "array<struct<field:string,enforcement:string,violation:string>>"


def violations(records: DataFrame, form: list[Bind], key: list[str], repeats: dict[str, list[str]] | None = None, lookups: dict[str, DataFrame] | None = None, as_of: str = "1970-01-01") -> DataFrame:
    """(key..., field, enforcement, violation) for each broken rule of the questions that records have.

    violation: constraint (answered, relevant and not true), missing (required, relevant, unanswered), answered_but_skipped
    or not_a_choice (answered with what its list, as its filter leaves it, does not hold under `name`).
    One pass over the records, whatever the number of rules; unanswered is null or ''.
    """
    records, found = _submission_rules(records, form, repeats or {}, lookups or {}, as_of)
    every = F.array_compact(F.array(*found)) if found else F.array().cast(_REPORTS)
    return records.select(*key, F.explode(every).alias("_v")).select(*key, "_v.*")


def _submission_rules(records: DataFrame, form: list[Bind], repeats: dict[str, list[str]], lookups: dict[str, DataFrame], as_of: str) -> tuple[DataFrame, list[Column]]:
    scope, found = Scope(set(records.columns), repeats, as_of), []
    for b in form:
        if b.name not in records.columns or not (b.constraint or b.required or b.choices or _condition(form, b)):
            continue
        had = len(scope.pulls)
        found += _broken(b, form, F.col(f"`{b.name}`"), scope)
        records = _joined(records, scope, lookups, had)
    return records, found


def checked(records: DataFrame, form: list[Bind], key: list[str], repeats: dict[str, list[str]], lookups: dict[str, DataFrame] | None = None, as_of: str = "1970-01-01") -> DataFrame:
    """(key..., line, field, enforcement, violation): all rules of a form over whole submissions, those of repeats by entry.

    Calculated fields are filled first. line is the entry's number from 1, null for the submission's own questions. Only
    questions that a repeat's list names (or that are calculated in it) are checked there. Entries are checked inside their
    submission, so a serial may be counted among its neighbours, and the plan has no shuffle but for lookups.
    """
    records = filled(records, form, repeats, lookups, as_of)
    known = {r: [f.name for f in records.schema[r].dataType.elementType.fields] for r in repeats}
    outer = [b for b in form if _home(b, repeats) is None]
    columns = frozenset(records.columns)
    records, found = _submission_rules(records, outer, known, lookups or {}, as_of)
    parts = [F.transform(F.array_compact(F.array(*found)), lambda v: F.struct(F.lit(None).cast("int").alias("line"), v["field"].alias("field"), v["enforcement"].alias("enforcement"), v["violation"].alias("violation")))] if found else []
    for repeat, names in known.items():
        ruled = [b for b in form if _home(b, repeats) == repeat and b.name in names and (b.constraint or b.required or b.choices or _condition(form, b))]
        if not ruled:
            continue

        def reports(e: Column, i: Column) -> Column:
            scope = Scope(set(columns), known, as_of, position=i + 1, entry=e, entry_names=frozenset(names))
            broken = [c for b in ruled for c in _broken(b, form, e[b.name], scope)]
            return F.transform(F.array_compact(F.array(*broken)), lambda v: F.struct((i + 1).alias("line"), v["field"].alias("field"), v["enforcement"].alias("enforcement"), v["violation"].alias("violation")))

        parts.append(F.coalesce(F.flatten(F.transform(F.col(f"`{repeat}`"), reports)), F.array().cast("array<struct<line:int,field:string,enforcement:string,violation:string>>")))
    every = F.concat(*parts) if parts else F.array().cast("array<struct<line:int,field:string,enforcement:string,violation:string>>")
    return records.select(*key, F.explode(every).alias("_v")).select(*key, "_v.*")


def lint(spark: SparkSession, form: list[Bind], repeats: dict[str, list[str]] | None = None, lookups: dict[str, list[str]] | None = None) -> DataFrame:
    """(field, problem): expressions that cannot be read, unknown names, repeated fields, constants as constraints."""
    names, rows = {b.name for b in form}, []
    seen: set[str] = set()
    for b in form:
        if b.path in seen:
            rows.append((b.name, "defined twice"))
        seen.add(b.path)
        for what in ("constraint", "relevant", "calculate"):
            text = getattr(b, what)
            if not text:
                continue
            scope = Scope(names, repeats or {}, value=F.lit("") if what == "constraint" else None, position=F.lit(1))
            try:
                compiled(text, scope)
            except FormError as e:
                rows.append((b.name, f"{what}: {e}"))
            rows += [(b.name, f"{what}: no column {c} in {f}") for f, col, key, _ in scope.pulls for c in (col, key) if lookups is not None and c not in lookups.get(f, [])]
            if what == "constraint" and not any(k in ("ref", "dots", "path") for k, _ in tokens_or_none(text)):
                rows.append((b.name, "constraint: tests nothing"))
    return spark.createDataFrame(rows, "field string, problem string")


def tokens_or_none(text: str) -> list[tuple[str, str]]:
    try:
        return tokens(text)
    except FormError:
        return [("dots", ".")]


#: How a question's type is stored; types not named are text.
STORAGE = {"int": "integer", "integer": "integer", "decimal": "double", "date": "date", "time": "time", "dateTime": "timestamp", "geopoint": "geopoint", "calculate": "derived"}


def codebook(spark: SparkSession, form: list[Bind], repeats: dict[str, list[str]] | None = None, choices: dict[str, list[str]] | None = None, shown: int = 14) -> DataFrame:
    """A row per question: its section, table, storage, rule class and the first options of its value set."""
    home = {n: r for r, names in (repeats or {}).items() for n in names}
    groups = {a.path for a in form for b in form if b.path.startswith(a.path + "/")}
    rows = []
    for n, b in enumerate(x for x in form if x.path not in groups):
        steps, options = b.path.strip("/").split("/"), (choices or {}).get(b.name, [])
        text = "; ".join(options[:shown]) + (f"; and {len(options) - shown} more" if len(options) > shown else "")
        rows.append((n + 1, b.name, steps[-2] if len(steps) > 2 else "", home.get(b.name, "submission"), "derived" if b.calculate else STORAGE.get(b.type, "text"), b.enforcement, text))
    return spark.createDataFrame(rows, "position int, field string, section string, table_name string, storage string, enforcement string, value_set string")


def differences(a: DataFrame, b: DataFrame, allowed: list[str] = ()) -> DataFrame:
    """(nodeset, attribute, a, b) where the binds of two variants of a form differ, but for the allowed fields."""
    attributes = ("type", "constraint", "relevant", "required", "calculate")
    long = lambda df, name: df.select("nodeset", F.explode(F.array(*[F.struct(F.lit(x).alias("attribute"), F.col(x).alias(name)) for x in attributes])).alias("_x")).select("nodeset", "_x.*")
    both = long(a, "a").join(long(b, "b"), ["nodeset", "attribute"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.where(~F.element_at(F.split("nodeset", "/"), -1).isin(list(allowed))) if allowed else both
