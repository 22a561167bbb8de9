"""Personal data: fixed base patterns, and candidates that boosted trees judge.

Base spans come from four patterns with checks. Beyond them, high-recall generators propose spans
that may overlap; each gets features of its format and of the text around it, a boosted tree
ensemble gives a probability, and a threshold per generator, calibrated on held-out examples,
decides. What runs over the corpus is one projection of DataFrame expressions, trees included, with
no shuffle. The ensemble is fitted on the driver from a fixed number of synthetic examples whose
features come from the same expressions.

Null text is empty and has no spans; positions are code points, ends exclusive; rows are
independent, so repeats and ties get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import json
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import let

BASE = ("email", "ip", "card", "phone")
# Fixed values of the base: patterns that give the contract's matches, written so that the engine never tries a run of characters twice and never recurses.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators of further candidates, in the order in which their kinds are listed. Runs are open, so no value is cut short.
GENERATORS = {
    "access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}+",
    "credential": r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.!@#$%^&*?~-]{6,}+",
    "national_phone": r"\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}",
    "social_number": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "bank_account": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?",
    "spelled_email": r"(?i)(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]++\s?(?:\.|[\[(]\s?dot\s?[\])])|\x20at\x20[A-Za-z0-9-]++\x20dot\x20)\s?[A-Za-z]{2,10}",
    "service_token": r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk_test_|sk-|AIza)[A-Za-z0-9_-]{16,}+",
    "web_token": r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)?",
    "private_key": r"-----BEGIN (?:[A-Z]{2,12} ){0,2}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]++-----END (?:[A-Z]{2,12} ){0,2}PRIVATE KEY-----|(?:\s*+[A-Za-z0-9+/]{16,}+={0,2}+)++)?",
    "ipv6": r"(?:\G|(?<![0-9A-Za-z:.]))(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})",
    "trunk_phone": r"(?:\G|(?<![0-9A-Za-z]))\(?0[0-9]{1,4}\)?[\x20/-][0-9]{2,8}(?:[\x20-][0-9]{2,6}){0,4}",
}
KINDS = (*BASE, *GENERATORS)
CONTEXT = {
    "phone": "(?i)phone|tel|call|fax|mobile", "id": "(?i)ssn|social|passport|taxpayer", "bank": "(?i)iban|account|bank|transfer",
    "secret": "(?i)password|passwd|secret|token|key|login", "mail": "(?i)mail|contact|write", "count": "(?i)version|order|item|total|page|row|score",
}
#: How addresses end.
DOMAIN_END = "(?i)(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu)$"
#: Synthetic examples per generator, and what they teach.
EXAMPLES, SEED, ROUNDS, DEPTH, RATE, PRECISION = 160, 11, 16, 3, 0.4, 0.95
LEFT_CHARS = 24


def running(lengths: Column) -> Column:
    """The sum of all before, for each of lengths; in blocks, so that long arrays stay cheap."""
    block = 64
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)

    def of(xs: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: total(F.slice(xs, b * block + 1, block)))
        offsets = F.aggregate(sums, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
        place = lambda offs: lambda i: F.get(offs, F.floor(i / block).cast("int")) + total(F.slice(xs, i - i % block + 1, i % block))
        return let(offsets, lambda offs: F.transform(F.sequence(F.lit(0), F.size(xs) - 1), place(offs)))

    return let(lengths, of)


SPAN = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str, hint: Column) -> Column:
    """The pattern's matches in text as (start, end, value); hint is false where there can be none."""
    none = F.array().cast(SPAN)

    def placed(found: Column) -> Column:
        def of(pieces: Column) -> Column:
            lengths = F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))

            def spans(before: Column) -> Column:
                start = lambda i: F.get(before, i) + F.length(F.get(pieces, i))
                return F.transform(found, lambda m, i: F.struct(start(i).alias("start"), (start(i) + F.length(m)).alias("end"), m.alias("value")))

            return let(running(lengths), spans)

        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), of))

    return F.when(hint, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    def term(i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((F.length(number) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    part = lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False))
    digit = text.rlike("[0-9]")
    card = lambda n: F.when(F.length(n).between(14, 19), luhn(n)).otherwise(F.lit(False))
    return {
        "email": matches(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(matches(text, IP, digit), lambda m: F.forall(F.split(m["value"], "[.]", -1), part)),
        "card": F.filter(matches(text, CARD, digit), lambda m: let(digits(m["value"]), card)),
        "phone": F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), lambda m: F.length(digits(m["value"])).between(10, 15)),
    }


def features(text: Column, generator: Column, span: Column) -> Column:
    """Numbers about a candidate's format and what stands around it."""
    value, count = span["value"], lambda p: F.regexp_count(span["value"], F.lit(p)).cast("double")
    left = F.substring(text, F.greatest(span["start"] - LEFT_CHARS, F.lit(0)) + 1, F.least(span["start"], F.lit(LEFT_CHARS)))
    before = F.when(span["start"] > 0, F.substring(text, span["start"], F.lit(1))).otherwise(F.lit(" "))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    truth = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    tail = F.regexp_extract(value, "[A-Za-z0-9+/_.!@#$%^&*?~-]+$", 0)
    near = [truth(left.rlike(p)) for p in CONTEXT.values()]
    return F.array(
        generator.cast("double"), F.length(value).cast("double"), count("[0-9]"), count("[A-Za-z]"), count("[A-Z]"), count("[\\x20().-]"),
        truth(before.rlike("[A-Za-z0-9]")), truth(after.rlike("[A-Za-z0-9]")), F.regexp_count(tail, F.lit("[0-9]")).cast("double"),
        truth(value.rlike("^(?:000|666|9)")), truth(before.isin("#", "$", "-", ".", "/")), truth(value.rlike(DOMAIN_END)), *near,
    )


def candidates(text: Column) -> Column:
    """All generators' spans with generator number and features."""
    digit = text.rlike("[0-9]")
    hints = {
        "access_key": text.rlike("A[KS]IA"), "credential": text.rlike("[=:]"), "spelled_email": text.rlike("(?i)[\\[(]\\s?at\\s?[\\])]| dot [a-z]"),
        "service_token": text.rlike("gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_|sk-|AIza"), "web_token": F.contains(text, F.lit("eyJ")),
        "private_key": F.contains(text, F.lit("PRIVATE KEY-----")), "ipv6": text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f:]"), "trunk_phone": text.rlike("0[0-9]{1,4}[)]?[ /-][0-9]"),
    }
    each = []
    for k, (name, pattern) in enumerate(GENERATORS.items()):
        found = matches(text, pattern, hints.get(name, digit))
        told = lambda k: lambda m: F.struct(F.lit(k).alias("gen"), m["start"].alias("start"), m["end"].alias("end"), features(text, F.lit(k), m).alias("x"))
        each.append(F.transform(found, told(k)))
    return F.flatten(F.array(*each))


def _examples(seed: int, per_kind: int) -> list[dict]:
    """Texts with one planted span each, good or not, in words that say nothing."""
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    num = lambda n: pick(string.digits, n)
    word = lambda: pick(string.ascii_lowercase, rng.randint(2, 9))
    named = lambda xs: rng.choice([*xs, "", "", ""])
    code = string.ascii_uppercase + string.digits
    hexed = lambda: pick("0123456789abcdef", rng.randint(1, 4))
    mixed = string.ascii_letters + string.digits + "-_."
    chosen = lambda: rng.choice([f"{word()}{num(rng.randint(1, 6))}{rng.choice(['', '!', '#', word()])}", f"{word().capitalize()}{rng.choice('0134')}{word()}{rng.choice('&!?$')}{num(1)}", pick(mixed, rng.randint(10, 24))])
    machine = lambda: pick("0123456789abcdef", rng.randint(8, 40)) if rng.random() < 0.5 else pick(mixed, rng.randint(60, 900))
    secret = lambda: (chosen() if rng.random() < 0.5 else machine()).rjust(6, "x")
    good = {
        "access_key": lambda: (named(["key ", "access key: "]), rng.choice(["AKIA", "ASIA"]) + pick(code, 16)),
        "credential": lambda: ("", rng.choice(["password=", "token = \"", "secret: ", "api_key=", "pwd: ", "Password: "]) + secret()),
        "national_phone": lambda: (named(["phone ", "call ", "tel. ", "fax "]), rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {}-{}"]).format(rng.choice("23456789") + num(2), rng.choice("23456789") + num(2), num(4))),
        "social_number": lambda: (named(["ssn ", "social security "]), f"{rng.randint(101, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"),
        "bank_account": lambda: (named(["iban ", "account "]), rng.choice(["DE", "FR", "ES", "GB"]) + num(2) + "".join(rng.choice([" ", ""]) + num(4) for _ in range(rng.randint(4, 6)))),
        "spelled_email": lambda: (named(["mail ", "write "]), rng.choice([f"{word()}{rng.choice([' ', ''])}{rng.choice(['[at]', '(at)', '( at )'])}{rng.choice([' ', ''])}{word()}{rng.choice(['.', ' [dot] ', '(dot)'])}", f"{word()} at {word()} dot "]) + rng.choice(["com", "org", "net"])),
        "service_token": lambda: (named(["Bearer ", "token ", "key "]), rng.choice(["ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "sk_live_", "sk-", "AIza"]) + pick(string.ascii_letters + string.digits, rng.randint(20, 90))),
        "web_token": lambda: (named(["Bearer ", "Authorization: Bearer ", "session="]), "eyJ" + pick(string.ascii_letters + string.digits + "_-", rng.randint(12, 60)) + ".eyJ" + pick(string.ascii_letters + string.digits + "_-", rng.randint(20, 300)) + rng.choice(["", "." + pick(string.ascii_letters + string.digits + "_-", rng.randint(20, 90))])),
        "private_key": lambda: ("", f"-----BEGIN {(kind := rng.choice(['RSA ', 'EC ', 'OPENSSH ', '']))}PRIVATE KEY-----" + rng.choice(["", f"\n{pick(string.ascii_letters + string.digits + '+/', 64)}\n{pick(string.ascii_letters, 30)}==", f" {pick(string.ascii_letters + string.digits + '+/', rng.randint(60, 400))} -----END {kind}PRIVATE KEY-----"])),
        "ipv6": lambda: (named(["host ", "address ", "from "]), rng.choice([":".join(hexed() for _ in range(8)), "2001:db8:" + ":".join(hexed() for _ in range(rng.randint(0, 2))) + "::" + hexed(), f"fe80::{hexed()}:{hexed()}:{hexed()}", f"fe80::{hexed()}", f"2001:db8::{hexed()}"]).replace(":::", "::")),
        "trunk_phone": lambda: (rng.choice(["phone ", "call ", "tel. ", "fax ", "mobile "]), rng.choice([f"0{num(2)} {num(7)}", f"0{rng.choice('1234567')} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(3)}/{num(6)}", f"(0{num(3)}) {num(6)}"])),
    }
    bad = {
        "access_key": lambda: (pick(code, 3), "AKIA" + pick(code, 16)),
        "credential": lambda: ("", rng.choice(["password: ", "token = ", "secret: "]) + pick(string.ascii_lowercase, rng.randint(6, 10))),
        "national_phone": lambda: (rng.choice(["order ", "version ", "#", num(3), "total $", "row 7."]), f"{num(3)}{rng.choice('. -')}{num(3)}{rng.choice('. -')}{num(4)}"),
        "social_number": lambda: (rng.choice(["item ", num(2), "order 4-", "page #"]), rng.choice(["000", "666", "9" + num(2), num(3)]) + f"-{num(2)}-{num(4)}"),
        "bank_account": lambda: (rng.choice(["item ", "", pick(code, 2)]), pick(string.ascii_uppercase, 2) + num(2) + "".join(" " + pick(string.ascii_uppercase, 4) for _ in range(4))),
        "spelled_email": lambda: ("score ", rng.choice([f"{num(3)} (at) {num(2)}.{pick(string.ascii_lowercase, 3)}", f"{num(3)} at {num(2)} dot {pick(string.ascii_lowercase, 3)}", f"{word()} at {word()} dot {word()}x"])),
        "service_token": lambda: (pick(string.ascii_lowercase, 3), rng.choice(["sk-", "sk-", "AIza"]) + "-".join(word() for _ in range(6)) + "-" + pick(string.ascii_lowercase, 12)),
        "web_token": lambda: (pick(string.ascii_letters, 6), "eyJ" + pick(string.ascii_lowercase, 9) + "." + pick(string.ascii_lowercase, 9)),
        "private_key": lambda: ("", "-----BEGIN PUBLIC KEY-----"),
        "ipv6": lambda: (rng.choice(["at ", "time ", "ratio "]), f"{rng.randint(1, 12)}:{num(2)}::{num(2)}"),
        "trunk_phone": lambda: (rng.choice(["order ", "version ", "item ", "total ", "", "page "]), rng.choice([f"0{num(1)}-{num(2)}-{num(4)}", f"0{num(2)} {num(3)}", f"0{num(1)} {num(2)}", f"0{num(3)}-{num(2)}-{num(2)}"])),
    }
    rows = []
    for name in GENERATORS:
        for k in range(per_kind):
            ok = k % 2 == 0
            lead, value = (good if ok else bad)[name]()
            head = " ".join(word() for _ in range(rng.randint(1, 6))) + " " + lead
            tail = "" if ok else rng.choice(["", "", num(2)])
            rows.append({"text": f"{head}{value}{tail} " + " ".join(word() for _ in range(3)), "at": len(head) if ok else -1})
    rng.shuffle(rows)
    return [r | {"held": int(k % 3 == 0)} for k, r in enumerate(rows)]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    leaf = float(-RATE * g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 8:
        return leaf
    worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    whole, best = g.sum() ** 2 / (h.sum() + 1.0), (1e-6, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values[:-1], values[1:]):
            below = x[:, f] <= (low + high) / 2
            gain = worth(below) + worth(~below) - whole
            if gain > best[0]:
                best = (gain, f, float((low + high) / 2))
    if best[1] is None:
        return leaf
    below = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[below], g[below], h[below], depth - 1), _grow(x[~below], g[~below], h[~below], depth - 1)


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _apply(tree[2], x), _apply(tree[3], x))


def _column(tree, x: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    return F.when(F.get(x, tree[0]) <= tree[1], _column(tree[2], x)).otherwise(_column(tree[3], x))


_fitted: dict[tuple, tuple[list, list[float]]] = {}


def fitted(spark: SparkSession, seed: int = SEED, per_kind: int = EXAMPLES) -> tuple[list, list[float]]:
    """The trees, and each generator's least margin; the same for a seed wherever they are fitted."""
    if (seed, per_kind) not in _fitted:
        told = F.from_json(F.lit(json.dumps(_examples(seed, per_kind))), "array<struct<text:string,at:int,held:int>>")
        rows = spark.range(1).select(F.inline(told)).select("at", "held", F.explode(candidates(F.col("text"))).alias("c"))
        found = sorted(rows.select("held", (F.col("at") == F.col("c.start")).cast("int").alias("y"), F.col("c.gen").alias("gen"), F.col("c.x").alias("x")).collect())
        x, y = np.array([r.x for r in found]), np.array([r.y for r in found], float)
        held, gen = np.array([r.held for r in found]) == 1, np.array([r.gen for r in found])
        margin, trees = np.zeros(len(y)), []
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-margin))
            trees.append(_grow(x[~held], (p - y)[~held], (p * (1 - p))[~held], DEPTH))
            margin += _apply(trees[-1], x)
        least = []
        for k in range(len(GENERATORS)):
            own = held & (gen == k)
            cuts = [c for c in np.sort(margin[own]) if y[own & (margin >= c)].mean() >= PRECISION]
            least.append(float(max(0.0, min(cuts) - 0.05)) if cuts else 1e9)
        _fitted[seed, per_kind] = trees, least
    return _fitted[seed, per_kind]


def personal_data(documents: DataFrame) -> DataFrame:
    """documents' doc_id with an array per base kind, `base` and `spans` (kind number, start, end), sorted."""
    trees, least = fitted(documents.sparkSession)
    text = F.col("_text")
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    found = docs.select("doc_id", "_text", *[c.alias(f"_{k}") for k, c in base_spans(text).items()])
    plain = lambda k: F.transform(f"_{BASE[k]}", lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))
    found = found.select("*", F.array_sort(F.flatten(F.array(*[plain(k) for k in range(len(BASE))]))).alias("base"))

    def margin(x: Column) -> Column:
        total = F.lit(0.0)
        for tree in trees:
            total = total + _column(tree, x)
        return total

    wanted = F.filter(candidates(text), lambda c: margin(c["x"]) >= F.get(F.array(*[F.lit(v) for v in least]), c["gen"]))
    clear = lambda b: lambda c: ~F.exists(b, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    own = let(F.col("base"), lambda b: F.filter(wanted, clear(b)))
    own = F.array_sort(F.transform(own, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("end"), c["gen"].alias("gen"))))
    nothing = F.struct(F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("kept"), F.lit(-1).alias("reach"))

    def sweep(acc: Column, c: Column) -> Column:
        span = F.struct(c["start"].alias("start"), (c["gen"] + len(BASE)).alias("kind"), (-c["end"]).alias("end"))
        free = c["start"] >= acc["reach"]
        return F.when(free, F.struct(F.concat(acc["kept"], F.array(span)).alias("kept"), (-c["end"]).alias("reach"))).otherwise(acc)

    added = F.aggregate(own, nothing, sweep)["kept"]
    return found.select("doc_id", "_text", *[F.col(f"_{k}").alias(k) for k in BASE], "base", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(documents: DataFrame) -> DataFrame:
    """doc_id and text with each span's place taken by its kind; of overlapping spans the first one's."""
    found = personal_data(documents)
    name = F.array(*[F.lit(k) for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(acc: Column, s: Column) -> Column:
        between = F.substring(F.col("_text"), acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(F.concat(acc["out"], between, F.lit("["), F.get(name, s["kind"]), F.lit("]")).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], new).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))

    done = F.aggregate("spans", start, put)
    return found.select("doc_id", "_text", done.alias("_d")).select("doc_id", F.concat("_d.out", F.substring("_text", F.col("_d.at") + 1, F.length("_text"))).alias("text"))
