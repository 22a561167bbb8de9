"""Quality rules: counts over each text, and lines that too many documents of a host share.

Lines are normalised and hashed; a host's distinct documents (by doc_id) that hold a line are
counted. Exact copies under ids of their own are documents of their own: a text that fills more than
SHARE of its host goes as boilerplate does, a smaller group of copies stays whole. Lines above the
limit (a share of the host's documents, and a least number) are taken out, and a document of which
too little is left is depleted and rejected. All of it is DataFrame expressions. What is shuffled is
a hash a line, first per document and then per host, so the count of a line that a third of all rows
hold is spread; the lines above the limit are at most (lines of a mean document / SHARE) per host,
and are broadcast only if a count shows that they are few.

Null text has no words and fails the base rule; a null source is a host of its own; repeated rows
get equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import BLANK_RUN, BLANKS, blank_words, covered, let, lines_without, small, stored, unpacked, without

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A line is above the limit if more than SHARE of its host's documents and more than LEAST hold it.
SHARE, LEAST = 0.1, 20
#: A document is depleted with less than LEFT_SHARE of its words left, or with fewer than LEFT_WORDS if those are the smaller half.
LEFT_WORDS, LEFT_SHARE = MIN_WORDS, 0.2
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: Column) -> Column:
    """Words inside windows that are found twice or more in the text."""

    def of_windows(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
            return covered(F.array_sort(F.transform(twice, lambda k: F.struct(F.get(s, k)["at"].alias("start"), F.lit(WINDOW).alias("length")))))

        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(placed, of_sorted))

    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashed, of_windows))


def text_counts(text: Column) -> list[Column]:
    full_lines = let(F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counts = lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(w).alias("again"))
    return [let(blank_words(text), counts).alias("_words"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), full_lines.cast("long").alias("n_dup_lines")]


def _lines(docs: DataFrame) -> DataFrame:
    """(host, doc, hash, at, line, words) of each line that has a word."""
    lines = docs.select("host", "doc", "hash", F.posexplode(F.split("text", "\n", -1)).alias("at", "told"))
    key = F.lower(F.btrim(F.regexp_replace("told", BLANK_RUN, " ")))
    lines = lines.select("host", "doc", "hash", "at", key.alias("key")).where("key <> ''")
    return lines.select("host", "doc", "hash", "at", F.xxhash64("key").alias("line"), (F.length("key") - F.length(F.replace(F.col("key"), F.lit(" "))) + 1).alias("words"))


def common_lines(docs: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(host, line) above the limit; a null doc_id is one document."""
    many = docs.select("host", "doc").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    held = _lines(docs).select("host", "line", "doc").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("holders"))
    above = held.where(F.col("holders") > least).join(many, "host").where(F.col("holders") > F.col("documents") * share)
    return above.select("host", "line")


def _keyed(documents: DataFrame) -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [text.alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("hash")]


def _removed(docs: DataFrame, share: float, least: int) -> DataFrame:
    above = small(stored(common_lines(docs, share, least), "common-lines"))
    hit = _lines(docs).join(above, ["host", "line"]).groupBy("host", "doc", "hash")
    return hit.agg(F.array_sort(F.collect_set("at")).alias("gone"), F.sum("words").alias("sum"), F.count(F.lit(1)).alias("rows"))


def quality(documents: DataFrame, share: float = SHARE, least: int = LEAST, with_text: bool = False) -> DataFrame:
    """The counts, base_failed, n_common_lines, words_left and kept of every row.

    with_text: all columns of documents (less those of these names) come too, text without the lines above the limit.
    """
    added = (*COUNTS, "base_failed", "n_common_lines", "words_left", "kept")
    removed = _removed(documents.select(*_keyed(documents)), share, least)
    own = without(documents, *added) if with_text else documents.select("doc_id")
    docs = documents.select(F.struct(*[F.col(f"`{c}`") for c in own.columns if c.lower() != "text"]).alias("row"), *_keyed(documents))
    counted = docs.select("row", *(["text"] if with_text else []), "host", "doc", "hash", *text_counts(F.col("text")))
    on = (counted["host"] == removed["host"]) & counted["doc"].eqNullSafe(removed["doc"]) & (counted["hash"] == removed["hash"])
    joined = counted.join(removed, on, "left").drop(removed["host"], removed["doc"], removed["hash"])
    n, again, lines = F.col("_words.n"), F.col("_words.again"), F.coalesce(F.size("gone"), F.lit(0))
    # repeated rows meet in one group: each row's own share of the sum is what its distinct lines hold
    taken = F.coalesce((F.col("sum") * lines / F.col("rows")).cast("long"), F.lit(0).cast("long"))
    failed = (n < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n)
    left = n - taken
    depleted = (lines > 0) & ((left < LEFT_SHARE * n) | (left < LEFT_WORDS) & (2 * left < n))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(lines_without(F.col("text"), F.col("gone"))) if with_text else None
    verdict = [
        n.alias("n_words"), F.col("_words.chars").alias("word_chars"), F.col("n_symbols"), F.col("n_dup_lines"), again.alias("n_repeat_words"),
        failed.alias("base_failed"), lines.cast("long").alias("n_common_lines"), left.alias("words_left"), (~failed & ~depleted).alias("kept"),
    ]
    out = joined.select("row", F.struct(*([text.alias("text")] if with_text else []), *verdict).alias("new"))
    return out.select(*unpacked(out), "new.*")
