"""Benchmark decontamination through a distributed positional inverted index.

The index is a table of postings (term, document, position), stored in the shared folder for the
terms that searches start from. A test phrase's terms are ranked by how often the corpus holds them.
The lists of its two rarest terms, each less the term's place in the phrase, are intersected with a
slop: they meet where they differ by at most that many words. At each meeting the whole phrase is
compared with the text: an exact match has its words one after another, a proximity match has them
in order within at most size + slop consecutive words. Only texts with a meeting move; those of all
other documents stay where they are read. Every document and every posting of those terms is
covered; the longest lists, of frequent words, are only read for phrases that hold nothing rarer.
All of it is DataFrame expressions.

Null or wordless items and documents match nothing; repeated document rows each get their result;
items without an item_id are passed over; an empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import ascii_lower, covered, let, small, stored

#: What separates words, once A-Z is lower-cased, and before that.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
NOT_WORD_YET = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Words of a phrase, and words that may stand between those of a proximity match.
PHRASE_WORDS, SLOP = 10, 1


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD, -1), lambda w: w != "")


def phrases(benchmark: DataFrame, size: int = PHRASE_WORDS) -> DataFrame:
    """(item_id, phrase, terms) for each window of each item; phrase is the hash of its words."""
    items = benchmark.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("_words")).where(F.size("_words") > 0)
    last = F.greatest(F.size("_words") - size, F.lit(0))
    windows = items.select("item_id", "_words", F.explode(F.sequence(F.lit(1), last + 1)).alias("_at"))
    terms = F.slice("_words", F.col("_at"), size)
    return windows.select("item_id", terms.alias("terms")).select("item_id", F.xxhash64(F.array_join("terms", " ")).alias("phrase"), "terms").distinct()


def _keyed(documents: DataFrame) -> DataFrame:
    """(doc, hash, text): a row's key and its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc, hash, at) of every place where one of terms(term) stands."""
    placed = docs.select("doc", "hash", F.posexplode(words_of(F.col("text"))).alias("at", "term"))
    return placed.join(small(terms), "term")


def rarest_terms(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(phrase, terms) -> (phrase, n, a, a_at, b, b_at): its two rarest terms and their places."""
    spread = wanted.select("phrase", F.size("terms").alias("n"), F.posexplode("terms").alias("at", "term"))
    vocabulary = stored(spread.select("term").distinct(), "benchmark-terms")
    counts = postings(docs, vocabulary).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ranked = spread.join(counts, "term").groupBy("phrase", "n").agg(F.array_sort(F.collect_list(F.struct("df", "at", "term"))).alias("r"))
    ranked = ranked.where("size(r) = n")  # else a term occurs nowhere
    second = F.coalesce(F.get("r", 1), F.get("r", 0))
    return ranked.select("phrase", "n", F.get("r", 0)["term"].alias("a"), F.get("r", 0)["at"].alias("a_at"), second["term"].alias("b"), second["at"].alias("b_at"))


def alignments(docs: DataFrame, wanted: DataFrame, slop: int = 0) -> DataFrame:
    """(doc, hash, phrase, n, start): where the lists of each phrase's rarest terms meet, give or take slop words."""
    anchors = stored(rarest_terms(docs, wanted), "anchors")
    index = stored(postings(docs, anchors.select(F.explode(F.array("a", "b")).alias("term")).distinct()), "postings")
    anchors = small(anchors)
    start = lambda term, at: index.join(anchors, index["term"] == anchors[term]).select("doc", "hash", "phrase", "n", (F.col("at") - F.col(at)).alias("start")).distinct()
    first, second = start("a", "a_at"), start("b", "b_at")
    key = ["doc", "hash", "phrase", "n"]
    if not slop:
        return first.join(second, [*key, "start"], "left_semi").where("start >= 0")
    # lists meet in cells of the offset: a start looks into the cells that a word less or more than slop away may lie in
    width = 8 * slop
    cell = lambda c: F.floor(c / width)
    reach = F.sequence(cell(F.col("start") - slop), cell(F.col("start") + slop))
    first = first.select("*", F.explode(reach).alias("cell"))
    second = second.select(*key, cell(F.col("start")).alias("cell"), F.col("start").alias("then"))
    near = first.join(second, [*key, "cell"]).where(F.abs(F.col("then") - F.col("start")) <= slop)
    return near.select(*key, "start").distinct()


def _near(words: Column, terms: Column, start: Column, slop: int) -> Column:
    """(start, length) of the proximity matches that begin at start or up to slop words before; one with nothing between is exact and none."""
    low = F.greatest(start - slop, F.lit(0))

    def from_first(head: Column) -> Column:
        reach = F.least(head + F.size(terms) + slop, F.size(words))  # one past the last place allowed

        def step(at: Column, term: Column) -> Column:
            found = F.array_position(F.slice(words, at + 1, F.greatest(reach - at, F.lit(0))), term).cast("int")
            return F.when((at < 0) | (found == 0), F.lit(-1)).otherwise(at + found)

        end = F.when(F.get(words, head) == F.get(terms, 0), F.aggregate(F.slice(terms, 2, F.size(terms)), (head + 1).cast("int"), step)).otherwise(F.lit(-1))
        return F.struct(head.cast("int").alias("start"), (end - head).cast("int").alias("length"), end.alias("end"))

    tried = F.transform(F.sequence(low, F.greatest(start, low)), from_first)
    return F.filter(tried, lambda m: (m["end"] > 0) & (m["length"] > F.size(terms)))


def _once(items: Column) -> Column:
    """A sorted array less its repeats; array_distinct compares all pairs of structs."""
    return F.filter(items, lambda m, i: (i == 0) | ~m.eqNullSafe(F.get(items, i - 1)))


def matches(documents: DataFrame, benchmark: DataFrame, size: int = PHRASE_WORDS, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """(doc, hash, exact, near) of the rows with any match, and the windows; exact and near are arrays of (start, length, phrase)."""
    windows = phrases(benchmark, size)
    docs = _keyed(documents)
    wanted = windows.select("phrase", "terms").dropDuplicates(["phrase"])
    met = alignments(docs, wanted, slop)
    if slop:
        met = met.join(small(wanted), "phrase")
    else:
        met = met.withColumn("terms", F.lit(None).cast("array<string>"))
    at = stored(met.groupBy("doc", "hash").agg(F.collect_set(F.struct("start", F.col("n").alias("length"), "phrase", "terms")).alias("met")), "meetings")
    texts = docs.join(small(at.select("doc", "hash")), ["doc", "hash"], "left_semi").dropDuplicates(["doc", "hash"])
    joined = at.join(texts, ["doc", "hash"])

    def verify(words: Column) -> Column:
        same = lambda m: (m["start"] >= 0) & (F.xxhash64(F.array_join(F.slice(words, F.greatest(m["start"], F.lit(0)) + 1, m["length"]), " ")) == m["phrase"])
        told = lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length"), m["phrase"].alias("phrase"))
        exact = F.transform(F.filter("met", same), told)
        if not slop:
            return F.struct(exact.alias("exact"), F.filter(exact, lambda m: F.lit(False)).alias("near"))
        loose = lambda m: F.transform(_near(words, m["terms"], m["start"], slop), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), m["phrase"].alias("phrase")))
        near = let(F.array_sort(F.flatten(F.transform(F.filter("met", lambda m: m["length"] > 1), loose))), _once)
        return F.struct(exact.alias("exact"), near.alias("near"))

    checked = joined.select("doc", "hash", let(words_of(F.col("text")), verify).alias("v"))
    return checked.select("doc", "hash", "v.exact", "v.near").where("size(exact) + size(near) > 0"), windows


def proximity_matches(documents: DataFrame, benchmark: DataFrame, slop: int = SLOP, size: int = PHRASE_WORDS) -> DataFrame:
    """(doc_id, item_id, start, length): where a phrase's words stand in order with 1 to slop others between them."""
    found, windows = matches(documents, benchmark, size, slop)
    near = found.select("doc", F.inline("near"))
    return near.join(windows.select("phrase", "item_id"), "phrase").select(F.col("doc").alias("doc_id"), "item_id", "start", "length").distinct()


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = PHRASE_WORDS, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, items and near_items (sorted as strings; the latter by proximity) of every document row, and its key (_doc, _row)."""
    found, windows = matches(documents, benchmark, size, slop)
    covers = lambda spans: F.coalesce(covered(F.array_sort(F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["length"].alias("length"))))), F.lit(0).cast("long"))
    of = lambda name: F.array_distinct(F.transform(name, lambda m: m["phrase"]))
    checked = stored(found.select("doc", "hash", covers(F.col("exact")).alias("n_hit"), of("exact").alias("exact"), of("near").alias("near")), "hits")
    pairs = lambda name: checked.select("doc", "hash", F.explode(name).alias("phrase"), F.lit(name).alias("kind"))
    named = pairs("exact").unionByName(pairs("near")).join(small(windows.select("phrase", "item_id")), "phrase")
    ids = lambda name: F.array_sort(F.collect_set(F.when(F.col("kind") == name, F.col("item_id").cast("string"))))
    items = named.groupBy("doc", "hash").agg(ids("exact").alias("items"), ids("near").alias("near_items"))
    hits = checked.select("doc", "hash", "n_hit").join(items, ["doc", "hash"])
    # only the first and the last piece can be empty
    pieces = lambda p: F.size(p) - (F.get(p, 0) == "").cast("int") - ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("int")
    n_words = let(F.split("text", NOT_WORD_YET, -1), pieces).cast("long")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("hash"), n_words.alias("n_words"))
    out = rows.join(small(hits), ["doc", "hash"], "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"),
        F.array_except(F.coalesce("near_items", none), F.coalesce("items", none)).alias("near_items"), F.col("doc").alias("_doc"), F.col("hash").alias("_row"),
    )
