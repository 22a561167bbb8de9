"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1 = """
with p as (select page_id, coalesce(html, '') h from pages),
q as (select page_id, octet_length(encode(h)) b, sha1(h) d from p),
r as (select *, max(page_id) over (partition by d, b) m from q)
select page_id, cast(b as bigint) payload_bytes, d payload_digest,
  case when b >= 1000 and page_id <> m then 'revisit' else 'response' end record_type,
  case when b >= 1000 and page_id <> m then m end refers_to
from r
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.linededup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2 = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
m as (select key, min(doc_id) first from k where length(key) >= 10 group by key having min(doc_id) <> max(doc_id)),
j as (select k.doc_id, i, line, m.first is not null and m.first <> k.doc_id gone from k left join m using (key))
select doc_id, count(*) n_lines, cast(count(*) filter (where gone) as bigint) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) kept_sha256
from j group by doc_id
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.quality_rules import quality

    return quality(table(spark, sf_dir, "documents"))


OP4 = r"""
with d as (select doc_id, coalesce(text, '') t, coalesce(source, '') s from documents),
w as (select doc_id, t, s, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w from d),
win as (select doc_id, i, array_to_string(w[i:i+7], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 6)) i from w where len(w) >= 8) q),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) c from win) q where c > 1),
cov as (select doc_id, count(distinct i + k) r from twice, range(0, 8) o(k) group by doc_id),
ln as (select doc_id, s, t, unnest(string_split(t, chr(10))) l from d),
fl as (select * from ln where regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g') <> ''),
dup as (select doc_id, count(*) - count(distinct l) n from fl group by doc_id),
nl as (select doc_id, s, t, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) k from fl),
hosts as (select s, count(distinct coalesce(doc_id, -1)) n from d group by s),
above as (select nl.s, k from nl join hosts using (s) group by nl.s, k, hosts.n having count(distinct coalesce(doc_id, -1)) > 20 and count(distinct coalesce(doc_id, -1)) > hosts.n * 0.1),
gone as (select doc_id, count(*) n, sum(len(string_split(k, ' '))) w from nl join above using (s, k) group by doc_id),
m as (
  select w.doc_id, cast(len(w.w) as bigint) n_words, cast(length(array_to_string(w.w, '')) as bigint) word_chars,
    cast(length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols, coalesce(dup.n, 0) n_dup_lines, coalesce(cov.r, 0) n_repeat_words,
    cast(coalesce(gone.n, 0) as bigint) n_common_lines, cast(len(w.w) - coalesce(gone.w, 0) as bigint) words_left
  from w left join dup using (doc_id) left join cov using (doc_id) left join gone using (doc_id))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not (n_common_lines > 0 and (words_left < 0.2 * n_words or words_left < 20 and 2 * words_left < n_words)) kept
from m
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"), F.sha2(F.array_join("near_items", ",").cast("binary"), 256).alias("near_items_sha256"),
    )


OP9 = r"""
with lo as (select 'd' kind, doc_id id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents
  union all select 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
w as (select kind, id, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from lo),
iw as (select distinct id item, least(len(w), 10) k, array_to_string(w[i:i+9], ' ') g from (select id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from w where kind = 'b' and len(w) > 0) q),
ks as (select distinct k from iw),
dw as (select id doc, i, k, array_to_string(w[i:i+k-1], ' ') g from (select id, w, k, unnest(range(1, len(w) - k + 2)) i from w, ks where kind = 'd' and len(w) >= k) q),
hit as (select doc, i, dw.k, item from dw join iw on dw.k = iw.k and dw.g = iw.g),
pos as (select doc, count(distinct p) n from (select doc, unnest(range(i, i + k)) p from hit) q group by doc),
its as (select doc, count(distinct item) n, string_agg(distinct cast(item as varchar), ',' order by cast(item as varchar)) s from hit group by doc),
pw as (select distinct id item, least(len(w), 10) k, w[i:i+9] p from (select id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from w where kind = 'b' and len(w) > 1) q),
dp as (select id doc, unnest(range(1, len(w) + 1)) pos, unnest(w) word from w where kind = 'd'),
cand as (select distinct a.doc, a.pos i, k, p, item from pw join dp a on a.word = pw.p[1] join dp b on b.doc = a.doc and b.pos = a.pos + k and b.word = pw.p[k]),
near as (select c.doc, item, k, p, w.w[i:i+k] s from cand c join w on w.kind = 'd' and w.id = c.doc),
loose as (select distinct doc, item from near where len(list_filter(range(1, k), lambda j: list_concat(s[1:j], s[j+2:k+1]) = p)) > 0),
nits as (select doc, count(*) n, string_agg(cast(item as varchar), ',' order by cast(item as varchar)) s from (from loose except select doc, item from hit) q group by doc)
select w.id doc_id, cast(len(w.w) as bigint) n_words, coalesce(pos.n, 0) n_hit, coalesce(its.n, 0) n_items, sha256(coalesce(its.s, '')) items_sha256, coalesce(pos.n, 0) > 0 contaminated,
  coalesce(nits.n, 0) n_near_items, sha256(coalesce(nits.s, '')) near_items_sha256
from w left join pos on pos.doc = w.id left join its on its.doc = w.id left join nits on nits.doc = w.id where kind = 'd'
"""

def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.pii import BASE, joined, personal_data

    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.common import scratch
    from fieldloom.llm.token_files import read, write

    path = scratch(spark, "token-ids")
    write(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"))
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.common import blank_words, let
    from fieldloom.llm.tandem import tandem_runs

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: F.Column) -> F.Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))), at), " "))

    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("text", F.when(h % 10 == 0, let(blank_words(F.col("text")), repeated)).otherwise(F.col("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return tandem_runs(docs).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.shorter")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * -best.shorter) div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op13(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Each round as an assignment and its means; inner products of integers below 2^53 are exact in doubles."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (
  select x.vec_id, x.p, min(cast(list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, b.c) + list_inner_product(b.c, b.c) as hugeint) * 256 + b.e) m from x join b{r} b using (p) group by x.vec_id, x.p)""")
        if r < rounds:
            steps.append(f"""g{r} as (select x.p, cast(m % 256 as bigint) e, i, floor(sum(x.v[i]) / count(*)) y from a{r} join x using (vec_id, p), s group by all),
b{r + 1} as materialized (select b.p, b.e, coalesce(n.c, b.c) c from b{r} b left join (select p, e, list(y order by i) c from g{r} group by p, e) n using (p, e))""")
    return f"""
with k as materialized (
  select vec_id, label, list_transform(embedding, lambda y: floor(1024.0 * cast(y as double))) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
w as (select cast(max(len(v)) // {parts} as bigint) w from k),
s as (select unnest(range(1, w + 1)) i from w),
x as materialized (select vec_id, p, v[p * w + 1:(p + 1) * w] v from k, w, range({parts}) t(p)),
b0 as materialized (select p, r e, v c from x join (select vec_id, row_number() over (order by vec_id) - 1 r from k) o using (vec_id) where r < {entries}),
{", ".join(steps)},
f as (select vec_id, string_agg(printf('%02x', cast(m % 256 as bigint)), '' order by p) code, cast(sum(m // 256) as bigint) error from a{rounds} group by vec_id),
h as (select sha256(string_agg(array_to_string(list_transform(c, lambda y: cast(cast(y as bigint) as varchar)), ','), ',' order by p, e)) h from b{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, h codebooks_sha256 from f join k using (vec_id), h
"""


QUERIES = {
    "op1_warc": op1_warc, "op2_line_dedup": op2_line_dedup, "op3_simhash": op3_simhash, "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier, "op6_html_extract": op6_html_extract, "op7_packing": op7_packing, "op8_language_id": op8_language_id,
    "op9_decontaminate": op9_decontaminate, "op10_pii": op10_pii,
    "op11_token_files": op11_token_files, "op12_tandem_runs": op12_tandem_runs, "op13_vector_codes": op13_vector_codes,
}
ORACLES = {"op1_warc": OP1, "op2_line_dedup": OP2, "op4_quality_rules": OP4, "op9_decontaminate": OP9, "op13_vector_codes": _op13()}
