"""The registered queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as decontamination
from . import jaccard_join, licences, mixing, nearest, passage_chains, quality, spelling, suffix_dedup, token_counts, toxicity, warc, word_runs
from .base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


@query("op1_suffix_array_dedup")
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("spans")


@query(
    "op2_ngram_jaccard_join",
    """
with recursive words as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s, least(len(w), 5) as k
  from words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as r(i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select x.doc_id as a, y.doc_id as b from shingles x join shingles y on x.s = y.s and x.k = y.k and x.doc_id <> y.doc_id
    join sizes p on p.doc_id = x.doc_id join sizes q on q.doc_id = y.doc_id
  group by x.doc_id, y.doc_id, p.n, q.n having 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach as (select doc_id, doc_id as r from documents union select l.b, reach.r from reach join links l on l.a = reach.doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
from documents d left join sizes using (doc_id) join (select doc_id, min(r) as component_id from reach group by doc_id) using (doc_id)
""",
)
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).drop("members")


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, forest).drop("text")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query(
    "op6_mixing",
    """
with sized as (
  select doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    length(coalesce(text, '')) as n, length(translate(coalesce(text, ''), '#*$%&|<>', '')) as m
  from documents),
keyed as (
  select *, greatest(case when n > 0 then (1.0::double - (n - m)::double / n) * (1.0::double - (n - m)::double / n) else 1.0::double end, 0.01::double) as quality,
    ((('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint)::double + 0.5) / 4503599627370496.0::double as u
  from sized),
sources as (
  select source, sum(size)::bigint as source_size,
    [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source is null, encode(source))) - 1) % 3 + 1] as weight
  from keyed group by source),
-- Fill sources one after another by rising cap / weight; a source is full if the common rate reaches its ratio.
rated as (
  select *, 2.0::double * source_size / weight as ratio,
    greatest(1.5::double * sum(source_size) over () - coalesce(sum(2.0::double * source_size) over before, 0), 0) /
      (sum(weight) over () - coalesce(sum(weight) over before, 0)) as rate
  from sources
  window before as (order by 2.0::double * source_size / weight, source is null, encode(source) rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size, case when ratio <= rate or level is null then 2.0::double * source_size else weight * level end as target
  from (select *, max(case when ratio > rate then rate end) over () as level from rated)),
placed as (
  select k.doc_id, k.size, t.source_size::bigint as source_size, t.target,
    coalesce(sum(k.size) over (partition by k.source order by -ln(k.u) / k.quality, k.doc_id rows between unbounded preceding and 1 preceding), 0) as ahead
  from keyed k join targets t on k.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (case when source_size > 0 then floor(target / source_size) * size
     + greatest(0, least(size, round(target - floor(target / source_size) * source_size) - ahead)) else 0 end)::bigint as taken
from placed
""",
)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op7_collinear_chaining")
def op7_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_chains.repeated_passages(table(spark, sf_dir, "documents"))


@query(
    "op8_benchmark_decontamination",
    """
with items as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where text is not null and item_id is not null),
windows as (
  select distinct item_id, least(len(w), 10) as k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as s
  from items, range(1, greatest(len(w) - 9, 1) + 1) as r(i) where len(w) > 0),
texts as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from documents),
places as (
  select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as s
  from texts, (select distinct k from windows) as lengths(k), unnest(range(1, len(w) - k + 2)) as r(i)),
found as (select doc_id, i, p.k, item_id from places p join windows v on p.k = v.k and p.s = v.s),
hits as (select doc_id, count(distinct i + o) as n_hit from found, range(0, 10) as r(o) where o < k group by doc_id),
owners as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, item_id::varchar as item from found) group by doc_id)
select t.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from texts t left join hits using (doc_id) left join owners using (doc_id)
""",
)
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        decontamination.digest_column().alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: Base 32 of a hexadecimal SHA-1 in SQL: 5 hexadecimal digits give 4 characters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1, {5 * k + 1}, 5))::bigint >> {shift}) & 31)::int + 1, 1)"
    for k in range(8) for shift in (15, 10, 5, 0)
)


@query(
    "op10_warc",
    f"""
with records as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha1 from pages),
owners as (select html, max(page_id) as owner from records group by html)
select page_id, octet_length(encode(html))::bigint as payload_bytes, {_BASE32} as payload_digest,
  case when page_id = owner then 'response' else 'revisit' end as record_type,
  case when page_id <> owner then owner end as refers_to
from records join owners using (html)
""",
)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(archive).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def _licence_sql() -> str:
    """The scan as DuckDB SQL over the same fixed texts, spellings and patterns."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def spelled(words: str) -> str:
        out = f"concat(' ', {words}, ' ')"
        for other, form in licences.SPELLINGS:
            out = f"replace({out}, ' {other} ', ' {form} ')"
        return f"trim({out})"

    def lines(text: str) -> str:
        out = f"regexp_replace(lower(coalesce({text}, '')), '\r\n?', chr(10), 'g')"
        out = f"regexp_replace(regexp_replace({out}, '\u00a9|\\(c\\)', ' copyright ', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
        out = f"regexp_replace({out}, {quoted(licences.COPYRIGHT_LINE)}, '', 'g')"
        return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"

    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(licences.KNOWN.items()))
    return f"""
with named(licence, text) as (values {known}),
known as (select min(licence) as licence, {spelled("array_to_string(" + lines("text") + ", ' ')")} as words from named group by words),
texts as (select doc_id, {lines("text")} as l from documents),
entire as (select doc_id, {spelled("array_to_string(l, ' ')")} as words from texts),
parts as (select distinct doc_id, {spelled("x")} as words from (select doc_id, unnest(l) as x from texts)),
noted as (select doc_id, list_sort(list(distinct licence)) as line_licences from parts join known using (words) group by doc_id)
select e.doc_id, case when e.words <> '' then sha256(e.words) end as digest, k.licence, coalesce(array_to_string(line_licences, ','), '') as line_licences
from entire e left join known k on e.words = k.words and e.words <> '' left join noted n on e.doc_id = n.doc_id
"""


@query("op9_licence_scan", _licence_sql())
def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licences.scan_licences(docs, licences.known_licences(spark))
    return found.withColumn("line_licences", F.array_join("line_licences", ","))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.digests(word_runs.word_runs(word_runs.planted(table(spark, sf_dir, "documents"))))


@query("op12_nearest_neighbours")
def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(rows, rows.filter("vec_id % 20 = 0"))


@query(
    "op13_spelling_variants",
    r"""
with recursive crc as (
  select list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
found as (
  select doc_id, w, count(*) as c
  from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{00C0}-\x{00FF}]+')) as w from documents) group by doc_id, w),
hexed as (select w, c, hex(encode(coalesce(doc_id::varchar, '') || ':' || w)) as h from found where length(w) >= 6),
summed as (
  select w, c, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::bigint, 2))::bigint)),
    lambda r, b: xor(r >> 8, tab[(xor(r, b) & 255) + 1])), 4294967295::bigint) as h from hexed, crc),
changed as (select case when h % 199 = 0 then substr(w, 1, (h % length(w))::bigint) || substr(w, (h % length(w))::bigint + 2) else w end as word, c from summed),
words as (select word, sum(c)::bigint as n from changed where length(word) >= 6 group by word having sum(c) >= 5),
cuts as (select word, n, length(word) as l, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from words, unnest(range(1, length(word) + 1)) as r(i)),
near as (
  select distinct x.word as a, y.word as b, x.n as n_a, y.n as n_b from cuts x join cuts y on x.rest = y.rest and x.l = y.l and x.i = y.i and x.word <> y.word
  union select distinct x.word, y.word, x.n, y.n from cuts x join words y on x.rest = y.word
  union select distinct y.word, x.word, y.n, x.n from cuts x join words y on x.rest = y.word),
best as (select a as word, n_a as n, count(*) as n_near, min((-n_b, encode(b), b)) as t from near group by a, n_a),
forms as (select word, n_near, case when -t[1] >= 5 * n then t[3] end as form, case when -t[1] >= 5 * n then -t[1] end as form_n from best),
chain as (select word, word as root, 0 as k from words union all select c.word, f.form, k + 1 from chain c join forms f on f.word = c.root where f.form is not null)
select w.word, f.form, r.root, w.n, coalesce(f.n_near, 0)::bigint as n_near, f.form_n::bigint as form_n
from words w left join forms f on w.word = f.word join (select word, arg_max(root, k) as root from chain group by word) r on r.word = w.word
""",
)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), change=spelling.planted)
