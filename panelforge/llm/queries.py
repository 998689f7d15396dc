"""The queries opN_<name>: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, flac_media, licenses, line_dedup, mixing, ngram_join, quality_bayes, quality_rules, secrets, sentencepiece_bpe, toxicity, url_filters, whitening
from .tables import table

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(*toxicity.training_texts(docs, table(spark, sf_dir, "labels")))
    return toxicity.score_documents(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", "n_windows", "n_flagged")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_bpe.encode_documents(table(spark, sf_dir, "documents"), model, with_text=False)


def op3_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac_media.read_media(flac_media.write_media(table(spark, sf_dir, "documents")))


def op4_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_bayes.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "evidence", "host_posterior", "path_posterior", "quality_score", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("rate", 6).alias("rate"), F.round("probability", 6).alias("probability"), "sampled")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), *licenses.default_known(spark))
    return found.withColumn("notice_ids", F.array_join("notice_ids", ","))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), url_filters.rule_table(spark, URL_RULES))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.filter_by_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in secrets.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("secrets")).alias("spans"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))[0]


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sentencepiece, op3_flac_media, op4_quality_bayes, op5_mixing, op6_license_scan, op7_ngram_jaccard, op8_url_filters, op9_quality_rules, op10_line_dedup, op11_whitening, op12_secret_scan, op13_centroids)}


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _license_sql() -> str:
    def canonical(x: str) -> str:
        x = f"lower({x})"
        for a, b in licenses.SPELLINGS:
            x = f"replace({x}, {_sql_text(a)}, {_sql_text(b)})"
        x = f"regexp_replace({x}, {_sql_text(licenses.COPYRIGHT_LINE)}, '', 'g')"
        x = f"regexp_replace({x}, {_sql_text(licenses.PUNCTUATION)}, ' ', 'g')"
        return f"trim(regexp_replace({x}, {_sql_text(licenses.SPACED_BREAK)}, chr(10), 'g'), ' ' || chr(10))"

    def known(texts, digests=()) -> str:
        rows = ", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in texts)
        more = "".join(f" union all select '{digest}', '{name}'" for name, *_, digest in digests)
        return f"select digest, min(license_id) as license_id from (select sha256(replace({canonical('body')}, chr(10), ' ')) as digest, license_id from (values {rows}) as v(license_id, body){more}) group by 1"

    return f"""
with whole as ({known(licenses.TEXTS, licenses.DIGESTS)}), notice as ({known(licenses.NOTICES)}),
forms as (select row_number() over () as r, doc_id, {canonical("coalesce(text, '')")} as form from documents),
found as (
  select r, string_agg(distinct n.license_id, ',' order by n.license_id) as ids
  from (select r, unnest(string_split(form, chr(10))) as line from forms) l join notice n on n.digest = sha256(l.line) group by r)
select doc_id, sha256(replace(form, chr(10), ' ')) as text_digest, w.license_id, coalesce(ids, '') as notice_ids
from forms left join whole w on w.digest = sha256(replace(form, chr(10), ' ')) left join found using (r)"""


def _url_sql() -> str:
    rules = ", ".join(str(x) for x in URL_RULES)
    return f"""
with parsed as (
  select row_number() over () as r, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules as (select * from (values {rules}) as v(rhost, rpath, rverdict))
select page_id, host, path, rhost || rpath as rule, coalesce(rverdict, 'allow') as verdict
from parsed left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
qualify row_number() over (partition by r order by length(rhost || rpath) desc nulls last) = 1"""


def _mixing_sql(rounds: int = 60, keep: float = 0.5, seed: int = 17) -> str:
    """mix_sources() with its default targets, by rounds that are many more than it takes to meet them."""
    ctes = ["""
named as (
  select doc_id, source, lang,
    case when bars * 50 > size then 'table' when digits * 25 > size then 'numeric' when size < 60 * (breaks + 1) then 'list' else 'prose' end as topic, n_tokens
  from (
    select doc_id, source, lang, length(t) as size, length(t) - length(replace(t, '|', '')) as bars, length(regexp_replace(t, '[^0-9]+', '', 'g')) as digits,
      length(t) - length(replace(t, chr(10), '')) as breaks, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) as n_tokens
    from (select *, coalesce(text, '') as t from documents))),
cells as (select source, lang, topic, sum(n_tokens)::double as n from named group by all having sum(n_tokens) > 0)""",
            f"total as (select {keep}::double * sum(n) as k from cells)"]
    for d in mixing.DIMENSIONS:
        # sorted by how soon their tokens are used up, values are full up to the first whose level leaves some
        ctes.append(f"""
w_{d} as (select {d}, n, s / sum(s) over () as share from (select {d}, sum(n) as n, power(sum(n), {mixing.POWERS[d]}) as s from cells group by 1)),
l_{d} as (
  select n / share as ratio, (k - coalesce(sum(n) over (order by n / share rows between unbounded preceding and 1 preceding), 0))
    / sum(share) over (order by n / share rows between current row and unbounded following) as level from w_{d}, total),
t_{d} as (select {d}, least(n, share * (select coalesce(arg_min(level, ratio) filter (level <= ratio), max(ratio)) from l_{d})) as target from w_{d})""")
    step, columns = "rounds", "source, lang, topic, n"
    for d in mixing.DIMENSIONS:
        step = f"""
(select k, {columns}, y * case when target > sx and so > 0 then 1 + (target - sx) / so when target <= sx and sx > 0 then target / sx else 1 end as y
 from (
  select k, {columns}, y, target, sum(least(n, y)) over (partition by {d}) as sx, sum(case when y < n then y else 0 end) over (partition by {d}) as so
  from (select k, {", ".join("c." + c.strip() for c in columns.split(","))}, y, target from {step} c join t_{d} t on c.{d} is not distinct from t.{d})))"""
    ctes.append(f"rounds as (select 0 as k, {columns}, n * {keep}::double as y from cells union all select k + 1, {columns}, y from {step} where k < {rounds})")
    ctes.append(f"fitted as (select {columns}, least(n, y) / n as p from rounds where k = {rounds})")
    return f"""with recursive {", ".join(ctes)}
select doc_id, d.source, d.lang, d.topic, n_tokens, round(coalesce(p, 0) / {keep}, 6) as rate, round(coalesce(p, 0), 6) as probability,
  coalesce(('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':{seed}'), 1, 13))::bigint / 4503599627370496.0::double < p, false) as sampled
from named d left join fitted c
  on d.source is not distinct from c.source and d.lang is not distinct from c.lang and d.topic = c.topic and n_tokens > 0"""


def _secret_sql() -> str:
    """scan_secrets(): the entropy of each window by itself, and runs of windows joined as islands."""
    kinds = [*zip(secrets.BASE_KINDS, (secrets.ASSIGN, secrets.ACCESS, secrets.HEX), strict=True), *((c.kind, c.pattern) for c in secrets.CLASSES)]
    places = " union all ".join(
        f"select r, {k} as number, '{kind}' as kind, unnest(list_zip(string_split_regex(t, {_sql_text(p)})[1:len(found)], found)) as z, generate_subscripts(found, 1) as k "
        f"from (select r, t, regexp_extract_all(t, {_sql_text(p)}) as found from texts)"
        for k, (kind, p) in enumerate(kinds)
    )
    assign = f"length(regexp_extract(found, {_sql_text(secrets.ASSIGN)}, 1)) >= {secrets.LEAST_VALUE}"
    windows = " union all ".join(
        f"select r, number, kind, start, k, w, {c.window} as size from (select *, unnest(range(0, length(found) - {c.window} + 1)) as w from placed where kind = '{c.kind}') "
        f"where regexp_matches(found, {_sql_text(secrets.MIXED)}) and not regexp_matches(found, {_sql_text('|'.join(secrets.ALLOWED))}) "
        f"and list_aggregate(string_split(substr(found, w + 1, {c.window}), ''), 'entropy') > {c.bits}"
        for c in secrets.CLASSES
    )
    listed = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, number, stop) {where}, '')"
    return f"""
with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
placed as (
  select r, number, kind, k, z[2] as found, sum(length(z[1]) + length(z[2])) over (partition by r, number order by k) - length(z[2]) as start from ({places})),
windows as ({windows}),
islands as (
  select *, sum(anew) over (partition by r, number, k order by w) as island
  from (select *, case when w <= lag(w) over (partition by r, number, k order by w) + size then 0 else 1 end as anew from windows)),
spans as (
  select r, number, kind, start, start + length(found) as stop from placed where number < {len(secrets.BASE_KINDS)} and (kind <> 'assign' or {assign})
  union all select r, number, kind, start + min(w), start + max(w) + any_value(size) from islands group by r, number, kind, k, start, island),
own as (
  select * from spans s where number < {len(secrets.BASE_KINDS)}
    or not exists (select 1 from spans o where o.r = s.r and o.number < s.number and o.start <= s.start and o.stop >= s.stop)),
by_row as (
  select r, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in secrets.BASE_KINDS)},
    {listed(f"filter (number < {len(secrets.BASE_KINDS)})")} as base, {listed("")} as spans
  from own group by r)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in secrets.BASE_KINDS)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join by_row using (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": _mixing_sql(), "op6_license_scan": _license_sql(), "op8_url_filters": _url_sql(), "op12_secret_scan": _secret_sql()}
