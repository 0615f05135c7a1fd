"""The operators' queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, fill_in_middle, fingerprint_index, html_extract, mixing, ngram_join, quality_rules, sharding, suffix_dedup, token_counts, token_files, url_rules

SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: str = "text"):
    return F.coalesce(F.expr(f"regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("long")


#: Weights of domains; sources belong to domains by the rest of their number. Others share evenly.
DOMAIN_WEIGHTS = {"web": 0.4, "books": 0.3, "forum": 0.2, "reference": 0.1}
DOMAINS = list(DOMAIN_WEIGHTS)
LANGUAGE_WEIGHTS = {"en": 0.6, "fr": 0.15, "de": 0.15, "es": 0.1}


def mix_weight(path: tuple) -> float:
    if len(path) == 1:
        return DOMAIN_WEIGHTS.get(path[0], 0.1)
    return LANGUAGE_WEIGHTS.get(path[1], 0.05) if len(path) == 2 else 1.0


def mix_path() -> list:
    number = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("long"), F.crc32(F.coalesce("source", F.lit(""))))
    return [F.get(F.array(*map(F.lit, DOMAINS)), F.pmod(number, F.lit(len(DOMAINS))).cast("int")), F.col("lang"), F.col("source")]


def op1_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs, mix_path(), n_words(), mix_weight, total=0.6, max_epochs=4, seed=7)
    return out.select("doc_id", *mixing.PATH, "n_tokens", "epoch", "order_hash")


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.hilbert_shards(rows, "doc_id", ["source", "lang", "n_chars"], 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op6_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_index.dedup_windows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs.select("doc_id", "text"), rules).select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


#: The given rules of URLs: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # a page has the label of the document that the first number of its path names
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", bad.alias("blocked"))
    named = F.regexp_extract(url_rules.parts(F.col("url"))[1], r"/([0-9]+)", 1).try_cast("long")
    rules = url_rules.learn_rules(pages.select("url", named.alias("doc_id")).join(labels, "doc_id"))
    return url_rules.judge(pages, URL_RULES, rules).select("page_id", "judged.*")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42)
    restored = fill_in_middle.restore(F.col("fim.output"), F.col("fim.form"))
    return out.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_template_leaks, op2_mixing, op3_hilbert_sharding, op4_html_blocks, op5_token_files, op6_fingerprint_index, op7_token_counts, op8_suffix_array, op9_decision_list, op10_ngram_join, op11_source_divergence, op12_url_rules, op13_fill_in_middle)
}
SQL: dict[str, str] = {
    "op11_source_divergence": r"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t, row_number() over () as no from documents),
w as (select lang, source, no, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as in_lang from w group by 1, 2 having count(distinct no) >= 30),
langs as (select lang, count(term) as v, coalesce(sum(in_lang), 0) as in_all from (select distinct lang from d) left join kept using (lang) group by 1),
g as (select distinct lang, source from d),
cells as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by 1, 2, 3),
totals as (select lang, source, coalesce(sum(n), 0) as total from g left join cells using (lang, source) group by 1, 2),
m as (select lang, source, term, coalesce(n, 0) as n, cast(1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // (total + 5 * v) as bigint) as p, cast(1 + (1000000000::hugeint * (in_lang + 5)) // (in_all + 5 * v) as bigint) as q
  from totals join langs using (lang) join kept using (lang) left join cells using (lang, source, term)),
pairs as (select a.lang, a.source, b.source as item, cast(coalesce(sum(abs(x.p - y.p)), 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join m x on x.lang = a.lang and x.source = a.source left join m y on y.lang = b.lang and y.source = b.source and y.term = x.term group by 1, 2, 3),
both_parts as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', term, p - q from m where n > 0 and p > q)
select lang, source, part, item, value, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as int) as rank from both_parts qualify part = 'pair' or rank <= 50""",
    "op12_url_rules": r"""
with u as (select page_id, row_number() over () as no, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(.*)$', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(.*)$', 2), '') as path, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(.*)$', 3), '') as rest from pages),
parts as (select *, unnest([{'mark': 'h:', 'part': host}, {'mark': 'p:', 'part': path}, {'mark': 'q:', 'part': rest}]) as x, unnest([1, 2, 3]) as part_no from u),
said as (select no, part_no, mark || unnest(f) as token, generate_subscripts(f, 1) as place from (select no, part_no, x.mark as mark, regexp_extract_all(translate(x.part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as f from parts)),
toks as (select no, token, row_number() over (partition by no order by part_no, place) as place from (select no, token, min(part_no) as part_no, min_by(place, part_no * 1000000 + place) as place from said group by no, token)),
named as (select no, try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') as bigint) as doc_id from u),
labelled as (select row_number() over () as id, no, coalesce(quality = 0, false) or coalesce(toxic = 1, false) as blocked from named join labels using (doc_id)),
n as (select count(*) as n, greatest(10, ceil(0.005 * count(*))) as enough, count(*) filter (blocked) as n_block from labelled),
t as (select id, blocked, token from (select id, blocked, token, row_number() over (partition by id order by place) as nth from labelled join toks using (no) where length(token) <= 64) where nth <= 16),
sets as (select blocked, [token] as s from t union all select a.blocked, [a.token, b.token] from t a join t b on a.id = b.id and a.token < b.token
  union all select a.blocked, [a.token, b.token, c.token] from t a join t b on a.id = b.id and a.token < b.token join t c on c.id = a.id and b.token < c.token),
stats as (select s, count(*) as covered, count(*) filter (blocked) as blocks from sets group by s),
sides as (select s, covered, blocks as n_right, 'block' as verdict from stats union all select s, covered, covered - blocks, 'allow' from stats),
rules as (select s, verdict, row_number() over (order by n_right / covered desc, n_right desc, len(s), s) as place from sides, n
  where n_right >= enough and 100 * n_right >= 80 * covered and n_right * n > covered * case verdict when 'block' then n_block else n - n_block end),
fits as (select no, min(place) as place from rules join (select no, list(token) as tokens from toks group by no) on list_has_all(tokens, s) group by no),
listed as (select *, case when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'block example.org/es/' when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'block example.org/en/1'
  when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'allow com/fr/' when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'block com/de/' when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'allow org/' end as rule_text from u)
select page_id, host, path, split_part(rule_text, ' ', 2) as rule, coalesce(split_part(rule_text, ' ', 1), verdict, 'allow') as verdict, case when rule_text is null then array_to_string(s, ' ') end as because
from listed left join fits using (no) left join rules using (place)""",
    "op13_fill_in_middle": r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tok,
  cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2, cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from d),
c as (select *, len(tok) as n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
k as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from c),
p as (select *, array_to_string(tok[1:a], '') as pre, array_to_string(tok[a + 1:b], '') as mid, array_to_string(tok[b + 1:], '') as suf from k)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256 from p""",
}
