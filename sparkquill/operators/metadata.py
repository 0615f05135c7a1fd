"""Metadata of sources and chunks: profiles by rules of paths, references carried over pages, rows of tables as text, terms, audits of encoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import views
from . import chunks as chunks_sql
from .chunks import ARTICLE, CIRCUIT, NUMBER, all_of, count, kind, references, section_type
from .evaluation import QUALIFIER
from .questions import FOLLOW_UP, mentions
from .retrieval import tokens
from .scoring import bare, longest

#: General words of five letters or more that are no topic.
STOPWORDS = ["donde", "cuando", "cuales", "cuanto", "sobre", "segun", "desde", "hasta", "estas", "estos", "deben", "entre", "hacia", "cuantos", "cuantas", "tiene", "seran", "seria", "puede", "podria", "suele", "hacer", "tener"]
#: Words that are long and say nothing; a user's list.
GENERIC = ["instalaciones", "documento", "documentos", "informacion", "descripcion", "siguiente", "anterior", "respuesta", "cualquier", "mediante"]
#: A line whose font was shifted, and the characters that it stands for.
SHIFTED = r"^[-0-9][A-Z\[\]]{3,}|(?:^|[^A-Za-z0-9À-ÿ])[A-Z\[\]]{4,}(?:[^A-Za-z0-9À-ÿ]|$)"
SHIFT = 31
#: Answers that say they are not complete; fixed values.
INSUFFICIENT = ["no hay informacion suficiente", "no tengo informacion suficiente", "no dispongo de contexto", "no hay contexto documental"]
PARTIAL_PHRASES = ["no se menciona", "no se especifica", "no se indica", "informacion parcial", "parcial"]


def path_profile(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """path, profile: that of the longest configured prefix that is the path or a folder of it; an equi-join on the path's folders."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hits = sources.select("path", F.explode(folders).alias("prefix")).join(profiles, "prefix")
    best = hits.groupBy("path").agg(F.max_by("profile", F.length("prefix")).alias("profile"))
    return sources.select("path").join(best, "path", "left").select("path", F.coalesce("profile", F.lit("general")).alias("profile"))


def source_profile(sources: DataFrame, overrides: DataFrame, profiles: DataFrame, terms: DataFrame) -> DataFrame:
    """path, domain, rule: the first that gives a domain: the metadata, an override for the file's name, the path's profile, a word or phrase of the path, its deepest folder, else 'general'."""
    rows = sources.select("path", "given", F.element_at(F.split("path", "/"), -1).alias("file"))
    by_path = path_profile(sources, profiles).where("profile <> 'general'")
    hinted = mentions(sources.select(F.col("path").alias("question_id"), F.col("path").alias("text")), terms).groupBy(F.col("question_id").alias("path")).agg(F.min_by("domain", F.struct("rule_no", "domain")).alias("hint"))
    folder = F.when(F.size(F.split("path", "/")) > 1, F.element_at(F.split("path", "/"), -2))
    rows = rows.join(overrides, "file", "left").join(by_path, "path", "left").join(hinted, "path", "left")
    rules = {"metadata": F.nullif("given", F.lit("")), "file": F.col("override"), "path": F.col("profile"), "hint": F.col("hint"), "folder": F.nullif(folder, F.lit("")), "general": F.lit("general")}
    rule = reduce(lambda c, r: c.when(r[1].isNotNull(), r[0]), rules.items(), F.when(F.lit(False), ""))
    return rows.select("path", F.coalesce(*rules.values()).alias("domain"), rule.alias("rule"))


def carried(chunks: DataFrame) -> DataFrame:
    """chunk_id, refs, section, level: the last article named before or in a chunk, over the pages of its document, is added to its references; a section that is missing is filled with it, and is of level 1 then."""
    own = F.transform(all_of(bare(F.col("text")), ARTICLE, 1), lambda x: F.concat(F.lit("articulo "), x.cast("int")))
    rows = chunks.withColumn("own", F.array_distinct(own))
    w = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("last_ref", F.last(F.when(F.size("own") > 0, F.element_at("own", -1)), ignorenulls=True).over(w))
    refs = F.when(F.col("last_ref").isNotNull(), F.array_union(F.array("last_ref"), "own")).otherwise(F.col("own"))
    section = F.coalesce(F.nullif("section", F.lit("")), "last_ref", F.lit(""))
    level = F.when((F.col("section") == "") & F.col("last_ref").isNotNull(), 1).when(section.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+"), 3).when(section.rlike(r"^[0-9]+\.[0-9]+"), 2).otherwise(1)
    return rows.select("chunk_id", F.array_join(refs, ", ").alias("refs"), section.alias("section"), level.alias("level"))


def chunk_profile(chunks: DataFrame) -> DataFrame:
    """chunk_id, kind, section_type, level, n_numbers, n_codes, refs, itc, title: the metadata of a chunk in one row; the title only of tables."""
    refs = references(chunks.select(F.col("chunk_id").alias("question_id"), "text")).select(F.col("question_id").alias("chunk_id"), F.col("articles").alias("refs"), "itc")
    level = F.when(F.col("section").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+"), 3).when(F.col("section").rlike(r"^[0-9]+\.[0-9]+"), 2).otherwise(1)
    rows = chunks.select("chunk_id", kind(F.col("text")).alias("kind"), section_type(F.col("section")).alias("section_type"), level.alias("level"), count(bare(F.col("text")), NUMBER).alias("n_numbers"), count(F.col("text"), CIRCUIT).alias("n_codes"), F.substring("text", 1, 40).alias("opening"))
    return rows.join(refs, "chunk_id").select("chunk_id", "kind", "section_type", "level", "n_numbers", "n_codes", "refs", "itc", F.when(F.col("kind") == "table", F.trim("opening")).alias("title"))


def page_refs(chunks: DataFrame, rules: DataFrame) -> DataFrame:
    """chunk_id, refs: the references (two digits, sorted) of rules whose pages of the source hold the chunk, or whose marker stands in it, with those it names itself."""
    hits = chunks.join(rules, "source").where(F.col("page").between(F.col("lo"), F.col("hi")) | F.contains(bare(F.col("text")), F.col("marker")))
    named = chunks.select("chunk_id", F.explode(F.transform(all_of(bare(F.col("text")), r"\bitc-bt-([0-9]{1,2})\b", 1), lambda x: F.concat(F.lit("itc-bt-"), F.lpad(x, 2, "0")))).alias("ref"))
    rows = hits.select("chunk_id", F.concat(F.regexp_extract("ref", "^(.*-)[0-9]+$", 1), F.lpad(F.regexp_extract("ref", "([0-9]+)$", 1), 2, "0")).alias("ref")).unionByName(named)
    return rows.groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("ref")), ", ").alias("refs"))


def rows_to_text(tables: DataFrame, legend: DataFrame) -> DataFrame:
    """table_id, row_no, row_text: 'TABLE_ROW. title. header: value; ...' of rows with two filled cells or more. The header is the first row, or the second if the first has one cell only; columns without a name are numbered; values of the legend are followed by what they mean. tables: table_id, title, row_no, cells."""
    filled = lambda c: F.size(F.filter(c, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))
    heads = tables.where("row_no <= 2").groupBy("table_id").agg(F.min_by("cells", F.struct(F.when(filled(F.col("cells")) >= 2, 0).otherwise(1), F.col("row_no"))).alias("header"), F.min_by("row_no", F.struct(F.when(filled(F.col("cells")) >= 2, 0).otherwise(1), F.col("row_no"))).alias("head_no"))
    meanings = legend.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("code", "meaning"))).alias("legend"))  # a small dictionary
    rows = tables.join(heads, "table_id").where((F.col("row_no") > F.col("head_no")) & (filled(F.col("cells")) >= 2)).crossJoin(F.broadcast(meanings))
    rows = rows.withColumn("width", F.greatest(F.size("cells"), F.size("header")))
    name = lambda i: F.coalesce(F.nullif(F.trim(F.get("header", i)), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string")))
    value = lambda i: F.trim(F.coalesce(F.get("cells", i), F.lit("")))
    said = lambda i: F.concat(name(i), F.lit(": "), value(i), F.coalesce(F.concat(F.lit(" ("), F.get(F.map_values(F.map_filter("legend", lambda k, v: k == value(i))), F.lit(0)), F.lit(")")), F.lit("")))
    parts = F.transform(F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda i: value(i) != ""), said)
    return rows.select("table_id", "row_no", F.concat(F.lit("TABLE_ROW. "), "title", F.lit(". "), F.array_join(parts, "; ")).alias("row_text"))


def terms(questions: DataFrame) -> DataFrame:
    """question_id, topic (words of five letters, six at most, in order), core (the four longest, then pairs of neighbours of ten characters, six in all), technical (words of eight letters that are not generic)."""
    words = F.filter(F.transform(tokens(F.col("text")), lambda t: bare(t)), lambda t: (F.length(t) >= 5) & ~t.isin(STOPWORDS))
    rows = questions.select("question_id", F.array_distinct(words).alias("w"), F.transform(tokens(F.col("text")), lambda t: bare(t)).alias("all"))
    pairs = F.filter(F.zip_with(F.slice("all", F.lit(1), F.greatest(F.size("all") - 1, F.lit(0))), F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)), lambda p: F.length(p) >= 10)
    core = F.slice(F.concat(longest(F.col("w"), 4), F.array_distinct(pairs)), 1, 6)
    technical = F.filter("w", lambda t: (F.length(t) >= 8) & t.rlike("^[a-z]+$") & ~t.isin(GENERIC))
    return rows.select("question_id", F.array_join(F.slice("w", 1, 6), " ").alias("topic"), F.array_join(core, "|").alias("core"), F.array_join(technical, " ").alias("technical"))


def encoding_audit(lines: DataFrame) -> DataFrame:
    """source, n_lines, n_shifted, share, repaired: lines whose capitals stand for letters SHIFT places on, and the first of them repaired, with the codes at its end as they are."""
    shifted = F.col("line").rlike(SHIFTED)
    wrong = "".join(chr(c) for c in range(64, 92))
    right = "".join(chr(c + SHIFT) for c in range(64, 92))
    tail = F.regexp_extract("line", r"((?:\s+[A-Z0-9]{1,3}){1,4}\s*)$", 1)
    body = F.substring("line", F.lit(1), F.length("line") - F.length(tail))
    rows = lines.select("source", "doc_id", "line_no", shifted.alias("shifted"), F.concat(F.translate(body, wrong, right), tail).alias("fixed"))
    out = rows.groupBy("source").agg(F.count("*").alias("n_lines"), F.count_if("shifted").alias("n_shifted"), F.min_by("fixed", F.when(F.col("shifted"), F.struct("doc_id", "line_no"))).alias("repaired"))
    return out.select("source", "n_lines", "n_shifted", F.round(F.col("n_shifted") / F.col("n_lines"), 6).alias("share"), F.when(F.col("n_shifted") > 0, F.col("repaired")).alias("repaired"))


def history_focus(turns: DataFrame, dictionary: DataFrame) -> DataFrame:
    """conv_id, turn, domains, inherited: the domains of a turn's own words; a follow-up, or a turn without any, takes those of the latest of the three turns before it that has some."""
    rows = turns.select("conv_id", "turn", F.struct("conv_id", "turn").alias("question_id"), "text")
    own = mentions(rows.select("question_id", "text"), dictionary).groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("own"))
    rows = rows.join(own, "question_id", "left").withColumn("follows", bare(F.col("text")).rlike(FOLLOW_UP))
    before = F.last("own", ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1))
    rows = rows.withColumn("before", before)
    takes = F.col("before").isNotNull() & (F.col("own").isNull() | (F.col("follows") & F.arrays_overlap(F.split("own", ","), F.split("before", ","))))
    both = F.array_join(F.array_sort(F.array_union(F.split("before", ","), F.split(F.coalesce("own", "before"), ","))), ",")
    return rows.select("conv_id", "turn", F.when(takes, both).otherwise(F.coalesce("own", F.lit(""))).alias("domains"), takes.alias("inherited"))


def answer_basis(answers: DataFrame) -> DataFrame:
    """model, basis, n, share: whether answers say they know nothing, only a part, or do not say so, and how often of each model."""
    low = F.lower("text")
    has = lambda words: reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in words))
    basis = F.when(has(INSUFFICIENT), "insufficient").when(has(PARTIAL_PHRASES), "partial").otherwise("explicit")
    out = answers.groupBy("model", basis.alias("basis")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("model")), 4))


def missing_qualifiers(turns: DataFrame) -> DataFrame:
    """conv_id, turn, missing, lost: whether the context has conditions, exceptions or limits and the answer none, and how many the answer lacks."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("before", F.lag("text").over(w)).where("role = 'assistant' and before is not null")
    pattern = rf"\b({QUALIFIER})\b"
    has = lambda c: F.array_distinct(all_of(F.lower(c), pattern, 1))
    rows = rows.select("conv_id", "turn", has(F.col("before")).alias("a"), has(F.col("text")).alias("b"))
    return rows.select("conv_id", "turn", ((F.size("a") > 0) & (F.size("b") == 0)).alias("missing"), F.size(F.array_except("a", "b")).alias("lost"))


SOURCES = "select path, case when doc_id % 9 = 0 then 'given' end as given from v_sources_all"
OVERRIDES = "select * from (values ('doc_12.pdf', 'special'), ('doc_13.md', 'special'), ('doc_9.pdf', 'never')) as t(file, override)"
PROFILES = "select prefix, profile from v_profiles"
HINTS = "select * from (values (1, 'doc 77', 'seventy'), (2, 'src4', 'fourth'), (3, 'fr', 'french')) as t(rule_no, term, domain)"
PAGES = "select * from (values ('src0', 1, 2, 'nada', 'itc-bt-1'), ('src0', 2, 4, 'nada', 'itc-bt-02'), ('src3', 1, 1, 'circuito', 'annex-1'), ('src1', 9, 9, 'puesta en marcha', 'itc-bt-7')) as t(source, lo, hi, marker, ref)"
TABLES = """
select s_suppkey as table_id, concat('supplier ', cast(s_suppkey as string)) as title, cast(r as bigint) as row_no, case r when 1 then case when s_suppkey % 2 = 0 then ARRAY_OF('sheet', '', '') else ARRAY_OF('name', 'nation', '') end when 2 then case when s_suppkey % 2 = 0 then ARRAY_OF('name', 'nation', '') else ARRAY_OF(s_name, cast(s_nationkey as string), 'K') end
 when 3 then ARRAY_OF(s_name, cast(s_nationkey as string), '') when 4 then ARRAY_OF('', '', 'X') else ARRAY_OF('  ', 'K', ' x ') end as cells from supplier cross join (select 1 as r union all select 2 union all select 3 union all select 4 union all select 5) t"""
LEGEND = "select * from (values ('K', 'checked'), ('3', 'three')) as t(code, meaning)"
LINES = "select source, doc_id, line_no, case when doc_id % 6 = 0 then concat('3HWTGP@FG@EQTTKGPVG ', 'U 2U') else line end as line from v_lines"
ANSWERS = "select case conv_id % 2 when 0 then 'm0' else 'm1' end as model, case conv_id % 5 when 0 then concat('No dispongo de contexto ', text) when 1 then concat(text, ' no se indica') else text end as text from conversations where role = 'assistant'"
TURNS = "select conv_id, turn, case turn % 5 when 0 then concat('tabla 3 1 y cliente ', text) when 1 then 'y eso del cliente' when 2 then 'seccion' else '...' end as text from conversations"
DICTIONARY = "select * from (values ('tabla 3 1', 'norms'), ('seccion', 'norms'), ('cliente', 'tenders')) as t(term, domain)"


def of(text: str):
    return lambda s, d: views.run(s, d, text)


norms = of("select * from v_norms")
QUERIES = {
    "path_profile_longest_prefix": lambda s, d: path_profile(of("select path from v_sources_all")(s, d), of(PROFILES)(s, d)),
    "source_profile": lambda s, d: source_profile(of(SOURCES)(s, d), of(OVERRIDES)(s, d), of(PROFILES)(s, d), of(HINTS)(s, d)),
    "structure_carry_forward": lambda s, d: carried(norms(s, d)),
    "chunk_profile": lambda s, d: chunk_profile(norms(s, d)),
    "page_range_refs": lambda s, d: page_refs(norms(s, d), of(PAGES)(s, d)),
    "row_to_text": lambda s, d: rows_to_text(of(TABLES)(s, d), of(LEGEND)(s, d)),
    "term_extractors": lambda s, d: terms(of("select * from v_questions")(s, d)),
    "encoding_audit": lambda s, d: encoding_audit(of(LINES)(s, d)),
    "history_inheritance": lambda s, d: history_focus(of(TURNS)(s, d), of(DICTIONARY)(s, d)),
    "answer_basis": lambda s, d: answer_basis(of(ANSWERS)(s, d)),
    "missing_qualifiers": lambda s, d: missing_qualifiers(s.read.parquet(f"{d}/conversations.parquet")),
}

_B = "lower(strip_accents(text))"
_REFS = chunks_sql.REFERENCES.replace("v_asks", "(select chunk_id as question_id, text from v_norms)")
_KIND = chunks_sql._KIND
_NORMS = f"n as (select *, {_B} as b from v_norms)"
SQL = {
    "path_profile_longest_prefix": views.oracle(f"with p as ({PROFILES}) select path, coalesce((select arg_max(profile, length(prefix)) from p where path = prefix or starts_with(path, prefix || '/')), 'general') as profile from v_sources_all"),
    "source_profile": views.oracle(rf"""
with s as ({SOURCES}), o as ({OVERRIDES}), p as ({PROFILES}), h as ({HINTS}), w as (select *, ' ' || regexp_replace(lower(path), '[^a-z0-9]+', ' ', 'g') || ' ' as q, string_split(path, '/') as parts from s),
f as (select path, given as r1, (select override from o where file = parts[-1]) as r2, (select arg_max(profile, length(prefix)) from p where path = prefix or starts_with(path, prefix || '/')) as r3, (select arg_min(domain, rule_no) from h where contains(q, ' ' || term || ' ')) as r4, case when len(parts) > 1 then parts[-2] end as r5 from w)
select path, coalesce(r1, r2, r3, r4, r5, 'general') as domain, case when r1 is not null then 'metadata' when r2 is not null then 'file' when r3 is not null then 'path' when r4 is not null then 'hint' when r5 is not null then 'folder' else 'general' end as rule from f"""),
    "structure_carry_forward": views.oracle(rf"""
with {_NORMS}, a as (select *, list_transform(regexp_extract_all(b, '{ARTICLE}', 1), lambda x: 'articulo ' || x::int) as own from n), c as (select *, last_value(own[-1] ignore nulls) over (partition by doc_id order by chunk rows between unbounded preceding and current row) as r from a),
e as (select chunk_id, section, r, unnest(case when r is null then own else list_concat([r], own) end) as x, unnest(range(1, len(case when r is null then own else list_concat([r], own) end) + 1)) as i from c), g as (select chunk_id, string_agg(x, ', ' order by i) as refs from (select chunk_id, x, min(i) as i from e group by 1, 2) z group by 1)
select c.chunk_id, coalesce(refs, '') as refs, coalesce(nullif(section, ''), r, '') as section, 1 as level from c left join g using (chunk_id)"""),
    "page_range_refs": views.oracle(rf"""
with {_NORMS}, p as ({PAGES}), r as (select chunk_id, regexp_extract(ref, '^(.*-)[0-9]+$', 1) || lpad(regexp_extract(ref, '[0-9]+$'), 2, '0') as ref from n join p on p.source = n.source and (page between lo and hi or contains(b, marker)) union select chunk_id, 'itc-bt-' || lpad(unnest(regexp_extract_all(b, '\bitc-bt-([0-9]{{1,2}})\b', 1)), 2, '0') from n)
select chunk_id, string_agg(distinct ref, ', ' order by ref) as refs from r group by 1"""),
    "row_to_text": views.oracle("""
select s_suppkey as table_id, 3 as row_no, 'TABLE_ROW. supplier ' || s_suppkey || '. name: ' || s_name || '; nation: ' || s_nationkey || case when s_nationkey = 3 then ' (three)' else '' end as row_text from supplier
union all select s_suppkey, 5, 'TABLE_ROW. supplier ' || s_suppkey || '. nation: K (checked); column_3: x' from supplier
union all select s_suppkey, 2, 'TABLE_ROW. supplier ' || s_suppkey || '. name: ' || s_name || '; nation: ' || s_nationkey || case when s_nationkey = 3 then ' (three)' else '' end || '; column_3: K (checked)' from supplier where s_suppkey % 2 = 1"""),
    "term_extractors": views.oracle(rf"""
with t as (select question_id, list_transform(regexp_extract_all(lower(text), '\p{{L}}{{4,}}'), lambda x: strip_accents(x)) as a from v_questions), u as (select question_id, a, unnest(a) as x, unnest(range(1, len(a) + 1)) as i from t),
d as (select question_id, x, min(i) as i from u where length(x) >= 5 and x not in ({", ".join(repr(w) for w in STOPWORDS)}) group by 1, 2), o as (select question_id, list(x order by i) as w, list(x order by length(x) desc, x)[1:4] as big, list(x order by i) filter (length(x) >= 8 and regexp_matches(x, '^[a-z]+$') and x not in ({", ".join(repr(w) for w in GENERIC)})) as tech from d group by 1),
b as (select question_id, p, min(i) as i from (select question_id, i, x || ' ' || lead(x) over (partition by question_id order by i) as p from u) z where length(p) >= 10 group by 1, 2), e as (select question_id, list(p order by i) as pairs from b group by 1)
select t.question_id, coalesce(array_to_string(w[1:6], ' '), '') as topic, coalesce(array_to_string(list_concat(coalesce(big, []), coalesce(pairs, []))[1:6], '|'), '') as core, coalesce(array_to_string(tech, ' '), '') as technical from t left join o using (question_id) left join e using (question_id)"""),
    "encoding_audit": views.oracle(rf"""
with l as ({LINES}), m as (select *, regexp_matches(line, '{SHIFTED}') as bad, regexp_extract(line, '((?:\s+[A-Z0-9]{{1,3}}){{1,4}}\s*)$', 1) as tail from l), f as (select *, translate(line[1:length(line) - length(tail)], '{"".join(chr(c) for c in range(64, 92))}', '{"".join(chr(c + SHIFT) for c in range(64, 92))}') || tail as fixed from m)
select source, count(*) as n_lines, count(*) filter (bad) as n_shifted, round(count(*) filter (bad)::double / count(*), 6) as share, arg_min(fixed, (doc_id, line_no)) filter (bad) as repaired from f group by source"""),
    "history_inheritance": f"""
with t as ({TURNS}), o as (select conv_id, turn, case turn % 5 when 0 then 'norms,tenders' when 1 then 'tenders' when 2 then 'norms' end as own, regexp_matches({_B}, '{FOLLOW_UP}') as f from t), p as (select *, last_value(own ignore nulls) over (partition by conv_id order by turn rows between 3 preceding and 1 preceding) as prev from o),
k as (select *, prev is not null and (own is null or (f and list_has_any(string_split(own, ','), string_split(prev, ',')))) as inherited from p)
select conv_id, turn, case when inherited then array_to_string(list_sort(list_distinct(list_concat(string_split(prev, ','), string_split(coalesce(own, prev), ',')))), ',') else coalesce(own, '') end as domains, inherited from k""",
    "answer_basis": f"""
with a as ({ANSWERS}), b as (select model, case when {" or ".join(f"contains(lower(text), '{w}')" for w in INSUFFICIENT)} then 'insufficient' when {" or ".join(f"contains(lower(text), '{w}')" for w in PARTIAL_PHRASES)} then 'partial' else 'explicit' end as basis from a)
select model, basis, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by model), 4) as share from b group by 1, 2""",
    "missing_qualifiers": rf"""
with t as (select conv_id, turn, role, text, lag(text) over (partition by conv_id order by turn) as before from conversations), q as (select conv_id, turn, list_distinct(regexp_extract_all(lower(before), '\b({QUALIFIER})\b', 1)) as a, list_distinct(regexp_extract_all(lower(text), '\b({QUALIFIER})\b', 1)) as b from t where role = 'assistant' and before is not null)
select conv_id, turn, len(a) > 0 and len(b) = 0 as missing, len(list_filter(a, lambda x: not list_contains(b, x))) as lost from q""",
}
SQL["chunk_profile"] = views.oracle(rf"""
with {_NORMS}, k as (select question_id as chunk_id, articles, itc from ({_REFS}) x) select n.chunk_id, {_KIND} as kind, case when section = '' then '' when starts_with(lower(strip_accents(section)), 'articulo') then 'article' when starts_with(lower(strip_accents(section)), 'capitulo') then 'chapter' else 'section' end as section_type, 1 as level,
 len(regexp_extract_all(b, '{NUMBER}')) as n_numbers, len(regexp_extract_all(text, '{CIRCUIT}')) as n_codes, articles as refs, itc, case when ({_KIND}) = 'table' then trim(text[1:40]) end as title from n join k on k.chunk_id = n.chunk_id""")
