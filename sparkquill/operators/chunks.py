"""Text and chunk metadata: headings, references, numbers, labels, kinds and signals as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import views
from .scoring import bare

#: Lengths of a heading, and the patterns that texts of this kind are read with (on text without accents, but for the first two).
LABEL, LABEL_WORDS = 80, 10
HEADING = r"^(?:[0-9]+(?:\.[0-9]+)*[.)]?\s+)?[A-ZÁÉÍÓÚÜÑ][A-ZÁÉÍÓÚÜÑa-záéíóúüñ\s\-/,:()]{3,}$"
NORMATIVE = r"^(?:art(?:iculo|\.?)\s+[0-9]+[.\s-]+.+|it\s+[0-9]+(?:\.[0-9]+){0,2}[.\s-]+.+|itc[-\s]*(?:bt|lat|rat)[-\s]*[0-9]+.*|[0-9]+(?:\.[0-9]+){0,4}[.)]?\s+[a-z].+|(?:disposicion|anexo|capitulo|titulo|instruccion)\s+.+)$"
LEADERS = r"\.\s*\.\s*\.\s*\."
ARTICLES = r"\bart(?:iculo|\.?)\s+[0-9]+\b"
ROW_CUE = r"(?:\b(?:c[0-9]{1,2}|itc[-\s]*[a-z]{1,4}[-\s]*[0-9]+|ip[0-9]{2}|ik[0-9]{2})\b|\s{2,}|[;|]|\b(?:fase|circuito|uso|proteccion|potencia|seccion|denominacion|descripcion)\b)"
CIRCUIT = r"\b[Cc](?:1[0-3]?|[1-9])\b"
TABLE_WORD = r"\b(?:circuito|fase|uso|potencia|seccion|proteccion)\b"
LIST_CUE = r"(?:^|\n)(?:[-*]\s+|[0-9]+\.\s+)"
NUMBER = r"\b[0-9]+(?:[.,][0-9]+)?\s*(?:a/mm2|mm2|m2|kva|kw|ma|kv|cm|mm|m|bar|hz|ohmios?|ohm|w|v|a)?\b"
TOC_LINE = r"\.{3,}\s*[0-9]+\s*$"
ONLY_NUMBERS = r"^[0-9\s\-/.,:;()]+$"
REFERENCE = r"\b(?:itc[-\s]*(?:bt|lat|rat)[-\s]*[0-9]+|art(?:iculo)?\.?\s*[0-9]+|tabla\s*[0-9]+|(?:rd|real\s+decreto)[-\s]*[0-9]{1,4}\s*/\s*[0-9]{4})\b"
IT_SECTION, ARTICLE, PAGE = r"\bit\s+([0-9]+(?:\.[0-9]+){0,2})\b", r"\bart(?:iculo|\.)?\s*([0-9]{1,3})\b", r"\b(?:pagina|pag|page)\.?\s*([0-9]{1,4})\b"
ITC, TABLE, DECREE = r"\b(?:itc|guia)[-\s]*(?:(?:bt|lat|rat)[-\s]*)?[0-9]{1,2}\b", r"\btabla\s*([0-9]{1,3}(?:\.[0-9]+)?)\b", r"\b(?:rd|real\s+decreto)[-\s]*([0-9]{1,4}\s*/\s*[0-9]{4})\b"
LABELS = {"clase": r"\bclase\s+(i{1,3}|iv|v|vi|vii|viii|ix|x|[0-9]+|[a-z])\b", "tipo": r"\btipo\s+([a-z0-9]+)\b", "categoria": r"\bcategoria\s+([a-z0-9]+)\b", "grado_ip": r"\bip\s?([0-9]{2}[a-z]?)\b", "grado_ik": r"\bik\s?([0-9]{2})\b", "esquema": r"\b(tt|tn(?:-?[sc])?|it)\b"}
PRINTED_PAGE = r"[–-]\s*([0-9]{1,4})\s*[–-]"
#: Words of a kind of content, and of the places that a rule holds for; inputs of a user.
INTENTS = {"procedure": ["procedimiento", "pasos", "puesta en marcha", "ejecucion"], "scope": ["objeto", "campo de aplicacion", "ambito"], "requirement": ["debe", "deben", "distancia minima", "no sera superior", "no debera"]}
SCOPES = ["local", "emplazamiento", "vivienda", "red subterranea", "instalacion interior", "generadora", "exterior", "interior", "quirofano", "recarga"]


def cleaned(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[ \t\n\r]+", " "))


def n_words(text: Column) -> Column:
    return F.size(F.split(text, " "))


def is_normative(line: Column) -> Column:
    return bare(line).rlike(NORMATIVE)


def is_heading(line: Column) -> Column:
    """A line that names a section: of the form that rules have, or short, in title case and without a stop."""
    short = (F.length(line) <= LABEL) & (n_words(line) <= LABEL_WORDS) & ~line.endswith(".") & ~(F.contains(line, F.lit(",")) & (n_words(line) > 6))
    return (line != "") & F.when(is_normative(line), F.length(line) <= LABEL).otherwise(short & line.rlike(HEADING))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once, also where lambdas in it use it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def headings(lines: DataFrame) -> DataFrame:
    """chunk_id, is_heading, heading, rest: a heading that stands at the start of a line with text behind it is cut off."""
    lines = lines.withColumn("line", cleaned(F.col("text")))
    line = F.col("line")
    whole = is_heading(line) | line.rlike(LEADERS) | (F.regexp_count(bare(line), F.lit(ARTICLES)) >= 2)
    # every part has a character, so a heading has (LABEL + 1) / 2 of them at most; of a longer one, LABEL + 1 characters say that it is no heading
    starts = lambda parts: F.transform(F.slice(parts, 1, (LABEL + 1) // 2), lambda x: F.substring(x, 1, LABEL + 1))
    heads = lambda p, n: F.transform(F.sequence(F.lit(1), F.least(n - 1, F.size(p))), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(p, 1, i), " ").alias("head")))
    behind = lambda parts, i: F.slice(parts, i + 1, F.size(parts))
    good = lambda parts, x: (F.length(x["head"]) <= LABEL) & is_normative(x["head"]) & ~bare(x["head"]).rlike(r"^it\s+[0-9]+(?:\.[0-9]+){0,2}\.?$") & F.exists(behind(parts, x["n"]), lambda r: r.rlike("[A-Za-zÀ-ÿ]"))
    first = lambda parts: F.when(F.size(parts) > 1, F.get(F.filter(let(starts(parts), lambda p: heads(p, F.size(parts))), lambda x: good(parts, x)), F.lit(0)))
    rest = lambda parts, x: F.ltrim(F.array_join(behind(parts, x["n"]), " "), F.lit(" .;:"))
    cut = let(F.split(line, r"(?<=[.:;])\s+"), lambda parts: let(first(parts), lambda x: F.when(x.isNotNull() & ~whole, F.struct(x["head"].alias("head"), rest(parts, x).alias("rest")))))
    # a generated column: a filter on it is not pushed below, where all of this would be done again
    lines = lines.select("chunk_id", "line", is_heading(line).alias("is_heading"), F.explode(F.array(cut)).alias("cut"))
    return lines.select("chunk_id", "is_heading", F.coalesce("cut.head", F.lit("")).alias("heading"), F.coalesce("cut.rest", "line").alias("rest"))


def noise(chunks: DataFrame) -> DataFrame:
    """chunk_id, is_noise: too short, numbers only, few letters, mostly lines of a table of contents, or the same word over and over."""
    text = F.trim("text")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    few = F.length(F.regexp_replace(text, r"[^A-Za-zÀ-ÖØ-öø-ÿ]", "")) < 0.3 * F.length(text)
    toc = F.size(F.filter(lines, lambda x: x.rlike(TOC_LINE))) > 0.5 * F.size(lines)
    same = (F.size(words) >= 4) & (F.size(F.array_distinct(F.transform(words, F.lower))) <= 2)
    return chunks.select("chunk_id", ((F.length(text) < 40) | text.rlike(ONLY_NUMBERS) | few | toc | same).alias("is_noise"))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def kind(text: Column) -> Column:
    cues = count(bare(text), ROW_CUE)
    table = F.contains(bare(text), F.lit("tabla")) | (count(text, CIRCUIT) >= 2) | (cues >= 3) | ((count(text, LIST_CUE) >= 2) & (cues >= 2))
    return F.when(table, "table").when(bare(text).rlike(NUMBER), "numeric").otherwise("text")


def signals(chunks: DataFrame) -> DataFrame:
    """chunk_id, kind, intent, scopes, table_signals, printed_page of each chunk (section, text)."""
    normal = bare(F.concat_ws(" ", "section", "text"))
    chunks = chunks.withColumns({"kind": kind(F.col("text")), "normal": normal})
    has = lambda words: reduce(Column.__or__, (F.contains("normal", F.lit(w)) for w in words))
    intent = F.when((F.col("kind") == "table") | has(["tabla"]), "table").when(F.col("normal").rlike(NUMBER), "numeric_value")
    for name, words in INTENTS.items():
        intent = intent.when(has(words), name)
    scopes = F.filter(F.array(*(F.when(F.contains("normal", F.lit(w)), w) for w in SCOPES)), lambda x: x.isNotNull())
    section = F.trim(bare(F.col("section")))
    scopes = F.when(F.size(scopes) > 0, F.array_join(F.slice(scopes, 1, 8), ", ")).when(F.length(section) >= 6, F.substring(section, 1, 60)).otherwise("")
    return chunks.select("chunk_id", "kind", intent.otherwise("text").alias("intent"), scopes.alias("scopes"), (count(F.col("text"), CIRCUIT) + count(bare(F.col("text")), TABLE_WORD)).alias("table_signals"), F.regexp_extract("text", PRINTED_PAGE, 1).alias("printed_page"))


def section_type(section: Column) -> Column:
    s = bare(section)
    rules = {"article": r"^(articulo|art\.)", "itc": "^itc[- ]", "technical_instruction": r"^it\s+[0-9]+", "annex": "^anexo", "disposition": "^disposicion", "chapter": "^(capitulo|titulo)", "numbered_section": "^[0-9]+"}
    return reduce(lambda c, r: c.when(s.rlike(r[1]), r[0]), rules.items(), F.when(F.coalesce(section, F.lit("")) == "", "")).otherwise("section")


def all_of(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def references(questions: DataFrame) -> DataFrame:
    """question_id and what a text refers to: free, it_sections, articles, exact (each in the spellings it is looked up by, sorted), pages (five at most), itc (eight at most, sorted)."""
    q = questions.select("question_id", bare(F.col("text")).alias("q"))
    squeeze = lambda x: F.regexp_replace(x, r"\s+", " ")
    free = F.transform(all_of(F.col("q"), REFERENCE, 0), squeeze)
    articles = F.array_distinct(F.transform(all_of(F.col("q"), ARTICLE, 1), lambda x: F.concat(F.lit("articulo "), x.cast("int"))))
    found = all_of(F.col("q"), ITC, 0)
    family = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, "(bt|lat|rat)", 1), F.lit("")), F.lit("bt"))
    number = lambda x: F.lpad(F.regexp_extract(x, "([0-9]+)$", 1), 2, "0")
    itc = F.flatten(F.transform(found, lambda x: F.array(F.concat(F.lit("itc-"), family(x), F.lit("-"), number(x)), F.concat(F.lit("itc "), family(x), F.lit(" "), number(x)), F.concat(family(x), F.lit("-"), number(x)))))
    tables = F.transform(all_of(F.col("q"), TABLE, 1), lambda x: F.concat(F.lit("tabla "), F.regexp_replace(x, "^0+([0-9])", "$1")))
    decrees = F.flatten(F.transform(F.transform(all_of(F.col("q"), DECREE, 1), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", ""), "^0+([0-9])", "$1")), lambda x: F.array(F.concat(F.lit("rd "), x), F.concat(F.lit("real decreto "), x))))
    exact = F.array_sort(F.array_distinct(F.concat(itc, tables, decrees)))
    pages = F.array_distinct(F.filter(F.transform(all_of(F.col("q"), PAGE, 1), lambda x: x.cast("int")), lambda x: x > 0))
    codes = F.array_sort(F.array_distinct(F.transform(found, lambda x: F.concat(F.lit("ITC-"), F.upper(family(x)), F.lit("-"), number(x)))))
    join = lambda a: F.array_join(a, ", ")
    its = F.array_distinct(F.transform(all_of(F.col("q"), IT_SECTION, 1), lambda x: F.concat(F.lit("it "), x)))
    return q.select("question_id", join(free).alias("free"), join(its).alias("it_sections"), join(articles).alias("articles"), join(exact).alias("exact"), join(F.slice(pages, 1, 5)).alias("pages"), join(F.slice(codes, 1, 8)).alias("itc"))


def numbers(questions: DataFrame) -> DataFrame:
    """question_id, terms (numbers with their units), variants (compact, spaced, one decimal as two; twelve at most) and standalone (numbers outside references, ten at most)."""
    q = questions.select("question_id", bare(F.col("text")).alias("q"))
    terms = F.transform(all_of(F.col("q"), NUMBER, 0), lambda x: F.trim(x))
    compact = lambda x: F.regexp_replace(x, r"\s+", "")
    spaced = lambda x: F.regexp_replace(x, r"^([0-9]+(?:[.,][0-9]+)?)([^0-9\s].*)$", "$1 $2")
    widen = lambda x: F.concat(F.regexp_extract(x, r"^([0-9]+[.,][0-9])([^0-9]*)$", 1), F.lit("0"), F.regexp_extract(x, r"^([0-9]+[.,][0-9])([^0-9]*)$", 2))
    one_decimal = lambda x: x.rlike(r"^[0-9]+[.,][0-9][^0-9]*$")
    of = lambda t: F.concat(F.array(t, compact(t), spaced(compact(t))), F.when(one_decimal(compact(t)), F.array(widen(compact(t)), spaced(widen(compact(t))))).otherwise(F.array().cast("array<string>")))
    variants = F.slice(F.array_distinct(F.flatten(F.transform(terms, of))), 1, 12)
    rest = reduce(lambda c, p: F.regexp_replace(c, p, " "), (ITC, TABLE, PAGE), F.col("q"))
    alone = F.flatten(F.transform(all_of(rest, r"[0-9]+(?:[.,][0-9]+)?", 0), lambda x: F.when(x.rlike("^[0-9]+[.,][0-9]$"), F.array(x, F.concat(x, F.lit("0")))).otherwise(F.array(x))))
    join = lambda a: F.array_join(a, "|")
    return q.select("question_id", join(terms).alias("terms"), join(variants).alias("variants"), join(F.slice(F.array_distinct(alone), 1, 10)).alias("standalone"))


def labels(questions: DataFrame) -> DataFrame:
    """question_id, family, label: the labels of each family that a text has; from a map of families to arrays."""
    q = questions.select("question_id", bare(F.col("text")).alias("q"))
    found = F.create_map(*(x for n, p in LABELS.items() for x in (F.lit(n), F.array_distinct(all_of(F.col("q"), p, 1)))))
    return q.select("question_id", F.explode(F.map_filter(found, lambda k, v: F.size(v) > 0)).alias("family", "values")).select("question_id", "family", F.array_join(F.array_sort("values"), ",").alias("labels"))


def html_lines(pages: DataFrame) -> DataFrame:
    """page_id, line_no, line: the paragraphs and list items of a page, up to their end tag or the next block, without tags, with character references decoded, without those that are empty."""
    breaks = r"(?is)<(?:p|li)(?=[\s>])[^>]*>(.*?)(?=</?(?:p|li|ul|ol|div|h[1-6]|section|article|aside|nav|header|footer|form|table|body|html|main)(?=[\s>/])|$)"
    found = pages.select("page_id", F.posexplode(all_of(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)\s*>|<!--.*?-->", ""), breaks, 1)).alias("at", "raw"))
    line = F.regexp_replace(F.regexp_replace(F.col("raw"), r"(?i)<br[^>]*>", " "), "<[^>]*>", "")
    for name, value in ENTITIES.items():
        line = F.replace(line, F.lit(f"&{name};"), F.lit(value))
    line = cleaned(line)
    w = Window.partitionBy("page_id").orderBy("at")
    return found.select("page_id", "at", line.alias("line")).where("line <> ''").select("page_id", F.row_number().over(w).alias("line_no"), "line")


#: Fixed values of HTML: character references by name; the ampersand last.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "nbsp": " ", "copy": "©", "ndash": "–", "mdash": "—", "hellip": "…", "eacute": "é", "amp": "&"}


def path_tokens(sources: DataFrame) -> DataFrame:
    """path, tokens: the words of a file name and every run of its parts between hyphens, joined by hyphens."""
    normal = F.replace(bare(F.col("path")), F.lit("/"), F.lit(" "))
    parts = F.transform(F.split(normal, r"[\s_]+"), lambda p: F.filter(F.split(p, "-"), lambda s: s != ""))
    runs = lambda p: F.flatten(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.transform(F.sequence(F.lit(1), F.size(p) - i + 1), lambda n: F.array_join(F.slice(p, i, n), "-"))))
    compound = F.flatten(F.transform(F.filter(parts, lambda p: F.size(p) > 0), runs))
    tokens = F.array_sort(F.array_distinct(F.concat(all_of(normal, "[a-z0-9&]+", 0), compound)))
    return sources.select("path", F.array_join(tokens, " ").alias("tokens"))


def toc(chunks: DataFrame) -> DataFrame:
    """chunk_id, is_toc: on one of the first four pages, with four articles or more, and dot leaders or a chapter."""
    raw = F.concat_ws(" ", "section", "text")
    hit = (count(bare(raw), r"articulo\s+[0-9]+") >= 4) & (raw.rlike(LEADERS) | bare(raw).rlike(r"capitulo\s+[ivxlcdm]+"))
    return chunks.select("chunk_id", (F.col("page").between(1, 4) & hit).alias("is_toc"))


def of(text: str):
    return lambda s, d: views.run(s, d, text)


norms, asks = of("select * from v_norms"), of("select * from v_asks")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.run(spark, sf_dir, "select replace(path, '/doc_', '/itc-doc-') as path from v_sources_all")


QUERIES = {
    "heading_detect": lambda s, d: headings(norms(s, d)).select("chunk_id", "is_heading"),
    "inline_heading_split": lambda s, d: headings(norms(s, d)).where("heading <> ''").select("chunk_id", "heading", "rest"),
    "noise_filter": lambda s, d: noise(norms(s, d)),
    "chunk_kind": lambda s, d: norms(s, d).select("chunk_id", kind(F.col("text")).alias("kind")),
    "chunk_signals": lambda s, d: signals(norms(s, d)),
    "section_type": lambda s, d: norms(s, d).select("chunk_id", section_type(F.col("text")).alias("kind")),
    "extract_refs": lambda s, d: references(asks(s, d)),
    "numeric_terms": lambda s, d: numbers(asks(s, d)),
    "labeled_terms": lambda s, d: labels(asks(s, d)),
    "html_line_blocks": lambda s, d: html_lines(s.read.parquet(f"{d}/pages.parquet")),
    "path_tokens": lambda s, d: path_tokens(sources(s, d)),
    "toc_detect": lambda s, d: toc(norms(s, d)),
}

_BARE = "lower(strip_accents({0}))"
_LINE = "trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))"
_NORMS = f"n as (select *, {_LINE} as line, {_BARE.format('text')} as b from v_norms)"
_HEAD = f"case when line = '' then false when regexp_matches({_BARE.format('line')}, '{NORMATIVE}') then length(line) <= 80 else length(line) <= 80 and len(string_split(line, ' ')) <= 10 and not ends_with(line, '.') and not (contains(line, ',') and len(string_split(line, ' ')) > 6) and regexp_matches(line, '{HEADING}') end"
_KIND = f"case when contains(b, 'tabla') or len(regexp_extract_all(text, '{CIRCUIT}')) >= 2 or len(regexp_extract_all(b, '{ROW_CUE}')) >= 3 or (len(regexp_extract_all(text, '{LIST_CUE}')) >= 2 and len(regexp_extract_all(b, '{ROW_CUE}')) >= 2) then 'table' when regexp_matches(b, '{NUMBER}') then 'numeric' else 'text' end"
_ASKS = f"q as (select question_id, {_BARE.format('text')} as q from v_asks)"
_HAS = lambda words: " or ".join(f"contains(c, '{w}')" for w in words)
_ENTITY = "line"
for _n, _v in ENTITIES.items():
    _ENTITY = f"replace({_ENTITY}, '&{_n};', '{_v.replace(chr(39), chr(39) * 2)}')"
REFERENCES = rf"""
with {_ASKS}, f as (select *, regexp_extract_all(q, '{ITC}') as itcs from q),
c as (select question_id, q, list_transform(itcs, lambda x: {{'p': coalesce(nullif(regexp_extract(x, 'bt|lat|rat'), ''), 'bt'), 'n': lpad(regexp_extract(x, '[0-9]+$'), 2, '0')}}) as codes from f)
select question_id, array_to_string(list_transform(regexp_extract_all(q, '{REFERENCE}'), lambda x: regexp_replace(x, '\s+', ' ', 'g')), ', ') as free,
 array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(q, '{IT_SECTION}', 1), lambda x, i: [x, i::varchar]), lambda y: list_position(regexp_extract_all(q, '{IT_SECTION}', 1), y[1])::varchar = y[2]), lambda y: 'it ' || y[1]), ', ') as it_sections,
 array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(q, '{ARTICLE}', 1), lambda x, i: [x::int, i]), lambda y: list_position(list_transform(regexp_extract_all(q, '{ARTICLE}', 1), lambda z: z::int), y[1]) = y[2]), lambda y: 'articulo ' || y[1]), ', ') as articles,
 array_to_string(list_sort(list_distinct(list_concat(flatten(list_transform(codes, lambda x: ['itc-' || x.p || '-' || x.n, 'itc ' || x.p || ' ' || x.n, x.p || '-' || x.n])), list_concat(list_transform(regexp_extract_all(q, '{TABLE}', 1), lambda x: 'tabla ' || regexp_replace(x, '^0+([0-9])', '\1')), flatten(list_transform(list_transform(regexp_extract_all(q, '{DECREE}', 1), lambda x: regexp_replace(regexp_replace(x, '\s+', '', 'g'), '^0+([0-9])', '\1')), lambda x: ['rd ' || x, 'real decreto ' || x])))))), ', ') as exact,
 array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(q, '{PAGE}', 1), lambda x, i: [x::int, i]), lambda y: y[1] > 0 and list_position(list_transform(regexp_extract_all(q, '{PAGE}', 1), lambda z: z::int), y[1]) = y[2])[1:5], lambda y: y[1]), ', ') as pages,
 array_to_string(list_sort(list_distinct(list_transform(codes, lambda x: 'ITC-' || upper(x.p) || '-' || x.n)))[1:8], ', ') as itc from c"""
SQL = {
    "heading_detect": views.oracle(f"with {_NORMS} select chunk_id, {_HEAD} as is_heading from n"),
    "inline_heading_split": views.oracle(rf"""
with {_NORMS}, s as (select chunk_id, line, string_split(regexp_replace(line, '([.:;])\s+', '\1' || chr(10), 'g'), chr(10)) as parts from n where not ({_HEAD}) and not regexp_matches(line, '{LEADERS}') and len(regexp_extract_all(b, '{ARTICLES}')) < 2),
c as (select chunk_id, parts, unnest(range(1, len(parts))) as i from s where len(parts) > 1), h as (select chunk_id, i, array_to_string(parts[1:i], ' ') as heading, ltrim(array_to_string(parts[i + 1:], ' '), ' .;:') as rest from c),
g as (select * from h where length(heading) <= 80 and regexp_matches(rest, '[A-Za-zÀ-ÿ]') and regexp_matches({_BARE.format('heading')}, '{NORMATIVE}') and not regexp_matches({_BARE.format('heading')}, '^it\s+[0-9]+(?:\.[0-9]+){{0,2}}\.?$'))
select chunk_id, heading, rest from g qualify row_number() over (partition by chunk_id order by i) = 1"""),
    "noise_filter": views.oracle(rf"""
with t as (select chunk_id, trim(text) as t from v_norms), w as (select *, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') as words from t)
select chunk_id, length(t) < 40 or regexp_matches(t, '{ONLY_NUMBERS}') or length(regexp_replace(t, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) < 0.3 * length(t) or len(list_filter(lines, lambda x: regexp_matches(x, '{TOC_LINE}'))) > 0.5 * len(lines) or (len(words) >= 4 and len(list_distinct(list_transform(words, lambda x: lower(x)))) <= 2) as is_noise from w"""),
    "chunk_kind": views.oracle(f"with {_NORMS} select chunk_id, {_KIND} as kind from n"),
    "chunk_signals": views.oracle(f"""
with {_NORMS}, k as (select *, {_KIND} as kind, {_BARE.format("section || ' ' || text")} as c, trim({_BARE.format('section')}) as s from n),
f as (select *, list_filter([{", ".join(f"case when contains(c, '{w}') then '{w}' end" for w in SCOPES)}], lambda x: x is not null) as found from k)
select chunk_id, kind, case when kind = 'table' or contains(c, 'tabla') then 'table' when regexp_matches(c, '{NUMBER}') then 'numeric_value' {" ".join(f"when {_HAS(w)} then '{i}'" for i, w in INTENTS.items())} else 'text' end as intent,
 case when len(found) > 0 then array_to_string(found[1:8], ', ') when length(s) >= 6 then s[1:60] else '' end as scopes, len(regexp_extract_all(text, '{CIRCUIT}')) + len(regexp_extract_all(b, '{TABLE_WORD}')) as table_signals, regexp_extract(text, '{PRINTED_PAGE}', 1) as printed_page from f"""),
    "section_type": views.oracle(f"with {_NORMS} select chunk_id, case when text = '' then '' when starts_with(b, 'articulo') or starts_with(b, 'art.') then 'article' when starts_with(b, 'itc-') or starts_with(b, 'itc ') then 'itc' when regexp_matches(b, '^it +[0-9]') then 'technical_instruction' when starts_with(b, 'anexo') then 'annex' when starts_with(b, 'disposicion') then 'disposition' when starts_with(b, 'capitulo') or starts_with(b, 'titulo') then 'chapter' when regexp_matches(b, '^[0-9]') then 'numbered_section' else 'section' end as kind from n"),
    "extract_refs": views.oracle(REFERENCES),
    "numeric_terms": views.oracle(rf"""
with {_ASKS}, t as (select question_id, list_transform(regexp_extract_all(q, '{NUMBER}'), lambda x: trim(x)) as terms, regexp_replace(regexp_replace(regexp_replace(q, '{ITC}', ' ', 'g'), '{TABLE}', ' ', 'g'), '{PAGE}', ' ', 'g') as rest from q),
e as (select question_id, terms, unnest(range(1, len(terms) + 1)) as i, regexp_replace(terms[i], '\s+', '', 'g') as c from t),
w as (select *, case when regexp_matches(c, '^[0-9]+[.,][0-9][^0-9]*$') then regexp_replace(c, '^([0-9]+[.,][0-9])', '\1' || '0') end as d from e),
v as (select question_id, i, unnest([terms[i], c, regexp_replace(c, '^([0-9]+(?:[.,][0-9]+)?)([^0-9 ].*)$', '\1 \2'), d, regexp_replace(d, '^([0-9]+(?:[.,][0-9]+)?)([^0-9 ].*)$', '\1 \2')]) as x, unnest([1, 2, 3, 4, 5]) as j from w),
u as (select question_id, x, min(i * 10 + j) as pos from v where x is not null group by 1, 2), a as (select question_id, array_to_string((list(x order by pos))[1:12], '|') as variants from u group by 1),
s as (select question_id, regexp_extract_all(rest, '[0-9]+(?:[.,][0-9]+)?') as nums from t), sx as (select question_id, unnest(range(1, len(nums) + 1)) as i, nums[i] as x from s),
sy as (select question_id, i * 10 as pos, x from sx union all select question_id, i * 10 + 1, x || '0' from sx where regexp_matches(x, '^[0-9]+[.,][0-9]$')), sz as (select question_id, x, min(pos) as pos from sy group by 1, 2), b as (select question_id, array_to_string((list(x order by pos))[1:10], '|') as standalone from sz group by 1)
select t.question_id, array_to_string(terms, '|') as terms, coalesce(variants, '') as variants, coalesce(standalone, '') as standalone from t left join a using (question_id) left join b using (question_id)"""),
    "labeled_terms": views.oracle(f"with {_ASKS}, " + "l as (" + " union all ".join(f"select question_id, '{n}' as family, unnest(regexp_extract_all(q, '{p}', 1)) as v from q" for n, p in LABELS.items()) + ") select question_id, family, string_agg(distinct v, ',' order by v) as labels from l group by 1, 2"),
    "html_line_blocks": rf"""
with c as (select page_id, regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)\s*>|<!--.*?-->', '', 'gsi') as h from pages),
m as (select page_id, string_split(regexp_replace(h, '(</?(p|li|ul|ol|div|h[1-6]|section|article|aside|nav|header|footer|form|table|body|html|main)([\s>/]))', chr(1) || '\1', 'gi'), chr(1)) as parts from c),
e as (select page_id, unnest(range(1, len(parts) + 1)) as pos, parts[pos] as part from m), k as (select page_id, pos, regexp_replace(regexp_replace(regexp_replace(part, '^<(p|li)[^>]*>', '', 'i'), '<br[^>]*>', ' ', 'gi'), '<[^>]*>', '', 'g') as line from e where regexp_matches(part, '^<(p|li)[\s>]', 'i')),
d as (select page_id, pos, trim(regexp_replace({_ENTITY}, '[ \t\n\r]+', ' ', 'g')) as line from k)
select page_id, row_number() over (partition by page_id order by pos) as line_no, line from d where line <> ''""",
    "path_tokens": views.oracle(r"""
with p as (select replace(path, '/doc_', '/itc-doc-') as path from v_sources_all), n as (select path, replace(lower(strip_accents(path)), '/', ' ') as x from p),
t as (select path, unnest(regexp_extract_all(x, '[a-z0-9&]+')) as token from n), s as (select path, list_filter(string_split(unnest(regexp_split_to_array(x, '[\s_]+')), '-'), lambda y: y <> '') as sub from n),
r as (select path, sub, unnest(range(1, len(sub) + 1)) as i from s), c as (select path, array_to_string(sub[i:unnest(range(i, len(sub) + 1))], '-') as token from r)
select path, string_agg(token, ' ' order by token) as tokens from (select distinct path, token from (select * from t union all select * from c) u) v group by path"""),
    "toc_detect": views.oracle(rf"with k as (select chunk_id, page, section || ' ' || text as raw, {_BARE.format('section')} || ' ' || {_BARE.format('text')} as b from v_norms) select chunk_id, page between 1 and 4 and len(regexp_extract_all(b, 'articulo\s+[0-9]+')) >= 4 and (regexp_matches(raw, '{LEADERS}') or regexp_matches(b, 'capitulo\s+[ivxlcdm]+')) as is_toc from k"),
}
