"""The additive relevance of candidates by a table of rules: what is counted where, for which questions, and what a hit is worth.

A rule names its part of the score, a flag of the question or the pair that it needs (or none), a way to count hits, and
the points of a hit for candidates found by vectors and for those found by words only. Two small interpreters read the
table, one gives columns and one SQL; a user may pass rules of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import views
from . import scoring, selection
from .scoring import BM25, CANDIDATES, COSINE, LEXICAL_BASE, bare, longest


@dataclass(frozen=True)
class Rule:
    """hits: 'terms' (entries of the list arg in a text), 'words' (of the words arg, by |, in a text), 'pattern' (matches of arg in a text), 'flag' (1), 'shared' (tokens of question and text)."""

    part: str
    flag: str | None
    hits: str
    arg: str
    of: str
    dense: int
    lexical: int
    least: int = 1
    most: int = 99


#: What hits are worth, and the words and forms that are looked for.
RULES = [
    Rule("overlap", None, "shared", "", "", 1, 1),
    Rule("keyword", None, "terms", "keywords", "d", 2, 1),
    Rule("core", None, "terms", "core", "d", 4, 2),
    Rule("location_text", "f_location", "terms", "core", "d", 18, 9, 1, 1),
    Rule("location_section", "f_location", "terms", "core", "s", 22, 11, 1, 1),
    Rule("page", "f_page", "flag", "", "", 50, 40),
    Rule("exact_ref", None, "terms", "exact", "dm", 28, 24),
    Rule("anchor_section", None, "terms", "articles", "s", 24, 24, 1, 1),
    Rule("table_kind", "f_numeric_table", "flag", "", "", 14, 10),
    Rule("numeric_intent", "f_value", "terms", "numbers", "d", 8, 6),
    Rule("numeric_compact", "f_value", "terms", "compact", "dc", 8, 6),
    Rule("lone_number", None, "terms", "lone", "d", 18, 12),
    Rule("number_group", "f_groups", "terms", "numbers", "d", 22, 22),
    Rule("group_context", "f_grouped", "terms", "keywords", "d", 4, 4),
    Rule("no_group", "f_ungrouped", "flag", "", "", -18, -18),
    Rule("table_in_comparison", "f_compared_table", "flag", "", "", -35, -35),
    Rule("phrase", None, "terms", "phrases", "d", 80, 30),
    Rule("application", "f_normative", "words", "se aplica|aplicacion|obligatorio|exigible", "ds", 16, 12),
    Rule("classification", "f_normative", "words", "clasificacion|clasifica|categorias", "ds", 12, 8),
    Rule("itc", None, "terms", "itcs", "dm", 70, 40, 1, 1),
    Rule("itc_more", None, "terms", "itcs", "dm", 10, 10),
    Rule("scope_page", "f_scope_page", "flag", "", "", 5, 5),
    Rule("scope_section", "f_scope", "words", "objeto|ambito|alcance|finalidad|definicion", "s", 7, 7, 1, 1),
    Rule("motivation_page", "f_motivation_page", "flag", "", "", 6, 6),
    Rule("motivation_cue", "f_motivation", "pattern", "con el fin de|para que|debido a", "d", 7, 7),
    Rule("motivation_section", "f_motivation", "words", "preambulo|exposicion|motivos|objeto", "s", 12, 12, 1, 1),
    Rule("documentation", "f_documentation", "words", "documentacion tecnica|certificado de instalacion|memoria tecnica|proyecto|puesta en servicio|empresa instaladora", "dm", 9, 9),
    Rule("catalogue", "f_documentation", "words", "catalogo|normas une", "d", -10, -10, 1, 1),
    Rule("whole_question", None, "terms", "whole", "d", 6, 6),
    Rule("definition", "f_definition", "pattern", "se entiende por|se define como|definicion|se denomina", "d", 10, 6),
    Rule("list", "f_list", "pattern", " (?:a|b|1|2)[)] | - ", "raw", 6, 4, 1, 1),
    Rule("summary", "f_summary", "pattern", "[a-z]", "s", 5, 3, 1, 1),
    Rule("table_word", "f_table", "words", "tabla", "dm", 8, 6, 1, 1),
    Rule("table_circuit", "f_table", "pattern", " c[0-9]{1,2} ", "d", 8, 6, 1, 1),
    Rule("comparison_cue", "f_comparison", "pattern", "mientras que|frente a|en cambio|mayor que|menor que", "d", 6, 4),
    Rule("procedure", "f_procedure", "pattern", "pasos|procedimiento|puesta en marcha|ejecucion", "d", 5, 4),
    Rule("temporal", "f_temporal", "pattern", "plazo|anual|dias|meses|antes de|despues de", "d", 7, 5),
    Rule("label", None, "terms", "labels", "ds", 12, 10),
    Rule("label_context", "f_label_alone", "flag", "", "", -10, -10),
    Rule("numeric", None, "terms", "numbers", "d", 6, 4),
    Rule("low_signal", "f_no_number", "flag", "", "", -5, -5),
    Rule("reference", None, "terms", "exact", "m", 5, 4),
    Rule("section", None, "terms", "keywords", "m", 8, 5),
    Rule("section_title", None, "terms", "keywords", "s", 6, 4, 2),
    Rule("source_title", None, "terms", "keywords", "src", 5, 3),
    Rule("domain", "f_own_domain", "flag", "", "", 12, 12),
    Rule("foreign_domain", "f_foreign", "flag", "", "", -30, -30),
    Rule("foreign_article", "f_foreign_article", "flag", "", "", -30, -30),
    Rule("layer_law", "f_law", "flag", "", "", 8, 8),
    Rule("layer_guide", "f_guide", "flag", "", "", 4, 4),
    Rule("layer_other", "f_other", "flag", "", "", -5, -5),
    Rule("variant", "f_own_variant", "flag", "", "", 18, 18),
    Rule("other_variant", "f_other_variant", "flag", "", "", -10, -10),
    Rule("it_section", None, "terms", "its", "ds", 20, 16),
    Rule("article", None, "terms", "articles", "dm", 26, 20),
    Rule("toc", "f_toc", "flag", "", "", -90, -90),
    Rule("comparison_overlap", "f_comparison", "shared", "", "", 3, 3, 2, 1),
    Rule("no_core", "f_no_core", "flag", "", "", -4, -2),
    Rule("nothing", "f_nothing", "flag", "", "", -6, -4),
    Rule("specific_scope", "f_specific", "words", "quirofano|recarga|piscina|generadora|vivienda", "s", -18, -18, 1, 1),
]
#: Flags of a question: forms of its text.
ASKS = {
    "f_location": "donde|en que documento|que apartado|where",
    "f_definition": "que es|que significa|definicion|what is",
    "f_list": "lista|enumera|cuales son|list",
    "f_summary": "resumen|resume|summary",
    "f_table": "tabla|table",
    "f_comparison": "compara|diferencia|versus|frente a|than",
    "f_procedure": "como se|pasos|procedimiento|how",
    "f_temporal": "plazo|cuando|cada cuanto|when",
    "f_scope": "objeto|ambito|alcance|finalidad",
    "f_motivation": "por que|motivo|why",
    "f_documentation": "documentacion",
    "f_normative": "normativa|reglamento|se aplica|obligatorio|segun",
}
#: Lists of a question: a pattern of its text, and what a match becomes as a term.
LISTS = {
    "articles": ("art(?:iculo|[.])? ?0?([0-9]{1,3}) ", " articulo # "),
    "itcs": ("itc-bt-0?([0-9]{1,2}) ", " itc-bt-# "),
    "its": (" it ([0-9]+(?:[.][0-9]+){0,2}) ", " it # "),
    "pages": ("pag(?:ina|[.])? ?([0-9]{1,4}) ", "#"),
    "numbers": (" ([0-9]+(?:,[0-9]+)? ?(?:mm2|kva|kw|ma|kv|cm|mm|m|v|a|w)) ", " # "),
    "labels": (" ((?:clase|tipo|categoria) [a-z0-9]+) ", " # "),
    "lone": (" ([0-9]{2,}) ", " # "),
}
#: Whether each combined flag holds, of the columns that there are by then; the text serves both engines.
COMBINED = {
    "f_page": "HAS(pages, cast(page as string))",
    "f_value": "LEN(numbers) > 0 and not f_comparison",
    "f_numeric_table": "(LEN(numbers) > 0 or f_table) and kind = 'table'",
    "f_groups": "f_comparison and LEN(numbers) >= 2",
    "f_grouped": "f_comparison and LEN(numbers) >= 2 and n_numbers > 0",
    "f_ungrouped": "f_comparison and LEN(numbers) >= 2 and n_numbers = 0",
    "f_compared_table": "f_comparison and LEN(numbers) >= 2 and kind = 'table' and not f_table",
    "f_scope_page": "f_scope and page <= 3",
    "f_motivation_page": "f_motivation and page <= 5",
    "f_label_alone": "n_labels > 0 and n_core = 0",
    "f_no_number": "LEN(numbers) > 0 and n_numbers = 0 and not RX(d, '[0-9]')",
    "f_own_domain": "coalesce(domain = source_domain, false)",
    "f_foreign": "domain is not null and coalesce(domain <> source_domain, true)",
    "f_foreign_article": "domain is not null and coalesce(domain <> source_domain, true) and LEN(articles) > 0",
    "f_law": "coalesce(layer, '') = 'law' and not f_procedure",
    "f_guide": "coalesce(layer, '') = 'guide' or (coalesce(layer, '') = 'manual' and f_procedure)",
    "f_other": "coalesce(layer, '') = 'other'",
    "f_own_variant": "coalesce(variant = source_variant, false)",
    "f_other_variant": "coalesce(variant <> source_variant, false)",
    "f_toc": "LEN(articles) > 0 and page <= 4 and n_articles >= 4",
    "f_no_core": "LEN(core) > 0 and n_core = 0",
    "f_nothing": "n_shared = 0 and n_core = 0 and kind = 'text'",
    "f_specific": "not RX(q, 'quirofano|recarga|piscina|generadora|vivienda')",
}
#: Counts that combined flags ask for.
COUNTS = {"n_numbers": ("terms", "numbers", "d"), "n_labels": ("terms", "labels", "ds"), "n_core": ("terms", "core", "d"), "n_articles": ("pattern", " articulo [0-9]", "d"), "n_shared": ("shared", "", "")}


def normal(text: Column) -> Column:
    """Bare text with single spaces, also at both ends; marks stay inside words and numbers only."""
    kept = F.regexp_replace(bare(F.coalesce(text, F.lit(""))), "[^a-z0-9.,/()-]+", " ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(kept, "[.,]+( |$)", " ")), F.lit(" "))


def spread(pattern: str) -> str:
    """A pattern for text whose spaces are doubled, so that two matches can stand side by side: its outer spaces are single."""
    inner = pattern.strip(" ").replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")
    return " " * pattern.startswith(" ") + inner + " " * pattern.endswith(" ")


def hits(kind: str, arg: str, of: str) -> Column:
    text = F.col(of) if of else None
    if kind == "terms":
        return F.size(F.filter(arg, lambda t: F.contains(text, t)))
    if kind == "words":
        return reduce(Column.__add__, (F.contains(text, F.lit(w)).cast("int") for w in arg.split("|")))
    if kind == "pattern":
        return F.regexp_count(text, F.lit(arg))
    return F.size(F.array_intersect("tokens", "have")) if kind == "shared" else F.lit(1)


def combined(text: str) -> Column:
    return F.expr(views.dialect(text.replace("HAS(", "array_contains("), spark=True))


def profiled(pairs: DataFrame) -> DataFrame:
    """pairs (question, text, section, source, page, domain, source_domain, layer, variant, source_variant) with all lists, texts, counts and flags that rules ask for."""
    texts = {"q": normal(F.col("question")), "d": normal(F.col("text")), "s": normal(F.col("section")), "src": normal(F.regexp_replace(F.coalesce("source", F.lit("")), "[/_-]", " ")), "raw": F.concat(F.lit(" "), F.lower(F.coalesce("text", F.lit(""))), F.lit(" "))}
    rows = pairs.withColumns(texts).withColumns({"m": F.concat("s", "src"), "ds": F.concat("d", "s"), "dm": F.concat("d", "s", "src"), "dc": F.replace("d", F.lit(" "), F.lit(""))})
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("([a-z]{4,})"), 1))
    found = lambda p: F.array_distinct(F.regexp_extract_all(F.replace("q", F.lit(" "), F.lit("  ")), F.lit(spread(p)), 1))
    as_term = lambda t: lambda x: F.replace(F.lit(t), F.lit("#"), F.regexp_replace(x, " +", " "))
    lists = {n: F.transform(found(p), as_term(t)) for n, (p, t) in LISTS.items()}
    rows = rows.withColumns({"tokens": words(F.col("q")), "have": words(F.col("d")), **lists})
    first = F.split(F.trim("q"), " ")
    rows = rows.withColumns({"keywords": F.filter("tokens", lambda w: F.length(w) >= 5), "core": longest(F.col("tokens"), 4), "exact": F.concat("itcs", "its"), "compact": F.transform("numbers", lambda t: F.replace(t, F.lit(" "), F.lit(""))), "phrases": F.when(F.size(first) >= 4, F.array(F.concat(F.lit(" "), F.array_join(F.slice(first, 1, 3), " "), F.lit(" ")))).otherwise(F.array().cast("array<string>")), "whole": F.array("q")})
    kind = F.when(F.contains("d", F.lit(" tabla ")), "table").when(F.col("d").rlike("[0-9]"), "numeric").otherwise("text")
    rows = rows.withColumns({"kind": kind, **{n: F.col("q").rlike(p) for n, p in ASKS.items()}, **{n: hits(*c) for n, c in COUNTS.items()}})
    return rows.withColumns({n: combined(t) for n, t in COMBINED.items()})


def relevance(pairs: DataFrame, lexical: bool = False, rules: list[Rule] = RULES) -> DataFrame:
    """question_id, chunk_id, the points of each part, and score, their sum (with a base for candidates found by words only). See profiled() for pairs."""
    rows, parts = profiled(pairs), []
    for r in rules:
        n = hits(r.hits, r.arg, r.of)
        n = F.when(n >= r.least, F.least(n, F.lit(r.most))).otherwise(0)
        n = F.when(F.col(r.flag), n).otherwise(0) if r.flag else n
        parts.append((n * (r.lexical if lexical else r.dense)).cast("long").alias(r.part))
    out = rows.select("question_id", "chunk_id", *parts)
    return out.withColumn("score", reduce(Column.__add__, (F.col(r.part) for r in rules), F.lit(LEXICAL_BASE if lexical else 0).cast("long")))


# -- queries ------------------------------------------------------------------------------------------------------------

#: Stands for a user's questions and sources: what questions refer to, the domain and the variant that they are about.
ASKED = "concat(question, case question_id % 8 when 0 then ' segun el articulo 7 y la ITC-BT-12' when 1 then ' tabla con 16 A y 0,2 mm2 pag. 1' when 2 then ' compara 16 A frente a 20 A' when 3 then ' objeto y ambito IT 3.1' when 4 then ' pasos y plazo de clase II' when 5 then ' que es la documentacion' when 6 then ' por que motivo, lista' else ' resumen 842' end)"
VARIANTS = ["case question_id % 4 when 0 then 'pdf' when 1 then 'md' end as variant", "case doc_id % 3 when 0 then 'pdf' else 'md' end as source_variant"]
PAIRS = f"select question_id, c.chunk_id, c.doc_id, {ASKED} as question, n.text, n.section, c.source, c.page, {selection.DOMAIN} as domain, l.domain as source_domain, l.layer, {', '.join(VARIANTS)} from c join (select chunk_id, section, text from v_norms) n on n.chunk_id = c.chunk_id left join ({selection.LAYERS}) l on l.source = c.source"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the sections, layers and domains of their sources."""
    found = scoring.candidates(spark, sf_dir).drop("text")
    norms = views.run(spark, sf_dir, "select chunk_id, section, text from v_norms")
    layers = spark.sql(selection.LAYERS).withColumnRenamed("domain", "source_domain")
    rows = found.join(norms, "chunk_id").join(layers, "source", "left").withColumns({"domain": F.expr(selection.DOMAIN), "question": F.expr(ASKED)})
    return rows.selectExpr("*", *VARIANTS)


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relevance as the base, and the vectors there are: each question and document has one, by its number among as many as there are."""
    vectors, rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), pairs(spark, sf_dir)
    n = vectors.count()
    based = rows.join(relevance(rows).select("question_id", "chunk_id", F.col("score").alias("base")), ["question_id", "chunk_id"])
    return scoring.hybrid_rerank(based.withColumns({"question_vec": F.col("question_id") % n, "chunk_vec": F.col("doc_id") % n}), vectors)


QUERIES = {
    "feature_score": lambda s, d: relevance(pairs(s, d)),
    "lexical_feature_score": lambda s, d: relevance(pairs(s, d), lexical=True),
    "hybrid_rerank": reranked,
}


def _norm(x: str) -> str:
    return f"' ' || trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^a-z0-9.,/()-]+', ' ', 'g'), '[.,]+( |$)', ' ', 'g')) || ' '"


def _hits(kind: str, arg: str, of: str) -> str:
    if kind == "terms":
        return f"len(list_filter({arg}, lambda t: contains({of}, t)))"
    if kind == "words":
        return "(" + " + ".join(f"contains({of}, '{w}')::int" for w in arg.split("|")) + ")"
    if kind == "pattern":
        return f"len(regexp_extract_all({of}, '{arg}'))"
    return "len(list_intersect(tokens, have))" if kind == "shared" else "1"


def _part(r: Rule, points: int) -> str:
    n = _hits(r.hits, r.arg, r.of)
    return f"case when {r.flag or 'true'} and {n} >= {r.least} then least({n}, {r.most}) else 0 end * ({points}) as {r.part}"


def _relevance(lexical: bool) -> str:
    """Common table expressions: c (the pairs), x (with all that is counted) and rel (parts and score)."""
    lists = ", ".join(f"list_transform(list_distinct(regexp_extract_all(replace(q, ' ', '  '), '{spread(p)}', 1)), lambda x: replace('{t}', '#', regexp_replace(x, ' +', ' ', 'g'))) as {n}" for n, (p, t) in LISTS.items())
    asks = ", ".join(f"regexp_matches(q, '{p}') as {n}" for n, p in ASKS.items())
    flags = ", ".join(f"{t.replace('HAS(', 'list_contains(')} as {n}" for n, t in COMBINED.items())
    parts = ", ".join(_part(r, r.lexical if lexical else r.dense) for r in RULES)
    return f"""
with c0 as (with c as ({CANDIDATES}) {PAIRS}),
n1 as (select *, {_norm("question")} as q, {_norm("text")} as d, {_norm("section")} as s, {_norm("regexp_replace(source, '[/_-]', ' ', 'g')")} as src, ' ' || lower(coalesce(text, '')) || ' ' as raw from c0),
n2 as (select *, s || src as m, d || s as ds, d || s || src as dm, replace(d, ' ', '') as dc, list_distinct(regexp_extract_all(q, '[a-z]{{4,}}')) as tokens, list_distinct(regexp_extract_all(d, '[a-z]{{4,}}')) as have, string_split(trim(q), ' ') as first, {lists} from n1),
n3 as (select *, list_filter(tokens, lambda w: length(w) >= 5) as keywords, list_transform(list_sort(list_transform(tokens, lambda w: {{'l': -length(w), 'w': w}}))[1:4], lambda x: x.w) as core, list_concat(itcs, its) as exact, list_transform(numbers, lambda t: replace(t, ' ', '')) as compact,
 case when len(first) >= 4 then [' ' || array_to_string(first[1:3], ' ') || ' '] else [] end as phrases, [q] as whole, case when contains(d, ' tabla ') then 'table' when regexp_matches(d, '[0-9]') then 'numeric' else 'text' end as kind, {asks} from n2),
n4 as (select *, {", ".join(f"{_hits(*c)} as {n}" for n, c in COUNTS.items())} from n3), n5 as (select *, {flags} from n4), rel0 as (select question_id, chunk_id, {parts} from n5),
rel as (select *, {LEXICAL_BASE if lexical else 0} + {" + ".join(r.part for r in RULES)} as score from rel0)"""


SQL = {
    "feature_score": views.oracle(f"{_relevance(False)} select * from rel"),
    "lexical_feature_score": views.oracle(f"{_relevance(True)} select * from rel"),
    "hybrid_rerank": views.oracle(rf"""{_relevance(False)},
t as (select *, regexp_split_to_array(trim(regexp_replace(lower(strip_accents(text)), '[ \t\n]+', ' ', 'g')), ' ') as words, list_distinct(list_transform(regexp_extract_all(lower(question), '\p{{L}}{{4,}}'), lambda w: strip_accents(w))) as asked from c0),
mm as (select *, avg(len(words)) over (partition by question_id) as mean from t), u as (select question_id, chunk_id, len(words) as n, mean, words, unnest(asked) as token from mm),
f as (select question_id, chunk_id, any_value(n) as n, any_value(mean) as mean, token, len(list_filter(any_value(words), lambda w: w = token))::double as tf from u group by question_id, chunk_id, token),
bm as (select question_id, chunk_id, sum(tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * n / mean))) as bm25 from f group by 1, 2), e as (select vec_id, embedding::double[] as v, count(*) over () as total from embeddings),
sc as (select c0.question_id, c0.chunk_id, score, coalesce(bm25, 0) as bm25, list_cosine_similarity(x.v, y.v) as cosine from c0 join rel using (question_id, chunk_id) left join bm using (question_id, chunk_id) join e x on x.vec_id = c0.question_id % x.total join e y on y.vec_id = c0.doc_id % y.total)
select question_id, chunk_id, round(cosine, 5) as cosine, round(bm25, 5) as bm25, round(score + {COSINE} * cosine + {BM25} * bm25, 4) as score from sc"""),
}
