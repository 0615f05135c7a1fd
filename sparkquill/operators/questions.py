"""Questions understood as batch jobs: intent, profile, domains, variants, expansion, aggregates, and what a turn inherits."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import views
from .business import found, parse_questions
from .chunks import NUMBER, PAGE, TABLE, cleaned
from .retrieval import tokens
from .scoring import bare

#: What a question of each kind says, in text without accents.
LOCATION = r"\b(?:pagina|pag|page|donde\s+(?:aparece|esta|se\s+encuentra)|ubicacion|apartado\s+de)\b"
COMPARISON = r"(?:\bdiferencia\b|\bdiferencias\b|\bcompara\b|\bcomparar\b|\bfrente\s+a\b|\bversus\b)"
UNIT = r"\b(?:mm2|m2|cm|mm|kw|kva|w|v|a|ma|ohmios?|ohm|bar|hz|a/mm2)\b"
VALUE_WORDS = ["densidad", "corriente", "valor", "limite", "distancia", "seccion"]
PROCEDURE = r"(?:\bcomo\s+se\s+calcula\b|\bcomo\s+debe\b|\bcomo\s+puede\b|\bprocedimiento\b|\bpasos\b)"
LIST = r"(?:\bcuales\s+son\b|\benumera\b|\blista\b|\btipos\s+de\b|\bclases\s+de\b|\bpueden\s+ser\b)"
DEFINITION = r"(?:\bcomo\s+se\s+denomina\b|\bque\s+es\b|\bque\s+se\s+entiende\s+por\b|\bdefinicion\b|\bque\s+funcion\s+cumple[n]?\b|\bpara\s+que\s+sirve[n]?\b)"
SUMMARY = r"(?:\bresume\b|\bresumen\b|\bresumir\b|\bsintetiza\b|\bsintesis\b)"
TEMPORAL = r"(?:\bcuando\b|\bplazo\b|\bperiodicidad\b|\brevisar\b|\bfrecuencia\b)"
FOLLOW_UP = r"^(?:y|e|pero|entonces|tambien|ahora)\b|\b(?:eso|esa|ese|anterior|mismo|misma)\b"
#: Answers' worth of results before a question asks for more.
BASE_K = 6


def of_words(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words))


def intent(q: Column) -> Column:
    """The first kind that a question (without accents) is of."""
    value = q.rlike(NUMBER) & (q.rlike(UNIT) | of_words(q, VALUE_WORDS))
    cascade = F.when(q.rlike(PAGE) | q.rlike(LOCATION), "document_location").when(F.contains(q, F.lit("tabla")), "table_lookup").when(q.rlike(COMPARISON), "comparison").when(value, "numeric_value")
    return cascade.when(q.rlike(PROCEDURE), "procedure").when(q.rlike(LIST), "list").when(q.rlike(DEFINITION), "definition").otherwise("general")


def profile(questions: DataFrame) -> DataFrame:
    """question_id, intent, flags of a question, n_keywords, how many results it gets (k), and how many candidates are looked at for them (window)."""
    q = questions.select("question_id", bare(F.col("text")).alias("q"))
    flags = {"is_table": F.contains("q", F.lit("tabla")), "is_list": F.col("q").rlike(LIST), "is_summary": F.col("q").rlike(SUMMARY), "is_definition": F.col("q").rlike(DEFINITION), "is_comparison": F.col("q").rlike(COMPARISON), "is_temporal": F.col("q").rlike(TEMPORAL)}
    q = q.withColumns({**flags, "intent": intent(F.col("q")), "n_keywords": F.size(F.array_distinct(F.filter(tokens(F.col("q")), lambda w: F.length(w) >= 5))), "has_refs": F.col("q").rlike(PAGE) | F.col("q").rlike(TABLE)})
    k = F.when(F.col("is_table"), 12).when(F.col("is_summary") | F.col("is_list"), 8).when(F.col("is_definition") | F.col("is_comparison"), 7).otherwise(BASE_K)
    k = F.greatest(k, F.when(F.col("is_temporal"), 8), F.when(F.col("has_refs") | F.col("intent").isin("numeric_value", "table_lookup"), 10))
    q = q.withColumn("k", k)
    window = F.least(F.greatest(F.col("k") * 4, F.lit(16)) + F.when(F.col("n_keywords") >= 4, 10).otherwise(0) + F.when(F.col("q").rlike("[0-9]"), 8).otherwise(0), F.lit(70))
    broad = reduce(Column.__or__, (F.col(c) for c in ("is_table", "is_list", "is_summary", "is_definition", "is_comparison")))
    return q.select("question_id", "intent", *flags, "n_keywords", "k", F.when(broad, F.least(window + 12, F.lit(80))).otherwise(window).alias("window"))


def mentions(questions: DataFrame, terms: DataFrame, *more: str) -> DataFrame:
    """questions (question_id and more columns) with each of terms (term, more columns) that their text holds as whole words: an equi-join on the term's first word, then the whole term is looked for."""
    q = questions.select("question_id", *more, F.concat(F.lit(" "), F.regexp_replace(bare(F.col("text")), "[^a-z0-9]+", " "), F.lit(" ")).alias("q"))
    words = q.select("*", F.explode(F.array_distinct(F.split("q", " "))).alias("first")).where("first <> ''")
    keyed = terms.withColumn("first", F.split_part("term", F.lit(" "), F.lit(1)))
    return words.join(keyed, "first").where(F.contains("q", F.concat(F.lit(" "), "term", F.lit(" ")))).drop("first", "q")


def expected_domains(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """question_id, domain, strong: the domains whose terms a question holds; those with weak terms only count if it holds no strong one."""
    hits = mentions(questions, terms).groupBy("question_id", "domain").agg(F.bool_or("is_strong").alias("strong"))
    any_strong = F.bool_or("strong").over(Window.partitionBy("question_id"))
    return hits.withColumn("any_strong", any_strong).where("strong or not any_strong").drop("any_strong")


def expected_variants(questions: DataFrame, triggers: DataFrame) -> DataFrame:
    """question_id, variant, score, rank. triggers: variant, trigger, term (its first word). A trigger that stands in the question scores its length, 20 more with a digit; else enough of its words score 5 each and a hundredth of its length. Exact matches keep others out."""
    q = questions.select("question_id", bare(F.col("text")).alias("q"))
    q = q.withColumn("words", F.array_distinct(F.filter(F.split(F.regexp_replace("q", "[^a-z0-9]+", " "), " "), lambda w: F.length(w) >= 4)))
    t = triggers.withColumn("parts", F.array_distinct(F.filter(F.split("trigger", " "), lambda w: F.length(w) >= 4)))
    keyed = t.select("variant", "trigger", "parts", F.explode("parts").alias("word"))
    pairs = q.withColumn("word", F.explode("words")).join(keyed, "word").dropDuplicates(["question_id", "variant", "trigger"])
    exact = F.contains("q", F.col("trigger"))
    overlap, size = F.size(F.array_intersect("words", "parts")), F.size("parts")
    enough = (size >= 2) & (overlap >= F.when(size <= 3, size).otherwise(F.greatest(F.lit(3), F.floor(size * 0.75))))
    score = F.when(exact, F.length("trigger") + F.when(F.col("trigger").rlike("[0-9]"), 20).otherwise(0)).when(enough, overlap * 5 + F.length("trigger") / 100)
    best = pairs.withColumns({"exact": exact, "score": score.cast("double")}).where("score is not null").groupBy("question_id", "variant").agg(F.max("score").alias("score"), F.bool_or("exact").alias("exact"))
    best = best.withColumn("any_exact", F.bool_or("exact").over(Window.partitionBy("question_id"))).where("exact or not any_exact")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "variant"))
    return best.select("question_id", "variant", F.round("score", 4).alias("score"), rank.alias("rank"))


def rule_expansion(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """question_id, phrases, search_text. rules: rule_no, term, needs_all, emits: a rule with any of its terms in the question (all, if needs_all) emits its phrase; phrases come once, in the order of rules."""
    sizes = rules.groupBy("rule_no").agg(F.count("*").alias("n_terms"))
    hits = mentions(questions, rules.join(sizes, "rule_no")).groupBy("question_id", "rule_no", "needs_all", "emits", "n_terms").agg(F.count_distinct("term").alias("n"))
    fired = hits.where("n = n_terms or not needs_all").groupBy("question_id", "emits").agg(F.min("rule_no").alias("rule_no"))
    emitted = fired.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_no", "emits"))), lambda x: x["emits"]).alias("p"))
    out = questions.join(emitted, "question_id")
    return out.select("question_id", F.array_join("p", "|").alias("phrases"), F.concat_ws(" ", cleaned(F.col("text")), F.array_join("p", " ")).alias("search_text"))


#: Columns that parse_questions() adds.
PARSED = ["reference", "years", "quarter", "month", "per_month", "per_year", "period", "area", "client"]


def parsed_with_text(questions: DataFrame) -> DataFrame:
    """parse_questions() with the text beside it, which needs no join."""
    return parse_questions(questions.select(F.struct("question_id", "text").alias("question_id"), "text")).select("question_id.*", *(F.col(c) for c in PARSED))


#: Stored bytes of the tables that rows are made of for each part of a shuffle that a task holds whole, and parts at most.
PART_BYTES, MAX_PARTS = 2 << 20, 200_000


def parts(rows: DataFrame) -> int:
    """Parts for a shuffle of rows: they grow with the bytes of the tables that rows are made of, and are the session's shuffle partitions at least."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    size = sum(x for x in sizes if x < 1 << 60)  # what has no statistics says 2 ** 63 - 1
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PART_BYTES), MAX_PARTS))


def detect_aggregate(questions: DataFrame) -> DataFrame:
    """question_id, kind (count before avg before top before sum), n, metric, scope, sort of each business question that asks for one; none with a reference, unless it asks for the top."""
    q = parsed_with_text(questions).select("question_id", "reference", bare(F.col("text")).alias("q"))
    text = F.col("q")
    n = F.coalesce(found(text, r"\btop\s+([0-9]+)\b", 1), found(text, r"\b(?:las|los|primeras|primeros|ultimas|ultimos)\s+([0-9]+)\b", 1)).cast("int")
    top = text.rlike(r"\btop\s+[0-9]+\b|\b(?:proyectos?|obras?|estudios?|licitaci(?:on|ones)) con (?:mas|mayor)\b|ranking")
    avg = of_words(text, ["importe medio", "importe promedio", "media de ", "promedio de ", "valor medio"])
    count = of_words(text, ["cuantas ", "cuantos ", "numero de ", "cantidad de "]) & (of_words(text, ["ofertas", "licitaciones", "obras", "cierres", "estudios"]) | ~of_words(text, ["importe", "media", "total", "suma", "cartera"]))
    sum_ = of_words(text, ["cuanto ", "cuanta ", "total de ", "suma de ", "importe total"])
    kind = F.when(count, "count").when(avg, "avg").when(top, "top").when(sum_, "sum")
    metric = F.when(count, F.when(of_words(text, ["cierre"]), "cierre:count").when(of_words(text, ["obra"]), "obras").otherwise("licitaciones")).when(of_words(text, ["importe"]), "importecontratado").when(of_words(text, ["cartera"]), "cartera").when(of_words(text, ["produccion"]), "produccion")
    scope = F.when(of_words(text, ["pipeline"]), "pipeline").when(of_words(text, ["backlog", "adjudicad"]), "backlog")
    sort = F.when(of_words(text, ["ultimas", "ultimos", "recientes"]), "latest")
    q = q.select("question_id", kind.alias("kind"), F.coalesce(n, F.lit(1)).alias("n"), metric.alias("metric"), scope.alias("scope"), sort.alias("sort"), (F.col("reference").isNull() | top).alias("free"))
    return q.where("free and kind is not null and metric is not null").drop("free")


def detect_fields(questions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """question_id, field: the fields whose synonyms (term, field, year, quarter) a question holds; those of a year or quarter only if it asks for that one, or for none."""
    parsed = parsed_with_text(questions).select("question_id", "text", F.split("years", ",").alias("years"), F.col("quarter").alias("asked_quarter"))
    hits = mentions(parsed, synonyms, "years", "asked_quarter")
    year_fits = F.col("year").isNull() | (F.get("years", F.lit(0)) == "") | F.array_contains("years", F.col("year").cast("string"))
    quarter_fits = F.col("quarter").isNull() | F.col("asked_quarter").isNull() | (F.col("quarter") == F.col("asked_quarter"))
    # the rows of a question meet in one of many small parts, and repeats are dropped only there: a task holds a part, however large the table is
    fields = hits.where(year_fits & quarter_fits).select("question_id", "field")
    return fields.repartition(parts(questions), "question_id").distinct()


def followup(turns: DataFrame) -> DataFrame:
    """conv_id, turn, reference, year, month of each turn, its own or, if it is a follow-up, that of the latest of the three turns before it that has one."""
    parsed = parsed_with_text(turns.select(F.struct("conv_id", "turn").alias("question_id"), "text"))
    year = F.nullif(F.split_part("years", F.lit(","), F.lit(1)), F.lit(""))
    rows = parsed.select("question_id.*", bare(F.col("text")).rlike(FOLLOW_UP).alias("follows"), "reference", year.alias("year"), "month")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    inherit = lambda c: F.coalesce(c, F.when(F.col("follows"), F.last(c, ignorenulls=True).over(w))).alias(c)
    return rows.select("conv_id", "turn", *(inherit(c) for c in ("reference", "year", "month")))


#: A user's dictionaries; these rows stand for them.
DOMAIN_TERMS = "select * from (values ('importe total', 'tenders', true), ('cliente', 'tenders', false), ('tabla 3 1', 'norms', true), ('articulo', 'norms', false), ('seccion', 'norms', true), ('trimestre', 'calendar', false), ('with', 'web', false), ('that', 'books', true)) as t(term, domain, is_strong)"
TRIGGERS = "select * from (values ('tender_2', 'importe total de est'), ('norm_a', 'articulo tabla clase seccion medida'), ('norm_b', 'tabla 3.1'), ('norm_c', 'seccion nada'), ('trim', 'trimestre 2')) as t(variant, trigger)"
RULES = "select * from (values (1, 'importe total', false, 'valor de la oferta'), (2, 'articulo', true, 'norma aplicable'), (2, 'clase', true, 'norma aplicable'), (3, 'cliente', true, 'ficha del cliente'), (3, 'nunca', true, 'ficha del cliente'), (4, 'oferta', false, 'valor de la oferta'), (5, 'tabla', false, 'filas de la tabla')) as t(rule_no, term, needs_all, emits)"
SYNONYMS = "select * from (values ('importe total', 'amount', 1995, cast(null as int)), ('importe', 'amount_any', null, null), ('cliente', 'client', null, null), ('trimestre', 'first_quarter', null, 1), ('trimestre', 'second_quarter', null, 2), ('seccion', 'section', null, null)) as t(term, field, year, quarter)"
#: Questions about business, some with what an aggregate says.
BUSINESS = "select question_id, case question_id % 7 when 0 then concat('top 3 obras con mayor importe ', text) when 1 then 'cuantas licitaciones adjudicadas hay en las ultimas 5' when 2 then concat('importe medio de pipeline ', cast(question_id as string)) when 3 then 'suma de cartera' when 4 then 'cuantos metros de obra' else text end as text from v_questions"
TURNS = "select conv_id, turn, case turn % 4 when 0 then concat('proyecto ', cast(20000 + conv_id as string), ' en marzo de 2024 ', role) when 2 then concat('y eso en 2025 ', role) when 1 then concat('y el mismo ', role) else role end as text from conversations"


def of(text: str):
    return lambda s, d: views.run(s, d, text)


asks, questions = of("select * from v_asks"), of("select * from v_questions")

QUERIES = {
    "query_intent": lambda s, d: asks(s, d).select("question_id", intent(bare(F.col("text"))).alias("intent")),
    "query_profile": lambda s, d: profile(asks(s, d)),
    "expected_domains": lambda s, d: expected_domains(questions(s, d), of(DOMAIN_TERMS)(s, d)),
    "expected_variants": lambda s, d: expected_variants(questions(s, d), of(TRIGGERS)(s, d)),
    "rule_expansion": lambda s, d: rule_expansion(questions(s, d), of(RULES)(s, d)),
    "detect_aggregate": lambda s, d: detect_aggregate(of(BUSINESS)(s, d)),
    "detect_fields": lambda s, d: detect_fields(questions(s, d), of(SYNONYMS)(s, d)),
    "business_followup": lambda s, d: followup(of(TURNS)(s, d)),
}

_B = "lower(strip_accents(text))"
_ANY = lambda c, words: "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _whole(pattern: str) -> str:
    """A pattern of whole words for an engine whose \\b knows ASCII only: letters, marks, digits and _ of any script are parts of a word. For finding whether a text matches, not what."""
    word = r"\p{L}\p{Mn}\p{Nd}_"
    ended = re.sub(r"\\b(?=[|)]|$)", lambda m: f"(?:[^{word}]|$)", pattern)
    return ended.replace(r"\b", f"(?:^|[^{word}])")


_INTENT = f"case when regexp_matches(q, '{_whole(PAGE)}') or regexp_matches(q, '{_whole(LOCATION)}') then 'document_location' when contains(q, 'tabla') then 'table_lookup' when regexp_matches(q, '{_whole(COMPARISON)}') then 'comparison' when regexp_matches(q, '{_whole(NUMBER)}') and (regexp_matches(q, '{_whole(UNIT)}') or {_ANY('q', VALUE_WORDS)}) then 'numeric_value' when regexp_matches(q, '{_whole(PROCEDURE)}') then 'procedure' when regexp_matches(q, '{_whole(LIST)}') then 'list' when regexp_matches(q, '{_whole(DEFINITION)}') then 'definition' else 'general' end"
_WORDS = f"w as (select question_id, text, ' ' || regexp_replace({_B}, '[^a-z0-9]+', ' ', 'g') || ' ' as q from v_questions)"
SQL = {
    "query_intent": views.oracle(f"with q as (select question_id, {_B} as q from v_asks) select question_id, {_INTENT} as intent from q"),
    "query_profile": views.oracle(rf"""
with q as (select question_id, {_B} as q from v_asks), f as (select question_id, q, {_INTENT} as intent, contains(q, 'tabla') as is_table, regexp_matches(q, '{_whole(LIST)}') as is_list, regexp_matches(q, '{_whole(SUMMARY)}') as is_summary, regexp_matches(q, '{_whole(DEFINITION)}') as is_definition, regexp_matches(q, '{_whole(COMPARISON)}') as is_comparison, regexp_matches(q, '{_whole(TEMPORAL)}') as is_temporal,
 len(list_distinct(list_filter(regexp_extract_all(q, '\p{{L}}{{4,}}'), lambda w: length(w) >= 5))) as n_keywords, regexp_matches(q, '{_whole(PAGE)}') or regexp_matches(q, '{_whole(TABLE)}') as refs from q),
k as (select *, greatest(case when is_table then 12 when is_summary or is_list then 8 when is_definition or is_comparison then 7 else 6 end, case when is_temporal then 8 else 0 end, case when refs or intent in ('numeric_value', 'table_lookup') then 10 else 0 end) as k from f),
w as (select *, least(greatest(k * 4, 16) + case when n_keywords >= 4 then 10 else 0 end + case when regexp_matches(q, '[0-9]') then 8 else 0 end, 70) as base from k)
select question_id, intent, is_table, is_list, is_summary, is_definition, is_comparison, is_temporal, n_keywords, k, case when is_table or is_list or is_summary or is_definition or is_comparison then least(base + 12, 80) else base end as window from w"""),
    "expected_domains": views.oracle(f"""
with {_WORDS}, t as ({DOMAIN_TERMS}), h as (select question_id, domain, bool_or(is_strong) as strong from w join t on contains(q, ' ' || term || ' ') group by 1, 2)
select question_id, domain, strong from h where strong or question_id not in (select question_id from h where strong)"""),
    "expected_variants": views.oracle(f"""
with v as (select question_id, {_B} as q from v_questions), a as (select *, list_distinct(list_filter(regexp_split_to_array(q, '[^a-z0-9]+'), lambda x: length(x) >= 4)) as words from v), t as ({TRIGGERS}),
p as (select question_id, variant, trigger, contains(q, trigger) as exact, len(list_intersect(words, list_distinct(list_filter(string_split(trigger, ' '), lambda x: length(x) >= 4)))) as o, len(list_distinct(list_filter(string_split(trigger, ' '), lambda x: length(x) >= 4))) as n from a cross join t),
s as (select question_id, variant, exact, case when o = 0 then null when exact then length(trigger) + case when regexp_matches(trigger, '[0-9]') then 20 else 0 end when n >= 2 and o >= case when n <= 3 then n else greatest(3, floor(n * 0.75)) end then o * 5 + length(trigger) / 100 end::double as score from p),
b as (select question_id, variant, max(score) as score, bool_or(exact) as exact from s where score is not null group by 1, 2), k as (select * from b where exact or question_id not in (select question_id from b where exact))
select question_id, variant, round(score, 4) as score, row_number() over (partition by question_id order by score desc, variant) as rank from k"""),
    "rule_expansion": views.oracle(rf"""
with {_WORDS}, r as ({RULES}), h as (select question_id, text, rule_no, needs_all, emits, count(*) filter (contains(q, ' ' || term || ' ')) as n, count(*) as total from w cross join r group by all),
f as (select question_id, text, emits, min(rule_no) as no from h where n > 0 and (n = total or not needs_all) group by all)
select question_id, string_agg(emits, '|' order by no) as phrases, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) || ' ' || string_agg(emits, ' ' order by no) as search_text from f group by question_id, text"""),
    "detect_aggregate": views.oracle(rf"""
with b as ({BUSINESS}), q as (select question_id, {_B} as q, text from b), p as (select *, regexp_matches(trim(regexp_replace(q, '[ \t\n]+', ' ', 'g')), 'est[- ]?[0-9]{{1,4}}[- ]?(19|20)[0-9]{{2}}([^a-z0-9]|$)|(^|[^a-z0-9])[a-z]{{2,6}}-[0-9]{{1,5}}-(19|20)[0-9]{{2}}|(^|[^a-z0-9])(proyecto|obra|licitacion|oferta|estudio) [a-z0-9-]*[0-9][a-z0-9-]{{3}}|(^|[^a-z0-9-])[03-9][0-9]{{3,7}}([^a-z0-9-]|$)|(^|[^a-z0-9-])1[0-8][0-9]{{2,6}}([^a-z0-9-]|$)|(^|[^a-z0-9-])2[1-9][0-9]{{2,6}}([^a-z0-9-]|$)|(^|[^a-z0-9-])(19|20)[0-9]{{3,6}}([^a-z0-9-]|$)') or regexp_matches(text, '"[^"]+"') as has_ref,
 coalesce(nullif(regexp_extract(q, '\btop\s+([0-9]+)\b', 1), ''), nullif(regexp_extract(q, '\b(?:las|los|primeras|primeros|ultimas|ultimos)\s+([0-9]+)\b', 1), ''))::int as num,
 regexp_matches(q, '\btop\s+[0-9]+\b|ranking|\b(proyectos?|obras?|estudios?|licitaci(on|ones)) con (mas|mayor)\b') as top, {_ANY('q', ["importe medio", "importe promedio", "media de ", "promedio de ", "valor medio"])} as av,
 {_ANY('q', ["cuantas ", "cuantos ", "numero de ", "cantidad de "])} and ({_ANY('q', ["ofertas", "licitaciones", "obras", "cierres", "estudios"])} or not {_ANY('q', ["importe", "media", "total", "suma", "cartera"])}) as cnt, {_ANY('q', ["cuanto ", "cuanta ", "total de ", "suma de ", "importe total"])} as sm from q),
k as (select question_id, q, top or not has_ref as free, coalesce(num, 1) as n, cnt, case when cnt then 'count' when av then 'avg' when top then 'top' when sm then 'sum' end as kind from p),
m as (select question_id, free, kind, n, case when cnt then case when contains(q, 'cierre') then 'cierre:count' when contains(q, 'obra') then 'obras' else 'licitaciones' end when contains(q, 'importe') then 'importecontratado' when contains(q, 'cartera') then 'cartera' when contains(q, 'produccion') then 'produccion' end as metric,
 case when contains(q, 'pipeline') then 'pipeline' when contains(q, 'backlog') or contains(q, 'adjudicad') then 'backlog' end as scope, case when regexp_matches(q, 'ultimas|ultimos|recientes') then 'latest' end as sort from k)
select question_id, kind, n, metric, scope, sort from m where free and kind is not null and metric is not null"""),
    "detect_fields": views.oracle(rf"""
with {_WORDS}, s as ({SYNONYMS}), y as (select question_id, q, regexp_extract_all(regexp_replace(lower(text), 'est-[0-9]+-[0-9]+', ' ', 'g'), '\b(19|20)[0-9][0-9]\b') as years, nullif(regexp_extract(q, ' (?:c|trimestre |cuatrimestre )([123]) ', 1), '')::int as asked from w)
select distinct question_id, field from y join s on contains(q, ' ' || term || ' ') where (year is null or len(years) = 0 or list_contains(years, year::varchar)) and (quarter is null or asked is null or quarter = asked)"""),
    "business_followup": views.oracle(rf"""
with t as ({TURNS}), p as (select conv_id, turn, case when turn % 4 = 0 then (20000 + conv_id)::varchar end as ref, case when turn % 4 = 0 then '2024' when turn % 4 = 2 then '2025' end as y, case when turn % 4 = 0 then 3 end as m, turn % 4 in (1, 2) or regexp_matches({_B}, '{FOLLOW_UP}') as f from t),
w as (select *, last_value(ref ignore nulls) over x as lr, last_value(y ignore nulls) over x as ly, last_value(m ignore nulls) over x as lm from p window x as (partition by conv_id order by turn rows between 3 preceding and 1 preceding))
select conv_id, turn, coalesce(ref, case when f then lr end) as reference, coalesce(y, case when f then ly end) as year, coalesce(m, case when f then lm end) as month from w"""),
}
