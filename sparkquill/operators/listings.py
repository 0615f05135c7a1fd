"""Listings and lookups over interactions, conversations, tenders and sources, and the routes of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import views
from .business import parse_questions
from .questions import FOLLOW_UP, of_words
from .retrieval import tokens
from .scoring import bare

#: Words of routes; a user's dictionaries, of which these are a part.
SMALLTALK, OUT_OF_SCOPE = ["hola", "buenos dias", "gracias", "ok", "vale"], ["receta", "futbol", "horoscopo", "tiempo hace"]
DOCUMENTARY = ["manual", "pdf", "documentacion", "documento", "normativa", "norma", "reglamento", "apartado", "seccion", "capitulo", "pagina", "pag"]
TECHNICAL = ["articulo", "tabla", "itc", "clase"]
INVENTORY_NOUNS, INVENTORY_VERBS = ["documentos", "archivos", "ficheros", "manuales"], ["lista", "listado", "muestra", "disponibles", "hay", "cuales"]
TENDER_HINTS, WORK_HINTS = ["licitacion", "oferta", "adjudica"], ["produccion", "control de obras", "cartera", "responsable", "rentabilidad", "codigo de obra"]
MIXED_HINTS = ["cliente", "importe", "presupuesto", "produccion", "estado", "en curso", "top", "ranking"]
SHORTEST = 3
#: Forms of a company's name that do not tell it from others; fixed values.
LEGAL = r"\b(s a|sa|s l|sl|s l u|slu|s a u|sau|sociedad anonima|sociedad limitada|sociedad limitada unipersonal)\b"
#: Words that stand in most turns; a user's list.
STOPWORDS = ["para", "desde", "hasta", "como", "donde", "cuando", "with", "that", "this", "entre", "sobre"]


# -- routes -------------------------------------------------------------------------------------------------------------


def routes(questions: DataFrame) -> DataFrame:
    """question_id, route, module of each question: the first rule of the cascade that holds, and of business questions what they are about."""
    q = questions.select("question_id", F.trim(F.regexp_replace(bare(F.col("text")), r"[ \t\n]+", " ")).alias("q"))
    text, words = F.col("q"), F.split("q", " ")
    any_word = lambda of: F.arrays_overlap(words, F.array(*map(F.lit, of)))
    technical, documentary = of_words(text, TECHNICAL), of_words(text, DOCUMENTARY) | of_words(text, TECHNICAL)
    reference = text.rlike(r"est-[0-9]{1,4}-(19|20)[0-9]{2}")
    business = reference | of_words(text, TENDER_HINTS) | of_words(text, WORK_HINTS) | F.contains(text, F.lit("importe contratado")) | (F.contains(text, F.lit("cliente")) & of_words(text, ["tiene", "tenemos", "del cliente"]))
    business = business & ~(technical & ~reference & ~of_words(text, MIXED_HINTS))
    smalltalk = text.rlike("^(" + "|".join(SMALLTALK) + r")\b") | ((F.size(words) <= 5) & of_words(text, ["gracias", "perfecto"]))
    module = F.when(of_words(text, ["licitacion", "estudio", "oferta", "pipeline", "backlog"]), "tenders").when(of_words(text, ["control de produccion", "cierre", "codigo de obra", "cartera", "rentabilidad"]) | text.rlike(r"\b(en|de|del) produccion\b"), "works").when(reference, "tenders")
    module = module.when(of_words(text, ["proyecto", "obra"]) & of_words(text, ["cliente", "en curso", "estado", "importe", "produccion"]), "works").when(of_words(text, ["cliente", "estado", "importe medio"]), "tenders")
    route = F.when(F.length(text) < SHORTEST, "invalid").when(smalltalk & ~documentary, "smalltalk").when(of_words(text, OUT_OF_SCOPE) & ~documentary, "out_of_scope").when(any_word(INVENTORY_NOUNS) & any_word(INVENTORY_VERBS), "document_inventory")
    route = route.when(business & technical & of_words(text, MIXED_HINTS) & ~reference, "mixed_scope").when(documentary & technical & ~reference, "knowledge").when(business, F.concat(F.lit("business_"), F.coalesce(module, F.lit("tenders")))).otherwise("knowledge")
    return q.select("question_id", route.alias("route"), F.when(~(technical & ~reference) & (business | ~documentary), module).alias("module"))


def recovered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, route: a follow-up takes the inventory route of one of the three turns before it; without a route of its own it takes the last business route, else that of knowledge."""
    found = routes(turns.select(F.struct("conv_id", "turn").alias("question_id"), "text"))
    rows = turns.select("conv_id", "turn", bare(F.col("text")).rlike(FOLLOW_UP).alias("follows"), F.struct("conv_id", "turn").alias("question_id")).join(found, "question_id")
    w = Window.partitionBy("conv_id").orderBy("turn")
    inventory = F.max(F.col("route") == "document_inventory").over(w.rowsBetween(-3, -1))
    business = F.last(F.when(F.col("route").startswith("business_"), F.col("route")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    lost = F.col("route").isin("smalltalk", "invalid", "out_of_scope")
    route = F.when(~F.col("follows"), F.col("route")).when(inventory, "document_inventory").when(lost | ((F.col("route") == "knowledge") & business.isNotNull()), F.coalesce(business, F.lit("knowledge"))).otherwise(F.col("route"))
    return rows.select("conv_id", "turn", route.alias("route"))


# -- interactions -------------------------------------------------------------------------------------------------------


def model_comparison(interactions: DataFrame, prices: DataFrame, base: str = "m0", second: str = "m1") -> DataFrame:
    """One row: second less base in count, cost, mean latency, errors and validation rate; a model without rows counts as zeros."""
    rows = interactions.join(prices, "model", "left").where(F.col("model").isin(base, second))
    cost = F.col("prompt_tokens") / 1e6 * F.coalesce("price_in", F.lit(0.0)) + F.col("completion_tokens") / 1e6 * F.coalesce("price_out", F.lit(0.0))
    of = lambda c, m: F.when(F.col("model") == m, c)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rate = lambda m: zero(F.count_if((F.col("model") == m) & (F.col("state") == "validated")) / F.nullif(F.count_if((F.col("model") == m) & F.col("state").isin("validated", "rejected")), F.lit(0)))
    delta = lambda f: f(second) - f(base)
    return rows.agg(
        delta(lambda m: F.count_if(F.col("model") == m)).alias("count_delta"),
        F.round(delta(lambda m: zero(F.sum(of(cost, m)))), 6).alias("cost_delta"),
        F.round(delta(lambda m: zero(F.avg(of(F.col("total_ms"), m)))), 2).alias("latency_delta"),
        delta(lambda m: F.count_if((F.col("model") == m) & (F.col("route") == "error"))).alias("error_delta"),
        F.round(delta(rate), 4).alias("rate_delta"),
    )


def latest_match(messages: DataFrame, interactions: DataFrame) -> DataFrame:
    """conv_id, turn, id: for each message the latest interaction of its conversation with the same question and answer, if any."""
    latest = interactions.groupBy("conv_id", "question", "answer").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))
    return messages.join(latest, ["conv_id", "question", "answer"], "left").select("conv_id", "turn", "id")


def conversation_list(turns: DataFrame) -> DataFrame:
    """conv_id, title, mode, n_turns, place: a user's conversations, newest first; the mode is read from the title where none is given."""
    rows = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"), F.max("mode").alias("mode"))
    title = F.trim(F.substring("first", 1, 60))
    mode = F.when(F.lower("mode").isin("business", "negocio"), "business").when(F.lower("mode").isin("technical", "tecnico"), "technical").when(bare(title).rlike("importe|cliente|oferta|obra"), "business").otherwise("technical")
    place = F.row_number().over(Window.partitionBy((F.col("conv_id") % 10).alias("u")).orderBy(F.desc("last_turn"), F.desc("conv_id")))
    return rows.select("conv_id", title.alias("title"), mode.alias("mode"), "n_turns", place.alias("place"))


def interaction_detail(interactions: DataFrame, conversations: DataFrame, users: DataFrame) -> DataFrame:
    """id, state, user_name, title, sources of each interaction; sources are a JSON array, or what stands there if they are not."""
    parsed = F.from_json("sources", "array<string>")
    sources = F.when(F.trim("sources").startswith("[") & parsed.isNotNull(), parsed).when(F.coalesce("sources", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array("sources"))
    return interactions.join(conversations, "conv_id", "left").join(users, "user_id", "left").select("id", "state", "user_name", "title", F.array_join(sources, "|").alias("sources"))


def ground_truth(knowledge: DataFrame, interactions: DataFrame) -> DataFrame:
    """id, question, n_sources, sources, route of what was validated; sources as in interaction_detail(), without empty ones."""
    parsed = F.from_json("sources", "array<string>")
    sources = F.when(F.trim("sources").startswith("[") & parsed.isNotNull(), parsed).otherwise(F.array("sources"))
    sources = F.filter(sources, lambda s: F.coalesce(s, F.lit("")) != "")
    return knowledge.join(interactions, "id", "left").select("id", F.coalesce("question", F.lit("")).alias("question"), F.size(sources).alias("n_sources"), F.array_join(sources, "|").alias("sources"), F.coalesce("route", F.lit("")).alias("route"))


def jaccard_gate(turns: DataFrame) -> DataFrame:
    """conv_id, turn, passes: each turn and the one before it share a quarter of their words, without stop words; an empty side passes."""
    words = lambda c: F.array_distinct(F.filter(tokens(c), lambda w: ~w.isin(STOPWORDS)))
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns.withColumn("before", before).where("before is not null").withColumns({"a": words(F.col("text")), "b": words(F.col("before"))})
    same, all_ = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return rows.select("conv_id", "turn", ((F.size("a") == 0) | (F.size("b") == 0) | (same >= 0.25 * all_)).alias("passes"))


# -- business and sources -----------------------------------------------------------------------------------------------


def reference_search(tenders: DataFrame, reference: str, take: int = 20) -> DataFrame:
    """id, project_no, offer_no, rank: tenders with the reference in one of four columns, exact numbers first; the first take."""
    like = f"%{reference}%"
    columns = ["project_no", "offer_no", "work_name", "client"]
    rank = F.when(F.col("project_no") == reference, 0).when(F.col("offer_no") == reference, 1).when(F.col("project_no").ilike(like), 2).when(F.col("offer_no").ilike(like), 3).otherwise(4)
    return tenders.where(reduce(Column.__or__, (F.col(c).ilike(like) for c in columns))).select("id", "project_no", "offer_no", rank.alias("rank")).orderBy("rank", "project_no", "offer_no", "id").limit(take)


def client_search(asked: DataFrame, tenders: DataFrame) -> DataFrame:
    """asked_id, id, match: tenders of the client asked for: those of exactly that name, legal forms aside; only if there are none those whose name has it as whole words. An equi-join on the name's first word."""
    canonical = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(bare(c), F.lit("."), F.lit(" ")), LEGAL, " "), "[^a-z0-9]+", " "), " +", " "))
    names = tenders.select(canonical(F.col("client")).alias("name")).distinct()
    words = names.withColumn("first", F.explode(F.array_distinct(F.split("name", " "))))
    q = asked.select("asked_id", canonical(F.col("client")).alias("needle")).where("needle <> ''").withColumn("first", F.split_part("needle", F.lit(" "), F.lit(1)))
    hits = q.join(words, "first").where(F.contains(F.concat(F.lit(" "), "name", F.lit(" ")), F.concat(F.lit(" "), "needle", F.lit(" "))))
    hits = hits.withColumn("exact", F.col("name") == F.col("needle")).withColumn("any_exact", F.bool_or("exact").over(Window.partitionBy("asked_id"))).where("exact or not any_exact")
    return hits.select("asked_id", "name", F.when(F.col("exact"), "exact").otherwise("words").alias("match")).join(tenders.select("id", canonical(F.col("client")).alias("name")), "name").select("asked_id", "id", "match")


def derived_measures(wide: DataFrame, years: list[int]) -> DataFrame:
    """id, year, produced, pipeline: for each year asked for its column, else the base, else 0 (0 for a year that is none); pipeline sums what the later years have."""
    of = lambda y: F.coalesce(F.col(f"y{y}"), F.col("base"), F.lit(0.0)) if f"y{y}" in wide.columns else F.lit(0.0)
    later = lambda y: sum((F.coalesce(F.col(c), F.lit(0.0)) for c in wide.columns if c[0] == "y" and int(c[1:]) > y), F.lit(0.0))
    rows = F.array(*(F.struct(F.lit(y).alias("year"), F.round(of(y), 2).alias("produced"), F.round(later(y), 2).alias("pipeline")) for y in years))
    return wide.select("id", F.explode(rows).alias("x")).select("id", "x.*")


def work_listing(works: DataFrame, ranked: bool, take: int = 5) -> DataFrame:
    """id, place: works that are not finished, by three measures or by when they changed; the first take."""
    active = works.where(~F.coalesce("finished", F.lit(False)) & ~F.lower(F.trim(F.coalesce("state", F.lit("")))).isin("completada", "finalizada"))
    order = [F.coalesce(c, F.lit(0.0)).desc() for c in ("amount", "backlog", "pending")] if ranked else [F.coalesce("updated_at", "created_at").desc_nulls_last()]
    top = active.orderBy(*order, "id").limit(take)
    return top.select("id", F.row_number().over(Window.orderBy(*order, "id")).alias("place"))  # take rows


def closing_fields(asked: DataFrame, values: DataFrame) -> DataFrame:
    """asked_id, label, value, rank: of a closing's values those that a question names: exact labels, else those with most of its words in the label; each once, six at most."""
    q = asked.withColumn("words", F.array_distinct(F.filter(F.split(F.regexp_replace(bare(F.col("text")), "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) >= 3) & ~w.isin("cierre", "obra", "del", "cual", "que"))))
    plain = F.lower(F.regexp_replace("label", "(?<=[a-z])(?=[A-Z])", " "))
    rows = q.join(values.where("value is not null and value <> '' and label not like '\\_\\_%'").withColumn("plain", plain), "key")
    score = F.size(F.filter("words", lambda w: F.contains(F.col("plain"), w)))
    exact = F.contains(bare(F.col("text")), F.col("plain"))
    rows = rows.select("asked_id", "label", "value", score.alias("score"), exact.alias("exact")).where("score > 0 or exact").distinct()
    rows = rows.withColumn("any_exact", F.bool_or("exact").over(Window.partitionBy("asked_id"))).where("exact or not any_exact")
    rank = F.row_number().over(Window.partitionBy("asked_id").orderBy(F.desc("score"), "label", "value"))
    return rows.withColumn("rank", rank).where("rank <= 6").select("asked_id", "label", "value", "rank")


def traces(questions: DataFrame, tenders: DataFrame) -> DataFrame:
    """module, route, has_filter, outcome, n: how business questions were answered: found, ambiguous, not found, or without a reference."""
    parsed = parse_questions(questions).select("question_id", "reference", F.col("client").isNotNull().alias("has_filter"))
    known = tenders.groupBy("offer_no").agg(F.count("*").alias("n"))
    rows = parsed.join(routes(questions), "question_id").join(known, F.col("reference") == F.col("offer_no"), "left")
    outcome = F.when(F.col("reference").isNull(), "no_reference").when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("answered")
    return rows.groupBy(F.coalesce("module", F.lit("none")).alias("module"), "route", "has_filter", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def inventory(sources: DataFrame) -> DataFrame:
    """domain, n_documents, documents: paths without odd slashes by their first folder, with the names of their files in order; a name is listed where it comes first."""
    path = F.regexp_replace(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    rows = sources.select(path.alias("path")).where("path <> ''").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("domain"), F.element_at(F.split("path", "/"), -1).alias("name"), "path")
    first = rows.groupBy("name").agg(F.min_by("domain", "path").alias("domain"))
    return first.groupBy("domain").agg(F.count("*").alias("n_documents"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("documents"))


# -- queries ------------------------------------------------------------------------------------------------------------

ASKED = "select question_id, case question_id % 11 when 0 then concat('hola ', text) when 1 then concat('lista de documentos disponibles ', text) when 2 then 'receta de futbol' when 3 then concat('licitacion en curso ', text) when 4 then 'ok' when 5 then concat('obra en curso del cliente ', text) when 6 then 'cartera del cliente en la tabla 3' else text end as text from v_questions"
TURNS = "select conv_id, turn, case turn % 4 when 0 then concat('licitacion del cliente ', text) when 1 then 'ok' when 2 then concat('y eso ', text) else concat('pero ', text) end as text from conversations"
MESSAGES = "select conv_id, turn, question, answer from (select conv_id, turn, role, text as question, lead(text) over (partition by conv_id order by turn) as answer from conversations) x where role = 'user' and answer is not null"
APPLIED = "select m.conv_id, m.question, m.answer, e.event_id as id, e.ts as created_at from events e join (MESSAGES) m on e.event_id % 300 = m.conv_id and m.turn % 3 = e.event_id % 3".replace("MESSAGES", MESSAGES)
MODES = "select conv_id, turn, text, case conv_id % 4 when 0 then 'Negocio' when 1 then 'technical' when 2 then '' end as mode from conversations"
DETAIL = "select event_id as id, event_id % 100 as conv_id, event_id % 40 as user_id, case when event_id % 5 = 0 then 'rejected' else 'validated' end as state, event_type as route, case event_id % 4 when 0 then '[\"a.pdf\",\"b.pdf\"]' when 1 then 'c.pdf' when 2 then '[broken' end as sources from events"
TITLES = "select conv_id, text as title from conversations where turn = 0"
USERS = "select c_custkey as user_id, c_name as user_name from customer"
TENDERS = "select id, concat('P', cast(id % 500 as string)) as project_no, offer_no, work_name, client from v_tenders"
COMPANIES = "select id, concat('Obras ', cast(id % 40 as string), case id % 4 when 0 then ' S.A.' when 1 then ' S.L.' when 2 then ' del Norte SA' else '' end) as client from v_tenders"
CLIENTS = "select n_nationkey as asked_id, case n_nationkey % 3 when 0 then concat('OBRAS ', cast(n_nationkey as string), ', s.l.') when 1 then concat('Obras ', cast(n_nationkey as string), ' del Norte') else concat(cast(n_nationkey as string), ' del Norte') end as client from nation"
WIDE = "select l_orderkey as id, case when l_orderkey % 4 = 0 then null else round(sum(l_extendedprice), 2) end as base, round(sum(case when year(l_shipdate) = 1995 then l_extendedprice end), 2) as y1995, round(sum(case when year(l_shipdate) = 1996 then l_extendedprice end), 2) as y1996, round(sum(case when year(l_shipdate) = 1997 then l_extendedprice end), 2) as y1997 from lineitem group by l_orderkey"
WORKS = "select o_orderkey as id, o_orderstatus = 'F' as finished, case when o_orderkey % 3 = 0 then 'Completada ' when o_orderkey % 3 = 1 then 'En curso' end as state, case when o_orderkey % 2 = 0 then o_totalprice end as amount, round(o_totalprice / 2, 2) as backlog, cast(o_orderkey % 100 as double) as pending, case when o_orderkey % 5 = 0 then null else o_orderdate end as updated_at, o_orderdate as created_at from orders"
FIELDS = "select l_orderkey as key, case l_linenumber when 1 then 'presupuestoTotal' when 2 then 'costeTotal' when 3 then 'margenPrevisto' when 4 then '__interno' else 'costeMateriales' end as label, cast(l_quantity as string) as value from lineitem"
FIELD_QUESTIONS = "select o_orderkey as asked_id, o_orderkey as key, case o_orderkey % 4 when 0 then 'cual es el coste total del cierre' when 1 then 'coste y margen' when 2 then 'presupuesto' else 'nada de eso' end as text from orders"


def of(text: str):
    return lambda s, d: views.run(s, d, text)


QUERIES = {
    "route_question": lambda s, d: routes(of(ASKED)(s, d)).select("question_id", "route"),
    "route_business": lambda s, d: routes(of(ASKED)(s, d)).select("question_id", "module"),
    "route_recovery": lambda s, d: recovered(of(TURNS)(s, d)),
    "model_comparison": lambda s, d: model_comparison(of("select * from v_interactions")(s, d), of("select * from v_prices")(s, d)),
    "latest_match_apply": lambda s, d: latest_match(of(MESSAGES)(s, d), of(APPLIED)(s, d)),
    "conversation_list": lambda s, d: conversation_list(of(MODES)(s, d)),
    "interaction_detail": lambda s, d: interaction_detail(of(DETAIL)(s, d), of(TITLES)(s, d), of(USERS)(s, d)),
    "load_ground_truth": lambda s, d: ground_truth(of(DETAIL)(s, d).where("state = 'validated'").select("id", "conv_id", "sources").join(of(TITLES)(s, d).withColumnRenamed("title", "question"), "conv_id", "left"), of(DETAIL)(s, d).where("id % 3 <> 0").select("id", "route")),
    "jaccard_gate": lambda s, d: jaccard_gate(s.read.parquet(f"{d}/conversations.parquet")),
    "ranked_reference_search": lambda s, d: reference_search(of(TENDERS)(s, d), "P12"),
    "client_search": lambda s, d: client_search(of(CLIENTS)(s, d), of(COMPANIES)(s, d)),
    "derived_measure": lambda s, d: derived_measures(of(WIDE)(s, d), [1995, 1996, 2030]),
    "listing_sort_filter": lambda s, d: work_listing(of(WORKS)(s, d), True).withColumn("by", F.lit("value")).unionByName(work_listing(of(WORKS)(s, d), False).withColumn("by", F.lit("time"))),
    "field_token_match": lambda s, d: closing_fields(of(FIELD_QUESTIONS)(s, d), of(FIELDS)(s, d)),
    "source_traceability": lambda s, d: traces(of("select * from v_questions")(s, d), of("select * from v_tenders")(s, d)),
    "inventory_grouping": lambda s, d: inventory(of("select path from v_sources_all")(s, d)),
}

_ANY = lambda words, c="q": "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"
_REF = "regexp_matches(q, 'est-[0-9]{1,4}-(19|20)[0-9]{2}')"


def _routed(rows: str) -> str:
    """CTEs up to r (id, route, module) of rows (id, text)."""
    return rf"""
b as (select id, trim(regexp_replace(lower(strip_accents(text)), '[ \t\n]+', ' ', 'g')) as q from ({rows}) x),
f as (select id, q, string_split(q, ' ') as w, {_ANY(TECHNICAL)} as tech, {_ANY(DOCUMENTARY)} or {_ANY(TECHNICAL)} as doc, {_REF} as ref, {_ANY(MIXED_HINTS)} as mixed from b),
g as (select *, (ref or {_ANY(TENDER_HINTS)} or {_ANY(WORK_HINTS)} or contains(q, 'importe contratado') or (contains(q, 'cliente') and {_ANY(["tiene", "tenemos", "del cliente"])})) and not (tech and not ref and not mixed) as biz, regexp_matches(q, '^({"|".join(SMALLTALK)})\b') or (len(w) <= 5 and {_ANY(["gracias", "perfecto"])}) as small,
 case when {_ANY(["licitacion", "estudio", "oferta", "pipeline", "backlog"])} then 'tenders' when {_ANY(["control de produccion", "cierre", "codigo de obra", "cartera", "rentabilidad"])} or regexp_matches(q, '\b(en|de|del) produccion\b') then 'works' when ref then 'tenders' when {_ANY(["proyecto", "obra"])} and {_ANY(["cliente", "en curso", "estado", "importe", "produccion"])} then 'works' when {_ANY(["cliente", "estado", "importe medio"])} then 'tenders' end as m from f),
r as (select id, case when length(q) < 3 then 'invalid' when small and not doc then 'smalltalk' when {_ANY(OUT_OF_SCOPE)} and not doc then 'out_of_scope' when list_has_any(w, {INVENTORY_NOUNS}) and list_has_any(w, {INVENTORY_VERBS}) then 'document_inventory' when biz and tech and mixed and not ref then 'mixed_scope' when doc and tech and not ref then 'knowledge' when biz then 'business_' || coalesce(m, 'tenders') else 'knowledge' end as route,
 case when not (tech and not ref) and (biz or not doc) then m end as module from g)"""


_SRC = "case when starts_with(trim(sources), '[') and try_cast(sources as json) is not null then from_json(sources::json, '[\"varchar\"]') when coalesce(sources, '') = '' then [] else [sources] end"
_CANON = lambda c: rf"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(strip_accents({c})), '.', ' '), '{LEGAL}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"
_KEEP = lambda c: rf"list_distinct(list_filter(regexp_extract_all(lower({c}), '\p{{L}}{{4,}}'), lambda w: w not in ({', '.join(repr(w) for w in STOPWORDS)})))"
SQL = {
    "route_question": views.oracle(f"with {_routed(f'select question_id as id, text from ({ASKED}) a')} select id as question_id, route from r"),
    "route_business": views.oracle(f"with {_routed(f'select question_id as id, text from ({ASKED}) a')} select id as question_id, module from r"),
    "route_recovery": f"""
with t as ({TURNS}), {_routed("select conv_id * 1000 + turn as id, text from t")}, j as (select conv_id, turn, route, regexp_matches(lower(strip_accents(text)), '{FOLLOW_UP}') as follows from t join r on id = conv_id * 1000 + turn),
w as (select *, max((route = 'document_inventory')::int) over (partition by conv_id order by turn rows between 3 preceding and 1 preceding) as inv, last_value(case when route like 'business%' then route end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as biz from j)
select conv_id, turn, case when not follows then route when inv = 1 then 'document_inventory' when route in ('smalltalk', 'invalid', 'out_of_scope') or (route = 'knowledge' and biz is not null) then coalesce(biz, 'knowledge') else route end as route from w""",
    "model_comparison": views.oracle("""
with m as (select model, count(*) as n, sum(prompt_tokens / 1e6 * coalesce(price_in, 0) + completion_tokens / 1e6 * coalesce(price_out, 0)) as cost, avg(total_ms) as ms, count(*) filter (route = 'error') as errors, count(*) filter (state = 'validated')::double / nullif(count(*) filter (state in ('validated', 'rejected')), 0) as rate from v_interactions left join v_prices using (model) where model in ('m0', 'm1') group by model),
s as (select max(case when model = 'm0' then {'n': n, 'c': cost, 'l': ms, 'e': errors, 'r': rate} end) as a, max(case when model = 'm1' then {'n': n, 'c': cost, 'l': ms, 'e': errors, 'r': rate} end) as b from m)
select coalesce(b.n, 0) - coalesce(a.n, 0) as count_delta, round(coalesce(b.c, 0) - coalesce(a.c, 0), 6) as cost_delta, round(coalesce(b.l, 0) - coalesce(a.l, 0), 2) as latency_delta, coalesce(b.e, 0) - coalesce(a.e, 0) as error_delta, round(coalesce(b.r, 0) - coalesce(a.r, 0), 4) as rate_delta from s"""),
    "latest_match_apply": f"with m as ({MESSAGES}), i as ({APPLIED}) select m.conv_id, m.turn, (select arg_max(id, (created_at, id)) from i where i.conv_id = m.conv_id and i.question = m.question and i.answer = m.answer) as id from m",
    "conversation_list": f"""
with g as (select conv_id, arg_min(text, turn) as first, count(*) as n_turns, max(turn) as last_turn, max(mode) as mode from ({MODES}) m group by conv_id), t as (select *, trim(first[1:60]) as title from g)
select conv_id, title, case when lower(mode) in ('business', 'negocio') then 'business' when lower(mode) in ('technical', 'tecnico') then 'technical' when regexp_matches(lower(strip_accents(title)), 'importe|cliente|oferta|obra') then 'business' else 'technical' end as mode, n_turns, row_number() over (partition by conv_id % 10 order by last_turn desc, conv_id desc) as place from t""",
    "interaction_detail": f"with i as ({DETAIL}), t as ({TITLES}), u as ({USERS}) select id, state, user_name, title, array_to_string({_SRC}, '|') as sources from i left join t using (conv_id) left join u using (user_id)",
    "load_ground_truth": f"with i as ({DETAIL}), t as ({TITLES}), k as (select id, title, list_filter({_SRC}, lambda s: coalesce(s, '') <> '') as l from i left join t using (conv_id) where state = 'validated') select k.id, coalesce(title, '') as question, len(l) as n_sources, array_to_string(l, '|') as sources, coalesce(case when i.id % 3 <> 0 then route end, '') as route from k left join i on i.id = k.id",
    "jaccard_gate": f"with t as (select conv_id, turn, {_KEEP('text')} as a, {_KEEP('lag(text) over (partition by conv_id order by turn)')} as b, lag(text) over (partition by conv_id order by turn) as before from conversations) select conv_id, turn, len(a) = 0 or len(b) = 0 or len(list_intersect(a, b)) >= 0.25 * len(list_distinct(list_concat(a, b))) as passes from t where before is not null",
    "ranked_reference_search": views.oracle(f"with t as ({TENDERS}) select id, project_no, offer_no, case when project_no = 'P12' then 0 when offer_no = 'P12' then 1 when project_no ilike '%P12%' then 2 when offer_no ilike '%P12%' then 3 else 4 end as rank from t where concat_ws('|', project_no, offer_no, work_name, client) ilike '%P12%' order by rank, project_no, offer_no, id limit 20"),
    "client_search": views.oracle(f"""
with t as (select id, {_CANON('client')} as name from ({COMPANIES}) c), q as (select asked_id, {_CANON('client')} as needle from ({CLIENTS}) c), h as (select asked_id, id, name = needle as exact from q join t on contains(' ' || name || ' ', ' ' || needle || ' '))
select asked_id, id, case when exact then 'exact' else 'words' end as match from h where exact or asked_id not in (select asked_id from h where exact)"""),
    "derived_measure": f"with w as ({WIDE}) select id, 1995 as year, coalesce(y1995, base, 0) as produced, round(coalesce(y1996, 0) + coalesce(y1997, 0), 2) as pipeline from w union all select id, 1996, coalesce(y1996, base, 0), coalesce(y1997, 0) from w union all select id, 2030, 0, 0 from w",
    "listing_sort_filter": f"""
with w as ({WORKS}), a as (select * from w where not finished and coalesce(state, '') not like 'Completada%'), v as (select id, row_number() over (order by coalesce(amount, 0) desc, backlog desc, pending desc, id) as place from a), t as (select id, row_number() over (order by coalesce(updated_at, created_at) desc, id) as place from a)
select id, place, 'value' as by from v where place <= 5 union all select id, place, 'time' from t where place <= 5""",
    "field_token_match": rf"""
with q as (select asked_id, key, text, list_distinct(list_filter(regexp_split_to_array(text, '[^a-z0-9]+'), lambda w: length(w) >= 3 and w not in ('cierre', 'obra', 'del', 'cual', 'que'))) as words from ({FIELD_QUESTIONS}) x), v as (select key, label, value, lower(regexp_replace(label, '([a-z])([A-Z])', '\1 \2', 'g')) as plain from ({FIELDS}) y where label <> '__interno'),
m as (select distinct asked_id, label, value, len(list_filter(words, lambda w: contains(plain, w))) as score, contains(text, plain) as exact from q join v using (key)), n as (select * from m where score > 0 or exact), o as (select * from n where exact or asked_id not in (select asked_id from n where exact))
select asked_id, label, value, row_number() over (partition by asked_id order by score desc, label, value) as rank from o qualify rank <= 6""",
    "source_traceability": views.oracle(f"""
with {_routed("select question_id as id, text from v_questions")}, p as (select question_id as id, regexp_extract(text, 'EST-[0-9]+-[0-9]+') as ref, regexp_matches(text, 'cliente [A-Za-z]+#[0-9]+') as has_filter, text from v_questions), k as (select offer_no, count(*) as n from v_tenders group by 1),
t as (select coalesce(module, 'none') as module, route, has_filter, case when ref = '' then 'no_reference' when n is null then 'not_found' when n > 1 then 'ambiguous' else 'answered' end as outcome from p join r using (id) left join k on k.offer_no = p.ref) select module, route, has_filter, outcome, count(*) as n from t group by all"""),
    "inventory_grouping": views.oracle("with p as (select string_split(path, '/') as s, path from v_sources_all), f as (select s[-1] as name, arg_min(s[1], path) as domain from p group by 1) select domain, count(*) as n_documents, string_agg(name, ',' order by name) as documents from f group by domain"),
}
