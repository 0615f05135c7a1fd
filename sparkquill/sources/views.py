"""Views that stand for the tables of a question-answering service, over the given tables.

One text serves Spark and, as an oracle, other engines; JSON_K(x) is the one function that differs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    "v_interactions": """
select event_id as id, event_id % 100 as conversation_id, user_id, ts as created_at,
  case when event_id % 5 = 0 then 'rejected' when event_id % 5 in (1, 2) then 'validated' else 'pending' end as state,
  case when event_id % 3 = 0 then 'm0' when event_id % 3 = 1 then 'm1' end as model,
  case when event_id % 11 = 0 then null else event_type end as route,
  value * 10 as total_ms, case when event_id % 7 = 0 then null else value end as router_ms, value * 3 as rag_ms, value * 5 as llm_ms, value as db_ms,
  cast(JSON_K(props) as bigint) * 10 as prompt_tokens, cast(JSON_K(props) as bigint) as completion_tokens, cast(JSON_K(props) as bigint) / 100.0 as confidence
from events""",
    "v_prices": "select 'm0' as model, 0.5 as price_in, 1.5 as price_out union all select 'm1', 2.0, 6.0",
    "v_runs": """
select cast(row_number() over (order by d) as bigint) as run_id, started_at, completed_at, case when (row_number() over (order by d)) % 5 = 0 then null else 'success' end as conclusion
from (select cast(ts as date) as d, min(ts) as started_at, max(ts) as completed_at from events group by cast(ts as date)) x""",
    "v_tenders": """
select o_orderkey as id, concat('EST-', cast(o_orderkey % 1000 as string), '-', cast(year(o_orderdate) as string)) as offer_no, c_name as client,
  case o_orderstatus when 'F' then 'Adjudicada' when 'O' then 'Pendiente de Presentar' else 'Potencial' end as state,
  o_totalprice as amount, case when o_orderkey % 4 = 0 then null else o_orderdate end as award_date, o_orderdate as created_at, o_orderpriority as work_name
from orders join customer on o_custkey = c_custkey""",
    "v_closings": """
select l_orderkey as id, l_linenumber as line, l_returnflag as area, substr(cast(l_shipdate as string), 1, 7) as period, l_shipdate as updated_at,
  case when l_linenumber % 5 = 0 then 'abc' when l_linenumber % 2 = 0 then replace(cast(cast(l_extendedprice as decimal(18,2)) as string), '.', ',') else cast(cast(l_extendedprice as decimal(18,2)) as string) end as value_text
from lineitem""",
    "v_sources": """
select concat(source, '/', lang, '/doc_', cast(doc_id as string), case when doc_id % 3 = 0 then '.pdf' else '.md' end) as path, md5(text) as hash, doc_id, source, lang
from documents where doc_id % 10 <> 2""",
    "v_sources_all": """
select concat(source, '/', lang, '/doc_', cast(doc_id as string), case when doc_id % 3 = 0 then '.pdf' else '.md' end) as path, md5(text) as hash, doc_id, source, lang
from documents""",
    "v_sources_new": """
select concat(source, '/', lang, '/doc_', cast(doc_id as string), case when doc_id % 3 = 0 then '.pdf' else '.md' end) as path, case when doc_id % 10 = 1 then md5(concat(text, ' edited')) else md5(text) end as hash, doc_id, source, lang
from documents where doc_id % 10 <> 0""",
    "v_lines": """
<<select doc_id, source, lang, cast(pos + 1 as bigint) as line_no, line from (select doc_id, source, lang, posexplode(split(text, chr(10))) as (pos, line) from documents) x|||
select doc_id, source, lang, cast(generate_subscripts(split(text, chr(10)), 1) as bigint) as line_no, unnest(split(text, chr(10))) as line from documents>>""",
    "v_chunks": """
select concat(source, '-', cast(doc_id as string), '-', cast(line_no as string)) as chunk_id, doc_id, source, lang, 1 + cast(floor((line_no - 1) / 5.0) as bigint) as page, line_no as chunk, line as text
from v_lines where trim(line) <> ''""",
    # lines with the forms that rules and tables have, so that what looks for them finds some
    "v_norms": """
select chunk_id, source, doc_id, page, chunk, case chunk % 4 when 0 then concat('Capítulo ', cast(page as string), ' Objeto') when 1 then '' else concat('Artículo ', cast(chunk as string)) end as section,
 case chunk % 12 when 0 then concat('Artículo ', cast(chunk % 20 as string), '. Objeto y ámbito. ', text) when 1 then concat('Tabla ', cast(page as string), '.1 circuito C', cast(chunk % 9 + 1 as string), ' C2 fase; ', text) when 2 then concat(text, ' - ', cast(page as string), ' - clase II tipo b2 IP45')
 when 3 then concat('ITC-BT-', cast(10 + chunk % 50 as string), ' ', text, ' de 0,2 mm2 y 16 A') when 4 then concat('CAPÍTULO I. ', text) when 5 then concat('pasos para la puesta en marcha ', text) when 6 then concat('Real Decreto 842/2002 ', text) when 7 then concat('3.', cast(chunk % 5 as string), ' Medidas en local interior')
 when 8 then concat('articulo 1 articulo 2 articulo 3 articulo 4 . . . . ', text) when 9 then concat('IT 3.1. ', text, '..... 12') when 10 then concat('debe debe debe ', 'debe debe debe debe debe debe') else text end as text from v_chunks""",
    # questions that refer to rules, tables, values and labels
    "v_asks": """
select question_id, case question_id % 6 when 0 then concat(text, ' segun la ITC-BT-', cast(question_id % 60 as string), ' y la guia 7, tabla 03.1') when 1 then concat(text, ' art. 0', cast(question_id % 9 + 1 as string), ' y articulo 12 del RD 0842/2002, pag. 4 y pagina 5')
 when 2 then concat('IT 1.2 e IT 1.2 con 0,2 mm2, 16A y 230 V clase II tipo b', cast(question_id % 4 as string), ' IP45 esquema TN-S ', text) when 3 then concat(text, ' IK 08 categoría 3 de 1,5kW') else text end as text from v_questions""",
    "v_questions": """
select conv_id * 100 + turn as question_id, text from conversations where role = 'user'
union all select 1000000000 + o_orderkey, concat('importe total de EST-', cast(o_orderkey % 1000 as string), '-', cast(year(o_orderdate) as string), ' para el cliente ', c_name, ' trimestre ', cast(quarter(o_orderdate) as string)) from orders join customer on o_custkey = c_custkey
union all select 2000000000 + p_partkey, concat('articulo ', cast(p_size as string), ' tabla 3.1 pag. ', cast(p_size % 9 + 1 as string), ' clase a1 seccion 0,2 mm2 ', lower(p_name)) from part""",
    # Dictionaries are inputs of a user; these few rows stand for them.
    "v_terms": "select * from (values ('with', 'web', true), ('that', 'books', true), ('tion', 'forum', true), ('this', 'web', false), ('importe', 'tenders', true), ('cliente', 'tenders', false), ('articulo', 'norms', true), ('tabla', 'norms', false)) as t(term, domain, is_strong)",
    "v_profiles": "select * from (values ('src0', 'legal'), ('src0/en', 'legal_en'), ('src1', 'manual'), ('src2/de', 'norm')) as t(prefix, profile)",
}

#: Letters of the corpus languages and the same letters without their marks.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçÿý"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"
#: A letter of the corpus languages.
LETTERS = "[a-zß-öø-ÿœ]"
#: What a query's text calls a function: its name in Spark, its name in the other engine.
NAMES = {"ARR_FILTER": ("filter", "list_filter"), "ARR_MAP": ("transform", "list_transform"), "LEN": ("size", "len"), "JOIN_ARR": ("array_join", "array_to_string"), "RX": ("regexp_like", "regexp_matches"), "EXPLODE": ("explode", "unnest"), "strpos_of": ("instr", "instr"), "COLLECT": ("collect_list", "list"), "ARRAY_OF": ("array", "list_value")}


def dialect(text: str, spark: bool) -> str:
    """A query's text for Spark or for the engine that checks it: NAMES, <<one|||other>>, <g> (replace all), λx: (a lambda), BARE(x) (lower case without marks), TOKENS(x) (runs of four letters or more) and JSON_K(x)."""
    text = re.sub(r"<<(.*?)\|\|\|(.*?)>>", lambda m: m[1 if spark else 2], text, flags=re.S)
    for name, both in NAMES.items():
        text = re.sub(rf"\b{name}\(", both[not spark] + "(", text)
    text = text.replace("<g>", "" if spark else ", 'g'")
    text = re.sub(r"λ(\w+):", r"\1 ->" if spark else r"lambda \1:", text)
    text = re.sub(r"TOKENS\((\w+)\)", rf"regexp_extract_all(lower(\1), '({LETTERS}{LETTERS}{LETTERS}{LETTERS}+)', 1)", text)
    text = re.sub(r"BARE\((\w+)\)", rf"translate(lower(\1), '{MARKED}', '{PLAIN}')" if spark else r"lower(strip_accents(\1))", text)
    return re.sub(r"JSON_K\((\w+)\)", r"get_json_object(\1, '$.k')" if spark else r"json_extract_string(\1, '$.k')", text)


def needed(text: str, names: dict | list) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", text)]


def load(spark: SparkSession, sf_dir: str, text: str) -> dict[str, DataFrame]:
    """The tables and views that a query's text names."""
    found: dict[str, DataFrame] = {}
    for v in needed(text, VIEWS):
        found[v] = run(spark, sf_dir, VIEWS[v])
    for t in needed(text, TABLES):
        found[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return found


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    body = dialect(text, spark=True)
    frames = load(spark, sf_dir, body)
    body = re.sub(rf"\b(from|join)(\s+)({'|'.join(frames)})\b", r"\1\2{\3}", body) if frames else body
    return spark.sql(body, **{n: frames[n] for n in frames if "{" + n + "}" in body})


def all_needed(text: str) -> list[str]:
    """The views that a query's text names and those that these name, each after those it needs."""
    found: list[str] = []
    for v in needed(text, VIEWS):
        found += [x for x in [*all_needed(VIEWS[v]), v] if x not in found]
    return found


def oracle(text: str) -> str:
    """The query with its views as common table expressions."""
    ctes = [f"{v} as ({VIEWS[v]})" for v in all_needed(text)]
    body = text if not ctes else (f"with {', '.join(ctes)}, {text.strip()[5:]}" if text.strip().startswith("with ") else f"with {', '.join(ctes)} {text}")
    return dialect(body, spark=False)
