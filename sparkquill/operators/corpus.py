"""Text, chunk, question, retrieval and evaluation operators that are one query each.

Written once for Spark and for the SQL they are compared with; see dialect() in sources/views.py for the few marks.
"""

from __future__ import annotations

#: A line that opens a section: short, a few words, no stop at its end.
HEADING = "(length(trim(line)) between 1 and 80 and LEN(split(trim(line), ' ')) <= 10 and not trim(line) like '%.' and RX(trim(line), '^[A-ZÄÖÜÉÁÍÓÚÑ]'))"
MATCH = "trim(regexp_replace(regexp_replace(BARE(text), '[.,;:!?¿¡()]+', ' '<g>), '[ \t\n]+', ' '<g>))"
#: Question tokens against chunk tokens, distinct: containment of a term by an equi-join on tokens.
HITS = """asked as (select distinct question_id, token from (select item_id as question_id, EXPLODE(TOKENS(text)) as token from benchmark) a),
 words as (select distinct chunk_id, source, page, doc_id, token from (select chunk_id, source, page, doc_id, EXPLODE(TOKENS(text)) as token from v_chunks) b),
 scored as (select question_id, chunk_id, source, page, doc_id, count(*) as hits from asked join words using (token) group by question_id, chunk_id, source, page, doc_id),
 ranked as (select *, row_number() over (partition by question_id order by hits desc, chunk_id) as rank from scored)"""

QUERIES = {
    # text and chunks
    "normalize_text": "select doc_id, BARE(text) as normal from documents",
    "normalize_for_matching": f"select conv_id, turn, {MATCH} as normal from conversations",
    "section_blocks": f"""
with marked as (select doc_id, line_no, line, case when {HEADING} then trim(line) end as heading, case when {HEADING} or trim(line) = '' then 1 else 0 end as breaks from v_lines),
carried as (select doc_id, line_no, line, breaks, <<last_value(heading) ignore nulls|||last_value(heading ignore nulls)>> over (partition by doc_id order by line_no rows between unbounded preceding and current row) as section,
  cast(sum(breaks) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as bigint) as block from marked)
select doc_id, block, max(section) as section, count(*) as n_lines, cast(sum(length(line)) as bigint) as n_chars, <<listagg(line, ' ') within group (order by line_no)|||string_agg(line, ' ' order by line_no)>> as body from carried where trim(line) <> '' group by doc_id, block""",
    "contextualize_chunk": "select chunk_id, concat(concat_ws(' | ', concat('Documento: ', source), concat('Dominio: ', lang), nullif(concat('Pagina: ', cast(page as string)), 'Pagina: 1')), chr(10), text) as full_text from v_chunks",
    "stable_chunk_ids": "select chunk_id, md5(concat_ws(':', concat(source, '/', cast(doc_id as string)), cast(page as string), cast(chunk as string))) as stable_id from v_chunks",
    # questions
    "clean_question": "select question_id, coalesce(nullif(trim(regexp_replace(regexp_replace(text, '[A-Za-z0-9_]+[.]pdf( [(]pag[.] [0-9]+[)])?', ' '<g>), '[ \t\n]+', ' '<g>)), ''), text) as cleaned from v_questions",
    "fuzzy_token_match": """
with t as (select distinct token from (select EXPLODE(split(trim(regexp_replace(lower(text), '[^a-zà-ÿ]+', ' '<g>)), ' ')) as token from conversations) x where length(token) >= 5)
select token, term from t join v_terms on substr(token, 1, 4) = substr(term, 1, 4) and abs(length(token) - length(term)) <= 2 and token <> term""",
    # retrieval
    "candidate_union": f"""
with {HITS}, lists as (select question_id, chunk_id, 1 as list, rank from ranked where rank <= 10 union all select question_id, chunk_id, 2 as list, row_number() over (partition by question_id order by page, chunk_id) as rank from scored where hits >= 2)
select question_id, chunk_id, list from (select *, row_number() over (partition by question_id, chunk_id order by list, rank) as rn from lists) x where rn = 1""",
    # business
    "format_value_locale": "select id, coalesce(concat(<<replace(replace(replace(format_number(cast(amount as decimal(18,2)), 2), ',', '#'), '.', ','), '#', '.')|||replace(replace(replace(format('{:,.2f}', cast(cast(amount as decimal(18,2)) as double)), ',', '#'), '.', ','), '#', '.')>>, ' €'), 'sin dato') as amount_text, coalesce(<<date_format(award_date, 'dd/MM/yyyy')|||strftime(award_date, '%d/%m/%Y')>>, 'sin dato') as award_text from v_tenders",
    # evaluation
    "recall_precision_at_k": f"""
with {HITS}, exp as (select distinct question_id, source from scored where hits >= 4), got as (select distinct question_id, source from ranked where rank <= 3),
e as (select question_id, count(*) as n from exp group by question_id), r as (select question_id, count(*) as n from got group by question_id), h as (select question_id, count(*) as n from exp join got using (question_id, source) group by question_id)
select item_id as question_id, case when e.n is null then 1.0 else round(cast(coalesce(h.n, 0) as double) / e.n, 4) end as recall, case when e.n is null or r.n is null then 0.0 else round(cast(coalesce(h.n, 0) as double) / r.n, 4) end as precision_at_k
from benchmark left join e on e.question_id = item_id left join r on r.question_id = item_id left join h on h.question_id = item_id""",
    # batch twins of streams
    "stream_error_window_batch": "select date_trunc('hour', ts) as hour_start, count(*) as n_errors from events where event_type = 'error' group by date_trunc('hour', ts)",
    "stream_user_sessions_batch": """
with g as (select user_id, ts, case when ts > lag(ts) over (partition by user_id order by ts) + interval '30' minute then 1 else 0 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as no from g)
select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from s group by user_id, no""",
}
