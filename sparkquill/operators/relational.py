"""Interaction analytics, business aggregates and corpus maintenance: operators that are one query each."""

from __future__ import annotations

RATE = "round(cast(count_if(state = 'validated') as double) / nullif(count_if(state in ('validated', 'rejected')), 0), 4)"

QUERIES = {
    # corpus maintenance
    "table_scan": "select l_orderkey, l_linenumber, cast(l_extendedprice as double) as price from lineitem where l_quantity > 45",
    "content_hash": "select doc_id, concat(md5(text), ':v1') as stored_hash from documents",
    "corpus_scan_prefer": """
with files as (select path, regexp_replace(path, '[.](md|pdf)$', '') as stem, path like '%.md' as is_md from v_sources_all)
select f.path from files f left join files m on f.stem = m.stem and m.is_md and not f.is_md where m.stem is null""",
    "registry_upsert": """
with registry as (select path, hash, source, case doc_id % 4 when 0 then 'vigente' when 1 then 'caducado' else 'pendiente_revision' end as validity, case when doc_id % 3 = 0 then concat('team-', lang) end as owner from v_sources)
select coalesce(n.path, o.path) as path, coalesce(n.hash, o.hash) as hash, coalesce(n.source, o.source) as domain, case when n.path is null then 'retirado' else 'indexado' end as index_state, case when o.path is null then 'pendiente_revision' else o.validity end as validity, o.owner as owner
from registry o full outer join v_sources_new n on o.path = n.path""",
    "indexed_sources": "select source, min_by(hash, path) as file_hash, count(*) as n_files from v_sources_all group by source",
    "active_sources": "select path, source from v_sources_all where lang = 'en' and source <> 'src0'",
    "embedding_cache_reuse": """
with keyed as (select doc_id, sha256_text as cache_key from (select doc_id, sha256(concat('v1|', text)) as sha256_text from documents) x)
select doc_id, cache_key, doc_id <> min(doc_id) over (partition by cache_key) as is_hit from keyed""",
    "cascade_delete": "select c.conv_id, c.turn, c.role from conversations c left join (select distinct conv_id as gone from conversations where conv_id % 7 = 0) d on c.conv_id = d.gone where d.gone is null",
    "archive_split": "select id, case when created_at < timestamp '2024-01-16 00:00:00' then 'cold' else 'hot' end as tier from v_interactions",
    "index_health": "select count(*) as n_chunks, count_if(cardinality_of(embedding) = 64) as n_valid, case when count(*) = 0 then 'empty' when count_if(cardinality_of(embedding) <> 64) > 0 then 'schema_mismatch' else 'ready' end as status from embeddings",
    # interactions
    "global_metrics": f"select count(*) as total, count_if(state = 'validated') as validated, count_if(state = 'rejected') as rejected, count_if(state = 'pending') as pending, cast(coalesce(sum(prompt_tokens), 0) as bigint) as prompt_tokens, cast(coalesce(sum(completion_tokens), 0) as bigint) as completion_tokens, round(avg(total_ms), 2) as avg_ms, {RATE} as validation_rate from v_interactions where created_at >= timestamp '2024-01-08 00:00:00'",
    "model_metrics": f"""
select i.model, count(*) as total, cast(sum(prompt_tokens + completion_tokens) as bigint) as tokens, round(cast(sum(prompt_tokens) as double) / 1000000 * cast(max(coalesce(price_in, 0)) as double) + cast(sum(completion_tokens) as double) / 1000000 * cast(max(coalesce(price_out, 0)) as double), 6) as cost, round(avg(total_ms), 2) as avg_ms, {RATE} as validation_rate
from v_interactions i left join v_prices p on i.model = p.model where i.model is not null group by i.model""",
    "availability_errors": "select model, count(*) as n_errors from v_interactions where route = 'error' and model is not null and created_at >= timestamp '2024-01-20 00:00:00' group by model",
    "retrieval_summary": f"select count(*) as total, count_if(state = 'rejected') as rejected, {RATE} as validation_rate, round(avg(cast(confidence as double)), 4) as avg_confidence, count_if(confidence < 0.65) as low_confidence from v_interactions",
    "route_summary": f"select coalesce(route, 'unknown') as route, count(*) as total, count_if(state = 'rejected') as rejected, round(avg(cast(confidence as double)), 4) as avg_confidence, {RATE} as validation_rate from v_interactions group by coalesce(route, 'unknown')",
    "weekly_timeline": f"select cast(date_trunc('week', created_at + interval '1' day) as date) as week, count(*) as total, count_if(state = 'rejected') as rejected, round(avg(cast(confidence as double)), 4) as avg_confidence, {RATE} as validation_rate from v_interactions group by cast(date_trunc('week', created_at + interval '1' day) as date)",
    "user_workload": "select user_id, count_if(state = 'pending') as pending, count_if(state = 'validated') as validated, count_if(state = 'rejected') as rejected, max(created_at) as last_activity from v_interactions group by user_id",
    "review_queue": "select id, user_id, created_at from v_interactions where state = 'pending' order by created_at desc, id desc limit 50",
    "last_n_turns": "select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) x where rn <= 6",
    "paged_listing": "select run_id, started_at from v_runs order by coalesce(completed_at, started_at) desc, run_id desc limit 11 offset 10",
    "slow_request_alerts": "select id, total_ms, rag_ms, llm_ms from v_interactions where total_ms > 500",
    # business
    "recent_listing": "select id, offer_no, coalesce(award_date, created_at) as listed_at from v_tenders order by listed_at desc, id desc limit 20",
    "tender_aggregate": "select state, count(*) as n, round(sum(amount), 2) as total, round(avg(amount), 2) as mean, max(amount) as largest from v_tenders group by state",
    "avg_of_top_n": "select round(avg(amount), 2) as mean from (select amount from v_tenders where amount <> 0 order by amount desc, id limit 10) x",
    "top_n": "select id, client, amount from v_tenders order by amount desc, id limit 10",
    "latest_row_per_key": "select id, area, period, line, value_text from (select *, row_number() over (partition by id, coalesce(area, '') order by period desc, updated_at desc, line desc, value_text desc) as rn from v_closings) x where rn = 1",
    "parse_decimal_locale": "select id, line, try_cast(case when value_text like '%,%' then replace(replace(value_text, '.', ''), ',', '.') else value_text end as decimal(18,2)) as parsed from v_closings",
}
