"""Maintenance of the corpus and of its tables: changes between two states, merges, publishing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import views
from ..streaming.streams import shared_folder
from . import versioned


def incremental_diff(old: DataFrame, new: DataFrame, indexed: DataFrame) -> DataFrame:
    """path, change: added, removed, updated or unchanged by hash. A source whose hash is the same but that has no chunks in the index (indexed: path) is updated."""
    o, n = old.select("path", F.col("hash").alias("before")), new.select("path", F.col("hash").alias("after"))
    both = o.join(n, "path", "full_outer").join(indexed.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when((F.col("before") != F.col("after")) | F.col("there").isNull(), "updated").otherwise("unchanged")
    return both.select("path", change.alias("change"))


def replace_source_chunks(index: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """chunk_id, action, text: the index with the chunks of touched sources (source_id) replaced by fresh ones. New ids are inserted, known ones updated, and obsolete ones of the same sources deleted (text null)."""
    rest = index.join(touched, "source_id", "left_anti").select("chunk_id", F.lit("kept").alias("action"), "text")
    old = index.join(touched, "source_id", "left_semi").select("chunk_id", F.lit(1).alias("had"))
    new = fresh.join(touched, "source_id", "left_semi").select("chunk_id", "text", F.lit(1).alias("has"))
    action = F.when(F.col("has").isNull(), "deleted").when(F.col("had").isNull(), "inserted").otherwise("updated")
    return rest.unionByName(old.join(new, "chunk_id", "full_outer").select("chunk_id", action.alias("action"), "text"))


def apply_log(log: DataFrame) -> DataFrame:
    """id, route, total_ms, llm_ms, n_updates of each interaction: rows of the log insert it or patch some columns later; of each column the last value that is not null wins."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", "step"))).alias(c)
    return log.groupBy("id").agg(last("route"), last("total_ms"), last("llm_ms"), (F.count("*") - 1).alias("n_updates"))


def coalescing_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """run_id, conclusion, started_at, completed_at, seconds: new values where they are not null, else the older ones; a run never lasts less than nothing."""
    names = ["conclusion", "started_at", "completed_at"]
    rename = lambda df, p: df.select("run_id", *(F.col(c).alias(p + c) for c in names))
    both = rename(old, "o_").join(rename(new, "n_"), "run_id", "full_outer")
    out = both.select("run_id", F.coalesce("n_conclusion", "o_conclusion", F.lit("unknown")).alias("conclusion"), *(F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in names[1:]))
    seconds = F.unix_timestamp(F.col("completed_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    return out.withColumn("seconds", F.greatest(seconds, F.lit(0)))


def review_transition(memory: DataFrame, reviews: DataFrame, excluded: str = "signup") -> DataFrame:
    """id, action: the memory (id) after the latest review of each interaction (id, decision, route, decided_at). Validated ones are stored, but for an excluded route; rejected ones are removed; those there already stay."""
    latest = reviews.groupBy("id").agg(F.max_by(F.struct("decision", "route"), F.struct("decided_at", "decision")).alias("r")).select("id", "r.*")
    stored = latest.where((F.col("decision") == "validated") & ~F.col("route").eqNullSafe(excluded)).select("id", F.lit(True).alias("stored"))
    removed = latest.where("decision = 'rejected'").select("id")
    both = memory.select("id", F.lit(True).alias("had")).join(removed, "id", "left_anti").join(stored, "id", "full_outer")
    return both.select("id", F.when(F.col("had").isNull(), "stored").otherwise("kept").alias("action"))


def purge_contaminated(memory: DataFrame, interactions: DataFrame, routes: list[str]) -> DataFrame:
    """id, action: the memory with what was validated under one of these routes marked as purged; the dry run counts the marks."""
    bad = interactions.where((F.col("state") == "validated") & F.col("route").isin(routes)).select("id", F.lit(True).alias("bad"))
    return memory.join(bad, "id", "left").select("id", F.when(F.col("bad"), "purged").otherwise("kept").alias("action"))


def publish(df: DataFrame, root: str) -> bool:
    """Writes df as a new version under root and makes it the current one, but only if it has rows; says whether it did.

    The pointer is an empty file whose name ends with the version's folder, made after the version is whole, so that
    readers see the old version or the new one. Versions are numbered by what is there.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    version = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    if spark.read.schema(df.schema).parquet(f"{root}/{version}").isEmpty():
        return False
    pointer = jvm.org.apache.hadoop.fs.Path(f"{root}/pointers/{len(pointers(spark, root)):012d}-{version}")
    pointer.getFileSystem(conf).create(pointer, False).close()
    return True


def pointers(spark: SparkSession, root: str) -> list[str]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []


def current(spark: SparkSession, root: str, schema) -> DataFrame:
    """The version that was published last; without one an empty table."""
    names = pointers(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/{names[-1].split('-', 1)[1]}") if names else spark.createDataFrame([], schema)


def sync_index(stream: DataFrame, root: str, key: str = "path", fan: int = versioned.FAN) -> versioned.VersionedTable:
    """A stream of changes (key, other columns, version, deleted) into an index under root.

    A batch writes its changes alone, whatever the size of the index: of two versions of a source the higher counts, also
    if it came in an earlier batch, and a deleted source leaves. Batches that are run again change nothing.
    """
    schema = StructType([f for f in stream.schema.fields if f.name not in ("version", "deleted")])
    table = versioned.VersionedTable(stream.sparkSession, f"{root}/runs", schema, key, fan)
    stream.writeStream.foreachBatch(table.apply).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table


# -- queries ------------------------------------------------------------------------------------------------------------

INDEXED = "select path from v_sources where doc_id % 13 <> 4"
OLD_CHUNKS = "select chunk_id, concat(source, '-', cast(doc_id as string)) as source_id, text from v_chunks where doc_id % 10 <> 2"
NEW_CHUNKS = "select case when chunk % 4 = 1 then concat(chunk_id, 'b') else chunk_id end as chunk_id, concat(source, '-', cast(doc_id as string)) as source_id, concat(text, ' edited') as text from v_chunks where doc_id % 10 in (1, 2)"
TOUCHED = "select distinct concat(source, '-', cast(doc_id as string)) as source_id from documents where doc_id % 10 in (1, 2)"
LOG = """
select event_id as id, ts as at, 0 as step, event_type as route, cast(null as double) as total_ms, value as llm_ms from events
union all select event_id, ts, 1, cast(null as string), value * 10, cast(null as double) from events where event_id % 2 = 0
union all select event_id, ts, 2, cast(null as string), cast(null as double), value * 2 from events where event_id % 3 = 0"""
NEW_RUNS = "select run_id + 3 as run_id, case when run_id % 2 = 0 then null else 'failure' end as conclusion, cast(null as timestamp) as started_at, case when run_id % 4 = 0 then null else completed_at end as completed_at from v_runs"
MEMORY = "select id from v_interactions where id % 6 = 0"
REVIEWS = """
select id, case when id % 5 = 0 then 'rejected' else 'validated' end as decision, route, created_at as decided_at from v_interactions where id % 4 <> 0
union all select id, 'rejected', route, created_at + interval '1' hour from v_interactions where id % 7 = 0"""
ROUTES = ["signup", "error"]


def run(text: str):
    return lambda s, d: views.run(s, d, text)


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks as published; an empty build that comes after them changes nothing."""
    chunks, root = views.run(spark, sf_dir, "select chunk_id, page, text from v_chunks"), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    publish(chunks, root)
    publish(chunks.where("false"), root)
    return current(spark, root, chunks.schema)


def synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/document[s].parquet")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    changes = docs.select(path.alias("path"), F.md5("text").alias("hash"), "text", F.col("doc_id").alias("version"), F.lit(False).alias("deleted"))
    return sync_index(changes, f"{shared_folder(spark)}/sync-{uuid.uuid4().hex}").read()


QUERIES = {
    "incremental_diff": lambda s, d: incremental_diff(run("select * from v_sources")(s, d), run("select * from v_sources_new")(s, d), run(INDEXED)(s, d)),
    "replace_source_chunks": lambda s, d: replace_source_chunks(run(OLD_CHUNKS)(s, d), run(NEW_CHUNKS)(s, d), run(TOUCHED)(s, d)),
    "append_interaction": lambda s, d: apply_log(run(LOG)(s, d)),
    "coalescing_upsert": lambda s, d: coalescing_upsert(run("select * from v_runs")(s, d), run(NEW_RUNS)(s, d)),
    "review_transition": lambda s, d: review_transition(run(MEMORY)(s, d), run(REVIEWS)(s, d)),
    "purge_contaminated": lambda s, d: purge_contaminated(run(MEMORY)(s, d), run("select id, state, route from v_interactions")(s, d), ROUTES),
    "validated_publish": published,
    "stream_index_sync": synced,
}

SQL = {
    "incremental_diff": views.oracle(f"""
with i as ({INDEXED}) select coalesce(n.path, o.path) as path, case when o.path is null then 'added' when n.path is null then 'removed' when n.hash <> o.hash or n.path not in (select path from i) then 'updated' else 'unchanged' end as change
from v_sources o full outer join v_sources_new n on o.path = n.path"""),
    "replace_source_chunks": views.oracle("""
select chunk_id, 'kept' as action, text from v_chunks where doc_id % 10 not in (1, 2)
union all select chunk_id, case when chunk % 4 = 1 then 'deleted' else 'updated' end, case when chunk % 4 <> 1 then text || ' edited' end from v_chunks where doc_id % 10 = 1
union all select chunk_id || 'b', 'inserted', text || ' edited' from v_chunks where doc_id % 10 = 1 and chunk % 4 = 1
union all select case when chunk % 4 = 1 then chunk_id || 'b' else chunk_id end, 'inserted', text || ' edited' from v_chunks where doc_id % 10 = 2"""),
    "append_interaction": "select event_id as id, event_type as route, case when event_id % 2 = 0 then value * 10 end as total_ms, case when event_id % 3 = 0 then value * 2 else value end as llm_ms, case when event_id % 2 = 0 then 1 else 0 end + case when event_id % 3 = 0 then 1 else 0 end as n_updates from events",
    "coalescing_upsert": views.oracle(f"""
with n as ({NEW_RUNS}), b as (select coalesce(n.run_id, o.run_id) as run_id, coalesce(n.conclusion, o.conclusion, 'unknown') as conclusion, coalesce(n.started_at, o.started_at) as started_at, coalesce(n.completed_at, o.completed_at) as completed_at from v_runs o full outer join n on n.run_id = o.run_id)
select *, case when completed_at is null or started_at is null then 0 else greatest(floor(epoch(completed_at))::bigint - floor(epoch(started_at))::bigint, 0) end as seconds from b"""),
    "review_transition": views.oracle(f"""
with r as ({REVIEWS}), l as (select * from r qualify row_number() over (partition by id order by decided_at desc, decision desc) = 1),
a as (select id from ({MEMORY}) m where id not in (select id from l where decision = 'rejected')), s as (select id from l where decision = 'validated' and coalesce(route, '') <> 'signup')
select coalesce(a.id, s.id) as id, case when a.id is null then 'stored' else 'kept' end as action from a full outer join s on a.id = s.id"""),
    "purge_contaminated": views.oracle(f"with m as ({MEMORY}) select id, case when state = 'validated' and coalesce(route in ('signup', 'error'), false) then 'purged' else 'kept' end as action from m join v_interactions using (id)"),
    "validated_publish": views.oracle("select chunk_id, page, text from v_chunks"),
    "stream_index_sync": "select concat_ws('/', source, lang, doc_id) as path, md5(text) as hash, text from documents",
}
