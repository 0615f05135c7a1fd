"""Scoring, selection and repair of candidates (question, chunk): column expressions over one table of pairs.

Each query is a DataFrame job; its SQL is written apart from it, from the description of the operator.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import views
from . import shared
from .corpus import HITS
from .inverted import K1, B
from .retrieval import tokens
from .vectors import dot

#: Candidates of a question, the best by shared tokens; a setting of the search.
WINDOW = 60
#: Chunks that a question is answered with, of a source at most, of a page at most.
K, SOURCE_CAP, PAGE_CAP = 6, 2, 1
#: Weights of the cosine and of BM25 beside the base score; fixed values.
COSINE, BM25 = 9, 6
#: Words of file names that say nothing about the file.
NOISE = "pdf baja tension alta manual boe reglamento guia para los las del con por que de en la el un una e y o v2 v1 esp 1 2 3".split()
#: Tokens of more names than this are common; questions that are broadcast at once.
COMMON, QUESTIONS_AT_ONCE = 1000, 1_000_000
#: What candidates found by words only start from.
LEXICAL_BASE = 8

#: The same candidates as SQL, for the engine that checks.
CANDIDATES = f"""
with {HITS} select r.question_id, r.chunk_id, r.source, r.page, r.doc_id, r.hits, r.rank, c.text, b.text as question
from ranked r join (select chunk_id, text from v_chunks) c on c.chunk_id = r.chunk_id join benchmark b on b.item_id = r.question_id where r.rank <= {WINDOW}"""


def letters(text: Column) -> Column:
    """Runs of four letters of the corpus languages or more, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({views.LETTERS}{{4,}})"), 1)


def searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, DataFrame, Column]:
    """Questions and their words, chunks and theirs."""
    chunks = views.run(spark, sf_dir, "select chunk_id, source, page, doc_id, text from v_chunks")
    questions = views.run(spark, sf_dir, "select item_id as question_id, text as question from benchmark")
    return questions, letters(F.col("question")), chunks, letters(F.col("text"))


def best_chunks(spark: SparkSession, sf_dir: str, k: int = WINDOW) -> DataFrame:
    """question_id, chunk_id, source, page, doc_id, hits, rank: for each question the k chunks that share most words with it, from one pass over the chunks."""
    return shared.most_shared(*searched(spark, sf_dir), "chunk_id", ["source", "page", "doc_id"], k)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """best_chunks() with both texts, which are fetched for those only."""
    questions, _, chunks, _ = searched(spark, sf_dir)
    # few rows against all texts, so the few are what is sent
    return chunks.select("chunk_id", "text").join(F.broadcast(best_chunks(spark, sf_dir)), "chunk_id").join(F.broadcast(questions), "question_id")


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, chunk_id, list: the ten best chunks of each question (1), and all others that share two words with it (2)."""
    best = best_chunks(spark, sf_dir, 10).select("question_id", "chunk_id")
    others = shared.sharing(*searched(spark, sf_dir), "chunk_id", 2).join(F.broadcast(best), ["question_id", "chunk_id"], "left_anti")
    return best.withColumn("list", F.lit(1)).unionByName(others.withColumn("list", F.lit(2)))


def bare(text: Column) -> Column:
    return F.translate(F.lower(text), views.MARKED, views.PLAIN)


# -- parts of the score -------------------------------------------------------------------------------------------------


def longest(words: Column, n: int) -> Column:
    """The n longest of some words; of equal length the first by name."""
    ordered = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
    return F.transform(F.slice(ordered, 1, n), lambda x: x["w"])


def with_parts(pairs: DataFrame) -> DataFrame:
    """pairs with the counts that the order of multi_key_sort() asks for."""
    asked, have = F.array_distinct(tokens(F.col("question"))), F.array_distinct(tokens(F.col("text")))
    pairs = pairs.withColumns({"asked": asked, "have": have})
    words = F.split(F.trim(F.regexp_replace(F.col("question"), r"[ \t\n]+", " ")), " ")
    hits = lambda of: F.size(F.array_intersect(of, "have"))
    flag = lambda c: F.when(c, 1).otherwise(0)
    return pairs.withColumns(
        {
            "overlap": hits(F.col("asked")),
            "core": hits(longest(F.col("asked"), 4)),
            "phrase": flag((F.size(words) >= 3) & (F.instr(F.lower("text"), F.lower(F.array_join(F.slice(words, 1, 3), " "))) > 0)),
        }
    )


def multi_key_sort(pairs: DataFrame) -> DataFrame:
    """question_id, chunk_id, rank: by the opening phrase, the words that matter most, all words, then the page and the id."""
    order = [F.desc("phrase"), F.desc("core"), F.desc("overlap"), "page", "chunk_id"]
    return with_parts(pairs).select("question_id", "chunk_id", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)).alias("rank"))


def lexical_contains(questions: DataFrame, chunks: DataFrame, terms: int = 8, take: int = 12) -> DataFrame:
    """question_id, term, chunk_id, rank: for each of a question's longest words the first chunks that contain it, also inside a longer word.

    Words of chunks are a vocabulary; a term meets those of its words that share its first four letters somewhere, and
    those that contain it whole lead to their chunks. So no term is compared with every chunk.
    """
    asked = questions.select("question_id", F.explode(longest(F.array_distinct(tokens(F.col("text"))), terms)).alias("term"))
    index = chunks.select("chunk_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 3), lambda i: F.substring(F.col("word"), i, F.lit(4))))
    vocabulary = index.select("word").distinct().select("word", F.explode(grams).alias("gram"))
    found = asked.select("term", F.substring("term", 1, 4).alias("gram")).distinct().join(vocabulary, "gram").where(F.contains("word", F.col("term"))).select("term", "word").distinct()
    hits = asked.join(found, "term").join(index, "word").select("question_id", "term", "chunk_id").distinct()
    rank = F.row_number().over(Window.partitionBy("question_id", "term").orderBy("chunk_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= take)


# -- anchors and mentions -----------------------------------------------------------------------------------------------


def starts_with_ref(text: Column, ref: Column) -> Column:
    """Whether a normalised text starts with a reference, and not with one below it: 'articulo 5' is not 'articulo 5.1'."""
    rest = F.substring(text, F.length(ref) + 1, F.length(text))
    return F.startswith(text, ref) & ~rest.rlike(r"^(\.[0-9]|[a-z0-9])")


def structural_anchor(pairs: DataFrame) -> DataFrame:
    """pairs (ref, section, section_type, text) with anchor and clean.

    anchor: 24 if the section starts with the reference, else 16 if the first 240 characters of the text do. clean: of
    anchored pairs 8 more for a structural section, 24 less for dot leaders, 40 less for a table of contents.
    """
    section, opening, ref = F.trim(bare(F.col("section"))), F.trim(bare(F.substring("text", 1, 240))), bare(F.col("ref"))
    pairs = pairs.withColumn("anchor", F.when(starts_with_ref(section, ref), 24).when(starts_with_ref(opening, ref), 16).otherwise(0))
    kind = F.col("section_type").isin("article", "technical_instruction", "itc", "chapter", "disposition", "numbered_section")
    leaders = F.col("section").rlike(r"\.\s*\.\s*\.\s*\.")
    toc = (F.col("page") <= 4) & (F.regexp_count(bare(F.col("text")), F.lit("articulo")) >= 4)
    points = lambda c, n: F.when(c, n).otherwise(0)
    clean = F.when(F.col("anchor") > 0, F.col("anchor") + points(kind, 8) - points(leaders, 24) - points(toc, 40)).otherwise(0)
    return pairs.withColumn("clean", clean)


def name_tokens(path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(NOISE)))


def sorted_out(rows: DataFrame, key: str, common: DataFrame) -> DataFrame:
    """key, tokens, common and rare: a row's tokens (the array tokens), parted by whether they are in common (token), each in order."""
    marked = rows.select(key, F.explode("tokens").alias("token")).distinct().join(F.broadcast(common.withColumn("is_common", F.lit(True))), "token", "left")
    of = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("token"))))
    return marked.groupBy(key).agg(of(F.lit(True)).alias("tokens"), of(F.col("is_common")).alias("common"), of(F.col("is_common").isNull()).alias("rare"))


def is_mention(mine: str, others: str) -> Column:
    """Whether the tokens that two rows share make a mention: two, or one that is not short."""
    both = F.array_intersect(mine, others)
    return (F.size(both) > 1) | ((F.size(both) == 1) & (F.length(F.get(both, F.lit(0))) >= 5))


def source_mention(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """question_id, path, boost of 14 for the sources whose file name a question mentions; one short word is no mention.

    Rows with the same common tokens (of more than COMMON names) are a class. Classes are held against each other by an
    equi-join on tokens, and a pair of classes that mentions holds for all their rows: names meet the broadcast pairs and
    questions where they are, so that a result's rows are not shuffled. More shared tokens never undo a mention, so what
    is left are pairs that share a rare token too, which an equi-join finds. The result grows with questions times names.
    """
    named = sources.select("path").distinct().select("path", name_tokens(F.col("path")).alias("tokens"))
    asked = questions.select("question_id", F.split(F.lower("text"), "[^a-z0-9]+").alias("tokens"))
    # at most as many as the names have tokens, through COMMON
    common = named.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select("token")
    named = sorted_out(named, "path", common)
    asked = sorted_out(asked, "question_id", common).select("question_id", F.col("tokens").alias("asked"), F.col("common").alias("asked_common"), F.col("rare").alias("asked_rare"))
    a, b = asked.select("asked_common").distinct(), named.select("common").distinct()
    met = a.withColumn("token", F.explode("asked_common")).join(b.withColumn("token", F.explode("common")), "token").select("asked_common", "common").distinct()
    classes = met.where(is_mention("asked_common", "common"))
    boost = F.lit(14).alias("boost")
    rare = asked.withColumn("token", F.explode("asked_rare")).join(named.withColumn("token", F.explode("rare")), "token")
    out = rare.where(is_mention("asked", "tokens") & ~is_mention("asked_common", "common")).select("question_id", "path").distinct().select("question_id", "path", boost)
    n = -(-asked.count() // QUESTIONS_AT_ONCE)
    for i in range(n):
        some = asked.where(F.pmod(F.xxhash64("question_id"), F.lit(n)) == i).select("question_id", "asked_common")
        out = out.unionByName(named.join(F.broadcast(classes), "common").join(F.broadcast(some), "asked_common").select("question_id", "path", boost))
    return out


# -- fusion, selection, repair ------------------------------------------------------------------------------------------


def hybrid_rerank(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """question_id, chunk_id, cosine, bm25, score: base + 9 cosine + 6 BM25, the last without document frequency and with the mean length of a question's candidates. pairs: candidates with base, question_vec and chunk_vec, the ids of their vectors."""
    q = vectors.select(F.col("vec_id").alias("question_vec"), F.col("embedding").alias("q"))
    c = vectors.select(F.col("vec_id").alias("chunk_vec"), F.col("embedding").alias("c"))
    words = F.split(F.trim(F.regexp_replace(bare(F.col("text")), r"[ \t\n]+", " ")), " ")
    pairs = pairs.withColumns({"words": words, "asked": F.array_distinct(F.transform(tokens(F.col("question")), bare))})
    pairs = pairs.withColumn("mean", F.avg(F.size("words")).over(Window.partitionBy("question_id")))
    length = 1 - B + B * F.size("words") / F.col("mean")
    tf = lambda t: F.size(F.filter("words", lambda w: w == t)).cast("double")
    bm25 = F.aggregate(F.transform("asked", tf), F.lit(0.0), lambda s, n: s + n * (K1 + 1) / (n + K1 * length))
    both = pairs.withColumn("bm25", bm25).join(q, "question_vec").join(c, "chunk_vec")
    cosine = dot(F.col("q"), F.col("c")) / F.sqrt(dot(F.col("q"), F.col("q")) * dot(F.col("c"), F.col("c")))
    return both.select("question_id", "chunk_id", F.round(cosine, 5).alias("cosine"), F.round("bm25", 5).alias("bm25"), F.round(F.col("base") + COSINE * cosine + BM25 * F.col("bm25"), 4).alias("score"))


def greedy_select(pairs: DataFrame, k: int = K) -> DataFrame:
    """question_id, chunk_id, place: in the order of rank, at most SOURCE_CAP of a source and PAGE_CAP of a page of it, then filled up to k without caps. A question's candidates, WINDOW at most, are one array."""
    entry = F.struct("rank", "chunk_id", "source", "page", "doc_id")
    ranked = pairs.groupBy("question_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    same = lambda a, x, *names: F.size(F.filter(a, lambda y: reduce(Column.__and__, (y[n] == x[n] for n in names))))
    fits = lambda a, x: (F.size(a) < k) & (same(a, x, "source") < SOURCE_CAP) & (same(a, x, "doc_id", "page") < PAGE_CAP)
    chosen = F.aggregate("all", F.slice("all", 1, 0), lambda a, x: F.when(fits(a, x), F.concat(a, F.array(x))).otherwise(a))
    ranked = ranked.withColumn("chosen", chosen).withColumn("chosen", F.slice(F.concat("chosen", F.array_except("all", "chosen")), 1, k))
    return ranked.select("question_id", F.posexplode(F.transform("chosen", lambda x: x["chunk_id"])).alias("place", "chunk_id")).select("question_id", "chunk_id", (F.col("place") + 1).alias("place"))


def coverage_repair(pairs: DataFrame, classes: dict[str, str], k: int = K) -> DataFrame:
    """question_id, chunk_id, place: the k best, in which for each class (name: pattern of its texts), in turn, that none of them has, the last that has no class gives way to the best candidate of it."""
    kind = reduce(lambda c, x: c.when(F.col("text").rlike(x[1]), x[0]), classes.items(), F.when(F.lit(False), ""))
    chosen = pairs.withColumn("kind", kind).withColumn("place", F.when(F.col("rank") <= k, F.col("rank")))
    q = Window.partitionBy("question_id")
    for name in classes:
        has = F.max(F.col("place").isNotNull() & F.col("kind").eqNullSafe(name)).over(q)
        best = F.min(F.when(F.col("place").isNull() & F.col("kind").eqNullSafe(name), F.col("rank"))).over(q)
        filled = F.max("place").over(q)
        gives = F.coalesce(F.max(F.when(F.col("kind").isNull(), F.col("place"))).over(q), filled)
        chosen = chosen.withColumns({"has": has, "best": best, "gives": gives})
        repair = ~F.col("has") & F.col("best").isNotNull()
        place = F.when(repair & (F.col("rank") == F.col("best")), F.col("gives")).when(repair & (F.col("place") == F.col("gives")), None).otherwise(F.col("place"))
        chosen = chosen.withColumn("place", place).drop("has", "best", "gives")
    return chosen.where("place is not null").select("question_id", "chunk_id", "place")


#: Classes of the coverage query: texts with a number, texts that are capitals at the start and short.
CLASSES = {"number": "[0-9]", "heading": "^[A-Z][^ ]* [^ ]*$"}

#: Stands for structured chunks: a line as an article, and references to articles as questions.
ARTICLES = """
select chunk_id, page, chunk % 12 as article_no, concat('Artículo ', cast(chunk % 12 as string), case when chunk % 5 = 0 then '.1' else '' end, case when chunk % 7 = 0 then ' . . . . 3' else '. Objeto' end) as section,
 case when chunk % 3 = 0 then 'article' else 'section' end as section_type, case when chunk % 4 = 1 then concat('Artículo ', cast(chunk % 12 as string), ' ', text) when chunk % 11 = 2 then concat('artículo artículo artículo artículo ', text) else text end as text from v_chunks"""
SECTIONLESS = "select chunk_id, page, article_no, case when page % 2 = 0 then 'Anexo' else section end as section, section_type, text from a"
MENTIONS = "select doc_id as question_id, concat('resumen de ', source, ' en ', lang, ' del documento doc ', cast(doc_id as string)) as text from documents where doc_id % 100 = 0"
ALL_PATHS = "select path from v_sources_all"


def structural_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = views.run(spark, sf_dir, f"with a as ({ARTICLES}) {SECTIONLESS}")
    refs = views.run(spark, sf_dir, "select distinct p_size as article_no, concat('articulo ', cast(p_size as string)) as ref from part")
    return structural_anchor(chunks.join(refs, "article_no")).select("ref", "chunk_id", "anchor", "clean")


QUERIES = {
    "multi_key_sort": lambda spark, sf_dir: multi_key_sort(candidates(spark, sf_dir)),
    "lexical_contains": lambda spark, sf_dir: lexical_contains(views.run(spark, sf_dir, "select item_id as question_id, text from benchmark"), views.run(spark, sf_dir, "select chunk_id, text from v_chunks")),
    "structural_anchor": structural_query,
    "source_mention_boost": lambda spark, sf_dir: source_mention(views.run(spark, sf_dir, MENTIONS), views.run(spark, sf_dir, ALL_PATHS)),
    "candidate_union": candidate_union,
    "capped_diverse_topk": lambda spark, sf_dir: greedy_select(candidates(spark, sf_dir)),
    "coverage_repair": lambda spark, sf_dir: coverage_repair(candidates(spark, sf_dir), CLASSES),
}


def sql(body: str) -> str:
    """SQL over the candidates, as c."""
    return views.oracle(f"with c as ({CANDIDATES}) {body}")


_TOK = r"list_distinct(regexp_extract_all(lower({0}), '\p{{L}}{{4,}}'))"
_PARTS = f"""
, t as (select *, {_TOK.format("question")} as asked, {_TOK.format("text")} as have, regexp_split_to_array(trim(regexp_replace(question, '[ \t\n]+', ' ', 'g')), ' ') as qw from c),
p as (select question_id, chunk_id, len(list_intersect(asked, have)) as overlap,
 len(list_intersect(list_transform(list_sort(list_transform(asked, lambda w: {{'l': -length(w), 'w': w}}))[1:4], lambda x: x.w), have)) as core,
 case when len(qw) >= 3 and contains(lower(text), lower(qw[1] || ' ' || qw[2] || ' ' || qw[3])) then 1 else 0 end as phrase from t)
select question_id, chunk_id, """


SQL = {
    "multi_key_sort": sql(_PARTS.rsplit("select question_id, chunk_id, ", 1)[0] + " select question_id, chunk_id, row_number() over (partition by question_id order by phrase desc, core desc, overlap desc, page, chunk_id) as rank from p join c using (question_id, chunk_id)"),
    "lexical_contains": views.oracle(rf"""
with a as (select item_id as question_id, unnest(list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '\p{{L}}{{4,}}')), lambda w: {{'l': -length(w), 'w': w}}))[1:8], lambda x: x.w)) as term from benchmark)
select question_id, term, chunk_id, row_number() over (partition by question_id, term order by chunk_id) as rank from a join v_chunks on contains(lower(text), term) qualify rank <= 12"""),
    "structural_anchor": views.oracle(f"""
with a as ({ARTICLES}), s as ({SECTIONLESS}), r as (select distinct p_size as n, concat('articulo ', p_size) as ref from part),
b as (select ref, chunk_id, section_type, page, section, text, trim(lower(strip_accents(section))) as sec, trim(lower(strip_accents(text[1:240]))) as opening from s join r on r.n = s.article_no),
f as (select *, case when regexp_matches(sec, '^' || ref || '($|[^a-z0-9.]|[.]($|[^0-9]))') then 24 when regexp_matches(opening, '^' || ref || '($|[^a-z0-9.]|[.]($|[^0-9]))') then 16 else 0 end as anchor from b)
select ref, chunk_id, anchor, case when anchor = 0 then 0 else anchor + case when section_type in ('article', 'technical_instruction', 'itc', 'chapter', 'disposition', 'numbered_section') then 8 else 0 end
 - case when regexp_matches(section, '[.] *[.] *[.] *[.]') then 24 else 0 end - case when page <= 4 and len(regexp_extract_all(lower(strip_accents(text)), 'articulo')) >= 4 then 40 else 0 end end as clean from f"""),
    "source_mention_boost": views.oracle(f"""
with q as (select distinct question_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as token from ({MENTIONS}) m),
s as (select distinct path, unnest(regexp_split_to_array(lower(path), '[^a-z0-9]+')) as token from ({ALL_PATHS}) p)
select question_id, path, 14 as boost from q join s using (token) where token <> '' and token not in ({", ".join(f"'{w}'" for w in NOISE)}) group by question_id, path having count(*) > 1 or min(length(token)) >= 5"""),
    "capped_diverse_topk": sql("""
, g as (select question_id, list([{'rank': rank, 'id': chunk_id, 'source': source, 'page': page, 'doc': doc_id}] order by rank, chunk_id) as items from c group by question_id),
k as (select question_id, list_transform(items, lambda i: i[1].id) as ids, list_transform(list_reduce(items, lambda a, x: case when len(a) < 6 and len(list_filter(a, lambda y: y.source = x[1].source)) < 2 and len(list_filter(a, lambda y: y.doc = x[1].doc and y.page = x[1].page)) < 1 then list_concat(a, x) else a end), lambda i: i.id) as chosen from g),
f as (select question_id, list_concat(chosen, list_filter(ids, lambda i: not list_contains(chosen, i)))[1:6] as final from k)
select question_id, unnest(final) as chunk_id, generate_subscripts(final, 1) as place from f"""),
    "coverage_repair": sql("""
, k as (select question_id, chunk_id, rank, case when regexp_matches(text, '[0-9]') then 'number' when regexp_matches(text, '^[A-Z][^ ]* [^ ]*$') then 'heading' end as kind from c),
s1 as (select question_id, max(rank) as n, coalesce(max(rank) filter (kind is null), max(rank)) as gives, bool_or(coalesce(kind, '') = 'number') as has from k where rank <= 6 group by question_id),
b1 as (select question_id, min(rank) as best from k where rank > 6 and kind = 'number' group by question_id),
p1 as (select k.question_id, chunk_id, kind, rank, case when not has and best is not null and rank = best then gives when not has and best is not null and rank = gives then null when rank <= 6 then rank end as place from k join s1 using (question_id) left join b1 using (question_id)),
s2 as (select question_id, coalesce(max(place) filter (kind is null), max(place)) as gives, bool_or(coalesce(kind, '') = 'heading') as has from p1 where place is not null group by question_id),
b2 as (select question_id, min(rank) as best from p1 where place is null and kind = 'heading' group by question_id)
select question_id, chunk_id, case when not has and best is not null and rank = best then gives else place end as place from p1 join s2 using (question_id) left join b2 using (question_id)
where case when not has and best is not null and rank = best then true when not has and best is not null and place = gives then false else place is not null end"""),
}
