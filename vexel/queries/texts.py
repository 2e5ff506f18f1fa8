"""Text and context operators L1 to L20, T6 to T10, over documents and conversations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.functions import text as X
from vexel.operators import knn, rag

QUERIES: dict = {}
ORACLES: dict = {}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _chunks(strategy: str):
    """Per document: chunks, and whether every chunk is the text between its ends and holds to the limit."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = docs(spark, sf_dir)
        c = X.chunk(d, strategy).join(d.select("doc_id", "text"), "doc_id")
        right = F.substring("text", F.col("start") + 1, F.length("content")) == F.col("content")
        return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min((right & (F.length("content") <= 1000)).cast("int")).alias("sound"), F.max("end").alias("reach"))

    return run


for _s in ("fixed", "paragraphs", "recursive"):
    QUERIES[f"l1_chunks_{_s}"] = _chunks(_s)


def l4_chunk_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.chunk_estimate("text").cast("long").alias("fixed"), X.chunk_estimate("text", "paragraphs").cast("long").alias("paragraphs"))


def l5_tokens_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.tokens_by_length("text").alias("tokens"))


def l6_tokens_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.tokens_by_words("text").alias("tokens"))


def l17_context_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = spark.createDataFrame([("gpt-4",), ("claude-2",), ("none",)], "model string")
    return models.select("model", X.context_size(F.col("model")).cast("long").alias("context"), X.response_size(F.col("model")).cast("long").alias("response"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made result of search: documents as chunks, ten to a query (id / 10), scored by id."""
    d = docs(spark, sf_dir)
    score = F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / 1000.0
    return d.select(F.floor(F.col("doc_id") / 10).cast("long").alias("query_id"), F.col("doc_id").alias("id"), score.alias("score"), X.tokens_by_length("text").alias("tokens"), F.floor(F.col("doc_id") / 2).cast("long").alias("doc_id"), F.pmod(F.col("doc_id") * 31, F.lit(97)).alias("ts"), F.col("text").alias("content"))


RANKED = "with c as (select cast(floor(doc_id / 10) as bigint) as query_id, doc_id as id, (doc_id * 7919 % 1000) / 1000.0 as score, cast(floor((length(text) + 3) / 4) as bigint) as tokens, cast(floor(doc_id / 2) as bigint) as doc_id, doc_id * 31 % 97 as ts, text as content from documents)"


def t6_greedy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.select_top(ranked(spark, sf_dir), 2000)


def t8_diverse_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.select_diverse(ranked(spark, sf_dir), 4000)


def t9_recent_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.select_recent(ranked(spark, sf_dir), 2000)


def t10_mixed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.select_mixed(ranked(spark, sf_dir), 3000)


def t7_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.history(spark.read.parquet(f"{sf_dir}/conversations.parquet"), 300)


def t7_fitted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.fit_chunks(ranked(spark, sf_dir), 2000).select("query_id", "id", "tokens")


def u3_word_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring documents of one query."""
    r = ranked(spark, sf_dir)
    other = r.select("query_id", (F.col("id") - 1).alias("id"), F.col("content").alias("next"))
    return r.join(other, ["query_id", "id"]).select("id", F.round(X.word_jaccard("content", "next"), 6).alias("similarity"))


def f21_relevance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).where(F.col("score") >= 0.7).select("query_id", "id")


def j9_hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ranked(spark, sf_dir).select("query_id", "id", "score").where("score >= 0.9")
    return hits.join(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", "n_chars"), "id")


def l13_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.drop_near_duplicates(ranked(spark, sf_dir), 0.9)


def l14_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rag.context(ranked(spark, sf_dir).where("score >= 0.8"))
    return c.select("query_id", F.length("context").alias("n"), F.md5("context").alias("digest"))


def l15_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = rag.context(ranked(spark, sf_dir).where("score >= 0.9").withColumn("content", F.lit("x")))
    queries = ranked(spark, sf_dir).select("query_id").distinct().withColumn("query", F.concat(F.lit("question "), F.col("query_id").cast("string")))
    return rag.prompts(queries, contexts).select("query_id", F.md5("prompt").alias("digest"))


def l16_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    few = ranked(spark, sf_dir).where("id % 10 < 4").select("query_id", "id", (F.col("tokens") % 200).alias("tokens"))
    return rag.assemble(turns, ranked(spark, sf_dir), 3000, few)


def l18_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranked(spark, sf_dir)
    f = rag.figures(r, rag.select_top(r, 2000))
    return f.select("query_id", "retrieved", "included", F.round("relevance", 6).alias("relevance"), "sources")


def l10_semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest documents of ten by hashed embeddings, with a score of at least 0.1."""
    e = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), X.hashed_embedding("text").alias("vector"))
    asked = e.where("id < 10").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    found = knn.search(e, asked, 5, "cosine").withColumn("score", 1.0 - F.col("distance"))
    return found.where("score >= 0.1").select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def l12_indexed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the documents with their embeddings' lengths."""
    c = X.chunk(docs(spark, sf_dir), "recursive")
    return c.select("doc_id", "chunk", "chunks", "tokens", F.size(X.hashed_embedding("content", 32)).alias("n"))


FUNCTIONS = (l4_chunk_estimates, l5_tokens_by_length, l6_tokens_by_words, l17_context_sizes, t6_greedy_selection, t8_diverse_selection, t9_recent_selection, t10_mixed_selection, t7_history, t7_fitted_chunks, u3_word_jaccard, f21_relevance_threshold, j9_hydrated, l13_near_duplicates, l14_context, l15_prompts, l16_assembly, l18_figures, l10_semantic_search, l12_indexed_chunks)
QUERIES |= {f.__name__: f for f in FUNCTIONS}

ORACLES["l4_chunk_estimates"] = "select doc_id, cast(case when length(text) <= 1000 then least(length(text), 1) else ceil((length(text) - 200) / 800.0) end as bigint) as fixed, cast(greatest(least(length(text), 1), ceil(length(text) / 1000.0)) as bigint) as paragraphs from documents"
ORACLES["l5_tokens_by_length"] = "select doc_id, cast(floor((length(text) + 3) / 4) as bigint) as tokens from documents"
ORACLES["l6_tokens_by_words"] = r"select doc_id, cast(floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 1.3) + len(regexp_extract_all(text, '[!-/:-@\[-`{-~]')) as bigint) as tokens from documents"
ORACLES["l17_context_sizes"] = "select * from (values ('gpt-4', 8192, 2048), ('claude-2', 100000, 25000), ('none', 4096, 1024)) as t(model, context, response)"
#: Greedy folds as a recursion over each query's ranked chunks.
GREEDY = """{ranked}, o as (select *, row_number() over (partition by query_id order by {order}, id) as k from c),
g as (with recursive s(query_id, k, used, docs, n, id, tokens, took) as (
  select query_id, cast(0 as bigint), cast(0 as bigint), cast([] as bigint[]), cast(0 as bigint), cast(null as bigint), cast(null as bigint), false from (select distinct query_id from o)
  union all select s.query_id, o.k, case when {ok} then s.used + o.tokens else s.used end, case when {ok} then list_append(s.docs, o.doc_id) else s.docs end, case when {ok} then s.n + 1 else s.n end, o.id, o.tokens, {ok} from s join o on o.query_id = s.query_id and o.k = s.k + 1) select * from s)
"""
FITS = "(s.used + o.tokens <= {budget})"
PICK = "select query_id, n as position, id, tokens from g where took"


def greedy(order: str, budget: int, extra: str = "true") -> str:
    return GREEDY.format(ranked=RANKED.replace("with c", "with c", 1), order=order, ok=f"({FITS.format(budget=budget)} and {extra})") + PICK


ORACLES["t6_greedy_selection"] = greedy("score desc", 2000)
ORACLES["t8_diverse_selection"] = greedy("score desc", 4000, "(s.n < 3 or not list_contains(s.docs, o.doc_id))")
ORACLES["t9_recent_selection"] = greedy("ts desc", 2000)
ORACLES["t7_history"] = "with t as (select conv_id, turn, cast(floor((length(coalesce(text, '')) + 3) / 4) as bigint) as tokens from conversations), u as (select *, sum(tokens) over (partition by conv_id order by turn desc) as used from t) select conv_id, turn, tokens, cast(used as bigint) as used from u where used <= 300"
ORACLES["t7_fitted_chunks"] = f"{RANKED}, u as (select *, sum(tokens) over (partition by query_id order by score desc, id) as upto from c) select query_id, id, cast(case when upto > 2000 then 2000 - (upto - tokens) else tokens end as bigint) as tokens from u where upto <= 2000 or 2000 - (upto - tokens) > 100"
ORACLES["u3_word_jaccard"] = RANKED + r", w as (select query_id, id, list_distinct(list_filter(regexp_split_to_array(lower(trim(content)), '\s+'), lambda x: x <> '')) as w from c) select a.id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) as similarity from w a join w b on a.query_id = b.query_id and b.id = a.id + 1"
ORACLES["f21_relevance_threshold"] = f"{RANKED} select query_id, id from c where score >= 0.7"
ORACLES["j9_hydrated"] = f"{RANKED} select c.query_id, c.id, c.score, d.source, d.n_chars from c join documents d on d.doc_id = c.id where score >= 0.9"
BLOCKS = "string_agg('[Source: ' || doc_id || ' | Relevance: ' || cast(cast(round(cast(score as decimal(10, 3)), 2) as decimal(10, 2)) as varchar) || ']' || chr(10) || %s, chr(10) || '---' || chr(10) order by score desc, id)"
ORACLES["l14_context"] = f"{RANKED}, k as (select query_id, {BLOCKS % 'content'} as context from c where score >= 0.8 group by 1) select query_id, length(context) as n, md5(context) as digest from k"
_HEAD, _MID = "'Answer from the context.' || chr(10) || chr(10) || 'Context:' || chr(10) || ", " || chr(10) || chr(10) || 'Question: question ' || q.query_id"
_BLOCK = BLOCKS % "'x'"
ORACLES["l15_prompts"] = f"{RANKED}, k as (select query_id, {_BLOCK} as context from c where score >= 0.9 group by 1) select q.query_id, md5({_HEAD}coalesce(context, 'No relevant context found.'){_MID}) as digest from (select distinct query_id from c) q left join k on k.query_id = q.query_id"
ORACLES["l10_semantic_search"] = r"""with w as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as word from documents),
b as (select doc_id, cast('0x' || substr(md5(word), 1, 8) as bigint) % 64 as bucket, count(*) as c from w group by 1, 2),
v as (select *, sum(c * c) over (partition by doc_id) as whole from b),
s as (select q.doc_id as query_id, d.doc_id as id, sum(q.c * d.c) / (sqrt(any_value(q.whole)) * sqrt(any_value(d.whole))) as score from v q join v d on q.bucket = d.bucket where q.doc_id < 10 group by 1, 2),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s) select query_id, rank, id, round(score, 6) as score from r where rank <= 5 and score >= 0.1"""
#: Each document's kept ones, in order of score: as many rounds as a query has documents.
ORACLES["l18_figures"] = GREEDY.format(ranked=RANKED, order="score desc", ok=f"({FITS.format(budget=2000)})") + """, i as (select g.query_id, count(*) as included, avg(score) as relevance, count(distinct c.doc_id) as sources from g join c on c.id = g.id where took group by 1)
select r.query_id, r.retrieved, coalesce(included, 0) as included, round(relevance, 6) as relevance, coalesce(sources, 0) as sources from (select query_id, count(*) as retrieved from c group by 1) r left join i on i.query_id = r.query_id"""
ORACLES["l16_assembly"] = f"""{RANKED}, t as (select conv_id, turn, cast(floor((length(coalesce(text, '')) + 3) / 4) as bigint) as tokens from conversations),
h as (select *, sum(tokens) over (partition by conv_id order by turn desc) as used from t), p as (select * from h where used <= 1000), spent as (select conv_id, max(used) as spent from p group by 1),
e as (select query_id, id, tokens % 200 as tokens, sum(tokens % 200) over (partition by query_id order by id) as used from c where id % 10 < 4), x as (select e.* from e left join spent s on s.conv_id = e.query_id where used <= least(500, floor((3000 - coalesce(spent, 0)) / 4))),
pair as (select conv_id as query_id, tokens from p union all select query_id, tokens from x), taken as (select query_id, sum(tokens) as spent from pair group by 1),
k as (select c.*, sum(tokens) over (partition by query_id order by score desc, id) as upto from c)
select conv_id as query_id, 'history' as kind, cast(turn as varchar) as id, tokens from p union all select query_id, 'example', cast(id as varchar), tokens from x
union all select k.query_id, 'chunk', cast(k.id as varchar), k.tokens from k left join taken s on s.query_id = k.query_id where upto <= 3000 - coalesce(spent, 0)"""
_STAGE = """o{n} as (select *, row_number() over (partition by query_id order by {order}, id) as k from {src}), g{n} as (with recursive s(query_id, k, used, docs, n, id, took) as (
  select query_id, cast(0 as bigint), cast(0 as bigint), cast([] as bigint[]), cast(0 as bigint), cast(null as bigint), false from (select distinct query_id from o{n})
  union all select s.query_id, o.k, case when {ok} then s.used + o.tokens else s.used end, case when {ok} then list_append(s.docs, o.doc_id) else s.docs end, case when {ok} then s.n + 1 else s.n end, o.id, {ok} from s join o{n} o on o.query_id = s.query_id and o.k = s.k + 1) select query_id, id from s where took),
left{n} as (select * from {src} anti join g{n} using (query_id, id))"""
_OK = FITS.format(budget=1000)
ORACLES["t10_mixed_selection"] = RANKED + ", " + ", ".join(_STAGE.format(n=n, order=order, src=src, ok=f"({_OK} and {extra})") for n, order, src, extra in ((1, "score desc", "c", "true"), (2, "score desc", "left1", "(s.n < 3 or not list_contains(s.docs, o.doc_id))"), (3, "ts desc", "left2", "true"))) + " select query_id, id, 'top' as part from g1 union all select query_id, id, 'diverse' from g2 union all select query_id, id, 'recent' from g3"
ORACLES["l13_near_duplicates"] = RANKED + r""", w as (select query_id, id, score, list_distinct(list_filter(regexp_split_to_array(lower(trim(content)), '\s+'), lambda x: x <> '')) as w from c), o as (select *, row_number() over (partition by query_id order by score desc, id) as k from w),
g as (with recursive s(query_id, k, kept, id, took) as (select query_id, cast(0 as bigint), cast([] as varchar[][]), cast(null as bigint), false from (select distinct query_id from o)
  union all select query_id, k, case when ok then list_append(kept, w) else kept end, id, ok from (select s.query_id, o.k, s.kept, o.w, o.id, len(list_filter(s.kept, lambda x: case when len(list_distinct(list_concat(x, o.w))) = 0 then 1 else len(list_intersect(x, o.w)) / len(list_distinct(list_concat(x, o.w))) end > 0.9)) = 0 as ok from s join o on o.query_id = s.query_id and o.k = s.k + 1)) select * from s)
select query_id, id from g where took"""


def l1_chunks_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By strategy: documents with chunks, whose chunks are all parts of the text at their places, none too long, numbered without gaps."""
    out = None
    for strategy in ("fixed", "paragraphs", "recursive"):
        d = docs(spark, sf_dir)
        c = X.chunk(d, strategy).join(d.select("doc_id", "text"), "doc_id")
        good = (F.substring("text", F.col("start") + 1, F.length("content")) == F.col("content")) & (F.length("content") <= 1000) & (F.col("end") == F.col("start") + F.length("content"))
        each = c.groupBy("doc_id").agg(F.min((good).cast("int")).alias("good"), (F.count_distinct("chunk") == F.max("chunks")).cast("int").alias("numbered"), F.min("start").alias("start"))
        row = each.agg(F.lit(strategy).alias("strategy"), F.count("*").alias("documents"), F.sum(F.col("good") * F.col("numbered")).alias("sound"))
        out = row if out is None else out.unionByName(row)
    return out


def l9_distinct_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's texts, embedded once each, with an embedder of our own: letters a to z counted."""
    d = docs(spark, sf_dir).select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    letters = lambda texts: np.array([[t.count(chr(97 + i)) for i in range(26)] for t in texts], float)
    return X.embed_distinct(d, "source", letters).select("doc_id", F.element_at("vector", 19).cast("long").alias("s"), F.element_at("vector", 3).cast("long").alias("c"))


def e4_own_chunker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 500 characters by a chunker of our own, and tokens by an estimator of our own."""
    pieces = lambda text, longest, overlap, shortest: [(i, text[i : i + longest]) for i in range(0, len(text), longest)]
    c = X.chunk(docs(spark, sf_dir), pieces, 500, tokens=lambda t: F.length(t).cast("long") * 2)
    return c.select("doc_id", "chunk", "chunks", "start", F.length("content").alias("n"), "tokens")


def l7_positional_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of the embeddings of all texts sum to one; with the places of words, order counts: texts whose reversal has another embedding."""
    d = docs(spark, sf_dir).where("text rlike '[a-zA-Z]'")
    turned = F.array_join(F.reverse(F.split("text", r"\s+")), " ")
    v = d.select(X.hashed_embedding("text", 64, 0.1).alias("v"), X.hashed_embedding("text").alias("plain"), X.hashed_embedding(turned).alias("turned"))
    one = lambda c: F.abs(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x) - 1) < 1e-9
    return v.agg(F.count("*").alias("documents"), F.count_if(one("v") & one("plain")).alias("unit"), F.count_if(F.aggregate(F.zip_with("plain", "turned", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) < 1e-9).alias("same"))


MORE = (l1_chunks_of_all, l9_distinct_embeddings, e4_own_chunker, l7_positional_embedding)
QUERIES |= {f.__name__: f for f in MORE}
ORACLES["l1_chunks_of_all"] = "select s as strategy, count(*) filter (s = 'fixed' or regexp_matches(text, '\\S') or s = 'recursive') as documents, count(*) filter (s = 'fixed' or regexp_matches(text, '\\S') or s = 'recursive') as sound from documents, (values ('fixed'), ('paragraphs'), ('recursive')) as t(s) where length(text) > 0 group by 1"
ORACLES["l9_distinct_embeddings"] = "select doc_id, length(coalesce(source, '')) - length(replace(coalesce(source, ''), 's', '')) as s, length(coalesce(source, '')) - length(replace(coalesce(source, ''), 'c', '')) as c from documents"
ORACLES["e4_own_chunker"] = "with d as (select doc_id, text, cast(ceil(length(text) / 500.0) as int) as chunks from documents where length(text) > 0), x as (select *, unnest(range(chunks)) as chunk from d) select doc_id, cast(chunk as int) as chunk, chunks, cast(chunk * 500 as int) as start, cast(least(500, length(text) - chunk * 500) as int) as n, 2 * least(500, length(text) - chunk * 500) as tokens from x"
ORACLES["l7_positional_embedding"] = "select count(*) as documents, count(*) as unit, count(*) as same from documents where regexp_matches(text, '[a-zA-Z]')"
