"""Context assembly from ranked chunks: near-duplicate removal, selection within a token budget, formatting, figures.

Chunks are (query_id, id, score, tokens, content, and for some doc_id, ts). A query has few ranked chunks (at most the k of
its search), so its selection is a fold over a sorted array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.functions import text as X


def _ranked(chunks: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """query_id and its chunks as an array in order."""
    w = Window.partitionBy("query_id").orderBy(*order, "id")
    numbered = chunks.withColumn("__r", F.row_number().over(w))
    return numbered.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("__r", *columns))).alias("items"))


def _fold(chunks: DataFrame, order: list[Column], budget: int, fits) -> DataFrame:
    """Takes items in order while fits(state, item) and they stay within the budget; query_id, position, id, tokens."""
    columns = ["id", "tokens", "doc_id"]
    arrays = _ranked(chunks, order, columns)
    item = arrays.schema["items"].dataType.elementType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{item}>").alias("taken"))

    def take(s: Column, x: Column) -> Column:
        ok = (s["used"] + x["tokens"] <= budget) & fits(s, x)
        return F.when(ok, F.struct((s["used"] + x["tokens"]).cast("long").alias("used"), F.concat(s["taken"], F.array(x)).alias("taken"))).otherwise(s)

    done = arrays.select("query_id", F.aggregate("items", start, take)["taken"].alias("taken"))
    return done.select("query_id", F.posexplode("taken").alias("position", "x")).select("query_id", (F.col("position") + 1).alias("position"), F.col("x.id").alias("id"), F.col("x.tokens").alias("tokens"))


def select_top(chunks: DataFrame, budget: int) -> DataFrame:
    """Best score first; a chunk that doesn't fit is passed over, later ones may still fit."""
    return _fold(chunks, [F.desc("score")], budget, lambda s, x: F.lit(True))


def select_diverse(chunks: DataFrame, budget: int, free: int = 3) -> DataFrame:
    """As select_top, but once `free` are taken only from documents that have none yet."""
    return _fold(chunks, [F.desc("score")], budget, lambda s, x: (F.size(s["taken"]) < free) | ~F.exists(s["taken"], lambda t: t["doc_id"] == x["doc_id"]))


def select_recent(chunks: DataFrame, budget: int) -> DataFrame:
    """Newest first."""
    return _fold(chunks, [F.desc("ts")], budget, lambda s, x: F.lit(True))


def select_mixed(chunks: DataFrame, budget: int) -> DataFrame:
    """A third of the budget each by score, by diversity, and by recency of what is left: query_id, id, part."""
    third = budget // 3
    top = select_top(chunks, third).select("query_id", "id").withColumn("part", F.lit("top"))
    rest = chunks.join(top, ["query_id", "id"], "left_anti")
    diverse = select_diverse(rest, third).select("query_id", "id").withColumn("part", F.lit("diverse"))
    left = rest.join(diverse, ["query_id", "id"], "left_anti")
    recent = select_recent(left, third).select("query_id", "id").withColumn("part", F.lit("recent"))
    return top.unionByName(diverse).unionByName(recent)


def within_budget(rows: DataFrame, by: str, order: list[Column], tokens: str, budget: int) -> DataFrame:
    """The rows of each group, in order, up to the first that would exceed the budget; column used is the running sum."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def history(turns: DataFrame, budget: int, estimate: X.TokenEstimator = X.tokens_by_length) -> DataFrame:
    """The newest turns of each conversation whose tokens fit: conv_id, turn, tokens, used."""
    sized = turns.select("conv_id", "turn", estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    return within_budget(sized, "conv_id", [F.desc("turn")], "tokens", budget)


def fit_chunks(chunks: DataFrame, budget: int, least: int = 100) -> DataFrame:
    """Ranked chunks up to the budget; the first that exceeds it is cut to what is left if that is above `least` tokens."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    run = chunks.withColumn("upto", F.sum("tokens").over(w))
    left = budget - (F.col("upto") - F.col("tokens"))
    cut = (F.col("upto") > budget) & (left > least)
    return run.where((F.col("upto") <= budget) | cut).select("query_id", "id", F.when(cut, left).otherwise(F.col("tokens")).cast("long").alias("tokens"), F.when(cut, F.substring("content", F.lit(1), (left * 4).cast("int"))).otherwise(F.col("content")).alias("content"))


def drop_near_duplicates(chunks: DataFrame, most: float = 0.9) -> DataFrame:
    """Of each query, in order of score, chunks whose word similarity to every chunk kept before is at most `most`."""
    arrays = _ranked(chunks.withColumn("words", X.word_set("content")), [F.desc("score")], ["id", "words"])
    item = arrays.schema["items"].dataType.elementType.simpleString()

    def keep(kept: Column, x: Column) -> Column:
        near = F.exists(kept, lambda k: X.set_jaccard(k["words"], x["words"]) > most)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(x)))

    done = arrays.select("query_id", F.aggregate("items", F.array().cast(f"array<{item}>"), keep).alias("kept"))
    return done.select("query_id", F.explode("kept").alias("x")).select("query_id", F.col("x.id").alias("id"))


def context(chunks: DataFrame) -> DataFrame:
    """query_id, context: the chunks with source and relevance headings, in order of score."""
    one = F.concat(F.lit("[Source: "), F.col("doc_id").cast("string"), F.lit(" | Relevance: "), F.format_string("%.2f", F.col("score")), F.lit("]\n"), F.col("content"))
    arrays = _ranked(chunks.withColumn("block", one), [F.desc("score")], ["block"])
    return arrays.select("query_id", F.array_join(F.transform("items", lambda x: x["block"]), "\n---\n").alias("context"))


def prompts(queries: DataFrame, contexts: DataFrame, template: str = "{system}\n\nContext:\n{context}\n\nQuestion: {query}", system: str = "Answer from the context.") -> DataFrame:
    """query_id, prompt for every query, also those without context."""
    joined = queries.join(contexts, "query_id", "left")
    found = F.coalesce("context", F.lit("No relevant context found."))
    return joined.select("query_id", X.fill(template, system=F.lit(system), context=found, query=F.col("query")).alias("prompt"))


def figures(retrieved: DataFrame, included: DataFrame) -> DataFrame:
    """query_id, retrieved, included, relevance (mean score of those included), sources (distinct documents)."""
    inside = included.join(retrieved, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("included"), F.avg("score").alias("relevance"), F.count_distinct("doc_id").alias("sources"))
    return retrieved.groupBy("query_id").agg(F.count("*").alias("retrieved")).join(inside, "query_id", "left").fillna(0, ["included", "sources"])


def assemble(conversation: DataFrame, chunks: DataFrame, total: int, examples: DataFrame | None = None) -> DataFrame:
    """query_id, kind, id, tokens of a prompt's parts: history within a third of the tokens; examples (query_id, id, tokens), in
    order of id, within a quarter of what is left, and 500; chunks in the rest."""
    past = history(conversation, total // 3)
    parts = past.select(F.col("conv_id").alias("query_id"), F.lit("history").alias("kind"), F.col("turn").cast("string").alias("id"), "tokens")
    spent = past.groupBy(F.col("conv_id").alias("query_id")).agg(F.max("used").alias("spent"))
    if examples is not None:
        w = Window.partitionBy("query_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
        left = F.least(F.lit(500), F.floor((total - F.coalesce("spent", F.lit(0))) / 4))
        shown = examples.join(spent, "query_id", "left").withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= left)
        parts = parts.unionByName(shown.select("query_id", F.lit("example").alias("kind"), F.col("id").cast("string").alias("id"), "tokens"))
        spent = parts.groupBy("query_id").agg(F.sum("tokens").alias("spent"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    rest = chunks.withColumn("upto", F.sum("tokens").over(w)).join(spent, "query_id", "left").where(F.col("upto") <= total - F.coalesce("spent", F.lit(0)))
    return parts.unionByName(rest.select("query_id", F.lit("chunk").alias("kind"), F.col("id").cast("string").alias("id"), "tokens"))
