"""A corpus pipeline of five stages: language, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of documents; the last one
returns packed pieces. run() writes each stage's rows to the shared folder and reads them for the next.

Empty tables give empty tables. Null texts go in the first stage. Of equal rows one stays, as of near duplicates; texts of any
length are read whole; columns beside those of documents stay, whatever their names. Ties go to the smaller doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm import decontam, jaccard_join, lang_gru, packing, substring_dedup
from vexel.llm.session import small, written

#: The languages to keep; None: all that column lang has.
LANGUAGES: tuple[str, ...] | None = None
#: From SURE_LETTERS letters on, a text's language must score above chance by this share of the way from chance to certainty.
LEAST_ABOVE_CHANCE, SURE_LETTERS = 0.2, 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = LANGUAGES) -> DataFrame:
    """Keeps the documents in one of the languages, by a net trained on these documents and their column lang.

    Rejected are texts without a letter, texts in a language that isn't to be kept, and longer texts in which the net sees none.
    """
    net = lang_gru.train(docs)
    found = lang_gru.identify(docs.select("text", F.struct(*docs.columns).alias("__row")), net, ("__row",))
    chance = 1 / len(net.languages) if net else 1.0
    short = F.length(F.regexp_replace("__row.text", r"[^\p{L}]+", "")) < SURE_LETTERS
    good = (F.col("lang_pred") != "und") & (short | (F.col("score") >= chance + LEAST_ABOVE_CHANCE * (1 - chance)))
    if languages is not None:
        good = good & F.col("lang_pred").isin(*languages)
    return found.where(good).select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that links join; of rows with equal id and text, one."""
    groups = written(jaccard_join.join(docs.select("doc_id", "text")), "groups")
    gone = groups.where("component_id != doc_id").select("doc_id").distinct()
    kept = docs.join(small(gone, 1_000_000), "doc_id", "left_anti")  # up to that many ids are broadcast; the texts then stay
    if groups.groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated sentence spans out of the texts; documents of which nothing is left go. n_chars follows the text."""
    cut = substring_dedup.dedup(docs).where("n_removed = 0 or trim(text) != ''")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents into which no item of table benchmark leaks."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences of 2048."""
    return packing.pack(packing.tokenize(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("packed", packed)]

#: No SQL can run the net, the edit distances or the packing; tests hold each stage to plain Python on small tables.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
