"""A corpus pipeline: every stage reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardlake.llm import language, minhash, mixing, plans, postings
from hazardlake.session import cut_lineage, drop_work, recording


def _stage(function: Callable) -> Callable:
    """A stage that leaves no work table but those its result reads: decisions, a few bytes a
    document. Nothing that another call made is touched."""

    @wraps(function)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with recording() as made:
            out = function(spark, docs, sf_dir)
        drop_work(spark, made, but_of=out)
        return out

    return call


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, also where no language could be learned or one is named 'und'."""
    model = language.learn(docs)
    names = ("__lang", "__score", "__languages")
    return language.predict(docs, model, names=names, letters="__letters").filter("__letters").select(*docs.columns)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group; of equal rows one. Rows without id stay,
    texts without words are no copies of each other. An empty table stays empty. Links are of
    five-word shingles, unlike those of op6."""
    found = cut_lineage(minhash.near_duplicates(docs, k=5), "found")
    marks = (found.filter("id is not null").groupBy(F.col("id").alias("__id"))
             .agg(F.max(~F.col("kept")).alias("__gone"), F.count(F.lit(1)).alias("__n"))
             .filter("__gone or __n > 1").select("__id", "__gone"))
    # Texts move once: ids that come once have no mark, so only the texts of others are compared.
    named = docs.filter("doc_id is not null")
    left = named.join(marks, named["doc_id"] == marks["__id"], "left").filter("__gone is null or not __gone")
    equal = Window.partitionBy("doc_id", F.when(F.col("__gone").isNotNull(), F.col("text"))).orderBy("doc_id")
    once = left.withColumn("__nth", F.row_number().over(equal)).filter("__gone is null or __nth = 1")
    return once.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without enough words of benchmark passages. Null and empty texts, repeated rows
    and rows without id have no verdict or an ordinary one and stay unless contaminated; a row
    whose id is that of a contaminated one goes with it. Without benchmark items all stay."""
    found = postings.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = cut_lineage(found.filter("contaminated").select(F.col("doc_id").alias("__id")).distinct(), "contaminated")
    return docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Texts without words are taken nowhere and go; a
    null source is one of its own, rows that share an id are repeated alike; an empty table
    stays empty. The slots are in ``mixing.taken``; the columns of documents have no room for
    them, and the token files are in order of the id."""
    return mixing.mixed(docs)


@_stage
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place and digest of every document in the token files, in order of the id (null first, then
    the text). A null or empty text is the end id alone; an empty table has an empty file set."""
    return plans.token_digest(docs)


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
    ("tokens", token_files),
]
#: Learned models, hashing and a tokenizer: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written and read again. The run deletes
    the tables that it made itself, as soon as the next result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with recording() as made:
            docs = cut_lineage(stage(spark, docs, sf_dir), name)
        drop_work(spark, [*made[:-1], *before])
        before = made[-1:]
    return docs
