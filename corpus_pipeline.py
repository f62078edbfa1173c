"""From documents to packed training sequences: each stage works on what the one before has kept.

Stages that reject documents do so by doc_id: rows that share an id stay or go together, and rows
without an id, which no decision can name, stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bayes, common, minhash, mixing, packing, suffixes
from millrace.llm.common import hot_limit, join_hot, materialize, table


def _without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``docs`` without the doc_ids that have a row in ``judged`` (doc_id, kept) that isn't kept."""
    gone = judged.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier finds bad or toxic: all rows of a doc_id of which one is.
    Null and empty texts are judged like others; without labels, or with one kind only, all stay."""
    return _without(docs, bayes.classify(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, and, of rows that repeat a doc_id, the one
    with the smallest hash of its columns, whatever the order of rows.  Texts without a word have no duplicates;
    rows without doc_id stay."""
    judged = minhash.near_duplicates(docs)
    kept = _without(docs, judged)
    if judged.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    # columns may have any names, so they go in one
    rows = kept.select(F.struct(*kept.columns).alias("row"), F.col("doc_id").alias("id")).withColumn("hash", F.xxhash64(F.to_json("row")))
    repeated = rows.filter("id is not null").groupBy("id").agg(F.min("hash").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = join_hot(rows, repeated, ["id"], hot_limit(docs.count()), "left")
    same = rows.filter(F.col("hash") == F.col("least")).dropDuplicates(["id"])  # equal rows are left
    return rows.filter("least is null").unionByName(same).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages that a document of smaller doc_id also has.  Documents with no word left go; ones that
    had none to begin with, and rows without doc_id, stay as they are."""
    return suffixes.cut_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources come to their target weights.  Null sources are one source; texts
    without words come as often as their source's whole repetitions say."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences: a row a piece.  A null or empty text is one piece, its end id;
    rows that repeat are packed each."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("minhash_near_dedup", one_of_each),
    ("suffix_array_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]
#: SQL can't express the stages that use models and tokenizers; the tests follow each by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage has written on its way is removed when its result is there."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        mark = len(common.MADE)
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
            common.forget_since(spark, mark, docs)
    return docs
