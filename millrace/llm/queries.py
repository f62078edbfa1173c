"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bayes, bitpack, crf, licenses, minhash, mixing, neighbours, packing, suffixes, warc
from millrace.llm.common import table


def op1_crf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf.line_labels(docs, crf.fit_on_labels(docs, table(spark, sf_dir, "labels")))


def op2_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.packed_digest(spark, table(spark, sf_dir, "documents"))


def op3_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark, table(spark, sf_dir, "pages"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op8_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold=0.85)


def op10_empirical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_crf_lines, op2_bit_packed_ids, op3_sparse_suffixes, op4_source_mix, op5_warc_revisits, op6_nn_descent, op7_best_fit_packing, op8_license_index, op9_circulant_minhash, op10_empirical_bayes)
}
SQL: dict[str, str] = {"op4_source_mix": mixing.SQL, "op5_warc_revisits": warc.SQL}
