"""The registered query of each corpus operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyweave.llm import decontaminate as contamination
from plyweave.llm import ann, exact_dedup, html_text, language, line_dedup, periodic_runs, pii, suffix_dedup, toxicity, whitening
from plyweave.llm.packing import pack_documents
from plyweave.llm.simhash import near_duplicates

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digest(contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"), n_lines="n_lines", n_removed="n_removed")
    return line_dedup.digest(cleaned)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find_runs(periodic_runs.repeat_tails(table(spark, sf_dir, "documents"))))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_nearest_neighbours": op1_nearest_neighbours,
        "op2_decontamination": op2_decontamination,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_html_extraction": op4_html_extraction,
        "op5_language_id": op5_language_id,
        "op6_line_dedup": op6_line_dedup,
        "op7_pii": op7_pii,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_packing": op9_packing,
        "op10_toxicity": op10_toxicity,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": contamination.ORACLE_SQL,
        "op3_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op6_line_dedup": line_dedup.ORACLE_SQL,
        "op11_periodic_runs": periodic_runs.ORACLE_SQL,
        "op12_exact_dedup": exact_dedup.ORACLE_SQL,
    }
