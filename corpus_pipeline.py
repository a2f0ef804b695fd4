"""The corpus pipeline: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of documents. What a stage writes for itself is removed after it.

Of all stages: other columns stay as they are, whatever their names; very long texts are read whole; an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plyweave.llm import decontaminate as contamination
from plyweave.llm import line_dedup, packing, simhash, toxicity
from plyweave.llm.common import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.5 or more go.

    Null and empty texts score as texts without known terms do. Rows that repeat, that share a doc_id or have none are
    judged each by its own text; they are learned from once for each labelled doc_id. Without labels nothing goes. A
    score of exactly 0.5 goes.
    """
    machine = toxicity.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, machine)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that eight sites or more have go, but for their first occurrence. All documents stay.

    Null texts stay null, empty ones empty; blank lines stay; a null source is no site. The first occurrence is that of
    the smallest doc_id (null ones last, by a hash of text and source); rows that repeat all three keep it each.
    """
    return line_dedup.remove_boilerplate(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id stays.

    Null, empty and blank texts are copies of each other. Of rows that share the smallest doc_id the text with the smallest
    hash stays, once if rows repeat. Rows without doc_id all stay, as nothing names them.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if benchmark windows cover a twentieth of their words or more, exactly a twentieth included.

    Null and empty texts have no words and stay, as does everything if the benchmark has none. Rows that repeat, that
    share a doc_id or have none are judged each by its own text.
    """
    return contamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in windows of 2048 tokens.

    Null and empty texts are the end token alone. Every row is packed, also ones that repeat or have no doc_id. Pieces
    of one length are told apart by document, then start.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages' models and hashes are beyond SQL; tests compare what each stage keeps with its operator's own result, and that with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
