"""A corpus pipeline in four stages; each is written as Parquet and read again by the next.

Every stage works on all that the one before it kept.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, mixing, packing, toxicity
from millrace.llm.queries import tokenizer_path
from millrace.llm.scratch import Scratch

#: Trained models, EM and hashing of shingles: SQL can't express these stages (tests/llm holds brute-force versions).
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; null and empty texts stay, repeated rows are judged alike."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts, the document of the least doc_id; documents linked with nothing stay.

    Groups go by text: different texts of one doc_id are different documents, and texts
    without a doc_id are grouped like all others.  Rows that repeat a doc_id and its text
    are one document: one of them stays.
    """
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, in training order; a document taken twice is two rows.

    Texts stay whole: what is left of a source's target goes to a few documents whose sizes come
    nearest to it.  Null and empty texts are taken as often as their source is taken whole.
    """
    copies = mixing.in_order(mixing.positions(mixing.mix(docs, keep=True, whole=True)))
    return copies.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each copy lies in the training sequences; null texts are a piece of the end id alone, repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` of a directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
