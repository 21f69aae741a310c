"""A training-data pipeline over ``documents``: toxicity, exact dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept. Between stages the rows are written as Parquet to the folder that driver and
executors share, and read again, so a lost executor repeats at most a stage's tasks;
then what the stage staged, and the rows it read, are deleted.

Defined cases, for every stage: null texts count as empty; null ids, sources and other
columns pass unchanged (in ties of equal or linked texts a known id stays before a null
one); rows that repeat id and text are rows of their own, and copies where a stage looks
for copies; an empty table gives an empty one; extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import exact_dedup, mixing, near_join, packing, toxicity
from eventloom.llm.common import scratch, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not call toxic."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    judged = toxicity.score_documents(docs, net, into=("__el_score", "__el_predicted"))
    return judged.filter("__el_predicted = 0").drop("__el_score", "__el_predicted")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts."""
    return near_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, repeated or cut as the sources' targets ask."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mix_sources", mix),
    ("pack_sequences", pack),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        # once a stage's rows are written, nothing reads what it staged or the rows before it
        with scratch(spark) as made:
            made += before
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
            before = [made.pop()]
    return STAGES[-1][1](spark, docs, sf_dir)
