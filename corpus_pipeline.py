"""The corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm import decontaminate, language, near, packing, pii
from tablegauge.llm.common import documents, staged, table
from tablegauge.llm.queries import vocabulary

#: A document stays if its language is named with at least this posterior.
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without a letter, with a null text
    or without a likely language go."""
    found = language.predict(docs, language.fit(language.learnable(docs)), "__lang", "__sure")
    return found.where((F.col("__lang") != language.UNKNOWN) & (F.col("__sure") >= SURE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal and alike texts: its smallest doc_id."""
    return near.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind."""
    return pii.mask(docs, pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 ids."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Trained models, sketches and a tokenizer decide the rows: no SQL can.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
