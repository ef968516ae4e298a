"""From raw documents to packed token windows, in five stages.

Each stage takes all documents that its predecessor kept and, but for the last,
returns the columns of ``documents``; it is written as Parquet before the next
one reads it. Rows whose text or id is null pass every filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staveline.llm import toxicity
from staveline.llm.decontamination import clean
from staveline.llm.minhash import first_of_each_group
from staveline.llm.packing import pack
from staveline.llm.pii import redacted
from staveline.llm.tables import table, vocabulary
from staveline.sources.scratch import materialize

#: Fixed value: a document of this toxicity score or more is rejected.
TOXIC_AT = 0.7
VOCABULARY = "word_bpe_49k.json"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subsequence-kernel machine, trained on the labels, does not reject."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs, machine, score_col="__toxicity")
    return scored.filter(F.col("__toxicity") < TOXIC_AT).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the smallest id."""
    return first_of_each_group(docs, shingle=5, per_cent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"), any_run=True)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    return redacted(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens, with their ids."""
    return pack(docs, vocabulary(VOCABULARY), with_ids=True, words=150_000, keep_words=False)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: SQL can't express the learnt, approximate and sequential stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
