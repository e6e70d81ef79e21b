"""From raw documents to token files, in five stages.

Each stage gets the documents that its predecessor kept, reads whatever other
tables it needs from ``sf_dir``, and returns what it keeps; the last returns
what the token files hold.  In every stage null texts are empty, very long
texts are read whole, an empty table gives an empty one, and the columns of the
documents, clashing names included, return unchanged.  What a stage does with
null doc_ids, ties and repeated rows is said where its operator is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topotide.llm.decontaminate import decontaminate
from topotide.llm.mixing import mix_documents
from topotide.llm.simhash import drop_near_duplicates
from topotide.llm.tables import table
from topotide.llm.token_output import tokenised
from topotide.llm.toxicity import drop_toxic
from topotide.plans.scratch import written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier scores 0.5 or more."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each component of documents whose five-word shingles have Jaccard similarity 0.8."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources meet their targets."""
    return mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return their documents."""
    return tokenised(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: The toxicity stage learns its classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
