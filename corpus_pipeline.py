"""A training corpus from raw documents: five stages, each on all that the one before kept.

All stages read whole texts and take any columns beside doc_id, text and source, whatever their names. Empty tables give empty
results. Documents without id are documents like others, and so are rows that repeat an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewloom.llm.common import checkpointed, release, table
from reviewloom.llm.decontaminate import drop_contaminated
from reviewloom.llm.mixing import mixed_documents
from reviewloom.llm.ngram_join import first_of_groups
from reviewloom.llm.sharding import shard_by_bytes
from reviewloom.llm.toxicity import drop_toxic, fit

SOURCE_WEIGHTS, N_SHARDS = (5, 2, 1), 40


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects, which learns from ``labels``.

    Null and empty texts stay. Without labels of both classes nothing goes; repeated rows go or stay together."""
    release(spark)
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links hold together: that of the smallest doc_id, null last.

    Documents without words, null texts among them, are linked with nothing and stay, all of them; of rows that repeat id and
    text one stays, and different texts under one id, or none, don't stand for each other."""
    release(spark)
    return first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold items of ``benchmark``.

    Null and empty texts hold none and stay; items without words are in no document. Repeated rows go or stay together."""
    release(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, three times at most; those without words aren't taken.

    Null is a source. Documents of one source are drawn by a digest of id and text, so a rerun takes the same; ties share what
    they are taken."""
    release(spark)
    return mixed_documents(docs, SOURCE_WEIGHTS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and its slot there, by doc_id, null first; the order of equal rows is arbitrary but one."""
    release(spark)
    return shard_by_bytes(docs, N_SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The first stage's model isn't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage's rows are written to the checkpoint folder,
    as the next reads them more than once."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
