"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

Toxic documents go; recurring lines go; of each group of near-duplicates one document stays; sources
are mixed to weight; what is left is packed into bins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from causalpanel.llm import linededup, mixing, packing, similar, toxicity
from causalpanel.llm.common import checkpoint_dir, discard

#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go; rows keep all their columns.

    The model learns from ``labels`` and the stage's own texts. Null and empty texts stay, repeated
    rows share their fate, an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go but for their first occurrence; every document stays.

    A document all of whose lines go has an empty text; null texts stay null.
    """
    return linededup.drop_recurring_lines(docs, counted=None)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts at a Jaccard similarity of 0.8 or more, exactly, the least doc_id stays.

    SimHash prints and pivot tables discard pairs, whole shingle sets decide. Groups are the components
    of such pairs. Texts without words (null, empty) are one group; of repeated rows one stays; an empty
    table stays empty.
    """
    return similar.drop_near_duplicates(docs, size=SHINGLE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last of a source gives the words of its part.

    Documents without words (null, empty) cost nothing and come once per full epoch of their source.
    Repeated rows are taken one by one; null sources are one source; an empty table stays empty.
    """
    return mixing.mixed_texts(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its bin; repeats of a text never share a bin.

    Documents without words (null, empty) have one piece and no bin; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_lines),
    ("near-duplicates", remove_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: SQL cannot express the trained model and the sequential packing. Tests hold near-duplicates to
#: brute-force Jaccard, toxicity and lines to planted words, mixing and packing to each other's words.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    A stage's input is deleted once its result is written, so one intermediate table is kept.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            discard(spark, f"{folder}/{k - 1}")
    return docs
