"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage reads what the one before wrote, works on all of it, and returns the
columns of documents; the last returns the packed pieces.  Null and empty texts
are scored, mixed and packed like others (as texts without words) and are copies
of nothing; texts are read whole; repeated rows count as copies, of which one
stays; rows of null key stay; columns may have any names besides doc_id, text and
source; from no documents come no pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import jaccard, mixing, packing, quality, queries, toxicity
from siftline.llm.frames import remove, shared_folder, table

#: Not expressible in SQL: the classifiers, the rounding and the packing are iterative.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.below(docs, queries.toxicity_model(docs, table(spark, sf_dir, "labels")), queries.TOXIC)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    return quality.at_least(docs, queries.quality_model(docs, table(spark, sf_dir, "labels")), queries.GOOD)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least key, of each group linked by five-word shingles and a similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, queries.vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents.

    Every stage but the last writes its documents as Parquet in the folder that driver and executors share, from which
    the next one reads the columns that it needs; a table goes once the next one is written.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if before:
                remove(spark, before)
            before = f"{folder}/{i}"
    return docs
