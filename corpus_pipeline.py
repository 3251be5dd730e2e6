"""The corpus pipeline: stages in order, each written as Parquet and reread as the next one's documents.

Every stage works on all that its predecessor kept. All but the last return rows of ``documents`` with all their
columns, whatever those are called; the last returns the packed pieces of what is left. In all stages a null text counts
as empty, very long texts are handled whole, and an empty table gives an empty one. Rows without an id are scored,
compared as whole texts and searched like others, but the near join leaves them alone. Repeated rows have one row left
after exact dedup.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import common, decontamination, exact_dedup, near_join, packing, toxicity

#: Learned scores and packed token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; labels come from the ``labels`` table beside the documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.acceptable(docs, labels, threshold=0.7, most_rows=20_000)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest, then the smallest id (none last), then one of the ties."""
    return exact_dedup.exact_keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; five words and a similarity of 0.8.

    Texts without words, and rows without an id, are in no group and stay.
    """
    found = near_join.near_components(docs, k=5, num=80, den=100)
    return common.without_ids(docs, found.filter("component_id <> doc_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and blank items match nothing."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean(docs, items, rate=0.08)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2, batch_bytes=2 << 20)


STAGES = [
    ("toxicity", toxic),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        mark = common.written()
        after = common.staged(stage(spark, docs, sf_dir), "".join(c if c.isalnum() else "-" for c in name))
        common.release(mark, but_last=1)  # what the stage has staged for itself
        docs = after
    return docs
