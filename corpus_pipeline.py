"""The corpus pipeline: quality rules, near-duplicates, decontamination, pseudonyms, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Between stages the rows
are written as Parquet to the shared folder and read again, so a lost executor costs no earlier stage. The last
stage's rows are the documents' token ids, with digests of them and of what they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfare.llm.bpe import bpe_round_trip
from wayfare.llm.decontamination import without_contaminated
from wayfare.llm.near_copies import one_of_each_group
from wayfare.llm.pii import with_pseudonyms
from wayfare.llm.quality import keep_good
from wayfare.llm.queries import pii_key, table
from wayfare.plans.shared import drop_path, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, public_tokenizers.path("piece_bpe_32k.model"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_pseudonyms(docs, pii_key(spark))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pseudonyms", pseudonyms),
    ("encoding", encoding),
]

#: Tokenisers, alignment, keyed permutations and connected components are beyond SQL; the tests have a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)  # what the next stage reads is written
        before = path
    return docs
