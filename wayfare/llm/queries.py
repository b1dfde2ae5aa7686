"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import chat_tools
from wayfare.llm.bpe import bpe_round_trip
from wayfare.llm.decontamination import contaminated
from wayfare.llm.html_text import extract_text
from wayfare.llm.language_model import score_texts
from wayfare.llm.pii import pseudonymise
from wayfare.llm.quality import quality_rules
from wayfare.llm.simhash import simhash_duplicates
from wayfare.llm.token_ids import token_id_round_trip
from wayfare.llm.toxicity import remainder, toxicity_held_out


#: The setting that holds the key of pseudonyms, and the key where it is unset. Real data take a secret one.
PII_KEY_SETTING, PII_KEY = "spark.wayfare.pseudonyms.key", "wayfare-public-demonstration-key"


def pii_key(spark: SparkSession) -> bytes:
    return spark.conf.get(PII_KEY_SETTING, PII_KEY).encode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tools.format_chat(table(spark, sf_dir, "conversations"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), remainder("doc_id", 7) == 2)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_id_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), pii_key(spark))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_decontamination": op2_decontamination,
        "op3_chat_tools": op3_chat_tools,
        "op4_language_model": op4_language_model,
        "op5_html": op5_html,
        "op6_token_ids": op6_token_ids,
        "op7_pii": op7_pii,
        "op8_simhash": op8_simhash,
        "op9_bpe": op9_bpe,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for whole tables. That of op3 says what messages without tool JSON become; the tables hold no other."""
    return {"op3_chat_tools": chat_tools.ORACLE}
