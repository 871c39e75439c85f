"""One query for each corpus operator, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe_codec import round_trip
from .common import read_table
from .conversation_repair import damaged, repairs, repairs_sql
from .decontaminate import OVERLAPS_SQL, overlaps
from .html_extract import main_text
from .importance import resampled, resampled_sql
from .lang_id import predicted
from .quality_classifier import scored
from .quality_rules import QUALITY_SQL, crc_table, quality
from .rans_files import file_round_trip
from .secret_scan import scan
from .simhash import NEAR_DUPLICATES_SQL, near_duplicates
from .suffix_dedup import DEDUPLICATED_SQL, deduplicated
from .token_counts import token_counts


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(damaged(read_table(spark, sf_dir, "conversations")))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_quality_rules,
        op3_token_counts,
        op4_simhash,
        op5_decontamination,
        op6_html_extract,
        op7_bpe_codec,
        op8_secret_scan,
        op9_quality_classifier,
        op10_id_files,
        op11_importance_resampling,
        op12_conversation_repair,
        op13_language_id,
    )
}

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": DEDUPLICATED_SQL,
    "op2_quality_rules": QUALITY_SQL,
    "op4_simhash": NEAR_DUPLICATES_SQL,
    "op5_decontamination": OVERLAPS_SQL,
    "op11_importance_resampling": resampled_sql(crc_table()),
    "op12_conversation_repair": repairs_sql(crc_table()),
}
