"""A corpus pipeline: quality, near-duplicates, decontamination, secrets, token ids.

Every stage takes all that its predecessor kept and returns it with the columns of
``documents``; the last returns (doc_id, n_tokens, ids_sha256, decoded_sha256).

* quality rules: documents that fail the base rules or the likelihood ratio go;
* near-duplicates: of each group the document with the smallest id stays.  Documents link
  if the Jaccard similarity of their five-word shingles is 0.8 or more; candidates come of
  SimHash and of bands of minhashes, which miss few links at the edge, and every link is verified;
* decontamination: documents into which a benchmark item leaks go;
* secrets: every span is replaced by the name of its kind, and ``n_chars`` is that of
  the new text;
* encoding: byte-level BPE ids of what is left, with their round trip.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.llm.bpe_codec import round_trip
from sparkgauge.llm.common import read_table, stored
from sparkgauge.llm.decontaminate import without_leaks
from sparkgauge.llm.near_copies import one_of_each
from sparkgauge.llm.quality_rules import accepted
from sparkgauge.llm.secret_scan import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(columns) if "n_chars" in columns else out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secret_scans),
    ("token ids", token_ids),
]

#: SQL expresses none of the hashed and iterative stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
