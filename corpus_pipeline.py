"""From raw documents to token ids: five stages, each on all that the one before has kept.

1. quality      rejects documents whose Bradley-Terry score is under the threshold,
2. near_dups    keeps one document (the least id) of each component of 5-word shingle sets that are
                alike to 0.8 or more,
3. substrings   cuts passages of 13 words or more that a document with a smaller id has too,
4. benchmark    drops documents that hold a benchmark item,
5. tokens       adds n_tokens and token_ids (and checks that the ids decode to the text).

Every stage but the last returns the columns of its input, clashing ones included; rows with null texts
pass all stages that don't reject them for their score. Of rows with one id and different texts each is a
document of its own; of equal rows near_dups keeps one. An empty table passes as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelight.llm import bpe, common, decontam, jaccard, quality, substrings


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` without those scored under the threshold; null and empty texts are scored as texts without features."""
    return quality.quality_filter(docs, common.table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` with one row of each component; rows without id or words stay."""
    return jaccard.keep_representatives(docs, k=5, t=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` without repeated passages, n_chars renewed; documents left empty by that go, empty ones stay."""
    return substrings.drop_repeats(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` without those that cover half of a benchmark item; null and empty texts stay."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` with n_tokens, token_ids and round_trip; null texts have no tokens."""
    path, pattern = bpe.tokenizer()
    out = bpe.bpe_round_trip(docs, path, pattern)
    same = F.col("decoded") == F.coalesce(common.octets("text"), F.lit(b""))
    return out.withColumn("round_trip", same).drop("decoded")


STAGES = [
    ("quality", quality_stage),
    ("near_dups", near_duplicate_stage),
    ("substrings", substring_stage),
    ("benchmark", benchmark_stage),
    ("tokens", token_stage),
]

#: Scores of a trained model decide in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialize(docs)
    return docs
