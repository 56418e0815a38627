"""The corpus pipeline: five stages over `documents`, each one operator.

Every stage gets what its predecessor kept; all but the last return the
columns of `documents`.  The last adds n_tokens, topic, probability and residual.

Defined cases: documents whose text is null, empty or without letters go with
language ID; rows that repeat an id and a text are one document from line dedup
on; null ids take part and come last where one of several is kept; an empty
table gives an empty result; other columns pass through, except that those
called like the columns added last are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontaminate, jaccard, langid, lines, mixing
from barloom.llm._spark import checkpoint_dir, remove


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(spark, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(spark, docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Language ID and SimHash have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to `documents`; each result is written as Parquet in the shared folder and read again.

    A stage's table is removed when the next one is written, and all are if a stage fails.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    try:
        for k, (name, stage) in enumerate(STAGES):
            path = f"{base}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    except BaseException:
        remove(spark, base)
        raise
    return docs
