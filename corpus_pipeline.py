"""The corpus pipeline: documents in, read-back token shards out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the driver of the
pipeline writes it as Parquet and reads it again as the next stage's ``docs``. All stages
but the last return the columns of ``documents``.

1. ``language_id``: documents without a letter, or whose language the model cannot tell
   (probability below ``MIN_LANG_SCORE``), go. The model learns from labelled documents
   whose ``crc32(doc_id) mod 4`` is not 2, among those the stage is given.
2. ``jaccard_join``: one document of each class of near duplicates stays.
3. ``decontamination``: documents that hold a benchmark passage go.
4. ``mixing``: the domain, language and source tree is brought to its target weights under a
   token budget; a document is repeated once for each epoch that takes it.
5. ``token_binary``: token ids in wavelet-matrix shards, read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.llm import decontaminate, jaccard_join, language, mixing, token_shards
from shardwright.llm.common import staged
from shardwright.llm.queries import mix_weights, table, with_domain

MIN_LANG_SCORE = 0.3
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs, language.learnable())
    seen = language.predict(docs, model, tuple(docs.columns), ("_language", "_certainty"))
    return seen.where((F.col("_language") != language.UND) & (F.col("_certainty") >= MIN_LANG_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(with_domain(docs), ["domain", "lang", "source"], mix_weights(spark))
    return mixed.select(*docs.columns)


def token_binary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_shards.encode_and_read(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("jaccard_join", near_duplicates), ("decontamination", decontamination),
    ("mixing", mix), ("token_binary", token_binary)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
