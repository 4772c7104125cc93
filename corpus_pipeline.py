"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs`` as they came;
a stage reads only ``doc_id`` and ``text``, so further columns pass through.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm.bpe import OUTPUTS as BPE_OUTPUTS
from cladeworks.llm.bpe import digester
from cladeworks.llm.common import filter_texts, replace_texts, shared_dir, text_map
from cladeworks.llm.decontamination import clean_rows
from cladeworks.llm.near_duplicates import keep_one
from cladeworks.llm.pii import redact, trained
from cladeworks.llm.quality_rules import judge
from cladeworks.sources.tables import read_table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go."""
    return filter_texts(docs, "text", lambda texts: judge(texts)["kept"])


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id.

    Rows without an id are never in a group and stay. Of rows that share id and words one stays; rows that
    share only the id are different documents.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return clean_rows(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; ``n_chars``, if present, is counted anew."""
    weights = trained()
    out = replace_texts(docs, "text", lambda texts: [redact(t, weights) for t in texts])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text."""
    path = public_tokenizers.path(TOKENIZER)
    return text_map(docs, "doc_id", "text", BPE_OUTPUTS, start=lambda: digester(path))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("personal data", redact_personal_data),
    ("byte-level BPE", tokenize),
]

#: The zstandard bands, the field's spans and the merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next stage."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
