"""Corpus pipeline over ``documents``: five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. ``run`` writes each stage's result as
Parquet in the shared folder and reads it again as the next one's input.

* toxicity: documents that score one half or more go.
* near_dedup: of each group of near copies, texts whose five-word shingles share
  0.8 or more, the document with the smallest id stays.
* decontamination: documents that hold a benchmark item go.
* mixing: documents are repeated, or left out, so that every source's words
  meet its target; copies of a document are equal rows.
* token_shards: what is left is written as token shards in training order; one
  row per sequence is returned.

Empty tables pass through every stage; null texts count as empty, null ids and
sources are kept as they are, repeated rows count as near copies of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellwright.llm import decontamination, mixing, near_copies, token_shards, toxicity
from cellwright.llm.common import read, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_shards.write_shards(docs, token_shards.shard_folder(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_shards", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, all stages applied to documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: SQL cannot express the stages (learned scores, 64-bit hashes, token ids).
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
