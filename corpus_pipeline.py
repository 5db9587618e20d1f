"""From raw documents to training sequences: toxicity, quality, near-duplicates, packing.

All stages but the last return the columns of documents, as they came, and whole rows of it.
Cases: a null text counts as empty: it is not toxic, and the quality rules reject it (no words). Null
doc_ids and rows that repeat a doc_id are judged by their own text; of equal or near-equal texts one
row stays, whatever its doc_id (the least doc_id, null last). Very long texts are judged whole. Other
columns may have any names: helper columns take names that the table does not have. Labels without a
document, null labels and several labels of one document (the greatest counts) do no harm; without
labels of both classes nothing is toxic. An empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import packing, quality, simhash, toxicity
from folio.llm.common import documents, fresh, materialize
from folio.llm.tokens import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under the threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs, "__toxicity")
    return toxicity.scored(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the quality policy."""
    names = [fresh(docs, f"__{name}") for name in quality.MEASURES]
    bits = fresh(docs, "__failed")
    rows = quality.measured(docs, docs["text"], names).withColumn(bits, quality.failures(names))
    return rows.where(quality.kept_by("v1", bits)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_bad), ("near_duplicates", drop_copies), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenizing and the learned toxicity model have no SQL form.
ORACLE_SQL = None
