"""A corpus pipeline of five stages, each the operator of that name, over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet in the shared folder and read
again as the next one's docs. All but the last return the columns of documents. Documents that the classifier calls toxic
and those that the quality rules reject go; lines common on a site go from texts; of near duplicates the document of the
least id stays; what is left is packed into token windows.

Null and empty texts are documents without words: the classifier scores them by its bias, and the quality rules reject them
(fewer than ten words). Null and repeated ids are rows like others; of rows equal in text one stays, null ids included. An
empty table gives an empty one at each stage. Columns that documents do not have, also those named like an operator's own,
go through all stages but packing unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docgrain.llm import line_dedup, packing, quality_rules, simhash
from docgrain.llm import toxicity as toxicity_model
from docgrain.llm.common import saved, table
from docgrain.llm.queries import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity_model.accept(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_classes(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("line_dedup", lines), ("simhash", near_duplicates), ("packing", pack)]

#: The first stage is a trained model, which SQL can't express; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
