"""Duplicates by content hash: groups, a representative for each, and references rewritten to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_groups(df: DataFrame, key: str, content: str, least: int = 2) -> DataFrame:
    """(content_hash, representative, n): contents that stand at least so often, and the least key of each.

    Hashes are made before the shuffle and summed by task, so contents are never dealt out.
    """
    hashed = df.select(F.col(key).alias("k"), F.sha2(F.col(content), 256).alias("content_hash")).where("content_hash is not null")
    return hashed.groupBy("content_hash").agg(F.min("k").alias("representative"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def reference_map(df: DataFrame, key: str, content: str) -> DataFrame:
    """(duplicate, canonical): for each key whose content has a lesser key, that key."""
    groups = content_groups(df, key, content)
    hashed = df.select(F.col(key).alias("duplicate"), F.sha2(F.col(content), 256).alias("content_hash"))
    return hashed.join(groups, "content_hash").where(F.col("duplicate") != F.col("representative")).select("duplicate", F.col("representative").alias("canonical"))


def rewrite_references(refs: DataFrame, column: str, mapping: DataFrame, out: str) -> DataFrame:
    """Adds the canonical key of a reference, or the reference itself where it has none."""
    return refs.join(mapping, refs[column] == mapping["duplicate"], "left").withColumn(out, F.coalesce("canonical", column)).drop("duplicate", "canonical")


def duplicate_count(df: DataFrame, key: str, content: str) -> DataFrame:
    """One row: rows that another row of equal content makes superfluous."""
    return content_groups(df, key, content).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def hash_listing(df: DataFrame, key: str, content: str) -> DataFrame:
    """Every row's content hash, and whether a lesser key has it too."""
    hashed = df.select(key, F.sha2(F.col(content), 256).alias("content_hash"))
    groups = content_groups(df, key, content).select(F.col("content_hash").alias("dg_hash"), "representative")
    met = hashed.join(groups, F.col("content_hash") == F.col("dg_hash"), "left")
    return met.select(key, "content_hash", F.coalesce(F.col(key) != F.col("representative"), F.lit(False)).alias("is_duplicate"))
