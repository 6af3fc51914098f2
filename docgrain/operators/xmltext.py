"""Markup as text: names, prefixes and indentation by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def names(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Distinct first groups of a pattern; made distinct inside each row before they are dealt out."""
    return df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))).alias(out)).distinct()


def strip_indent(text: Column) -> Column:
    """Without white space that stands alone between tags."""
    return F.regexp_replace(text, r">\s+<", "><")


def rename_prefixes(text: Column, table: dict[str, str]) -> Column:
    """Namespace prefixes of tags, attributes and declarations by a table."""
    for old, new in sorted(table.items()):
        text = F.regexp_replace(text, rf"(</?|\s|xmlns:){old}(?=[:=])", f"$1{new}")
    return text
