"""Tables in and out: Parquet, delimited text, JSON lines and plain bytes, by one pair of functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "csv", "tsv", "json", "text", "bytes")


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """Rows of a path. Delimited text and JSON need a schema, so that no pass is spent on guessing one; what doesn't fit it is null."""
    if kind not in FORMATS:
        raise ValueError(f"no format {kind!r}; there are {', '.join(FORMATS)}")
    if kind == "bytes":
        return spark.read.format("binaryFile").load(path)
    if kind in ("csv", "tsv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read
    if kind in ("csv", "tsv"):
        reader = reader.option("header", "true").option("sep", "\t" if kind == "tsv" else ",").option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format("csv" if kind == "tsv" else kind).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", overwrite: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """Writes rows; a path that exists is an error unless it is to be overwritten."""
    if kind not in FORMATS[:-1]:
        raise ValueError(f"{kind!r} can't be written")
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*partition_by)
    if kind in ("csv", "tsv"):
        writer = writer.option("header", "true").option("sep", "\t" if kind == "tsv" else ",").option("escape", '"')
    writer.format("csv" if kind == "tsv" else kind).save(path)
