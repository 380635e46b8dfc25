"""Readers for the Parquet tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, lazily; column pruning and filters reach the scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, separator: str = ",", missing: str = "") -> DataFrame:
    """A table of separated values, by a schema and so in one pass; lines that don't fit it are an error."""
    return spark.read.csv(path, schema=schema, header=header, sep=separator, nullValue=missing, mode="FAILFAST", enforceSchema=False)


def write(df: DataFrame, path: str, format: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    """Write a table as ``parquet``, ``orc``, ``json`` or ``csv`` (with a header), by the values of some columns if given."""
    if format not in ("parquet", "orc", "json", "csv"):
        raise ValueError(f"unknown format {format!r}")
    writer = df.write.format(format).mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
