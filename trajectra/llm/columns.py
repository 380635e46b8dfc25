"""Keep a table's own columns apart from those that an operator adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def protect(docs: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but ``needed`` renamed out of the way, and the names to give back."""
    away = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in needed}
    return docs.withColumnsRenamed(away), {v: k for k, v in away.items()}


def give_back(docs: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    """The columns of the table as it came, by name; what the operator added goes."""
    held = {own: away for away, own in names.items()}
    return docs.select(*[F.col(f"`{held.get(c, c)}`").alias(c) for c in columns])


def row_key(*columns: str) -> Column:
    """128 bits that stand for a row's values of these columns: two hashes of different seeds."""
    values = [F.col(f"`{c}`") for c in columns]
    return F.struct(F.xxhash64(*values).alias("x"), F.xxhash64(F.lit("second"), *values).alias("y"))
