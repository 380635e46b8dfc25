"""Results are rounded the same way in the queries and their SQL, so that sums in another order compare equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """All double columns to six digits; minus zero is zero."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), DIGITS) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema])
