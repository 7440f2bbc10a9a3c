"""Drop secrets before a DataFrame leaves the library."""

from __future__ import annotations

from pyspark.sql import DataFrame

SECRET_COLUMNS = ("password",)


def redact(df: DataFrame) -> DataFrame:
    drop = [c for c in df.columns if c.lower() in SECRET_COLUMNS]
    return df.drop(*drop) if drop else df
