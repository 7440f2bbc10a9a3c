"""Change sets between two versions of a table, and stored counts kept up to date by them.

A report over counts need not read all rows again after a few changed: the
changed rows leave with sign -1 and enter with +1, are folded by group, and are
added to the stored counts.  Work after the comparison grows with the changes and the groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_set(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of ``old`` that are changed or gone (``sign`` -1) and those of ``new`` that are
    changed or added (+1), with the columns of ``old``.  ``key`` is unique and not null in both."""
    rest = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("__old"))
    b = new.select(*key, F.struct(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in rest]).alias("__new"))
    moved = a.join(b, list(key), "full").filter(~F.col("__old").eqNullSafe(F.col("__new")))
    sides = F.array(F.struct(F.lit(-1).alias("sign"), F.col("__old").alias("row")), F.struct(F.lit(1).alias("sign"), F.col("__new").alias("row")))
    return (moved.select(*key, F.inline(sides)).filter("row is not null")
            .select(*[F.col(c) if c in key else F.col(f"row.{c}").alias(c) for c in old.columns], "sign"))


def counted(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, n): stored counts of a table from scratch."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def recounted(stored: DataFrame, changes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stored counts (*by, n) after ``changes``; groups that are empty now are gone."""
    delta = changes.groupBy(*by).agg(F.sum("sign").alias("n"))
    return (stored.select(*by, "n").unionByName(delta).groupBy(*by).agg(F.sum("n").alias("n")).filter("n <> 0"))
