"""Set-at-a-time writes: keyed updates (W01) and appends.

Parquet has no in-place UPDATE, so an update produces a *new version* of the
table: ``table LEFT JOIN updates ON key`` with the updated columns taken from
the update row where one exists.  Updates are first reduced to one row per
key with a ``max_by`` / ``min_by`` aggregate (folded map-side, so one key with
many updates stays cheap) or rejected with ``raise_error`` when a job promises
one update per key.  Appends add ids and defaults and union; writing either
result is a plain ``DataFrame.write``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(updates: DataFrame, key: Sequence[str], columns: Sequence[str],
                order_by: str | None = None, policy: str = "error") -> DataFrame:
    """Reduce ``updates`` to one row per key.

    ``policy``: ``last`` / ``first`` keep the row with the largest / smallest
    ``order_by``; ``error`` fails the job if any key has two updates.
    """
    key, columns = list(key), list(columns)
    payload = F.struct(*[F.col(c) for c in columns])
    if policy in ("last", "first"):
        if order_by is None:
            raise ValueError("order_by is required for policy last/first")
        pick = F.max_by if policy == "last" else F.min_by
        rank = F.struct(F.col(order_by), payload)
        red = updates.groupBy(*key).agg(pick(payload, rank).alias("__u"))
    elif policy == "error":
        red = (updates.groupBy(*key)
               .agg(F.count(F.lit(1)).alias("__n"), F.first(payload).alias("__u"))
               .withColumn("__u", F.when(F.col("__n") > 1, F.raise_error(
                   F.concat(F.lit("two updates for one key: "),
                            F.to_json(F.struct(*[F.col(k) for k in key])))))
                   .otherwise(F.col("__u")))
               .drop("__n"))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return red.select(*key, *[F.col(f"__u.{c}").alias(c) for c in columns])


def apply_updates(table: DataFrame, updates: DataFrame, key: Sequence[str],
                  columns: Sequence[str], order_by: str | None = None,
                  policy: str = "error") -> DataFrame:
    """New version of ``table`` with ``columns`` replaced for updated keys.

    A column set to null by an update becomes null (no coalesce).  Rows of
    ``table`` without an update are unchanged; updates for unknown keys are
    ignored, as ``UPDATE .. WHERE id = ..`` would.
    """
    key, columns = list(key), list(columns)
    red = one_per_key(updates, key, columns, order_by, policy)
    red = red.select(*key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in columns])
    j = table.join(red, key, "left")
    out = []
    for c in table.columns:
        if c in columns:
            out.append(F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def append_rows(table: DataFrame, rows: DataFrame, defaults: Mapping[str, Column] | None = None,
                id_col: str | None = None, id_expr: Column | None = None) -> DataFrame:
    """``table`` plus ``rows``, with defaults and ids filled in.

    Columns of ``table`` missing from ``rows`` take ``defaults`` (else null);
    ``id_expr`` must be deterministic (see ``functions.ids.stable_uuid``) so a
    retried task produces the same ids.
    """
    new = rows
    if id_col and id_expr is not None:
        new = new.withColumn(id_col, id_expr)
    for c, v in (defaults or {}).items():
        if c not in new.columns:
            new = new.withColumn(c, v)
    typed = [F.col(c).cast(table.schema[c].dataType).alias(c) if c in new.columns
             else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns]
    return table.unionByName(new.select(*typed))


def write_version(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a new table version (overwrite a fresh path; never in place)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append new rows to a parquet table (the sink form of W02).

    Appending is not idempotent on its own: a job that may be retried should
    append rows with deterministic ids and deduplicate on read, or write a new
    version with ``write_version`` instead.
    """
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
