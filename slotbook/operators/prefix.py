"""Positions and running aggregates along a total order, without a window per key.

A window partitioned by a key sends all rows of a hot key to one task, and an
unpartitioned one sends the whole table there.  Here the rows are dealt by
range over (key, order), so a hot key covers several ranges; each range works
on its own rows, and one summary row per range (and key) carries the answer
from range to range.  The dealt rows are written once to the shared checkpoint
folder: ranges come from a sample of the rows, and both passes must see the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotbook.session import cut_lineage

_RANGE, _AT = "__range", "__at"
_ROW_BITS = 33  # of monotonically_increasing_id: row of the task; the bits above are the task


def _ranges(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_position(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """``df`` with each row's place (from 0) under ``order``, which should be a total order."""
    dealt = (df.repartitionByRange(_ranges(df), *order).sortWithinPartitions(*order)
             .withColumn(_AT, F.monotonically_increasing_id())
             .withColumn(_RANGE, F.shiftright(_AT, _ROW_BITS))
             .withColumn(_AT, F.col(_AT).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))))
    dealt = cut_lineage(dealt)
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range, so this window and this broadcast hold at most shuffle.partitions rows
    starts = (dealt.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("__n"))
              .select(_RANGE, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    return (dealt.join(F.broadcast(starts), _RANGE)
            .select(*df.columns, (F.col("__start") + F.col(_AT)).alias(name)))


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str | Sequence[str],
            name: str | Sequence[str], agg: str = "sum", inclusive: bool = True) -> DataFrame:
    """``df`` with the sum (or the ``last`` non-null) of ``value`` over the rows of its key up to
    itself (before itself if not ``inclusive``), in the ascending total ``order``; several values
    take several names.

    A sum over no rows is 0, a last value over none is null.  Rows with equal keys
    (null keys included) share a key.  ``last`` needs non-null order columns.
    """
    by, order = list(by), list(order)
    values, names = ([value], [name]) if isinstance(value, str) else (list(value), list(name))
    dealt = cut_lineage(df.repartitionByRange(_ranges(df), *by, *order).withColumn(_RANGE, F.spark_partition_id()))
    here = (Window.partitionBy(_RANGE, *by).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    earlier = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    own, part, carry, total = [], [], [], []
    for i, v in enumerate(values):
        p, o, c = f"__part{i}", F.col(f"__own{i}"), F.col(f"__carry{i}")
        if agg == "sum":
            own.append(F.coalesce(F.sum(v).over(here), F.lit(0)))
            part.append(F.sum(v))
            carry.append(F.coalesce(F.sum(p).over(earlier), F.lit(0)))
            total.append(o + c)
        elif agg == "last":
            own.append(F.last(v, ignorenulls=True).over(here))
            part.append(F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.struct(*order))))
            carry.append(F.last(p, ignorenulls=True).over(earlier))
            total.append(F.coalesce(o, c))
        else:
            raise ValueError(f"unknown aggregate {agg!r}")
    # one row per key and range that holds it
    carries = (dealt.groupBy(_RANGE, *by).agg(*[p.alias(f"__part{i}") for i, p in enumerate(part)])
               .select(F.col(_RANGE).alias("__r"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)],
                       *[c.alias(f"__carry{i}") for i, c in enumerate(carry)]))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)],
                  F.col(_RANGE) == F.col("__r"))
    out = dealt.select("*", *[o.alias(f"__own{i}") for i, o in enumerate(own)]).join(carries, same)
    return out.select(*df.columns, *[t.alias(n) for t, n in zip(total, names)])
