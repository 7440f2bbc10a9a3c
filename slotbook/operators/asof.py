"""As-of lookups: for every left row, the latest right row (or the number of
right rows) with the same key and a time at or before the left row's time.

Spark has no as-of join, and the obvious forms do not scale: a ``<=`` join
emits every earlier right row per left row, and one window partitioned by
key sends a hot key (a third of all rows) to one task.  Here time is cut into
buckets (``date_trunc(bucket, ts)``) and the work is done at two levels:

1. inside a bucket: left and right rows of one (key, bucket) are unioned and a
   running ``last(payload, ignorenulls)`` / running count over
   ``(time, side)`` gives the in-bucket answer;
2. across buckets: right rows are first folded to one summary row per
   (key, bucket) by a partial aggregate (latest payload, row count); a window
   per key over those summaries, which holds at most one row per bucket,
   yields a "carry" row per left bucket (latest payload / count of all
   earlier buckets).  The carry rows join the level-1 union and sort first in
   their bucket, so no join back is needed.

Right rows cross the network once (in the level-1 shuffle); the level-2
inputs are partial aggregates.

No pairs are formed and the largest group is one key's rows within one
bucket, which the bucket width bounds.  All steps are built-in window and aggregate operators.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_B, _T, _SIDE, _LEFT, _PAY = "__b", "__t", "__side", "__left", "__pay"
_FIXED_WIDTH = (T.TimestampNTZType, T.TimestampType, T.DateType, T.LongType, T.IntegerType,
                T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.BooleanType)


_INTEGRAL = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def unique_rank(time_type, order_col: str, time_col: str):
    """Public form of the packed (time, integral id) rank, for ``max_by``."""
    return _unique_rank(time_type, order_col, time_col)


def _unique_rank(time_type, order_col: str, time_col: str = _T):
    """(time, integral tie-break) packed into one decimal(38,0), ordered like
    the pair: microseconds * 10^20 + (tie-break + 2^63).  Zone-free for both
    timestamp types."""
    if isinstance(time_type, T.TimestampNTZType):
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
                        f"`{time_col}`)")
    else:
        micros = F.unix_micros(F.col(time_col))
    dec = "decimal(38,0)"
    return (micros.cast(dec) * F.expr(f"CAST({10 ** 20} AS DECIMAL(38,0))")
            + (F.col(order_col).cast(dec) + F.expr(f"CAST({2 ** 63} AS DECIMAL(38,0))"))).cast(dec)


def _prep(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str,
          payload: Sequence[str] | None, order: Sequence[str], bucket: str, inclusive: bool,
          weight: str | None = None):
    by = list(by)
    left_cols = left.columns
    # Right rows first on a time tie when the lookup is inclusive (<=).
    right_side, left_side = (0, 1) if inclusive else (1, 0)
    pay = F.struct(*[F.col(c) for c in payload]) if payload else F.lit(None)
    # Null keys and null times match nothing (equi-join / comparison semantics).
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*by, right_time]])
    r = (right.filter(has_key)
         .select(*[F.col(k) for k in by], F.col(right_time).alias(_T),
                 F.date_trunc(bucket, F.col(right_time)).alias(_B),
                 F.lit(right_side).alias(_SIDE),
                 *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)],
                 F.lit(None).cast(left.select(F.struct(*left_cols)).schema[0].dataType).alias(_LEFT),
                 pay.alias(_PAY),
                 (F.col(weight) if weight else F.lit(1)).cast("long").alias("__w")))
    lt = left.select(*[F.col(k) for k in by], F.col(left_time).alias(_T),
                     F.date_trunc(bucket, F.col(left_time)).alias(_B),
                     F.lit(left_side).alias(_SIDE),
                     *[F.lit(None).cast(right.schema[o].dataType).alias(f"__o{i}")
                       for i, o in enumerate(order)],
                     F.struct(*[F.col(c) for c in left_cols]).alias(_LEFT),
                     F.lit(None).cast(r.schema[_PAY].dataType).alias(_PAY),
                     F.lit(0).cast("long").alias("__w"))
    return by, left_cols, r, lt


def _run(left, right, by, left_time, right_time, payload, order, bucket, inclusive,
         want_latest, want_count, left_keys=None, weight=None):
    by, left_cols, r, lt = _prep(left, right, by, left_time, right_time, payload, order,
                                 bucket, inclusive, weight)
    right_side = 0 if inclusive else 1
    o_cols = [f"__o{i}" for i in range(len(order))]

    # Level 2 first, on small data: one summary row per (key, bucket) of the
    # right side (partial aggregate, so a hot key is folded map-side) and one
    # row per (key, bucket) that holds left rows; a window per key over these
    # (at most one row per bucket) gives each left bucket what earlier buckets
    # hold.  Left buckets sort before the right summary of the same bucket, so
    # the frame "up to the previous row" sees earlier buckets only.
    aggs = []
    pay_fields = r.schema[_PAY].dataType.fields if want_latest else []
    fixed = bool(pay_fields) and all(isinstance(f.dataType, _FIXED_WIDTH) for f in pay_fields)
    rank = None
    if want_latest and fixed and not o_cols and len(pay_fields) == 1:
        rank = F.col(_T)
    elif (want_latest and fixed and len(o_cols) == 1
          and isinstance(r.schema[o_cols[0]].dataType, _INTEGRAL)
          and isinstance(r.schema[_T].dataType, (T.TimestampNTZType, T.TimestampType))):
        rank = _unique_rank(r.schema[_T].dataType, o_cols[0])
    hashable = rank is not None
    if hashable:
        # Fixed-width payload columns and a fixed-width rank that is unique per
        # row (time, or time and integral tie-break packed in one decimal):
        # max_by per column then picks the same row for every column, and the
        # buffers are fixed-width, so Spark plans a hash aggregate instead of
        # sorting every right row.
        for f in pay_fields:
            aggs.append(F.max_by(F.col(f"{_PAY}.{f.name}"), rank).alias(f"__p_{f.name}"))
    elif want_latest:
        aggs.append(F.max_by(F.col(_PAY), F.struct(F.col(_T), *[F.col(c) for c in o_cols]))
                    .alias(_PAY))
    if want_count:
        aggs.append(F.sum("__w").alias("__n"))
    summary = r.groupBy(*by, _B).agg(*aggs).withColumn("__k", F.lit(1))
    if hashable:
        summary = (summary.withColumn(_PAY, F.struct(*[F.col(f"__p_{f.name}").alias(f.name)
                                                        for f in pay_fields]))
                   .drop(*[f"__p_{f.name}" for f in pay_fields]))
    # Buckets that hold left rows.  ``left_keys`` may supply them from a
    # cheaper frame than ``left`` (a superset is fine: a carry row for a bucket
    # without left rows is simply never read).
    if left_keys is None:
        buckets = lt.select(*by, _B)
    else:
        buckets = left_keys.select(*[F.col(k) for k in by],
                                   F.date_trunc(bucket, F.col(left_time)).alias(_B))
    buckets = buckets.distinct().withColumn("__k", F.lit(0))
    if want_latest:
        buckets = buckets.withColumn(_PAY, F.lit(None).cast(summary.schema[_PAY].dataType))
    if want_count:
        buckets = buckets.withColumn("__n", F.lit(None).cast("long"))
    wk = Window.partitionBy(*by).orderBy(_B, "__k").rowsBetween(Window.unboundedPreceding, -1)
    carry_pay = (F.last(_PAY, ignorenulls=True).over(wk) if want_latest
                 else F.lit(None).cast(r.schema[_PAY].dataType))
    carry_n = F.coalesce(F.sum("__n").over(wk), F.lit(0)) if want_count else F.lit(0)
    carry = (summary.unionByName(buckets)
             .select(*by, _B, "__k", carry_pay.alias(_PAY), carry_n.alias("__c"))
             .filter(F.col("__k") == 0)
             .select(*by, F.lit(None).cast(r.schema[_T].dataType).alias(_T), _B,
                     F.lit(-1).alias(_SIDE),
                     *[F.lit(None).cast(r.schema[c].dataType).alias(c) for c in o_cols],
                     F.lit(None).cast(r.schema[_LEFT].dataType).alias(_LEFT), _PAY, "__c"))

    # Level 1: one shuffle of right rows, left rows and carry rows on
    # (key, bucket).  The carry row sorts first in its bucket (null time,
    # side -1), so a running last()/sum() over the bucket already includes
    # everything before the bucket.
    rows = (r.withColumnRenamed("__w", "__c")
            .unionByName(lt.withColumnRenamed("__w", "__c"))
            .unionByName(carry))
    w = (Window.partitionBy(*by, _B).orderBy(_T, _SIDE, *o_cols)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cols = [_LEFT]
    if want_latest:
        cols.append(F.last(_PAY, ignorenulls=True).over(w).alias("__pay_at"))
    if want_count:
        cols.append(F.sum(F.when(F.col(_SIDE) != (1 - right_side), F.col("__c")).otherwise(0))
                    .over(w).alias("__n_at"))
    j = rows.select(*cols, _SIDE).filter(F.col(_SIDE) == 1 - right_side)
    out = [F.col(f"{_LEFT}.{c}").alias(c) for c in left_cols]
    extra = {}
    if want_latest:
        extra["pay"] = F.col("__pay_at")
    if want_count:
        extra["n"] = F.col("__n_at")
    return j, out, extra


def asof_latest(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str,
                right_time: str, payload: Sequence[str], *, order: Sequence[str] = (),
                bucket: str = "minute", inclusive: bool = True, prefix: str = "",
                left_keys: DataFrame | None = None) -> DataFrame:
    """Left rows plus the payload columns of the latest matching right row.

    A right row matches when its ``by`` columns equal the left row's and its
    ``right_time`` is <= (``inclusive``) or < the left row's ``left_time``.  Ties
    on time are broken by ``order`` (the last in that order wins).  Payload
    columns are null when nothing matches.  Output columns: the left columns
    followed by ``prefix + payload``.  ``left_keys`` (optional) is any frame
    with the ``by`` and ``left_time`` columns covering the left rows, used
    instead of ``left`` to list the left buckets when ``left`` is costly.
    """
    j, out, extra = _run(left, right, by, left_time, right_time, payload, order, bucket,
                         inclusive, True, False, left_keys)
    pay = extra["pay"]
    return j.select(*out, *[pay.getField(c).alias(prefix + c) for c in payload])


def asof_count(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str,
               right_time: str, *, name: str = "asof_count", bucket: str = "minute",
               inclusive: bool = True, left_keys: DataFrame | None = None,
               weight: str | None = None) -> DataFrame:
    """Left rows plus the number of right rows with equal key and time <= (or <) theirs.

    With ``weight`` (an integral column of ``right``) the rows' weights are
    summed instead: +1 / -1 events give "how many were open at that time".
    """
    j, out, extra = _run(left, right, by, left_time, right_time, None, (), bucket, inclusive,
                         False, True, left_keys, weight)
    return j.select(*out, extra["n"].alias(name))


def asof_latest_and_count(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str,
                          right_time: str, payload: Sequence[str], *, order: Sequence[str] = (),
                          bucket: str = "minute", inclusive: bool = True, prefix: str = "",
                          count_name: str = "asof_count") -> DataFrame:
    """Both answers from one pass."""
    j, out, extra = _run(left, right, by, left_time, right_time, payload, order, bucket,
                         inclusive, True, True)
    pay = extra["pay"]
    return j.select(*out, *[pay.getField(c).alias(prefix + c) for c in payload],
                    extra["n"].alias(count_name))

