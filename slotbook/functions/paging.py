"""LIMIT/OFFSET paging over an explicit total order.

``page(df, order, page, limit)`` plans as ``TakeOrderedAndProject`` (a per-task
top-(offset+limit) followed by a merge on the driver), so a page never sorts
or shuffles the whole table.  ``page=None`` means "the whole result": no sort
is added, because a distributed result has no order to preserve.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotbook import constants as C
from slotbook.operators.prefix import with_position


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def page(df: DataFrame, order: Sequence, page: int | None = C.DEFAULT_PAGE,
         limit: int = C.DEFAULT_LIMIT) -> DataFrame:
    """Return rows ``(page-1)*limit .. page*limit-1`` of ``df`` under ``order``.

    ``order`` must be a total order (end it with a key column); otherwise the
    page content is undefined, as it is in the source application.
    """
    if page is None:
        return df
    if page < 1 or limit < 0:
        raise ValueError("page starts at 1 and limit must be >= 0")
    ordered = df.orderBy(*[_as_col(c) for c in order])
    offset = (page - 1) * limit
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit)


def page_after(df: DataFrame, order: Sequence[tuple[str, bool]], cursor: Sequence | None,
               limit: int = C.DEFAULT_LIMIT) -> DataFrame:
    """Keyset paging: the ``limit`` rows that follow ``cursor`` under ``order``.

    ``order`` lists ``(column, descending)`` pairs forming a total order over
    non-null values; ``cursor`` holds the values of the last row of the
    previous page (``None`` for the first page).  Unlike OFFSET, each task keeps
    only ``limit`` rows whatever the page number, and the cursor predicate can
    be pushed to the scan.
    """
    cols = [F.col(c) for c, _ in order]
    if cursor is not None:
        if len(cursor) != len(order):
            raise ValueError("cursor needs one value per order column")
        # (a, b, c) after (x, y, z): a > x  or  a = x and b > y  or ...
        cond = None
        for i, ((_c, desc), v) in enumerate(zip(order, cursor)):
            beyond = cols[i] < F.lit(v) if desc else cols[i] > F.lit(v)
            prefix = [cols[j] == F.lit(cursor[j]) for j in range(i)]
            term = beyond
            for p in prefix:
                term = p & term
            cond = term if cond is None else cond | term
        df = df.filter(cond)
    ordered = df.orderBy(*[c.desc() if d else c.asc() for c, (_n, d) in zip(cols, order)])
    return ordered.limit(limit)


def page_numbers(df: DataFrame, order: Sequence, limit: int = C.DEFAULT_LIMIT) -> DataFrame:
    """Every row with the ``page`` it is on and its ``line`` there (both from 1), under the total ``order``.

    All pages at once: rows are dealt by range and numbered by range (``with_position``), so
    no task sees more than its range, whatever the number of pages.
    """
    if limit < 1:
        raise ValueError("a page has at least one row")
    at = F.col("__position")
    return (with_position(df, [_as_col(c) for c in order], "__position")
            .select(*df.columns, (F.floor(at / limit) + 1).alias("page"), (at % limit + 1).alias("line")))
