"""snake_case -> camelCase column names for API-shaped output.

A name without '_' is kept as is.  Any other name is split at '_' and '-'; its
parts are lower-cased and each but the first is capitalised (a part that does
not begin with a letter keeps an '_' before it).  Two columns mapping to one name is an
error rather than a silent overwrite.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def camel_name(name: str) -> str:
    if "_" not in name:
        return name
    head, *rest = re.split("[_-]", name.lower())
    return head + "".join(p.capitalize() if p[:1].isalpha() else f"_{p}" for p in rest)


def camel_columns(df: DataFrame) -> DataFrame:
    new = [camel_name(c) for c in df.columns]
    if len(set(new)) != len(new):
        dup = sorted({n for n in new if new.count(n) > 1})
        raise ValueError(f"camelCase rename collides on {dup}")
    return df.toDF(*new)
