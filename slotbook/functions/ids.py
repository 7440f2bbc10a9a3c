"""Deterministic, uuid-shaped ids for rows a job creates.

``uuid()`` would depend on task and partition layout, so a retried task could
mint different ids.  Hashing the job name with the request key gives the same
id on every attempt and is computed inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_uuid(job: str, *keys: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(job), *[k.cast("string") for k in keys]))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def stable_uuid_sql(job: str, *keys: str) -> str:
    """The same id as ``stable_uuid`` written in SQL (for oracle queries)."""
    parts = ", ".join([f"'{job}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    h = f"md5(concat_ws(':', {parts}))"
    return (f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), "
            f"substr({h}, 17, 4), substr({h}, 21, 12))")
