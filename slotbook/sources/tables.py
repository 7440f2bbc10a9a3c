"""Raw parquet tables with declared schemas.

Declaring the schema skips inference and fails fast on drift.  Reads are lazy:
Catalyst prunes columns and pushes filters into each scan, so declaring every
column costs nothing for a query that needs two of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _I, _S, _D, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampNTZType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


RAW_SCHEMAS = {
    "nation": _schema(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "supplier": _schema(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "part": _schema(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S),
                    ("p_size", _I), ("p_retailprice", _D)),
    "orders": _schema(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S),
                      ("o_totalprice", _D), ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _schema(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L),
                        ("l_linenumber", _I), ("l_quantity", _D), ("l_extendedprice", _D),
                        ("l_discount", _D), ("l_tax", _D), ("l_returnflag", _S),
                        ("l_linestatus", _S), ("l_shipdate", _TS)),
    "customer": _schema(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I),
                        ("c_acctbal", _D), ("c_mktsegment", _S)),
    "events": _schema(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S),
                      ("value", _D), ("props", _S)),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def check_schema(spark: SparkSession, sf_dir: str, name: str) -> None:
    """Compare the files' schema (parquet footers only) with the declared one.

    Every declared column must exist with the declared type; extra columns in
    the files are allowed (they are never read).
    """
    found = {f.name: f.dataType for f in spark.read.parquet(table_path(sf_dir, name)).schema}
    bad = [(f.name, f.dataType.simpleString(),
            found[f.name].simpleString() if f.name in found else "missing")
           for f in RAW_SCHEMAS[name] if found.get(f.name) != f.dataType]
    if bad:
        raise ValueError(f"table {name!r} does not match its declared schema: {bad}")


def read_table(spark: SparkSession, sf_dir: str, name: str, check: bool = False) -> DataFrame:
    """Read one raw table; known tables get their declared schema (``check``
    first verifies the files against it)."""
    reader = spark.read
    if name in RAW_SCHEMAS:
        if check:
            check_schema(spark, sf_dir, name)
        reader = reader.schema(RAW_SCHEMAS[name])
    return reader.parquet(table_path(sf_dir, name))
