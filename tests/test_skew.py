"""Rule-checked jobs on inputs where one key holds a third of all rows,
checked against a brute-force evaluation in Python (small fixture)."""

import datetime as dt

from pyspark.sql import functions as F

from slotbook import constants as C
from slotbook.plans import admission as M

HOT_PACKAGE, HOT_MEMBER = 7, 1


def _skewed(df, id_col):
    hot = F.col(id_col) % 3 == 0
    return (df.withColumn("package_id", F.when(hot, F.lit(HOT_PACKAGE).cast("bigint"))
                          .otherwise(F.col("package_id")))
              .withColumn("member_user_id", F.when(hot, F.lit(HOT_MEMBER).cast("bigint"))
                          .otherwise(F.col("member_user_id"))))


def _brute(requests, state, capacity, strict_capacity):
    ttl = dt.timedelta(hours=2)
    out = {}
    for r in requests:
        if r["package_id"] is None:
            out[r["id"]] = C.BOOKING_CREATE_FIELDS
            continue
        cap = capacity.get(r["package_id"])
        if cap is None:
            out[r["id"]] = C.BOOKING_CREATE_PACKAGE_MISSING
            continue
        seen = [s for s in state if s["created_at"] <= r["requested_at"]]
        n = sum(1 for s in seen if s["package_id"] == r["package_id"])
        if (n >= cap) if strict_capacity else (n == cap):
            out[r["id"]] = C.BOOKING_CREATE_PACKAGE_FULL
            continue
        if any(s["member_user_id"] == r["member_user_id"] and s["created_at"] + ttl > r["requested_at"]
               for s in seen):
            out[r["id"]] = C.BOOKING_CREATE_ONGOING_EXISTS
            continue
        out[r["id"]] = C.OK
    return out


def test_admission_with_a_hot_package_and_member(spark, cat):
    requests = _skewed(cat.booking_request, "id")
    state = _skewed(cat.live_booking, "id")
    # give the hot package a capacity the state actually reaches
    package = cat.package.withColumn(
        "capacity", F.when(F.col("id") == HOT_PACKAGE, F.lit(40)).otherwise(F.col("capacity")))
    req_rows = [r.asDict() for r in requests.collect()]
    st_rows = [r.asDict() for r in state.collect()]
    cap = {r.id: r.capacity for r in package.select("id", "capacity").collect()}
    hot_share = sum(1 for r in req_rows if r["package_id"] == HOT_PACKAGE) / len(req_rows)
    assert hot_share > 0.3
    for strict in (False, True):
        want = _brute(req_rows, st_rows, cap, strict)
        got = {r.id: r.reason_code for r in
               M.admit_bookings(requests, package, state, strict_capacity=strict).collect()}
        assert got == want
        assert {C.BOOKING_CREATE_PACKAGE_FULL, C.BOOKING_CREATE_ONGOING_EXISTS} <= set(got.values())


# --- every registered batch key on a skewed copy of the tables ----------------------
import duckdb  # noqa: E402
import pytest  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from slotbook.registry import all_queries  # noqa: E402
from slotbook.session import scratch_path  # noqa: E402
from slotbook.sources.tables import read_table  # noqa: E402
from tests.conftest import SMOKE_DIR  # noqa: E402
from tools.oracle_check import digest  # noqa: E402

SKEW = {  # table -> (column, key column, hot value): every third row gets the hot value
    "orders": ("o_custkey", "o_orderkey", 1),
    "lineitem": ("l_partkey", "l_orderkey", 7),
    "events": ("user_id", "event_id", 1),
}
TABLES = ["nation", "supplier", "part", "customer", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def skewed_dir(spark):
    out = scratch_path(spark, "skewed")
    for t in TABLES:
        df = read_table(spark, SMOKE_DIR, t)
        if t in SKEW:
            col, key, hot = SKEW[t]
            df = df.withColumn(col, F.when(F.col(key) % 3 == 0, F.lit(hot).cast(df.schema[col].dataType))
                               .otherwise(F.col(col)))
        df.coalesce(1).write.mode("overwrite").parquet(f"{out}/{t}.parquet")
    return out


@pytest.fixture(scope="module")
def skewed_con(skewed_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    base = skewed_dir.removeprefix("file:")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(k for k in all_queries() if not k.startswith("stream_")))
def test_parity_on_skewed_tables(spark, skewed_dir, skewed_con, key):
    df = E.queries()[key](spark, skewed_dir)
    rows = [tuple(r) for r in df.collect()]
    res = skewed_con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert len(rows) == len(drows)
    assert digest(df.columns, rows) == digest(dcols, drows)
