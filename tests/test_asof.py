"""The bucketed as-of operator equals a brute-force scan, including a hot key,
time ties, null keys and rows far apart in time (carry across buckets)."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotbook.operators.asof import asof_count, asof_latest, asof_latest_and_count

LEFT = T.StructType([T.StructField("lid", T.LongType()), T.StructField("k", T.LongType()),
                     T.StructField("lt", T.TimestampNTZType())])
RIGHT = T.StructType([T.StructField("rid", T.LongType()), T.StructField("k", T.LongType()),
                      T.StructField("rt", T.TimestampNTZType()), T.StructField("v", T.StringType())])


def _data(seed: int, n_left=300, n_right=300):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)

    def ts():
        # coarse minutes give many exact ties; a 10-day span crosses buckets
        return base + dt.timedelta(minutes=rnd.randrange(0, 10 * 24 * 60, 7))

    def key():
        r = rnd.random()
        if r < 0.34:
            return 1          # hot key: a third of all rows
        if r < 0.37:
            return None
        return rnd.randrange(2, 12)

    left = [(i, key(), ts()) for i in range(n_left)]
    right = [(i, key(), ts(), f"v{i}") for i in range(n_right)]
    return left, right


def _brute(left, right, inclusive):
    out = {}
    for lid, k, lt in left:
        if k is None:
            out[lid] = (None, 0)
            continue
        m = [r for r in right if r[1] == k and (r[2] <= lt if inclusive else r[2] < lt)]
        best = max(m, key=lambda r: (r[2], r[0])) if m else None
        out[lid] = (best[3] if best else None, len(m))
    return out


@pytest.mark.parametrize("seed,bucket,inclusive", [(1, "day", True), (2, "hour", True),
                                                    (3, "day", False), (4, "week", True)])
def test_asof_matches_brute_force(spark, seed, bucket, inclusive):
    left, right = _data(seed)
    L = spark.createDataFrame(left, LEFT)
    R = spark.createDataFrame(right, RIGHT)
    want = _brute(left, right, inclusive)
    got = asof_latest_and_count(L, R, ["k"], "lt", "rt", ["v"], order=["rid"], bucket=bucket,
                                inclusive=inclusive, prefix="last_", count_name="n").collect()
    assert len(got) == len(left)
    for r in got:
        assert (r["last_v"], r["n"]) == want[r["lid"]], r
    only_latest = {r["lid"]: r["last_v"] for r in
                   asof_latest(L, R, ["k"], "lt", "rt", ["v"], order=["rid"], bucket=bucket,
                               inclusive=inclusive, prefix="last_").collect()}
    only_count = {r["lid"]: r["n"] for r in
                  asof_count(L, R, ["k"], "lt", "rt", name="n", bucket=bucket,
                             inclusive=inclusive).collect()}
    assert only_latest == {k: v[0] for k, v in want.items()}
    assert only_count == {k: v[1] for k, v in want.items()}


def test_asof_keeps_left_columns_and_rows(spark):
    left, right = _data(7, 50, 5)
    L = spark.createDataFrame(left, LEFT)
    R = spark.createDataFrame(right, RIGHT)
    out = asof_latest(L, R, ["k"], "lt", "rt", ["v", "rid"], prefix="r_")
    assert out.columns == ["lid", "k", "lt", "r_v", "r_rid"]
    assert sorted(r["lid"] for r in out.collect()) == list(range(50))


def test_left_keys_superset_gives_same_answer(spark):
    left, right = _data(11)
    L = spark.createDataFrame(left, LEFT)
    R = spark.createDataFrame(right, RIGHT)
    extra = spark.createDataFrame([(999, 5, dt.datetime(2023, 6, 1))], LEFT)
    a = asof_latest(L, R, ["k"], "lt", "rt", ["v"], order=["rid"], prefix="x_")
    b = asof_latest(L, R, ["k"], "lt", "rt", ["v"], order=["rid"], prefix="x_",
                    left_keys=L.unionByName(extra))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_null_times_match_nothing(spark):
    L = spark.createDataFrame([(1, 1, None), (2, 1, dt.datetime(2024, 1, 2))], LEFT)
    R = spark.createDataFrame([(1, 1, None, "a"), (2, 1, dt.datetime(2024, 1, 1), "b")], RIGHT)
    got = {r.lid: (r.x_v, r.n) for r in asof_latest_and_count(
        L, R, ["k"], "lt", "rt", ["v"], prefix="x_", count_name="n").collect()}
    assert got == {1: (None, 0), 2: ("b", 1)}


@pytest.mark.parametrize("seed,inclusive", [(21, True), (22, False)])
def test_single_fixed_width_payload_path(spark, seed, inclusive):
    left, right = _data(seed)
    L = spark.createDataFrame(left, LEFT)
    R = spark.createDataFrame(right, RIGHT)
    out = asof_latest(L, R.select("k", "rt", F.col("rt").alias("seen")), ["k"], "lt", "rt",
                      ["seen"], inclusive=inclusive, prefix="last_")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    got = {r.lid: r.last_seen for r in out.collect()}
    for lid, k, lt in left:
        times = [rt for _, rk, rt, _ in right
                 if k is not None and rk == k and (rt <= lt if inclusive else rt < lt)]
        assert got[lid] == (max(times) if times else None)


def test_fixed_width_payload_with_tiebreak_is_hash_aggregated(spark):
    left, right = _data(31)
    L = spark.createDataFrame(left, LEFT)
    R = spark.createDataFrame(right, RIGHT).withColumn("neg", -F.col("rid"))
    out = asof_latest(L, R, ["k"], "lt", "rt", ["rid", "rt"], order=["neg"], prefix="x_")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    got = {r.lid: (r.x_rid, r.x_rt) for r in out.collect()}
    for lid, k, lt in left:
        m = [(rt, -rid, rid) for rid, rk, rt, _ in right if k is not None and rk == k and rt <= lt]
        best = max(m) if m else None
        assert got[lid] == ((best[2], best[0]) if best else (None, None))
