"""Every registered query equals its DuckDB oracle (rows, columns, values) at sf0.001."""

import pytest

import __spark_entry__ as E
from slotbook.registry import all_oracle_sql, all_queries
from tests.conftest import SMOKE_DIR
from tools.oracle_check import digest, duck

KEYS = sorted(all_queries())  # the reference's operators; tests/llm has its own tests


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE_DIR)


def test_every_key_has_oracle_sql():
    assert set(all_oracle_sql()) == set(all_queries()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SMOKE_DIR)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows) == digest(dcols, drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["created_at", "profit"]
    assert df.count() > 0


SMJ_KEYS = ["booking_log", "admit_bookings", "transition_bookings", "import_members",
            "place_detail_owner", "effective_ban_status", "ban_gate", "places_member_view"]


@pytest.mark.parametrize("key", SMJ_KEYS)
def test_matches_oracle_without_broadcast(spark, con, key):
    """The plan shapes of a large cluster: every join sort-merge (no broadcast)."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        df = E.queries()[key](spark, SMOKE_DIR)
        rows = [tuple(r) for r in df.collect()]
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    res = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert digest(df.columns, rows) == digest(dcols, res.fetchall())
    assert "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("view", __import__("slotbook.sources.views", fromlist=["VIEW_NAMES"]).VIEW_NAMES)
def test_view_matches_oracle_view(spark, con, view):
    from slotbook.oracle_views import with_views
    from slotbook.sources.views import Catalog
    df = getattr(Catalog(spark, SMOKE_DIR), view)
    res = con.execute(with_views(f"SELECT * FROM {view}"))
    dcols = [d[0] for d in res.description]
    assert df.columns == dcols
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(dcols, res.fetchall())
