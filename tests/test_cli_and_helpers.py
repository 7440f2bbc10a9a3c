"""CLI and small helpers."""

from slotbook.operators.writes import write_version
from slotbook.session import scale_conf, scratch_path
from tests.conftest import SMOKE_DIR


def test_cli_list_and_run(spark, capsys):
    from slotbook.__main__ import main
    assert main(["list"]) == 0
    listed = capsys.readouterr().out.split()
    assert "profit_by_day" in listed and "stream_expiry" in listed
    out = scratch_path(spark, "cli-out")
    assert main(["run", "profit_by_day", "--data", SMOKE_DIR, "--out", out]) == 0
    assert spark.read.parquet(out).count() > 0
    assert main(["run", "no_such_job", "--data", SMOKE_DIR]) == 2


def test_write_version_partitioned(spark, cat):
    out = scratch_path(spark, "version")
    write_version(cat.booking.filter("order_status = 'PENDING'"), out, ["order_status"])
    back = spark.read.parquet(out)
    assert back.count() == cat.booking.filter("order_status = 'PENDING'").count()
    assert "order_status" in back.columns


def test_scale_conf():
    c = scale_conf(100 << 40)
    assert int(c["spark.sql.shuffle.partitions"]) == 200_000          # capped
    c = scale_conf(1 << 30, partition_bytes=128 << 20)
    assert c["spark.sql.shuffle.partitions"] == "8"
    assert c["spark.sql.files.maxPartitionBytes"] == str(128 << 20)


def test_write_append(spark, cat):
    from slotbook.operators.writes import write_append
    out = scratch_path(spark, "append")
    write_append(cat.live_booking, out)
    write_append(cat.live_booking.limit(3), out)
    assert spark.read.parquet(out).count() == cat.live_booking.count() + 3


def test_schema_drift_is_reported(spark):
    import pytest
    from slotbook.sources.tables import read_table
    bad_dir = scratch_path(spark, "drift")
    spark.createDataFrame([(1, "x", 3)], "n_nationkey bigint, n_name string, n_regionkey int") \
        .write.parquet(f"{bad_dir}/nation.parquet")
    with pytest.raises(ValueError, match="n_nationkey"):
        read_table(spark, bad_dir, "nation", check=True)
    assert read_table(spark, SMOKE_DIR, "nation", check=True).count() == 25


def test_bench_prints_one_json_line():
    import json
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR=SMOKE_DIR, BENCH_RUNS="1", BENCH_CPUS="2",
               BENCH_KEYS="list_cities,profit_by_day")
    out = subprocess.run([sys.executable, os.path.join(root, "bench.py")], env=env, cwd=root,
                         capture_output=True, text=True, timeout=600)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1, out.stdout + out.stderr[-2000:]
    d = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(d)
    assert d["unit"] == "sec" and set(d["queries"]) == {"list_cities", "profit_by_day"}
