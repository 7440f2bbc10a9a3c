"""Equal requests, refused sign-ups, number and id formats."""

import pytest
from pyspark.sql import functions as F

from slotbook.functions import validate as V
from slotbook.plans import admission as M
from slotbook.session import ensure_checkpoint_dir


def test_equal_requests_have_one_first(spark):
    df = spark.createDataFrame([(1, 5, 10), (2, 5, 10), (3, 5, 11), (4, 6, 9)], "request_id long, k long, t long")
    got = M.first_in_batch(df, ["k"], ["t"], F.lit(True)).filter("is_first")
    assert sorted(r.request_id for r in got.collect()) == [1, 4]


def test_refused_sign_up_takes_no_name(spark):
    users = spark.createDataFrame([("old", "old@x.org")], "username string, email string")
    rows = [(1, "Ann A", "MALE", "ann1", "old@x.org"), (2, "Ann B", "MALE", "ann1", "new@x.org"),
            (3, "Ann C", "MALE", "ann1", "third@x.org")]
    req = spark.createDataFrame(rows, "id long, fullname string, gender string, username string, email string")
    codes = {r.id: r.reason_code for r in M.import_members(req, users).collect()}
    assert codes == {1: "1002", 2: "0000", 3: "1002"}


def test_strict_admission_orders_requests_of_one_instant(spark):
    req = spark.sql("""SELECT id, member_user_id, package_id, timestamp_ntz'2024-01-05 10:00:00' AS requested_at
        FROM VALUES (1L, 11L, 1L), (2L, 12L, 1L), (3L, 13L, 1L), (4L, 14L, 2L), (5L, 14L, 3L)
        AS t(id, member_user_id, package_id)""")
    package = spark.createDataFrame([(1, 1), (2, 9), (3, 9)], "id long, capacity int")
    state = spark.createDataFrame([], "id long, member_user_id long, package_id long, order_status string, created_at timestamp_ntz")
    codes = {r.id: r.reason_code for r in M.admit_bookings(req, package, state, mode="strict").collect()}
    assert codes == {1: "0000", 2: "1021", 3: "1021", 4: "0000", 5: "1022"}


@pytest.mark.parametrize("value, ok", [("12", True), ("-3", True), ("1.5", False), (".5", False), ("", False)])
def test_numbers_are_integers(spark, value, ok):
    assert spark.range(1).select(V.numeric(F.lit(value)).alias("x")).first().x is ok


@pytest.mark.parametrize("value, ok", [
    ("6f9619ff-8b86-4011-b42d-00c04fc964ff", True), ("6f9619ff-8b86-1011-b42d-00c04fc964ff", True),
    ("6f9619ff-8b86-9011-b42d-00c04fc964ff", False), ("6f9619ff-8b86-4011-c42d-00c04fc964ff", False),
    ("00000000-0000-0000-0000-000000000000", True)])
def test_uuid_versions(spark, value, ok):
    assert spark.range(1).select(V.uuid_any(F.lit(value)).alias("x")).first().x is ok


def test_shared_checkpoint_folder_is_required_off_local_mode():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
