"""Boundary cases of the rule-checked jobs, the gate and the helpers, on tiny frames."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from slotbook import constants as C
from slotbook.functions import validate as V
from slotbook.functions.naming import camel_columns, camel_name
from slotbook.functions.paging import page
from slotbook.operators.writes import append_rows, apply_updates
from slotbook.plans import access as A
from slotbook.plans import admission as M
from slotbook.plans import places as P
from slotbook.plans import reports as R

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)
U4 = "3f2b6c1e-8d4a-4b7e-9c1d-2a3b4c5d6e7f"   # a version-4 uuid


def ts(**kw):
    return T0 + dt.timedelta(**kw)


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def codes(d, key="id"):
    return {r[key]: r["reason_code"] for r in d.collect()}


# --- M01 ---------------------------------------------------------------------------
PKG = "id bigint, capacity int"
LIVE = "id bigint, member_user_id bigint, package_id bigint, order_status string, created_at timestamp_ntz"
REQ = "id bigint, member_user_id bigint, package_id bigint, requested_at timestamp_ntz"


def test_booking_two_hours_old_is_expired(spark):
    live = df(spark, [(1, 7, 100, "PENDING", T0), (2, 8, 100, "PENDING", ts(minutes=1))], LIVE)
    req = df(spark, [(10, 7, 100, ts(hours=2)),                      # exactly 2 h: expired
                     (11, 8, 100, ts(hours=2)),                      # 1h59m old: ongoing
                     (12, 9, 100, ts(hours=2))], REQ)                # no booking at all
    got = codes(M.admit_bookings(req, df(spark, [(100, 10)], PKG), live))
    assert got == {10: C.OK, 11: C.BOOKING_CREATE_ONGOING_EXISTS, 12: C.OK}


def test_booking_capacity_equal_vs_above(spark):
    live = df(spark, [(i, 50 + i, 100 if i < 2 else 200, "PENDING", T0) for i in range(5)], LIVE)
    pkg = df(spark, [(100, 2), (200, 2)], PKG)  # package 100: 2 pending (=cap); 200: 3 (>cap)
    req = df(spark, [(10, 1, 100, ts(hours=5)), (11, 2, 200, ts(hours=5))], REQ)
    assert codes(M.admit_bookings(req, pkg, live)) == {10: C.BOOKING_CREATE_PACKAGE_FULL, 11: C.OK}
    assert codes(M.admit_bookings(req, pkg, live, strict_capacity=True)) == {
        10: C.BOOKING_CREATE_PACKAGE_FULL, 11: C.BOOKING_CREATE_PACKAGE_FULL}


def test_booking_state_after_request_is_not_seen(spark):
    live = df(spark, [(1, 7, 100, "PENDING", ts(minutes=5))], LIVE)
    req = df(spark, [(10, 7, 100, T0)], REQ)
    assert codes(M.admit_bookings(req, df(spark, [(100, 1)], PKG), live)) == {10: C.OK}


def test_booking_uuid_ids(spark):
    live = df(spark, [], "id string, member_user_id string, package_id string, order_status string, "
                         "created_at timestamp_ntz")
    pkg = df(spark, [(U4, 3)], "id string, capacity int")
    req = df(spark, [("a", "m", U4, T0), ("b", "m2", "not-a-uuid", T0), ("c", "m3", None, T0)],
             "id string, member_user_id string, package_id string, requested_at timestamp_ntz")
    got = codes(M.admit_bookings(req, pkg, live, id_kind="uuid4"))
    assert got == {"a": C.OK, "b": C.BOOKING_CREATE_FIELDS, "c": C.BOOKING_CREATE_FIELDS}


# --- access gate ---------------------------------------------------------------------
BANS = ("id bigint, member_user_id bigint, approval_status string, ban_lifted_at timestamp_ntz, "
        "created_at timestamp_ntz")
ATT = "id bigint, user_id bigint, required_role string, attempted_at timestamp_ntz"


def test_ban_lifted_exactly_now_is_not_banned(spark):
    bans = df(spark, [(1, 7, "BANNED", ts(hours=1), T0), (2, 8, "BANNED", ts(hours=2), T0)], BANS)
    att = df(spark, [(10, 7, "MEMBER", ts(hours=1)), (11, 8, "MEMBER", ts(hours=1))], ATT)
    assert codes(A.ban_gate(att, bans)) == {10: C.OK, 11: C.ACCESS_BANNED}


def test_latest_ban_wins_and_same_instant_counts(spark):
    bans = df(spark, [(1, 7, "BANNED", ts(days=9), T0),               # old ban, long lift
                      (2, 7, "BANNED", ts(hours=1), ts(minutes=30)),  # latest ban, short lift
                      (3, 9, "BANNED", ts(days=1), ts(hours=3)),      # created at attempt time
                      (4, 9, "REVOKED", ts(days=9), ts(hours=2))], BANS)
    att = df(spark, [(10, 7, "MEMBER", ts(hours=2)), (11, 9, "MEMBER", ts(hours=3))], ATT)
    assert codes(A.ban_gate(att, bans)) == {10: C.OK, 11: C.ACCESS_BANNED}


def test_role_gate_order(spark):
    users = df(spark, [(7, "ADMIN"), (8, "MEMBER")], "id bigint, role string")
    bans = df(spark, [(1, 7, "BANNED", ts(days=1), T0)], BANS)
    att = df(spark, [(10, 7, "MEMBER", ts(hours=1)),    # banned beats wrong role
                     (11, 8, "ADMIN", ts(hours=1)),     # wrong role
                     (12, 8, "MEMBER", ts(hours=1)),    # fine
                     (13, 99, "MEMBER", ts(hours=1))],  # unknown user
             ATT)
    assert codes(A.role_gate(att, users, bans)) == {
        10: C.ACCESS_BANNED, 11: C.ACCESS_UNAUTHORIZED, 12: C.OK, 13: C.ACCESS_UNAUTHORIZED}


def test_endpoint_table_is_complete(spark):
    routes = {r["operation"]: r["allowed_roles"] for r in A.endpoint_roles(spark).collect()}
    assert routes["booking.profit"] == [C.ROLE_OWNER]
    assert len(routes) == len(C.ENDPOINT_ROLES)


# --- places --------------------------------------------------------------------------
PLACE = "id bigint, name string, max_capacity int, address string, owner_user_id bigint, city_id int"


def test_occupancy_zero_without_packages_or_pending(spark):
    place = df(spark, [(1, "A", 10, "x", 1, 1), (2, "B", 10, "y", 1, 12), (3, "C", 10, "z", 1, 21)],
               PLACE)
    package = df(spark, [(20, 5, 2), (30, 4, 3)], "id bigint, capacity int, place_id bigint")
    booking = df(spark, [(1, 20, "COMPLETED"), (2, 30, "PENDING"), (3, 30, None)],
                 "id bigint, package_id bigint, order_status string")
    city = df(spark, [(1, "c1"), (12, "c12"), (21, "c21")], "id int, name string")
    got = {r["id"]: r["current_capacity"]
           for r in P.places_member_view(place, package, booking, city).collect()}
    assert got == {1: 0, 2: 0, 3: 4}
    got = {r["id"] for r in P.places_member_view(place, package, booking, city, ["1%"]).collect()}
    assert got == {1, 2}
    got = {r["id"] for r in P.places_member_view(place, package, booking, city, ["_1"]).collect()}
    assert got == {3}
    with pytest.raises(ValueError):
        P.city_filter(F.col("city_id"), [])


def test_member_without_bookings_keeps_one_row(spark):
    users = df(spark, [(1, "u1", "e1", "MEMBER", "ACTIVE", T0), (2, "u2", "e2", "MEMBER", "ACTIVE", None)],
               "id bigint, username string, email string, role string, ban_status string, "
               "created_at timestamp_ntz")
    booking = df(spark, [(1, 1, "EXPIRED"), (2, 1, "COMPLETED"), (3, 1, "COMPLETED")],
                 "id bigint, member_user_id bigint, order_status string")
    roll = {r["member_user_id"]: (r["expired_order_count"], r["completed_order_count"])
            for r in R.member_order_rollup(users, booking).collect()}
    assert roll == {1: (1, 2), 2: (0, 0)}
    faithful = sorted((r["member_user_id"], r["expired_order_count"], r["completed_order_count"])
                      for r in R.member_order_counts(users, booking).collect())
    assert faithful == [(1, 0, 2), (1, 1, 0), (2, 0, 0)]
    first = R.member_order_counts(users, booking, page=1, limit=1).collect()
    assert first[0]["member_user_id"] == 2   # null created_at sorts first on DESC


# --- helpers -------------------------------------------------------------------------
def test_paging(spark):
    d = spark.range(0, 40).withColumnRenamed("id", "k")
    assert [r.k for r in page(d, ["k"], 2, 15).collect()] == list(range(15, 30))
    assert page(d, ["k"], 4, 15).count() == 0
    assert page(d, ["k"], None).count() == 40


def test_camel_columns(spark):
    assert camel_name("member_user_id") == "memberUserId"
    assert camel_name("Name") == "Name"
    assert camel_name("AB_cd-ef") == "abCdEf"
    d = spark.createDataFrame([(1, 2)], "member_id int, memberId int")
    with pytest.raises(ValueError):
        camel_columns(d)
    assert camel_columns(d.select("member_id")).columns == ["memberId"]


def test_validation_rules(spark):
    d = spark.createDataFrame(
        [("Abcdef1!", "a@b.co", U4, "Ann Lee", "x9", "12"),
         ("abcdefg1", "bad", "3f2b6c1e-8d4a-1b7e-9c1d-2a3b4c5d6e7f", "Ann3", "x 9", "1.5"),
         (None, None, None, None, None, "a1")],
        "pw string, email string, id string, name string, user string, num string")
    got = d.select(V.passes(V.strong_password(F.col("pw"))).alias("pw"),
                   V.passes(V.email(F.col("email"))).alias("em"),
                   V.passes(V.valid_id(F.col("id"), "uuid4")).alias("id"),
                   V.passes(V.alpha_spaces(F.col("name"))).alias("nm"),
                   V.passes(V.alphanumeric(F.col("user"))).alias("us"),
                   V.passes(V.numeric(F.col("num"))).alias("nu")).collect()
    assert [tuple(r) for r in got] == [(True, True, True, True, True, True),
                                       (False, False, False, False, False, False),
                                       (False, False, False, False, False, False)]
    errs = d.select(V.collect_errors([("m1", F.col("pw").isNotNull()), ("m2", F.lit(False)),
                                      ("m1", F.lit(False))]).alias("e")).collect()
    assert [r.e for r in errs] == [["m2", "m1"], ["m2", "m1"], ["m1", "m2"]]


def test_apply_updates_policies(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, s string, n int")
    u = spark.createDataFrame([(1, None, T0), (1, "z", ts(hours=1)), (3, "q", T0)],
                              "id int, s string, at timestamp_ntz")
    got = {r.id: (r.s, r.n) for r in apply_updates(t, u, ["id"], ["s"], "at", "last").collect()}
    assert got == {1: ("z", 10), 2: ("b", 20)}
    got = {r.id: r.s for r in apply_updates(t, u, ["id"], ["s"], "at", "first").collect()}
    assert got == {1: None, 2: "b"}
    with pytest.raises(PySparkException):
        apply_updates(t, u, ["id"], ["s"], policy="error").collect()


def test_append_rows_fills_defaults(spark):
    t = spark.createDataFrame([(1, "PENDING", T0)], "id bigint, status string, at timestamp_ntz")
    new = spark.createDataFrame([(5,)], "rid int")
    out = append_rows(t, new.withColumnRenamed("rid", "req"),
                      defaults={"status": F.lit("PENDING"), "at": F.lit(T0)},
                      id_col="id", id_expr=F.col("req") * 10)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "PENDING", T0), (50, "PENDING", T0)]


# --- malformed ids and codes the fixture cannot reach ---------------------------------
def test_malformed_id_codes(spark):
    booking = df(spark, [(U4, "m", "p", None, T0)],
                 "id string, member_user_id string, package_id string, updated_at timestamp_ntz, "
                 "created_at timestamp_ntz")
    ids = df(spark, [("nope",), (U4,)], "booking_id string")
    package = df(spark, [("p", "pk", 5, 10, "pl", "t")],
                 "id string, name string, price int, capacity int, place_id string, package_type_id string")
    ptype = df(spark, [("t", "type")], "id string, name string")
    users = df(spark, [("m", "u", "MALE", "e")], "id string, username string, gender string, email string")
    got = codes(R.booking_detail(ids, booking, package, ptype, users, id_kind="uuid"), "booking_id")
    assert got == {"nope": C.BOOKING_DETAIL_BAD_ID, U4: C.OK}

    place = df(spark, [("pl", 10)], "id string, max_capacity int")
    admins = df(spark, [("a1", "pl")], "admin_user_id string, place_id string")
    tr = df(spark, [("bad", "COMPLETED", "a1", T0), (U4, "COMPLETED", "a1", T0)],
            "booking_id string, new_status string, admin_user_id string, requested_at timestamp_ntz")
    got = codes(M.transition_bookings(tr, booking, package, place, admins, id_kind="uuid"),
                "booking_id")
    assert got == {"bad": C.BOOKING_UPDATE_BAD_ID, U4: C.OK}

    preq = df(spark, [(1, "bad", "Nice", 1, 2, U4, "a1")],
              "id int, place_id string, name string, capacity int, price int, "
              "package_type_id string, admin_user_id string")
    got = codes(M.admit_packages(preq, place, admins, package, ptype, id_kind="uuid4"))
    assert got == {1: C.PACKAGE_CREATE_BAD_PLACE_ID}


def test_place_update_and_admin_field_codes(spark):
    place = df(spark, [(1, "Old", 10, "x"), (2, "Other", 10, "y")],
               "id bigint, name string, max_capacity int, address string")
    upd = df(spark, [(1, "New 1", 20, "x"),        # digits in name -> 1011
                     (1, "New", 20, ""),           # empty address -> 1011
                     (None, "New", 20, "x"),       # no id -> 1044
                     (1, "Other", 20, "y"),        # conflicts with place 2 -> 1015
                     (2, "Other", 20, "y")],       # same place -> ok
             "id bigint, name string, max_capacity int, address string")
    got = [r.reason_code for r in M.update_places(upd, place).collect()]
    assert sorted(got) == sorted([C.PLACE_UPDATE_FIELDS, C.PLACE_UPDATE_FIELDS,
                                  C.PLACE_UPDATE_BAD_ID, C.PLACE_UPDATE_CONFLICT, C.OK])

    entries = df(spark, [(5, None, f"Ann {chr(97 + i)}", f"u{i}", True) for i in range(11)]
                 + [(6, 1, "Bo", "b", None), (None, 2, "Cy", "c", True)],
                 "place_id bigint, admin_user_id bigint, fullname string, username string, "
                 "is_active boolean")
    pa = df(spark, [(1, 6)], "admin_user_id bigint, place_id bigint")
    got = {(r.place_id, r.reason_code) for r in M.upsert_place_admins(entries, pa).collect()}
    assert got == {(5, C.PLACE_ADMINS_FIELDS), (6, C.PLACE_ADMINS_INVALID_ENTRY),
                   (None, C.PLACE_ADMINS_BAD_ID)}


def test_signup_drops_password_and_dedups(spark):
    users = df(spark, [(1, "taken", "t@x.io")], "id bigint, username string, email string")
    req = df(spark, [(5, "Ann Lee", "MALE", "fresh", "f@x.io", "Secret1!"),
                     (6, "Bo Ray", "MALE", "fresh", "g@x.io", "Secret1!"),
                     (7, "Cy Poe", "FEMALE", "taken", "h@x.io", "Secret1!"),
                     (8, "Di", "FEMALE", "dee", "d@x.io", "weak")],
             "id bigint, fullname string, gender string, username string, email string, password string")
    out = M.import_members(req, users)
    assert "password" not in out.columns
    assert codes(out) == {5: C.OK, 6: C.SIGNUP_DUPLICATE, 7: C.SIGNUP_DUPLICATE, 8: C.SIGNUP_FIELDS}


def test_decisions_first_in_batch_wins(spark):
    bans = df(spark, [(1, 7, "PENDING", None, T0)],
              "id bigint, member_user_id bigint, approval_status string, updated_at timestamp_ntz, "
              "created_at timestamp_ntz")
    dec = df(spark, [(1, "BANNED", 9, ts(hours=1)), (1, "REVOKED", 9, ts(hours=2))],
             "ban_request_id bigint, decision string, owner_user_id bigint, decided_at timestamp_ntz")
    got = {r.decision: (r.reason_code, r.ban_lifted_at)
           for r in M.decide_ban_requests(dec, bans).collect()}
    assert got == {"BANNED": (C.OK, ts(days=3, hours=1)), "REVOKED": (C.BAN_DECISION_PROCESSED, None)}


def test_row_order_independence(spark, cat):
    a = M.admit_bookings(cat.booking_request, cat.package, cat.live_booking)
    b = M.admit_bookings(cat.booking_request.repartition(7).orderBy(F.rand(3)), cat.package,
                         cat.live_booking.repartition(3).orderBy(F.rand(5)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_keyset_paging_equals_offset_paging(spark, cat):
    from slotbook.functions.paging import page_after
    log = R.booking_log(cat.booking, cat.package, cat.package_type, cat.place_admin, cat.users)
    order = [("created_at", True), ("booking_id", False), ("admin_user_id", False)]
    by_offset = [F.col("created_at").desc(), "booking_id", "admin_user_id"]
    cursor = None
    for n in range(1, 5):
        want = [tuple(r) for r in page(log, by_offset, n, 15).collect()]
        got = page_after(log, order, cursor, 15).collect()
        assert [tuple(r) for r in got] == want
        last = got[-1]
        cursor = (last["created_at"], last["booking_id"], last["admin_user_id"])


def test_apply_place_admins_versions(spark, cat):
    d = M.upsert_place_admins(cat.admin_entry, cat.place_admin)
    out = M.apply_place_admins(d, cat.users, cat.place_admin)
    acc = d.filter("reason_code = '0000'")
    n_new = acc.filter("action = 'CREATE'").count()
    assert out["users"].count() == cat.users.count() + n_new
    assert out["place_admin"].count() == cat.place_admin.count() + n_new
    upd = {r.admin_user_id: r.username for r in acc.filter("action = 'UPDATE'").collect()}
    got = {int(r.id): r.username for r in out["users"].filter(F.col("id").isin(
        [str(k) for k in upd])).collect()}
    assert got == upd
    assert "password" not in out["users"].columns


def test_ban_request_pending_only_until_decided(spark):
    users = df(spark, [(7, "MEMBER")], "id bigint, role string")
    bans = df(spark, [(1, 7, "BANNED", ts(hours=2), T0)],     # pending from T0 to T0+2h
              "id bigint, member_user_id bigint, approval_status string, updated_at timestamp_ntz, "
              "created_at timestamp_ntz")
    req = df(spark, [(10, 7, "late show", 1, ts(hours=1)),    # while pending -> 1027
                     (11, 7, "late show", 1, ts(hours=2)),    # decided at that instant -> ok
                     (12, 7, "late show", 1, ts(hours=-1))],  # before it was filed -> ok
             "id bigint, member_user_id bigint, ban_reason string, admin_user_id bigint, "
             "requested_at timestamp_ntz")
    assert codes(M.admit_ban_requests(req, users, bans)) == {
        10: C.BAN_REQUEST_EXISTS, 11: C.OK, 12: C.OK}


def test_asof_weighted_sum(spark):
    from slotbook.operators.asof import asof_count
    events = df(spark, [(1, T0, 1), (1, ts(hours=1), 1), (1, ts(hours=2), -1), (1, ts(days=3), -1)],
                "k bigint, at timestamp_ntz, w int")
    probe = df(spark, [(i, 1, ts(hours=h)) for i, h in enumerate([-1, 0, 1.5, 2, 80])],
               "id int, k bigint, t timestamp_ntz")
    got = {r.id: r.open for r in asof_count(probe, events, ["k"], "t", "at", name="open",
                                             weight="w").collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 1, 4: 0}


def test_place_detail_options(spark, cat):
    ids = cat.place.select(F.col("id").alias("place_id"))
    flat = P.place_detail_owner(cat.place, cat.place_admin, cat.users, ids)
    nested = P.place_detail_owner(cat.place, cat.place_admin, cat.users, ids, nested=True)
    assert nested.count() == ids.count()
    rows = {r.place_id: r for r in nested.collect()}
    for r in flat.filter("reason_code = '0000'").collect():
        assert r.admin_id in [a.admin_id for a in rows[r.place_id].admins]
    for r in rows.values():
        if r.admins:
            assert [a.admin_id for a in r.admins] == sorted(a.admin_id for a in r.admins)
        else:
            assert r.reason_code == "1012"
    strict = P.place_detail_member(cat.place, cat.package, cat.booking, cat.city, ids)
    loose = P.place_detail_member(cat.place, cat.package, cat.booking, cat.city, ids,
                                  keep_empty=True)
    assert (loose.filter("reason_code = '1012'").count()
            <= strict.filter("reason_code = '1012'").count())


def test_listing_page_first(spark, cat):
    full = P.places_owner_view(cat.place, cat.place_admin)
    first = P.places_owner_view(cat.place, cat.place_admin, page=1, limit=4, page_first=True)
    # page the place table by id first, then drop places without admins
    ids = [r.id for r in cat.place.orderBy("id").limit(4).collect()]
    assert {r.id for r in first.collect()} == {r.id for r in full.collect() if r.id in ids}


def test_caller_scopes(spark, cat):
    owner = 2000001
    mine = {r.id for r in cat.place.filter(F.col("owner_user_id") == owner).collect()}
    listed = {r.id for r in P.places_owner_view(cat.place, cat.place_admin, owner_id=owner).collect()}
    assert listed and listed <= mine
    total = sum(r.profit for r in R.profit_by_day(cat.booking, cat.package).collect())
    parts = sum(sum(r.profit for r in R.profit_by_day(cat.booking, cat.package, place=cat.place,
                                                      owner_id=o).collect())
                for o in (2000000, 2000001, 2000002))
    assert parts == total
    admin = cat.place_admin.first()
    ids = cat.place.select(F.col("id").alias("place_id"))
    got = P.place_detail_owner(cat.place, cat.place_admin, cat.users, ids,
                               admin_id=admin.admin_user_id).filter("reason_code = '0000'")
    assert {r.place_id for r in got.collect()} == {admin.place_id}
    ids = cat.booking.select(F.col("id").alias("booking_id"))
    d = R.booking_detail(ids, cat.booking, cat.package, cat.package_type, cat.users,
                         admin_id=admin.admin_user_id, place_admin=cat.place_admin)
    found = {r.booking_id for r in d.filter("reason_code = '0000'").collect()}
    log = {r.booking_id for r in R.booking_log(cat.booking, cat.package, cat.package_type,
                                               cat.place_admin, cat.users,
                                               admin_id=admin.admin_user_id).collect()}
    assert found == log


def test_materialized_catalog_same_results_and_pruning(spark, cat):
    from slotbook.session import scratch_path
    stored = cat.materialize(scratch_path(spark, "stored"))
    a = R.profit_by_day(cat.booking, cat.package)
    b = R.profit_by_day(stored.booking.drop("created_day"), stored.package)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    day = stored.booking.filter(F.col("created_day") == F.lit("1995-03-01").cast("date"))
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_day" in plan
    assert stored.live_booking.count() == cat.live_booking.count()   # falls through
    pending = stored.booking.filter(F.col("order_status") == "PENDING")
    plan = pending._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(order_status,PENDING)" in plan                     # stored column: pushed down


def test_nested_admin_requests_equal_flat(spark, cat):
    flat = M.upsert_place_admins(cat.admin_entry, cat.place_admin)
    nested_req = (cat.admin_entry.groupBy("place_id")
                  .agg(F.collect_list(F.struct("admin_user_id", "fullname", "username",
                                               "is_active")).alias("admins")))
    nested = M.upsert_place_admins_nested(nested_req, cat.place_admin)
    assert (sorted(map(tuple, nested.collect()), key=repr)
            == sorted(map(tuple, flat.select(*nested.columns).collect()), key=repr))
    too_many = spark.createDataFrame(
        [(5, [(None, f"Ann {chr(97 + i)}", f"u{i}", True) for i in range(11)]), (6, [])],
        "place_id bigint, admins array<struct<admin_user_id:bigint,fullname:string,"
        "username:string,is_active:boolean>>")
    got = {(r.place_id, r.reason_code) for r in
           M.upsert_place_admins_nested(too_many, cat.place_admin).collect()}
    assert got == {(5, C.PLACE_ADMINS_FIELDS), (6, C.PLACE_ADMINS_FIELDS)}


def test_bucketed_tables_join_without_shuffle(spark, cat):
    from slotbook.session import scratch_path
    stored = cat.materialize(scratch_path(spark, "bucketed"), names=("booking", "package"),
                             buckets=4)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        j = stored.booking.join(stored.package.withColumnRenamed("id", "package_id"), "package_id")
        n = j.count()
        plan = j._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert n == cat.booking.join(cat.package.withColumnRenamed("id", "package_id"),
                                 "package_id").count()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    a = R.profit_by_day(cat.booking, cat.package)
    b = R.profit_by_day(stored.booking, stored.package)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_strict_modes_for_batch_conflicts(spark, cat):
    # Two valid requests for one member in a batch
    users = df(spark, [(7, "MEMBER")], "id bigint, role string")
    bans = df(spark, [], "id bigint, member_user_id bigint, approval_status string, "
                         "updated_at timestamp_ntz, created_at timestamp_ntz")
    req = df(spark, [(10, 7, "late show", 1, ts(hours=1)), (11, 7, "late show", 1, ts(hours=2))],
             "id bigint, member_user_id bigint, ban_reason string, admin_user_id bigint, "
             "requested_at timestamp_ntz")
    assert codes(M.admit_ban_requests(req, users, bans)) == {10: C.OK, 11: C.OK}
    assert codes(M.admit_ban_requests(req, users, bans, mode="strict")) == {
        10: C.OK, 11: C.BAN_REQUEST_EXISTS}
    # Two requests for the same new place
    city = df(spark, [(1, "c")], "id int, name string")
    place = df(spark, [], "id bigint, name string, address string, city_id int")
    preq = df(spark, [(1, "Nice Place", "Road 1", 100, 1, "Ann;Bo", 9),
                      (2, "Nice Place", "Road 1", 100, 1, "Cy", 9)],
              "id bigint, name string, address string, max_capacity int, city_id int, "
              "admin_names string, owner_user_id bigint")
    got = codes(M.admit_places(preq, city, place, mode="strict")["decisions"])
    assert got == {1: C.OK, 2: C.PLACE_CREATE_EXISTS}
    assert codes(M.admit_places(preq, city, place)["decisions"]) == {1: C.OK, 2: C.OK}
    # Two places renamed to the same name and address
    place = df(spark, [(1, "A", 10, "x"), (2, "B", 10, "y")],
               "id bigint, name string, max_capacity int, address string")
    upd = df(spark, [(1, "Same", 20, "z"), (2, "Same", 20, "z")],
             "id bigint, name string, max_capacity int, address string")
    assert codes(M.update_places(upd, place, mode="strict")) == {1: C.OK, 2: C.PLACE_UPDATE_CONFLICT}
    assert codes(M.update_places(upd, place)) == {1: C.OK, 2: C.OK}


def test_first_in_batch_with_null_order_values(spark):
    d = df(spark, [(1, None, 5), (1, None, 7), (2, 3, 1)], "k int, a int, b int")
    got = {(r.k, r.b): r.is_first for r in
           M.first_in_batch(d, ["k"], ["a", "b"], F.lit(True)).collect()}
    assert got == {(1, 5): True, (1, 7): False, (2, 1): True}


def test_packages_strict_takes_requests_one_after_another(spark):
    """Against a plain loop per place; one place holds most requests."""
    rng = random.Random(7)
    place = df(spark, [(p, 40 + 7 * p) for p in range(6)], "id bigint, max_capacity int")
    admins = df(spark, [("a", p) for p in range(6)], "admin_user_id string, place_id bigint")
    package = df(spark, [(0, 10), (1, 46), (2, 60)], "place_id bigint, capacity int")
    ptype = df(spark, [("t",)], "id string")
    rows = []
    for i in range(600):
        p = rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 9])
        rows.append((i, p, "Nice", rng.choice(["1", "2", "7", "13", "30", "0", "-4", "1.5", "900", "", None]), "5",
                     rng.choice(["t", "t", "t", "?"]), "a"))
    req = df(spark, rows, "id int, place_id bigint, name string, capacity string, price string, "
                          "package_type_id string, admin_user_id string")
    snap = codes(M.admit_packages(req, place, admins, package, ptype))
    got = codes(M.admit_packages(req, place, admins, package, ptype, mode="strict"))
    room = {p: 40 + 7 * p for p in range(6)}
    for p, c in ((0, 10), (1, 46), (2, 60)):
        room[p] -= c
    want = {}
    for i, p, _, cap, *_ in rows:
        want[i] = snap[i]
        if snap[i] == C.OK and int(cap) > 0:
            if int(cap) <= room[p]:
                room[p] -= int(cap)
            else:
                want[i] = C.PACKAGE_CREATE_OVER_CAPACITY
    assert got == want
    assert sum(got[i] != snap[i] for i in got) > 50
    empty = M.admit_packages(req.limit(0), place, admins, package, ptype, mode="strict")
    assert empty.count() == 0


def test_place_detail_malformed_id(spark):
    place = df(spark, [(U4, "A", 10, "x", 1)], "id string, name string, max_capacity int, address string, city_id int")
    pa = df(spark, [(1, U4)], "admin_user_id bigint, place_id string")
    users = df(spark, [(1, "Ann", "ann", True, None)],
               "id bigint, fullname string, username string, is_active boolean, created_at timestamp_ntz")
    asked = df(spark, [(U4,), ("no uuid",), (None,)], "place_id string")
    got = {r.place_id: r.reason_code for r in
           P.place_detail_owner(place, pa, users, asked, id_kind="uuid").collect()}
    assert got == {U4: C.OK, "no uuid": C.PLACE_DETAIL_BAD_ID, None: C.PLACE_DETAIL_BAD_ID}


def test_place_admin_entries_per_request_have_ids_of_their_own(spark):
    entries = df(spark, [(r, i, 5, None, "Ann", "ann", True) for r in (1, 2) for i in range(6)] + [(3, 0, 5, None, "Ann", "", True)],
                 "request_id int, position int, place_id bigint, admin_user_id bigint, fullname string, "
                 "username string, is_active boolean")
    pa = df(spark, [(1, 6)], "admin_user_id bigint, place_id bigint")
    got = M.upsert_place_admins(entries, pa).collect()
    assert [r.reason_code for r in sorted(got, key=lambda r: r.request_id)] == [C.OK] * 12 + [C.PLACE_ADMINS_INVALID_ENTRY]
    assert len({r.new_user_id for r in got if r.reason_code == C.OK}) == 12
