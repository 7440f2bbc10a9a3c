"""Jobs that take requests one by one, timelines, change sets and the pattern index, against
brute force on small tables with ties, hot keys, nulls, chains and nothing at all."""

import collections
import datetime as dt
import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from slotbook import constants as C
from slotbook.functions.paging import page_numbers
from slotbook.operators import changes, patterns
from slotbook.operators.prefix import running, with_position
from slotbook.operators.settle import settle
from slotbook.plans import access as A
from slotbook.plans import admission as M
from slotbook.plans import places as P
from slotbook.plans import timelines as T

T0 = dt.datetime(2024, 1, 1)


def _at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


# --- operators ------------------------------------------------------------------------------
def test_running_and_positions(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(4) if k % 3 else 0, rng.randrange(30), k, rng.choice([None, 1, 2, 3])) for k in range(300)]
    rows += [(None, 5, 1000 + k, k) for k in range(5)]
    df = spark.createDataFrame(rows, "k long, t long, id long, v long")
    got = {r.id: r for r in running(running(df, ["k"], ["t", "id"], ["v", "t"], ["total", "times"], inclusive=False),
                                    ["k"], ["t", "id"], "v", "seen", "last").collect()}
    for k, t, i, _ in rows:
        before = sorted((x for x in rows if x[0] == k and (x[1], x[2]) < (t, i)), key=lambda x: x[1:3])
        upto = [x[3] for x in sorted((x for x in rows if x[0] == k and (x[1], x[2]) <= (t, i)), key=lambda x: x[1:3]) if x[3] is not None]
        assert got[i].total == sum(x[3] or 0 for x in before) and got[i].times == sum(x[1] for x in before)
        assert got[i].seen == (upto[-1] if upto else None)
    want = {x[2]: n for n, x in enumerate(sorted(rows, key=lambda x: x[1:3]))}
    assert {r.id: r.position for r in with_position(df, ["t", "id"]).collect()} == want
    pages = {r.id: (r.page, r.line) for r in page_numbers(df, ["t", "id"], 7).collect()}
    assert pages == {i: (n // 7 + 1, n % 7 + 1) for i, n in want.items()}
    assert running(df.limit(0), ["k"], ["t"], "v", "x").count() == with_position(df.limit(0), ["t"]).count() == 0
    with pytest.raises(ValueError):
        page_numbers(df, ["id"], 0)


def _one_by_one(rows, needs=()):
    taken, accepted, out = set(), set(), {}
    for i, a, b in sorted(rows):
        values = {(k, v) for k, v in (("a", a), ("b", b)) if v is not None}
        out[i] = not values & taken and all(n in accepted for j, n in needs if j == i)
        if out[i]:
            taken |= values
            accepted.add(i)
    return out


_R = random.Random(2)


@pytest.mark.parametrize("rows, needs", [
    ([(k, k // 2, (k + 1) // 2) for k in range(400)], []),                                       # one long chain
    ([(k, _R.randrange(60), _R.randrange(60)) for k in range(300)], [(k, _R.randrange(320)) for k in range(0, 300, 4)]),
    ([(k, None, None) for k in range(300)], [(k, k - 1) for k in range(300) if k % 60] + [(50, 3), (51, 200)]),
    ([(k, 0 if k % 3 == 0 else k, k % 97) for k in range(300)], []),                              # a hot value
    ([], []),
])
def test_settle_is_one_by_one(spark, rows, needs):
    df = spark.createDataFrame(rows, "id long, a long, b long")
    pairs = spark.createDataFrame(needs, "id long, need long") if needs else None
    assert {r.id: r.accepted for r in settle(df, "id", ["a", "b"], pairs).collect()} == _one_by_one(rows, needs)


def test_change_sets(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "b", 7), (4, None, 1)], "id long, g string, x long")
    new = spark.createDataFrame([(1, "a", 5), (2, "b", None), (4, None, 2), (9, "c", 1)], "id long, g string, x long")
    diff = changes.change_set(old, new, ["id"])
    assert {tuple(r) for r in diff.collect()} == {(2, "a", None, -1), (2, "b", None, 1), (3, "b", 7, -1), (4, None, 1, -1), (4, None, 2, 1), (9, "c", 1, 1)}
    assert ({tuple(r) for r in changes.recounted(changes.counted(old, ["g"]), diff, ["g"]).collect()}
            == {tuple(r) for r in changes.counted(new, ["g"]).collect()})
    assert changes.change_set(old, old, ["id"]).isEmpty()


def _like(text, pattern):
    regex, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
            regex += re.escape(pattern[k])
        else:
            regex += {"%": ".*", "_": "."}.get(c, re.escape(c))
        k += 1
    return re.fullmatch(regex, text, re.S) is not None


def test_pattern_index(spark):
    texts = ["", "1", "12", "21", "123", "a%b", "a_b", "axb", "a\\b", "zzz", "%", "line\nbreak", "é1é"]
    wanted = ["", "1", "1%", "%1", "_", "__", "%", "%%", "_%_", "%2%", "_2_", "1_3", "a\\%b", "a\\_%", "%\\%%", "a\\\\b", "a\\\\%", "%\\\\%", "%é", "line%", "none"]
    asked = [(k, p) for k, p in enumerate(wanted)] + [(100, "1%"), (100, "%1"), (101, None), (102, "1"), (102, "1")]
    plan = patterns.like_any(spark.createDataFrame([(t,) for t in texts * 2 + [None]], "t string"), "t",
                             spark.createDataFrame(asked, "caller long, pattern string"), "caller")
    want = {(c, t) for c, p in asked if p is not None for t in texts if _like(t, p)}
    got = [tuple(r) for r in plan.collect()]
    assert set(got) == want and len(got) == len(want)
    physical = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in physical and "Cartesian" not in physical


# --- M01 ------------------------------------------------------------------------------------
def _admitted(requests, state, capacity):
    took, out = [], {}
    for i, member, package, at in sorted(requests, key=lambda r: (r[3], r[0])):
        seen = [s for s in state if s[2] <= at] + took
        if package is None:
            code = C.BOOKING_CREATE_FIELDS
        elif package not in capacity:
            code = C.BOOKING_CREATE_PACKAGE_MISSING
        elif sum(s[1] == package for s in seen) >= capacity[package]:
            code = C.BOOKING_CREATE_PACKAGE_FULL
        elif any(s[0] == member and s[2] + dt.timedelta(hours=2) > at for s in seen):
            code = C.BOOKING_CREATE_ONGOING_EXISTS
        else:
            code = C.OK
            took.append((member, package, at))
        out[i] = code
    return out


@pytest.mark.parametrize("seed, hot", [(3, False), (4, True)])
def test_admission_one_by_one(spark, seed, hot):
    rng = random.Random(seed)
    capacity = {p: rng.randrange(0, 6) for p in range(8)} | {0: 25}
    requests = [(k, 0 if hot and k % 3 == 0 else rng.randrange(9), 0 if hot and k % 3 else rng.choice([None, 99, *range(8)]), _at(rng.randrange(60) * 20))
                for k in range(150)]
    state = [(rng.randrange(9), rng.randrange(8), _at(rng.randrange(1200))) for _ in range(10)]
    r = spark.createDataFrame(requests, "id long, member_user_id long, package_id long, requested_at timestamp_ntz")
    p = spark.createDataFrame(list(capacity.items()), "id long, capacity int")
    s = spark.createDataFrame(state, "member_user_id long, package_id long, created_at timestamp_ntz").withColumn("order_status", F.lit("PENDING"))
    got = {x.id: x.reason_code for x in M.admit_bookings(r, p, s, mode="sequential").collect()}
    want = _admitted(requests, state, capacity)
    assert got == want
    assert {C.OK, C.BOOKING_CREATE_PACKAGE_FULL, C.BOOKING_CREATE_ONGOING_EXISTS} <= set(want.values())


def test_a_refused_request_blocks_nobody(spark):
    requests = [(1, 1, 1, _at(0)), (2, 2, 1, _at(1)), (3, 2, 2, _at(2)), (4, 2, 2, _at(2)), (5, 1, 2, _at(120)), (6, 3, 2, None)]
    r = spark.createDataFrame(requests, "id long, member_user_id long, package_id long, requested_at timestamp_ntz")
    p = spark.createDataFrame([(1, 1), (2, 9)], "id long, capacity int")
    s = spark.createDataFrame([], "member_user_id long, package_id long, created_at timestamp_ntz, order_status string")
    got = {x.id: x.reason_code for x in M.admit_bookings(r, p, s, mode="sequential").collect()}
    # 2 is refused for capacity and so does not stop 3; 5 comes exactly two hours after 1
    assert got == {1: "0000", 2: "1021", 3: "0000", 4: "1022", 5: "0000", 6: "0000"}


# --- M02, M03, M06, M09, M10 ------------------------------------------------------------------
def test_equal_requests_give_one_success(spark):
    booking = spark.createDataFrame([(1, 5, None)], "id long, package_id long, updated_at timestamp_ntz")
    package = spark.createDataFrame([(5, 7)], "id long, place_id long")
    place, link = spark.createDataFrame([(7,)], "id long"), spark.createDataFrame([(3, 7)], "admin_user_id long, place_id long")
    asks = spark.createDataFrame([(1, "COMPLETED", 3, _at(0))] * 4, "booking_id long, new_status string, admin_user_id long, requested_at timestamp_ntz")
    got = M.transition_bookings(asks.repartition(3), booking, package, place, link)
    assert sorted(r.reason_code for r in got.collect()) == ["0000", "1035", "1035", "1035"]
    assert "__row" not in got.columns
    bans = spark.createDataFrame([(1, 4, None)], "id long, member_user_id long, updated_at timestamp_ntz")
    say = spark.createDataFrame([(1, "BANNED", 2, _at(0))] * 3, "ban_request_id long, decision string, owner_user_id long, decided_at timestamp_ntz")
    assert sorted(r.reason_code for r in M.decide_ban_requests(say, bans).collect()) == ["0000", "1032", "1032"]


@pytest.mark.parametrize("mode", ["snapshot", "strict"])
def test_numbers_beyond_int_are_refused(spark, mode):
    asks = [(k, 7, "Deal", c, "10", 1, 3) for k, c in enumerate(["10", "99999999999", "2147483648", "2147483647", "-5", "11"])]
    r = spark.createDataFrame(asks, "id long, place_id long, name string, capacity string, price string, package_type_id long, admin_user_id long")
    place = spark.createDataFrame([(7, 10)], "id long, max_capacity int")
    link = spark.createDataFrame([(3, 7)], "admin_user_id long, place_id long")
    none = spark.createDataFrame([], "place_id long, capacity int")
    kind = spark.createDataFrame([(1,)], "id long")
    got = {x.id: x.reason_code for x in M.admit_packages(r, place, link, none, kind, mode=mode).collect()}
    assert got == {0: "0000", 1: "1036", 2: "1036", 3: "1039", 4: "0000", 5: "1039"}


def test_sign_ups_one_by_one(spark):
    rows = [(1, "aa", "a@x.org"), (2, "aa", "b@x.org"), (3, "cc", "b@x.org"), (4, "cc", "d@x.org"), (5, "ee", "d@x.org"), (6, "old", "f@x.org"), (7, "gg", "bad")]
    r = spark.createDataFrame([(i, "Jo", "MALE", u, e) for i, u, e in rows], "id long, fullname string, gender string, username string, email string")
    users = spark.createDataFrame([("old", "o@x.org")], "username string, email string")
    got = {x.id: x.reason_code for x in M.import_members(r, users).collect()}
    assert got == {1: "0000", 2: "1002", 3: "0000", 4: "1002", 5: "0000", 6: "1002", 7: "1001"}


def _moved(updates, places):
    held, out = dict(places), {}
    for i, spot in sorted(updates):
        out[i] = all(s != spot or j == i for j, s in held.items())
        if out[i]:
            held[i] = spot
    return out


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_moves_one_by_one(spark, seed):
    rng = random.Random(seed)
    places = {k: ("n", f"s{k if k % 9 else 0}") for k in range(60)}  # some share a spot
    updates = {0: ("n", "new")} | {k: places[k - 1] for k in range(1, 30)}          # a chain of 29
    updates |= {k: ("n", f"s{rng.randrange(62)}") for k in range(30, 60) if k % 7}
    place = spark.createDataFrame([(k, n, a, 10) for k, (n, a) in places.items()], "id long, name string, address string, max_capacity int")
    asks = spark.createDataFrame([(k, n, a, 10) for k, (n, a) in updates.items()], "id long, name string, address string, max_capacity int")
    got = {x.id: x.reason_code == "0000" for x in M.update_places(asks, place, mode="sequential").collect()}
    assert got == _moved(updates.items(), places)


# --- timelines ----------------------------------------------------------------------------------
def _bans(spark):
    rng = random.Random(8)
    rows = []
    for k in range(120):
        made = rng.randrange(400)
        kind = rng.choice([C.BAN_APPROVAL_PENDING, C.BAN_APPROVAL_BANNED, C.BAN_APPROVAL_REVOKED])
        done = None if kind == C.BAN_APPROVAL_PENDING else made + rng.randrange(30)
        lift = None if kind != C.BAN_APPROVAL_BANNED or k % 10 == 0 else done + rng.choice([0, 5, 60])
        rows.append((k, 0 if k % 3 == 0 else rng.randrange(6), kind, *[None if x is None else _at(x) for x in (made, done, lift)]))
    return rows, spark.createDataFrame(rows, "id long, member_user_id long, approval_status string, created_at timestamp_ntz, updated_at timestamp_ntz, ban_lifted_at timestamp_ntz")


def test_ban_history_is_a04_at_any_time(spark):
    rows, bans = _bans(spark)
    history = T.ban_status_history(bans).cache()
    spans = collections.defaultdict(list)
    for r in history.collect():
        spans[r.member_user_id].append(r)
    for own in spans.values():
        own.sort(key=lambda r: r.valid_from)
        assert all(a.valid_to == b.valid_from and a.ban_status != b.ban_status for a, b in zip(own, own[1:])) and own[-1].valid_to is None
    for t in (_at(0), _at(77), _at(200), _at(333), _at(1000)):
        last = {}  # the stored status by then: that of the last event
        for i, m, kind, made, done, _ in rows:
            for at, n, status in ((made, 0, "PENDING"), (done, 1, "BANNED" if kind == "BANNED" else "ACTIVE")):
                if at is not None and at <= t:
                    last[m] = max(last.get(m, (T0, -1, 0, "")), (at, i, n, status))
        users = spark.createDataFrame([(m, "MEMBER", x[3]) for m, x in last.items()], "id long, role string, ban_status string")
        want = {r.id: r.effective_ban_status for r in A.effective_ban_status(users, bans, t).collect()}
        assert {r.member_user_id: r.ban_status for r in T.ban_status_at(history, t).collect()} == want
    assert T.ban_status_history(bans.limit(0)).count() == 0


def test_peaks(spark):
    rng = random.Random(9)
    rows = [(0 if k % 3 == 0 else rng.randrange(4), _at(a := rng.randrange(50)), None if k % 7 == 0 else _at(a + rng.randrange(-1, 20))) for k in range(200)]
    df = spark.createDataFrame(rows, "p long, created_at timestamp_ntz, updated_at timestamp_ntz")
    for lapse in (None, "INTERVAL 5 MINUTES"):
        best = {}
        for p, t, _ in rows:
            n = 0
            for q, made, done in rows:
                end = done
                if lapse:
                    end = min(done or made + dt.timedelta(minutes=5), made + dt.timedelta(minutes=5))
                n += q == p and made <= t and (end is None or (end > made and end > t))
            if n and (n, t) and (p not in best or n > best[p][0] or n == best[p][0] and t < best[p][1]):
                best[p] = (n, t)
        assert {r.p: (r.peak, r.peak_at) for r in T.peak_pending(df, ["p"], lapse).collect()} == best


def test_places_for_callers_see_each_place_once(spark, cat):
    asked = spark.createDataFrame([(1, "1%"), (1, "%1"), (2, "%"), (3, "nowhere")], "caller_id long, pattern string")
    got = [(r.caller_id, r.id) for r in P.places_for_callers(cat.place, cat.place_admin, asked).collect()]
    assert len(got) == len(set(got)) and 3 not in {c for c, _ in got}
    listed = {(r.id, str(r.city_id)) for r in cat.place.join(cat.place_admin.select("place_id").distinct(), F.col("id") == F.col("place_id")).collect()}
    assert {i for c, i in got if c == 2} == {i for i, _ in listed}
    assert {i for c, i in got if c == 1} == {i for i, c in listed if fnmatch.fnmatchcase(c, "1*") or fnmatch.fnmatchcase(c, "*1")}


def test_settle_writes_its_rounds_once_as_files(spark):
    """Rounds are read again as Parquet, by column and size, not as checkpointed rows of unknown size."""
    rows = spark.range(500).selectExpr("id", "concat('u', id div 2) AS a", "concat('e', (id + 1) div 2) AS b")
    got = settle(rows, "id", ["a", "b"])
    assert {r.id: r.accepted for r in got.collect()} == {i: i % 2 == 0 for i in range(500)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "parquet" in plan.lower()


def test_places_for_callers_deal_rows_over_tasks(spark, cat, monkeypatch):
    """Many callers of few cities: no task puts out more than a few blocks, and no pair is lost or doubled."""
    monkeypatch.setattr(P, "SIDE", 8, raising=False)
    monkeypatch.setattr(P, "TASK_BLOCKS", 1, raising=False)
    place = spark.range(200).selectExpr("id", "concat('p', id) AS name", "100 AS max_capacity", "'a' AS address", "if(id % 10 = 0, 1, 0) AS city_id")
    admins = place.selectExpr("id AS place_id", "id AS admin_user_id")
    asked = spark.range(300).selectExpr("id AS caller_id", "if(id % 3 = 0, '%', '1%') AS pattern")
    out = P.places_for_callers(place, admins, asked).withColumn("task", F.spark_partition_id()).collect()
    want = {(c, p) for c in range(300) for p in range(200) if c % 3 == 0 or p % 10 == 0}
    assert len(out) == len(want) and {(r.caller_id, r.id) for r in out} == want
    per_task = [sum(r.task == t for r in out) for t in {r.task for r in out}]
    assert len(per_task) > 100 and max(per_task) < len(want) / 20


def test_emitted_open_and_completed_are_all(spark):
    from slotbook.registry import catalog
    from slotbook.streaming import jobs

    sf_dir = "/root/testdata/sf0.001"
    bookings, done = catalog(spark, sf_dir).live_booking, catalog(spark, sf_dir).completion
    emitted = jobs.stream_expiry(spark, sf_dir).select(F.col("booking_id").alias("id"))
    still = jobs.stream_expiry_open(spark, sf_dir).select(F.col("booking_id").alias("id"))
    b, c = bookings.alias("b"), done.alias("c")
    completed = b.join(c, (F.col("b.member_user_id") == F.col("c.member_user_id")) & (F.col("c.completed_at") >= F.col("b.created_at"))
                       & (F.col("c.completed_at") < F.col("b.created_at") + F.expr(C.BOOKING_TTL)), "left_semi").select("id")
    parts = [{r.id for r in x.collect()} for x in (emitted, still, completed)]
    assert sum(map(len, parts)) == bookings.count() and set().union(*parts) == {r.id for r in bookings.collect()} and parts[1]
