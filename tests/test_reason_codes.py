"""Per-code counts of every rule-checked job at sf0.01 (FIXTURES.md section 3).

Every count equals FIXTURES.md except admit_ban_requests, where a PENDING ban
request only blocks requests made after it was filed (replay time; README).
"""

import pytest

from slotbook.plans import admission as M
from slotbook.sources.views import Catalog

SF01 = "/root/testdata/sf0.01"

EXPECTED = {
    "admit_bookings": {"0000": 1721, "1020": 193, "1021": 14, "1022": 53},
    "transition_bookings": {"0000": 2979, "1029": 1154, "1034": 5059, "1035": 5808},
    "admit_packages": {"0000": 544, "1036": 223, "1037": 38, "1038": 432, "1039": 727, "1040": 36},
    "admit_ban_requests": {"0000": 1279, "1025": 240, "1026": 191, "1027": 117, "1033": 190},
    "decide_ban_requests": {"0000": 521, "1028": 290, "1031": 176, "1032": 1027},
    "admit_places": {"0000": 41, "1006": 20, "1007": 20, "1009": 13, "1041": 6},
    "update_places": {"0000": 47, "1013": 12, "1014": 30, "1015": 11},
    "upsert_place_admins": {"0000": 54, "1017": 21},
    "import_members": {"0000": 496, "1001": 242, "1002": 762},
}


@pytest.fixture(scope="module")
def t01(spark):
    return Catalog(spark, SF01)


def _jobs(t):
    return {
        "admit_bookings": lambda: M.admit_bookings(t.booking_request, t.package, t.live_booking),
        "transition_bookings": lambda: M.transition_bookings(
            t.transition_request, t.booking, t.package, t.place, t.place_admin),
        "admit_packages": lambda: M.admit_packages(
            t.package_request, t.place, t.place_admin, t.package, t.package_type),
        "admit_ban_requests": lambda: M.admit_ban_requests(t.ban_request, t.users, t.member_ban),
        "decide_ban_requests": lambda: M.decide_ban_requests(t.ban_decision, t.member_ban),
        "admit_places": lambda: M.admit_places(t.place_request, t.city, t.place)["decisions"],
        "update_places": lambda: M.update_places(t.place_update, t.place),
        "upsert_place_admins": lambda: M.upsert_place_admins(t.admin_entry, t.place_admin)
        .select("place_id", "reason_code").distinct(),
        "import_members": lambda: M.import_members(t.member_signup, t.users),
    }


@pytest.mark.parametrize("job", sorted(EXPECTED))
def test_reason_code_counts(t01, job):
    df = _jobs(t01)[job]()
    got = {r["reason_code"]: r["count"] for r in df.groupBy("reason_code").count().collect()}
    assert got == EXPECTED[job]


def test_strict_mode_refuses_at_least_snapshot(t01):
    snap = M.admit_bookings(t01.booking_request, t01.package, t01.live_booking)
    strict = M.admit_bookings(t01.booking_request, t01.package, t01.live_booking, mode="strict")
    s_ok = {r.id for r in snap.filter("reason_code = '0000'").select("id").collect()}
    t_ok = {r.id for r in strict.filter("reason_code = '0000'").select("id").collect()}
    assert t_ok <= s_ok and len(t_ok) < len(s_ok)
