"""Registered rule-checked jobs (M01-M03, M05-M10, N01, V01, W01, W02) and oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotbook import constants as C
from slotbook.functions import validate as V
from slotbook.operators.writes import append_rows, apply_updates
from slotbook.plans import admission as M
from slotbook.queries import _sql as S
from slotbook.registry import RAW_SQL, catalog, register


def _uuid_if_ok(job: str, *keys: str) -> str:
    return f"CASE WHEN reason_code = '0000' THEN {S.stable_uuid_sql(job, *keys)} END"


# --- M01 + W02 -----------------------------------------------------------------------
ADMIT_BOOKINGS_SQL = f"""
WITH pend AS (SELECT * FROM live_booking WHERE order_status = 'PENDING'),
r AS (SELECT q.*, p.capacity AS cap, p.id AS pk
      FROM booking_request q LEFT JOIN package p ON p.id = q.package_id),
c AS (SELECT r.id, count(s.id) AS n FROM r
      LEFT JOIN pend s ON s.package_id = r.package_id AND s.created_at <= r.requested_at
      GROUP BY r.id),
m AS (SELECT r.id, max(s.created_at) AS last_mt FROM r
      LEFT JOIN pend s ON s.member_user_id = r.member_user_id AND s.created_at <= r.requested_at
      GROUP BY r.id),
x AS (SELECT r.id, r.member_user_id, r.package_id, r.requested_at,
             CASE WHEN NOT {S.key('r.package_id')} THEN '1019'
                  WHEN r.pk IS NULL THEN '1020'
                  WHEN c.n = r.cap THEN '1021'
                  WHEN m.last_mt + INTERVAL 2 HOUR > r.requested_at THEN '1022'
                  ELSE '0000' END AS reason_code
      FROM r JOIN c ON c.id = r.id JOIN m ON m.id = r.id)"""


@register("admit_bookings", ADMIT_BOOKINGS_SQL + f"""
SELECT *, {_uuid_if_ok('admit_bookings', 'id')} AS new_booking_id,
       CASE WHEN reason_code = '0000' THEN 'PENDING' END AS order_status
FROM x""")
def q_admit_bookings(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return M.admit_bookings(t.booking_request, t.package, t.live_booking)


@register("bookings_after_admission", ADMIT_BOOKINGS_SQL + """
SELECT id, member_user_id, package_id, 'PENDING' AS order_status, requested_at AS created_at
FROM x WHERE reason_code = '0000'
UNION ALL
SELECT id, member_user_id, package_id, order_status, created_at FROM live_booking""")
def q_bookings_after_admission(spark, sf_dir):
    t = catalog(spark, sf_dir)
    d = M.admit_bookings(t.booking_request, t.package, t.live_booking)
    new = (d.filter(F.col("reason_code") == C.OK)
           .select("id", "member_user_id", "package_id", F.col("requested_at").alias("created_at")))
    return append_rows(t.live_booking, new, defaults={"order_status": F.lit(C.ORDER_PENDING)})


STRICT_SQL = f"""
WITH pend AS (SELECT * FROM live_booking WHERE order_status = 'PENDING'),
r AS (SELECT q.*, p.capacity AS cap, p.id AS pk
      FROM booking_request q LEFT JOIN package p ON p.id = q.package_id),
c AS (SELECT r.id, count(s.id) AS n FROM r
      LEFT JOIN pend s ON s.package_id = r.package_id AND s.created_at <= r.requested_at
      GROUP BY r.id),
m AS (SELECT r.id, max(s.created_at) AS last_mt FROM r
      LEFT JOIN pend s ON s.member_user_id = r.member_user_id AND s.created_at <= r.requested_at
      GROUP BY r.id),
b AS (SELECT r.*, c.n, NOT {S.key('r.package_id')} AS bad,
             coalesce(m.last_mt + INTERVAL 2 HOUR > r.requested_at, false) AS st_ongoing
      FROM r JOIN c ON c.id = r.id JOIN m ON m.id = r.id),
b1 AS (SELECT *, NOT bad AND pk IS NOT NULL AND NOT st_ongoing AS e1 FROM b),
bo AS (SELECT b1.id, max(e.requested_at) AS prev FROM b1
       LEFT JOIN b1 e ON e.e1 AND e.member_user_id = b1.member_user_id
                     AND (e.requested_at, e.id) < (b1.requested_at, b1.id)
       GROUP BY b1.id),
b2 AS (SELECT b1.*, coalesce(bo.prev + INTERVAL 2 HOUR > b1.requested_at, false) AS batch_ongoing
       FROM b1 JOIN bo ON bo.id = b1.id),
b3 AS (SELECT *, e1 AND NOT batch_ongoing AS e2 FROM b2),
rk AS (SELECT b3.id, count(e.id) AS rnk FROM b3
       LEFT JOIN b3 e ON e.e2 AND e.package_id = b3.package_id
                     AND (e.requested_at, e.id) < (b3.requested_at, b3.id)
       GROUP BY b3.id),
x AS (SELECT b3.id, b3.member_user_id, b3.package_id, b3.requested_at,
             CASE WHEN b3.bad THEN '1019'
                  WHEN b3.pk IS NULL THEN '1020'
                  WHEN b3.n + rk.rnk >= b3.cap THEN '1021'
                  WHEN b3.st_ongoing OR b3.batch_ongoing THEN '1022'
                  ELSE '0000' END AS reason_code
      FROM b3 JOIN rk ON rk.id = b3.id)
SELECT *, {_uuid_if_ok('admit_bookings', 'id')} AS new_booking_id,
       CASE WHEN reason_code = '0000' THEN 'PENDING' END AS order_status
FROM x"""


@register("admit_bookings_strict", STRICT_SQL)
def q_admit_bookings_strict(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return M.admit_bookings(t.booking_request, t.package, t.live_booking, mode="strict")


# --- M02 + W01 -----------------------------------------------------------------------
TRANSITION_SQL = f"""
WITH w AS (SELECT b.id AS booking_id, pk.place_id, b.updated_at AS prev_updated
           FROM booking b JOIN package pk ON pk.id = b.package_id JOIN place pl ON pl.id = pk.place_id),
r AS (SELECT t.*, w.place_id, w.prev_updated, pa.admin_user_id AS managed
      FROM transition_request t
      LEFT JOIN w ON w.booking_id = t.booking_id
      LEFT JOIN place_admin pa ON pa.admin_user_id = t.admin_user_id AND pa.place_id = w.place_id),
p AS (SELECT *, CASE WHEN NOT {S.key('booking_id')} THEN '1030'
                     WHEN NOT {S.one_of('new_status', ('COMPLETED', 'EXPIRED'))} THEN '1029'
                     WHEN managed IS NULL THEN '1034'
                     WHEN prev_updated IS NOT NULL THEN '1035'
                     ELSE '0000' END AS pre FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY booking_id, pre = '0000'
                                   ORDER BY requested_at, admin_user_id, new_status) AS rn FROM p),
x AS (SELECT booking_id, new_status, admin_user_id, requested_at,
             CASE WHEN pre = '0000' AND rn > 1 THEN '1035' ELSE pre END AS reason_code FROM f),
y AS (SELECT *, CASE WHEN reason_code = '0000' THEN new_status END AS order_status,
             CASE WHEN reason_code = '0000' THEN requested_at END AS updated_at
      FROM x)"""


@register("transition_bookings", TRANSITION_SQL + "\nSELECT * FROM y")
def q_transition_bookings(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return M.transition_bookings(t.transition_request, t.booking, t.package, t.place, t.place_admin)


@register("bookings_after_transitions", TRANSITION_SQL + """
SELECT b.id, CASE WHEN y.booking_id IS NOT NULL THEN y.order_status ELSE b.order_status END AS order_status,
       b.member_user_id, b.package_id,
       CASE WHEN y.booking_id IS NOT NULL THEN y.updated_at ELSE b.updated_at END AS updated_at,
       b.created_at, y.admin_user_id
FROM booking b LEFT JOIN (SELECT * FROM y WHERE reason_code = '0000') y ON y.booking_id = b.id""")
def q_bookings_after_transitions(spark, sf_dir):
    t = catalog(spark, sf_dir)
    d = M.transition_bookings(t.transition_request, t.booking, t.package, t.place, t.place_admin)
    upd = (d.filter(F.col("reason_code") == C.OK)
           .select(F.col("booking_id").alias("id"), "order_status", "updated_at", "admin_user_id"))
    booking = t.booking.withColumn("admin_user_id", F.lit(None).cast("long"))  # who settled it
    return apply_updates(booking, upd, ["id"], ["order_status", "updated_at", "admin_user_id"], policy="error")


# --- M03 -------------------------------------------------------------------------------
@register("admit_packages", f"""
WITH used AS (SELECT place_id, sum(capacity) AS used FROM package GROUP BY place_id),
r AS (SELECT q.*, pl.id AS pl, pl.max_capacity AS mx, u.used, pa.admin_user_id AS adm, pt.id AS pt
      FROM package_request q
      LEFT JOIN place pl ON pl.id = q.place_id
      LEFT JOIN used u ON u.place_id = q.place_id
      LEFT JOIN place_admin pa ON pa.admin_user_id = q.admin_user_id AND pa.place_id = q.place_id
      LEFT JOIN package_type pt ON pt.id = q.package_type_id),
x AS (SELECT id, place_id, name, capacity, price, package_type_id, admin_user_id,
             CASE WHEN NOT {S.key('place_id')} THEN '1042'
                  WHEN {S.any_bad(S.alpha('name'), S.numeric('capacity'), S.numeric('price'),
                                  S.key('package_type_id'))} THEN '1036'
                  WHEN pl IS NULL THEN '1037'
                  WHEN adm IS NULL THEN '1038'
                  WHEN coalesce(used, 0) + capacity > mx THEN '1039'
                  WHEN pt IS NULL THEN '1040'
                  ELSE '0000' END AS reason_code
      FROM r)
SELECT *, {_uuid_if_ok('admit_packages', 'id')} AS new_package_id FROM x""")
def q_admit_packages(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return M.admit_packages(t.package_request, t.place, t.place_admin, t.package, t.package_type)


# --- M05 / N01 -------------------------------------------------------------------------
ADMIT_PLACES_SQL = f"""
WITH q AS (SELECT *, string_split(admin_names, ';') AS lst FROM place_request),
ex AS (SELECT DISTINCT name, address, city_id FROM place),
x AS (SELECT q.id, q.name, q.address, q.max_capacity, q.city_id, q.admin_names, q.owner_user_id, q.lst,
             CASE WHEN {S.any_bad(S.alpha('q.name'), S.numeric('q.max_capacity'),
                                  S.key('q.address'), S.key('q.city_id'),
                                  S.ok('q.lst IS NOT NULL AND len(q.lst) BETWEEN 1 AND 10'))} THEN '1006'
                  WHEN len(list_distinct(q.lst)) <> len(q.lst) THEN '1007'
                  WHEN c.id IS NULL THEN '1041'
                  WHEN ex.name IS NOT NULL THEN '1009'
                  ELSE '0000' END AS reason_code
      FROM q LEFT JOIN city c ON c.id = q.city_id
      LEFT JOIN ex ON ex.name = q.name AND ex.address = q.address AND ex.city_id = q.city_id),
y AS (SELECT *, {_uuid_if_ok('admit_places', 'id')} AS new_place_id FROM x)"""


@register("admit_places", ADMIT_PLACES_SQL + """
SELECT * EXCLUDE (lst) FROM y""")
def q_admit_places(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return M.admit_places(t.place_request, t.city, t.place)["decisions"]


@register("admit_places_admins", ADMIT_PLACES_SQL + f""",
e AS (SELECT id AS request_id, new_place_id AS place_id, name, lst,
             unnest(range(1, len(lst) + 1)) AS i
      FROM y WHERE reason_code = '0000'),
n AS (SELECT request_id, place_id, CAST(i - 1 AS INT) AS position, lst[i] AS fullname,
             lower(concat(replace(name, ' ', ''), replace(lst[i], ' ', ''), CAST(i - 1 AS VARCHAR)))
               AS username
      FROM e)
SELECT request_id, place_id, position,
       {S.stable_uuid_sql('admit_places_admin', 'request_id', 'position')} AS admin_user_id,
       fullname, 'MALE' AS gender, username, concat(username, '@{C.ADMIN_EMAIL_DOMAIN}') AS email,
       'ADMIN' AS role
FROM n""")
def q_admit_places_admins(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return M.admit_places(t.place_request, t.city, t.place)["admins"]


# --- M06 -------------------------------------------------------------------------------
@register("update_places", f"""
WITH bn AS (SELECT name, address, count(*) AS n, min(id) AS nid FROM place GROUP BY name, address)
SELECT q.id, q.name, q.address, q.max_capacity,
       CASE WHEN NOT {S.key('q.id')} THEN '1044'
            WHEN {S.any_bad(S.alpha('q.name'), S.numeric('q.max_capacity'), S.key('q.address'))}
              THEN '1011'
            WHEN p.id IS NULL THEN '1013'
            WHEN q.max_capacity < p.max_capacity THEN '1014'
            WHEN bn.n > 1 OR (bn.n = 1 AND bn.nid <> q.id) THEN '1015'
            ELSE '0000' END AS reason_code
FROM place_update q
LEFT JOIN place p ON p.id = q.id
LEFT JOIN bn ON bn.name = q.name AND bn.address = q.address""")
def q_update_places(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return M.update_places(t.place_update, t.place)


# --- M07 -------------------------------------------------------------------------------
UPSERT_SQL = f"""
WITH e AS (SELECT *, NOT ({S.key('fullname')} AND {S.key('username')} AND is_active IS NOT NULL)
                   AS missing
           FROM admin_entry),
g AS (SELECT place_id, count(*) AS n, bool_or(missing) AS invalid FROM e GROUP BY place_id),
x AS (SELECT e.place_id, e.admin_user_id, e.fullname, e.username, e.is_active,
             CASE WHEN NOT {S.key('e.place_id')} THEN '1045'
                  WHEN NOT coalesce(g.n BETWEEN 1 AND 10, false) THEN '1016'
                  WHEN g.invalid THEN '1017'
                  ELSE '0000' END AS reason_code,
             pa.admin_user_id IS NOT NULL AS managed
      FROM e LEFT JOIN g ON g.place_id = e.place_id
      LEFT JOIN place_admin pa ON pa.admin_user_id = e.admin_user_id AND pa.place_id = e.place_id)
SELECT place_id, admin_user_id, fullname, username, is_active, reason_code,
       CASE WHEN reason_code = '0000' THEN CASE WHEN admin_user_id IS NULL THEN 'CREATE' ELSE 'UPDATE' END
            END AS action,
       managed,
       CASE WHEN reason_code = '0000' AND admin_user_id IS NULL
            THEN {S.stable_uuid_sql('upsert_place_admins', 'place_id', 'username')} END AS new_user_id,
       CASE WHEN reason_code = '0000' AND admin_user_id IS NULL
            THEN concat(username, '@{C.ADMIN_EMAIL_DOMAIN}') END AS new_email
FROM x"""


@register("upsert_place_admins", UPSERT_SQL)
def q_upsert_place_admins(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return M.upsert_place_admins(t.admin_entry, t.place_admin)


@register("place_admins_response", "WITH d AS (" + UPSERT_SQL + """),
acc AS (SELECT * FROM d WHERE reason_code = '0000')
SELECT CAST(u.id AS VARCHAR) AS admin_user_id, a.place_id, a.fullname, a.username, a.is_active,
       u.role, u.email, 'UPDATE' AS action
FROM acc a JOIN users u ON u.id = a.admin_user_id
WHERE a.action = 'UPDATE'
UNION ALL
SELECT new_user_id, place_id, fullname, username, is_active, 'ADMIN', new_email, 'CREATE'
FROM acc WHERE action = 'CREATE'""")
def q_place_admins_response(spark, sf_dir):
    t = catalog(spark, sf_dir)
    d = M.upsert_place_admins(t.admin_entry, t.place_admin)
    return M.apply_place_admins(d, t.users, t.place_admin)["admins"]


# --- M08 -------------------------------------------------------------------------------
@register("admit_ban_requests", f"""
WITH pend AS (SELECT member_user_id, created_at,
                     CASE WHEN approval_status <> 'PENDING' THEN updated_at END AS decided_at
              FROM member_ban
              WHERE approval_status = 'PENDING' OR updated_at IS NOT NULL),
r AS (SELECT q.*, u.role FROM ban_request q LEFT JOIN users u ON u.id = q.member_user_id),
c AS (SELECT r.id, count(p.created_at) AS n FROM r
      LEFT JOIN pend p ON p.member_user_id = r.member_user_id AND p.created_at <= r.requested_at
                      AND (p.decided_at IS NULL OR p.decided_at > r.requested_at)
      GROUP BY r.id),
x AS (SELECT r.id, r.member_user_id, r.ban_reason, r.admin_user_id, r.requested_at,
             CASE WHEN {S.any_bad(S.key('r.member_user_id'), S.alpha('r.ban_reason'))} THEN '1025'
                  WHEN r.role IS NULL THEN '1026'
                  WHEN r.role IN ('OWNER', 'ADMIN') THEN '1033'
                  WHEN c.n > 0 THEN '1027'
                  ELSE '0000' END AS reason_code
      FROM r JOIN c ON c.id = r.id)
SELECT *, {_uuid_if_ok('admit_ban_requests', 'id')} AS new_ban_id,
       CASE WHEN reason_code = '0000' THEN 'PENDING' END AS user_ban_status
FROM x""")
def q_admit_ban_requests(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return M.admit_ban_requests(t.ban_request, t.users, t.member_ban)


# --- M09 -------------------------------------------------------------------------------
DECIDE_SQL = f"""
WITH r AS (SELECT d.*, mb.member_user_id, mb.updated_at AS prev, mb.id AS found
           FROM ban_decision d LEFT JOIN member_ban mb ON mb.id = d.ban_request_id),
p AS (SELECT *, CASE WHEN {S.any_bad(S.key('ban_request_id'),
                                     S.one_of('decision', ('BANNED', 'REVOKED')))} THEN '1028'
                     WHEN found IS NULL THEN '1031'
                     WHEN prev IS NOT NULL THEN '1032'
                     ELSE '0000' END AS pre FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY ban_request_id, pre = '0000'
                                   ORDER BY decided_at, decision, owner_user_id) AS rn FROM p),
x AS (SELECT *, CASE WHEN pre = '0000' AND rn > 1 THEN '1032' ELSE pre END AS reason_code FROM f)
SELECT ban_request_id, decision, owner_user_id, decided_at, reason_code, member_user_id,
       CASE WHEN reason_code = '0000' THEN decision END AS approval_status,
       CASE WHEN reason_code = '0000' THEN
         CASE WHEN decision = 'BANNED' THEN decided_at + INTERVAL 3 DAY ELSE decided_at END
       END AS ban_lifted_at,
       CASE WHEN reason_code = '0000' THEN
         CASE WHEN decision = 'BANNED' THEN 'BANNED' ELSE 'ACTIVE' END
       END AS user_ban_status
FROM x"""


@register("decide_ban_requests", DECIDE_SQL)
def q_decide_ban_requests(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return M.decide_ban_requests(t.ban_decision, t.member_ban)


# --- M10 / V01 -------------------------------------------------------------------------
_SIGNUP_OKS = [
    (C.MSG_SIGNUP_GENDER, S.one_of("gender", C.GENDERS)),
    (C.MSG_SIGNUP_FULLNAME, S.alpha("fullname")),
    (C.MSG_SIGNUP_USERNAME, S.alnum("username")),
    (C.MSG_SIGNUP_EMAIL, S.email("email")),
]


@register("import_members", f"""
WITH r AS (SELECT *, {S.any_bad(*[o for _, o in _SIGNUP_OKS])} AS bad FROM member_signup),
free AS (SELECT * FROM r WHERE NOT bad AND username NOT IN (SELECT username FROM users WHERE username IS NOT NULL)
         AND email NOT IN (SELECT email FROM users WHERE email IS NOT NULL)),
fu AS (SELECT username, min(id) AS fu FROM free GROUP BY username),
fe AS (SELECT email, min(id) AS fe FROM free GROUP BY email),
tu AS (SELECT DISTINCT username FROM users),
te AS (SELECT DISTINCT email FROM users),
x AS (SELECT r.id, r.fullname, r.gender, r.username, r.email,
             CASE WHEN r.bad THEN '1001'
                  WHEN tu.username IS NOT NULL OR te.email IS NOT NULL
                       OR fu.fu <> r.id OR fe.fe <> r.id THEN '1002'
                  ELSE '0000' END AS reason_code
      FROM r LEFT JOIN tu ON tu.username = r.username LEFT JOIN te ON te.email = r.email
      LEFT JOIN fu ON fu.username = r.username LEFT JOIN fe ON fe.email = r.email)
SELECT *, CASE WHEN reason_code = '0000' THEN 'MEMBER' END AS role FROM x""")
def q_import_members(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return M.import_members(t.member_signup, t.users)


_ERR_LIST = ", ".join(f"CASE WHEN NOT {o} THEN {S.msg(m)} END" for m, o in _SIGNUP_OKS)
_ERR_COUNT = " + ".join(f"CASE WHEN NOT {o} THEN 1 ELSE 0 END" for _, o in _SIGNUP_OKS)


@register("validate_signups", f"""
SELECT id, CAST({_ERR_COUNT} AS INT) AS error_count, concat_ws(' | ', {_ERR_LIST}) AS errors_text
FROM member_signup""")
def q_validate_signups(spark, sf_dir):
    t = catalog(spark, sf_dir)
    v = V.validate_fields(t.member_signup, V.signup_rules())
    return v.select("id", F.size("errors").alias("error_count"),
                    F.array_join("errors", " | ").alias("errors_text"))


# --- table versions after the decisions (W01 / W02) --------------------------------------
@register("packages_after_admission", f"""
SELECT CAST(id AS VARCHAR) AS id, name, capacity, price, place_id, package_type_id FROM package
UNION ALL
SELECT new_package_id, name, capacity, price, place_id, package_type_id
FROM ({RAW_SQL['admit_packages']}) d WHERE reason_code = '0000'""")
def q_packages_after_admission(spark, sf_dir):
    t = catalog(spark, sf_dir)
    d = M.admit_packages(t.package_request, t.place, t.place_admin, t.package, t.package_type)
    return M.apply_packages(d, t.package)


@register("places_after_update", f"""
WITH acc AS (SELECT * FROM ({RAW_SQL['update_places']}) d WHERE reason_code = '0000')
SELECT p.id,
       CASE WHEN a.id IS NOT NULL THEN a.name ELSE p.name END AS name,
       CASE WHEN a.id IS NOT NULL THEN a.max_capacity ELSE p.max_capacity END AS max_capacity,
       CASE WHEN a.id IS NOT NULL THEN a.address ELSE p.address END AS address,
       p.owner_user_id, p.city_id
FROM place p LEFT JOIN acc a ON a.id = p.id""")
def q_places_after_update(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return M.apply_place_updates(M.update_places(t.place_update, t.place), t.place)


@register("member_ban_after_requests", f"""
SELECT CAST(id AS VARCHAR) AS id, member_user_id, approval_status, ban_reason, ban_lifted_at,
       updated_at, created_at
FROM member_ban
UNION ALL
SELECT new_ban_id, member_user_id, 'PENDING', ban_reason, NULL, NULL, requested_at
FROM ({RAW_SQL['admit_ban_requests']}) d WHERE reason_code = '0000'""")
def q_member_ban_after_requests(spark, sf_dir):
    t = catalog(spark, sf_dir)
    d = M.admit_ban_requests(t.ban_request, t.users, t.member_ban)
    return M.apply_ban_requests(d, t.member_ban, t.users)["member_ban"]


@register("users_after_signup", f"""
SELECT * FROM users
UNION ALL
SELECT id, fullname, gender, username, email, role, 'ACTIVE', true, NULL
FROM ({RAW_SQL['import_members']}) d WHERE reason_code = '0000'""")
def q_users_after_signup(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return M.apply_signups(M.import_members(t.member_signup, t.users), t.users)


# --- V01 on the other request tables ------------------------------------------------------
def _errors_sql(pairs) -> tuple[str, str]:
    lst = ", ".join(f"CASE WHEN NOT {o} THEN {S.msg(m)} END" for m, o in pairs)
    cnt = " + ".join(f"CASE WHEN NOT {o} THEN 1 ELSE 0 END" for _, o in pairs)
    return lst, cnt


_PACKAGE_OKS = [(C.MSG_PACKAGE_NAME, S.alpha("name")), (C.MSG_PACKAGE_CAPACITY, S.numeric("capacity")),
                (C.MSG_PACKAGE_PRICE, S.numeric("price")), (C.MSG_PACKAGE_TYPE_ID, S.key("package_type_id"))]
_PLACE_OKS = [(C.MSG_PLACE_NAME, S.alpha("name")), (C.MSG_PLACE_MAX_CAPACITY, S.numeric("max_capacity")),
              (C.MSG_PLACE_ADDRESS, S.key("address")), (C.MSG_PLACE_CITY_ID, S.key("city_id")),
              (C.MSG_PLACE_ADMIN_NAMES,
               S.ok("string_split(admin_names, ';') IS NOT NULL "
                    "AND len(string_split(admin_names, ';')) BETWEEN 1 AND 10"))]


def _validated(df, rules):
    v = V.validate_fields(df, rules)
    return v.select("id", F.size("errors").alias("error_count"),
                    F.array_join("errors", " | ").alias("errors_text"))


_l, _c = _errors_sql(_PACKAGE_OKS)


@register("validate_package_requests", f"""
SELECT id, CAST({_c} AS INT) AS error_count, concat_ws(' | ', {_l}) AS errors_text
FROM package_request""")
def q_validate_package_requests(spark, sf_dir):
    return _validated(catalog(spark, sf_dir).package_request, V.package_create_rules())


_l, _c = _errors_sql(_PLACE_OKS)


@register("validate_place_requests", f"""
SELECT id, CAST({_c} AS INT) AS error_count, concat_ws(' | ', {_l}) AS errors_text
FROM place_request""")
def q_validate_place_requests(spark, sf_dir):
    t = catalog(spark, sf_dir)
    req = t.place_request.withColumn("admin_name_list", F.split("admin_names", ";"))
    return _validated(req, V.place_create_rules())


@register("admit_ban_requests_strict", f"""
WITH d AS ({RAW_SQL['admit_ban_requests']}),
f AS (SELECT *, row_number() OVER (PARTITION BY member_user_id, reason_code = '0000'
                                   ORDER BY requested_at, id) AS rn FROM d),
x AS (SELECT id, member_user_id, ban_reason, admin_user_id, requested_at,
             CASE WHEN reason_code = '0000' AND rn > 1 THEN '1027' ELSE reason_code END AS reason_code
      FROM f)
SELECT *, {_uuid_if_ok('admit_ban_requests', 'id')} AS new_ban_id,
       CASE WHEN reason_code = '0000' THEN 'PENDING' END AS user_ban_status
FROM x""")
def q_admit_ban_requests_strict(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return M.admit_ban_requests(t.ban_request, t.users, t.member_ban, mode="strict")
