"""Registered effect tables of the rule-checked jobs, batch-aware packages, and the
validation rules that the request tables do not exercise (V06, V09, V10, U03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotbook import constants as C
from slotbook.functions import validate as V
from slotbook.functions.ids import stable_uuid
from slotbook.functions.privacy import redact
from slotbook.plans import admission as M
from slotbook.queries import _sql as S
from slotbook.queries.access import DECIDED_SQL, decided_state
from slotbook.queries.admission import ADMIT_PLACES_SQL, DECIDE_SQL, UPSERT_SQL
from slotbook.registry import RAW_SQL, catalog, register

# --- M03, batch-aware -----------------------------------------------------------------
# The requests of a place one by one in a recursive query.
@register("admit_packages_strict", f"""
WITH RECURSIVE d AS ({RAW_SQL['admit_packages']}),
o AS (SELECT d.id, d.place_id, d.capacity, row_number() OVER (PARTITION BY d.place_id ORDER BY d.id) AS rn,
             p.max_capacity - coalesce((SELECT sum(capacity) FROM package k WHERE k.place_id = p.id), 0) AS room
      FROM d JOIN place p ON p.id = d.place_id WHERE d.reason_code = '0000'),
s AS (SELECT place_id, id, rn, true AS took, room - capacity AS rest FROM o WHERE rn = 1
      UNION ALL
      SELECT o.place_id, o.id, o.rn, o.capacity <= s.rest,
             CASE WHEN o.capacity <= s.rest THEN s.rest - o.capacity ELSE s.rest END
      FROM s JOIN o ON o.place_id = s.place_id AND o.rn = s.rn + 1)
SELECT d.id, d.place_id, d.name, d.capacity, d.price, d.package_type_id, d.admin_user_id,
       CASE WHEN s.took = false THEN '1039' ELSE d.reason_code END AS reason_code,
       CASE WHEN s.took = false THEN NULL ELSE d.new_package_id END AS new_package_id
FROM d LEFT JOIN s ON s.id = d.id""")
def q_admit_packages_strict(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return M.admit_packages(t.package_request, t.place, t.place_admin, t.package, t.package_type,
                            mode="strict")


# --- M05 ------------------------------------------------------------------------------
@register("admit_places_places", ADMIT_PLACES_SQL + """
SELECT new_place_id AS id, name, max_capacity, address, owner_user_id, city_id
FROM y WHERE reason_code = '0000'""")
def q_admit_places_places(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return M.admit_places(t.place_request, t.city, t.place)["places"]


@register("admit_places_links", f"""
SELECT admin_user_id, place_id FROM ({RAW_SQL['admit_places_admins']}) a""")
def q_admit_places_links(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return M.admit_places(t.place_request, t.city, t.place)["links"]


# --- M07 ------------------------------------------------------------------------------
# Requests in the source's shape, one row a place with its list of admins; same decisions as the flat form.
@register("upsert_place_admins_nested", RAW_SQL["upsert_place_admins"])
def q_upsert_place_admins_nested(spark, sf_dir):
    t = catalog(spark, sf_dir)
    lists = t.admin_entry.groupBy("place_id").agg(
        F.collect_list(F.struct("admin_user_id", "fullname", "username", "is_active")).alias("admins"))
    return M.upsert_place_admins_nested(lists, t.place_admin)


def _place_admins(t):
    return M.apply_place_admins(M.upsert_place_admins(t.admin_entry, t.place_admin), t.users, t.place_admin)


@register("users_after_place_admins", f"""
WITH d AS ({UPSERT_SQL}),
hit AS (SELECT * FROM d WHERE action = 'UPDATE')
SELECT CAST(u.id AS VARCHAR) AS id,
       CASE WHEN h.admin_user_id IS NULL THEN u.fullname ELSE h.fullname END AS fullname, u.gender,
       CASE WHEN h.admin_user_id IS NULL THEN u.username ELSE h.username END AS username, u.email, u.role,
       u.ban_status, CASE WHEN h.admin_user_id IS NULL THEN u.is_active ELSE h.is_active END AS is_active, u.created_at
FROM users u LEFT JOIN hit h ON h.admin_user_id = u.id
UNION ALL
SELECT new_user_id, fullname, 'MALE', username, new_email, 'ADMIN', 'ACTIVE', is_active, NULL
FROM d WHERE action = 'CREATE'""")
def q_users_after_place_admins(spark, sf_dir):
    return _place_admins(catalog(spark, sf_dir))["users"]


@register("place_admin_after_upsert", f"""
SELECT CAST(admin_user_id AS VARCHAR) AS admin_user_id, place_id FROM place_admin
UNION ALL
SELECT new_user_id, place_id FROM ({UPSERT_SQL}) d WHERE action = 'CREATE'""")
def q_place_admin_after_upsert(spark, sf_dir):
    return _place_admins(catalog(spark, sf_dir))["place_admin"]


# --- M08, M09 -------------------------------------------------------------------------
@register("users_after_ban_requests", f"""
WITH d AS ({RAW_SQL['admit_ban_requests']})
SELECT u.* REPLACE (CASE WHEN u.id IN (SELECT member_user_id FROM d WHERE reason_code = '0000')
                         THEN 'PENDING' ELSE u.ban_status END AS ban_status)
FROM users u""")
def q_users_after_ban_requests(spark, sf_dir):
    t = catalog(spark, sf_dir)
    d = M.admit_ban_requests(t.ban_request, t.users, t.member_ban)
    return M.apply_ban_requests(d, t.member_ban, t.users)["users"]


@register("users_after_ban_decisions", "WITH " + DECIDED_SQL.format(decisions=DECIDE_SQL) + """
SELECT * FROM users2""")
def q_users_after_ban_decisions(spark, sf_dir):
    return decided_state(catalog(spark, sf_dir))[0]


@register("member_ban_after_decisions", "WITH " + DECIDED_SQL.format(decisions=DECIDE_SQL) + """
SELECT * FROM bans2""")
def q_member_ban_after_decisions(spark, sf_dir):
    return decided_state(catalog(spark, sf_dir))[1]


# --- V06: every booking id as uuid-shaped text, every ninth without its last character ---
@register("validate_ids", f"""
WITH i AS (SELECT id, {S.stable_uuid_sql('ids', 'id')} AS u FROM booking),
j AS (SELECT id, CASE WHEN id % 9 = 0 THEN substr(u, 1, 35) ELSE u END AS u FROM i),
k AS (SELECT id, u, length(u) = 36 AND substr(u, 20, 1) IN ('8', '9', 'a', 'b') AS shaped, substr(u, 15, 1) AS v FROM j)
SELECT id, u AS uuid, shaped AND v = '4' AS is_v4, shaped AND v BETWEEN '1' AND '8' AS is_any FROM k""")
def q_validate_ids(spark, sf_dir):
    u = stable_uuid("ids", F.col("id"))
    uuid = F.when(F.col("id") % 9 == 0, F.substring(u, 1, 35)).otherwise(u)
    return (catalog(spark, sf_dir).booking.select("id", uuid.alias("uuid"))
            .select("id", "uuid", V.passes(V.valid_id(F.col("uuid"), "uuid4")).alias("is_v4"),
                    V.passes(V.valid_id(F.col("uuid"), "uuid")).alias("is_any")))


# --- V09, U03: passwords that miss one class of characters or the length -----------------
_PASSWORD = """CASE id % 5 WHEN 0 THEN concat('Aa1!', username) WHEN 1 THEN username
    WHEN 2 THEN concat(upper(username), '!') WHEN 3 THEN 'Aa1!' ELSE concat('Aa!', fullname) END"""


@register("validate_passwords", f"""
WITH p AS (SELECT id, {_PASSWORD} AS pw FROM users)
SELECT id, length(pw) >= 8 AND len(regexp_extract_all(pw, '[a-z]')) > 0 AND len(regexp_extract_all(pw, '[A-Z]')) > 0
           AND len(regexp_extract_all(pw, '[0-9]')) > 0
           AND length(translate(lower(pw), 'abcdefghijklmnopqrstuvwxyz0123456789', '')) > 0 AS strong
FROM p""")
def q_validate_passwords(spark, sf_dir):
    users = catalog(spark, sf_dir).users.withColumn("password", F.expr(_PASSWORD))
    return users.select("id", V.passes(V.strong_password(F.col("password"))).alias("strong"))


@register("redacted_users", "SELECT * FROM users")
def q_redacted_users(spark, sf_dir):
    return redact(catalog(spark, sf_dir).users.withColumn("password", F.expr(_PASSWORD)))


# --- V10: lists of 0 to 12 names -------------------------------------------------------
@register("validate_admin_lists", f"""
SELECT id, CASE WHEN id % 13 BETWEEN 1 AND 10 THEN '' ELSE {S.msg(C.MSG_PLACE_ADMIN_NAMES)} END AS errors_text
FROM package""")
def q_validate_admin_lists(spark, sf_dir):
    names = F.array_repeat(F.col("name"), (F.col("id") % 13).cast("int"))
    rules = [(C.MSG_PLACE_ADMIN_NAMES, V.array_size_between(F.col("admin_name_list")))]
    df = catalog(spark, sf_dir).package.select("id", names.alias("admin_name_list"))
    return V.validate_fields(df, rules).select("id", F.array_join("errors", " | ").alias("errors_text"))
