"""Registered jobs whose result is that of taking requests one by one; the oracle SQL folds them
one by one in a recursive query."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotbook import constants as C
from slotbook.functions.paging import page_numbers
from slotbook.plans import admission as M
from slotbook.queries import _sql as S
from slotbook.registry import catalog, register

# --- M01 --------------------------------------------------------------------------------
# Requests crowd on a tenth of the packages and members, so both rules bind.
_CROWDED = """
crowded_request AS (SELECT id, member_user_id % greatest(1, (SELECT count(*) FROM customer) // 10) AS member_user_id,
                           CASE WHEN package_id < 0 OR id % 31 = 0 THEN package_id
                                ELSE package_id % greatest(1, (SELECT count(*) FROM part) // 10) END AS package_id, requested_at
                    FROM booking_request)"""

SEQUENTIAL_SQL = f"""
WITH RECURSIVE {_CROWDED},
pend AS (SELECT * FROM live_booking WHERE order_status = 'PENDING'),
c AS (SELECT q.id, count(s.id) AS n FROM crowded_request q
      LEFT JOIN pend s ON s.package_id = q.package_id AND s.created_at <= q.requested_at GROUP BY q.id),
m AS (SELECT q.id, coalesce(max(s.created_at) + INTERVAL 2 HOUR > any_value(q.requested_at), false) AS ongoing FROM crowded_request q
      LEFT JOIN pend s ON s.member_user_id = q.member_user_id AND s.created_at <= q.requested_at GROUP BY q.id),
b AS (SELECT q.*, p.id AS pk, p.capacity AS cap, c.n, m.ongoing, row_number() OVER (ORDER BY q.requested_at, q.id) AS rn
      FROM crowded_request q JOIN c USING (id) JOIN m USING (id) LEFT JOIN package p ON p.id = q.package_id),
fold AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS reason_code,
         CAST([] AS STRUCT(p BIGINT, m BIGINT, t TIMESTAMP)[]) AS took
  UNION ALL
  SELECT rn, id, code, CASE WHEN code = '0000' THEN list_append(took, {{'p': package_id, 'm': member_user_id, 't': requested_at}}) ELSE took END
  FROM (SELECT b.*, took, CASE WHEN NOT {S.key('b.package_id')} THEN '1019'
                 WHEN pk IS NULL THEN '1020'
                 WHEN n + len(list_filter(took, lambda x: x.p = b.package_id)) >= cap THEN '1021'
                 WHEN ongoing OR len(list_filter(took, lambda x: x.m = b.member_user_id AND x.t + INTERVAL 2 HOUR > b.requested_at)) > 0 THEN '1022'
                 ELSE '0000' END AS code
        FROM fold JOIN b ON b.rn = fold.rn + 1))
SELECT b.id, b.member_user_id, b.package_id, b.requested_at, f.reason_code,
       CASE WHEN f.reason_code = '0000' THEN {S.stable_uuid_sql('admit_bookings', 'b.id')} END AS new_booking_id,
       CASE WHEN f.reason_code = '0000' THEN 'PENDING' END AS order_status
FROM b JOIN (SELECT id, reason_code FROM fold) f USING (id)"""


@register("admit_bookings_sequential", SEQUENTIAL_SQL)
def q_admit_bookings_sequential(spark, sf_dir):
    t = catalog(spark, sf_dir)
    members = F.greatest(F.lit(1), F.floor(t._customer_count() / 10))
    packages = F.greatest(F.lit(1), F.floor(F.lit(t._n_parts) / 10))
    keep = (F.col("package_id") < 0) | (F.col("id") % 31 == 0)
    requests = t.booking_request.select(
        "id", (F.col("member_user_id") % members).alias("member_user_id"),
        F.when(keep, F.col("package_id")).otherwise(F.col("package_id") % packages).alias("package_id"), "requested_at")
    return M.admit_bookings(requests, t.package, t.live_booking, mode="sequential")


# --- M10 --------------------------------------------------------------------------------
# Sign-up k shares its username with k + 1 or its e-mail, by turns, so each is refused only if
# the one before is accepted: one chain over all customers, with gaps where sign-ups are invalid.
_CHAINED = """
chained_signup AS (SELECT id, fullname, gender, concat('chain', CAST(id // 2 AS VARCHAR)) AS username,
                          concat('c', CAST((id + 1) // 2 AS VARCHAR), '@example.com') AS email
                   FROM member_signup)"""
_SIGNUP_BAD = S.any_bad(S.one_of("gender", C.GENDERS), S.alpha("fullname"), S.alnum("username"), S.email("email"))


@register("import_members_chained", f"""
WITH RECURSIVE {_CHAINED},
b AS (SELECT *, {_SIGNUP_BAD} AS bad, row_number() OVER (ORDER BY id) AS rn FROM chained_signup),
fold AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS reason_code,
         CAST(NULL AS VARCHAR) AS last_user, CAST(NULL AS VARCHAR) AS last_email
  UNION ALL
  SELECT rn, id, code, CASE WHEN code = '0000' THEN username ELSE last_user END, CASE WHEN code = '0000' THEN email ELSE last_email END
  FROM (SELECT b.*, last_user, last_email,
               CASE WHEN bad THEN '1001'
                    WHEN username = last_user OR email = last_email OR username IN (SELECT username FROM users)
                         OR email IN (SELECT email FROM users) THEN '1002'
                    ELSE '0000' END AS code
        FROM fold JOIN b ON b.rn = fold.rn + 1))
SELECT b.id, fullname, gender, username, email, f.reason_code, CASE WHEN f.reason_code = '0000' THEN 'MEMBER' END AS role
FROM b JOIN (SELECT id, reason_code FROM fold) f USING (id)""")
def q_import_members_chained(spark, sf_dir):
    t = catalog(spark, sf_dir)
    half = lambda c: F.floor(c / 2).cast("string")
    chained = t.member_signup.select(
        "id", "fullname", "gender", F.concat(F.lit("chain"), half(F.col("id"))).alias("username"),
        F.concat(F.lit("c"), half(F.col("id") + 1), F.lit("@example.com")).alias("email"))
    return M.import_members(chained, t.users)


# --- M06 --------------------------------------------------------------------------------
# Place k moves to where place k - 1 was (or, every 40th, to a new spot), so a whole run of moves
# hangs on its first one; every 23rd update is refused for its capacity, every 29th goes back on the run.
_MOVES = """
place_move AS (SELECT p.id, CASE WHEN p.id % 40 = 0 THEN 'Fresh spot' WHEN p.id % 29 = 0 THEN n.name ELSE coalesce(b.name, 'Fresh spot') END AS name,
                      CASE WHEN p.id % 40 = 0 THEN concat('Lane ', CAST(p.id AS VARCHAR)) WHEN p.id % 29 = 0 THEN n.address
                           ELSE coalesce(b.address, concat('Lane ', CAST(p.id AS VARCHAR))) END AS address,
                      CAST(p.max_capacity - CASE WHEN p.id % 23 = 5 THEN 1 ELSE 0 END AS INT) AS max_capacity
               FROM place p LEFT JOIN place b ON b.id = p.id - 1 LEFT JOIN place n ON n.id = p.id + 1)"""


@register("update_places_sequential", f"""
WITH RECURSIVE {_MOVES},
b AS (SELECT q.*, {S.any_bad(S.alpha('q.name'), S.numeric('q.max_capacity'), S.key('q.address'))} AS bad,
             q.max_capacity < p.max_capacity AS small, row_number() OVER (ORDER BY q.id) AS rn FROM place_move q JOIN place p ON p.id = q.id),
fold AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS reason_code,
         (SELECT list({{'id': id, 'n': name, 'a': address}}) FROM place) AS held
  UNION ALL
  SELECT rn, id, code, CASE WHEN code = '0000' THEN list_append(list_filter(held, lambda x: x.id <> b_id), {{'id': b_id, 'n': name, 'a': address}}) ELSE held END
  FROM (SELECT b.*, b.id AS b_id, held,
               CASE WHEN bad THEN '1011' WHEN small THEN '1014'
                    WHEN len(list_filter(held, lambda x: x.n = b.name AND x.a = b.address AND x.id <> b.id)) > 0 THEN '1015'
                    ELSE '0000' END AS code
        FROM fold JOIN b ON b.rn = fold.rn + 1))
SELECT b.id, name, address, max_capacity, f.reason_code FROM b JOIN (SELECT id, reason_code FROM fold) f USING (id)""")
def q_update_places_sequential(spark, sf_dir):
    t = catalog(spark, sf_dir)
    near = lambda k, tag: t.place.select((F.col("id") + k).alias("id"), F.col("name").alias(f"{tag}_name"), F.col("address").alias(f"{tag}_address"))
    k = F.col("id")
    lane = F.concat(F.lit("Lane "), k.cast("string"))
    moves = t.place.join(near(1, "before"), "id", "left").join(near(-1, "next"), "id", "left").select(
        "id", F.when(k % 40 == 0, "Fresh spot").when(k % 29 == 0, F.col("next_name")).otherwise(F.coalesce("before_name", F.lit("Fresh spot"))).alias("name"),
        F.when(k % 40 == 0, lane).when(k % 29 == 0, F.col("next_address")).otherwise(F.coalesce("before_address", lane)).alias("address"),
        (F.col("max_capacity") - F.when(k % 23 == 5, 1).otherwise(0)).cast("int").alias("max_capacity"))
    return M.update_places(moves, t.place, mode="sequential")


# --- U01 --------------------------------------------------------------------------------
@register("booking_page_numbers", f"""
SELECT id, member_user_id, created_at, order_status,
       CAST((row_number() OVER (ORDER BY created_at DESC NULLS FIRST, id) - 1) // {C.DEFAULT_LIMIT} + 1 AS BIGINT) AS page,
       CAST((row_number() OVER (ORDER BY created_at DESC NULLS FIRST, id) - 1) % {C.DEFAULT_LIMIT} + 1 AS BIGINT) AS line
FROM booking""")
def q_booking_page_numbers(spark, sf_dir):
    b = catalog(spark, sf_dir).booking.select("id", "member_user_id", "created_at", "order_status")
    return page_numbers(b, [F.col("created_at").desc_nulls_first(), F.col("id")])
