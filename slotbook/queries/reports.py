"""Registered report queries (R01-R09, R14, U01, U02) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotbook.plans import reports as R
from slotbook.registry import catalog, register


@register("list_cities", """SELECT id, name FROM city""")
def q_list_cities(spark, sf_dir):
    return R.list_cities(catalog(spark, sf_dir).city)


@register("list_package_types", """SELECT id, name FROM package_type""")
def q_list_package_types(spark, sf_dir):
    return R.list_package_types(catalog(spark, sf_dir).package_type)


_ONGOING_ADMIN_SQL = """
SELECT pa.admin_user_id AS {admin_user_id}, b.id AS {booking_id}, pt.name AS {package_type_name},
       u.username AS {member_username}, p.price AS {package_price}, b.order_status AS {order_status},
       b.created_at + INTERVAL 2 HOUR AS {expires_at}, b.created_at AS {created_at}
FROM booking b
JOIN users u ON u.id = b.member_user_id
JOIN package p ON p.id = b.package_id
JOIN package_type pt ON pt.id = p.package_type_id
JOIN place_admin pa ON pa.place_id = p.place_id
WHERE b.order_status = 'PENDING'"""
_SNAKE = {k: k for k in ("admin_user_id", "booking_id", "package_type_name", "member_username",
                         "package_price", "order_status", "expires_at", "created_at")}
_CAMEL = {"admin_user_id": '"adminUserId"', "booking_id": '"bookingId"',
          "package_type_name": '"packageTypeName"', "member_username": '"memberUsername"',
          "package_price": '"packagePrice"', "order_status": '"orderStatus"',
          "expires_at": '"expiresAt"', "created_at": '"createdAt"'}


@register("ongoing_by_admin", _ONGOING_ADMIN_SQL.format(**_SNAKE))
def q_ongoing_by_admin(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return R.ongoing_by_admin(t.booking, t.users, t.package, t.package_type, t.place_admin)


@register("ongoing_by_member", """
SELECT b.member_user_id, b.id AS booking_id, p.name AS package_name, pl.name AS place_name,
       c.name AS city_name, b.created_at + INTERVAL 2 HOUR AS expires_at, b.created_at
FROM booking b
JOIN package p ON p.id = b.package_id
JOIN place pl ON pl.id = p.place_id
JOIN city c ON c.id = pl.city_id
WHERE b.order_status = 'PENDING'""")
def q_ongoing_by_member(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return R.ongoing_by_member(t.booking, t.package, t.place, t.city)


@register("booking_detail", """
WITH req AS (SELECT o_orderkey AS booking_id FROM orders),
j AS (
  SELECT r.booking_id, b.id AS found, p.name AS package_name, p.price AS package_price,
         pt.name AS package_type_name, u.username AS member_username, u.gender AS member_gender,
         u.email AS member_email, b.created_at,
         CASE WHEN r.booking_id IS NULL THEN '1023'
              WHEN b.id IS NULL THEN '1024'
              WHEN p.id IS NULL OR pt.id IS NULL OR u.id IS NULL THEN '1000'
              ELSE '0000' END AS reason_code
  FROM req r
  LEFT JOIN booking b ON b.id = r.booking_id
  LEFT JOIN package p ON p.id = b.package_id
  LEFT JOIN package_type pt ON pt.id = p.package_type_id
  LEFT JOIN users u ON u.id = b.member_user_id)
SELECT booking_id, reason_code,
       CASE WHEN reason_code = '0000' THEN package_type_name END AS package_type_name,
       CASE WHEN reason_code = '0000' THEN package_name END AS package_name,
       CASE WHEN reason_code = '0000' THEN package_price END AS package_price,
       CASE WHEN reason_code = '0000' THEN member_username END AS member_username,
       CASE WHEN reason_code = '0000' THEN member_gender END AS member_gender,
       CASE WHEN reason_code = '0000' THEN member_email END AS member_email,
       CASE WHEN reason_code = '0000' THEN created_at + INTERVAL 2 HOUR END AS expires_at,
       CASE WHEN reason_code = '0000' THEN created_at END AS created_at
FROM j""")
def q_booking_detail(spark, sf_dir):
    t = catalog(spark, sf_dir)
    ids = t.raw("orders").select(F.col("o_orderkey").alias("booking_id"))
    return R.booking_detail(ids, t.booking, t.package, t.package_type, t.users)


_LOG_SQL = """
SELECT pa.admin_user_id, b.id AS booking_id, u.email AS member_email, u.username AS member_username,
       u.gender AS member_gender, pt.name AS package_type_name, p.name AS package_name,
       p.price AS package_price, b.order_status, b.created_at + INTERVAL 2 HOUR AS expires_at,
       b.created_at
FROM booking b
JOIN package p ON p.id = b.package_id
JOIN package_type pt ON pt.id = p.package_type_id
JOIN place_admin pa ON pa.place_id = p.place_id
JOIN users u ON u.id = b.member_user_id"""


@register("booking_log", _LOG_SQL)
def q_booking_log(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return R.booking_log(t.booking, t.package, t.package_type, t.place_admin, t.users)


@register("profit_by_day", """
SELECT CAST(CAST(b.created_at AS DATE) AS VARCHAR) AS created_at, CAST(sum(p.price) AS INT) AS profit
FROM booking b JOIN package p ON p.id = b.package_id
WHERE b.order_status = 'COMPLETED'
GROUP BY CAST(b.created_at AS DATE)""")
def q_profit_by_day(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return R.profit_by_day(t.booking, t.package)


@register("member_order_counts", """
WITH grain AS (SELECT member_user_id, order_status, CAST(count(*) AS INT) AS n
               FROM booking GROUP BY ALL),
members AS (SELECT * FROM users WHERE role = 'MEMBER')
SELECT m.id AS member_user_id, m.username AS member_username, m.email AS member_email,
       CAST(if(g.order_status = 'EXPIRED', g.n, 0) AS INT) AS expired_order_count,
       CAST(if(g.order_status = 'COMPLETED', g.n, 0) AS INT) AS completed_order_count,
       m.ban_status AS member_ban_status, m.created_at AS member_created_at
FROM members m LEFT JOIN grain g ON g.member_user_id = m.id""")
def q_member_order_counts(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return R.member_order_counts(t.users, t.booking)


@register("member_order_rollup", """
WITH expired AS (SELECT member_user_id, count(*) AS n FROM booking WHERE order_status = 'EXPIRED' GROUP BY ALL),
completed AS (SELECT member_user_id, count(*) AS n FROM booking WHERE order_status = 'COMPLETED' GROUP BY ALL)
SELECT u.id AS member_user_id, u.username AS member_username, u.email AS member_email,
       CAST(COALESCE(e.n, 0) AS INT) AS expired_order_count,
       CAST(COALESCE(d.n, 0) AS INT) AS completed_order_count,
       u.ban_status AS member_ban_status, u.created_at AS member_created_at
FROM users u
LEFT JOIN expired e ON e.member_user_id = u.id
LEFT JOIN completed d ON d.member_user_id = u.id
WHERE u.role = 'MEMBER'""")
def q_member_order_rollup(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return R.member_order_rollup(t.users, t.booking)


@register("pending_ban_requests", """SELECT * FROM member_ban WHERE approval_status = 'PENDING'""")
def q_pending_ban_requests(spark, sf_dir):
    return R.pending_ban_requests(catalog(spark, sf_dir).member_ban)


@register("paged_bookings", _LOG_SQL + """
ORDER BY created_at DESC, booking_id, admin_user_id
LIMIT 15 OFFSET 30""")
def q_paged_bookings(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return R.paged_booking_log(t.booking, t.package, t.package_type, t.place_admin, t.users,
                               page_no=3, limit=15)


@register("camel_bookings", _ONGOING_ADMIN_SQL.format(**_CAMEL))
def q_camel_bookings(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return R.camel_ongoing_by_admin(t.booking, t.users, t.package, t.package_type, t.place_admin)


@register("member_order_counts_page", """
SELECT u.id AS member_user_id, u.username AS member_username, u.email AS member_email,
       CAST(count(b.order_status) FILTER (WHERE b.order_status = 'EXPIRED') AS INT) AS expired_order_count,
       CAST(count(b.order_status) FILTER (WHERE b.order_status = 'COMPLETED') AS INT) AS completed_order_count,
       u.ban_status AS member_ban_status, u.created_at AS member_created_at
FROM users u LEFT JOIN booking b ON b.member_user_id = u.id
WHERE u.role = 'MEMBER'
GROUP BY u.id, u.username, u.email, b.order_status, u.ban_status, u.created_at
ORDER BY u.created_at DESC NULLS FIRST, u.id, b.order_status NULLS FIRST
LIMIT 15""")
def q_member_order_counts_page(spark, sf_dir):
    """R08 as the source serves it: page 1 of 15, newest member first (nulls first)."""
    t = catalog(spark, sf_dir)
    return R.member_order_counts(t.users, t.booking, page=1, limit=15)
