"""DuckDB-side definitions of the domain views (FIXTURES.md section 2).

The oracle SQL of every registered query is written against these views; the
driver only registers the raw tables, so ``with_views`` inlines the views a
query mentions as CTEs, dependencies first.
"""

from __future__ import annotations

import re

VIEW_SQL = {
    "city": """SELECT n_nationkey AS id, n_name AS name FROM nation""",
    "package_type": """SELECT DISTINCT p_type AS id, lower(p_type) AS name FROM part""",
    "place": """SELECT s_suppkey AS id,
        concat('Place ', translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'abcdefghij')) AS name,
        CAST(300 + (s_suppkey % 5) * 100 AS INT) AS max_capacity,
        concat('Street ', CAST(s_suppkey AS VARCHAR)) AS address,
        2000000 + s_suppkey % 3 AS owner_user_id, s_nationkey AS city_id
      FROM supplier""",
    "place_admin": """SELECT 1000000 + s_suppkey * 3 + k AS admin_user_id, s_suppkey AS place_id
      FROM supplier CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks
      WHERE k < s_suppkey % 4""",
    "package": """SELECT p_partkey AS id, p_name AS name, p_size AS capacity,
        CAST(floor(p_retailprice) AS INT) AS price,
        p_partkey % (SELECT count(*) FROM supplier) AS place_id, p_type AS package_type_id
      FROM part""",
    "booking": """SELECT o.o_orderkey AS id,
        CASE o.o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'COMPLETED' ELSE 'EXPIRED' END AS order_status,
        o.o_custkey AS member_user_id, l.package_id,
        CASE WHEN o.o_orderstatus <> 'P' THEN o.o_orderdate + INTERVAL 1 HOUR END AS updated_at,
        o.o_orderdate AS created_at
      FROM orders o
      LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS package_id FROM lineitem GROUP BY l_orderkey) l
        ON l.l_orderkey = o.o_orderkey""",
    "users": """SELECT c.c_custkey AS id,
        concat('Member ', translate(CAST(c.c_custkey AS VARCHAR), '0123456789', 'abcdefghij')) AS fullname,
        CASE WHEN c.c_custkey % 2 = 0 THEN 'MALE' ELSE 'FEMALE' END AS gender,
        lower(replace(c.c_name, '#', '')) AS username,
        concat(lower(replace(c.c_name, '#', '')), '@example.com') AS email,
        'MEMBER' AS role,
        CASE WHEN b.n > 0 THEN 'PENDING' ELSE 'ACTIVE' END AS ban_status,
        true AS is_active, f.created_at
      FROM customer c
      LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey) f
        ON f.o_custkey = c.c_custkey
      LEFT JOIN (SELECT user_id, count(*) AS n FROM events
                 WHERE event_type = 'error' AND event_id % 3 = 2 GROUP BY user_id) b
        ON b.user_id = c.c_custkey
      UNION ALL
      SELECT a.id, concat('Admin ', CAST(a.id AS VARCHAR)), 'MALE', concat('admin', CAST(a.id AS VARCHAR)),
        concat('admin', CAST(a.id AS VARCHAR), '@example.com'), 'ADMIN', 'ACTIVE', true, NULL
      FROM (SELECT 1000000 + s_suppkey * 3 + k AS id
            FROM supplier CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks
            WHERE k < s_suppkey % 4) a
      UNION ALL
      SELECT w.id, concat('Owner ', CAST(w.id AS VARCHAR)), 'FEMALE', concat('owner', CAST(w.id AS VARCHAR)),
        concat('owner', CAST(w.id AS VARCHAR), '@example.com'), 'OWNER', 'ACTIVE', true, NULL
      FROM (SELECT DISTINCT 2000000 + s_suppkey % 3 AS id FROM supplier) w
      UNION ALL
      SELECT -10 - s_suppkey, concat('Idle ', CAST(-10 - s_suppkey AS VARCHAR)), 'FEMALE',
        concat('idle', CAST(-10 - s_suppkey AS VARCHAR)),
        concat('idle', CAST(-10 - s_suppkey AS VARCHAR), '@example.com'), 'MEMBER', 'ACTIVE', true, NULL
      FROM supplier""",
    "member_ban": """SELECT event_id AS id, user_id AS member_user_id,
        CASE event_id % 3 WHEN 0 THEN 'BANNED' WHEN 1 THEN 'REVOKED' ELSE 'PENDING' END AS approval_status,
        concat('reason ', CAST(event_id % 7 AS VARCHAR)) AS ban_reason,
        CASE event_id % 3 WHEN 0 THEN ts + INTERVAL 3 DAYS WHEN 1 THEN ts END AS ban_lifted_at,
        CASE WHEN event_id % 3 < 2 THEN ts END AS updated_at, ts AS created_at
      FROM events WHERE event_type = 'error'""",
    "access_attempt": """SELECT event_id AS id,
        CASE WHEN event_id % 17 = 0 THEN -1 ELSE user_id END AS user_id,
        CASE WHEN event_id % 4 = 0 THEN 'ADMIN' ELSE 'MEMBER' END AS required_role,
        ts AS attempted_at
      FROM events WHERE event_type IN ('view', 'click')""",
    "live_booking": """SELECT event_id AS id, user_id AS member_user_id,
        event_id % (SELECT count(*) FROM part) AS package_id, 'PENDING' AS order_status, ts AS created_at
      FROM events WHERE event_type = 'click'""",
    "booking_request": """SELECT event_id AS id, user_id AS member_user_id,
        CASE WHEN event_id % 11 = 0 THEN -1 ELSE event_id % (SELECT count(*) FROM part) END AS package_id,
        ts AS requested_at
      FROM events WHERE event_type = 'purchase'""",
    "completion": """SELECT event_id AS id, user_id AS member_user_id, ts AS completed_at
      FROM events WHERE event_type = 'view'""",
    "transition_request": """SELECT b.id AS booking_id,
        CASE WHEN b.id % 13 = 0 THEN 'CANCELLED' WHEN b.id % 2 = 0 THEN 'COMPLETED' ELSE 'EXPIRED' END AS new_status,
        CASE WHEN b.id % 7 = 0 THEN 1000000
             ELSE 1000000 + (b.package_id % (SELECT count(*) FROM supplier)) * 3 END AS admin_user_id,
        b.created_at + INTERVAL 2 HOURS AS requested_at
      FROM booking b""",
    "package_request": """SELECT p_partkey AS id, p_partkey % (SELECT count(*) + 2 FROM supplier) AS place_id,
        CASE WHEN p_partkey % 9 = 0 THEN 'new 9' ELSE p_name END AS name,
        p_size AS capacity, CAST(floor(p_retailprice) AS INT) AS price,
        CASE WHEN p_partkey % 10 = 0 THEN 'NONE' ELSE p_type END AS package_type_id,
        1000000 + (p_partkey % (SELECT count(*) + 2 FROM supplier)) * 3 AS admin_user_id
      FROM part""",
    "place_request": """SELECT s_suppkey AS id,
        CASE WHEN s_suppkey % 5 = 0
               THEN concat('Place ', translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'abcdefghij'))
             WHEN s_suppkey % 5 = 1 THEN s_name ELSE 'New place' END AS name,
        concat('Street ', CAST(s_suppkey AS VARCHAR)) AS address,
        CAST(100 AS INT) AS max_capacity,
        CASE WHEN s_suppkey % 6 = 0 THEN -1 ELSE s_nationkey END AS city_id,
        CASE WHEN s_suppkey % 4 = 0 THEN 'Ann Lee;Bo Ray;Ann Lee' ELSE 'Ann Lee;Bo Ray;Cy Poe' END AS admin_names,
        2000000 AS owner_user_id
      FROM supplier""",
    "place_update": """SELECT CASE WHEN s_suppkey % 8 = 7 THEN -1 ELSE s_suppkey END AS id,
        CASE WHEN s_suppkey % 5 = 0 THEN 'Place a' ELSE 'Renamed place' END AS name,
        CASE WHEN s_suppkey % 5 = 0 THEN 'Street 0' ELSE concat('Road ', CAST(s_suppkey AS VARCHAR)) END AS address,
        CAST(300 + (s_suppkey % 5) * 100 + CASE WHEN s_suppkey % 3 = 0 THEN -50 ELSE 50 END AS INT) AS max_capacity
      FROM supplier""",
    "admin_entry": """SELECT place_id, CASE WHEN admin_user_id % 2 = 0 THEN admin_user_id END AS admin_user_id,
        CASE WHEN admin_user_id % 7 = 0 THEN '' ELSE 'Dee Fox' END AS fullname,
        concat('staff', CAST(admin_user_id AS VARCHAR)) AS username,
        admin_user_id % 3 > 0 AS is_active
      FROM place_admin""",
    "ban_request": """SELECT event_id AS id,
        CASE event_id % 9 WHEN 0 THEN -1 WHEN 1 THEN 1000003
             ELSE (event_id * 7) % (SELECT count(*) FROM customer) END AS member_user_id,
        CASE WHEN event_id % 8 = 0 THEN 'no show 3' ELSE 'no show' END AS ban_reason,
        1000003 AS admin_user_id, ts AS requested_at
      FROM events WHERE event_type = 'signup'""",
    "ban_decision": """SELECT CASE WHEN event_id % 10 = 0 THEN -1 ELSE event_id END AS ban_request_id,
        CASE WHEN event_id % 7 = 0 THEN 'MAYBE' WHEN event_id % 2 = 0 THEN 'BANNED' ELSE 'REVOKED' END AS decision,
        2000000 AS owner_user_id, ts + INTERVAL 1 HOUR AS decided_at
      FROM events WHERE event_type = 'error'""",
    "member_signup": """SELECT c_custkey AS id,
        concat('Member ', translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij')) AS fullname,
        CASE WHEN c_custkey % 11 = 0 THEN 'OTHER' ELSE 'MALE' END AS gender,
        CASE WHEN c_custkey % 4 = 0 THEN lower(replace(c_name, '#', ''))
             ELSE concat('new', CAST(c_custkey - c_custkey % 3 AS VARCHAR)) END AS username,
        CASE WHEN c_custkey % 13 = 0 THEN 'bad-email'
             ELSE concat('m', CAST(c_custkey AS VARCHAR), '@example.com') END AS email
      FROM customer""",
}

# Views that read other views.
_DEPENDS = {"transition_request": ("booking",), "admin_entry": ("place_admin",)}
_ORDER = list(VIEW_SQL)


def _mentioned(sql: str) -> set[str]:
    found = {v for v in VIEW_SQL if re.search(rf"(?<![\w.]){v}(?!\w)", sql)}
    for v in list(found):
        found.update(_DEPENDS.get(v, ()))
    return found


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every domain view it mentions."""
    body = sql.strip()
    needed = _mentioned(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{v} AS (\n{VIEW_SQL[v]}\n)" for v in _ORDER if v in needed)
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
