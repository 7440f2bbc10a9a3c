"""Registered access-gate queries (A01-A04) and their oracle SQL."""

from __future__ import annotations

from slotbook import constants as C
from slotbook.plans import access as A
from slotbook.plans import admission as M
from slotbook.registry import catalog, register

_LATEST_BAN = """
bans AS (SELECT member_user_id, id AS ban_id, ban_lifted_at, created_at
         FROM member_ban WHERE approval_status = 'BANNED'),
j AS (SELECT a.*, b.ban_id AS latest_ban_id, b.ban_lifted_at AS latest_ban_lifted_at,
             row_number() OVER (PARTITION BY a.id
                                ORDER BY b.created_at DESC NULLS LAST, b.ban_id DESC NULLS LAST) AS rn
      FROM {attempts} a
      LEFT JOIN bans b ON b.member_user_id = a.user_id AND b.created_at <= a.attempted_at),
g AS (SELECT * EXCLUDE (rn) FROM j WHERE rn = 1)"""


@register("ban_gate", "WITH " + _LATEST_BAN.format(attempts="access_attempt") + """
SELECT *, CASE WHEN latest_ban_lifted_at > attempted_at THEN '9998' ELSE '0000' END AS reason_code
FROM g""")
def q_ban_gate(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return A.ban_gate(t.access_attempt, t.member_ban)


_GATE_CODE = """CASE WHEN u.role IS NULL THEN '9999'
            WHEN g.latest_ban_lifted_at > g.attempted_at THEN '9998'
            WHEN NOT coalesce({allowed}, false) THEN '9999'
            ELSE '0000' END"""


@register("role_gate", "WITH " + _LATEST_BAN.format(attempts="access_attempt") + f"""
SELECT g.*, u.role AS user_role,
       {_GATE_CODE.format(allowed="u.role = g.required_role")} AS reason_code
FROM g LEFT JOIN users u ON u.id = g.user_id""")
def q_role_gate(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return A.role_gate(t.access_attempt, t.users, t.member_ban)


_OPS = ", ".join(f"'{op}'" for op, _ in C.ENDPOINT_ROLES)
_ROUTES = ", ".join(f"('{op}', '{','.join(roles)}')" for op, roles in C.ENDPOINT_ROLES)


@register("endpoint_roles", f"""
WITH att AS (SELECT *, ([{_OPS}])[CAST(id % {len(C.ENDPOINT_ROLES)} AS INT) + 1] AS operation
             FROM access_attempt),
routes(operation, roles) AS (VALUES {_ROUTES}),
""" + _LATEST_BAN.format(attempts="att") + f"""
SELECT g.*, u.role AS user_role,
       {_GATE_CODE.format(allowed="list_contains(string_split(r.roles, ','), u.role)")} AS reason_code
FROM g LEFT JOIN users u ON u.id = g.user_id LEFT JOIN routes r ON r.operation = g.operation""")
def q_endpoint_roles(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return A.endpoint_gate(A.with_operation(t.access_attempt), t.users, t.member_ban)


AS_OF = "2024-01-20 00:00:00"


def decided_state(t):
    """users and member_ban after applying the accepted ban decisions (M09 + W01)."""
    d = M.decide_ban_requests(t.ban_decision, t.member_ban)
    out = M.apply_ban_decisions(d, t.member_ban, t.users)
    return out["users"], out["member_ban"]


DECIDED_SQL = """
d AS ({decisions}),
acc AS (SELECT * FROM d WHERE reason_code = '0000'),
uu AS (SELECT member_user_id, user_ban_status FROM (
         SELECT *, row_number() OVER (PARTITION BY member_user_id
                                      ORDER BY decided_at DESC, user_ban_status DESC) AS rn FROM acc)
       WHERE rn = 1),
users2 AS (SELECT u.* REPLACE (CASE WHEN uu.member_user_id IS NOT NULL THEN uu.user_ban_status
                                    ELSE u.ban_status END AS ban_status)
           FROM users u LEFT JOIN uu ON uu.member_user_id = u.id),
bans2 AS (SELECT m.* REPLACE (
            CASE WHEN a.ban_request_id IS NOT NULL THEN a.approval_status ELSE m.approval_status END
              AS approval_status,
            CASE WHEN a.ban_request_id IS NOT NULL THEN a.ban_lifted_at ELSE m.ban_lifted_at END
              AS ban_lifted_at,
            CASE WHEN a.ban_request_id IS NOT NULL THEN a.decided_at ELSE m.updated_at END
              AS updated_at)
          FROM member_ban m LEFT JOIN acc a ON a.ban_request_id = m.id)"""


def _effective_sql():
    from slotbook.queries.admission import DECIDE_SQL
    return "WITH " + DECIDED_SQL.format(decisions=DECIDE_SQL) + f""",
latest AS (SELECT member_user_id, ban_lifted_at FROM (
             SELECT *, row_number() OVER (PARTITION BY member_user_id
                                          ORDER BY created_at DESC, id DESC) AS rn
             FROM bans2 WHERE approval_status = 'BANNED' AND created_at <= TIMESTAMP '{AS_OF}')
           WHERE rn = 1)
SELECT u.id, u.role, u.ban_status, l.ban_lifted_at,
       CASE WHEN u.ban_status = 'BANNED' AND l.ban_lifted_at <= TIMESTAMP '{AS_OF}' THEN 'ACTIVE'
            ELSE u.ban_status END AS effective_ban_status
FROM users2 u LEFT JOIN latest l ON l.member_user_id = u.id"""


def q_effective_ban_status(spark, sf_dir):
    t = catalog(spark, sf_dir)
    users2, bans2 = decided_state(t)
    return A.effective_ban_status(users2, bans2, AS_OF)


register("effective_ban_status", _effective_sql())(q_effective_ban_status)
