"""Registered streaming jobs (S01, S02) and their batch-equivalent oracle SQL."""

from __future__ import annotations

from slotbook.queries.reports import q_profit_by_day  # noqa: F401  (same result as S02)
from slotbook.queries.access import _LATEST_BAN
from slotbook.registry import ORACLE, register
from slotbook.streaming import gate, jobs

# S01 emits a booking once the global watermark (the smaller of the two
# inputs' max event times, minus the delay) has passed its 2-hour window.
_EXPIRY_SQL = """
WITH wm AS (SELECT least((SELECT max(created_at) FROM live_booking),
                         (SELECT max(completed_at) FROM completion)) - INTERVAL 1 HOUR AS w)
SELECT b.id AS booking_id, b.member_user_id, b.package_id, b.created_at,
       b.created_at + INTERVAL 2 HOUR AS expired_at, 'EXPIRED' AS order_status
FROM live_booking b
WHERE NOT EXISTS (SELECT 1 FROM completion c
                  WHERE c.member_user_id = b.member_user_id
                    AND c.completed_at >= b.created_at
                    AND c.completed_at < b.created_at + INTERVAL 2 HOUR)
  AND b.created_at + INTERVAL 2 HOUR < (SELECT w FROM wm)"""


@register("stream_expiry", _EXPIRY_SQL)
def q_stream_expiry(spark, sf_dir):
    return jobs.stream_expiry(spark, sf_dir)


# What is neither emitted nor completed by then.
@register("stream_expiry_open", _EXPIRY_SQL
          .replace("b.created_at + INTERVAL 2 HOUR AS expired_at, 'EXPIRED' AS order_status", "'PENDING' AS order_status")
          .replace("INTERVAL 2 HOUR < (SELECT w", "INTERVAL 2 HOUR >= (SELECT w"))
def q_stream_expiry_open(spark, sf_dir):
    return jobs.stream_expiry_open(spark, sf_dir)


@register("stream_profit")
def q_stream_profit(spark, sf_dir):
    return jobs.stream_profit(spark, sf_dir)


ORACLE["stream_profit"] = ORACLE["profit_by_day"]


# A01 behind the watermark: the latest event that either input holds, less the delay.
@register("stream_ban_gate", "WITH " + _LATEST_BAN.format(attempts="access_attempt") + """,
wm AS (SELECT date_trunc('millisecond', greatest((SELECT max(attempted_at) FROM access_attempt),
                                                 (SELECT max(created_at) FROM member_ban WHERE approval_status = 'BANNED'))) - INTERVAL 1 HOUR AS w)
SELECT id, user_id, attempted_at, latest_ban_id, latest_ban_lifted_at,
       CASE WHEN latest_ban_lifted_at > attempted_at THEN '9998' ELSE '0000' END AS reason_code
FROM g WHERE attempted_at < (SELECT w FROM wm)""")
def q_stream_ban_gate(spark, sf_dir):
    return gate.stream_ban_gate(spark, sf_dir)
