"""Registered timelines (ban status, peak occupancy), reports refreshed by change sets, and place
lists of all callers at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotbook import constants as C
from slotbook.operators.changes import change_set, counted, recounted
from slotbook.operators.writes import apply_updates
from slotbook.plans import admission as M
from slotbook.plans import places as P
from slotbook.plans import reports as R
from slotbook.plans import timelines as T
from slotbook.registry import RAW_SQL, catalog, register

AS_OF = "2024-01-15 12:00:00"

# --- A04 / M09 ----------------------------------------------------------------------------
_HISTORY = """
ev AS (SELECT member_user_id AS m, created_at AS tm, id, 0 AS kind, 'PENDING' AS status,
              CASE WHEN approval_status = 'BANNED' THEN {'l': ban_lifted_at} END AS lift FROM member_ban WHERE created_at IS NOT NULL
       UNION ALL
       SELECT member_user_id, updated_at, id, 1, CASE WHEN approval_status = 'BANNED' THEN 'BANNED' ELSE 'ACTIVE' END, NULL
       FROM member_ban WHERE approval_status <> 'PENDING' AND updated_at IS NOT NULL AND created_at IS NOT NULL
       UNION ALL
       SELECT member_user_id, ban_lifted_at, id, 2, NULL, NULL FROM member_ban
       WHERE approval_status = 'BANNED' AND ban_lifted_at IS NOT NULL AND created_at IS NOT NULL),
seen AS (SELECT m, tm, id, kind, last_value(status IGNORE NULLS) OVER w AS status, last_value(lift IGNORE NULLS) OVER w AS lift
         FROM ev WINDOW w AS (PARTITION BY m ORDER BY tm, id, kind ROWS UNBOUNDED PRECEDING)),
inst AS (SELECT m, tm, CASE WHEN status = 'BANNED' AND lift.l <= tm THEN 'ACTIVE' ELSE status END AS status
         FROM seen QUALIFY row_number() OVER (PARTITION BY m, tm ORDER BY id DESC, kind DESC) = 1),
steps AS (SELECT * FROM inst WHERE status IS NOT NULL
          QUALIFY lag(status) OVER (PARTITION BY m ORDER BY tm) IS DISTINCT FROM status)"""


@register("ban_status_history", f"""
WITH {_HISTORY}
SELECT m AS member_user_id, status AS ban_status, tm AS valid_from, lead(tm) OVER (PARTITION BY m ORDER BY tm) AS valid_to
FROM steps""")
def q_ban_status_history(spark, sf_dir):
    return T.ban_status_history(catalog(spark, sf_dir).member_ban)


# The status at one instant, from the records themselves: the last event so far, and A04's rule.
@register("ban_status_at", f"""
WITH ev AS (SELECT member_user_id AS m, created_at AS tm, id, 0 AS kind, 'PENDING' AS status FROM member_ban
            UNION ALL SELECT member_user_id, updated_at, id, 1, CASE WHEN approval_status = 'BANNED' THEN 'BANNED' ELSE 'ACTIVE' END
            FROM member_ban WHERE approval_status <> 'PENDING' AND updated_at IS NOT NULL),
s AS (SELECT m, arg_max(status, {{'tm': tm, 'id': id, 'kind': kind}}) AS status FROM ev WHERE tm <= TIMESTAMP '{AS_OF}' GROUP BY m),
b AS (SELECT member_user_id AS m, ban_lifted_at FROM member_ban WHERE approval_status = 'BANNED' AND created_at <= TIMESTAMP '{AS_OF}'
      QUALIFY row_number() OVER (PARTITION BY member_user_id ORDER BY created_at DESC, id DESC) = 1)
SELECT s.m AS member_user_id, CASE WHEN status = 'BANNED' AND b.ban_lifted_at <= TIMESTAMP '{AS_OF}' THEN 'ACTIVE' ELSE status END AS ban_status
FROM s LEFT JOIN b ON b.m = s.m""")
def q_ban_status_at(spark, sf_dir):
    return T.ban_status_at(T.ban_status_history(catalog(spark, sf_dir).member_ban), AS_OF)


# --- 1021: peaks ----------------------------------------------------------------------------
def _peak_sql(spans: str, key: str) -> str:
    """Counts the open spans at every start, pair by pair."""
    return f"""
spans AS ({spans}),
n AS (SELECT a.{key}, a.created_at, count(*) AS level FROM (SELECT DISTINCT {key}, created_at FROM spans) a
      JOIN spans b ON b.{key} = a.{key} AND b.created_at <= a.created_at AND (b.ended_at IS NULL OR b.ended_at > a.created_at)
      GROUP BY a.{key}, a.created_at),
peaks AS (SELECT {key}, level AS peak, created_at AS peak_at FROM n
          QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY level DESC, created_at) = 1)"""


@register("package_peaks", f"""
WITH {_peak_sql("SELECT package_id, created_at, updated_at AS ended_at FROM booking WHERE updated_at IS NULL OR updated_at > created_at", "package_id")}
SELECT package_id, place_id, capacity, peak, peak_at, peak >= capacity AS filled FROM peaks JOIN package p ON p.id = package_id""")
def q_package_peaks(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return T.package_peaks(t.booking, t.package)


_LAPSED = """SELECT p.place_id, created_at, least(coalesce(updated_at, created_at + INTERVAL 2 HOUR), created_at + INTERVAL 2 HOUR) AS ended_at
             FROM booking b JOIN package p ON p.id = b.package_id"""


@register("place_peaks", f"""
WITH {_peak_sql(f"SELECT * FROM ({_LAPSED}) WHERE ended_at > created_at", "place_id")}
SELECT place_id, max_capacity, peak, peak_at FROM peaks JOIN place p ON p.id = place_id""")
def q_place_peaks(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return T.place_peaks(t.booking, t.package, t.place)


# --- W01 -> R08, R09, R11 ---------------------------------------------------------------------
# The reports on the booking table after M02: from stored counts of the old version and the
# change set, against a full computation on the new version.
def _refreshed(t, by):
    d = M.transition_bookings(t.transition_request, t.booking, t.package, t.place, t.place_admin)
    upd = (d.filter(F.col("reason_code") == C.OK)
           .select(F.col("booking_id").alias("id"), "order_status", "updated_at"))
    new = apply_updates(t.booking, upd, ["id"], ["order_status", "updated_at"], policy="error")
    return recounted(counted(t.booking, by), change_set(t.booking, new, ["id"]), by)


def _on_new_version(key: str) -> str:
    return (f"WITH new_booking AS (SELECT id, order_status, member_user_id, package_id, updated_at, created_at FROM "
            f"({RAW_SQL['bookings_after_transitions']}) v)\nSELECT * FROM ({_swapped(RAW_SQL[key])}) r")


def _swapped(sql: str) -> str:
    return " ".join("new_booking" if w == "booking" else w for w in sql.replace("\n", " ").split(" "))


@register("member_order_counts_refreshed", _on_new_version("member_order_counts"))
def q_member_order_counts_refreshed(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return R.member_order_counts(t.users, None, counts=_refreshed(t, ["member_user_id", "order_status"]))


@register("member_order_rollup_refreshed", _on_new_version("member_order_rollup"))
def q_member_order_rollup_refreshed(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return R.member_order_rollup(t.users, None, counts=_refreshed(t, ["member_user_id", "order_status"]))


@register("places_member_view_refreshed", _on_new_version("places_member_view"))
def q_places_member_view_refreshed(spark, sf_dir):
    from slotbook.queries.places import CITY_PATTERNS

    t = catalog(spark, sf_dir)
    return P.places_member_view(t.place, t.package, None, t.city, CITY_PATTERNS, counts=_refreshed(t, ["package_id", "order_status"]))


# --- R10 for all callers ------------------------------------------------------------------------
# Every owner of a supplier's row asks with patterns of every kind.
_PATTERNS = [("CAST(s_suppkey % 25 AS VARCHAR)", "s_suppkey % 2 = 0"), ("concat(CAST(s_suppkey % 3 AS VARCHAR), '%')", "s_suppkey % 3 = 0"),
             ("concat('%', CAST(s_suppkey % 10 AS VARCHAR))", "s_suppkey % 5 < 2"), ("concat('_', CAST(s_suppkey % 10 AS VARCHAR))", "s_suppkey % 4 = 1"),
             ("concat('%', CAST(s_suppkey % 10 AS VARCHAR), '%')", "s_suppkey % 7 = 0"), ("'_'", "s_suppkey % 11 = 0"), ("'%'", "s_suppkey % 13 = 0"),
             ("concat(CAST(s_suppkey % 10 AS VARCHAR), '\\_')", "s_suppkey % 6 = 5"), ("'1_%'", "s_suppkey % 9 = 4")]


def _patterns_sql(text: str) -> str:
    return " UNION ALL ".join(f"SELECT s_suppkey AS caller_id, {p} AS pattern FROM {text} WHERE {w}" for p, w in _PATTERNS)


@register("places_for_callers", f"""
WITH asked AS ({_patterns_sql('supplier')}),
counts AS (SELECT place_id, CAST(count(admin_user_id) AS INT) AS admin_count FROM place_admin GROUP BY place_id)
SELECT DISTINCT a.caller_id, p.id, p.name, p.max_capacity, c.admin_count, p.address
FROM asked a JOIN place p ON CAST(p.city_id AS VARCHAR) LIKE a.pattern ESCAPE '\\' JOIN counts c ON c.place_id = p.id""")
def q_places_for_callers(spark, sf_dir):
    t = catalog(spark, sf_dir)
    supplier = t.raw("supplier")
    asked = [supplier.filter(F.expr(w)).select(F.col("s_suppkey").alias("caller_id"), F.expr(p.replace("\\", "\\\\").replace("VARCHAR", "STRING")).alias("pattern"))
             for p, w in _PATTERNS]
    every = asked[0]
    for a in asked[1:]:
        every = every.unionByName(a)
    return P.places_for_callers(t.place, t.place_admin, every)
