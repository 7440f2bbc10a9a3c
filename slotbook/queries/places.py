"""Registered place queries (R10-R13, M04) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotbook.plans import places as P
from slotbook.registry import RAW_SQL, catalog, register

# City-id patterns of the listing queries: '%' and '_' wildcards plus a plain id.
CITY_PATTERNS = ["1%", "2_", "7"]
_LIKE = " OR ".join(f"CAST(p.city_id AS VARCHAR) LIKE '{p}'" for p in CITY_PATTERNS)

_ADMIN_COUNT = """(SELECT DISTINCT place_id, count(*) OVER (PARTITION BY place_id) AS admin_count
                   FROM place_admin)"""

# Bookings per package first, then capacity taken per place; places with a booking only.
_TAKEN = """waiting AS (SELECT package_id, count(*) AS n_all, sum(CAST(order_status = 'PENDING' AS INT)) AS n
            FROM booking GROUP BY package_id),
taken AS (SELECT pk.place_id, CAST(sum(pk.capacity * w.n) AS INT) AS capacity
          FROM waiting w JOIN package pk ON pk.id = w.package_id GROUP BY pk.place_id)"""


@register("places_owner_view", f"""
SELECT p.id, p.name, p.max_capacity, CAST(a.admin_count AS INT) AS admin_count, p.address
FROM place p JOIN {_ADMIN_COUNT} a ON a.place_id = p.id
WHERE {_LIKE}""")
def q_places_owner_view(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return P.places_owner_view(t.place, t.place_admin, CITY_PATTERNS)


@register("places_member_view", f"""
WITH {_TAKEN}
SELECT p.id, p.name, COALESCE(s.capacity, 0) AS current_capacity, p.max_capacity, c.name AS city_name, p.address
FROM city c JOIN place p ON p.city_id = c.id LEFT JOIN taken s ON s.place_id = p.id
WHERE {_LIKE}""")
def q_places_member_view(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return P.places_member_view(t.place, t.package, t.booking, t.city, CITY_PATTERNS)


def _place_requests(t):
    """Requested place ids: every place id named by the package requests (some unknown), and none."""
    return t.package_request.select("place_id").union(t.spark.sql("SELECT CAST(NULL AS BIGINT)")).distinct()


@register("place_detail_owner", f"""
WITH req AS (SELECT place_id FROM package_request UNION SELECT NULL),
hdr AS (SELECT p.id AS place_id, p.name, p.max_capacity, CAST(a.admin_count AS INT) AS admin_count,
               p.address
        FROM place p JOIN {_ADMIN_COUNT} a ON a.place_id = p.id)
SELECT r.place_id, h.name, h.max_capacity, h.admin_count, h.address,
       CASE WHEN r.place_id IS NULL THEN '1043' WHEN h.place_id IS NULL THEN '1012' ELSE '0000' END AS reason_code,
       u.id AS admin_id, u.fullname AS admin_fullname, u.username AS admin_username,
       u.is_active AS admin_is_active, u.created_at AS admin_created_at
FROM req r
LEFT JOIN hdr h ON h.place_id = r.place_id
LEFT JOIN place_admin pa ON pa.place_id = h.place_id
LEFT JOIN users u ON u.id = pa.admin_user_id""")
def q_place_detail_owner(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return P.place_detail_owner(t.place, t.place_admin, t.users, _place_requests(t))


@register("place_detail_member", f"""
WITH req AS (SELECT place_id FROM package_request UNION SELECT NULL),
{_TAKEN},
hdr AS (SELECT s.place_id, p.name, s.capacity AS current_capacity, p.max_capacity, c.name AS city_name, p.address
        FROM taken s JOIN place p ON p.id = s.place_id JOIN city c ON c.id = p.city_id)
SELECT r.place_id, h.name, h.current_capacity, h.max_capacity, h.city_name, h.address,
       CASE WHEN r.place_id IS NULL THEN '1043' WHEN h.place_id IS NULL THEN '1012' ELSE '0000' END AS reason_code,
       pk.id AS package_id, pk.name AS package_name, pk.capacity AS package_capacity,
       pk.price AS package_price, pk.package_type_id
FROM req r
LEFT JOIN hdr h ON h.place_id = r.place_id
LEFT JOIN package pk ON pk.place_id = h.place_id""")
def q_place_detail_member(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return P.place_detail_member(t.place, t.package, t.booking, t.city, _place_requests(t))


# The nested forms, in the source's shape: one row a place with an array, here spelt out as text.
def _spelt(array: str, *fields: str):
    """The entries of an array of structs as text, in order."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws("|", *[x[f].cast("string") for f in fields])), ";")


def _spelt_sql(key: str, array_id: str, *fields: str) -> str:
    entry = ", ".join(f"CAST({f} AS VARCHAR)" for f in fields)
    return f"""
SELECT place_id, name, reason_code, count({array_id}) AS entries,
       string_agg(CASE WHEN {array_id} IS NOT NULL THEN concat_ws('|', {entry}) END, ';' ORDER BY {array_id}) AS entries_text
FROM ({RAW_SQL[key]}) f GROUP BY place_id, name, reason_code"""


_ADMIN_FIELDS = ("admin_id", "admin_fullname", "admin_username", "admin_is_active")
_PACKAGE_FIELDS = ("package_id", "package_name", "package_capacity", "package_price", "package_type_id")


@register("place_detail_owner_nested", _spelt_sql("place_detail_owner", "admin_id", *_ADMIN_FIELDS))
def q_place_detail_owner_nested(spark, sf_dir):
    t = catalog(spark, sf_dir)
    d = P.place_detail_owner(t.place, t.place_admin, t.users, _place_requests(t), nested=True)
    return d.select("place_id", "name", "reason_code", F.coalesce(F.size("admins"), F.lit(0)).cast("long").alias("entries"),
                    _spelt("admins", *_ADMIN_FIELDS).alias("entries_text"))


@register("place_detail_member_nested", _spelt_sql("place_detail_member", "package_id", *_PACKAGE_FIELDS))
def q_place_detail_member_nested(spark, sf_dir):
    t = catalog(spark, sf_dir)
    d = P.place_detail_member(t.place, t.package, t.booking, t.city, _place_requests(t), nested=True)
    return d.select("place_id", "name", "reason_code", F.coalesce(F.size("packages"), F.lit(0)).cast("long").alias("entries"),
                    _spelt("packages", *_PACKAGE_FIELDS).alias("entries_text"))


@register("capacity_audit", """
SELECT p.id AS place_id, p.name, p.max_capacity,
       COALESCE(CAST(s.total AS INT), 0) AS package_capacity,
       COALESCE(CAST(s.total AS INT), 0) - p.max_capacity AS over_by
FROM place p LEFT JOIN (SELECT place_id, sum(capacity) AS total FROM package GROUP BY place_id) s
  ON s.place_id = p.id
WHERE COALESCE(CAST(s.total AS INT), 0) > p.max_capacity""")
def q_capacity_audit(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return P.capacity_audit(t.place, t.package)
