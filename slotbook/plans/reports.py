"""Read reports over bookings, members and ban requests.

Every report covers all admins / members at once; the optional ``admin_id`` /
``member_id`` argument narrows it to one caller, as the source application's
per-request endpoints do.  Paging is optional (``page=None`` returns the whole
result) and always runs over an explicit total order.

Shapes chosen for scale:
* facts are pre-aggregated on their join key before they meet a dimension
  (profit, member counts), so the shuffle carries one row per key, not one row
  per booking, and a hot key is folded by the map-side partial aggregate;
* package, type, place, city and place admins are joined among themselves first, so
  a booking crosses the network once by member and once by package, and the
  row-multiplying join (booking x admins of its place) comes last;
* no explicit broadcast: AQE turns a join into a broadcast only when the
  runtime size of a side is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotbook import constants as C
from slotbook.functions.naming import camel_columns
from slotbook.functions.paging import page as take_page
from slotbook.functions.validate import valid_id

def _ttl():
    return F.expr(C.BOOKING_TTL)


# --- R01 / R02 -------------------------------------------------------------------
def list_cities(city: DataFrame, page: int | None = None, limit: int = C.DEFAULT_LIMIT) -> DataFrame:
    return take_page(city.select("id", "name"), ["id"], page, limit)


def list_package_types(package_type: DataFrame, page: int | None = None,
                       limit: int = C.DEFAULT_LIMIT) -> DataFrame:
    return take_page(package_type.select("id", "name"), ["id"], page, limit)


# --- R03 ---------------------------------------------------------------------------
def ongoing_by_admin(booking: DataFrame, users: DataFrame, package: DataFrame,
                     package_type: DataFrame, place_admin: DataFrame, admin_id=None,
                     page: int | None = None, limit: int = C.DEFAULT_LIMIT) -> DataFrame:
    """PENDING bookings at the places each admin manages (one row per admin x booking)."""
    b = (booking.filter(F.col("order_status") == C.ORDER_PENDING)
         .select(F.col("id").alias("booking_id"), "member_user_id", "package_id",
                 "order_status", "created_at"))
    pk = package.select(F.col("id").alias("package_id"), F.col("price").alias("package_price"),
                        "place_id", "package_type_id")
    pt = package_type.select(F.col("id").alias("package_type_id"),
                             F.col("name").alias("package_type_name"))
    u = users.select(F.col("id").alias("member_user_id"), F.col("username").alias("member_username"))
    pa = place_admin.select("admin_user_id", "place_id")
    if admin_id is not None:
        pa = pa.filter(F.col("admin_user_id") == F.lit(admin_id))
    out = (b.join(u, "member_user_id")
           .join(pk.join(pt, "package_type_id").join(pa, "place_id"), "package_id")
           .select("admin_user_id", "booking_id", "package_type_name", "member_username",
                   "package_price", "order_status",
                   (F.col("created_at") + _ttl()).alias("expires_at"), "created_at"))
    return take_page(out, ["admin_user_id", "booking_id"], page, limit)


# --- R04 ---------------------------------------------------------------------------
def ongoing_by_member(booking: DataFrame, package: DataFrame, place: DataFrame, city: DataFrame,
                      member_id=None, page: int | None = None,
                      limit: int = C.DEFAULT_LIMIT) -> DataFrame:
    """A member's PENDING bookings with package, place and city names."""
    b = booking.filter(F.col("order_status") == C.ORDER_PENDING)
    if member_id is not None:
        b = b.filter(F.col("member_user_id") == F.lit(member_id))
    b = b.select(F.col("id").alias("booking_id"), "member_user_id", "package_id", "created_at")
    pk = package.select(F.col("id").alias("package_id"), F.col("name").alias("package_name"),
                        "place_id")
    pl = place.select(F.col("id").alias("place_id"), F.col("name").alias("place_name"), "city_id")
    ct = city.select(F.col("id").alias("city_id"), F.col("name").alias("city_name"))
    out = (b.join(pk.join(pl.join(ct, "city_id"), "place_id"), "package_id")
           .select("member_user_id", "booking_id", "package_name", "place_name", "city_name",
                   (F.col("created_at") + _ttl()).alias("expires_at"), "created_at"))
    return take_page(out, ["member_user_id", "booking_id"], page, limit)


# --- R05 ---------------------------------------------------------------------------
def booking_detail(ids: DataFrame, booking: DataFrame, package: DataFrame,
                   package_type: DataFrame, users: DataFrame, id_kind: str = "key",
                   admin_id=None, place_admin: DataFrame | None = None) -> DataFrame:
    """Detail of every requested booking id (column ``booking_id``), with a reason code.

    1023 malformed id, 1024 no such booking, 1000 the booking exists but its
    package, type or member is missing (the source application fails the
    request there), 0000 found.  No status filter, as in the source.
    ``admin_id`` (with ``place_admin``) limits the lookup to bookings at the
    admin's place (others are 1024); the source does not check this.
    """
    if admin_id is not None:
        if place_admin is None:
            raise ValueError("admin_id needs the place_admin table")
        mine = place_admin.filter(F.col("admin_user_id") == F.lit(admin_id)).select("place_id")
        package = package.join(mine, "place_id", "left_semi")
        booking = booking.join(package.select(F.col("id").alias("package_id")), "package_id",
                               "left_semi")
    b = booking.select(F.col("id").alias("booking_id"), F.col("id").alias("_found"),
                       "member_user_id", "package_id", "created_at")
    pk = package.select(F.col("id").alias("package_id"), F.col("id").alias("_pk"),
                        F.col("name").alias("package_name"), F.col("price").alias("package_price"),
                        "package_type_id")
    pt = package_type.select(F.col("id").alias("package_type_id"), F.col("id").alias("_pt"),
                             F.col("name").alias("package_type_name"))
    u = users.select(F.col("id").alias("member_user_id"), F.col("id").alias("_u"),
                     F.col("username").alias("member_username"),
                     F.col("gender").alias("member_gender"), F.col("email").alias("member_email"))
    j = (ids.select("booking_id").join(b, "booking_id", "left")
         .join(pk.join(pt, "package_type_id", "left"), "package_id", "left")
         .join(u, "member_user_id", "left"))
    complete = F.col("_pk").isNotNull() & F.col("_pt").isNotNull() & F.col("_u").isNotNull()
    code = (F.when(~valid_id(F.col("booking_id"), id_kind), C.BOOKING_DETAIL_BAD_ID)
            .when(F.col("_found").isNull(), C.BOOKING_DETAIL_NOT_FOUND)
            .when(~complete, C.ERR_GENERAL).otherwise(C.OK))
    ok = code == C.OK

    def keep(c, name=None):
        return F.when(ok, F.col(c) if isinstance(c, str) else c).alias(name or c)

    return j.select("booking_id", code.alias("reason_code"),
                    keep("package_type_name"), keep("package_name"), keep("package_price"),
                    keep("member_username"), keep("member_gender"), keep("member_email"),
                    keep(F.col("created_at") + _ttl(), "expires_at"), keep("created_at"))


# --- R06 ---------------------------------------------------------------------------
def booking_log(booking: DataFrame, package: DataFrame, package_type: DataFrame,
                place_admin: DataFrame, users: DataFrame, admin_id=None,
                page: int | None = None, limit: int = C.DEFAULT_LIMIT) -> DataFrame:
    """Every booking (any status) at the places each admin manages."""
    b = booking.select(F.col("id").alias("booking_id"), "member_user_id", "package_id",
                       "order_status", "created_at")
    pk = package.select(F.col("id").alias("package_id"), F.col("name").alias("package_name"),
                        F.col("price").alias("package_price"), "place_id", "package_type_id")
    pt = package_type.select(F.col("id").alias("package_type_id"),
                             F.col("name").alias("package_type_name"))
    u = users.select(F.col("id").alias("member_user_id"), F.col("email").alias("member_email"),
                     F.col("username").alias("member_username"),
                     F.col("gender").alias("member_gender"))
    pa = place_admin.select("admin_user_id", "place_id")
    if admin_id is not None:
        pa = pa.filter(F.col("admin_user_id") == F.lit(admin_id))
    out = (b.join(u, "member_user_id")
           .join(pk.join(pt, "package_type_id").join(pa, "place_id"), "package_id")
           .select("admin_user_id", "booking_id", "member_email", "member_username",
                   "member_gender", "package_type_name", "package_name", "package_price",
                   "order_status", (F.col("created_at") + _ttl()).alias("expires_at"), "created_at"))
    return take_page(out, ["admin_user_id", "booking_id"], page, limit)


# --- R07 ---------------------------------------------------------------------------
def profit_by_day(booking: DataFrame, package: DataFrame, page: int | None = None,
                  limit: int = C.DEFAULT_LIMIT, place: DataFrame | None = None,
                  owner_id=None) -> DataFrame:
    """Sum of package price over COMPLETED bookings per calendar day of creation.

    The day is returned as text under the name ``created_at``; the sum is cast
    to int and overflows with an error, as ``::int`` does.  Bookings are first
    counted per (package, day): the map-side partial aggregate folds a hot
    package, and only one row per (package, day) meets the package table.
    ``owner_id`` (with ``place``) restricts the report to that owner's places;
    the source reports over all places.
    """
    if owner_id is not None:
        if place is None:
            raise ValueError("owner_id needs the place table")
        owned = place.filter(F.col("owner_user_id") == F.lit(owner_id)).select(
            F.col("id").alias("place_id"))
        package = package.join(owned, "place_id", "left_semi")
    per_pkg_day = (booking.filter(F.col("order_status") == C.ORDER_COMPLETED)
                   .groupBy("package_id", F.to_date("created_at").alias("day"))
                   .agg(F.count(F.lit(1)).alias("n")))
    priced = per_pkg_day.join(package.select(F.col("id").alias("package_id"), "price"), "package_id")
    out = (priced.groupBy("day")
           .agg(F.sum(F.col("price") * F.col("n")).cast("int").alias("profit"))
           .select(F.col("day").cast("string").alias("created_at"), "profit"))
    return take_page(out, ["created_at"], page, limit)


# --- R08 / R09 -------------------------------------------------------------------
def _per_member_status(booking: DataFrame) -> DataFrame:
    return (booking.groupBy(F.col("member_user_id"), "order_status")
            .agg(F.count("order_status").alias("n")))


def _members(users: DataFrame) -> DataFrame:
    return (users.filter(F.col("role") == C.ROLE_MEMBER)
            .select(F.col("id").alias("member_user_id"), F.col("username").alias("member_username"),
                    F.col("email").alias("member_email"),
                    F.col("ban_status").alias("member_ban_status"),
                    F.col("created_at").alias("member_created_at")))


def member_order_counts(users: DataFrame, booking: DataFrame | None, page: int | None = None,
                        limit: int = C.DEFAULT_LIMIT, counts: DataFrame | None = None) -> DataFrame:
    """Faithful grain: one row per member *and* order status (status not shown).

    A member with no booking keeps one 0/0 row.  Ordered newest member first
    (nulls first, as PostgreSQL sorts DESC), then id and status for a total order.
    ``counts`` (member_user_id, order_status, n), kept up to date elsewhere
    (``operators.changes``), stands in for the booking table.
    """
    s = _per_member_status(booking) if counts is None else counts
    out = (_members(users).join(s, "member_user_id", "left")
           .select("member_user_id", "member_username", "member_email",
                   F.when(F.col("order_status") == C.ORDER_EXPIRED, F.col("n")).otherwise(0)
                    .cast("int").alias("expired_order_count"),
                   F.when(F.col("order_status") == C.ORDER_COMPLETED, F.col("n")).otherwise(0)
                    .cast("int").alias("completed_order_count"),
                   "member_ban_status", "member_created_at", "order_status"))
    if page is not None:
        out = take_page(out, [F.col("member_created_at").desc_nulls_first(), "member_user_id",
                              F.col("order_status").asc_nulls_first()], page, limit)
    return out.drop("order_status")


def member_order_rollup(users: DataFrame, booking: DataFrame | None, page: int | None = None,
                        limit: int = C.DEFAULT_LIMIT, counts: DataFrame | None = None) -> DataFrame:
    """Intended grain: exactly one row per member with both counts.  ``counts`` as in
    ``member_order_counts``."""
    if counts is None:
        per_member = (booking.groupBy("member_user_id")
                      .agg(F.count_if(F.col("order_status") == C.ORDER_EXPIRED).alias("e"),
                           F.count_if(F.col("order_status") == C.ORDER_COMPLETED).alias("c")))
    else:
        per_member = counts.groupBy("member_user_id").agg(
            *[F.sum(F.when(F.col("order_status") == status, F.col("n")).otherwise(0)).alias(name)
              for status, name in ((C.ORDER_EXPIRED, "e"), (C.ORDER_COMPLETED, "c"))])
    out = (_members(users).join(per_member, "member_user_id", "left")
           .select("member_user_id", "member_username", "member_email",
                   F.coalesce(F.col("e"), F.lit(0)).cast("int").alias("expired_order_count"),
                   F.coalesce(F.col("c"), F.lit(0)).cast("int").alias("completed_order_count"),
                   "member_ban_status", "member_created_at"))
    return take_page(out, [F.col("member_created_at").desc_nulls_first(), "member_user_id"],
                     page, limit)


# --- R14 ---------------------------------------------------------------------------
def pending_ban_requests(member_ban: DataFrame, page: int | None = None,
                         limit: int = C.DEFAULT_LIMIT) -> DataFrame:
    out = member_ban.filter(F.col("approval_status") == C.BAN_APPROVAL_PENDING)
    return take_page(out, ["id"], page, limit)


# --- U01 / U02 -----------------------------------------------------------------------
def paged_booking_log(booking, package, package_type, place_admin, users, page_no: int = 3,
                      limit: int = C.DEFAULT_LIMIT) -> DataFrame:
    """One page of the booking log, newest first (TakeOrderedAndProject, no full sort)."""
    log = booking_log(booking, package, package_type, place_admin, users)
    return take_page(log, [F.col("created_at").desc(), "booking_id", "admin_user_id"],
                     page_no, limit)


def camel_ongoing_by_admin(*args, **kwargs) -> DataFrame:
    return camel_columns(ongoing_by_admin(*args, **kwargs))
