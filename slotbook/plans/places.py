"""Place listings, place details and the capacity audit.

Aggregates are computed *before* they meet the place table: the admin count
per place, the PENDING count per package and the package capacity per place
are each folded by a partial hash aggregate, so a popular place or package is
reduced map-side and every join carries one row per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotbook import constants as C
from slotbook.functions import validate as V
from slotbook.functions.paging import page as take_page
from slotbook.operators.patterns import like_any
from slotbook.session import cut_lineage

#: Callers and places of one block of ``places_for_callers``, and the blocks of one task (4 Mi rows at most, about).
SIDE, TASK_BLOCKS = 512, 16


def city_filter(city_col: Column, patterns: Sequence[str] | None) -> Column:
    """``CAST(city_id AS STRING) LIKE ANY (patterns)``; ``None`` keeps every city.

    ``%`` and ``_`` are wildcards, ``\\`` escapes them.  An empty list is an
    error (the source application cannot express it either).
    """
    if patterns is None:
        return F.lit(True)
    if len(patterns) == 0:
        raise ValueError(f"reason {C.PLACE_LIST_BAD_CITY_IDS}: no city id pattern given")
    text = city_col.cast("string")
    return reduce(lambda a, b: a | b, [text.like(p) for p in patterns])


def _admin_counts(place_admin: DataFrame) -> DataFrame:
    return (place_admin.groupBy("place_id")
            .agg(F.count("admin_user_id").cast("int").alias("admin_count")))


def _pending_capacity_per_place(package: DataFrame, booking: DataFrame | None,
                                counts: DataFrame | None = None) -> DataFrame:
    """Per place: sum of package capacity over its PENDING bookings, and booking count."""
    if counts is None:
        per_pkg = (booking.groupBy(F.col("package_id"))
                   .agg(F.count(F.lit(1)).alias("n_all"),
                        F.count_if(F.col("order_status") == C.ORDER_PENDING).alias("n_pending")))
    else:
        pending = F.when(F.col("order_status") == C.ORDER_PENDING, F.col("n")).otherwise(0)
        per_pkg = counts.groupBy("package_id").agg(F.sum("n").alias("n_all"), F.sum(pending).alias("n_pending"))
    pk = package.select(F.col("id").alias("package_id"), "place_id", "capacity")
    return (pk.join(per_pkg, "package_id")
            .groupBy("place_id")
            .agg(F.sum(F.col("capacity") * F.col("n_pending")).cast("int").alias("pending_capacity"),
                 F.sum("n_all").alias("n_bookings")))


# --- R10 ---------------------------------------------------------------------------
def places_owner_view(place: DataFrame, place_admin: DataFrame,
                      city_patterns: Sequence[str] | None = None, page: int | None = None,
                      limit: int = C.DEFAULT_LIMIT, page_first: bool = False,
                      owner_id=None) -> DataFrame:
    """Places in the matching cities with their admin count; places without admins drop out.

    ``page_first=True`` reproduces the source's "page the place table, then
    join and filter" order (pages over place id); the default filters first.
    ``owner_id`` narrows the list to one owner's places (the source lists all).
    """
    p = place if owner_id is None else place.filter(F.col("owner_user_id") == F.lit(owner_id))
    if page_first and page is not None:
        p = take_page(p, ["id"], page, limit)
    out = (p.filter(city_filter(F.col("city_id"), city_patterns))
           .join(_admin_counts(place_admin).withColumnRenamed("place_id", "id"), "id")
           .select("id", "name", "max_capacity", "admin_count", "address"))
    return out if page_first else take_page(out, ["id"], page, limit)


def places_for_callers(place: DataFrame, place_admin: DataFrame, patterns: DataFrame) -> DataFrame:
    """R10 for every caller at once: ``patterns`` (caller_id, pattern) holds each caller's city patterns, and
    a caller sees a place once if its city matches any of them (``operators.patterns``).

    The result grows with callers times places, and there are few cities.  A city's callers and places are
    therefore dealt into blocks of about ``SIDE`` by ``SIDE``, and tasks are made by the number of rows they
    will put out: more rows give more tasks, not longer ones."""
    city = F.col("city_id").cast("string").alias("__city")
    seen = cut_lineage(like_any(place.select(city), "__city", patterns, "caller_id"))
    listed = (place.select("id", "name", "max_capacity", "address", city)
              .join(_admin_counts(place_admin).withColumnRenamed("place_id", "id"), "id"))
    a, b = (F.ceil(F.col(n) / SIDE).cast("int") for n in ("__callers", "__places"))
    sides = (seen.groupBy("__city").agg(F.count(F.lit(1)).alias("__callers"))
             .join(listed.groupBy("__city").agg(F.count(F.lit(1)).alias("__places")), "__city")
             .select("__city", a.alias("__a"), b.alias("__b")))
    blocks = sides.agg(F.sum(F.col("__a").cast("long") * F.col("__b"))).first()[0] or 1
    tasks = -(-blocks // TASK_BLOCKS)

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        return (df.join(sides, "__city")
                .withColumn(f"{own}k", F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
                .withColumn(f"{other}k", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                .drop("__a", "__b").repartition(tasks, "__city", "__ak", "__bk"))

    met = dealt(seen, "caller_id", "__a", "__b").join(dealt(listed, "id", "__b", "__a").hint("shuffle_hash"), ["__city", "__ak", "__bk"])
    return met.select("caller_id", "id", "name", "max_capacity", "admin_count", "address")


# --- R11 ---------------------------------------------------------------------------
def places_member_view(place: DataFrame, package: DataFrame, booking: DataFrame, city: DataFrame,
                       city_patterns: Sequence[str] | None = None, page: int | None = None,
                       limit: int = C.DEFAULT_LIMIT, page_first: bool = False,
                       counts: DataFrame | None = None) -> DataFrame:
    """Places with current occupancy (capacity summed once per PENDING booking).

    Places without packages or bookings are kept with 0.  ``counts`` (package_id, order_status, n), kept
    up to date elsewhere (``operators.changes``), stands in for the booking table.
    """
    p = place
    if page_first and page is not None:
        p = take_page(place, ["id"], page, limit)
    occ = _pending_capacity_per_place(package, booking, counts).withColumnRenamed("place_id", "id")
    ct = city.select(F.col("id").alias("city_id"), F.col("name").alias("city_name"))
    out = (p.filter(city_filter(F.col("city_id"), city_patterns))
           .join(ct, "city_id")
           .join(occ, "id", "left")
           .select("id", "name",
                   F.coalesce(F.col("pending_capacity"), F.lit(0)).alias("current_capacity"),
                   "max_capacity", "city_name", "address"))
    return out if page_first else take_page(out, ["id"], page, limit)


def _detail_code(id_kind: str) -> Column:
    return (F.when(~V.passes(V.valid_id(F.col("place_id"), id_kind)), C.PLACE_DETAIL_BAD_ID)
            .when(F.col("_found").isNull(), C.PLACE_DETAIL_NOT_FOUND).otherwise(C.OK))


# --- R12 ---------------------------------------------------------------------------
def place_detail_owner(place: DataFrame, place_admin: DataFrame, users: DataFrame,
                       place_ids: DataFrame, nested: bool = False, admin_id=None,
                       id_kind: str = "key") -> DataFrame:
    """Header (as R10) of each requested place (column ``place_id``) plus its admins.

    Flat form (default): one row per (place, admin), header repeated; a place
    that is missing or has no admin gives one row with reason 1012.  The flat
    form is a join, so a place with very many admins is spread over tasks.
    ``nested=True`` returns one row per place with an ``admins`` array sorted by
    id; use it for scoped requests, it gathers each place's admins in one row.
    ``admin_id`` gives an admin the detail of the place they manage only
    (other requested places are "not found").  A malformed place id gives 1043.
    """
    if admin_id is not None:
        managed = place_admin.filter(F.col("admin_user_id") == F.lit(admin_id)).select("place_id")
        place = place.join(managed.withColumnRenamed("place_id", "id"), "id", "left_semi")
    header = (place.join(_admin_counts(place_admin).withColumnRenamed("place_id", "id"), "id")
              .select(F.col("id").alias("place_id"), "name", "max_capacity", "admin_count",
                      "address", F.lit(True).alias("_found")))
    admins = (place_admin.join(users.select(F.col("id").alias("admin_user_id"), "fullname",
                                            "username", "is_active", "created_at"),
                               "admin_user_id")
              .select("place_id", F.col("admin_user_id").alias("admin_id"),
                      F.col("fullname").alias("admin_fullname"),
                      F.col("username").alias("admin_username"),
                      F.col("is_active").alias("admin_is_active"),
                      F.col("created_at").alias("admin_created_at")))
    req = place_ids.select("place_id").join(header, "place_id", "left")
    req = req.withColumn("reason_code", _detail_code(id_kind)).drop("_found")
    if nested:
        packed = (admins.join(req.filter(F.col("reason_code") == C.OK).select("place_id").distinct(), "place_id", "left_semi").groupBy("place_id")
                  .agg(F.sort_array(F.collect_list(F.struct(
                      "admin_id", "admin_fullname", "admin_username", "admin_is_active",
                      "admin_created_at"))).alias("admins")))
        return req.join(packed, "place_id", "left").withColumn(
            "admins", F.when(F.col("reason_code") == C.OK, F.col("admins")))
    # One pass: a found place has at least one admin (its header needs one),
    # and a missing place keeps its single row through the outer join.
    a = admins.withColumnRenamed("place_id", "__pid")
    j = req.join(a, (F.col("place_id") == F.col("__pid")) & (F.col("reason_code") == C.OK), "left")
    return j.drop("__pid")


# --- R13 ---------------------------------------------------------------------------
def place_detail_member(place: DataFrame, package: DataFrame, booking: DataFrame, city: DataFrame,
                        place_ids: DataFrame, keep_empty: bool = False,
                        id_kind: str = "key", nested: bool = False) -> DataFrame:
    """Header (as R11) of each requested place plus its packages, one row per package.

    ``nested=True`` returns one row per place with a ``packages`` array sorted by id; use it for scoped
    requests, it gathers each place's packages in one row (the flat form is a join).

    Faithful: the header uses inner joins, so a place none of whose packages has
    a booking is "not found" (1012); ``keep_empty=True`` keeps it with 0.  A
    malformed place id gives 1043.
    """
    occ = _pending_capacity_per_place(package, booking)
    ct = city.select(F.col("id").alias("city_id"), F.col("name").alias("city_name"))
    hdr = place.select(F.col("id").alias("place_id"), "name", "max_capacity", "address", "city_id")
    hdr = hdr.join(ct, "city_id").join(occ, "place_id", "left" if keep_empty else "inner")
    hdr = hdr.select("place_id", "name",
                     F.coalesce(F.col("pending_capacity"), F.lit(0)).alias("current_capacity"),
                     "max_capacity", "city_name", "address", F.lit(True).alias("_found"))
    pk = package.select("place_id", F.col("id").alias("package_id"),
                        F.col("name").alias("package_name"), F.col("capacity").alias("package_capacity"),
                        F.col("price").alias("package_price"), "package_type_id")
    req = place_ids.select("place_id").join(hdr, "place_id", "left")
    req = req.withColumn("reason_code", _detail_code(id_kind)).drop("_found")
    if nested:
        packed = (pk.join(req.filter(F.col("reason_code") == C.OK).select("place_id").distinct(), "place_id", "left_semi").groupBy("place_id")
                  .agg(F.sort_array(F.collect_list(F.struct("package_id", "package_name", "package_capacity", "package_price",
                                                            "package_type_id"))).alias("packages")))
        return req.join(packed, "place_id", "left")
    p = pk.withColumnRenamed("place_id", "__pid")
    j = req.join(p, (F.col("place_id") == F.col("__pid")) & (F.col("reason_code") == C.OK), "left")
    return j.drop("__pid")


# --- M04 ---------------------------------------------------------------------------
def capacity_audit(place: DataFrame, package: DataFrame) -> DataFrame:
    """Places whose packages' total capacity already exceeds the place's max capacity."""
    per_place = (package.groupBy("place_id")
                 .agg(F.sum("capacity").cast("int").alias("package_capacity")))
    return (place.select(F.col("id").alias("place_id"), "name", "max_capacity")
            .join(per_place, "place_id", "left")
            .withColumn("package_capacity", F.coalesce(F.col("package_capacity"), F.lit(0)))
            .filter(F.col("package_capacity") > F.col("max_capacity"))
            .withColumn("over_by", F.col("package_capacity") - F.col("max_capacity")))
