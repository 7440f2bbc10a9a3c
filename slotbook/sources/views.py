"""Domain tables of the booking marketplace, derived from the raw test tables.

``Catalog`` exposes the eight state tables (city, package_type, place,
place_admin, package, booking, users, member_ban) and the request tables the
rule-checked jobs consume.  Every view is a lazy DataFrame expression over the
parquet scans, so filters and projections of a downstream query reach the
scan.  Definitions follow FIXTURES.md section 2 column for column.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotbook import constants as C
from slotbook.sources.tables import read_table

_DIGITS, _LETTERS = "0123456789", "abcdefghij"


def _spelled(col: Column) -> Column:
    """Integer key spelled with letters (0 -> a, 1 -> b, ...), used in names."""
    return F.translate(col.cast("string"), _DIGITS, _LETTERS)


def _fanout(n: Column) -> Column:
    """Positions 0..n-1 as an array (empty when n <= 0), without sequence()."""
    return F.array_repeat(F.lit(0), F.greatest(n.cast("int"), F.lit(0)))


STATE_TABLES = ("city", "package_type", "place", "place_admin", "package", "booking", "users",
                "member_ban")


class Catalog:
    """Lazily built domain views for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._raw: dict[str, DataFrame] = {}

    def materialize(self, path: str, names=STATE_TABLES,
                    buckets: int | None = None) -> "StoredCatalog":
        """Write the named views as parquet tables under ``path`` and return a
        catalog that reads them.

        The views stand in for stored tables; materialising them once lets a
        batch of jobs share one derivation, and ``booking`` is partitioned by
        creation day so date filters prune whole partitions.  With ``buckets``
        the tables become bucketed external tables (``booking`` by
        ``package_id``, ``package`` by ``id``), so the booking-package join of
        every report reads co-located buckets without a shuffle.  ``path``
        must be on shared storage (use ``session.scratch_path``).
        """
        import uuid as _uuid

        bucket_key = {"booking": "package_id", "package": "id"}
        tables: dict[str, str] = {}
        for name in names:
            df = getattr(self, name)
            target = f"{path.rstrip('/')}/{name}"
            if name == "booking":
                df = df.withColumn("created_day", F.to_date("created_at"))
            if buckets and name in bucket_key:
                table = f"slotbook_{_uuid.uuid4().hex[:10]}_{name}"
                w = df.write.mode("overwrite").option("path", target)
                if name == "booking":
                    w = w.partitionBy("created_day")
                w.bucketBy(buckets, bucket_key[name]).sortBy(bucket_key[name]).saveAsTable(table)
                tables[name] = table
                continue
            if name == "booking":
                df.repartition("created_day").write.mode("overwrite") \
                    .partitionBy("created_day").parquet(target)
            else:
                df.write.mode("overwrite").parquet(target)
        return StoredCatalog(self, path, names, tables)

    def raw(self, name: str) -> DataFrame:
        """One reader per table and catalog: the file listing is done once, and
        every view reading the table shares the same (lazy) scan definition."""
        if name not in self._raw:
            self._raw[name] = read_table(self.spark, self.sf_dir, name, check=True)
        return self._raw[name]

    # ---- helpers shared by several views --------------------------------------
    # Three fixture formulas divide by a table's row count.  The count is taken
    # once per catalog (a scalar action on a small table) rather than as a
    # scalar subquery, which would run as an extra job inside every query.
    @cached_property
    def _n_suppliers(self) -> int:
        return self.raw("supplier").count()

    @cached_property
    def _n_customers(self) -> int:
        return self.raw("customer").count()

    @cached_property
    def _n_parts(self) -> int:
        return self.raw("part").count()

    def _supplier_count(self) -> Column:
        return F.lit(self._n_suppliers).cast("bigint")

    def _customer_count(self) -> Column:
        return F.lit(self._n_customers).cast("bigint")

    def _admin_ids(self) -> DataFrame:
        s = self.raw("supplier")
        return (s.select("s_suppkey", F.posexplode(_fanout(F.col("s_suppkey") % 4)).alias("k", "_z"))
                 .select((F.lit(1000000) + F.col("s_suppkey") * 3 + F.col("k")).alias("admin_user_id"),
                         F.col("s_suppkey").alias("place_id")))

    # ---- state tables ------------------------------------------------------------
    @cached_property
    def city(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))

    @cached_property
    def package_type(self) -> DataFrame:
        return (self.raw("part").select(F.col("p_type").alias("id"), F.lower("p_type").alias("name"))
                .distinct())

    @cached_property
    def place(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("id"),
            F.concat(F.lit("Place "), _spelled(k)).alias("name"),
            (F.lit(300) + (k % 5) * 100).cast("int").alias("max_capacity"),
            F.concat(F.lit("Street "), k.cast("string")).alias("address"),
            (F.lit(2000000) + k % 3).alias("owner_user_id"),
            F.col("s_nationkey").alias("city_id"),
        )

    @cached_property
    def place_admin(self) -> DataFrame:
        return self._admin_ids()

    @cached_property
    def package(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            k.alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_size").alias("capacity"),
            F.floor("p_retailprice").cast("int").alias("price"),
            (k % self._supplier_count()).alias("place_id"),
            F.col("p_type").alias("package_type_id"),
        )

    @cached_property
    def booking(self) -> DataFrame:
        return booking_from(self.raw("orders"), self.first_part)

    @cached_property
    def first_part(self) -> DataFrame:
        """Package of each order: its smallest part key (one row per order)."""
        return (self.raw("lineitem").groupBy("l_orderkey")
                .agg(F.min("l_partkey").alias("package_id")))

    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        first_order = (self.raw("orders").groupBy("o_custkey")
                       .agg(F.min("o_orderdate").alias("created_at")))
        pending_bans = (self.raw("events")
                        .filter((F.col("event_type") == "error") & (F.col("event_id") % 3 == 2))
                        .groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))
        uname = F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("")))
        members = (c.join(first_order, c.c_custkey == first_order.o_custkey, "left")
                   .join(pending_bans, c.c_custkey == pending_bans.user_id, "left")
                   .select(F.col("c_custkey").alias("id"),
                           F.concat(F.lit("Member "), _spelled(F.col("c_custkey"))).alias("fullname"),
                           F.when(F.col("c_custkey") % 2 == 0, C.GENDER_MALE)
                            .otherwise(C.GENDER_FEMALE).alias("gender"),
                           uname.alias("username"),
                           F.concat(uname, F.lit("@example.com")).alias("email"),
                           F.lit(C.ROLE_MEMBER).alias("role"),
                           F.when(F.col("n") > 0, C.BAN_STATUS_PENDING)
                            .otherwise(C.BAN_STATUS_ACTIVE).alias("ban_status"),
                           F.lit(True).alias("is_active"),
                           F.col("created_at")))

        def staff(ids: DataFrame, title: str, gender: str, prefix: str, role: str) -> DataFrame:
            sid = F.col("id").cast("string")
            return ids.select(
                F.col("id"),
                F.concat(F.lit(title + " "), sid).alias("fullname"),
                F.lit(gender).alias("gender"),
                F.concat(F.lit(prefix), sid).alias("username"),
                F.concat(F.lit(prefix), sid, F.lit("@example.com")).alias("email"),
                F.lit(role).alias("role"),
                F.lit(C.BAN_STATUS_ACTIVE).alias("ban_status"),
                F.lit(True).alias("is_active"),
                F.lit(None).cast("timestamp_ntz").alias("created_at"))

        admins = staff(self._admin_ids().select(F.col("admin_user_id").alias("id")),
                       "Admin", C.GENDER_MALE, "admin", C.ROLE_ADMIN)
        owners = staff(self.raw("supplier").select((F.lit(2000000) + F.col("s_suppkey") % 3).alias("id"))
                       .distinct(), "Owner", C.GENDER_FEMALE, "owner", C.ROLE_OWNER)
        # members who never booked
        idle = staff(self.raw("supplier").select((F.lit(-10) - F.col("s_suppkey")).alias("id")),
                     "Idle", C.GENDER_FEMALE, "idle", C.ROLE_MEMBER)
        return members.unionByName(admins).unionByName(owners).unionByName(idle)

    @cached_property
    def member_ban(self) -> DataFrame:
        return bans_from(self.raw("events"))

    # ---- request and event tables -----------------------------------------------
    def _events(self, *types: str) -> DataFrame:
        return self.raw("events").filter(F.col("event_type").isin(*types))

    @cached_property
    def access_attempt(self) -> DataFrame:
        return attempts_from(self.raw("events"))

    @cached_property
    def live_booking(self) -> DataFrame:
        return self.live_booking_of(self.raw("events"))

    def live_booking_of(self, events: DataFrame) -> DataFrame:
        """``live_booking`` over an events DataFrame, batch or stream."""
        return live_booking_from(events, self._n_parts)

    @cached_property
    def booking_request(self) -> DataFrame:
        return self._events("purchase").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("member_user_id"),
            F.when(F.col("event_id") % 11 == 0, F.lit(-1).cast("bigint"))
             .otherwise(F.col("event_id") % F.lit(self._n_parts).cast("bigint")).alias("package_id"),
            F.col("ts").alias("requested_at"))

    @cached_property
    def completion(self) -> DataFrame:
        return completion_from(self.raw("events"))

    @cached_property
    def transition_request(self) -> DataFrame:
        return self.booking.select(
            F.col("id").alias("booking_id"),
            F.when(F.col("id") % 13 == 0, "CANCELLED").when(F.col("id") % 2 == 0, C.ORDER_COMPLETED)
             .otherwise(C.ORDER_EXPIRED).alias("new_status"),
            F.when(F.col("id") % 7 == 0, F.lit(1000000).cast("bigint"))
             .otherwise(F.lit(1000000) + (F.col("package_id") % self._supplier_count()) * 3)
             .alias("admin_user_id"),
            (F.col("created_at") + F.expr("INTERVAL 2 HOURS")).alias("requested_at"))

    @cached_property
    def package_request(self) -> DataFrame:
        k = F.col("p_partkey")
        place_id = k % (self._supplier_count() + 2)
        return self.raw("part").select(
            k.alias("id"),
            place_id.alias("place_id"),
            F.when(k % 9 == 0, "new 9").otherwise(F.col("p_name")).alias("name"),
            F.col("p_size").alias("capacity"),
            F.floor("p_retailprice").cast("int").alias("price"),
            F.when(k % 10 == 0, "NONE").otherwise(F.col("p_type")).alias("package_type_id"),
            (F.lit(1000000) + place_id * 3).alias("admin_user_id"))

    @cached_property
    def place_request(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("id"),
            F.when(k % 5 == 0, F.concat(F.lit("Place "), _spelled(k)))
             .when(k % 5 == 1, F.col("s_name")).otherwise("New place").alias("name"),
            F.concat(F.lit("Street "), k.cast("string")).alias("address"),
            F.lit(100).cast("int").alias("max_capacity"),
            F.when(k % 6 == 0, F.lit(-1)).otherwise(F.col("s_nationkey")).alias("city_id"),
            F.when(k % 4 == 0, "Ann Lee;Bo Ray;Ann Lee").otherwise("Ann Lee;Bo Ray;Cy Poe")
             .alias("admin_names"),
            F.lit(2000000).alias("owner_user_id"))

    @cached_property
    def place_update(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            F.when(k % 8 == 7, F.lit(-1).cast("bigint")).otherwise(k).alias("id"),
            F.when(k % 5 == 0, "Place a").otherwise("Renamed place").alias("name"),
            F.when(k % 5 == 0, "Street 0").otherwise(F.concat(F.lit("Road "), k.cast("string")))
             .alias("address"),
            (F.lit(300) + (k % 5) * 100 + F.when(k % 3 == 0, -50).otherwise(50)).cast("int")
             .alias("max_capacity"))

    @cached_property
    def admin_entry(self) -> DataFrame:
        a = F.col("admin_user_id")
        return self.place_admin.select(
            F.col("place_id"),
            F.when(a % 2 == 0, a).alias("admin_user_id"),
            F.when(a % 7 == 0, "").otherwise("Dee Fox").alias("fullname"),
            F.concat(F.lit("staff"), a.cast("string")).alias("username"),
            (a % 3 > 0).alias("is_active"))

    @cached_property
    def ban_request(self) -> DataFrame:
        e = F.col("event_id")
        return self._events("signup").select(
            e.alias("id"),
            F.when(e % 9 == 0, F.lit(-1).cast("bigint")).when(e % 9 == 1, F.lit(1000003).cast("bigint"))
             .otherwise((e * 7) % self._customer_count()).alias("member_user_id"),
            F.when(e % 8 == 0, "no show 3").otherwise("no show").alias("ban_reason"),
            F.lit(1000003).alias("admin_user_id"),
            F.col("ts").alias("requested_at"))

    @cached_property
    def ban_decision(self) -> DataFrame:
        e = F.col("event_id")
        return self._events("error").select(
            F.when(e % 10 == 0, F.lit(-1).cast("bigint")).otherwise(e).alias("ban_request_id"),
            F.when(e % 7 == 0, "MAYBE").when(e % 2 == 0, C.BAN_APPROVAL_BANNED)
             .otherwise(C.BAN_APPROVAL_REVOKED).alias("decision"),
            F.lit(2000000).alias("owner_user_id"),
            (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("decided_at"))

    @cached_property
    def member_signup(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.alias("id"),
            F.concat(F.lit("Member "), _spelled(k)).alias("fullname"),
            F.when(k % 11 == 0, "OTHER").otherwise(C.GENDER_MALE).alias("gender"),
            F.when(k % 4 == 0, F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(""))))
             .otherwise(F.concat(F.lit("new"), (k - k % 3).cast("string"))).alias("username"),
            F.when(k % 13 == 0, "bad-email")
             .otherwise(F.concat(F.lit("m"), k.cast("string"), F.lit("@example.com"))).alias("email"))


class StoredCatalog:
    """A catalog whose state tables are read from materialised parquet tables;
    every other view falls through to the source catalog."""

    def __init__(self, source: Catalog, path: str, names, tables: dict[str, str] | None = None):
        self._source, self._path, self._names = source, path.rstrip("/"), set(names)
        self._tables = dict(tables or {})
        self.spark, self.sf_dir = source.spark, source.sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in self._names:
            return getattr(self._source, name)
        if name not in self._cache:
            if name in self._tables:
                df = self.spark.table(self._tables[name])
            else:
                df = self.spark.read.parquet(f"{self._path}/{name}")
            if name == "booking":
                df = df.select(*self._source.booking.columns, "created_day")
            self._cache[name] = df
        return self._cache[name]


# ---- event-shaped views, usable on batch and streaming DataFrames -------------------
def bans_from(events: DataFrame) -> DataFrame:
    """``member_ban`` over an events DataFrame, batch or stream."""
    e = events.filter(F.col("event_type") == "error")
    m = F.col("event_id") % 3
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("member_user_id"),
        F.when(m == 0, C.BAN_APPROVAL_BANNED).when(m == 1, C.BAN_APPROVAL_REVOKED)
         .otherwise(C.BAN_APPROVAL_PENDING).alias("approval_status"),
        F.concat(F.lit("reason "), (F.col("event_id") % 7).cast("string")).alias("ban_reason"),
        F.when(m == 0, F.col("ts") + F.expr("INTERVAL 3 DAYS"))
         .when(m == 1, F.col("ts")).alias("ban_lifted_at"),
        F.when(m < 2, F.col("ts")).alias("updated_at"),
        F.col("ts").alias("created_at"),
    )


def attempts_from(events: DataFrame) -> DataFrame:
    """``access_attempt`` over an events DataFrame, batch or stream."""
    return events.filter(F.col("event_type").isin("view", "click")).select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 17 == 0, F.lit(-1).cast("bigint"))
         .otherwise(F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 4 == 0, C.ROLE_ADMIN).otherwise(C.ROLE_MEMBER).alias("required_role"),
        F.col("ts").alias("attempted_at"))


def booking_from(orders: DataFrame, first_part: DataFrame) -> DataFrame:
    """Bookings from orders (batch or stream) and the static order -> package table."""
    o = orders
    status = (F.when(F.col("o_orderstatus") == "P", C.ORDER_PENDING)
              .when(F.col("o_orderstatus") == "F", C.ORDER_COMPLETED)
              .otherwise(C.ORDER_EXPIRED))
    return (o.join(first_part, o.o_orderkey == first_part.l_orderkey, "left")
            .select(F.col("o_orderkey").alias("id"),
                    status.alias("order_status"),
                    F.col("o_custkey").alias("member_user_id"),
                    F.col("package_id"),
                    F.when(F.col("o_orderstatus") != "P",
                           F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("updated_at"),
                    F.col("o_orderdate").alias("created_at")))


def live_booking_from(events: DataFrame, packages: int) -> DataFrame:
    """A click creates a PENDING booking of one of ``packages`` packages (batch or stream)."""
    return events.filter(F.col("event_type") == "click").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("member_user_id"),
        (F.col("event_id") % F.lit(packages).cast("bigint")).alias("package_id"),
        F.lit(C.ORDER_PENDING).alias("order_status"),
        F.col("ts").alias("created_at"))


def completion_from(events: DataFrame) -> DataFrame:
    """A view completes the member's bookings (batch or stream)."""
    return events.filter(F.col("event_type") == "view").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("member_user_id"),
        F.col("ts").alias("completed_at"))


VIEW_NAMES = ("city", "package_type", "place", "place_admin", "package", "booking", "users",
              "member_ban", "access_attempt", "live_booking", "booking_request", "completion",
              "transition_request", "package_request", "place_request", "place_update",
              "admin_entry", "ban_request", "ban_decision", "member_signup")
