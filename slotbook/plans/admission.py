"""Rule-checked writes (M01-M03, M05-M10, N01): a whole table of requests in,
each request with a ``reason_code`` out, plus the rows to append or update.

Checks run in the source application's order and the first failing check
wins (one ``when`` chain).  Requests are judged against a snapshot of the
state tables ("snapshot" mode): a request does not see other requests of the
same batch, which is what concurrent readers of the source see.  Where a
batch holds two changes to the same record (same booking, same ban request,
same username), the first by request time wins and the rest get the job's
"already processed" / "duplicate" code.

Lookups are joins on the request key; "exists"-style checks are folded to one
row per key with an aggregate before the join; time-dependent state (pending
bookings, pending bans) uses the bucketed as-of operator, so no check forms
request x state pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotbook import constants as C
from slotbook.functions import validate as V
from slotbook.functions.ids import stable_uuid
from slotbook.functions.times import micros
from slotbook.operators.asof import asof_count, asof_latest, unique_rank
from slotbook.operators.prefix import running
from slotbook.operators.settle import settle
from slotbook.operators.writes import apply_updates
from slotbook.session import cut_lineage

def _ttl():
    return F.expr(C.BOOKING_TTL)


def _chain(checks: Sequence[tuple[Column, str]]) -> Column:
    """First failing check wins; ``0000`` when none fails."""
    expr = None
    for cond, code in checks:
        c = F.coalesce(cond, F.lit(False))
        expr = F.when(c, code) if expr is None else expr.when(c, code)
    return expr.otherwise(C.OK) if expr is not None else F.lit(C.OK)


def _has_errors(rules) -> Column:
    return ~V.all_pass(rules)


def first_in_batch(df: DataFrame, key: Sequence[str], order: Sequence[str],
                   eligible: Column, name: str = "is_first", unique: bool = False) -> DataFrame:
    """Flag the first eligible row per key by ``order`` (a min aggregate + join,
    so a key with very many rows is folded map-side instead of windowed).

    Exactly one row is first, also of requests that are equal in everything: a ``request_id``
    column, where there is one, orders them, else they get row numbers, which are written down
    before they are compared.
    """
    if "request_id" in df.columns and "request_id" not in order:
        order = [*order, "request_id"]
    elif not unique:
        df = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__eligible", eligible))
        order, eligible = [*order, "__row"], F.col("__eligible")
    types = [df.schema[c].dataType for c in order]
    integral = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    if len(order) == 1 and isinstance(types[0], integral):
        rank = F.col(order[0])                     # fixed-width: hash aggregate
    elif (len(order) == 2 and isinstance(types[0], (T.TimestampNTZType, T.TimestampType))
          and isinstance(types[1], integral)):
        rank = unique_rank(types[0], order[1], order[0])   # packed, still fixed-width
    else:
        rank = F.struct(*[F.col(c) for c in order])
    firsts = (df.filter(eligible).groupBy(*key).agg(F.min(rank).alias("__first")))
    j = df.join(firsts, list(key), "left")
    return j.withColumn(name, F.coalesce(eligible & rank.eqNullSafe(F.col("__first")), F.lit(False))) \
            .drop("__first", "__row", "__eligible")


def _batch_unique(r: DataFrame, code: Column, key, order, clash: str,
                  mode: str) -> tuple[DataFrame, Column]:
    """Strict mode: among rows that pass (``code`` is 0000) and share ``key``,
    keep the first by ``order``; the others get ``clash``.  A min aggregate per
    key joined back (``first_in_batch``), so a hot key is folded map-side."""
    if mode == "snapshot":
        return r, code
    if mode != "strict":
        raise ValueError(f"unknown mode {mode!r}")
    r = first_in_batch(r.withColumn("__pre", code), list(key), list(order),
                       F.col("__pre") == C.OK, name="__first_in_batch", unique=True)
    return r, (F.when((F.col("__pre") == C.OK) & ~F.col("__first_in_batch"), clash)
               .otherwise(F.col("__pre")))


# --- M01 ---------------------------------------------------------------------------
def admit_bookings(requests: DataFrame, package: DataFrame, state: DataFrame,
                   strict_capacity: bool = False, id_kind: str = "key",
                   bucket: str = "minute", mode: str = "snapshot") -> DataFrame:
    """Judge booking requests (id, member_user_id, package_id, requested_at).

    1019 invalid fields; 1020 unknown package; 1021 the package's PENDING count
    at request time equals its capacity (``strict_capacity=True``: reaches or
    exceeds it); 1022 the member has a PENDING booking younger than 2 h (exactly
    2 h old is expired); else accepted as a new PENDING booking created at
    ``requested_at``.  State rows count only if created at or before the request.
    The capacity count includes pendings older than 2 h, as in the source.

    ``mode="snapshot"`` judges every request against stored state only.
    ``mode="strict"`` also lets requests of the batch see earlier requests of
    the batch, conservatively: a request is 1022 when the same member has an
    earlier (by time, then id) request in the batch, younger than 2 h,
    that passed the field, package and stored-state checks; and 1021 when
    stored pendings plus earlier surviving requests for the package reach the
    capacity (always ``>=`` in this mode).  A later request can be refused
    because of an earlier one that itself fails the capacity check.
    ``mode="sequential"`` is exact: the result of taking the requests one by one by (time, id), so
    a request that was refused, for whatever reason, blocks nobody (``_one_by_one``); requests
    without a time or member are judged against stored state and keep no member from booking.
    """
    if mode not in ("snapshot", "strict", "sequential"):
        raise ValueError(f"unknown mode {mode!r}")
    pending = state.filter(F.col("order_status") == C.ORDER_PENDING)
    r = requests.withColumn("__bad", _has_errors(V.booking_create_rules(id_kind)))
    pk = package.select(F.col("id").alias("package_id"), F.col("capacity").alias("__cap"),
                        F.lit(True).alias("__pk"))
    r = r.join(pk, "package_id", "left")
    r = asof_count(r, pending.select("package_id", F.col("created_at").alias("__st")),
                   ["package_id"], "requested_at", "__st", name="pending_count", bucket=bucket)
    r = asof_latest(r, pending.select("member_user_id", F.col("created_at").alias("__mt")),
                    ["member_user_id"], "requested_at", "__mt", ["__mt"], bucket=bucket,
                    prefix="last", left_keys=requests)
    ongoing = F.coalesce(F.col("last__mt") + _ttl() > F.col("requested_at"), F.lit(False))
    if mode == "snapshot":
        full = (F.col("pending_count") >= F.col("__cap")) if strict_capacity \
            else (F.col("pending_count") == F.col("__cap"))
    elif mode == "sequential":
        r = _one_by_one(r.withColumn("__stored", ongoing))
        full = F.col("pending_count") + F.col("__earlier") >= F.col("__cap")
        ongoing = ~F.col("__took")
    else:
        # Each step below reads the previous step's output twice (as the left
        # side and, filtered, as the right side); a reliable checkpoint in the
        # shared checkpoint folder cuts the lineage so no step is recomputed.
        r = r.withColumn("__e1", ~F.col("__bad") & F.col("__pk").isNotNull() & ~ongoing)
        r = cut_lineage(r)
        e1 = r.filter("__e1").select("member_user_id", F.col("requested_at").alias("__et"))
        r = asof_latest(r, e1, ["member_user_id"], "requested_at", "__et", ["__et"],
                        bucket=bucket, inclusive=False, prefix="prev")
        # of a member's requests at one instant the lowest id is first
        r = first_in_batch(r, ["member_user_id", "requested_at"], ["id"], F.col("__e1"), "__member_first", unique=True)
        batch_ongoing = (F.coalesce(F.col("prev__et") + _ttl() > F.col("requested_at"), F.lit(False))
                         | (F.col("__e1") & ~F.col("__member_first")))
        # earlier survivors for the package, requests of one instant by id: a running count split by
        # range, so neither a hot package nor a hot instant is one task's work
        counts = F.col("__e1") & ~batch_ongoing & F.col("requested_at").isNotNull()
        r = r.withColumn("__one", counts.cast("int")).withColumn("__t", micros(r, "requested_at"))
        r = running(r, ["package_id"], ["__t", "id"], "__one", "__rank", inclusive=False)
        full = F.col("pending_count") + F.col("__rank") >= F.col("__cap")
        ongoing = ongoing | batch_ongoing
    code = _chain([
        (F.col("__bad"), C.BOOKING_CREATE_FIELDS),
        (F.col("__pk").isNull(), C.BOOKING_CREATE_PACKAGE_MISSING),
        (full, C.BOOKING_CREATE_PACKAGE_FULL),
        (ongoing, C.BOOKING_CREATE_ONGOING_EXISTS),
    ])
    ok = code == C.OK
    return r.select(*requests.columns, code.alias("reason_code"),
                    F.when(ok, stable_uuid("admit_bookings", F.col("id"))).alias("new_booking_id"),
                    F.when(ok, F.lit(C.ORDER_PENDING)).alias("order_status"))


def _one_by_one(r: DataFrame) -> DataFrame:
    """M01 taken one by one: ``r`` with ``__earlier``, the accepted requests for the package before
    this one, and ``__took``, whether the member could book then and the package was not full.

    Two rules are coupled: a package is full from some request on (its cut: stored and accepted
    bookings only grow), and a member's accepted requests are two hours apart.  Given the cuts, each member's
    requests are settled exactly (``_spaced``); given these, the cuts follow from running counts.
    Both are repeated until no cut moves.  What comes before the first wrong cut is right after
    each round, so the end is the sequential result, after as many rounds as cuts depend on
    each other in a chain (two where no package fills up).
    """
    time = F.coalesce(micros(r, "requested_at"), F.lit(0))
    timed = F.col("requested_at").isNotNull() & F.col("member_user_id").isNotNull()
    r = cut_lineage(r.withColumn("__t", time).withColumn("__timed", timed)
                    .withColumn("__could", ~F.col("__bad") & F.col("__pk").isNotNull() & ~F.col("__stored")))
    able = r.filter(F.col("__could") & (F.col("pending_count") < F.col("__cap")))
    able = cut_lineage(able.select("id", "member_user_id", "package_id", "__t", "__timed", "__cap", "pending_count"))
    cuts = None
    while True:
        open_ = able
        if cuts is not None:
            open_ = able.join(cuts, "package_id", "left").filter(F.col("__cut").isNull() | (F.struct("__t", "id") < F.col("__cut")))
        took = cut_lineage(_spaced(open_.filter("__timed")).unionByName(open_.filter(~F.col("__timed")).select("id"))
                           .withColumn("__one", F.lit(1)))
        counted = running(able.join(took, "id", "left"), ["package_id"], ["__t", "id"], "__one", "__earlier", inclusive=False)
        found = cut_lineage(counted.filter(F.col("pending_count") + F.col("__earlier") >= F.col("__cap"))
                            .groupBy("package_id").agg(F.min(F.struct("__t", "id")).alias("__cut")))
        if cuts is None:
            moved = not found.isEmpty()
        else:
            both = found.join(cuts.withColumnRenamed("__cut", "__old"), "package_id", "full")
            moved = not both.filter(~F.col("__cut").eqNullSafe(F.col("__old"))).isEmpty()
        if not moved:
            break
        cuts = found
    judged = r.join(took, "id", "left")
    out = running(judged, ["package_id"], ["__t", "id"], "__one", "__earlier", inclusive=False)
    return out.withColumn("__took", F.col("__one").isNotNull())


def _spaced(open_: DataFrame, ttl: str = C.BOOKING_TTL) -> DataFrame:
    """(id) of the requests a member gets if every one is taken that is at least ``ttl`` after the last
    one taken.

    The first request of an instant stands for it.  From each instant a pointer goes to the member's first one at
    least ``ttl`` later (a running last value from the latest back, see ``prefix``); what the pointers reach from a member's first
    instant is taken.  Pointers are doubled, so a member's chain takes the logarithm of its length.
    """
    ttl_us = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', TIMESTAMP_NTZ'1970-01-01 00:00:00' + {ttl})")
    slots = cut_lineage(open_.groupBy("member_user_id", "__t").agg(F.min("id").alias("id")))
    t, member = F.col("__t"), F.col("member_user_id")
    events = (slots.select(member, (-t).alias("at"), F.lit(0).alias("probe"), t.alias("seen"))
              .unionByName(slots.select(member, (-(t + ttl_us)).alias("at"), F.lit(1).alias("probe"), F.lit(None).cast("long").alias("seen"))))
    nexts = (running(events, ["member_user_id"], ["at", "probe"], "seen", "next", "last").filter("probe = 1 and next is not null")
             .select(member, (-F.col("at") - ttl_us).alias("__t"), "next"))
    nexts = cut_lineage(nexts)
    reached = slots.groupBy("member_user_id").agg(F.min("__t").alias("__t"))
    while not nexts.isEmpty():
        ahead = reached.join(nexts, ["member_user_id", "__t"]).select("member_user_id", F.col("next").alias("__t"))
        reached = cut_lineage(reached.unionByName(ahead))
        further = nexts.select("member_user_id", F.col("__t").alias("next"), F.col("next").alias("__far"))
        nexts = cut_lineage(nexts.join(further, ["member_user_id", "next"]).select("member_user_id", "__t", F.col("__far").alias("next")))
    return slots.join(reached, ["member_user_id", "__t"], "left_semi").select("id")


# --- M02 ---------------------------------------------------------------------------
def transition_bookings(requests: DataFrame, booking: DataFrame, package: DataFrame,
                        place: DataFrame, place_admin: DataFrame, id_kind: str = "key") -> DataFrame:
    """Judge status changes (booking_id, new_status, admin_user_id, requested_at).

    1030 malformed id; 1029 status not COMPLETED/EXPIRED; 1034 the booking is not
    at a place this admin manages; 1035 already updated (or an earlier request
    of the batch updates it); else the booking gets the new status, the admin
    and ``updated_at = requested_at``.
    """
    # Requests meet their booking first; only those bookings go on to the packages and their admins.
    b = booking.select(F.col("id").alias("booking_id"), F.col("package_id").alias("__package"),
                       F.col("updated_at").alias("__prev_updated"))
    managed = (package.select(F.col("id").alias("__package"), "place_id")
               .join(place.select(F.col("id").alias("place_id")), "place_id")
               .join(place_admin.select("admin_user_id", "place_id"), "place_id")
               .select("__package", "admin_user_id", F.lit(True).alias("__managed")).distinct())
    r = (requests.withColumn("__bad_id", ~V.passes(V.valid_id(F.col("booking_id"), id_kind)))
         .withColumn("__bad", _has_errors(V.booking_status_rules()))
         .join(b, "booking_id", "left")
         .join(managed, ["__package", "admin_user_id"], "left"))
    pre = _chain([
        (F.col("__bad_id"), C.BOOKING_UPDATE_BAD_ID),
        (F.col("__bad"), C.BOOKING_UPDATE_FIELDS),
        (F.col("__managed").isNull(), C.BOOKING_UPDATE_NOT_MANAGED),
        (F.col("__prev_updated").isNotNull(), C.BOOKING_UPDATE_ALREADY_UPDATED),
    ])
    r = r.withColumn("__pre", pre)
    r = first_in_batch(r, ["booking_id"], ["requested_at", "admin_user_id", "new_status"],
                       F.col("__pre") == C.OK)
    code = (F.when((F.col("__pre") == C.OK) & ~F.col("is_first"), C.BOOKING_UPDATE_ALREADY_UPDATED)
            .otherwise(F.col("__pre")))
    ok = code == C.OK
    return r.select(*requests.columns, code.alias("reason_code"),
                    F.when(ok, F.col("new_status")).alias("order_status"),
                    F.when(ok, F.col("requested_at")).alias("updated_at"))


# --- M03 ---------------------------------------------------------------------------
def admit_packages(requests: DataFrame, place: DataFrame, place_admin: DataFrame,
                   package: DataFrame, package_type: DataFrame, id_kind: str = "key",
                   mode: str = "snapshot") -> DataFrame:
    """Judge new packages (id, place_id, name, capacity, price, package_type_id, admin_user_id).

    1042 malformed place id; 1036 invalid fields; 1037 unknown place; 1038 the
    admin does not manage the place; 1039 existing capacity of the place plus
    the new one exceeds max_capacity (the intended check); 1040 unknown type.
    ``mode="strict"``: requests that pass all this are taken one after another
    by id, and one that no longer fits beside those accepted before it gets
    1039.  A capacity of 0 or less takes and frees nothing in the batch.
    """
    used = package.groupBy("place_id").agg(F.sum("capacity").alias("__used"))
    pl = (place.select(F.col("id").alias("place_id"), F.col("max_capacity").alias("__max"),
                       F.lit(True).alias("__pl"))
          .join(used, "place_id", "left"))
    pa = place_admin.select("admin_user_id", "place_id", F.lit(True).alias("__adm"))
    pt = package_type.select(F.col("id").alias("package_type_id"), F.lit(True).alias("__pt"))
    r = (requests.withColumn("__bad_id", ~V.passes(V.valid_id(F.col("place_id"), id_kind)))
         .withColumn("__bad", _has_errors(V.package_create_rules(id_kind)))
         .join(pl, "place_id", "left")
         .join(pa, ["admin_user_id", "place_id"], "left")
         .join(pt, "package_type_id", "left"))
    code = _chain([
        (F.col("__bad_id"), C.PACKAGE_CREATE_BAD_PLACE_ID),
        (F.col("__bad"), C.PACKAGE_CREATE_FIELDS),
        (F.col("__pl").isNull(), C.PACKAGE_CREATE_PLACE_MISSING),
        (F.col("__adm").isNull(), C.PACKAGE_CREATE_NOT_ADMIN),
        (~F.coalesce(F.coalesce(F.col("__used"), F.lit(0)) + F.col("capacity").try_cast("long") <= F.col("__max"), F.lit(False)),
         C.PACKAGE_CREATE_OVER_CAPACITY),
        (F.col("__pt").isNull(), C.PACKAGE_CREATE_TYPE_MISSING),
    ])
    r = r.withColumn("reason_code", code)
    if mode == "strict":
        size = F.col("capacity").try_cast("int").cast("long")
        # Read twice below (to settle, and to look up): judged once.
        r = cut_lineage(r.withColumn("__size", size)
                        .withColumn("__room", F.col("__max") - F.coalesce(F.col("__used"), F.lit(0))))
        fits = _fitting(r.filter((F.col("reason_code") == C.OK) & (F.col("__size") > 0))
                        .select("id", "place_id", "__size", "__room")).withColumn("__fits", F.lit(True))
        late = (F.col("reason_code") == C.OK) & (F.col("__size") > 0) & F.col("__fits").isNull()
        r = (r.join(fits, ["place_id", "id"], "left")
             .withColumn("reason_code", F.when(late, C.PACKAGE_CREATE_OVER_CAPACITY).otherwise(F.col("reason_code"))))
    elif mode != "snapshot":
        raise ValueError(f"unknown mode {mode!r}")
    ok = F.col("reason_code") == C.OK
    return r.select(*requests.columns, "reason_code",
                    F.when(ok, stable_uuid("admit_packages", F.col("id"))).alias("new_package_id"))


def _fitting(requests: DataFrame, salts: int = 64) -> DataFrame:
    """(place_id, id) of the requests that fit when taken by id (id, place_id, __size, __room).

    Room only shrinks, so once a size is refused at a place it stays refused: the
    accepted requests of one size are its first ones, at most ``__room / __size``
    of them.  Only those go into the fold, whose length is so bounded by the
    place's room, not by the batch; a hot place is thinned over ``salts`` tasks first.
    """
    first = F.row_number()
    size_key = ["place_id", "__size"]
    salted = requests.withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    for key in ([*size_key, "__salt"], size_key):
        salted = (salted.withColumn("__rank", first.over(Window.partitionBy(*key).orderBy("id")))
                  .filter(F.col("__rank") * F.col("__size") <= F.col("__room")))
    queue = salted.groupBy("place_id").agg(
        F.min("__room").alias("room"), F.array_sort(F.collect_list(F.struct("id", "__size"))).alias("queue"))
    none = F.array().cast(T.ArrayType(requests.schema["id"].dataType))

    def take(acc, x):
        return F.when(x["__size"] <= acc["room"], F.struct(
            (acc["room"] - x["__size"]).alias("room"),
            F.concat(acc["got"], F.array(x["id"])).alias("got"))).otherwise(acc)

    start = F.struct(F.col("room").cast("long").alias("room"), none.alias("got"))
    return queue.select("place_id", F.explode(F.aggregate("queue", start, take)["got"]).alias("id"))


# --- M05 / N01 -----------------------------------------------------------------------
def derive_admin_accounts(place_name: Column, fullname: Column, position: Column,
                          domain: str = C.ADMIN_EMAIL_DOMAIN) -> tuple[Column, Column]:
    """username = lower(place name + full name, spaces removed, + 0-based position)."""
    username = F.lower(F.concat(F.replace(place_name, F.lit(" "), F.lit("")),
                                F.replace(fullname, F.lit(" "), F.lit("")), position.cast("string")))
    return username, F.concat(username, F.lit("@" + domain))


def admit_places(requests: DataFrame, city: DataFrame, place: DataFrame,
                 id_kind: str = "key", mode: str = "snapshot") -> dict[str, DataFrame]:
    """Judge new places (id, name, address, max_capacity, city_id, admin_names, owner_user_id).

    ``admin_names`` is an array of names or a ';'-joined string.  1006 invalid
    fields; 1007 duplicate admin names; 1041 unknown city; 1009 a place with the
    same name, address and city exists.  Returns ``decisions`` (one row per
    request), and for accepted requests ``places``, ``admins`` (one generated
    admin account per name) and ``links`` (admin -> place).  ``mode="strict"``:
    of several accepted requests for the same name, address and city in one
    batch only the lowest id is accepted, the others get 1009.
    """
    names = F.col("admin_names")
    if dict(requests.dtypes)["admin_names"] == "string":
        names = F.split(names, ";")
    r = requests.withColumn("admin_name_list", names)
    existing = (place.groupBy("name", "address", "city_id").agg(F.lit(True).alias("__dup")))
    ct = city.select(F.col("id").alias("city_id"), F.lit(True).alias("__city"))
    r = (r.withColumn("__bad", _has_errors(V.place_create_rules(id_kind)))
         .join(ct, "city_id", "left")
         .join(existing, ["name", "address", "city_id"], "left"))
    code = _chain([
        (F.col("__bad"), C.PLACE_CREATE_FIELDS),
        (F.size(F.array_distinct("admin_name_list")) != F.size("admin_name_list"),
         C.PLACE_CREATE_DUPLICATE_ADMIN_NAMES),
        (F.col("__city").isNull(), C.PLACE_CREATE_CITY_MISSING),
        (F.col("__dup").isNotNull(), C.PLACE_CREATE_EXISTS),
    ])
    r, code = _batch_unique(r, code, ["name", "address", "city_id"], ["id"],
                            C.PLACE_CREATE_EXISTS, mode)
    ok = code == C.OK
    decisions = r.select(*requests.columns, "admin_name_list", code.alias("reason_code"),
                         F.when(ok, stable_uuid("admit_places", F.col("id"))).alias("new_place_id"))
    accepted = decisions.filter(F.col("reason_code") == C.OK)
    places = accepted.select(F.col("new_place_id").alias("id"), "name", "max_capacity", "address",
                             "owner_user_id", "city_id")
    exploded = accepted.select(F.col("id").alias("request_id"), F.col("new_place_id").alias("place_id"),
                               "name", F.posexplode("admin_name_list").alias("position", "fullname"))
    username, email = derive_admin_accounts(F.col("name"), F.col("fullname"), F.col("position"))
    admins = exploded.select(
        "request_id", "place_id", "position",
        stable_uuid("admit_places_admin", F.col("request_id"), F.col("position")).alias("admin_user_id"),
        "fullname", F.lit(C.GENDER_MALE).alias("gender"), username.alias("username"),
        email.alias("email"), F.lit(C.ROLE_ADMIN).alias("role"))
    links = admins.select("admin_user_id", "place_id")
    return {"decisions": decisions.drop("admin_name_list"), "places": places,
            "admins": admins, "links": links}


# --- M06 ---------------------------------------------------------------------------
def update_places(requests: DataFrame, place: DataFrame, id_kind: str = "key",
                  mode: str = "snapshot") -> DataFrame:
    """Judge place updates (id, name, address, max_capacity).

    1044 malformed id; 1011 invalid fields; 1013 unknown place; 1014 the new max
    capacity is below the current one (the intended check); 1015 another place
    already has this name and address (city is not compared); else update.
    ``mode="strict"``: of several accepted updates giving different places the
    same name and address in one batch only the lowest id is accepted, the
    others get 1015.
    ``mode="sequential"`` takes the updates one by one by id: a name and address can
    be taken once all places that had it have moved away by earlier updates, through chains of any
    length (``_free_names``).  A place has one update in a batch.
    """
    if mode not in ("snapshot", "strict", "sequential"):
        raise ValueError(f"unknown mode {mode!r}")
    cur = place.select("id", F.col("max_capacity").alias("__cur_max"), F.lit(True).alias("__pl"))
    by_name = (place.groupBy("name", "address")
               .agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias("__nid")))
    r = (requests.withColumn("__bad_id", ~V.passes(V.valid_id(F.col("id"), id_kind)))
         .withColumn("__bad", _has_errors(V.place_update_rules()))
         .join(cur, "id", "left")
         .join(by_name, ["name", "address"], "left"))
    conflict = (F.col("__n") > 1) | ((F.col("__n") == 1) & (F.col("__nid") != F.col("id")))
    code = _chain([
        (F.col("__bad_id"), C.PLACE_UPDATE_BAD_ID),
        (F.col("__bad"), C.PLACE_UPDATE_FIELDS),
        (F.col("__pl").isNull(), C.PLACE_UPDATE_NOT_FOUND),
        (F.col("max_capacity") < F.col("__cur_max"), C.PLACE_UPDATE_MAX_CAPACITY),
        (conflict & (mode != "sequential"), C.PLACE_UPDATE_CONFLICT),
    ])
    if mode == "sequential":
        r = cut_lineage(r.withColumn("__pre", code))
        free = _free_names(r.filter(F.col("__pre") == C.OK).select("id", "name", "address"), place)
        r = r.join(free.withColumnRenamed("accepted", "__free"), "id", "left")
        code = F.when((F.col("__pre") == C.OK) & ~F.col("__free"), C.PLACE_UPDATE_CONFLICT).otherwise(F.col("__pre"))
    else:
        r, code = _batch_unique(r, code, ["name", "address"], ["id"], C.PLACE_UPDATE_CONFLICT, mode)
    return r.select(*requests.columns, code.alias("reason_code"))


def _free_names(updates: DataFrame, place: DataFrame) -> DataFrame:
    """(id, accepted) of updates (id, name, address), taken one by one by id.

    An update moves its place from one (name, address) to another.  It needs every other place there to
    have moved away before, and no earlier update to have moved in.  All that leave one spot are one node more, numbered right after
    the last of them, which needs each of them; an update needs that node.  So needs are as many
    as updates, and ``settle`` follows the chains.
    """
    key = ["name", "address"]
    moves = updates.select("id", F.col("name").alias("__name"), F.col("address").alias("__address"))
    held = place.select("id", *key).join(moves, "id", "left")
    leaves = F.col("__name").isNotNull() & ~((F.col("name") == F.col("__name")) & (F.col("address") == F.col("__address")))
    held = cut_lineage(held.withColumn("leaves", F.coalesce(leaves, F.lit(False))))
    spots = held.groupBy(*key).agg(F.count_if(~F.col("leaves")).alias("__stay"), F.min(F.when(~F.col("leaves"), F.col("id"))).alias("__stays"),
                                   F.max(F.when(F.col("leaves"), F.col("id"))).alias("__last"))
    # a request is number 2 id, the node of those that leave a spot 2 last + 1; spots never left free have none
    u = cut_lineage(updates.join(spots, key, "left"))
    taken_up = (F.col("__stay") > 1) | ((F.col("__stay") == 1) & (F.col("__stays") != F.col("id")))
    never = F.coalesce(taken_up, F.lit(False))
    last = held.filter("leaves").join(spots.select(*key, "__last"), key)
    needs = (last.select((2 * F.col("__last") + 1).alias("id"), (2 * F.col("id")).alias("need"))
             .unionByName(u.filter(F.col("__last").isNotNull() & ~never).select((2 * F.col("id")).alias("id"), (2 * F.col("__last") + 1).alias("need")))
             .unionByName(u.filter(never).select((2 * F.col("id")).alias("id"), F.lit(-1).cast("long").alias("need"))))
    nodes = (u.select((2 * F.col("id")).alias("id"), F.struct(*key).alias("spot"))
             .unionByName(spots.filter("__last is not null").select((2 * F.col("__last") + 1).alias("id"), F.lit(None).cast(u.select(F.struct(*key)).schema[0].dataType).alias("spot"))))
    return (settle(nodes, "id", ["spot"], needs).filter(F.col("id") % 2 == 0)
            .select((F.col("id") / 2).cast("long").alias("id"), "accepted"))


# --- M07 ---------------------------------------------------------------------------
def upsert_place_admins(entries: DataFrame, place_admin: DataFrame,
                        id_kind: str = "key") -> DataFrame:
    """Judge admin lists per place; ``entries`` is the flattened list
    (place_id, admin_user_id or null for a new admin, fullname, username, is_active).

    Per place: 1045 malformed place id; 1016 list size not 1..10; 1017 some entry
    lacks fullname, username (null or '') or is_active (null).  Accepted entries
    with an id are updates of that user, the others create an admin user linked
    to the place.  ``managed`` tells whether an updated admin belongs to the
    place (the source does not check it).  Where entries carry a ``request_id``,
    the checks are per request and place; ``request_id`` and ``position`` (of the
    entry in its list), where present, keep the new ids of equal usernames apart.
    """
    request = [c for c in ("request_id",) if c in entries.columns]
    entry = [c for c in ("request_id", "position") if c in entries.columns]
    missing = (~V.passes(V.not_empty(F.col("fullname"))) | ~V.passes(V.not_empty(F.col("username")))
               | F.col("is_active").isNull())
    per_place = (entries.groupBy("place_id", *request)
                 .agg(F.count(F.lit(1)).alias("__n"), F.bool_or(missing).alias("__invalid")))
    pa = place_admin.select("admin_user_id", "place_id", F.lit(True).alias("__m"))
    per_place = per_place.toDF("__place", *[f"__{c}" for c in request], "__n", "__invalid")
    same = F.col("place_id").eqNullSafe(F.col("__place"))
    for c in request:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    r = (entries.join(per_place, same, "left")
         .join(pa, ["admin_user_id", "place_id"], "left"))
    code = _chain([
        (~V.passes(V.valid_id(F.col("place_id"), id_kind)), C.PLACE_ADMINS_BAD_ID),
        (~F.col("__n").between(C.ARRAY_MIN_ITEMS, C.ARRAY_MAX_ITEMS), C.PLACE_ADMINS_FIELDS),
        (F.col("__invalid"), C.PLACE_ADMINS_INVALID_ENTRY),
    ])
    ok = code == C.OK
    create = F.col("admin_user_id").isNull()
    return r.select(*entries.columns, code.alias("reason_code"),
                    F.when(ok, F.when(create, "CREATE").otherwise("UPDATE")).alias("action"),
                    F.col("__m").isNotNull().alias("managed"),
                    F.when(ok & create, stable_uuid("upsert_place_admins", F.col("place_id"), F.col("username"),
                                                    *[F.col(c) for c in entry])).alias("new_user_id"),
                    F.when(ok & create, F.concat(F.col("username"), F.lit("@" + C.ADMIN_EMAIL_DOMAIN)))
                     .alias("new_email"))


def upsert_place_admins_nested(requests: DataFrame, place_admin: DataFrame,
                               id_kind: str = "key") -> DataFrame:
    """M07 on requests in the source's shape: one row per place with an
    ``admins`` array of structs (admin_user_id or null, fullname, username,
    is_active).  The per-place checks are array expressions (``size``,
    ``forall``) on the request row itself; accepted and refused requests are
    then flattened with ``inline`` into the same output as
    ``upsert_place_admins``.
    """
    admins = F.col("admins")

    def missing(a: Column) -> Column:
        return (~V.passes(V.not_empty(a["fullname"])) | ~V.passes(V.not_empty(a["username"]))
                | a["is_active"].isNull())

    code = _chain([
        (~V.passes(V.valid_id(F.col("place_id"), id_kind)), C.PLACE_ADMINS_BAD_ID),
        (admins.isNull() | ~F.size(admins).between(C.ARRAY_MIN_ITEMS, C.ARRAY_MAX_ITEMS),
         C.PLACE_ADMINS_FIELDS),
        (~F.forall(admins, lambda a: ~missing(a)), C.PLACE_ADMINS_INVALID_ENTRY),
    ])
    flat = (requests.withColumn("reason_code", code)
            .select("place_id", "reason_code", F.inline_outer("admins")))
    pa = place_admin.select("admin_user_id", "place_id", F.lit(True).alias("__m"))
    r = flat.join(pa, ["admin_user_id", "place_id"], "left")
    ok = F.col("reason_code") == C.OK
    create = F.col("admin_user_id").isNull()
    return r.select("place_id", "admin_user_id", "fullname", "username", "is_active",
                    "reason_code",
                    F.when(ok, F.when(create, "CREATE").otherwise("UPDATE")).alias("action"),
                    F.col("__m").isNotNull().alias("managed"),
                    F.when(ok & create, stable_uuid("upsert_place_admins", F.col("place_id"),
                                                    F.col("username"))).alias("new_user_id"),
                    F.when(ok & create, F.concat(F.col("username"),
                                                 F.lit("@" + C.ADMIN_EMAIL_DOMAIN)))
                     .alias("new_email"))


def apply_place_admins(decisions: DataFrame, users: DataFrame,
                       place_admin: DataFrame) -> dict[str, DataFrame]:
    """Carry out accepted ``upsert_place_admins`` decisions.

    Returns ``users`` (new version: UPDATE entries rewrite fullname, username and
    is_active of that user (W01, one update per user or the job fails); CREATE
    entries append ADMIN users (W02)), ``place_admin`` (new version with the
    links of created admins) and ``admins`` (the response: updated and created
    admins, concatenated with ``unionByName``; ids as text since created ids are
    uuid-shaped).
    """
    acc = decisions.filter(F.col("reason_code") == C.OK)
    upd = acc.filter(F.col("action") == "UPDATE").select(
        F.col("admin_user_id").alias("id"), "place_id", "fullname", "username", "is_active")
    new = acc.filter(F.col("action") == "CREATE").select(
        F.col("new_user_id").alias("id"), "place_id", "fullname", "username", "is_active",
        F.col("new_email").alias("email"))
    users_v2 = apply_updates(users, upd.drop("place_id"), ["id"],
                             ["fullname", "username", "is_active"], policy="error")
    created_users = new.select(
        "id", "fullname", F.lit(C.GENDER_MALE).alias("gender"), "username", "email",
        F.lit(C.ROLE_ADMIN).alias("role"), F.lit(C.BAN_STATUS_ACTIVE).alias("ban_status"),
        "is_active")
    users_v2 = (users_v2.withColumn("id", F.col("id").cast("string"))
                .unionByName(created_users, allowMissingColumns=True))
    links = place_admin.withColumn("admin_user_id", F.col("admin_user_id").cast("string")) \
        .unionByName(new.select(F.col("id").alias("admin_user_id"), "place_id"),
                     allowMissingColumns=True)
    updated = (upd.join(users.select("id", "role", "email"), "id")
               .select(F.col("id").cast("string").alias("admin_user_id"), "place_id", "fullname",
                       "username", "is_active", "role", "email", F.lit("UPDATE").alias("action")))
    created = new.select(F.col("id").alias("admin_user_id"), "place_id", "fullname", "username",
                         "is_active", F.lit(C.ROLE_ADMIN).alias("role"), "email",
                         F.lit("CREATE").alias("action"))
    return {"users": users_v2, "place_admin": links, "admins": updated.unionByName(created)}


# --- M08 ---------------------------------------------------------------------------
def admit_ban_requests(requests: DataFrame, users: DataFrame, member_ban: DataFrame,
                       id_kind: str = "key", bucket: str = "minute",
                       mode: str = "snapshot") -> DataFrame:
    """Judge ban requests (id, member_user_id, ban_reason, admin_user_id, requested_at).

    1025 invalid fields; 1026 unknown user; 1033 the user is an OWNER or ADMIN;
    1027 a ban request for the member was pending at request time (created at
    or before it and not decided by then); else a new PENDING request, and the
    member's ban_status becomes PENDING.  ``mode="strict"``: a request also
    gets 1027 when an earlier request of the same batch for the member passed
    every other check (it would be pending by then).
    """
    u = users.select(F.col("id").alias("member_user_id"), F.col("role").alias("__role"))
    # Every ban request was PENDING from its creation until its decision
    # (updated_at of a decided request): +1 at creation, -1 at decision, and the
    # running sum at request time is the number of requests pending then.
    decided = (F.col("approval_status") != C.BAN_APPROVAL_PENDING) & F.col("updated_at").isNotNull()
    known = member_ban.filter((F.col("approval_status") == C.BAN_APPROVAL_PENDING) | decided)
    opened = known.select("member_user_id", F.col("created_at").alias("__bt"),
                          F.lit(1).alias("__sign"))
    closed = member_ban.filter(decided).select("member_user_id", F.col("updated_at").alias("__bt"),
                                               F.lit(-1).alias("__sign"))
    r = (requests.withColumn("__bad", _has_errors(V.ban_request_rules(id_kind)))
         .join(u, "member_user_id", "left"))
    r = asof_count(r, opened.unionByName(closed), ["member_user_id"], "requested_at", "__bt",
                   name="__npend", bucket=bucket, weight="__sign")
    code = _chain([
        (F.col("__bad"), C.BAN_REQUEST_FIELDS),
        (F.col("__role").isNull(), C.BAN_REQUEST_USER_MISSING),
        (F.col("__role").isin(C.ROLE_OWNER, C.ROLE_ADMIN), C.BAN_REQUEST_BAD_ROLE),
        (F.col("__npend") > 0, C.BAN_REQUEST_EXISTS),
    ])
    if mode == "strict":  # the settling of the batch reads its input twice: judged once
        r = cut_lineage(r.select(*requests.columns, code.alias("__snapshot")))
        code = F.col("__snapshot")
    r, code = _batch_unique(r, code, ["member_user_id"], ["requested_at", "id"],
                            C.BAN_REQUEST_EXISTS, mode)
    ok = code == C.OK
    return r.select(*requests.columns, code.alias("reason_code"),
                    F.when(ok, stable_uuid("admit_ban_requests", F.col("id"))).alias("new_ban_id"),
                    F.when(ok, F.lit(C.BAN_STATUS_PENDING)).alias("user_ban_status"))


# --- M09 ---------------------------------------------------------------------------
def decide_ban_requests(decisions: DataFrame, member_ban: DataFrame,
                        id_kind: str = "key") -> DataFrame:
    """Judge decisions (ban_request_id, decision, owner_user_id, decided_at).

    1028 invalid fields; 1031 unknown request; 1032 already decided (or decided
    earlier in the batch); REVOKED -> lifted at decision time, member ACTIVE;
    BANNED -> lifted 3 days later, member BANNED.
    """
    mb = member_ban.select(F.col("id").alias("ban_request_id"), "member_user_id",
                           F.col("updated_at").alias("__prev_updated"), F.lit(True).alias("__found"))
    r = (decisions.withColumn("__bad", _has_errors(V.ban_decision_rules(id_kind)))
         .join(mb, "ban_request_id", "left"))
    pre = _chain([
        (F.col("__bad"), C.BAN_DECISION_FIELDS),
        (F.col("__found").isNull(), C.BAN_DECISION_NOT_FOUND),
        (F.col("__prev_updated").isNotNull(), C.BAN_DECISION_PROCESSED),
    ])
    r = r.withColumn("__pre", pre)
    r = first_in_batch(r, ["ban_request_id"], ["decided_at", "decision", "owner_user_id"],
                       F.col("__pre") == C.OK)
    code = (F.when((F.col("__pre") == C.OK) & ~F.col("is_first"), C.BAN_DECISION_PROCESSED)
            .otherwise(F.col("__pre")))
    ok = code == C.OK
    banned = F.col("decision") == C.BAN_APPROVAL_BANNED
    return r.select(*decisions.columns, code.alias("reason_code"), "member_user_id",
                    F.when(ok, F.col("decision")).alias("approval_status"),
                    F.when(ok, F.when(banned, F.col("decided_at") + F.expr(C.BAN_DURATION))
                           .otherwise(F.col("decided_at"))).alias("ban_lifted_at"),
                    F.when(ok, F.when(banned, C.BAN_STATUS_BANNED).otherwise(C.BAN_STATUS_ACTIVE))
                     .alias("user_ban_status"))


# --- M10 ---------------------------------------------------------------------------
def import_members(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Judge sign-ups (id, fullname, gender, username, email [, password]).

    1001 invalid fields; 1002 the username or e-mail is taken by a stored user
    or by a sign-up of the batch that was accepted before (by id); else a MEMBER.  A refused sign-up takes
    no name: the result is that of inserting them one by one (``settle``).  Passwords are never
    carried into the output.
    """
    has_pw = "password" in requests.columns
    r = requests.withColumn("__bad", _has_errors(V.signup_rules(with_password=has_pw)))
    for key, tag in (("username", "u"), ("email", "e")):
        stored = users.select(key).distinct().withColumn(f"__t{tag}", F.lit(True))
        r = r.join(stored, key, "left")
    stored = F.coalesce(F.col("__tu"), F.lit(False)) | F.coalesce(F.col("__te"), F.lit(False))
    r = cut_lineage(r.withColumn("__stored", stored).drop("password"))
    fair = settle(r.filter(~F.col("__bad") & ~F.col("__stored")), "id", ["username", "email"])
    r = r.join(fair, "id", "left")
    code = _chain([(F.col("__bad"), C.SIGNUP_FIELDS), (F.col("__stored") | ~F.col("accepted"), C.SIGNUP_DUPLICATE)])
    ok = code == C.OK
    cols = [c for c in requests.columns if c != "password"]
    return r.select(*cols, code.alias("reason_code"),
                    F.when(ok, F.lit(C.ROLE_MEMBER)).alias("role"))


# --- table versions after the accepted decisions (W01 / W02) ------------------------
def _text_ids(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("string"))
    return df


def apply_packages(decisions: DataFrame, package: DataFrame) -> DataFrame:
    """M03 effect: package table plus the accepted packages (ids as text)."""
    new = (decisions.filter(F.col("reason_code") == C.OK)
           .select(F.col("new_package_id").alias("id"), "name", "capacity", "price", "place_id",
                   "package_type_id"))
    return _text_ids(package, "id").unionByName(new.select(*package.columns))


def apply_place_updates(decisions: DataFrame, place: DataFrame) -> DataFrame:
    """M06 effect: new place version; two accepted updates of one place fail the job."""
    upd = decisions.filter(F.col("reason_code") == C.OK).select("id", "name", "address",
                                                                "max_capacity")
    return apply_updates(place, upd, ["id"], ["name", "address", "max_capacity"], policy="error")


def apply_ban_requests(decisions: DataFrame, member_ban: DataFrame,
                       users: DataFrame) -> dict[str, DataFrame]:
    """M08 effect: new PENDING ban requests (W02) and the members' ban status
    set to PENDING (W01, keyed by the member: the intended form of K7)."""
    acc = decisions.filter(F.col("reason_code") == C.OK)
    new = acc.select(F.col("new_ban_id").alias("id"), "member_user_id",
                     F.lit(C.BAN_APPROVAL_PENDING).alias("approval_status"), "ban_reason",
                     F.lit(None).cast("timestamp_ntz").alias("ban_lifted_at"),
                     F.lit(None).cast("timestamp_ntz").alias("updated_at"),
                     F.col("requested_at").alias("created_at"))
    bans = _text_ids(member_ban, "id").unionByName(new.select(*member_ban.columns))
    status = acc.select(F.col("member_user_id").alias("id"),
                        F.col("user_ban_status").alias("ban_status"), "requested_at")
    users_v2 = apply_updates(users, status, ["id"], ["ban_status"], order_by="requested_at",
                             policy="last")
    return {"member_ban": bans, "users": users_v2}


def apply_ban_decisions(decisions: DataFrame, member_ban: DataFrame,
                        users: DataFrame) -> dict[str, DataFrame]:
    """M09 effect: decided requests get status, lift time and ``updated_at``
    (W01, one decision per request); each member takes the status of their
    latest accepted decision (W01, last by decision time)."""
    acc = decisions.filter(F.col("reason_code") == C.OK)
    users_v2 = apply_updates(
        users, acc.select(F.col("member_user_id").alias("id"),
                          F.col("user_ban_status").alias("ban_status"), "decided_at"),
        ["id"], ["ban_status"], order_by="decided_at", policy="last")
    bans_v2 = apply_updates(
        member_ban, acc.select(F.col("ban_request_id").alias("id"), "approval_status",
                               "ban_lifted_at", F.col("decided_at").alias("updated_at")),
        ["id"], ["approval_status", "ban_lifted_at", "updated_at"], policy="error")
    return {"member_ban": bans_v2, "users": users_v2}


def apply_signups(decisions: DataFrame, users: DataFrame) -> DataFrame:
    """M10 effect: users plus the accepted members (ids kept; role MEMBER)."""
    new = (decisions.filter(F.col("reason_code") == C.OK)
           .select("id", "fullname", "gender", "username", "email", "role",
                   F.lit(C.BAN_STATUS_ACTIVE).alias("ban_status"), F.lit(True).alias("is_active")))
    return users.unionByName(new, allowMissingColumns=True)
