"""What was so at any time: each member's ban status as intervals, and the most bookings that were
ever pending at once.  Both are sweeps along time; keys with very many events are split by
range (``operators.prefix``), and events of one instant are folded first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotbook import constants as C
from slotbook.functions.times import micros
from slotbook.operators.prefix import running


def ban_status_history(member_ban: DataFrame) -> DataFrame:
    """(member_user_id, ban_status, valid_from, valid_to): each member's effective ban status from
    the first ban request on; ``valid_to`` is null for the last.  Intervals are half open, follow each other without
    gaps, and neighbours differ.

    A request makes the status PENDING when it is made (M08) and BANNED or ACTIVE when it is decided (M09).
    While it is BANNED, it counts as ACTIVE from the time on at which the member's latest ban (by creation, then id) is
    lifted (A04).  Records without a creation time, or whose lift time is not known, never lift.
    """
    m, i = F.col("member_user_id"), F.col("id")
    banned = F.col("approval_status") == C.BAN_APPROVAL_BANNED
    lift = F.struct(F.col("ban_lifted_at"))
    no_status, no_lift = F.lit(None).cast("string"), F.lit(None).cast(member_ban.select(lift).schema[0].dataType)
    made = member_ban.filter("created_at is not null")
    events = (
        made.select(m, F.col("created_at").alias("at"), i, F.lit(0).alias("kind"), F.lit(C.BAN_STATUS_PENDING).alias("status"),
                    F.when(banned, lift).alias("lift"))
        .unionByName(made.filter((F.col("approval_status") != C.BAN_APPROVAL_PENDING) & F.col("updated_at").isNotNull())
                     .select(m, F.col("updated_at").alias("at"), i, F.lit(1).alias("kind"),
                             F.when(banned, C.BAN_STATUS_BANNED).otherwise(C.BAN_STATUS_ACTIVE).alias("status"), no_lift.alias("lift")))
        .unionByName(made.filter(banned & F.col("ban_lifted_at").isNotNull())
                     .select(m, F.col("ban_lifted_at").alias("at"), i, F.lit(2).alias("kind"), no_status.alias("status"), no_lift.alias("lift"))))
    seen = running(events, ["member_user_id"], ["at", "id", "kind"], ["status", "lift"], ["status_now", "lift_now"], "last")
    # the last event of an instant tells what is so from then on
    instants = (seen.groupBy("member_user_id", "at").agg(F.max_by(F.struct("status_now", "lift_now"), F.struct("id", "kind")).alias("s"))
                .filter("s.status_now is not null"))
    lifted = (F.col("s.status_now") == C.BAN_STATUS_BANNED) & (F.col("s.lift_now.ban_lifted_at") <= F.col("at"))
    instants = instants.select("member_user_id", "at", F.when(F.coalesce(lifted, F.lit(False)), C.BAN_STATUS_ACTIVE)
                               .otherwise(F.col("s.status_now")).alias("ban_status"))
    steps = running(instants, ["member_user_id"], ["at"], "ban_status", "before", "last", inclusive=False)
    steps = steps.filter(F.col("before").isNull() | (F.col("before") != F.col("ban_status"))).drop("before")
    back = steps.withColumn("back", -micros(steps, "at"))
    return (running(back, ["member_user_id"], ["back"], "at", "valid_to", "last", inclusive=False)
            .select("member_user_id", "ban_status", F.col("at").alias("valid_from"), "valid_to"))


def ban_status_at(history: DataFrame, as_of) -> DataFrame:
    """(member_user_id, ban_status) at one instant; members without a row then are ACTIVE."""
    t = F.lit(as_of).cast(history.schema["valid_from"].dataType)
    return (history.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))
            .select("member_user_id", "ban_status"))


def peak_pending(booking: DataFrame, by: Sequence[str], lapse: str | None = None) -> DataFrame:
    """(*by, peak, peak_at): the most bookings of a key that were PENDING at once, and when first.

    A booking is pending from its creation until it is settled (``updated_at``), to the end if it
    never is, or until ``lapse`` (an interval) after its creation at the latest.  At an instant, bookings that end
    then are no longer pending.  Bookings that end no later than they begin never were.
    """
    end = F.col("updated_at")
    if lapse is not None:
        end = F.least(F.coalesce(end, F.col("created_at") + F.expr(lapse)), F.col("created_at") + F.expr(lapse))
    spans = booking.select(*by, "created_at", end.alias("ended_at")).filter(
        F.col("created_at").isNotNull() & (F.col("ended_at").isNull() | (F.col("ended_at") > F.col("created_at"))))
    events = (spans.select(*by, F.col("created_at").alias("at"), F.lit(1).alias("step"))
              .unionByName(spans.filter("ended_at is not null").select(*by, F.col("ended_at").alias("at"), F.lit(-1).alias("step"))))
    net = events.groupBy(*by, "at").agg(F.sum("step").alias("step"))  # events of one instant are one
    level = running(net, by, ["at"], "step", "level")
    return level.groupBy(*by).agg(F.max("level").alias("peak"), F.max_by("at", F.struct("level", -micros(level, "at"))).alias("peak_at"))


def package_peaks(booking: DataFrame, package: DataFrame) -> DataFrame:
    """Each booked package's peak beside its capacity; ``filled`` where a request at the peak would be refused for capacity (1021)."""
    p = package.select(F.col("id").alias("package_id"), "place_id", "capacity")
    return (p.join(peak_pending(booking, ["package_id"]), "package_id")
            .select("package_id", "place_id", "capacity", "peak", "peak_at", (F.col("peak") >= F.col("capacity")).alias("filled")))


def place_peaks(booking: DataFrame, package: DataFrame, place: DataFrame) -> DataFrame:
    """Each booked place's peak of bookings that are pending and have not lapsed (2 h)."""
    at = booking.join(package.select(F.col("id").alias("package_id"), "place_id"), "package_id").select("place_id", "created_at", "updated_at")
    return (place.select(F.col("id").alias("place_id"), "max_capacity")
            .join(peak_pending(at, ["place_id"], C.BOOKING_TTL), "place_id")
            .select("place_id", "max_capacity", "peak", "peak_at"))
