"""The ban gate (A01, A02) on streams: attempts are judged as bans arrive.

Attempts and ban records are one stream of events with one watermark, keyed by ``BUCKETS`` buckets of users.  A
stateful operator holds a bucket's open attempts and its bans, as packed rows.  Once the watermark has passed an
attempt, every ban that can count for it has arrived: a timer fires, the bucket's attempts behind the watermark are
judged together, each by the latest ban of its user created at or before it, and leave.  Of a user's bans before the
watermark only the latest is kept, so the state is bounded by the delay and the banned users, not by the length of the stream.

Calls to the state cost far more than rows, so their number follows the buckets, not the users.  A user
with very many attempts is spread over ``SALTS`` buckets by attempt; the user's bans, which are few, go to
all of them.  Results equal the batch gate for the attempts behind the watermark; a stopped query goes on from its checkpoint.
Attempts and bans without a time are left out, bans without a user count for nobody.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from slotbook import constants as C
from slotbook.functions.times import micros
from slotbook.session import scratch_path
from slotbook.streaming.jobs import utc_session

GATE_DELAY = "1 hour"
SALTS = 8
BUCKETS = 1024
NONE = -(1 << 63)   # stands for null in packed rows
_COLUMNS = ["user_id", "id", "at", "lifted"]   # times are microseconds
_PACKED = "rows binary"
_OUT = "user_id bigint, id bigint, at bigint, latest_ban_id bigint, lifted bigint, reason_code string"


def _unpacked(state) -> np.ndarray:
    return np.concatenate([np.zeros((0, 4), np.int64), *[np.frombuffer(rows, np.int64).reshape(-1, 4) for (rows,) in state.get()]])


def _latest(asked: np.ndarray, bans: np.ndarray) -> np.ndarray:
    """For each attempt the place in ``bans`` of its user's latest ban (by time, then id) at or before it, or -1."""
    n = len(bans)
    user, id_, at, _ = np.concatenate([bans, asked]).T
    kind = np.arange(len(user)) >= n
    order = np.lexsort((id_, kind, at, user))
    last = np.maximum.accumulate(np.where(kind[order], -1, np.arange(len(order))))
    ban = np.where(last >= 0, order[last], -1)
    ban = np.where((ban >= 0) & (user[ban] == user[order]), ban, -1)
    out = np.empty(len(order), np.int64)
    out[order] = ban
    return out[n:]


def _nullable(values: np.ndarray, null: np.ndarray):
    return pd.arrays.IntegerArray(np.where(null, 0, values), null)


class BanGate(StatefulProcessor):
    """A lift time of null never lifts anything."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempts = handle.getListState("attempts", _PACKED)
        self.bans = handle.getListState("bans", _PACKED)
        self.timer = handle.getValueState("timer", "ms bigint")

    def _wake(self, rows: np.ndarray) -> None:
        """One timer a bucket: when the watermark passes the first open attempt."""
        due = int(rows[:, 2].min()) // 1000 + 1
        if self.timer.exists():
            (have,) = self.timer.get()
            if have <= due:
                return
            self.handle.deleteTimer(have)
        self.timer.update((due,))
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            banned = part["is_ban"].to_numpy(bool)
            packed = part[_COLUMNS].to_numpy(np.int64)
            if banned.any():
                self.bans.appendValue((packed[banned].tobytes(),))
            if not banned.all():
                self.attempts.appendValue((packed[~banned].tobytes(),))
                self._wake(packed[~banned])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, bans = _unpacked(self.attempts), _unpacked(self.bans)
        due, rest = waiting[waiting[:, 2] < passed], waiting[waiting[:, 2] >= passed]
        met = _latest(due, bans)
        bans_or_none = np.concatenate([bans, np.full((1, 4), NONE)])
        ban, lifted = bans_or_none[met, 1], bans_or_none[met, 3]
        if len(bans):
            bans = bans[np.lexsort((bans[:, 1], bans[:, 2], bans[:, 0]))]
            replaced = np.append((bans[1:, 0] == bans[:-1, 0]) & (bans[1:, 2] < passed), False)
            self._put(self.bans, bans[~replaced])
        self._put(self.attempts, rest)
        if len(rest):
            self._wake(rest)
        if len(due):
            yield pd.DataFrame({"user_id": _nullable(due[:, 0], due[:, 0] == NONE), "id": due[:, 1], "at": due[:, 2],
                                "latest_ban_id": _nullable(ban, met < 0), "lifted": _nullable(lifted, lifted == NONE),
                                "reason_code": np.where(lifted > due[:, 2], C.ACCESS_BANNED, C.OK).astype(object)})

    @staticmethod
    def _put(state, rows: np.ndarray) -> None:
        if len(rows):
            state.put([(rows.tobytes(),)])
        else:
            state.clear()

    def close(self) -> None:
        pass


def _bucket(user, salt):
    return F.pmod(F.xxhash64(user, salt), F.lit(BUCKETS)).cast("int")


def gate_events(attempts: DataFrame, member_ban: DataFrame, delay: str = GATE_DELAY) -> DataFrame:
    """Attempts (id, user_id, attempted_at) and ban records as one stream of events by bucket; a user's bans
    go to all buckets of the user."""
    none = F.lit(NONE).cast("bigint")
    attempts = attempts.filter(F.col("attempted_at").isNotNull())
    user = F.col("user_id").cast("bigint")
    asked = attempts.select(_bucket(user, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).alias("bucket"), F.lit(False).alias("is_ban"),
                            F.coalesce(user, none).alias("user_id"), F.col("id").cast("bigint").alias("id"),
                            F.col("attempted_at").cast("timestamp").alias("event_time"), micros(attempts, "attempted_at").alias("at"),
                            none.alias("lifted"))
    banned = member_ban.filter((F.col("approval_status") == C.BAN_APPROVAL_BANNED) & F.col("created_at").isNotNull() & F.col("member_user_id").isNotNull())
    user = F.col("member_user_id").cast("bigint")
    buckets = F.array_distinct(F.array(*[_bucket(user, F.lit(k)) for k in range(SALTS)]))
    bans = banned.select(F.explode(buckets).alias("bucket"), F.lit(True).alias("is_ban"), user.alias("user_id"), F.col("id").cast("bigint").alias("id"),
                         F.col("created_at").cast("timestamp").alias("event_time"), micros(banned, "created_at").alias("at"),
                         F.coalesce(micros(banned, "ban_lifted_at"), none).alias("lifted"))
    return asked.unionByName(bans).withWatermark("event_time", delay)


def gate_stream(attempts: DataFrame, member_ban: DataFrame, delay: str = GATE_DELAY) -> DataFrame:
    """A01 on streams (append mode): id, user_id, attempted_at, latest_ban_id, latest_ban_lifted_at, reason_code."""
    judged = gate_events(attempts, member_ban, delay).groupBy("bucket").transformWithStateInPandas(
        BanGate(), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
    return judged.select("id", "user_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("attempted_at"), "latest_ban_id",
                         F.timestamp_micros("lifted").cast("timestamp_ntz").alias("latest_ban_lifted_at"), "reason_code")


def role_gate_stream(attempts: DataFrame, users: DataFrame, member_ban: DataFrame, allowed, delay: str = GATE_DELAY) -> DataFrame:
    """A02 on streams: unknown user 9999, banned 9998, a role not in ``allowed`` 9999, else 0000; ``users`` is a table."""
    u = users.select(F.col("id").alias("user_id"), F.col("role").alias("user_role"))
    code = (F.when(F.col("user_role").isNull(), C.ACCESS_UNAUTHORIZED).when(F.col("reason_code") == C.ACCESS_BANNED, C.ACCESS_BANNED)
            .when(~F.col("user_role").isin(*allowed), C.ACCESS_UNAUTHORIZED).otherwise(C.OK))
    return gate_stream(attempts, member_ban, delay).join(u, "user_id", "left").withColumn("reason_code", code)


def run_gate(spark: SparkSession, judged, out_path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a gate (``judged``: a function that gives its stream) until the available input is consumed; return
    what it has emitted.  A later call with the same ``out_path`` goes on where the last one ended."""
    out = out_path or scratch_path(spark, "gate-out")
    checkpoint = checkpoint or f"{out.rstrip('/')}-checkpoint"
    with utc_session(spark):
        q = (judged().writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(out)


def stream_ban_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered A01 on a stream of the events table of ``sf_dir``."""
    from slotbook.sources.views import attempts_from, bans_from
    from slotbook.streaming.jobs import _read_stream

    events = _read_stream(spark, sf_dir, "events")
    return run_gate(spark, lambda: gate_stream(attempts_from(events), bans_from(events)))
