"""The two time-driven rules, run on Structured Streaming.

S01 ``expiry_stream``: a booking with no completion within 2 hours is emitted
EXPIRED.  Stream-stream *left outer* join of bookings and completions on the
member and a 2-hour slot, with the time range
``created_at <= completed_at < created_at + 2h`` and a watermark on both sides.  A booking is emitted once the watermark shows
no completion can still arrive for it; the join state is bounded by the
watermark, so it stays constant-size however long the stream runs.

S02 ``profit_stream``: daily profit (R07) kept current on a stream of
bookings: a stream-static join to the order -> price table, a 1-day tumbling
window sum, written in ``complete`` mode (one row per day of state).

Event time must be ``timestamp`` (not ``timestamp_ntz``) for watermarks; with
the session zone pinned to UTC the cast keeps wall-clock values.  Both runners
write to files under the shared checkpoint folder (exactly-once file sink /
idempotent overwrite in ``foreachBatch``), so a restarted query resumes from
its checkpoint without duplicating output.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotbook import constants as C
from slotbook.session import cut_lineage, scratch_path
from slotbook.sources.tables import RAW_SCHEMAS, table_path
from slotbook.sources.views import booking_from, completion_from

EXPIRY_DELAY = "1 hour"      # watermark delay (lateness tolerated) for S01
PROFIT_DELAY = "1 day"       # watermark delay for S02
TTL_SECONDS = 7200           # C.BOOKING_TTL


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def utc_session(spark: SparkSession):
    """Run with the session zone pinned to UTC (NTZ -> timestamp casts and day
    windows are then wall-clock exact), restoring the caller's zone after.

    State of new queries goes to RocksDB (off-heap, spills to local disk and is
    snapshotted into the checkpoint), unless the session already names a
    provider: join state grows with the watermark delay times the event rate.
    """
    zone, provider = "spark.sql.session.timeZone", "spark.sql.streaming.stateStore.providerClass"
    before = {k: spark.conf.get(k, None) for k in (zone, provider)}
    spark.conf.set(zone, "UTC")
    if not before[provider] or before[provider].endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(provider, ROCKSDB_PROVIDER)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _event_time(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


def _slot(time):
    return F.floor(time.cast("long") / TTL_SECONDS)


def expiry_stream(bookings: DataFrame, completions: DataFrame, delay: str = EXPIRY_DELAY) -> DataFrame:
    """S01 on streams of bookings and completions: EXPIRED bookings (append mode).

    The join key is the member and a slot as long as a booking lives.  A completion can
    end a booking of its own slot or of the one before, so it is put in both, and
    a member with very many bookings is spread over tasks by time.
    """
    b = (_event_time(bookings, "created_at").withColumn("b_slot", _slot(F.col("created_at")))
         .withWatermark("created_at", delay))
    at = _slot(F.col("completed_at"))
    c = (_event_time(completions, "completed_at")
         .select(F.col("id").alias("completion_id"), F.col("member_user_id").alias("c_member"),
                 "completed_at", F.explode(F.array(at, at - 1)).alias("c_slot"))
         .withWatermark("completed_at", delay))
    cond = ((F.col("c_member") == F.col("member_user_id")) & (F.col("c_slot") == F.col("b_slot"))
            & (F.col("completed_at") >= F.col("created_at"))
            & (F.col("completed_at") < F.col("created_at") + F.expr(C.BOOKING_TTL)))
    j = b.join(c, cond, "leftOuter")
    return (j.filter(F.col("completion_id").isNull())
            .select(F.col("id").alias("booking_id"), "member_user_id", "package_id",
                    F.col("created_at").cast("timestamp_ntz").alias("created_at"),
                    (F.col("created_at") + F.expr(C.BOOKING_TTL)).cast("timestamp_ntz")
                     .alias("expired_at"),
                    F.lit(C.ORDER_EXPIRED).alias("order_status")))


def profit_stream(orders: DataFrame, first_part: DataFrame, package: DataFrame,
                  delay: str = PROFIT_DELAY) -> DataFrame:
    """S02 on a streaming orders DataFrame: profit per day (complete mode)."""
    price = package.select(F.col("id").alias("package_id"), "price")
    done = (booking_from(orders, first_part)
            .filter(F.col("order_status") == C.ORDER_COMPLETED)
            .join(price, "package_id"))
    return (_event_time(done, "created_at").withWatermark("created_at", delay)
            .groupBy(F.window("created_at", "1 day"))
            .agg(F.sum("price").alias("profit")))


def _read_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int | None = None):
    r = (spark.readStream.schema(RAW_SCHEMAS[table])
         .option("pathGlobFilter", f"{table}.parquet"))
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(table_path(sf_dir, table).rsplit("/", 1)[0])


def run_expiry(spark: SparkSession, bookings: DataFrame, completions: DataFrame,
               out_path: str | None = None, delay: str = EXPIRY_DELAY, checkpoint: str | None = None) -> DataFrame:
    """Run S01 until the available input is consumed; return what it emitted.

    A later call with the same ``out_path`` (and ``checkpoint``, by default a
    folder named after it) goes on where the last one ended.
    """
    out = out_path or scratch_path(spark, "expiry-out")
    checkpoint = checkpoint or f"{out.rstrip('/')}-checkpoint"
    with utc_session(spark):
        q = (expiry_stream(bookings, completions, delay).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(out)


def open_bookings(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Bookings that S01 still holds in its state: neither completed nor expired at its last watermark.

    Read from the join's checkpoint by the state data source, one task a state partition, while the query
    is stopped; the query can go on afterwards.  What was emitted, what is open here
    and what was completed are all bookings.
    """
    held = (spark.read.format("statestore").option("storeName", "left-keyWithIndexToValue").load(checkpoint)
            .filter(~F.col("value.matched")))
    return held.select(F.col("value.id").alias("booking_id"), F.col("value.member_user_id").alias("member_user_id"),
                       F.col("value.package_id").alias("package_id"),
                       F.col("value.created_at").cast("timestamp_ntz").alias("created_at"),
                       F.lit(C.ORDER_PENDING).alias("order_status"))


def run_profit(spark: SparkSession, orders_stream: DataFrame, first_part: DataFrame,
               package: DataFrame, out_path: str | None = None,
               checkpoint: str | None = None) -> DataFrame:
    """Run S02 until the available input is consumed; return the latest full result.

    A later call with the same ``out_path`` goes on where the last one ended.
    """
    out = out_path or scratch_path(spark, "profit-out")
    checkpoint = checkpoint or f"{out.rstrip('/')}-checkpoint"

    def write(batch: DataFrame, epoch: int) -> None:
        # Complete mode hands over the whole (small: one row per day) result.  Each
        # epoch has its own folder: a replay overwrites only its own, and a
        # crash leaves the last complete result as it was.
        (batch.select(F.to_date(F.col("window.start")).cast("string").alias("created_at"),
                      F.col("profit").cast("int").alias("profit"))
         .write.mode("overwrite").parquet(f"{out}/epoch={epoch}"))

    # The static side is reused by every micro-batch: compute it once and cut
    # its lineage into the shared checkpoint folder.  (It maps an order to its
    # package only because the test data stores bookings as TPC-H orders; a
    # booking event that carries its package id needs just the package price
    # table, which AQE broadcasts when it is small.)
    static_first = cut_lineage(first_part)
    with utc_session(spark):
        q = (profit_stream(orders_stream, static_first, package).writeStream
             .outputMode("complete").foreachBatch(write)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    got = spark.read.parquet(out)
    return got.filter(F.col("epoch") == got.agg(F.max("epoch")).first()[0]).drop("epoch")


def stream_expiry_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S01 over the events table of ``sf_dir``, then the bookings that are still open."""
    from slotbook.registry import catalog
    events = _read_stream(spark, sf_dir, "events")
    out = scratch_path(spark, "expiry-out")
    run_expiry(spark, catalog(spark, sf_dir).live_booking_of(events), completion_from(events), out)
    with utc_session(spark):
        return open_bookings(spark, f"{out}-checkpoint")


def stream_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered S01: the events table of ``sf_dir`` read as a stream."""
    from slotbook.registry import catalog
    events = _read_stream(spark, sf_dir, "events")
    return run_expiry(spark, catalog(spark, sf_dir).live_booking_of(events), completion_from(events))


def stream_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered S02: the orders table of ``sf_dir`` read as a stream."""
    from slotbook.registry import catalog
    t = catalog(spark, sf_dir)
    return run_profit(spark, _read_stream(spark, sf_dir, "orders"), t.first_part, t.package)
