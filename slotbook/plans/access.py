"""Access gate (A01-A04): latest ban as of each attempt, role check, route table,
and effective ban status at a point in time.

The ban lookup is an as-of join (``operators.asof``): for each attempt, the
latest BANNED record of that user created at or before the attempt.  The user
is banned when that record's ``ban_lifted_at`` is strictly after the attempt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotbook import constants as C
from slotbook.operators.asof import asof_latest, unique_rank


def _latest_ban(attempts: DataFrame, member_ban: DataFrame, bucket: str) -> DataFrame:
    bans = (member_ban.filter(F.col("approval_status") == C.BAN_APPROVAL_BANNED)
            .select(F.col("member_user_id").alias("user_id"), F.col("id").alias("ban_id"),
                    F.col("ban_lifted_at"), F.col("created_at").alias("ban_created_at")))
    # A ban created at the attempt instant counts (inclusive); ties on time go
    # to the larger ban id.
    return asof_latest(attempts, bans, ["user_id"], "attempted_at", "ban_created_at",
                       ["ban_id", "ban_lifted_at"], order=["ban_id"], bucket=bucket,
                       prefix="latest_")


def _is_banned() -> Column:
    return F.coalesce(F.col("latest_ban_lifted_at") > F.col("attempted_at"), F.lit(False))


def ban_gate(attempts: DataFrame, member_ban: DataFrame, bucket: str = "minute") -> DataFrame:
    """Every attempt with its latest ban and ``reason_code`` 9998 / 0000."""
    x = _latest_ban(attempts, member_ban, bucket)
    return x.withColumn("reason_code", F.when(_is_banned(), C.ACCESS_BANNED).otherwise(C.OK))


def role_gate(attempts: DataFrame, users: DataFrame, member_ban: DataFrame,
              allowed: Sequence[str] | Column | None = None, bucket: str = "minute") -> DataFrame:
    """Full gate.  Unknown user 9999, banned 9998, role not allowed 9999, else 0000.

    ``allowed`` is a list of roles, an ``array<string>`` column, or ``None`` to
    use each attempt's ``required_role`` column.  The ban stage runs first, so a
    banned user gets 9998 whatever the role.
    """
    if allowed is None:
        allowed_col = F.array(F.col("required_role"))
    elif isinstance(allowed, Column):
        allowed_col = allowed
    else:
        allowed_col = F.array(*[F.lit(r) for r in allowed])
    u = users.select(F.col("id").alias("user_id"), F.col("role").alias("user_role"))
    x = _latest_ban(attempts, member_ban, bucket).join(u, "user_id", "left")
    code = (F.when(F.col("user_role").isNull(), C.ACCESS_UNAUTHORIZED)
            .when(_is_banned(), C.ACCESS_BANNED)
            .when(~F.coalesce(F.array_contains(allowed_col, F.col("user_role")), F.lit(False)),
                  C.ACCESS_UNAUTHORIZED)
            .otherwise(C.OK))
    return x.withColumn("reason_code", code)


def endpoint_roles(spark: SparkSession) -> DataFrame:
    """The route table (operation -> allowed roles) as a DataFrame."""
    schema = T.StructType([T.StructField("operation", T.StringType(), False),
                           T.StructField("allowed_roles", T.ArrayType(T.StringType()), False)])
    return spark.createDataFrame([(op, list(roles)) for op, roles in C.ENDPOINT_ROLES], schema)


def endpoint_gate(attempts: DataFrame, users: DataFrame, member_ban: DataFrame,
                  bucket: str = "minute") -> DataFrame:
    """Gate attempts that name an ``operation`` against the route table.

    The route table is fixed by code (one row per operation), so broadcasting
    it is bounded no matter how large the attempt stream grows.
    """
    routes = F.broadcast(endpoint_roles(attempts.sparkSession))
    x = attempts.join(routes, "operation", "left")
    allowed = F.coalesce(F.col("allowed_roles"), F.array().cast(T.ArrayType(T.StringType())))
    return role_gate(x, users, member_ban, allowed=allowed, bucket=bucket).drop("allowed_roles")


def with_operation(attempts: DataFrame) -> DataFrame:
    """Assign each attempt one route of the table, round-robin on its id (test input)."""
    ops = F.array(*[F.lit(op) for op, _ in C.ENDPOINT_ROLES])
    return attempts.withColumn(
        "operation", F.element_at(ops, (F.col("id") % len(C.ENDPOINT_ROLES) + 1).cast("int")))


def effective_ban_status(users: DataFrame, member_ban: DataFrame, as_of) -> DataFrame:
    """Stored ban status, except BANNED whose latest ban is lifted by ``as_of`` -> ACTIVE.

    The latest BANNED record per member (created at or before ``as_of``) is a
    ``max_by`` aggregate, folded map-side, so a member with many bans costs one
    row in the shuffle.
    """
    t = F.lit(as_of).cast("timestamp_ntz") if not isinstance(as_of, Column) else as_of
    latest = (member_ban.filter((F.col("approval_status") == C.BAN_APPROVAL_BANNED)
                                & (F.col("created_at") <= t))
              .select(F.col("member_user_id").alias("id"), F.col("id").alias("ban_id"),
                      "created_at", "ban_lifted_at"))
    # latest by (created_at, ban id): a packed decimal rank keeps the
    # aggregate buffer fixed-width, so this is a hash aggregate
    rank = unique_rank(latest.schema["created_at"].dataType, "ban_id", "created_at") \
        if isinstance(latest.schema["ban_id"].dataType, (T.LongType, T.IntegerType)) \
        else F.struct("created_at", "ban_id")
    latest = latest.groupBy("id").agg(F.max_by("ban_lifted_at", rank).alias("ban_lifted_at"))
    lifted = (F.col("ban_status") == C.BAN_STATUS_BANNED) & (F.col("ban_lifted_at") <= t)
    return (users.select("id", "role", "ban_status").join(latest, "id", "left")
            .withColumn("effective_ban_status",
                        F.when(F.coalesce(lifted, F.lit(False)), C.BAN_STATUS_ACTIVE)
                        .otherwise(F.col("ban_status"))))
