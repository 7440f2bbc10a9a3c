"""Requests that exclude or need each other, settled as if taken one by one.

Each request may name values it takes for itself (``groups``: of the requests
with the same value in a column only one can be accepted) and other requests that
must have been accepted (``needs``).  Taken one after another by
``id``, a request is accepted if no earlier one was accepted with one of its values
and all that it needs were.  This is the lexicographically first independent
set of the conflict graph, found in rounds without forming its edges:

* a request that is the least undecided one in all its groups, and whose needs
  are met, is accepted; those that share a value with it, or need a refused
  one, are refused;
* from the third round on, chains are also settled at once: a request with
  exactly one open obstacle has the opposite fate of it (a shared value) or the
  same fate (a need), so pointers to obstacles are doubled until they end at a
  request that is decided or has several obstacles.

Every round settles at least the least undecided request; chains take the
logarithm of their length.  Groups are folded to their two least ids by
aggregates, so a value that a third of the requests share is one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotbook.session import scratch_path

SIMPLE_ROUNDS = 2


def _stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder: later steps read the columns they
    need, and their joins are planned by its size."""
    spark = df.sparkSession
    at = scratch_path(spark, "settle")
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def settle(requests: DataFrame, id: str, groups: Sequence[str], needs: DataFrame | None = None) -> DataFrame:
    """(id, accepted) for every row of ``requests``; ids are unique, integral and not null.

    A null value takes nothing.  ``needs`` holds pairs (id, need) of ids; a needed request that
    is not there, or not earlier, is never accepted in time.
    """
    names = [f"g{i}" for i in range(len(groups))]
    open_ = requests.select(F.col(id).alias("id"), *[F.col(c).alias(n) for c, n in zip(groups, names)])
    decided = None
    if needs is not None:
        open_ = _stored(open_)
        known = open_.select(F.col("id").alias("need"), F.lit(True).alias("__known"))
        needs = (needs.select("id", "need").join(known, "need", "left")
                 .withColumn("met", F.when(F.col("__known").isNull() | (F.col("need") >= F.col("id")), F.lit(False))).drop("__known"))
    settled, turn = [], 0
    while True:
        if needs is not None:
            if decided is not None:
                needs = needs.drop("met").join(decided.select(F.col("id").alias("need"), F.col("accepted").alias("met")), "need", "left")
            needs = _stored(needs.select("id", "need", "met").filter("met is null or not met"))
        marked = _obstacles(open_, names, needs)
        fates = _fates(marked, chains=turn >= SIMPLE_ROUNDS)
        round_ = _stored(_spread(marked, fates, names))
        decided = round_.filter("accepted is not null").select("id", "accepted")
        settled.append(decided)
        open_ = round_.filter("accepted is null").select("id", *names)
        turn += 1
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, settled)


def _obstacles(open_: DataFrame, names, needs: DataFrame | None) -> DataFrame:
    """Open requests with ``ptr``, one open obstacle, ``flip``, whether its fate is the opposite, ``n``, the
    number of open obstacles (2 for more), and ``lost`` for those that need a refused request."""
    if needs is not None:
        waits = needs.groupBy("id").agg(F.count_if(F.col("met").isNull()).alias("__n"), F.min(F.when(F.col("met").isNull(), F.col("need"))).alias("need"),
                                        F.count_if(F.col("met").isNotNull()).alias("__lost"))
        marked = open_.join(waits, "id", "left").withColumn("lost", F.coalesce(F.col("__lost") > 0, F.lit(False)))
        n = F.least(F.coalesce("__n", F.lit(0)), F.lit(2))
    else:
        marked = open_.withColumn("lost", F.lit(False)).withColumn("need", F.lit(None).cast(open_.schema["id"].dataType))
        n = F.lit(0)
    ptr, flip = F.col("need"), F.lit(False)
    for i, g in enumerate(names):
        held = open_.filter(F.col(g).isNotNull()).select(g, "id")
        first = held.groupBy(g).agg(F.min("id").alias(f"first{i}"))
        second = held.join(first, g).filter(F.col("id") > F.col(f"first{i}")).groupBy(g).agg(F.min("id").alias(f"second{i}"))
        marked = marked.join(first.join(second, g), g, "left")   # a value that one request holds alone hinders nobody
        behind = F.coalesce(F.col("id") > F.col(f"first{i}"), F.lit(False))
        n = n + F.when(behind, F.when(F.col("id") == F.col(f"second{i}"), 1).otherwise(2)).otherwise(0)
        ptr = F.when(behind, F.col(f"first{i}")).otherwise(ptr)
        flip = F.when(behind, F.lit(True)).otherwise(flip)
    return _stored(marked.select("id", *names, "lost", n.alias("n"), ptr.alias("ptr"), flip.alias("flip")))


def _fates(marked: DataFrame, chains: bool) -> DataFrame:
    """(id, accepted) of the requests that this round decides by themselves."""
    alive = marked.filter("not lost")
    free = alive.filter("n = 0").select("id", F.lit(True).alias("accepted"))
    if not chains:
        return free
    one = alive.filter("n = 1").select("id", "ptr", "flip")
    # a request with no obstacle, or several, or that is lost, ends a chain
    ends = marked.filter("lost or n <> 1").select("id", F.when(F.col("lost"), F.lit(False)).when(F.col("n") == 0, F.lit(True)).alias("fate"))
    chain = _stored(one)
    while True:
        ahead = chain.select(F.col("id").alias("ptr"), F.col("ptr").alias("__ptr"), F.col("flip").alias("__flip"))
        stepped = chain.join(ahead, "ptr", "left")
        chain = _stored(stepped.select("id", F.coalesce("__ptr", "ptr").alias("ptr"),
                                           F.when(F.col("__ptr").isNotNull(), F.col("flip") != F.col("__flip"))
                                           .otherwise(F.col("flip")).alias("flip"),
                                           F.col("__ptr").isNotNull().alias("moved")))
        if chain.filter("moved").isEmpty():
            break
        chain = chain.drop("moved")
    found = (chain.join(ends.select(F.col("id").alias("ptr"), "fate"), "ptr").filter("fate is not null")
             .select("id", (F.col("fate") != F.col("flip")).alias("accepted")))
    return free.unionByName(found)


def _spread(marked: DataFrame, fates: DataFrame, names) -> DataFrame:
    """Open requests with ``accepted``, null for those that stay open: fates, and the refused
    ones that share a value with an accepted one."""
    fates = _stored(fates)
    out = marked.join(fates, "id", "left")
    won = marked.join(fates.filter("accepted"), "id", "left_semi")
    for i, g in enumerate(names):
        taken = won.filter(F.col(g).isNotNull()).select(g, F.col("id").alias(f"__winner{i}"))
        out = out.join(taken, g, "left")
    beaten = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"__winner{i}") != F.col("id"), F.lit(False)) for i in range(len(names))], F.lit(False))
    return out.withColumn("accepted", F.when(F.col("lost") | beaten, F.lit(False)).otherwise(F.col("accepted"))) \
              .select("id", *names, "accepted")
