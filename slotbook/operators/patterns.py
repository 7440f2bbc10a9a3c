"""Many callers' LIKE patterns against a table of texts, by equality joins.

``text LIKE pattern`` between two tables is a nested-loop join.  Here each pattern
is filed under one thing that every text it matches must have, and each text is looked up
under all things it has:

* without a wildcard: the whole text;
* with a literal beginning: that prefix; else with a literal end: that suffix;
* else with a literal part: the first one or two characters of the first one;
* else (only wildcards): the least length.

The pairs that meet are then checked by LIKE itself.  ``%`` and ``_`` are wildcards, a backslash takes the next
character as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = r"(?:[^\\]|\\.)"          # a character, or an escaped one
_PLAIN = r"(?:[^%_\\]|\\.)"        # one that is no wildcard


def _literal(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\\(.)", "$1")


def filed(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """``patterns`` with ``filed_as``, the key under which a pattern is looked up."""
    p = F.col(pattern)
    head = F.regexp_extract(p, rf"(?s)^({_PLAIN}*)", 1)
    tail = F.regexp_extract(p, rf"(?s)^{_TOKEN}*?[%_]({_PLAIN}*)$", 1)
    part = _literal(F.regexp_extract(p, rf"(?s)^[%_]+({_PLAIN}+)", 1))
    least = F.length(F.regexp_replace(p, "%", ""))
    key = (F.when(head == p, F.concat(F.lit("="), _literal(p)))
           .when(head != "", F.concat(F.lit("<"), _literal(head)))
           .when(tail != "", F.concat(F.lit(">"), _literal(tail)))
           .when(part != "", F.concat(F.lit("~"), F.substring(part, 1, 2)))
           .otherwise(F.concat(F.lit("#"), least.cast("string"))))
    return patterns.withColumn("filed_as", key)


def keys_of(text: Column) -> Column:
    """All keys under which patterns that match ``text`` can be filed."""
    size = F.length(text)

    def each(first: int, make) -> Column:
        return F.when(size >= first, F.transform(F.sequence(F.lit(first), size), make)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(
        F.array(F.concat(F.lit("="), text)),
        each(1, lambda n: F.concat(F.lit("<"), F.substring(text, F.lit(1), n))),
        each(1, lambda n: F.concat(F.lit(">"), F.right(text, n))),
        each(1, lambda n: F.concat(F.lit("~"), F.substring(text, n, F.lit(1)))),
        each(2, lambda n: F.concat(F.lit("~"), F.substring(text, n - 1, F.lit(2)))),
        F.transform(F.sequence(F.lit(0), size), lambda n: F.concat(F.lit("#"), n.cast("string")))))


def like_any(texts: DataFrame, text: str, patterns: DataFrame, caller: str, pattern: str = "pattern") -> DataFrame:
    """(caller, text) once for every caller with a pattern that matches the text."""
    each = texts.select(F.col(text).cast("string").alias("__text")).filter("__text is not null").distinct()
    asked = filed(patterns.filter(F.col(pattern).isNotNull()).select(F.col(caller).alias("__caller"), F.col(pattern).alias("__pattern")).distinct(),
                  "__pattern")
    met = each.select("__text", F.explode(keys_of(F.col("__text"))).alias("filed_as")).join(asked, "filed_as")
    return (met.filter(F.expr("__text like __pattern")).select(F.col("__caller").alias(caller), F.col("__text").alias(text)).distinct())
