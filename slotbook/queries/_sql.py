"""SQL spellings of the validation rules, for oracle queries (DuckDB dialect).

Each ``ok_*`` returns a predicate that is never null: a null input fails,
exactly like ``functions.validate.passes``.  The patterns are written here anew, so
that a wrong pattern of the engine shows.
"""

from __future__ import annotations

from slotbook.functions.ids import stable_uuid_sql  # noqa: F401  (re-export)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ok(pred: str) -> str:
    return f"coalesce(({pred}), false)"


def not_empty(c: str) -> str:
    return f"({c} IS NOT NULL AND length(CAST({c} AS VARCHAR)) > 0)"


def rx(c: str, pattern: str) -> str:
    return f"regexp_full_match(CAST({c} AS VARCHAR), {_q(pattern)})"


def alpha(c: str) -> str:
    return ok(f"{not_empty(c)} AND {rx(c, '([A-Z]|[a-z]| )+')}")


def alnum(c: str) -> str:
    return ok(f"{not_empty(c)} AND {rx(c, '([A-Z]|[a-z]|[0-9])+')}")


def numeric(c: str) -> str:
    return ok(f"{not_empty(c)} AND {rx(c, '(-|[+])?[0-9]+')} "
              f"AND TRY_CAST(ltrim(CAST({c} AS VARCHAR), '+') AS INTEGER) IS NOT NULL")


def key(c: str) -> str:
    return ok(not_empty(c))


def one_of(c: str, values) -> str:
    vals = ", ".join(_q(v) for v in values)
    return ok(f"{not_empty(c)} AND {c} IN ({vals})")


def email(c: str) -> str:
    return ok(rx(c, r'[^@\s]+@[^@\s]+[.][^@\s]+'))


def any_bad(*oks: str) -> str:
    return "NOT (" + " AND ".join(oks) + ")"


def msg(text: str) -> str:
    return _q(text)
