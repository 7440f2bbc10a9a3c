"""Field validation rules (V01-V10) as Column expressions.

Each rule returns a boolean Column that is true when the value passes; a null
result counts as a failure.  ``collect_errors`` turns (message, rule) pairs into
an ``array<string>`` of distinct messages in field order, which is what the
source application returns on a failed request.  All rules are built-in
expressions (regex, length, isin), so validation stays inside codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotbook import constants as C


def _str(col: Column) -> Column:
    return col.cast("string")


def not_empty(col: Column) -> Column:                      # V02
    return col.isNotNull() & (F.length(_str(col)) > 0)


def alpha_spaces(col: Column) -> Column:                   # V03
    return _str(col).rlike(C.RE_ALPHA_SPACES)


def alphanumeric(col: Column) -> Column:                   # V04
    return _str(col).rlike(C.RE_ALPHANUMERIC)


def numeric(col: Column) -> Column:                        # V05
    """Digits that fit the integer columns they are written to."""
    return _str(col).rlike(C.RE_NUMERIC) & _str(col).try_cast("int").isNotNull()


def uuid_v4(col: Column) -> Column:                        # V06 (body ids)
    return _str(col).rlike(C.RE_UUID_V4)


def uuid_any(col: Column) -> Column:                       # V06 (path ids)
    return _str(col).rlike(C.RE_UUID_ANY)


def one_of(col: Column, values: Sequence[str]) -> Column:  # V07
    return col.isin(*values)


def email(col: Column) -> Column:                          # V08
    return _str(col).rlike(C.RE_EMAIL)


def strong_password(col: Column) -> Column:                # V09
    s = _str(col)
    return ((F.length(s) >= C.STRONG_PASSWORD_MIN_LENGTH) & s.rlike(C.RE_LOWER)
            & s.rlike(C.RE_UPPER) & s.rlike(C.RE_DIGIT) & s.rlike(C.RE_SYMBOL))


def array_size_between(col: Column, lo: int = C.ARRAY_MIN_ITEMS,
                       hi: int = C.ARRAY_MAX_ITEMS) -> Column:  # V10
    return F.size(col).between(lo, hi)


def valid_id(col: Column, kind: str = "key") -> Column:
    """Id format rule.

    ``uuid4`` / ``uuid`` check the textual uuid forms the source application
    uses for body / path ids.  ``key`` is for integer or opaque keys (as in
    the test tables): present and, for strings, non-empty.
    """
    if kind == "uuid4":
        return not_empty(col) & uuid_v4(col)
    if kind == "uuid":
        return not_empty(col) & uuid_any(col)
    if kind == "key":
        return not_empty(col)
    raise ValueError(f"unknown id kind {kind!r}")


def passes(rule: Column) -> Column:
    """Null-safe: a rule that evaluates to null fails."""
    return F.coalesce(rule, F.lit(False))


def collect_errors(rules: Iterable[tuple[str, Column]]) -> Column:
    """Distinct messages of the failing rules, in the order given.

    Built from ``flatten`` of one- or zero-element arrays rather than a lambda
    ``filter``, so the expression stays inside whole-stage codegen.
    """
    empty = F.array().cast(T.ArrayType(T.StringType()))
    parts = [F.when(passes(rule), empty).otherwise(F.array(F.lit(msg))) for msg, rule in rules]
    if not parts:
        return empty
    return F.array_distinct(F.flatten(F.array(*parts)))


def all_pass(rules: Iterable[tuple[str, Column]]) -> Column:
    """True when every rule passes (what the jobs need: no message array)."""
    ok = [passes(rule) for _, rule in rules]
    if not ok:
        return F.lit(True)
    out = ok[0]
    for c in ok[1:]:
        out = out & c
    return out


def validate_fields(df: DataFrame, rules: Iterable[tuple[str, Column]],
                    name: str = "errors") -> DataFrame:
    """Attach ``errors array<string>``; an empty array means the row is valid."""
    return df.withColumn(name, collect_errors(rules))


# --- rule sets per request kind (field order = declaration order) ------------
def signup_rules(with_password: bool = False) -> list[tuple[str, Column]]:
    g, f, u, e = F.col("gender"), F.col("fullname"), F.col("username"), F.col("email")
    rules = [
        (C.MSG_SIGNUP_GENDER, not_empty(g) & one_of(g, C.GENDERS)),
        (C.MSG_SIGNUP_FULLNAME, not_empty(f) & alpha_spaces(f)),
        (C.MSG_SIGNUP_USERNAME, not_empty(u) & alphanumeric(u)),
        (C.MSG_SIGNUP_EMAIL, email(e)),
    ]
    if with_password:
        rules.append((C.MSG_SIGNUP_PASSWORD, strong_password(F.col("password"))))
    return rules


def ban_request_rules(id_kind: str = "key") -> list[tuple[str, Column]]:
    m, r = F.col("member_user_id"), F.col("ban_reason")
    id_rule = valid_id(m, "uuid4" if id_kind == "uuid4" else id_kind)
    return [(C.MSG_BAN_MEMBER_ID, id_rule), (C.MSG_BAN_REASON, not_empty(r) & alpha_spaces(r))]


def ban_decision_rules(id_kind: str = "key") -> list[tuple[str, Column]]:
    i, d = F.col("ban_request_id"), F.col("decision")
    return [(C.MSG_BAN_REQUEST_ID, valid_id(i, id_kind)),
            (C.MSG_BAN_DECISION, not_empty(d) & one_of(d, (C.BAN_APPROVAL_BANNED,
                                                            C.BAN_APPROVAL_REVOKED)))]


def place_create_rules(id_kind: str = "key") -> list[tuple[str, Column]]:
    n, mc, a, c = F.col("name"), F.col("max_capacity"), F.col("address"), F.col("city_id")
    names = F.col("admin_name_list")
    return [(C.MSG_PLACE_NAME, not_empty(n) & alpha_spaces(n)),
            (C.MSG_PLACE_MAX_CAPACITY, not_empty(mc) & numeric(mc)),
            (C.MSG_PLACE_ADDRESS, not_empty(a)),
            (C.MSG_PLACE_CITY_ID, valid_id(c, id_kind)),
            (C.MSG_PLACE_ADMIN_NAMES, names.isNotNull() & array_size_between(names))]


def place_update_rules() -> list[tuple[str, Column]]:
    n, mc, a = F.col("name"), F.col("max_capacity"), F.col("address")
    return [(C.MSG_PLACE_NAME, not_empty(n) & alpha_spaces(n)),
            (C.MSG_PLACE_MAX_CAPACITY, not_empty(mc) & numeric(mc)),
            (C.MSG_PLACE_ADDRESS, not_empty(a))]


def package_create_rules(id_kind: str = "key") -> list[tuple[str, Column]]:
    n, cap, pr, t = F.col("name"), F.col("capacity"), F.col("price"), F.col("package_type_id")
    return [(C.MSG_PACKAGE_NAME, not_empty(n) & alpha_spaces(n)),
            (C.MSG_PACKAGE_CAPACITY, not_empty(cap) & numeric(cap)),
            (C.MSG_PACKAGE_PRICE, not_empty(pr) & numeric(pr)),
            (C.MSG_PACKAGE_TYPE_ID, valid_id(t, id_kind))]


def booking_create_rules(id_kind: str = "key") -> list[tuple[str, Column]]:
    return [(C.MSG_BOOKING_PACKAGE_ID, valid_id(F.col("package_id"), id_kind))]


def booking_status_rules() -> list[tuple[str, Column]]:
    s = F.col("new_status")
    return [(C.MSG_BOOKING_STATUS, not_empty(s) & one_of(s, (C.ORDER_COMPLETED, C.ORDER_EXPIRED)))]
