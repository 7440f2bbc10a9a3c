"""Property test: the Spark validation rules agree with the fixed patterns read
as full matches (Python ``re``) on generated strings, including nulls."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotbook import constants as C
from slotbook.functions import validate as V

ALPHABET = "abcXYZ 019-_.@+#!é\t"
UUIDISH = st.builds(
    lambda a, b, c, d, e: f"{a}-{b}-{c}-{d}-{e}",
    st.text("0123456789abcdefABCDEF", min_size=8, max_size=8),
    st.text("0123456789abcdef", min_size=4, max_size=4),
    st.text("0123456789abcdef4", min_size=4, max_size=4),
    st.text("0123456789ab89", min_size=4, max_size=4),
    st.text("0123456789abcdef", min_size=12, max_size=12))
VALUES = st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=12), UUIDISH), max_size=60)

RULES = {
    "alpha": (V.alpha_spaces, C.RE_ALPHA_SPACES),
    "alnum": (V.alphanumeric, C.RE_ALPHANUMERIC),
    "numeric": (V.numeric, C.RE_NUMERIC),
    "email": (V.email, C.RE_EMAIL),
    "uuid4": (V.uuid_v4, C.RE_UUID_V4),
    "uuid": (V.uuid_any, C.RE_UUID_ANY),
}


def _py(pattern, v):
    return v is not None and re.search(pattern, v) is not None


@settings(max_examples=8, deadline=None)
@given(VALUES)
def test_rules_match_patterns(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    cols = [V.passes(rule(F.col("v"))).alias(name) for name, (rule, _) in RULES.items()]
    cols.append(V.passes(V.not_empty(F.col("v"))).alias("not_empty"))
    got = {r.i: r for r in df.select("i", *cols).collect()}
    for i, v in enumerate(values):
        for name, (_, pattern) in RULES.items():
            assert got[i][name] == _py(pattern, v), (name, v)
        assert got[i]["not_empty"] == (v is not None and len(v) > 0)
