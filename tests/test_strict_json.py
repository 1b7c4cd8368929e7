"""Strict JSON against texts that break one rule each."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.sources import strict_json

CASES = [
    ('{"b": 1, "a": [1, 2.50, {"z": null, "y": true}]}', '{"a":[1,2.5,{"y":true,"z":null}],"b":1}', None),
    (' \n[1]\t', "[1]", None), ('"é\\u00e9\\n"', '"éé\\n"', None), ("12345678901234567890123", "12345678901234567890123", None),
    ('{"a": 1, "a": 1}', None, "repeated_key"), ('[{"x": {"a": 1, "b": 2, "a": 3}}]', None, "repeated_key"), ('{"a": {"a": 1}}', '{"a":{"a":1}}', None),
    ("[NaN]", None, "not_a_number"), ('{"a": -Infinity}', None, "not_a_number"), ("1e999", None, "beyond_doubles"), ("1 2", None, "trailing_text"), ('{"a": 1}}', None, "trailing_text"),
    ("{'a': 1}", None, "malformed"), ('{"a": 1,}', None, "malformed"), ("[1", None, "malformed"), ("﻿1", None, "malformed"), ("\xa01", None, "malformed"), ('"\\ud800"', None, "lone_surrogate"),
    ("[" * 100_000, None, "too_deep"), ("", None, "empty"), (" \n ", None, "empty"), (None, None, "null"), ('"a\tb"', None, "malformed"), ("01", None, "trailing_text"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "id int, text string").repartition(3)
    got = {r.id: (r.read.canonical, r.read.rule) for r in df.select("id", strict_json.strict(df.text).alias("read")).collect()}
    assert got == {i: (c, rule) for i, (_, c, rule) in enumerate(CASES)}
    assert {(r.id, r.rule) for r in strict_json.violations(df, "text", "id").collect()} == {(i, rule) for i, (_, _, rule) in enumerate(CASES) if rule}
    assert {(r.id, r.canonical) for r in strict_json.canonical(df, "text", "id").collect()} == {(i, c) for i, (_, c, rule) in enumerate(CASES) if not rule}


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"])), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=3), x, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_sound_texts_keep_their_value(value):
    text, rule = strict_json._read(json.dumps(value, indent=1))
    assert rule is None and json.loads(text) == value
    assert strict_json._read(text) == (text, None)


