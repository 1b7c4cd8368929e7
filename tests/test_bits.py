"""Bits of doubles there and back."""

import struct

from tidemark.functions import bits


def test_bits_there_and_back(spark):
    values = [0.0, -0.0, 1.5, -2.75, float("inf"), float("-inf"), float("nan"), 5e-324, 1.7976931348623157e308, 0.1, None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    df = df.withColumn("text", bits.double_hex(df.x))
    got = {r.i: r.text for r in df.collect()}
    assert got == {i: None if v is None else struct.pack(">d", v).hex() for i, v in enumerate(values)}
    back = {r.i: r.text for r in df.select("i", bits.double_hex(bits.hex_double(df.text)).alias("text")).collect()}
    assert back == got


def test_other_texts_are_no_doubles(spark):
    texts = ["3ff0000000000000", "3FF0000000000000", "3ff", "", "3ff00000000000001", "xyz0000000000000", "3ff0000000000000\n", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {r.i: r.x for r in df.select("i", bits.hex_double(df.t).alias("x")).collect()} == {0: 1.0} | {i: None for i in range(1, len(texts))}
