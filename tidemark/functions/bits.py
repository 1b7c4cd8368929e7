"""The bits of doubles as text: 16 lower-case hex digits, the sign and exponent first, so that no value loses anything."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def double_hex(value: Column) -> Column:
    """The bits of a double; null for null. Both zeros, infinities and every NaN keep their own bits."""

    @F.arrow_udf("string")
    def digits(values: pa.Array) -> pa.Array:
        return pa.array(["%016x" % b for b in values.to_numpy(zero_copy_only=False).view(np.uint64).tolist()], pa.string())

    return F.when(value.isNotNull(), digits(F.coalesce(value.cast("double"), F.lit(0.0))))


def hex_double(text: Column) -> Column:
    """The double of 16 lower-case hex digits; null for any other text."""

    @F.arrow_udf("double")  # pandas would turn NaN into null
    def doubles(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([int(t, 16) for t in texts.to_pylist()], np.uint64).view(np.float64))

    sound = text.rlike(r"\A[0-9a-f]{16}\z")
    return F.when(sound, doubles(F.when(sound, text).otherwise("0" * 16)))
