"""Strict JSON: what the built-in parser would let through is named, and sound texts get one canonical form."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Refused(ValueError):
    """Its text is the rule that a document breaks."""


def _once(pairs: Iterable[tuple[str, object]]) -> dict:
    held: dict = {}
    for key, value in pairs:
        if key in held:
            raise _Refused("repeated_key")
        held[key] = value
    return held


def _no_constant(name: str) -> None:
    raise _Refused("not_a_number")


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise _Refused("beyond_doubles")
    return value


_DECODER = json.JSONDecoder(object_pairs_hook=_once, parse_constant=_no_constant, parse_float=_finite)
_WHITE = " \t\n\r"


def _read(text: str | None) -> tuple[str | None, str | None]:
    """The canonical form, or the first rule that is broken."""
    if text is None:
        return None, "null"
    body = text.lstrip(_WHITE)
    if not body:
        return None, "empty"
    try:
        value, end = _DECODER.raw_decode(body)
        if body[end:].strip(_WHITE):
            return None, "trailing_text"
        canonical = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        canonical.encode()
        return canonical, None
    except _Refused as e:
        return None, str(e)
    except UnicodeEncodeError:
        return None, "lone_surrogate"
    except RecursionError:
        return None, "too_deep"
    except ValueError:
        return None, "malformed"


def strict(text: Column) -> Column:
    """A struct of each document: canonical (null if refused) and rule (null if sound).

    Rules: null, empty, malformed, repeated_key (of one object, at any depth), not_a_number (NaN and infinities by name),
    beyond_doubles (1e999), trailing_text (anything but white space after the value), lone_surrogate, too_deep. The
    canonical form sorts the keys of every object by code point, has no white space, and keeps integers whole.
    """

    @F.pandas_udf("canonical string, rule string")
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read(t) for t in texts], columns=["canonical", "rule"], dtype=object)

    return read(text)


def violations(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, rule) of the documents that are refused."""
    return df.select(*keys, strict(F.col(text)).alias("read")).where("read.rule is not null").select(*keys, F.col("read.rule").alias("rule"))


def canonical(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, canonical) of the documents that are sound."""
    return df.select(*keys, strict(F.col(text)).alias("read")).where("read.rule is null").select(*keys, F.col("read.canonical").alias("canonical"))
