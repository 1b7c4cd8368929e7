"""Drift scenarios: parsing, concept schedule, features, labels."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.addressing import key_from_address, uniform_at

#: Families, drifts and magnitudes; drift starts after these rows and a gradual one lasts so long.
FAMILIES = ("LOCAL_TREE", "OBLIQUE")
DRIFTS = ("ABRUPT", "GRADUAL", "RECURRENT")
MAGNITUDES = {"MILD": 0.1, "SEVERE": 0.25}
CHECKPOINTS = (10_000, 20_000)
GRADUAL_ROWS = 2_000
NOISE = 0.1


def scenarios() -> list[str]:
    """The fourteen scenario names in analysis order: each family's stationary one first."""
    return [f"{f}-{d}" for f in FAMILIES for d in ("STATIONARY-NONE", *(f"{d}-{m}" for d in DRIFTS for m in MAGNITUDES))]


def scenario_part(scenario: Column, part: int) -> Column:
    return F.element_at(F.split(scenario, "-"), part)


def magnitude(scenario: Column) -> Column:
    out = F.lit(0.0)
    for name, value in MAGNITUDES.items():
        out = F.when(scenario_part(scenario, 3) == name, value).otherwise(out)
    return out


def concept_at(scenario: Column, t: Column, mixture: Column) -> Column:
    """Which concept (0, 1 or 2) holds at row t, from 1; `mixture` is the uniform draw that decides while a drift is under way.

    Abrupt and gradual drifts go on to a new concept after each checkpoint, a gradual one by a share that rises over
    GRADUAL_ROWS; a recurrent one comes back to the first concept after the second checkpoint.
    """
    drift = scenario_part(scenario, 2)
    passed = sum((t > c).cast("int") for c in CHECKPOINTS)
    since = t - F.when(passed == 2, CHECKPOINTS[1]).otherwise(CHECKPOINTS[0])
    behind = (since <= GRADUAL_ROWS) & (mixture >= since / float(GRADUAL_ROWS))
    return (
        F.when(drift == "ABRUPT", passed)
        .when(drift == "GRADUAL", passed - ((passed > 0) & behind).cast("int"))
        .when(drift == "RECURRENT", passed % 2)
        .otherwise(0)
    )


def normal(u: Column, v: Column) -> Column:
    """Box-Muller's cosine half."""
    return F.sqrt(-2 * F.ln(u)) * F.cos(F.lit(2 * pi) * v)


def feature(scenario: Column, key: Column, t: Column, j: int) -> Column:
    """Feature j of row t: uniform for tree scenarios, normal for oblique ones."""
    u, v = (uniform_at(key, F.lit(f"features:{j}"), t, F.lit(k)) for k in (0, 1))
    return F.when(scenario_part(scenario, 1) == "OBLIQUE", normal(u, v)).otherwise(u)


def clean_label(scenario: Column, x: list[Column], concept: Column) -> Column:
    """The label without noise, from eight features.

    Local: feature 1 or 2, by the half that feature 0 is in, less the half's shift, has a fractional part under a half.
    Oblique: which side of a line the half-sums of features 0-3 and 4-7 are on; drift turns the line.
    """
    size = magnitude(scenario)
    z = F.when(x[0] < 0.5, x[1] - size * (concept >= 1).cast("int")).otherwise(x[2] - size * (concept >= 2).cast("int"))
    angle = concept * F.lit(pi) * size
    u, v = (x[0] + x[1] + x[2] + x[3]) / 2, (x[4] + x[5] + x[6] + x[7]) / 2
    turned = F.cos(angle) * u + F.sin(angle) * v >= 0
    return F.when(scenario_part(scenario, 1) == "OBLIQUE", turned).otherwise(z - F.floor(z) < 0.5).cast("int")


def noisy(label: Column, u: Column) -> Column:
    return F.when(u < NOISE, 1 - label).otherwise(label)


# The forms of streams' addresses before the scenario, and the digits of a realisation.
ADDRESSES = {
    "DEV": ("DT-P9-v1|DEV|", 2),
    "CONF": ("DT-C8E1-F09-v1|CONF|SOURCE|scenario=", 3),
}


def stream_key(scenario: Column, realisation: Column, partition: str = "DEV") -> Column:
    """The key of a stream's draws: a development stream's, or a confirmatory one's (realisations 0 to 319)."""
    before, digits = ADDRESSES[partition]
    return key_from_address(F.concat(F.lit(before), scenario, F.lit("|r="), F.lpad(realisation.cast("string"), digits, "0")))


def stream_rows(streams: DataFrame) -> DataFrame:
    """Add x (eight features), concept, clean and y to rows with scenario, key and t: a stream is a function of its address."""
    draw = lambda role: uniform_at(F.col("key"), F.lit(role), F.col("t"), F.lit(0))
    rows = streams.withColumn("x", F.array(*(feature(F.col("scenario"), F.col("key"), F.col("t"), j) for j in range(8))))
    rows = rows.withColumn("concept", concept_at(F.col("scenario"), F.col("t"), draw("mixture")))
    rows = rows.withColumn("clean", clean_label(F.col("scenario"), [F.col("x")[j] for j in range(8)], F.col("concept")))
    return rows.withColumn("y", noisy(F.col("clean"), draw("label_noise")))
