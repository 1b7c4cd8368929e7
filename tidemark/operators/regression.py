"""Least squares with fixed effects from sufficient statistics: sums are distributed, only their small matrix is solved."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_effects(df: DataFrame, y: str, xs: list[str], group: str) -> DataFrame:
    """Slopes of y on xs within groups: (term, slope). Columns without variance get no slope.

    Sums of products are taken by group in one aggregation; what reaches the driver is one matrix of len(xs) + 1 columns,
    summed over groups after centring. Rows need all values; a null in one of them leaves the row out of its sums.
    """
    names = [*xs, y]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    value = lambda c: F.col(c).cast("double")
    # Covariances are centred as they are summed, so large means cost no digits.
    sums = df.groupBy(group).agg(*((F.covar_pop(value(a), value(b)) * F.count("*")).alias(f"c_{a}_{b}") for a, b in pairs))
    row = sums.agg(*(F.sum(f"c_{a}_{b}").alias(f"c_{a}_{b}") for a, b in pairs)).first()
    matrix = np.zeros((len(names), len(names)))
    for a, b in pairs:
        i, j = names.index(a), names.index(b)
        matrix[i, j] = matrix[j, i] = row[f"c_{a}_{b}"] or 0.0
    active = [i for i in range(len(xs)) if matrix[i, i] > 1e-12]
    slopes: list[float | None] = [None] * len(xs)
    if active:
        found = np.linalg.lstsq(matrix[np.ix_(active, active)], matrix[active, -1], rcond=None)[0]
        for i, s in zip(active, found, strict=True):
            slopes[i] = round(float(s), 6)
    return df.sparkSession.createDataFrame([*zip(xs, slopes, strict=True)], "term string, slope double")
