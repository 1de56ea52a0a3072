"""Gestalt string similarity, which SQL does not have: the one Python function of pair scoring."""

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    seen: dict[tuple[str, str], float] = {}

    def one(a, b):
        if a is None or b is None:
            return 0.0
        if a == b:
            return 1.0 if a else 0.0
        if (got := seen.get((a, b))) is None:
            got = seen[a, b] = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
        return got

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def sequence_ratio(left: Column, right: Column) -> Column:
    """Similarity by longest common blocks; depends on the order of its arguments, 0 for null or empty strings."""
    return _ratio(left, right)


def reaches(left: Column, right: Column, threshold: float) -> Column:
    """False where lengths alone keep the ratio under the threshold, as it is at most twice the shorter over both."""
    return 2.0 * F.least(F.length(left), F.length(right)) >= threshold * (F.length(left) + F.length(right))
