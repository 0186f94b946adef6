"""Join helpers.

No helper hints a broadcast: Catalyst's size estimate knows nothing of the fan-out of an
``explode`` or of a Python operator, so the planner and adaptive execution choose, the latter by
the measured size of the shuffled side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup(df: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """Left lookup of a dimension."""
    return df.join(dim, on=on, how=how)
