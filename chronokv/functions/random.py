"""SplitMix64 as a vectorised function: draw n of a seed needs no draw before it."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType

GAMMA = 0x9E3779B97F4A7C15


def splitmix(seed: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n-th draw (from 1), unsigned 64 bits."""
    with np.errstate(over="ignore"):
        z = seed.astype(np.uint64) + n.astype(np.uint64) * np.uint64(GAMMA)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@F.pandas_udf(DecimalType(20, 0))
def next_u64(seed: pd.Series, n: pd.Series) -> pd.Series:
    from decimal import Decimal

    return pd.Series([Decimal(int(x)) for x in splitmix(seed.to_numpy(), n.to_numpy())])


@F.pandas_udf(DoubleType())
def next_f64(seed: pd.Series, n: pd.Series) -> pd.Series:
    """In [0, 1), from the draw's upper 53 bits."""
    return pd.Series((splitmix(seed.to_numpy(), n.to_numpy()) >> np.uint64(11)).astype(np.float64) / float(1 << 53))
