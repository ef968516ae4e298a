"""Half-precision numbers, which Spark has no type for, as their 16 bits in an int column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.IntegerType())
def _encode(x: pd.Series) -> pd.Series:
    with np.errstate(over="ignore"):
        bits = x.to_numpy(np.float32, na_value=np.nan).astype(np.float16).view(np.uint16).astype(np.int32)
    return pd.Series(bits, dtype="Int32").mask(x.isna().to_numpy())


@F.pandas_udf(T.FloatType())
def _decode(bits: pd.Series) -> pd.Series:
    known = bits.fillna(0).to_numpy(np.uint16).view(np.float16).astype(np.float32)
    return pd.Series(known).mask(bits.isna().to_numpy())


def to_half(x: Column) -> Column:
    """The bits of the nearest half-precision number, ties to even; beyond the range infinity."""
    return _encode(x.cast("float"))


def from_half(bits: Column) -> Column:
    """The single-precision value of half-precision bits."""
    return _decode(bits.cast("int"))
