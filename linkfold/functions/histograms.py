"""Histograms as binary values of 32-bit floats in little-endian order, and as arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def packed(hist: Column) -> Column:
    """An array of numbers as binary; null stays null."""

    def pack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: np.asarray(v, dtype="<f4").tobytes(), na_action="ignore")

    pack.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(pack, "binary")(hist)


def unpacked(blob: Column, size: int) -> Column:
    """A binary of ``size`` numbers as an array; null for one of another length."""

    def unpack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: np.frombuffer(v, dtype="<f4").astype(np.float64) if len(v) == 4 * size else None, na_action="ignore")

    unpack.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(unpack, "array<double>")(blob)
