"""Autocorrelation lags of long windows by FFT inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_lags_fft(df: DataFrame, window: str, k: int) -> DataFrame:
    """``lags`` column as ``functions.arrays.top_lags``, in n log n."""

    @F.pandas_udf("array<int>")
    def lags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for windows in batches:
            out = []
            for x in windows:
                spectrum = np.fft.rfft(np.asarray(x, dtype=float))
                power = np.fft.irfft(spectrum * np.conj(spectrum), n=len(x))
                out.append(np.argsort(-np.round(power, 4), kind="stable")[:k].astype("int32"))
            yield pd.Series(out)

    return df.withColumn("lags", lags(F.col(window)))
