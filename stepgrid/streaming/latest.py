"""Latest unbroken context per subject, kept from a stream of readings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stepgrid.series import SeriesSpec


def newest_run(us: np.ndarray, values: np.ndarray, step: int, length: int) -> int | None:
    """Index of the last row that ends an unbroken run of ``length`` rows."""
    broken = np.flatnonzero(np.diff(us) != step) + 1
    starts = np.zeros(len(us), dtype=np.int64)
    starts[broken] = broken
    run = np.arange(len(us)) - np.maximum.accumulate(starts)
    ends = np.flatnonzero(run >= length - 1)
    return int(ends[-1]) if len(ends) else None


def latest_stream(readings: DataFrame, spec: SeriesSpec, context: int, watermark: str) -> DataFrame:
    """Emit a subject's newest unbroken context whenever it changes.

    State per subject is its readings from the watermark less one context on,
    which new and late ones are merged into, and the end of the window emitted
    last: whatever may still arrive finds all readings its window can need, so
    the stream ends with what the batch operator gives. A subject that the
    watermark has left behind by a context is forgotten. Repeated timestamps
    are dropped within the watermark, later readings are dropped; the
    watermark bounds the state and should be of the order of the lateness.
    """
    step = spec.step_us
    reach = (context - 1) * step
    rows = readings.withWatermark(spec.ts, watermark).dropDuplicatesWithinWatermark([*spec.keys, spec.ts])
    rows = rows.select(*spec.keys, spec.ts, F.unix_micros(F.col(spec.ts)).alias("us"), F.col(spec.value).cast("double").alias("v"))
    key_fields = ", ".join(f"{k} string" for k in spec.keys)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept_us, kept_v, emitted = state.get if state.exists else ([], [], None)
        frames = [pd.DataFrame({"us": list(kept_us), "v": list(kept_v)})] if len(kept_us) else []
        frames += [p[["us", "v"]] for p in parts]
        merged = pd.concat(frames).drop_duplicates("us").sort_values("us")
        us, values = merged["us"].to_numpy(dtype="int64"), merged["v"].to_numpy(dtype=float)
        end = newest_run(us, values, step, context)
        changed = end is not None and (emitted is None or us[end] > emitted)
        if changed:
            emitted = int(us[end])
        passed_ms = state.getCurrentWatermarkMs()
        recent = us >= passed_ms * 1000 - reach
        state.update((us[recent].tolist(), values[recent].tolist(), emitted))
        state.setTimeoutTimestamp(max(int(us[-1] + reach) // 1000, passed_ms) + 1)
        if changed:
            window = values[end - context + 1 : end + 1].tolist()
            yield pd.DataFrame([dict(zip(spec.keys, key)) | {"last_us": emitted, "context": window}])

    return rows.groupBy(*spec.keys).applyInPandasWithState(
        update,
        f"{key_fields}, last_us bigint, context array<double>",
        "us array<bigint>, v array<double>, emitted bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
