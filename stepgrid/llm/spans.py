"""Where a pattern matches in a text, with built-in columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint>>"


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs ``start, end`` in code points, end exclusive.

    What lies between matches and the matches themselves come from one
    splitting and one extracting of the text; running sums of their lengths
    are the places. The pattern must not match the empty string.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(found, F.length).alias("own"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        own = F.coalesce(x["own"], F.lit(0))
        end = (start + own).cast("bigint")
        span = F.struct(start.cast("bigint").alias("start"), end.alias("end"))
        spans = F.when(own > 0, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    none = F.array().cast(SPAN)
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans"))
    return F.aggregate(steps, begin, step, lambda done: done["spans"])
