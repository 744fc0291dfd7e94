"""Calendar features of timestamps as columns."""

from __future__ import annotations

import math
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Feature sets by frequency class.
FEATURES_BY_FREQ = {
    "year": [],
    "quarter": ["month"],
    "month": ["month"],
    "week": ["day", "week"],
    "day": ["weekday", "day", "dayofyear"],
    "hour": ["hour", "weekday", "day", "dayofyear"],
    "minute": ["minute", "hour", "weekday", "day", "dayofyear"],
    "second": ["second", "minute", "hour", "weekday", "day", "dayofyear"],
}


def _parts(ts: Column) -> dict[str, tuple[Column, int, float]]:
    """Feature -> (raw part, first value, span), zero-based scaling."""
    return {
        "second": (F.second(ts), 0, 59.0),
        "minute": (F.minute(ts), 0, 59.0),
        "hour": (F.hour(ts), 0, 23.0),
        "weekday": (F.weekday(ts), 0, 6.0),
        "day": (F.dayofmonth(ts), 1, 30.0),
        "dayofyear": (F.dayofyear(ts), 1, 365.0),
        "month": (F.month(ts), 1, 11.0),
        "week": (F.weekofyear(ts), 1, 52.0),
    }


def time_features(ts: Column, freq: str) -> dict[str, Column]:
    """Features in [-0.5, 0.5] that suit the frequency class."""
    parts = _parts(ts)
    return {name: (parts[name][0] - parts[name][1]) / parts[name][2] - 0.5 for name in FEATURES_BY_FREQ[freq]}


def sunday_week(ts: Column) -> Column:
    """Week of the year, weeks starting on Sunday (``%U``)."""
    return F.floor((F.dayofyear(ts) + 7 - F.dayofweek(ts)) / 7).cast("int")


def time_covariates(ts: Column, normalized: bool = True) -> dict[str, Column]:
    """Second variant: parts keep their own first value."""
    raw = {
        "moh": (F.minute(ts), 59.0),
        "hod": (F.hour(ts), 23.0),
        "dom": (F.dayofmonth(ts), 30.0),
        "dow": (F.weekday(ts), 6.0),
        "doy": (F.dayofyear(ts), 364.0),
        "moy": (F.month(ts), 11.0),
        "woy": (sunday_week(ts), 51.0),
    }
    return {k: (c / span - 0.5) if normalized else c.cast("double") for k, (c, span) in raw.items()}


def cyclical_time(ts: Column) -> dict[str, Column]:
    """Sine and cosine of the minute of the day; 00:00 and 23:59 coincide."""
    angle = (F.hour(ts) * 60 + F.minute(ts)) * (2.0 * math.pi) / 1439.0
    return {"time_sin": F.sin(angle), "time_cos": F.cos(angle)}


def raw_calendar(ts: Column, minute_bin: int | None = None) -> dict[str, Column]:
    out = {
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "weekday": F.weekday(ts),
        "hour": F.hour(ts),
    }
    if minute_bin:
        out["minute"] = F.floor(F.minute(ts) / minute_bin).cast("int")
    return out


# Class of a frequency by its last code, and by its first where
# an anchor follows.
LAST_CODE = {"H": 0, "T": 0, "MIN": 0, "D": 0, "B": 0, "U": 0, "S": 0, "MS": 1, "W": 1, "M": 1, "Y": 2, "Q": 2, "A": 2}
FIRST_CODE = {"W": 1, "ME": 1, "Y": 2, "Q": 2, "A": 2}


def freq_class(freq: Column) -> Column:
    """0 sub-weekly, 1 weekly or monthly, 2 slower; null when unknown."""
    code = F.upper(freq)
    table = lambda t: F.create_map(*[F.lit(x) for pair in t.items() for x in pair])
    last = F.regexp_extract(code, "(MIN|MS|[A-Z])$", 1)
    first = F.regexp_extract(code, "^(ME$|[A-Z](?=-))", 1)
    return F.coalesce(F.try_element_at(table(LAST_CODE), last), F.try_element_at(table(FIRST_CODE), first))


def week_end_date(year_week: Column) -> Column:
    """``YYYY`` + week number (Monday-based, week 1 has the first Monday) and
    weekday 0 = Sunday closing that week, as a date."""
    year = F.substring(year_week, 1, 4).try_cast("int")
    week = F.substring(year_week, 5, 2).try_cast("int")
    jan1 = F.make_date(year, F.lit(1), F.lit(1))
    to_first_monday = F.pmod(7 - F.weekday(jan1), F.lit(7))
    return F.date_add(jan1, (to_first_monday + (week - 1) * 7 + 6).cast("int"))


def easter(year: int) -> date:
    """Easter Sunday by the Meeus/Jones/Butcher rule."""
    a, (b, c) = year % 19, divmod(year, 100)
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = (a + 11 * h + 22 * m) // 451
    month, day = divmod(h + m - 7 * n + 114, 31)
    return date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    first = date(year, month, 1)
    return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))


def _last(year: int, month: int, weekday: int) -> date:
    end = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    return end - timedelta(days=(end.weekday() - weekday) % 7)


# The holidays, in feature order.
HOLIDAYS = {
    "easter_monday": lambda y: easter(y) + timedelta(days=1),
    "good_friday": lambda y: easter(y) - timedelta(days=2),
    "columbus_day": lambda y: _nth(y, 10, 0, 2),
    "labor_day": lambda y: _nth(y, 9, 0, 1),
    "martin_luther_king_day": lambda y: _nth(y, 1, 0, 3),
    "memorial_day": lambda y: _last(y, 5, 0),
    "presidents_day": lambda y: _nth(y, 2, 0, 3),
    "thanksgiving": lambda y: _nth(y, 11, 3, 4),
    "easter_sunday": easter,
    "new_years_day": lambda y: date(y, 1, 1),
    "superbowl": lambda y: _nth(y, 2, 6, 1),
    "mothers_day": lambda y: _nth(y, 5, 6, 2),
    "independence_day": lambda y: date(y, 7, 4),
    "christmas_eve": lambda y: date(y, 12, 24),
    "christmas_day": lambda y: date(y, 12, 25),
    "new_years_eve": lambda y: date(y, 12, 31),
    "black_friday": lambda y: _nth(y, 11, 3, 4) + timedelta(days=1),
    "cyber_monday": lambda y: _nth(y, 11, 3, 4) + timedelta(days=4),
}
HOLIDAY_REACH = 200


MOST_YEARS = 5_000


def holiday_dates(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Holiday dimension: 18 rows per year, and one year more at both ends."""
    rows = [(n, f(y)) for n, f in HOLIDAYS.items() for y in range(max(first_year - 1, 1), min(last_year + 1, 9998) + 1)]
    return spark.createDataFrame(rows, "holiday string, holiday_date date")


def holiday_distance(df: DataFrame, day: str) -> DataFrame:
    """Days to each holiday, counted to the earliest date within 200 days.

    Dates repeat across all rows of a table, so distances are found once per
    distinct date; the holidays span the years the dates do, so every date
    gets all of them. A yearly holiday has at most three candidate years for a
    date, so each date is matched on ``(year of candidate)`` by an equi-join.
    """
    days = df.select(F.col(day).cast("date").alias("day")).where("day IS NOT NULL").distinct()
    first, last = days.agg(F.year(F.min("day")), F.year(F.max("day"))).first()
    if first is None:
        first, last = 2000, 2000
    holidays = holiday_dates(df.sparkSession, first, last)
    near = days.withColumn("y", F.explode(F.sequence(F.year("day") - 1, F.year("day") + 1)))
    dated = holidays.withColumn("y", F.year("holiday_date"))
    if last - first <= MOST_YEARS:  # 18 small rows a year
        dated = F.broadcast(dated)
    diff = F.datediff("day", "holiday_date")
    return (
        near.join(dated, "y", "left")
        .filter(F.abs(diff) <= HOLIDAY_REACH)
        .groupBy("day", "holiday")
        .agg(F.datediff("day", F.min("holiday_date")).alias("distance"))
    )


def standardized_holiday_distance(distances: DataFrame) -> DataFrame:
    """Zero-mean unit-variance (population) distance per holiday; a constant
    one stays at zero."""
    stats = distances.groupBy("holiday").agg(F.avg("distance").alias("_m"), F.stddev_pop("distance").alias("_s"))
    scaled = (F.col("distance") - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    return distances.join(stats, "holiday").withColumn("scaled", scaled).drop("_m", "_s")
