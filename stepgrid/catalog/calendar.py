"""Calendar features and text functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stepgrid.catalog.base import KEYS, PAIRS, query, r6, raw_events, rounded, slot, table
from stepgrid.functions import calendar, text

EV = "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events"


def ev(spark, sf):
    return raw_events(spark, sf).select("event_id", "ts")


@query(
    "time_features",
    """SELECT event_id, round(second(ts) / 59.0 - 0.5, 6) AS second, round(minute(ts) / 59.0 - 0.5, 6) AS minute, round(hour(ts) / 23.0 - 0.5, 6) AS hour,
      round((isodow(ts) - 1) / 6.0 - 0.5, 6) AS weekday, round((day(ts) - 1) / 30.0 - 0.5, 6) AS day, round((dayofyear(ts) - 1) / 365.0 - 0.5, 6) AS dayofyear FROM events""",
)
def _(spark, sf):
    feats = calendar.time_features(F.col("ts"), "second")
    return rounded(ev(spark, sf).select("event_id", *[c.alias(n) for n, c in feats.items()]))


@query(
    "time_features_weekly",
    "SELECT l_orderkey, l_linenumber, round((day(l_shipdate) - 1) / 30.0 - 0.5, 6) AS day, round((weekofyear(l_shipdate) - 1) / 52.0 - 0.5, 6) AS week FROM lineitem",
)
def _(spark, sf):
    feats = calendar.time_features(F.col("l_shipdate"), "week")
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in feats.items()]))


@query(
    "time_covariates",
    """SELECT o_orderkey, round(minute(o_orderdate) / 59.0 - 0.5, 6) AS moh, round(hour(o_orderdate) / 23.0 - 0.5, 6) AS hod, round(day(o_orderdate) / 30.0 - 0.5, 6) AS dom,
      round((isodow(o_orderdate) - 1) / 6.0 - 0.5, 6) AS dow, round(dayofyear(o_orderdate) / 364.0 - 0.5, 6) AS doy, round(month(o_orderdate) / 11.0 - 0.5, 6) AS moy,
      round(CAST(strftime(o_orderdate, '%U') AS INTEGER) / 51.0 - 0.5, 6) AS woy FROM orders""",
)
def _(spark, sf):
    feats = calendar.time_covariates(F.col("o_orderdate"))
    return rounded(table(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in feats.items()]))


@query(
    "cyclical_time",
    f"""SELECT event_id, round(sin((hour(ts) * 60 + minute(ts)) * {2 * math.pi!r} / 1439.0), 6) + 0.0::DOUBLE AS time_sin,
      round(cos((hour(ts) * 60 + minute(ts)) * {2 * math.pi!r} / 1439.0), 6) + 0.0::DOUBLE AS time_cos FROM events""",
)
def _(spark, sf):
    waves = calendar.cyclical_time(F.col("ts"))
    # adding zero turns a rounded -0.0 into 0.0
    return ev(spark, sf).select("event_id", *[(F.round(c, 6) + 0.0).alias(n) for n, c in waves.items()])


@query(
    "raw_calendar",
    """SELECT event_id, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour,
      CAST(minute(ts) // 15 AS INTEGER) AS minute FROM events""",
)
def _(spark, sf):
    return ev(spark, sf).select("event_id", *[c.alias(n) for n, c in calendar.raw_calendar(F.col("ts"), 15).items()])


# n-th weekday of a month: the first such day, and weeks after it (isodow of the weekday plus 7, so that % never meets a negative)
NTH = "CAST(make_date(y, {m}, 1) + CAST(({w} + 7 - isodow(make_date(y, {m}, 1))) % 7 + {d} AS INTEGER) AS DATE)"
YEARLY = {
    "easter_monday": "CAST(e + 1 AS DATE)", "good_friday": "CAST(e - 2 AS DATE)", "easter_sunday": "e",
    "columbus_day": NTH.format(m=10, w=1, d=7), "labor_day": NTH.format(m=9, w=1, d=0), "martin_luther_king_day": NTH.format(m=1, w=1, d=14),
    "memorial_day": "CAST(make_date(y, 5, 31) - CAST((isodow(make_date(y, 5, 31)) + 6) % 7 AS INTEGER) AS DATE)",
    "presidents_day": NTH.format(m=2, w=1, d=14), "thanksgiving": NTH.format(m=11, w=4, d=21), "black_friday": NTH.format(m=11, w=4, d=22),
    "cyber_monday": NTH.format(m=11, w=4, d=25), "superbowl": NTH.format(m=2, w=7, d=0), "mothers_day": NTH.format(m=5, w=7, d=7),
    "new_years_day": "make_date(y, 1, 1)", "independence_day": "make_date(y, 7, 4)", "christmas_eve": "make_date(y, 12, 24)",
    "christmas_day": "make_date(y, 12, 25)", "new_years_eve": "make_date(y, 12, 31)",
}
# Easter by Gauss's rule for 1900 to 2099
HOLIDAY = f"""days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
years AS (SELECT y, (19 * (y % 19) + 24) % 30 AS gd FROM (SELECT unnest(range(1990, 2006)) AS y)),
gauss AS (SELECT *, (2 * (y % 4) + 4 * (y % 7) + 6 * gd + 5) % 7 AS ge FROM years),
easter AS (SELECT y, CAST(make_date(y, 3, 22) + CAST(gd + ge - CASE WHEN gd + ge = 35 OR (gd = 28 AND ge = 6 AND y % 19 > 10) THEN 7 ELSE 0 END AS INTEGER) AS DATE) AS e FROM gauss),
hol AS ({" UNION ALL ".join(f"SELECT '{n}' AS holiday, {d} AS d FROM easter" for n, d in YEARLY.items())}),
dist AS (SELECT day, holiday, date_diff('day', min(d), day) AS distance FROM days JOIN hol ON abs(date_diff('day', d, day)) <= 200 GROUP BY 1, 2)"""
def distances(spark, sf):
    return calendar.holiday_distance(table(spark, sf, "orders"), "o_orderdate")


@query("holiday_distance", f"WITH {HOLIDAY} SELECT day, holiday, CAST(distance AS INTEGER) AS distance FROM dist")
def _(spark, sf):
    return distances(spark, sf)


@query(
    "holiday_distance_scaled",
    f"WITH {HOLIDAY} SELECT day, holiday, round((distance - avg(distance) OVER w) / stddev_pop(distance) OVER w, 6) AS scaled FROM dist WINDOW w AS (PARTITION BY holiday)",
)
def _(spark, sf):
    out = calendar.standardized_holiday_distance(distances(spark, sf))
    return rounded(out.select("day", "holiday", "scaled"))


@query(
    "freq_class",
    """SELECT o_orderkey, CAST(([0, 0, 1, 1, 2, 2, 0, 1, 2])[o_orderkey % 9 + 1] AS INTEGER) AS freq_class FROM orders""",
)
def _(spark, sf):
    names = F.array(*[F.lit(x) for x in ("H", "5min", "W", "MS", "Q", "A", "D", "W-SUN", "Y-DEC")])
    pick = F.get(names, (F.col("o_orderkey") % 9).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", calendar.freq_class(pick).alias("freq_class"))


@query(
    "route_subject",
    """SELECT c_custkey, CASE WHEN c_custkey < 100 THEN 'small' WHEN c_custkey % 10 = 7 THEN 'seven' END AS dataset FROM customer""",
)
def _(spark, sf):
    rules = [(r"^\d{1,2}$", "small"), (r"7$", "seven")]
    return table(spark, sf, "customer").select("c_custkey", text.route_subject(F.col("c_custkey").cast("string"), rules).alias("dataset"))


@query(
    "normalize_dataset",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Build' ELSE c_mktsegment END AS dataset FROM customer""",
)
def _(spark, sf):
    raw = F.concat(F.lit("  "), F.col("c_custkey").cast("string"), F.lit("_"), F.col("c_mktsegment"), F.lit(" "))
    return table(spark, sf, "customer").select("c_custkey", text.normalize_dataset(raw, {"BUILDING": "Build"}).alias("dataset"))


@query(
    "method_from_path",
    """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%NOT%' THEN 'None' WHEN o_orderpriority LIKE '%MED%' THEN 'Medium'
      WHEN o_orderpriority LIKE '%LOW%' THEN 'Low' ELSE lower(o_orderpriority) END AS method FROM orders""",
)
def _(spark, sf):
    rules = [("not specified", "None"), ("medium", "Medium"), ("low", "Low")]
    path = F.concat(F.lit("/results/fullshot/"), F.lower("o_orderpriority"), F.lit(".csv"))
    return table(spark, sf, "orders").select("o_orderkey", text.method_from_path(path, rules).alias("method"))


@query(
    "horizon_text",
    "SELECT event_id, CAST(event_id % 4 * 15 + 15 AS INTEGER) AS minutes, CAST(event_id % 4 * 15 + 15 AS VARCHAR) || 'min' AS label FROM events",
)
def _(spark, sf):
    label = text.horizon_text(F.col("event_id") % 4 * 15 + 15)
    return ev(spark, sf).select("event_id", text.horizon_minutes(label).alias("minutes"), label.alias("label"))


@query(
    "mean_std_cells",
    """SELECT o_orderpriority, printf('%.2f (%.2f)', avg(o_totalprice), coalesce(stddev_samp(o_totalprice), 0)) AS cell,
      CAST(printf('%.2f', avg(o_totalprice)) AS DOUBLE) AS mean, CAST(printf('%.2f', stddev_samp(o_totalprice)) AS DOUBLE) AS std FROM orders GROUP BY 1""",
)
def _(spark, sf):
    cells = table(spark, sf, "orders").groupBy("o_orderpriority").agg(text.mean_std_text(F.col("o_totalprice")).alias("cell"))
    return cells.withColumns(text.parse_mean_std(F.col("cell")))


@query(
    "duration_text",
    """SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%.1fm', s / 60.0) ELSE printf('%.2fh', s / 3600.0) END AS label
    FROM (SELECT event_id, value * value + 0.013 AS s FROM events)""",
)
def _(spark, sf):
    s = F.col("value") * F.col("value") + 0.013
    return raw_events(spark, sf).select("event_id", text.duration_text(s).alias("label"))


@query(
    "p_value_text",
    """SELECT event_id, CASE WHEN p IS NULL THEN 'NA' WHEN p < 0.001 THEN printf('%.1e', p) ELSE printf('%.3f', p) END AS label,
      CASE WHEN p IS NULL THEN 'NA' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars
    FROM (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN exp(-value / 20) END AS p FROM events)""",
)
def _(spark, sf):
    p = F.when(F.col("event_id") % 11 > 0, F.exp(-F.col("value") / 20))
    return raw_events(spark, sf).select("event_id", text.p_value_text(p).alias("label"), text.significance_stars(p).alias("stars"))


@query(
    "week_end_date",
    """SELECT DISTINCT CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS slot, strftime(o_orderdate, '%Y') || strftime(o_orderdate, '%W') AS year_week,
      CAST(o_orderdate + to_days(CAST((7 - isodow(o_orderdate)) AS INTEGER)) AS DATE) AS week_end FROM orders""",
)
def _(spark, sf):
    days = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    # Monday-based week of the year, week 1 holding the first Monday
    week = F.floor((F.dayofyear("day") + 6 - F.weekday("day")) / 7)
    year_week = F.concat(F.year("day").cast("string"), F.lpad(week.cast("string"), 2, "0"))
    rows = days.withColumn("year_week", year_week)
    return rows.select(slot(F.col("day").cast("timestamp")).alias("slot"), "year_week", calendar.week_end_date(F.col("year_week")).alias("week_end"))


@query(
    "number_or_sentinel",
    "SELECT event_id, CASE WHEN event_id % 5 > 1 THEN value END AS v, CASE WHEN event_id % 5 > 1 THEN value ELSE 0 END AS v0 FROM events",
)
def _(spark, sf):
    raw = F.when(F.col("event_id") % 5 == 0, "X").when(F.col("event_id") % 5 == 1, "n/a").otherwise(F.col("value").cast("string"))
    return raw_events(spark, sf).select("event_id", text.number_or(raw).alias("v"), text.number_or(raw, default=0.0).alias("v0"))


@query(
    "composite_keys",
    """SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' || l_returnflag AS key,
      CAST(l_partkey AS VARCHAR) AS part, CAST(l_suppkey AS VARCHAR) AS supplier, l_returnflag AS flag FROM lineitem""",
)
def _(spark, sf):
    key = text.compose_key(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key.alias("key"))
    return rows.withColumns(text.split_key(F.col("key"), ["part", "supplier", "flag"]))


@query(
    "dataset_group",
    "SELECT p_partkey, CASE WHEN p_name LIKE 'small%' THEN 'small' WHEN p_name LIKE 'red%' THEN 'red' ELSE p_name END AS grp FROM part",
)
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.dataset_group(F.col("p_name"), ["small", "red"]).alias("grp"))


@query(
    "safe_division",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0 ELSE round(l_tax / l_discount, 6) END AS ratio FROM lineitem",
)
def _(spark, sf):
    from stepgrid.functions.safe import over_or

    ratio = F.round(over_or(F.col("l_tax"), F.col("l_discount"), 0.0), 6)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("ratio"))


@query(
    "boolish",
    "SELECT event_id, event_id % 6 IN (1, 2, 3) AS flag FROM events",
)
def _(spark, sf):
    words = F.array(*[F.lit(x) for x in ("no", " TRUE ", "1", "Yes", "0", None)])
    return ev(spark, sf).select("event_id", text.boolish(F.get(words, (F.col("event_id") % 6).cast("int"))).alias("flag"))
