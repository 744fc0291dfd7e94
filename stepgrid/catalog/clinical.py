"""Error grids, glycemic strata and their roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepgrid.catalog.base import KEYS, PAIRS, SPEC, query, readings, rounded, slot
from stepgrid.functions import clinical
from stepgrid.operators import rollup
from stepgrid.operators.windows import persistence_pairs
from stepgrid.plans.evaluation import clinical_report
from stepgrid.session import fresh_path
from stepgrid.sources.readings import read_seg_table, seg_table_report


# values moved into a glucose-like range by the same formula in both engines
GLU = f"""{PAIRS}, glu AS (SELECT dataset, subject_id, slot, prediction + 40 AS p, ground_truth + 40 AS t FROM pairs)"""
ZONE = """CASE WHEN (t <= 70 AND p >= 180) OR (t >= 180 AND p <= 70) THEN 'E' WHEN t < 70 AND p < 70 THEN 'A' WHEN abs(p - t) <= 0.20 * t THEN 'A'
  WHEN t <= 70 AND p BETWEEN 70 AND 180 THEN 'D' WHEN t >= 240 AND p BETWEEN 70 AND 180 THEN 'D' WHEN t >= 70 AND p >= t + 110 THEN 'C'
  WHEN t >= 130 AND p <= 70 AND p <= 1.4 * (t - 130) THEN 'C' ELSE 'B' END"""
GRADE = "CASE WHEN {x} <= {a} THEN 0.5 WHEN {x} <= {b} THEN 1.0 WHEN {x} <= {c} THEN 2.0 ELSE 3.0 END"
RISK = f"""CASE WHEN CASE WHEN r < 100 THEN abs(m - r) <= 15 ELSE m >= r * 0.85 AND m <= r * 1.15 END THEN 0.0
  WHEN r < 70 THEN CASE WHEN m < r THEN {GRADE.format(x="abs(m - r)", a=30, b=60, c=90)} ELSE {GRADE.format(x="abs(m - r)", a=30, b=50, c=80)} END
  WHEN r <= 180 THEN {GRADE.format(x="abs(m - r)", a=40, b=80, c=120)}
  WHEN m < r THEN {GRADE.format(x="abs(m - r) / r * 100.0", a=20, b=40, c=60)} ELSE {GRADE.format(x="abs(m - r) / r * 100.0", a=20, b=40, c=70)} END"""
ZONED = f"""{GLU}, idx AS (SELECT *, CAST(least(599, trunc(t)) AS INTEGER) AS r, CAST(least(599, trunc(p)) AS INTEGER) AS m FROM glu),
zoned AS (SELECT *, {ZONE} AS zone, CAST({RISK} AS DOUBLE) AS risk FROM idx)"""
SUMMARY = """count(*) AS n, round(avg(CASE WHEN zone = 'A' THEN 100.0 ELSE 0 END), 6) AS ceg_a, round(avg(CASE WHEN risk = 0 THEN 100.0 ELSE 0 END), 6) AS seg_a, round(avg(risk), 6) AS seg_risk"""


def P():
    return F.col("prediction")


def T():
    return F.col("ground_truth")


def glucose(spark, sf):
    return persistence_pairs(readings(spark, sf), SPEC, 1).withColumns({"prediction": P() + 40, "ground_truth": T() + 40})


@query("clarke_zone", f"WITH {ZONED} SELECT dataset, subject_id, slot, zone FROM zoned")
def _(spark, sf):
    return glucose(spark, sf).select(*KEYS, slot().alias("slot"), clinical.clarke_zone(T(), P()).alias("zone"))


LETTERS = ["A", "B", "C", "D", "E"]


@query(
    "zone_percentages",
    f"WITH {ZONED} SELECT dataset, " + ", ".join(f"round(avg(CASE WHEN zone = '{z}' THEN 100.0 ELSE 0 END), 6) AS {z}" for z in LETTERS) + " FROM zoned GROUP BY 1",
)
def _(spark, sf):
    return rounded(rollup.zone_shares(glucose(spark, sf), ["dataset"], clinical.clarke_zone(T(), P()), LETTERS))


@query("seg_rule_risk", f"WITH {ZONED} SELECT dataset, subject_id, slot, risk FROM zoned")
def _(spark, sf):
    return glucose(spark, sf).select(*KEYS, slot().alias("slot"), clinical.seg_rule_risk(T(), P()).alias("risk"))


def seg_table(spark):
    """A synthetic grid of the lookup's shape: risk grows with the error."""
    i = F.explode(F.sequence(F.lit(0), F.lit(599)))
    return (
        spark.range(600)
        .select(F.col("id").cast("int").alias("ref_i"), i.alias("meas_i"))
        .withColumn("risk", F.least(F.lit(4.0), F.abs(F.col("ref_i") - F.col("meas_i")) / 60.0))
    )


LOOKUP = f"""{GLU}, k AS (SELECT *, least(599, round_even(t, 0)) AS r, least(599, round_even(p, 0)) AS m FROM glu),
looked AS (SELECT *, least(4.0, abs(r - m) / 60.0) AS risk FROM k)"""


@query(
    "seg_lookup_risk",
    f"WITH {LOOKUP} SELECT dataset, round(avg(risk), 6) AS mean_risk, round(avg(CASE WHEN risk <= 0.5 THEN 100.0 ELSE 0 END), 6) AS zone_a FROM looked GROUP BY 1",
)
def _(spark, sf):
    rows = clinical.with_seg_risk(glucose(spark, sf), seg_table(spark), "ground_truth", "prediction")
    return rounded(
        rows.groupBy("dataset").agg(F.avg("risk").alias("mean_risk"), F.avg(F.when(F.col("risk") <= 0.5, 100.0).otherwise(0.0)).alias("zone_a"))
    )


ZONES = ["None", "Slight", "Moderate", "Great", "Extreme"]


@query(
    "seg_zone_distribution",
    f"""WITH {LOOKUP}, z AS (SELECT dataset, CASE WHEN risk < 0.5 THEN 'None' WHEN risk < 1.5 THEN 'Slight' WHEN risk < 2.5 THEN 'Moderate' WHEN risk < 3.5 THEN 'Great' ELSE 'Extreme' END AS z FROM looked)
    SELECT dataset, """ + ", ".join(f"round(avg(CASE WHEN z = '{z}' THEN 100.0 ELSE 0 END), 6) AS \"{z}\"" for z in ZONES) + " FROM z GROUP BY 1",
)
def _(spark, sf):
    rows = clinical.with_seg_risk(glucose(spark, sf), seg_table(spark), "ground_truth", "prediction")
    return rounded(rollup.zone_shares(rows, ["dataset"], clinical.seg_zone(F.col("risk")), ZONES))


@query(
    "seg_bilinear_risk",
    f"""WITH {GLU}, a AS (SELECT dataset, greatest(0, least(600, t)) / (600.0 / 599) AS x, greatest(0, least(600, p)) / (600.0 / 599) AS y FROM glu),
    b AS (SELECT *, least(598, floor(x)) AS i, least(598, floor(y)) AS j FROM a), c AS (SELECT *, x - i AS u, y - j AS v FROM b),
    r AS (SELECT dataset, (1 - u) * (1 - v) * least(4.0, abs(i - j) / 60.0) + (1 - u) * v * least(4.0, abs(i - j - 1) / 60.0)
      + u * (1 - v) * least(4.0, abs(i + 1 - j) / 60.0) + u * v * least(4.0, abs(i - j) / 60.0) AS risk FROM c)
    SELECT dataset, round(avg(risk), 6) AS mean_risk, round(stddev_pop(risk), 6) AS std_risk FROM r GROUP BY 1""",
)
def _(spark, sf):
    rows = clinical.with_seg_bilinear(glucose(spark, sf), seg_table(spark), "ground_truth", "prediction", 600)
    return rounded(rows.groupBy("dataset").agg(F.avg("risk").alias("mean_risk"), F.stddev_pop("risk").alias("std_risk")))


@query(
    "read_seg_table",
    f"""WITH {GLU}, g AS (SELECT CAST(floor(t / 50) AS INTEGER) AS i, CAST(floor(p / 50) AS INTEGER) AS j, count(*) AS n FROM glu GROUP BY 1, 2),
    s AS (SELECT max(greatest(i, j)) AS m FROM g), c AS (SELECT a.i, b.j FROM (SELECT unnest(range(m + 1)) AS i FROM s) a, (SELECT unnest(range(m + 1)) AS j FROM s) b),
    x AS (SELECT c.i, c.j, CASE WHEN c.i = c.j THEN 0 ELSE least(4.0, coalesce(g.n, 0) / 100.0) END AS risk FROM c LEFT JOIN g ON c.i = g.i AND c.j = g.j)
    SELECT CAST(max(i) + 1 AS INTEGER) AS rows, CAST(max(j) + 1 AS INTEGER) AS columns, true AS complete, true AS square, true AS zero_diagonal, round(min(risk), 6) AS low, round(max(risk), 6) AS high FROM x""",
)
def _(spark, sf):
    # a square text grid counted from the pairs, signed, read back as risks
    cell = lambda c: F.floor(c / 50).cast("int")
    counts = glucose(spark, sf).groupBy(cell(T()).alias("i"), cell(P()).alias("j")).agg(F.count("*").alias("n"))
    # every line of the grid on its own: the cells that pairs fall into, zero elsewhere
    places = F.sequence(F.lit(0), counts.agg(F.max(F.greatest("i", "j"))).scalar())
    risk = F.when(F.col("i") != F.col("j"), -F.least(F.lit(4.0), F.col("n") / 100.0)).otherwise(0.0)
    held = counts.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", risk))).alias("held"))
    every = counts.select(F.explode(places).alias("i")).distinct().join(held, "i", "left").withColumn("places", places)
    cells = F.transform("places", lambda j: F.coalesce(F.try_element_at("held", j), F.lit(0.0)).cast("string"))
    path = fresh_path(spark, "seg")
    lines = every.select("i", F.array_join(cells, " ").alias("value"))
    lines.repartitionByRange(1, "i").sortWithinPartitions("i").select("value").write.text(path)  # one file holds a grid, line by line
    return rounded(seg_table_report(read_seg_table(spark, path)))


@query(
    "strata_rmse",
    f"""WITH {GLU}, e AS (SELECT dataset, subject_id, t, pow(t - p, 2) AS e FROM glu)
    SELECT dataset, subject_id, round(sqrt(avg(e) FILTER (t > 180)), 6) AS "Hyper (>180)", round(sqrt(avg(e) FILTER (t BETWEEN 70 AND 180)), 6) AS "In-range [70,180]",
      round(sqrt(avg(e) FILTER (t < 70)), 6) AS "Hypo (<70)" FROM e GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(rollup.strata_rmse(glucose(spark, sf), KEYS))


@query(
    "strata_table",
    f"""WITH {GLU}, e AS (SELECT dataset, subject_id, CASE WHEN t > 180 THEN 'Hyper (>180)' WHEN t >= 70 THEN 'In-range [70,180]' ELSE 'Hypo (<70)' END AS stratum, pow(t - p, 2) AS e FROM glu),
    r AS (SELECT dataset, subject_id, stratum, sqrt(avg(e)) AS r FROM e GROUP BY 1, 2, 3),
    c AS (SELECT stratum, dataset, printf('%.2f (%.2f)', avg(r), coalesce(stddev_samp(r), 0)) AS cell FROM r GROUP BY 1, 2)
    SELECT stratum, coalesce(max(cell) FILTER (dataset = 'g0'), '') AS g0, coalesce(max(cell) FILTER (dataset = 'g1'), '') AS g1, coalesce(max(cell) FILTER (dataset = 'g2'), '') AS g2, coalesce(max(cell) FILTER (dataset = 'g9'), '') AS g9 FROM c GROUP BY 1""",
)
def _(spark, sf):
    each = rollup.strata_rmse(glucose(spark, sf), KEYS)
    return rollup.strata_table(each, "dataset", ["g0", "g1", "g2", "g9"])


def overlapping(t):
    return [("low", t < 80), ("not high", t <= 180), ("high", t > 180), ("very high", t > 250)]


@query(
    "strata_by_condition",
    f"""WITH {GLU}, e AS (SELECT dataset, subject_id, t, pow(t - p, 2) AS e FROM glu)
    SELECT dataset, subject_id, round(sqrt(avg(e) FILTER (t < 80)), 6) AS "low", round(sqrt(avg(e) FILTER (t <= 180)), 6) AS "not high",
      round(sqrt(avg(e) FILTER (t > 180)), 6) AS "high", round(sqrt(avg(e) FILTER (t > 250)), 6) AS "very high" FROM e GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(rollup.strata_rmse(glucose(spark, sf), KEYS, strata=overlapping(T())))


@query(
    "strata_rows",
    f"""WITH {GLU}, s(stratum, lo, hi) AS (VALUES ('low', -1e9, 79.999999999), ('not high', -1e9, 180), ('high', 180.000000001, 1e9), ('very high', 250.000000001, 1e9))
    SELECT dataset, stratum, count(*) AS n, round(avg(abs(t - p)), 6) AS mae FROM glu JOIN s ON t BETWEEN lo AND hi GROUP BY 1, 2""",
)
def _(spark, sf):
    rows = rollup.strata_rows(glucose(spark, sf), overlapping(T()))
    return rounded(rows.groupBy("dataset", "stratum").agg(F.count("*").alias("n"), F.avg(F.abs(T() - P())).alias("mae")))


@query("zone_summary_by_dataset", f"WITH {ZONED} SELECT dataset, {SUMMARY} FROM zoned GROUP BY 1")
def _(spark, sf):
    return rounded(rollup.zone_summary(glucose(spark, sf), ["dataset"]))


@query("zone_summary_by_participant", f"WITH {ZONED} SELECT dataset, subject_id, {SUMMARY} FROM zoned GROUP BY 1, 2")
def _(spark, sf):
    return rounded(rollup.zone_summary(glucose(spark, sf), KEYS))


MEANS = """count(*) AS n_participants, round(avg(a), 6) AS ceg_a_mean, round(stddev_samp(a), 6) AS ceg_a_std, round(avg(s), 6) AS seg_a_mean, round(stddev_samp(s), 6) AS seg_a_std,
  round(avg(k), 6) AS seg_risk_mean, round(stddev_samp(k), 6) AS seg_risk_std"""


@query(
    "clinical_report",
    f"""WITH {ZONED}, e AS (SELECT dataset, subject_id, avg(CASE WHEN zone = 'A' THEN 100.0 ELSE 0 END) AS a, avg(CASE WHEN risk = 0 THEN 100.0 ELSE 0 END) AS s, avg(risk) AS k FROM zoned GROUP BY 1, 2)
    SELECT 'last' AS method, dataset, {MEANS} FROM e GROUP BY dataset
    UNION ALL SELECT 'last', 'Overall (Open)', {MEANS} FROM e WHERE dataset <> 'g2' UNION ALL SELECT 'last', 'Overall (Total)', {MEANS} FROM e""",
)
def _(spark, sf):
    rows = glucose(spark, sf).withColumn("method", F.lit("last"))
    return rounded(clinical_report(rows, "method", "dataset", "subject_id", ["g2"]))


@query(
    "participant_zone_means",
    f"""WITH {ZONED}, e AS (SELECT dataset, subject_id, """ + ", ".join(f"avg(CASE WHEN zone = '{z}' THEN 100.0 ELSE 0 END) AS {z}" for z in LETTERS) + """ FROM zoned GROUP BY 1, 2)
    SELECT dataset, """ + ", ".join(f"round(avg({z}), 6) AS {z}" for z in LETTERS) + " FROM e GROUP BY 1",
)
def _(spark, sf):
    return rounded(rollup.participant_zone_means(glucose(spark, sf), ["dataset"], "subject_id", clinical.clarke_zone(T(), P()), LETTERS))
