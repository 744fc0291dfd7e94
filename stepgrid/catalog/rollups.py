"""Dimension joins, roll-ups, cohort tests and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepgrid.catalog.base import DAY, KEYS, PAIRS, POS, READINGS, SPEC, query, raw_events, readings, rounded, slot, table
from stepgrid.functions import metrics
from stepgrid.operators import ranks, rollup, stats
from stepgrid.operators.windows import persistence_pairs
from stepgrid.plans import evaluation



def P():
    return F.col("prediction")


def T():
    return F.col("ground_truth")


def scores(spark, sf):
    """RMSE per dataset and subject of three methods: 1, 2 and 3 days back."""
    pairs = persistence_pairs(readings(spark, sf), SPEC, [1, 2, 3])
    method = F.concat(F.lit("back"), F.col("horizon_steps").cast("string")).alias("method")
    return pairs.groupBy(*KEYS, method).agg(
        metrics.rmse(P(), T()).alias("rmse"), F.count("*").alias("n_windows"), metrics.mae(P(), T()).alias("mae")
    )


SCORES = f"""{READINGS}, runs AS (SELECT *, slot - row_number() OVER (PARTITION BY dataset, subject_id ORDER BY slot) AS run FROM readings),
hs AS (SELECT unnest([1, 2, 3]) AS h),
scores AS (SELECT a.dataset, a.subject_id, 'back' || CAST(h AS VARCHAR) AS method, sqrt(avg((a.value - b.value) * (a.value - b.value))) AS rmse, count(*) AS n_windows, avg(abs(a.value - b.value)) AS mae
  FROM runs a JOIN hs ON true JOIN runs b ON a.dataset = b.dataset AND a.subject_id = b.subject_id AND a.run = b.run AND b.slot = a.slot + h GROUP BY 1, 2, 3)"""


@query(
    "attach_phenotype",
    f"""WITH {SCORES} SELECT s.dataset, s.subject_id, s.method, round(s.rmse, 6) AS rmse, c.c_mktsegment AS diabetes_type
    FROM scores s LEFT JOIN customer c ON CAST(s.subject_id AS BIGINT) = c.c_custkey AND c.c_acctbal > 0""",
)
def _(spark, sf):
    dim = table(spark, sf, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").cast("string").alias("subject_id"), F.col("c_mktsegment").alias("diabetes_type")
    )
    out = rollup.attach_dimension(scores(spark, sf).select(*KEYS, "method", "rmse"), dim, ["subject_id"])
    return rounded(out.select("dataset", "subject_id", "method", "rmse", "diabetes_type"))


@query(
    "unmapped_keys",
    f"""WITH {READINGS} SELECT DISTINCT subject_id FROM readings WHERE CAST(subject_id AS BIGINT) NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def _(spark, sf):
    dim = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("subject_id"))
    return rollup.unmapped_keys(readings(spark, sf), dim, ["subject_id"])


@query(
    "map_patient_to_dataset",
    """SELECT n_name AS dataset, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def _(spark, sf):
    from stepgrid.sources.readings import unique_patients

    pairs = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    dim = unique_patients(pairs.select(F.col("n_name").alias("dataset"), F.col("c_custkey").alias("patient")))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("patient"), "o_totalprice")
    joined = rollup.attach_dimension(rows, dim, ["patient"], "inner")
    return joined.groupBy("dataset").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean_price"))


@query(
    "allowed_datasets",
    f"WITH {READINGS} SELECT dataset, count(*) AS n FROM readings WHERE dataset IN ('g0', 'g2') GROUP BY 1",
)
def _(spark, sf):
    return readings(spark, sf).filter(F.col("dataset").isin("g0", "g2")).groupBy("dataset").agg(F.count("*").alias("n"))


@query(
    "common_participants",
    """SELECT DISTINCT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT DISTINCT user_id FROM events WHERE event_type = 'error'""",
)
def _(spark, sf):
    ev = table(spark, sf, "events")
    return rollup.common_keys(ev.filter("event_type = 'click'"), ev.filter("event_type = 'error'"), ["user_id"])


@query(
    "config_grid",
    f"""WITH {READINGS}, s AS (SELECT DISTINCT dataset, subject_id FROM readings), g AS (SELECT unnest([2, 4, 6]) AS context_steps), h AS (SELECT unnest([1, 2]) AS horizon_steps)
    SELECT dataset, subject_id, CAST(context_steps AS INTEGER) AS context_steps, CAST(horizon_steps AS INTEGER) AS horizon_steps FROM s, g, h
    WHERE NOT (CAST(subject_id AS BIGINT) % 5 = 0 AND context_steps = 4 AND horizon_steps = 1)""",
)
def _(spark, sf):
    rows = readings(spark, sf)
    done = rows.select(*KEYS).distinct().filter(F.col("subject_id").cast("bigint") % 5 == 0)
    done = done.withColumns({"context_steps": F.lit(4), "horizon_steps": F.lit(1)})
    grid = [(c, h) for c in (2, 4, 6) for h in (1, 2)]
    return evaluation.work_units(rows, SPEC, grid, done)


@query(
    "rolling_evaluation",
    f"""WITH {POS}, l AS (SELECT dataset, subject_id, slot, pos, lead(slot, 3) OVER w AS e4, lead(slot, 5) OVER w AS e6, lead(value, 1) OVER w AS v1, lead(value, 2) OVER w AS v2,
        lead(value, 3) OVER w AS v3, lead(value, 4) OVER w AS v4, lead(value, 5) OVER w AS v5 FROM pos WINDOW w AS (PARTITION BY dataset, subject_id ORDER BY slot)),
    s AS (SELECT dataset, subject_id, 2 AS c, v1 AS p, v2 AS t, false AS f FROM l WHERE e4 = slot + 3 AND pos % 2 = 0 UNION ALL SELECT dataset, subject_id, 2, v1, v3, true FROM l WHERE e4 = slot + 3 AND pos % 2 = 0
      UNION ALL SELECT dataset, subject_id, 4, v3, v4, false FROM l WHERE e6 = slot + 5 AND pos % 2 = 0 UNION ALL SELECT dataset, subject_id, 4, v3, v5, true FROM l WHERE e6 = slot + 5 AND pos % 2 = 0)
    SELECT dataset, subject_id, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse_all, round(avg(abs(p - t)), 6) AS mae_all, round(sqrt(avg((p - t) * (p - t)) FILTER (f)), 6) AS rmse_final,
      round(avg(abs(p - t)) FILTER (f), 6) AS mae_final, count(*) FILTER (f) AS n_windows, CAST(c AS INTEGER) AS context_steps, CAST(2 AS INTEGER) AS horizon_steps FROM s GROUP BY dataset, subject_id, c""",
)
def _(spark, sf):
    return rounded(evaluation.rolling_evaluation(readings(spark, sf), SPEC, [(2, 2), (4, 2)], 2))


for _dev in ("population", "sample"):
    _fn = "stddev_pop" if _dev == "population" else "stddev_samp"

    @query(
        f"across_patients_{_dev}",
        f"WITH {SCORES} SELECT dataset, method, round(avg(rmse), 6) AS rmse_mean, round({_fn}(rmse), 6) AS rmse_std, count(rmse) AS n_patients FROM scores GROUP BY 1, 2",
    )
    def _(spark, sf, dev=_dev):
        return rounded(rollup.across_patients(scores(spark, sf), ["dataset", "method"], "rmse", dev))


@query(
    "weighted_dataset_summary",
    f"""WITH {SCORES} SELECT method, dataset, subject_id, n_windows, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM scores
    UNION ALL SELECT method, dataset, 'ALL_PATIENTS', CAST(sum(n_windows) AS BIGINT), round(sqrt(sum(n_windows * rmse * rmse) / sum(n_windows)), 6), round(sum(n_windows * mae) / sum(n_windows), 6) FROM scores GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(rollup.weighted_dataset_summary(scores(spark, sf), "dataset", "subject_id", ["method"]))


METHODS = ["back1", "back2", "back3"]


@query(
    "pivot_dataset_method",
    f"WITH {SCORES} SELECT dataset, " + ", ".join(f"round(avg(rmse) FILTER (method = '{m}'), 6) AS {m}" for m in METHODS) + " FROM scores GROUP BY 1",
)
def _(spark, sf):
    return rounded(rollup.pivot_table(scores(spark, sf), "dataset", "method", METHODS, "rmse"))


@query(
    "melt_metrics",
    f"WITH {SCORES} SELECT dataset, subject_id, method, 'rmse' AS metric, round(rmse, 6) AS value FROM scores UNION ALL SELECT dataset, subject_id, method, 'mae', round(mae, 6) FROM scores",
)
def _(spark, sf):
    return rounded(rollup.melt(scores(spark, sf), [*KEYS, "method"], ["rmse", "mae"], "metric", "value"))


@query(
    "stitch_protocols",
    f"""WITH {SCORES}, c AS (SELECT dataset, method, printf('%.2f (%.2f)', avg(rmse), coalesce(stddev_samp(rmse), 0)) AS cell FROM scores WHERE NOT (dataset = 'g1' AND method = 'back2') GROUP BY 1, 2)
    SELECT 'fullshot' AS protocol, dataset, """ + ", ".join(f"coalesce(max(cell) FILTER (method = '{m}'), '') AS {m}" for m in METHODS) + " FROM c GROUP BY 2",
)
def _(spark, sf):
    from stepgrid.functions.text import mean_std_text

    rows = scores(spark, sf).filter("NOT (dataset = 'g1' AND method = 'back2')")
    cells = rows.groupBy("dataset", "method").agg(mean_std_text(F.col("rmse")).alias("cell")).withColumn("protocol", F.lit("fullshot"))
    return rollup.stitch_protocols(cells, "protocol", "method", "dataset", "cell", METHODS)


@query(
    "collapse_duplicates",
    "SELECT o_custkey, o_orderstatus, round(avg(o_totalprice), 6) AS o_totalprice FROM orders GROUP BY 1, 2",
)
def _(spark, sf):
    out = stats.collapse_duplicates(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], "o_totalprice")
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query(
    "scope_summary",
    f"""WITH {SCORES} SELECT 'all' AS scope, count(*) AS n, round(avg(rmse), 6) AS mean, round(stddev_samp(rmse), 6) AS std FROM scores
    UNION ALL SELECT 'open', count(*), round(avg(rmse), 6), round(stddev_samp(rmse), 6) FROM scores WHERE dataset IN ('g0', 'g1')""",
)
def _(spark, sf):
    return rounded(rollup.scope_summary(scores(spark, sf), "dataset", ["g0", "g1"], "rmse"))


@query(
    "mean_columns",
    "SELECT l_returnflag, l_linestatus, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " FROM lineitem GROUP BY 1, 2",
)
def _(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = rollup.mean_columns(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], cols)
    return out.withColumns({c: F.round(c, 6) for c in cols})


@query(
    "relative_score",
    f"""WITH {SCORES}, a AS (SELECT dataset, method, avg(rmse) AS rmse, avg(mae) AS mae FROM scores GROUP BY 1, 2)
    SELECT round(exp(avg(ln(m.rmse / b.rmse))), 6) AS rmse, round(exp(avg(ln(m.mae / b.mae))), 6) AS mae FROM a m JOIN a b USING (dataset) WHERE m.method = 'back3' AND b.method = 'back1'""",
)
def _(spark, sf):
    agg = scores(spark, sf).groupBy("dataset", "method").agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))
    return rounded(rollup.relative_score(agg.filter("method = 'back3'"), agg.filter("method = 'back1'"), "dataset", ["rmse", "mae"]))


@query(
    "pair_methods",
    f"""WITH {SCORES} SELECT a.dataset, a.subject_id, a.method AS method_a, b.method AS method_b, round(a.rmse, 6) AS value_a, round(b.rmse, 6) AS value_b
    FROM scores a JOIN scores b ON a.dataset = b.dataset AND a.subject_id = b.subject_id AND a.method < b.method""",
)
def _(spark, sf):
    out = stats.pair_methods(scores(spark, sf), ["dataset"], ["subject_id"], "method", "rmse")
    return rounded(out.select(*KEYS, "method_a", "method_b", "value_a", "value_b"))


# integer-valued scores per supplier and part: many ties and zeros
TIES = """sc AS (SELECT l_returnflag AS dataset, l_suppkey AS part, CASE WHEN l_linenumber <= 2 THEN 'low' ELSE 'rest' END AS method, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3),
pr AS (SELECT a.dataset, a.part, a.method AS method_a, b.method AS method_b, a.v - b.v AS d FROM sc a JOIN sc b ON a.dataset = b.dataset AND a.part = b.part AND a.method < b.method),
rk AS (SELECT *, rank() OVER (PARTITION BY dataset, method_a, method_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY dataset, method_a, method_b, abs(d)) - 1) / 2 AS r,
  count(*) OVER (PARTITION BY dataset, method_a, method_b, abs(d)) AS ties FROM pr WHERE d <> 0),
agg AS (SELECT dataset, method_a, method_b, count(*) AS n_used, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(ties * ties - 1) AS tie FROM rk GROUP BY 1, 2, 3),
base AS (SELECT dataset, method_a, method_b, count(*) AS n_pairs, avg(d) AS mean_diff FROM pr GROUP BY 1, 2, 3)"""


def _tied(spark, sf):
    low = F.when(F.col("l_linenumber") <= 2, "low").otherwise("rest")
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").alias("part"), low.alias("method"))
    return rows.agg(F.count("*").cast("double").alias("v"))


@query(
    "paired_wilcoxon",
    f"""WITH {TIES} SELECT b.dataset, b.method_a, b.method_b, n_pairs, round(mean_diff, 6) AS mean_diff, CAST(n_used AS BIGINT) AS n_used, round(w_plus, 6) AS w_plus,
      round((w_plus - n_used * (n_used + 1) / 4.0) / sqrt((n_used * (n_used + 1) * (2 * n_used + 1) - tie / 2.0) / 24.0), 6) AS z FROM base b JOIN agg USING (dataset, method_a, method_b)""",
)
def _(spark, sf):
    pairs = stats.pair_methods(_tied(spark, sf), ["dataset"], ["part"], "method", "v")
    out = stats.paired_wilcoxon(pairs, ["dataset"])
    return rounded(out.select("dataset", "method_a", "method_b", "n_pairs", "mean_diff", "n_used", "w_plus", "z"))


# complementary error function, fractional error below 1.2e-7
_T = "(1 / (1 + 0.5 * x))"
ERFC = "1.26551223 1.00002368 0.37409196 0.09678418 -0.18628806 0.27886807 -1.13520398 1.48851587 -0.82215223 0.17087277".split()
ERFC_SQL = f"{_T} * exp(-x * x - {ERFC[0]} + " + " + ".join(f"({c}) * pow({_T}, {i + 1})" for i, c in enumerate(ERFC[1:])) + ")"


@query(
    "cohort_tests",
    f"""WITH RECURSIVE ways AS (SELECT 0 AS n, 0 AS w, 1.0::DOUBLE AS c
      UNION ALL SELECT n + 1, w + d.d * (n + 1), sum(c) / 2 FROM ways, (SELECT unnest([0, 1]) AS d) d WHERE n < 50 GROUP BY n + 1, w + d.d * (n + 1)),
    {SCORES}, pr AS (SELECT a.method AS method_a, b.method AS method_b, a.rmse - b.rmse AS d FROM scores a JOIN scores b ON a.dataset = b.dataset AND a.subject_id = b.subject_id AND a.method < b.method),
    rk AS (SELECT *, rank() OVER (PARTITION BY method_a, method_b ORDER BY abs(d)) AS r FROM pr),
    w AS (SELECT method_a, method_b, count(*) AS n, count(DISTINCT abs(d)) AS sizes, avg(d) AS mean_diff, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus FROM rk GROUP BY 1, 2),
    z AS (SELECT *, (w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0) AS z FROM w), e AS (SELECT *, abs(z) / sqrt(2) AS x FROM z),
    p AS (SELECT *, CASE WHEN n <= 50 AND sizes = n THEN least(1, 2 * (SELECT sum(c) FROM ways WHERE ways.n = e.n AND ways.w <= least(w_plus, e.n * (e.n + 1) / 2 - w_plus))) ELSE {ERFC_SQL} END AS p FROM e),
    k AS (SELECT *, row_number() OVER (ORDER BY p) AS k FROM p), q AS (SELECT *, least(1, min(p * 3 / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM k)
    SELECT 'zeroshot' AS protocol, method_a, method_b, n AS n_pairs, n AS n_used, round(mean_diff, 6) AS mean_diff, CAST(w_plus AS DOUBLE) AS w_plus, round(z, 6) AS z, round(p, 5) AS p_value, round(q, 5) AS p_adj_bh, q < 0.05 AS significant FROM q""",
)
def _(spark, sf):
    rows = scores(spark, sf).withColumn("protocol", F.lit("zeroshot"))
    out = evaluation.cohort_tests(rows, "protocol", KEYS, "method", "rmse")
    return rounded(out).withColumns({c: F.round(c, 5) for c in ("p_value", "p_adj_bh")})


@query(
    "benjamini_hochberg",
    """WITH t AS (SELECT l_returnflag AS protocol, l_suppkey % 25 AS test, CASE WHEN l_suppkey % 25 = 3 THEN NULL ELSE exp(-abs(avg(l_quantity) - 25.5) * 4) END AS p FROM lineitem GROUP BY 1, l_suppkey % 25),
    r AS (SELECT *, row_number() OVER (PARTITION BY protocol ORDER BY p) AS k, count(*) OVER (PARTITION BY protocol) AS m FROM t WHERE p IS NOT NULL),
    a AS (SELECT protocol, test, p, least(1, min(p * m / k) OVER (PARTITION BY protocol ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)
    SELECT protocol, test, round(p, 6) AS p_value, round(q, 6) AS p_adj_bh, q < 0.05 AS significant FROM a UNION ALL SELECT protocol, test, NULL, NULL, false FROM t WHERE p IS NULL""",
)
def _(spark, sf):
    key = F.col("l_suppkey") % 25
    tests = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("protocol"), key.alias("test")).agg(F.avg("l_quantity").alias("q"))
    p = F.when(F.col("test") != 3, F.exp(-F.abs(F.col("q") - 25.5) * 4))
    return rounded(stats.benjamini_hochberg(tests.withColumn("p_value", p).drop("q"), ["protocol"]))


@query(
    "method_matrix",
    f"""WITH {SCORES}, p AS (SELECT a.dataset, a.method AS ma, b.method AS mb, avg(a.rmse - b.rmse) AS d FROM scores a JOIN scores b ON a.dataset = b.dataset AND a.subject_id = b.subject_id AND a.method < b.method GROUP BY 1, 2, 3),
    s AS (SELECT dataset, ma, mb, d FROM p UNION ALL SELECT dataset, mb, ma, d FROM p)
    SELECT dataset, ma AS method, """ + ", ".join(f"CASE WHEN ma = '{m}' THEN 0.0::DOUBLE ELSE round(max(d) FILTER (mb = '{m}'), 6) END AS {m}" for m in METHODS) + " FROM s GROUP BY 1, 2",
)
def _(spark, sf):
    pairs = stats.pair_methods(scores(spark, sf), ["dataset"], ["subject_id"], "method", "rmse")
    diffs = pairs.groupBy("dataset", "method_a", "method_b").agg(F.avg(F.col("value_a") - F.col("value_b")).alias("d"))
    return rounded(stats.method_matrix(diffs, ["dataset"], METHODS, "d", 0.0))


@query(
    "average_ranks",
    """SELECT l_returnflag, l_quantity, count(*) AS ties, (min(r) + max(r)) / 2.0 AS avg_rank FROM (
      SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r FROM lineitem) GROUP BY 1, 2""",
)
def _(spark, sf):
    return ranks.average_ranks(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity")


@query(
    "dataset_weights",
    """WITH l AS (SELECT p_brand AS name, l_partkey, count(*) AS length FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    s AS (SELECT CASE WHEN name LIKE 'Brand#1%' THEN 'Brand#1' ELSE name END AS g, name, sum(length) AS len, count(*) AS k FROM l GROUP BY 1, 2),
    g AS (SELECT g, sum(len) AS len, sum(k) AS k, count(*) AS shards FROM s GROUP BY 1), o AS (SELECT *, least(0.03, len / (SELECT sum(len) FROM g)) AS om FROM g)
    SELECT name, round(om / (SELECT sum(om) FROM o) * (SELECT sum(k) FROM g) / o.k / shards, 6) AS weight FROM s JOIN o USING (g)""",
)
def _(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name"))
    lengths = table(spark, sf, "lineitem").join(part, "l_partkey").groupBy("name", "l_partkey").agg(F.count("*").alias("length"))
    group = F.when(F.col("name").startswith("Brand#1"), "Brand#1").otherwise(F.col("name"))
    return rounded(rollup.dataset_weights(lengths, "name", group, 0.03))


@query(
    "merge_throughput",
    """WITH r AS (SELECT o_orderstatus AS method, o_orderkey AS src, CASE WHEN o_orderkey % 3 = 0 THEN 'zeroshot' ELSE 'fullshot' END AS protocol,
        CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS sec, o_totalprice / 100 AS ms FROM orders)
    SELECT method, arg_min(sec, src) FILTER (sec IS NOT NULL) AS sec, round(arg_min(ms, src) FILTER (protocol <> 'zeroshot'), 6) AS ms, round(arg_max(ms, src) FILTER (protocol = 'zeroshot'), 6) AS zeroshot_ms FROM r GROUP BY 1""",
)
def _(spark, sf):
    rec = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("method"),
        F.col("o_orderkey").alias("src"),
        F.when(F.col("o_orderkey") % 3 == 0, "zeroshot").otherwise("fullshot").alias("protocol"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("sec"),
        (F.col("o_totalprice") / 100).alias("ms"),
    )
    return rounded(rollup.merge_throughput(rec, "method", "src", ["sec", "ms"], ["ms"]))


COST = f"""{POS}, l AS (SELECT dataset, pos, slot, lead(slot, 5) OVER (PARTITION BY dataset, subject_id ORDER BY slot) AS last FROM pos),
ok AS (SELECT CASE WHEN dataset = 'g0' THEN 'test' ELSE 'train' END AS split, pos FROM l WHERE last = slot + 5),
tp AS (SELECT o_orderstatus AS method, avg(o_totalprice) / 1e5 AS sec1k, avg(o_totalprice) / 1e6 AS ms FROM orders GROUP BY 1),
cfg AS (SELECT * FROM (VALUES ('F', 'fullshot', 2, 10, 16, NULL, NULL), ('O', 'fullshot', 1, 3, 8, NULL, 1000), ('P', 'fewshot', 2, NULL, 32, 1600, NULL)) t(method, protocol, stride, epochs, batch, steps, cap)),
x AS (SELECT cfg.*, sec1k, ms, (SELECT count(*) FROM ok WHERE split = 'train' AND pos % stride = 0) AS tw, (SELECT count(*) FROM ok WHERE split = 'test') AS iw FROM cfg JOIN tp USING (method))"""


@query(
    "cost_estimate",
    f"""WITH {COST} SELECT method, protocol, tw AS train_windows, least(tw, coalesce(cap, tw)) AS windows_per_epoch,
      CAST(CASE WHEN steps IS NOT NULL THEN steps ELSE floor(least(tw, coalesce(cap, tw)) / batch) * epochs END AS BIGINT) AS train_steps,
      round(CASE WHEN steps IS NOT NULL THEN sec1k / 50 * steps ELSE least(tw, coalesce(cap, tw)) / 1000.0 * sec1k * epochs END, 6) AS train_seconds, iw AS infer_windows, round(iw * ms / 1000.0, 6) AS infer_seconds FROM x""",
)
def _(spark, sf):
    from stepgrid.operators.windows import count_windows

    rows = readings(spark, sf).withColumn("split", F.when(F.col("dataset") == "g0", "test").otherwise("train"))
    spec = SPEC.with_(keys=("dataset", "subject_id", "split"))
    work = count_windows(rows, spec, 6, [1, 2], ["split"]).withColumn("convention", F.lit("contiguous"))
    price = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("method")).agg(F.avg("o_totalprice").alias("a"))
    tp = price.select(
        "method",
        (F.col("a") / 1e5).alias("sec_per_1k_train_windows"),
        (F.col("a") / 1e5 / 50).alias("sec_per_step"),
        (F.col("a") / 1e6).alias("ms_per_window"),
        (F.col("a") / 1e6).alias("zeroshot_ms_per_window"),
    )
    cfg = spark.createDataFrame(
        [("F", "fullshot", "contiguous", 10, 16, 2, None, None), ("O", "fullshot", "contiguous", 3, 8, 1, None, 1000), ("P", "fewshot", "contiguous", None, 32, 2, 1600, None)],
        "method string, protocol string, convention string, epochs int, batch int, stride int, steps int, window_cap bigint",
    )
    return rounded(rollup.cost_estimate(tp, work, cfg))


@query(
    "display_order",
    """SELECT row_number() OVER (ORDER BY CASE m WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, m) AS place, m AS segment, n FROM (SELECT c_mktsegment AS m, count(*) AS n FROM customer GROUP BY 1)""",
)
def _(spark, sf):
    counts = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    return rollup.with_display_place(counts, "segment", ["MACHINERY", "BUILDING"])
