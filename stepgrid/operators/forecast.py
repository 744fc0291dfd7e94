"""Baseline forecasts, covariate regression and the plug-in forecaster slot."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepgrid.operators.ranks import number_in_order
from stepgrid.operators.windows import lag_rows
from stepgrid.series import SeriesSpec, spread_join, with_position
from stepgrid.session import settle


def last_observed(windows: DataFrame, horizon: int | Column) -> DataFrame:
    """The last context value as the forecast of every horizon step."""
    return windows.withColumn("forecast", F.array_repeat(F.element_at("context", -1), horizon))


def seasonal_naive(df: DataFrame, spec: SeriesSpec, season: int) -> DataFrame:
    """The value one season back as the forecast of each reading."""
    rows = lag_rows(with_position(df, spec), spec, {"prediction": season})
    return rows.filter(F.col("prediction").isNotNull()).withColumn("ground_truth", F.col(spec.value))


def seasonal_naive_windows(windows: DataFrame, season: int, horizon: int) -> DataFrame:
    """Repeat the last season of the context over the horizon."""
    tail = F.slice("context", F.size("context") - season + 1, F.lit(season))
    steps = F.sequence(F.lit(0), F.lit(horizon - 1))
    return windows.withColumn("forecast", F.transform(steps, lambda i: F.get(tail, i % season)))


def long_predictions(windows: DataFrame, keys: list[str], forecast: str = "forecast", target: str | None = "target") -> DataFrame:
    """One row per horizon step, with the truth where it is known."""
    if target is None:
        return windows.select(*keys, F.posexplode(forecast).alias("horizon_step", "prediction"))
    zipped = F.arrays_zip(F.col(forecast).alias("p"), F.col(target).alias("t"))
    out = windows.select(*keys, F.posexplode(zipped).alias("horizon_step", "r"))
    return out.select(*keys, "horizon_step", F.col("r.p").alias("prediction"), F.col("r.t").alias("ground_truth"))


def forecast_apply(
    windows: DataFrame,
    keys: list[str],
    make_model: Callable[[], Callable[[list[np.ndarray]], dict[str, np.ndarray]]],
    outputs: list[str],
    context: str = "context",
) -> DataFrame:
    """Batch inference over windows by any forecaster.

    ``make_model`` runs once per Python worker; the model takes a list of
    contexts and returns one (windows, horizon) array per output name. A batch
    that fails is halved until single windows are left: only those that fail
    alone yield a row with ``error`` set and null outputs, whatever the batch
    size. Rows stream through in Arrow batches.
    """
    kept = [c for c in windows.columns if c in keys or c == "target"]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in windows.schema if f.name in kept]
    schema = ", ".join([*fields, *[f"{o} array<double>" for o in outputs], "error string"])

    def forecast(model, contexts: list[np.ndarray]) -> list[tuple]:
        """Outputs and error of each window."""
        try:
            made = model(contexts)
            arrays = [np.asarray(made[name], dtype=float) for name in outputs]
            if any(len(x) != len(contexts) for x in arrays):
                raise ValueError("the model returned another number of windows")
            return [(*(x[k].tolist() for x in arrays), None) for k in range(len(contexts))]
        except Exception as problem:  # one bad window must not end the job
            if len(contexts) == 1:
                return [(*(None for _ in outputs), f"{type(problem).__name__}: {problem}")]
            half = len(contexts) // 2
            return forecast(model, contexts[:half]) + forecast(model, contexts[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            if not len(batch):
                continue
            out = batch[kept].copy()
            made = forecast(model, [np.asarray(c, dtype=float) for c in batch[context]])
            for k, name in enumerate([*outputs, "error"]):
                out[name] = [row[k] for row in made]
            yield out

    needed = windows.select(*dict.fromkeys([*kept, context]))
    return needed.mapInPandas(run, schema)


def point_choice(*candidates: str) -> Column:
    """Median if there is one, else sample mean, else mean."""
    return F.coalesce(*[F.col(c) for c in candidates])


def sample_median(samples: DataFrame, keys: list[str], value: str = "sample") -> DataFrame:
    """Median over samples per (id, step). A forecast has a fixed number of
    samples, so a group stays small however many forecasts there are."""
    return samples.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("prediction"))


def forecast_frame(windows: DataFrame, keys: list[str], ts: str, step_us: int, columns: dict[str, str], target_name: str) -> DataFrame:
    """Long output: ids, timestamp, target name, one column per output.

    ``columns`` maps array columns to output names; ``ts`` is the timestamp of
    the first forecast step.
    """
    zipped = F.arrays_zip(*[F.col(c).alias(n) for c, n in columns.items()])
    out = windows.select(*keys, F.col(ts).alias("_t0"), F.posexplode(zipped).alias("_k", "_r"))
    at = F.timestamp_micros(F.unix_micros(F.col("_t0").cast("timestamp")) + F.col("_k") * step_us)
    return out.select(
        *keys, at.alias("timestamp"), F.lit(target_name).alias("target_name"), *[F.col(f"_r.{n}").alias(n) for n in columns.values()]
    )


class RidgeFit:
    """Coefficients of a covariate regression, usable as a column."""

    def __init__(self, terms: list[Column], beta: np.ndarray):
        self.terms, self.beta = terms, beta

    def predict(self) -> Column:
        out = F.lit(0.0)
        for b, x in zip(self.beta, self.terms):
            out = out + float(b) * x
        return out


def xreg_ridge(
    train: DataFrame,
    target: str,
    numeric: list[str],
    categorical: dict[str, list[str]],
    ridge: float = 0.0,
    tol: float = 1e-6,
) -> RidgeFit:
    """Pooled linear regression on covariates.

    Numbers are standardised on the training rows, categories one-hot coded
    (first dropped unless ridge > 0), an intercept added. The table is read
    twice by map-side aggregates, for the moments and for X'X and X'y; only
    those k x k numbers reach the driver, whose size does not grow with rows.
    """
    moments = {}
    if numeric:
        aggs = [f(F.col(c)).alias(f"{n}_{i}") for i, c in enumerate(numeric) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        row = train.agg(*aggs).first()
        moments = {c: (row[f"m_{i}"], row[f"s_{i}"] if row[f"s_{i}"] > tol else 1.0) for i, c in enumerate(numeric)}
    terms: list[Column] = [F.lit(1.0)]
    terms += [(F.col(c) - moments[c][0]) / moments[c][1] for c in sorted(numeric)]
    for name in sorted(categorical):
        cats = categorical[name] if ridge > 0 else categorical[name][1:]
        terms += [F.coalesce((F.col(name) == F.lit(c)).cast("double"), F.lit(0.0)) for c in cats]
    k = len(terms)
    design = train.select(*[t.alias(f"x{i}") for i, t in enumerate(terms)], F.col(target).cast("double").alias("y"))
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a_{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(F.col(f"x{i}") * F.col("y")).alias(f"b_{i}") for i in range(k)]
    row = design.agg(*sums).first()
    gram = np.array([[row[f"a_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    moment = np.array([row[f"b_{i}"] for i in range(k)], dtype=float)
    return RidgeFit(terms, np.linalg.pinv(gram + ridge * np.eye(k), hermitian=True) @ moment)


class CategoryFit:
    """Coefficients of a covariate regression whose categories are a table.

    ``levels`` has ``field, level, beta``; a level it lacks counts as zero.
    """

    def __init__(self, numeric: Column, fields: list[str], levels: DataFrame):
        self.numeric, self.fields, self.levels = numeric, fields, levels

    def predict(self, df: DataFrame, out: str = "xreg") -> DataFrame:
        """Add the regression to rows; each categorical field meets the levels in a join that splits hot ones."""
        df = df.withColumn(out, self.numeric)
        for field in self.fields:
            own = self.levels.where(F.col("field") == field).select(F.col("level").alias("_level"), F.col("beta").alias("_beta"))
            df = spread_join(df.withColumn("_level", F.col(field).cast("string")), own, ["_level"], how="left")
            df = df.withColumn(out, F.col(out) + F.coalesce("_beta", F.lit(0.0))).drop("_level", "_beta")
        return df


DRIVER_TERMS = 512  # so many terms at most are solved on the driver


def xreg_category_ridge(
    train: DataFrame, target: str, numeric: list[str], categorical: list[str], ridge: float = 0.0, tol: float = 1e-6, driver_terms: int = DRIVER_TERMS
) -> CategoryFit:
    """:func:`xreg_ridge` whose categories are found in the data and stay a table.

    Levels are numbered per field in sorted order (the first of each field
    dropped unless ridge > 0). The normal equations come from counts and sums
    by combination of levels, as a table of (term, term, value): pairs of
    levels give counts, a level and a number give a sum. Up to
    ``driver_terms`` terms the driver solves them; with more levels conjugate
    gradients do, as joins of that table with the vector. Rows need a target;
    a null number or category counts as zero.
    """
    sorted_numeric = sorted(numeric)
    moments = {}
    if numeric:
        row = train.agg(*[f(F.col(c)).alias(f"{n}_{i}") for i, c in enumerate(sorted_numeric) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        moments = {c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] if (row[f"s_{i}"] or 0.0) > tol else 1.0) for i, c in enumerate(sorted_numeric)}
    scaled = [F.coalesce((F.col(c) - moments[c][0]) / moments[c][1], F.lit(0.0)) for c in sorted_numeric]
    first_level = 1 + len(numeric)

    fields = sorted(categorical)
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("level")) for c in fields]) if fields else F.array().cast("array<struct<field:string,level:string>>"))
    levels = train.select(one.alias("l")).select("l.field", "l.level").distinct().where("level IS NOT NULL")
    if ridge <= 0:
        lowest = levels.groupBy("field").agg(F.min("level").alias("_low"))
        levels = levels.join(F.broadcast(lowest), "field").where("level > _low").drop("_low")
    levels = settle(number_in_order(levels, [F.col("field"), F.col("level")], "term").withColumn("term", F.col("term") + first_level), "levels")

    # one row per combination of levels: sums of products of 1, the numbers and the target
    parts = [F.lit(1.0), *scaled, F.col(target).cast("double")]
    y = len(parts) - 1
    names = [f"_c{i}" for i in range(len(fields))]
    rows = train.where(F.col(target).isNotNull()).select(*[F.col(c).cast("string").alias(n) for c, n in zip(fields, names)], *[p.alias(f"x{i}") for i, p in enumerate(parts)])
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p_{i}_{j}") for i in range(len(parts)) for j in range(i, len(parts))]
    sums = settle(rows.groupBy(*names).agg(*products), "products")
    for field, name in zip(fields, names):
        own = levels.where(F.col("field") == field).select(F.col("level").alias(name), F.col("term").alias(f"{name}_t"))
        sums = spread_join(sums, own, [name], how="left")
    held = [F.col(f"{n}_t") for n in names]
    value = lambda i, j: F.col(f"p_{min(i, j)}_{max(i, j)}")
    entry = lambda i, j, v: F.struct(i.cast("bigint").alias("i"), j.cast("bigint").alias("j"), v.alias("v"))
    end = F.lit(-1)  # the right-hand side
    entries = [entry(F.lit(i), F.lit(j), value(i, j)) for i in range(first_level) for j in range(first_level)]
    entries += [entry(F.lit(i), end, value(i, y)) for i in range(first_level)]
    for t in held:
        known = lambda *x, t=t: F.when(t.isNotNull(), entry(*x))
        entries += [known(t, F.lit(i), value(0, i)) for i in range(first_level)] + [known(F.lit(i), t, value(0, i)) for i in range(first_level)]
        entries.append(known(t, end, value(0, y)))
        entries += [F.when(t.isNotNull() & u.isNotNull(), entry(t, u, value(0, 0))) for u in held]
    system = sums.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.v").alias("v"))
    system = settle(system, "normal-equations")

    terms = first_level + levels.count()
    solve = _solved_here if terms <= driver_terms else _solved_by_gradients
    beta = settle(solve(system, terms, ridge), "coefficients")
    named = levels.join(beta.withColumnRenamed("i", "term"), "term").select("field", "level", "beta")
    head = {r["i"]: r["beta"] for r in beta.where(F.col("i") < first_level).collect()}  # intercept and numbers
    line = F.lit(head.get(0, 0.0))
    for i, x in enumerate(scaled, 1):
        line = line + head.get(i, 0.0) * x
    return CategoryFit(line, fields, named)


def _solved_here(system: DataFrame, terms: int, ridge: float) -> DataFrame:
    gram, moment = np.zeros((terms, terms)), np.zeros(terms)
    for row in system.collect():  # terms x (terms + 1) numbers at most
        if row["j"] < 0:
            moment[row["i"]] = row["v"]
        else:
            gram[row["i"], row["j"]] = row["v"]
    beta = np.linalg.pinv(gram + ridge * np.eye(terms), hermitian=True) @ moment
    return system.sparkSession.createDataFrame([(i, float(b)) for i, b in enumerate(beta)], "i bigint, beta double")


def _solved_by_gradients(system: DataFrame, terms: int, ridge: float, tolerance: float = 1e-12) -> DataFrame:
    """Conjugate gradients from zero, so a singular system gets its smallest solution.

    Scaled by the diagonal. A step is one join on the term and one aggregate;
    two numbers steer it from the driver.
    """
    gram, right = system.where("j >= 0"), system.where("j < 0").select("i", F.col("v").alias("b"))
    diagonal = gram.where("i = j").select("i", F.sqrt(F.col("v") + ridge).alias("d")).where("d > 0")
    state = diagonal.join(right, "i", "left").select("i", "d", F.lit(0.0).alias("x"), (F.coalesce("b", F.lit(0.0)) / F.col("d")).alias("r"))
    state = settle(state.withColumn("p", F.col("r")), "gradients")
    size = start = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    for _ in range(2 * terms):
        if size <= tolerance * tolerance * start:
            break
        along = state.select(F.col("i").alias("j"), (F.col("p") / F.col("d")).alias("p"))
        image = gram.join(along, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("p")).alias("g"))
        moved = state.join(image, "i", "left")
        moved = moved.withColumn("g", (F.coalesce("g", F.lit(0.0)) + ridge * F.col("p") / F.col("d")) / F.col("d"))
        moved = settle(moved, "gradients")
        steep = moved.agg(F.sum(F.col("p") * F.col("g"))).first()[0]
        if not steep > 0:
            break
        step = size / steep
        state = moved.select("i", "d", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("g")).alias("r"), "p")
        before, size = size, state.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        state = settle(state.withColumn("p", F.col("r") + size / before * F.col("p")), "gradients")
    return state.select("i", (F.col("x") / F.col("d")).alias("beta"))


def residual_target(df: DataFrame, target: str, fit: RidgeFit) -> DataFrame:
    """Covariates first: leave the residual to the forecaster."""
    return df.withColumn("xreg", fit.predict()).withColumn("residual", F.col(target) - F.col("xreg"))


def add_back(predictions: DataFrame, fit: RidgeFit, point: str, quantiles: list[str]) -> DataFrame:
    """Add the regression to the point forecast and every quantile."""
    return predictions.withColumns({c: F.col(c) + fit.predict() for c in [point, *quantiles]})


def xreg_on_residuals(history: DataFrame, future: DataFrame, target: str, forecast: str, numeric: list[str], categorical: dict[str, list[str]], ridge: float = 0.0) -> DataFrame:
    """Forecaster first: regress its residual on the covariates and correct
    its forecast of the future."""
    residual = history.withColumn("_res", F.col(target) - F.col(forecast))
    fit = xreg_ridge(residual, "_res", numeric, categorical, ridge)
    return future.withColumn("prediction", F.col(forecast) + fit.predict())


def align_models(forecasts: dict[str, DataFrame], on: list[str], value: str = "prediction") -> DataFrame:
    """Forecasts of several models side by side.

    One shuffle for all of them: union, then a pivot over the known names,
    instead of a chain of joins.
    """
    rows = None
    for name, df in forecasts.items():
        part = df.select(*on, F.lit(name).alias("_model"), F.col(value).alias("_value"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*on).agg(*[F.max(F.when(F.col("_model") == n, F.col("_value"))).alias(n) for n in forecasts])


def join_truth(truth: DataFrame, forecasts: DataFrame, on: list[str]) -> DataFrame:
    """Truth with forecasts; :func:`unmatched` counts truth left bare."""
    return truth.join(forecasts, on, "left")


def unmatched(joined: DataFrame, columns: list[str]) -> DataFrame:
    return joined.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def future_mismatch(expected: DataFrame, future: DataFrame, on: list[str]) -> DataFrame:
    """(id, ts) pairs in only one of the expected and given future rows."""
    left = expected.select(*on).withColumn("_e", F.lit(1))
    right = future.select(*on).withColumn("_f", F.lit(1))
    both = left.join(right, on, "full_outer")
    side = F.when(F.col("_e").isNull(), "unexpected").when(F.col("_f").isNull(), "missing")
    return both.withColumn("problem", side).filter("problem is not null").drop("_e", "_f")


def future_covariates(expected: DataFrame, future: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """One row per item: each covariate as an array over the predicted steps.

    ``expected`` has ``keys, horizon_step, ts`` (see ``windows.future_timestamps``),
    so an array is as long as the horizon. A step without a row in ``future``
    is null in the arrays; ``n_missing`` counts those and ``n_extra`` the rows
    of ``future`` at other times, both zero for a valid input.
    """
    rows = future.select(*keys, ts, F.struct(*columns).alias("_c"))
    met = expected.join(rows, [*keys, ts], "full_outer")
    one = F.when(F.col("horizon_step").isNotNull(), F.struct("horizon_step", "_c"))
    out = met.groupBy(*keys).agg(
        F.array_sort(F.collect_list(one)).alias("_r"),
        F.count_if(F.col("_c").isNull()).alias("n_missing"),
        F.count_if(F.col("horizon_step").isNull()).alias("n_extra"),
    )
    return out.select(*keys, *[_field("_r", c) for c in columns], "n_missing", "n_extra")


def _field(rows: str, name: str) -> Column:
    return F.transform(rows, lambda r: r["_c"][name]).alias(name)
