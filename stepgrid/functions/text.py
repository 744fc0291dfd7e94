"""Names, keys, cells and other text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(col: Column, rules: list[tuple[str, str]], how: str = "regex", default: Column | None = None) -> Column:
    """The value of the first rule that matches, in list order.

    ``how``: 'regex', 'contains' (case-blind) or 'prefix'.
    """
    out = None
    for pattern, value in rules:
        if how == "regex":
            test = col.rlike(pattern)
        elif how == "contains":
            test = F.lower(col).contains(pattern.lower())
        else:
            test = col.startswith(pattern)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default) if default is not None else out


def route_subject(subject: Column, rules: list[tuple[str, str]], strict: bool = False) -> Column:
    """Dataset of a subject id. Unknown ids become null, or fail if strict."""
    unknown = F.raise_error(F.concat(F.lit("unknown subject id "), subject)) if strict else F.lit(None)
    return first_match(subject, rules, default=unknown.cast("string"))


def normalize_dataset(dataset: Column, names: dict[str, str] | None = None) -> Column:
    """Trim, drop a leading ``12_`` style number, map known spellings."""
    bare = F.regexp_replace(F.trim(dataset), r"^\d+_", "")
    if not names:
        return bare
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[bare], bare)


def method_from_path(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Method name from a file path by the first contained token; else the
    file stem. List longer tokens before tokens they contain."""
    return first_match(path, rules, "contains", F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1))


def dataset_group(name: Column, prefixes: list[str]) -> Column:
    return first_match(name, [(p, p) for p in prefixes], "prefix", name)


def horizon_minutes(text: Column) -> Column:
    """``'30min'`` or ``30`` as an integer, null when there is none."""
    return F.regexp_extract(text.cast("string"), r"(\d+)", 1).try_cast("int")


def horizon_text(minutes: Column) -> Column:
    return F.concat(minutes.cast("int").cast("string"), F.lit("min"))


def mean_std_text(value: Column) -> Column:
    """Aggregate: ``'mean (std)'`` with the sample deviation; one value has
    deviation 0.00, none is an empty cell."""
    n = F.count(value)
    std = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return F.when(n == 0, "").otherwise(F.format_string("%.2f (%.2f)", F.avg(value), std))


def parse_mean_std(cell: Column) -> dict[str, Column]:
    pattern = r"^\s*(-?[\d.]+)\s*\(\s*([\d.]+)\s*\)\s*$"
    return {
        "mean": F.regexp_extract(cell, pattern, 1).try_cast("double"),
        "std": F.regexp_extract(cell, pattern, 2).try_cast("double"),
    }


def duration_text(seconds: Column) -> Column:
    return (
        F.when(seconds.isNull(), "-")
        .when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.format_string("%.1fm", seconds / 60.0))
        .otherwise(F.format_string("%.2fh", seconds / 3600.0))
    )


def p_value_text(p: Column) -> Column:
    return (
        F.when(p.isNull() | F.isnan(p), "NA")
        .when(p < 0.001, F.format_string("%.1e", p))
        .otherwise(F.format_string("%.3f", p))
    )


def significance_stars(q: Column) -> Column:
    return (
        F.when(q.isNull() | F.isnan(q), "NA")
        .when(q < 0.001, "***")
        .when(q < 0.01, "**")
        .when(q < 0.05, "*")
        .otherwise("ns")
    )


def number_or(text: Column, sentinel: str = "X", default: float | None = None) -> Column:
    """Number from text; the sentinel and bad text become ``default``."""
    value = F.nullif(F.trim(text), F.lit(sentinel)).try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))


def compose_key(*parts: Column, sep: str = "-") -> Column:
    return F.concat_ws(sep, *[p.cast("string") for p in parts])


def split_key(key: Column, names: list[str], sep: str = "-") -> dict[str, Column]:
    pieces = F.split(key, r"\Q" + sep + r"\E")
    return {n: F.get(pieces, i) for i, n in enumerate(names)}


def boolish(text: Column) -> Column:
    """Tolerant boolean: 1, true, t, yes, y; anything else is false."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("1", "true", "t", "yes", "y"), F.lit(False))


def dataset_choice(dataset: Column, kind: Column, choices: dict[str, str], default: str = "identity") -> Column:
    """What a dataset is assigned: by its name, else by its type, else the
    entry ``default``, else ``default`` itself."""
    table = F.create_map(*[F.lit(x) for pair in choices.items() for x in pair])
    return F.coalesce(F.try_element_at(table, dataset), F.try_element_at(table, kind), F.lit(choices.get("default", default)))


def at_horizon(minutes: Column | None, steps: Column | None, wanted: int, step_minutes: int) -> Column:
    """Whether a row is about one horizon, told in minutes or in steps."""
    by_minutes = minutes == wanted if minutes is not None else F.lit(None).cast("boolean")
    by_steps = steps * step_minutes == wanted if steps is not None else F.lit(None).cast("boolean")
    return F.coalesce(by_minutes, by_steps, F.lit(False))
