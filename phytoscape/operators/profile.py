"""Column profiles of loads, compiled into one shared aggregate scan of mergeable states.

``profile_states`` makes one state per load and column: counts, range, moments,
an HLL sketch of the values and a KLL sketch of their distribution. States of
parts of a load merge into the state of the load (``merge_states``), so a load
that grows is profiled from its new part alone. ``profile_metrics`` reads the
metrics from states, ``control_limits`` holds each metric against its history.

``value_states`` are the exact states beside them: counts per different value
of the checked columns, made in one scan, stored, and merged by adding
(``merge_value_states``). ``value_metrics`` reads exact metrics from them;
quantiles are found in two steps (bin of the rank, then rank within the bin),
so no load has to fit into one task. ``load_findings`` declares its checks as
limits on these metrics, some of them set by the load before.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phytoscape.session import materialise


@dataclass(frozen=True)
class Limits:
    """A numeric column, the limits of its valid values (included) and the width of the bins used to find ranks."""

    column: str
    low: float
    high: float
    bin: float


@dataclass(frozen=True)
class Checks:
    """Thresholds of the findings."""

    missing: float = 0.05
    out_of_range: float = 0.02
    shift_iqr: float = 0.55
    distinct: float = 0.5
    pattern: float = 0.03


def _present(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return F.col(name).isNotNull() & ~F.isnan(name) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(name).isNotNull()


def profile_states(df: DataFrame, by: list[str], columns: list[str] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """One mergeable state per load (``by``) and column; all columns in the same aggregation.

    An empty table gives no state. Columns that are all missing have NULL
    range and empty sketches. Columns of complex types are counted only.
    """
    patterns = patterns or {}
    columns = columns or [c for c in df.columns if c not in by]
    aggs = []
    for c in columns:
        kind, ok = df.schema[c].dataType, _present(df, c)
        simple = not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
        number = F.when(ok, F.col(c).cast("double")) if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
        text = F.when(ok, F.col(c).cast("string")) if simple else F.lit(None).cast("string")
        form = F.sum(F.when(ok & ~F.col(c).cast("string").rlike(f"^(?:{patterns[c]})$"), 1).otherwise(0)) if c in patterns else F.lit(None).cast("bigint")
        aggs.append(F.struct(
            F.lit(c).alias("column_name"), F.count("*").alias("n"), F.sum((~ok).cast("bigint")).alias("missing"), form.alias("off_form"),
            F.min(text if not isinstance(kind, T.NumericType) else F.lit(None).cast("string")).alias("low_text"), F.max(text if not isinstance(kind, T.NumericType) else F.lit(None).cast("string")).alias("high_text"),
            F.min(number).alias("low"), F.max(number).alias("high"), F.sum(number).alias("total"), F.sum(number * number).alias("squares"),
            F.hll_sketch_agg(F.coalesce(text, F.lit(None).cast("string"))).alias("distinct_sketch"), F.kll_sketch_agg_double(number).alias("value_sketch"),
        ).alias(f"_{len(aggs)}"))
    wide = df.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.explode(F.array(*[f"_{i}" for i in range(len(aggs))])).alias("s")).select(*by, "s.*")


def merge_states(states: DataFrame, by: list[str]) -> DataFrame:
    """States of parts merged into one state per load and column."""
    add = lambda c: F.sum(c).alias(c)
    return states.groupBy(*by, "column_name").agg(
        add("n"), add("missing"), add("off_form"), F.min("low_text").alias("low_text"), F.max("high_text").alias("high_text"), F.min("low").alias("low"), F.max("high").alias("high"),
        add("total"), add("squares"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"),
    )


def profile_metrics(states: DataFrame, by: list[str]) -> DataFrame:
    """Metrics of each state: shares, distinct values (HLL estimate), range, mean, deviation, quartiles (KLL estimates)."""
    seen = F.col("n") - F.col("missing")
    some = F.when(F.col("low").isNotNull(), F.col("value_sketch"))
    mean = F.try_divide("total", F.when(F.col("low").isNotNull(), seen))
    q = lambda p: F.when(F.col("low").isNotNull(), F.kll_sketch_get_quantile_double(some, F.lit(p)))
    return states.select(
        *by, "column_name", "n", "low", "high", F.try_divide("missing", "n").alias("missing_share"), F.hll_sketch_estimate("distinct_sketch").alias("distinct_values"),
        F.coalesce(F.col("low").cast("string"), "low_text").alias("lowest"), F.coalesce(F.col("high").cast("string"), "high_text").alias("highest"), F.try_divide("off_form", seen).alias("off_form_share"),
        mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.try_divide("squares", seen) - mean * mean)).alias("deviation"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"),
    )


#: Metrics that are held against their history.
METRICS = ("n", "missing_share", "distinct_values", "off_form_share", "mean", "deviation", "q1", "median", "q3", "low", "high")


def control_limits(metrics: DataFrame, series: str, order: str, names: tuple[str, ...] = METRICS, sigmas: float = 3.0, least: int = 3, jump: float = 0.5) -> DataFrame:
    """Metrics outside mean ± sigmas · deviation of all earlier loads of their series.

    With fewer than ``least`` earlier loads, but one, a metric is reported if it
    moved by more than ``jump`` of the load before; a first load has no history.
    Metrics that the table does not have, and missing values, are passed over.
    """
    past = Window.partitionBy(series, "column_name", "metric").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(series, "column_name", "metric").orderBy(order)
    names = [m for m in names if m in metrics.columns]
    long = metrics.select(series, order, "column_name", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("m")).select(series, order, "column_name", "m.*").where("value is not null")
    long = long.withColumn("history", F.count("*").over(past)).withColumn("centre", F.avg("value").over(past)).withColumn("spread", F.stddev_samp("value").over(past)).withColumn("_before", F.lag("value").over(before))
    far = F.abs(F.col("value") - F.col("centre")) > sigmas * F.greatest(F.col("spread"), F.lit(1e-9) + 0.001 * F.abs("centre"))
    moved = F.abs(F.col("value") - F.col("_before")) > jump * F.greatest(F.abs("_before"), F.lit(1e-9))
    return long.where(F.when(F.col("history") >= least, far).otherwise((F.col("history") > 0) & moved)).drop("_before")


def value_states(df: DataFrame, series: str, order: str, limits: list[Limits], pattern: tuple[str, str]) -> DataFrame:
    """Exact mergeable state: rows per (series, load, column, value); of the pattern column only whether a value is of the form. Rows without series or load number are left out."""
    name, form = pattern
    cells = []
    for m in limits:
        v = F.col(m.column).cast("double")
        cells.append(F.struct(F.lit(m.column).alias("c"), F.when(v.isNotNull() & ~F.isnan(v), v + 0.0).alias("v")))
    cells.append(F.struct(F.lit(name).alias("c"), F.when(F.col(name).isNotNull(), F.col(name).rlike(f"^(?:{form})\\z").cast("double")).alias("v")))
    rows = df.where(F.col(series).isNotNull() & F.col(order).isNotNull())
    return rows.select(F.col(series).alias("s"), F.col(order).cast("int").alias("o"), F.explode(F.array(*cells)).alias("x")).groupBy("s", "o", "x.c", "x.v").agg(F.count("*").alias("n"))


def merge_value_states(states: DataFrame) -> DataFrame:
    """States of parts (the union of their rows) merged into those of the loads."""
    return states.groupBy("s", "o", "c", "v").agg(F.sum("n").alias("n"))


def _quantiles(values: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """Exact quantiles (linear interpolation) per (s, o, c) of (s, o, c, v, n, bin) in two steps."""
    key = ["s", "o", "c"]
    bins = values.groupBy(*key, "bin").agg(F.sum("n").alias("m"))
    run = Window.partitionBy(*key).orderBy("bin")
    bins = bins.withColumn("upto", F.sum("m").over(run)).withColumn("all", F.sum("m").over(Window.partitionBy(*key)))
    ranks = []
    for p in shares:
        h = (F.col("all") - 1) * p
        ranks += [F.struct(F.lit(p).alias("p"), F.floor(h).alias("r"), (1 - (h - F.floor(h))).alias("w")), F.struct(F.lit(p).alias("p"), F.ceil(h).alias("r"), (h - F.floor(h)).alias("w"))]
    want = (
        bins.withColumn("k", F.explode(F.array(*ranks))).where((F.col("k.r") < F.col("upto")) & (F.col("k.r") >= F.col("upto") - F.col("m")))
        .groupBy(*key, "bin").agg(F.collect_list("k").alias("ks"), F.first(F.col("upto") - F.col("m")).alias("before"))
    )
    inner = Window.partitionBy(*key, "bin").orderBy("v")
    picked = (
        values.join(want, [*key, "bin"]).withColumn("top", F.sum("n").over(inner) + F.col("before"))
        .withColumn("k", F.explode(F.expr("filter(ks, k -> k.r < top and k.r >= top - n)")))
    )
    return picked.groupBy(*key).agg(*[F.sum(F.when(F.col("k.p") == p, F.col("k.w") * F.col("v"))).alias(f"q{round(p * 100)}") for p in shares])


def value_metrics(states: DataFrame, limits: list[Limits]) -> DataFrame:
    """Exact metrics per (s, o, c) of stored ``value_states``: rows, present, valid and different valid values, values of the form, quartiles of the valid ones."""
    pick = lambda f: reduce(lambda a, m: a.when(F.col("c") == m.column, f(m)), limits, F.when(F.lit(False), f(limits[0])))
    valid = pick(lambda m: F.col("v").between(float(m.low), float(m.high))) & F.col("v").isNotNull()
    states = states.withColumn("ok", F.coalesce(valid, F.lit(False)))
    summary = states.groupBy("s", "o", "c").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("present"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("valid"),
        F.sum(F.col("ok").cast("bigint")).alias("different"), F.sum(F.when(F.col("v") == 1.0, F.col("n")).otherwise(0)).alias("formed"),
    )
    binned = states.where("ok").withColumn("bin", F.floor(F.col("v") / pick(lambda m: F.lit(float(m.bin)))))
    return summary.join(_quantiles(binned, (0.25, 0.5, 0.75)), ["s", "o", "c"], "left")


def limit_tests(checks: Checks, pattern: str) -> dict[str, Column]:
    """The declared checks: each a limit on a metric of a load, or on its change against the load before (``b_`` metrics)."""
    has = (F.col("b_o") == F.col("o") - 1) & (F.col("c") != pattern)
    share = lambda p: F.try_divide(F.col(f"{p}n") - F.col(f"{p}present"), F.col(f"{p}n"))
    return {
        "missing": has & (share("") - share("b_") > checks.missing),
        "range": (F.col("c") != pattern) & (F.col("present") - F.col("valid") > checks.out_of_range * F.col("present")),
        "shift": has & (F.abs(F.col("q50") - F.col("b_q50")) > checks.shift_iqr * (F.col("b_q75") - F.col("b_q25"))),
        "distinct": has & (F.col("different") < checks.distinct * F.col("b_different")),
        "pattern": (F.col("c") == pattern) & (F.col("present") - F.col("formed") > checks.pattern * F.col("present")),
    }


def findings_of(metrics: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """(s, o, c, finding) of ``value_metrics`` that break a test, with the metrics of the load before beside each load."""
    past = Window.partitionBy("s", "c").orderBy("o")
    now = metrics.select("*", *[F.lag(m).over(past).alias(f"b_{m}") for m in ("o", "n", "present", "different", "q25", "q50", "q75")])
    broken = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]), lambda f: f.isNotNull())
    return now.select("s", "o", "c", F.explode(broken).alias("finding"))


def load_findings(df: DataFrame, series: str, order: str, limits: list[Limits], pattern: tuple[str, str], checks: Checks = Checks(), stored: DataFrame | None = None) -> DataFrame:
    """Findings (series, load, column_name, finding) of loads out of order.

    missing, shift and distinct compare with the load before (order − 1 of the
    same series), if there is one; range and pattern need none. All rows count,
    repeated ones too; NULL and NaN are missing; rows without series or load
    number are left out. Loads without valid values have no shift; a load
    before without spread (interquartile range 0) makes any change of the
    median a shift. The table is scanned once into states, which are stored;
    ``stored`` states of earlier parts are merged with them, so only new rows
    have to be read.
    """
    states = value_states(df, series, order, limits, pattern)
    states = materialise(states if stored is None else merge_value_states(stored.unionByName(states)))
    found = findings_of(value_metrics(states, limits), limit_tests(checks, pattern[0]))
    return found.select(F.col("s").alias(series), F.col("o").alias(order), F.col("c").alias("column_name"), "finding")
