"""Alpha and beta diversity. All per-site indices come from one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def log_factorial(n: Column) -> Column:
    """ln n! of whole numbers, by Stirling's series at n + 9 less eight logarithms; right to 12 digits, of constant cost."""
    z = F.greatest(n.cast("double"), F.lit(0.0)) + 1
    y = z + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return F.when(n > 1, series - sum((F.log(z + i) for i in range(8)), F.lit(0.0))).otherwise(0.0)


def moments(com: DataFrame, rare: float = 10.0) -> DataFrame:
    """One row of sums per site from which all closed-form indices follow."""
    x = C("abundance")
    k = F.floor(x)
    return com.groupBy("site").agg(
        F.sum(x).alias("n"), F.count("*").alias("s"), F.sum(x * x).alias("q"), F.sum(x * F.log(x)).alias("l"), F.max(x).alias("m"),
        F.count_if(x == 1).alias("f1"), F.count_if(x == 2).alias("f2"), F.count_if(x <= rare).alias("s_rare"), F.sum(F.when(x <= rare, x).otherwise(0.0)).alias("n_rare"),
        F.sum(k).alias("k"), F.sum(log_factorial(k)).alias("lf"),
    )


def _fisher(s: Column, n: Column) -> Column:
    """Fixed point of alpha = S / ln(1 + N / alpha) from S, at most 100 steps, the value before the last step that moves less than 1e-6."""
    step = lambda st: s / F.log(1 + n / st["a"])
    fold = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.struct(s.cast("double").alias("a"), F.lit(False).alias("done")),
        lambda st, _: F.when(st["done"], st).otherwise(F.struct(F.when(F.abs(step(st) - st["a"]) < 1e-6, st["a"]).otherwise(step(st)).alias("a"), (F.abs(step(st) - st["a"]) < 1e-6).alias("done"))),
    )
    return F.when(s > 1, fold["a"]).otherwise(0.0)


def index_columns() -> dict[str, Column]:
    """The indices as columns over a row of ``moments``."""
    n, s, q, m, f1, f2 = C("n"), C("s"), C("q"), C("m"), C("f1"), C("f2")
    h = F.greatest(F.log(n) - C("l") / n, F.lit(0.0))
    u = F.sqrt(q)
    cover = 1 - F.try_divide(f1, C("n_rare"))
    gamma = F.when(C("n_rare") > 1, F.greatest(F.lit(0.0), F.try_divide(F.try_divide(C("s_rare"), cover), C("n_rare") - 1) - 1)).otherwise(0.0)
    ace = F.when(C("s_rare") == 0, s - C("s_rare")).when(C("n_rare") == f1, s).otherwise(s - C("s_rare") + F.try_divide(C("s_rare"), cover) + F.try_divide(f1, cover) * gamma)
    kf = log_factorial(C("k"))
    return {
        "shannon": h, "simpson": q / (n * n), "simpson_inverse": n * n / q, "richness": s, "evenness": F.when(s > 1, h / F.log(s)).otherwise(0.0),
        "fisher_alpha": _fisher(s, n), "berger_parker": m / n, "mcintosh": F.when(F.abs(n - u) < 1e-12, 0.0).otherwise(F.try_divide(n - u, n - F.sqrt(n))),
        "brillouin": F.when(C("k") > 0, (kf - C("lf")) / C("k")), "menhinick": s / F.sqrt(n), "margalef": F.when((n > 0) & (n != 1), (s - 1) / F.log(n)).otherwise(0.0),
        "chao1": F.when(f2 == 0, s + f1 * (f1 - 1) / 2.0).otherwise(s + F.try_divide(f1 * f1, 2.0 * f2)), "ace": ace.cast("double"),
    }


#: What a site without individuals has.
EMPTY = {"simpson_inverse": None, "brillouin": 0.0}


def indices(com: DataFrame, names: list[str] | None = None, sites: DataFrame | None = None) -> DataFrame:
    """Per site the named indices (default all) in one shuffle; with ``sites`` also those without individuals (0; simpson_inverse NULL)."""
    every = index_columns()
    unknown = set(names or ()) - set(every)
    if unknown:
        raise ValueError(f"Unknown diversity index: {', '.join(sorted(unknown))}")
    names = names or list(every)
    out = moments(com).select("site", *[every[k].alias(k) for k in names])
    if sites is not None:
        out = sites.join(out, "site", "left").select("site", *[F.coalesce(C(k), F.lit(EMPTY.get(k, 0.0))) if EMPTY.get(k, 0.0) is not None else C(k) for k in names]).toDF("site", *names)
    return out


def hill_numbers(com: DataFrame, orders: tuple[float, ...] = (0, 1, 2)) -> DataFrame:
    """(site, q, hill): order 0 is the richness, 1 the exponential of Shannon's index."""
    p = com.withColumn("p", C("abundance") / F.sum("abundance").over(Window.partitionBy("site")))
    sums = p.groupBy("site").agg(*[(F.count("*").cast("double") if q == 0 else F.exp(-F.sum(C("p") * F.log("p"))) if q == 1 else F.pow(F.sum(F.pow("p", F.lit(float(q)))), F.lit(1 / (1 - q)))).alias(f"h{i}") for i, q in enumerate(orders)])
    return sums.select("site", F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), C(f"h{i}").alias("hill")) for i, q in enumerate(orders)])).alias("h")).select("site", "h.*")


def jackknife(com: DataFrame) -> DataFrame:
    """One row: observed species, first- and second-order jackknife over the sites."""
    occ = com.groupBy("species").agg(F.count("*").alias("k")).agg(F.count("*").alias("s"), F.count_if(C("k") == 1).alias("q1"), F.count_if(C("k") == 2).alias("q2"))
    r = occ.join(com.agg(F.countDistinct("site").alias("n")))
    s, q1, q2, n = C("s"), C("q1"), C("q2"), C("n")
    one = F.when(n < 2, s.cast("double")).otherwise(s + q1 * F.try_divide(n - 1, n))
    return r.select(s.alias("observed"), one.alias("jackknife1"), F.when(n < 3, one).otherwise(s + F.try_divide(q1 * (2 * n - 3), n) - F.try_divide(q2 * (n - 2) * (n - 2), n * (n - 1))).alias("jackknife2"))


def whittaker(com: DataFrame) -> DataFrame:
    """One row: gamma richness over mean alpha richness."""
    return com.groupBy("site").agg(F.count("*").alias("s")).agg(F.avg("s").alias("alpha")).join(com.agg(F.countDistinct("species").alias("gamma"))).select(F.try_divide("gamma", "alpha").alias("whittaker_beta"))


def rarefaction(com: DataFrame, points: int = 50) -> DataFrame:
    """(site, sample_size, expected_species): sizes 1, 1 + step, ... with step = max(1, greatest total // points), as far as the site's total."""
    whole = com.withColumn("x", F.floor("abundance")).where("x > 0")
    whole = whole.withColumn("n", F.sum("x").over(Window.partitionBy("site")))
    top = com.groupBy("site").agg(F.sum("abundance").alias("t")).agg(F.max("t").alias("top")).first()["top"]
    if top is None:
        return com.select("site", F.lit(1).alias("sample_size"), F.lit(0.0).alias("expected_species")).limit(0)
    step = max(1, int(top) // points)
    lf = log_factorial
    e = whole.where("n >= 1").withColumn("sample_size", F.explode(F.sequence(F.lit(1).cast("bigint"), C("n"), F.lit(step).cast("bigint"))))
    miss = F.when(C("sample_size") > C("n") - C("x"), 0.0).otherwise(F.exp(lf(C("n") - C("x")) - lf(C("n") - C("x") - C("sample_size")) - lf(C("n")) + lf(C("n") - C("sample_size"))))
    return e.groupBy("site", "sample_size").agg(F.sum(1 - miss).alias("expected_species"))
