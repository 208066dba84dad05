"""Predictive models over pyspark.ml: habitat suitability, identification, biomass."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _features(features: list[str]) -> list:
    filled = [f"_{f}" for f in features]
    return [Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]


def _split(df: DataFrame, key: str, test: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """By hash of the key, so the split does not hang on the order or number of partitions."""
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000)) / 10_000
    return df.where(u >= test), df.where(u < test)


def _numeric(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features})


def classify(df: DataFrame, key: str, target: str, features: list[str], model: str = "rf") -> tuple[object, DataFrame]:
    """(fitted pipeline, one row of accuracy and F1 on the held-out part). Rows without target are left out, missing features are the column's mean."""
    make = {"rf": lambda: RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=50, seed=42), "logistic": lambda: LogisticRegression(labelCol="label", featuresCol="features", maxIter=50)}
    if model not in make:
        raise ValueError(f"Unknown model: {model}")
    train, held = _split(_numeric(df.where(F.col(target).isNotNull()), features), key)
    fitted = Pipeline(stages=[StringIndexer(inputCol=target, outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc"), *_features(features), make[model]()]).fit(train)
    p = fitted.transform(held)
    score = {m: MulticlassClassificationEvaluator(labelCol="label", metricName=m).evaluate(p) for m in ("accuracy", "f1")}
    return fitted, df.sparkSession.createDataFrame([(model, score["accuracy"], score["f1"])], "model string, accuracy double, f1 double")


def suitability(df: DataFrame, key: str, presence: str, features: list[str], model: str = "logistic") -> tuple[object, DataFrame]:
    """(fitted pipeline, one row with the area under the curve) for a 0/1 target. maxent is the logistic model under another name."""
    model = {"maxent": "logistic", "glm": "logistic"}.get(model, model)
    fitted, _ = classify(df.withColumn("_p", F.col(presence).cast("int").cast("string")), key, "_p", features, model)
    held = fitted.transform(_split(_numeric(df.withColumn("_p", F.col(presence).cast("int").cast("string")), features), key)[1])
    auc = BinaryClassificationEvaluator(labelCol="label").evaluate(held)
    return fitted, df.sparkSession.createDataFrame([(model, auc)], "model string, auc double")


def regress(df: DataFrame, key: str, target: str, features: list[str], model: str = "rf") -> tuple[object, DataFrame]:
    """(fitted pipeline, one row of rmse, mae, r2 on the held-out part)."""
    make = {"rf": lambda: RandomForestRegressor(labelCol=target, featuresCol="features", numTrees=50, seed=42), "gbm": lambda: GBTRegressor(labelCol=target, featuresCol="features", seed=42), "ridge": lambda: LinearRegression(labelCol=target, featuresCol="features", regParam=0.1)}
    train, held = _split(_numeric(df, [*features, target]).where(F.col(target).isNotNull()), key)
    fitted = Pipeline(stages=[*_features(features), make[model]()]).fit(train)
    p = fitted.transform(held)
    s = [RegressionEvaluator(labelCol=target, metricName=m).evaluate(p) for m in ("rmse", "mae", "r2")]
    return fitted, df.sparkSession.createDataFrame([(model, *s)], "model string, rmse double, mae double, r2 double")


def confusion(predicted: DataFrame, target: str) -> DataFrame:
    """(actual, predicted, records) with margins named ``all``, of rows with the columns ``target`` and ``predicted``."""
    return predicted.cube(F.col(target).cast("string").alias("actual"), F.col("predicted").cast("string").alias("predicted")).agg(F.count("*").alias("records")).select(F.coalesce("actual", F.lit("all")).alias("actual"), F.coalesce("predicted", F.lit("all")).alias("predicted"), "records")


def predict_labels(fitted, df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """The table with ``predicted``, the class a pipeline of ``classify`` gives each row."""
    labels = fitted.stages[0].labels
    rows = _numeric(df, features).withColumn("_target", F.col(target)).withColumn(target, F.lit(labels[0]))
    out = fitted.transform(rows).withColumn("predicted", F.get(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int")))
    return out.withColumn(target, F.col("_target")).select(*df.columns, "predicted")


def cross_validated(df: DataFrame, key: str, target: str, features: list[str], model: str = "rf", folds: int = 5) -> DataFrame:
    """(fold, records, accuracy): each fold (by hash of the key) predicted by a model of the others."""
    make = {"rf": lambda: RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=50, seed=42), "logistic": lambda: LogisticRegression(labelCol="label", featuresCol="features", maxIter=50)}
    if model not in make:
        raise ValueError(f"Unknown model: {model}")
    rows = _numeric(df.where(F.col(target).isNotNull()), features).withColumn("_fold", F.pmod(F.xxhash64(F.lit(7), key), F.lit(folds)))
    out = None
    for f in range(folds):
        fitted = Pipeline(stages=[StringIndexer(inputCol=target, outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc"), *_features(features), make[model]()]).fit(rows.where(F.col("_fold") != f))
        r = fitted.transform(rows.where(F.col("_fold") == f)).agg(F.lit(f).alias("fold"), F.count("*").alias("records"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
        out = r if out is None else out.union(r)
    return out


def importances(fitted, features: list[str]) -> list[tuple[str, float]]:
    """(feature, importance) of a fitted pipeline: of its trees, else absolute coefficients over their sum."""
    last = fitted.stages[-1]
    if hasattr(last, "featureImportances"):
        v = last.featureImportances.toArray()
    else:
        v = abs(last.coefficientMatrix.toArray()).sum(0) if hasattr(last, "coefficientMatrix") else abs(last.coefficients.toArray())
        v = v / (v.sum() or 1.0)
    return sorted(zip(features, map(float, v)), key=lambda p: (-p[1], p[0]))


def tuned(df: DataFrame, key: str, target: str, features: list[str], trees: tuple[int, ...] = (50, 100, 200), depths: tuple[int, ...] = (5, 10, 15), folds: int = 5) -> DataFrame:
    """(trees, depth, accuracy, best) of random forests over a grid, by mean accuracy over folds; the best is the first of the greatest."""
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = _numeric(df.where(F.col(target).isNotNull()), features).withColumn("_fold", F.pmod(F.xxhash64(F.lit(7), key), F.lit(folds)).cast("int"))
    rf = RandomForestClassifier(labelCol="label", featuresCol="features", seed=42)
    grid = ParamGridBuilder().addGrid(rf.numTrees, list(trees)).addGrid(rf.maxDepth, list(depths)).build()
    pipe = Pipeline(stages=[StringIndexer(inputCol=target, outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc"), *_features(features), rf])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy"), numFolds=folds, foldCol="_fold", parallelism=2)
    scores = cv.fit(rows).avgMetrics
    top = max(range(len(scores)), key=lambda i: (scores[i], -i))
    return df.sparkSession.createDataFrame([(int(g[rf.numTrees]), int(g[rf.maxDepth]), float(v), i == top) for i, (g, v) in enumerate(zip(grid, scores))], "trees int, depth int, accuracy double, best boolean")


def permutation_importance(fitted, df: DataFrame, key: str, target: str, features: list[str]) -> DataFrame:
    """(feature, drop): accuracy lost when a feature's values are handed on to the row of the next hash."""
    from pyspark.sql import Window

    def accuracy(rows: DataFrame) -> float:
        p = predict_labels(fitted, rows, target, features)
        return p.agg(F.avg((F.col("predicted") == F.col(target).cast("string")).cast("double"))).first()[0] or 0.0

    rows = _numeric(df.where(F.col(target).isNotNull()), features).withColumn("_b", F.pmod(F.xxhash64(key), F.lit(64)))
    base, out = accuracy(rows), []
    for f in features:  # within 64 buckets of rows by hash, so no task sees them all
        w = Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(f), key))
        out.append((f, float(base - accuracy(rows.withColumn(f, F.coalesce(F.lag(f).over(w), f))))))
    return df.sparkSession.createDataFrame(out, "feature string, drop double")


def isolation_forest(df: DataFrame, key: str, features: list[str], trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """(key, score, anomaly): isolation scores of all rows and whether they belong to the ``contamination`` share of greatest ones (ties included).

    Each tree is grown from ``sample`` rows, as the method is defined, all of
    them from one bounded sample by hash; every row is scored in the tasks.
    Missing values count as the column's mean; rows without key are left out.
    """
    import numpy as np
    import pandas as pd

    ok = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    mean = df.agg(*[F.avg(ok[f]).alias(f) for f in features]).first()
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[F.coalesce(ok[f], F.lit(float(mean[f] or 0.0))).alias(f"f{i}") for i, f in enumerate(features)])
    most = trees * sample
    n = rows.count()
    kind = rows.schema["key"].dataType.simpleString()
    if n == 0:
        return df.sparkSession.createDataFrame([], f"key {kind}, score double, anomaly boolean")
    share = min(1.0, 1.2 * most / n)
    few = rows.where(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).orderBy(F.xxhash64(F.lit(seed), "key")).limit(most).drop("key").toPandas().to_numpy(float)
    rng, size = np.random.default_rng(seed), min(sample, len(few))
    depth = int(np.ceil(np.log2(max(2, size))))
    path = lambda m: 2 * (np.log(np.maximum(m - 1, 1)) + 0.5772156649015329) - 2 * (m - 1) / np.maximum(m, 1) if m > 2 else float(m == 2)

    def grow(x, level):
        spread = np.ptp(x, axis=0) if len(x) else np.zeros(x.shape[1])
        if level >= depth or len(x) <= 1 or not spread.any():
            return level + path(len(x))
        f = int(rng.choice(np.flatnonzero(spread)))
        cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
        return f, cut, grow(x[x[:, f] < cut], level + 1), grow(x[x[:, f] >= cut], level + 1)

    forest = [grow(few[rng.choice(len(few), size, replace=False)], 0) for _ in range(trees)]
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def score(batches):
        def walk(node, x, at, out):
            if not isinstance(node, tuple):
                out[at] += node
                return
            f, cut, left, right = node
            low = x[at, f] < cut
            for child, part in ((left, at[low]), (right, at[~low])):
                if len(part):
                    walk(child, x, part, out)

        for b in batches:
            x, total = b.drop(columns="key").to_numpy(float), np.zeros(len(b))
            for t in shared.value:
                walk(t, x, np.arange(len(x)), total)
            yield pd.DataFrame({"key": b["key"], "score": 2 ** (-total / len(shared.value) / max(path(size), 1e-9))})

    from phytoscape.session import materialise

    scored = materialise(rows.mapInPandas(score, f"key {kind}, score double"))
    cut = scored.agg(F.percentile("score", 1 - contamination)).first()[0]
    return scored.withColumn("anomaly", F.col("score") >= cut)


def reduce_dimensions(df: DataFrame, key: str, features: list[str], components: int = 2) -> DataFrame:
    """(key, pc1, pc2, ...): principal axes of z-scored features, missing values as means; axes point to their greatest loading."""
    import numpy as np

    ok = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    rows = df.where(F.col(key).isNotNull())
    st = rows.agg(*[F.avg(ok[f]).alias(f"m_{f}") for f in features], *[F.count(ok[f]).alias(f"k_{f}") for f in features], *[(F.var_pop(ok[f]) * F.count(ok[f])).alias(f"v_{f}") for f in features], F.count("*").alias("n")).first()
    z = rows.select(F.col(key).alias("key"), *[((F.coalesce(ok[f], F.lit(st[f"m_{f}"] or 0.0)) - (st[f"m_{f}"] or 0.0)) / (((st[f"v_{f}"] or 0.0) / max(1, st["n"])) ** 0.5 or 1.0)).alias(f) for f in features])
    k = len(features)
    s = z.agg(*[F.avg(F.col(features[i]) * F.col(features[j])).alias(f"{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    m = np.array([[s[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    lam, vec = np.linalg.eigh(m)
    vec = vec[:, np.argsort(-lam)[:components]]
    vec = vec * np.where(vec[np.abs(vec).argmax(0), np.arange(vec.shape[1])] < 0, -1, 1)
    return z.select("key", *[sum((F.col(f) * float(vec[i, c]) for i, f in enumerate(features)), F.lit(0.0)).alias(f"pc{c + 1}") for c in range(vec.shape[1])])


def community_classes(com: DataFrame, clusters: int = 4) -> tuple[DataFrame, DataFrame]:
    """(site, cluster) by k-means of ln(x + 1) z-scores, and per cluster its sites, the mean richness and the five species of greatest total (ties: name)."""
    from pyspark.sql import Window

    from phytoscape.community import dense
    from phytoscape.operators.clustering import as_vectors, kmeans

    w = Window.partitionBy("species")
    z = dense(com).withColumn("v", F.log1p("abundance")).withColumn("value", (F.col("v") - F.avg("v").over(w)) / F.when(F.stddev_pop("v").over(w) > 0, F.stddev_pop("v").over(w)).otherwise(1.0))
    labels = kmeans(as_vectors(z), clusters)[0]
    own = com.join(labels, "site")
    top = own.groupBy("cluster", "species").agg(F.sum("abundance").alias("t")).withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("t"), "species"))).where("r <= 5")
    names = top.groupBy("cluster").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("r", "species"))), lambda x: x["species"])).alias("dominant"))
    rich = own.groupBy("cluster", "site").agg(F.count("*").alias("s"), F.sum("abundance").alias("n")).groupBy("cluster").agg(F.count("*").alias("sites"), F.avg("s").alias("mean_richness"), F.sum("n").alias("total_abundance"))
    return labels, rich.join(names, "cluster")


def species_distribution(presence: DataFrame, env: DataFrame, on: list[str], species: str, variables: list[str], models: tuple[str, ...] = ("logistic", "rf")) -> tuple[object, DataFrame]:
    """(best pipeline, (model, accuracy, f1) of all): presence (0/1 column ``species``) by environmental variables at the same coordinates, compared on a held-out part; the best by accuracy."""
    rows = presence.join(env, on).withColumn("_key", F.xxhash64(*on)).withColumn("_p", F.col(species).cast("int").cast("string"))
    fits = {m: classify(rows, "_key", "_p", variables, m) for m in models}
    scores = None
    for _, s in fits.values():
        scores = s if scores is None else scores.union(s)
    best = scores.orderBy(F.desc("accuracy"), "model").first()["model"]
    return fits[best][0], scores


def climate_projection(current: DataFrame, future: DataFrame, key: str, presence: str, variables: list[str]) -> DataFrame:
    """One row: mean suitability now and under the future values, their difference, and rows of each; by a random forest of the current rows."""
    from pyspark.ml.functions import vector_to_array

    fitted, _ = classify(current.withColumn("_p", F.col(presence).cast("int").cast("string")), key, "_p", variables, "rf")
    labels = fitted.stages[0].labels
    one = labels.index("1") if "1" in labels else None

    def mean(df: DataFrame) -> DataFrame:
        p = fitted.transform(_numeric(df, variables).withColumn("_p", F.lit(labels[0])))
        return p.agg(F.avg(vector_to_array("probability")[one] if one is not None else F.lit(0.0)).alias("m"), F.count("*").alias("n"))

    return mean(current).toDF("current", "current_rows").join(mean(future).toDF("future", "future_rows")).select("current", "future", (F.col("future") - F.col("current")).alias("change"), "current_rows", "future_rows")
