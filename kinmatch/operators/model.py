"""Models over pair features with pyspark.ml: fit, score, blend, calibrate."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = -1.0


def fold(key: Column, folds: int = 5) -> Column:
    """Fold of an entry: all of its pairs are in one."""
    return F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")


def id_fold(key: Column, folds: int = 5, factor: int = 7919, seed: int = 0) -> Column:
    """Fold by arithmetic on the number in the id, the same in any engine."""
    return ((F.regexp_extract(key, "([0-9]+)$", 1).cast("bigint") * factor + seed) % folds).cast("int")


def prepared(features: DataFrame, columns: list[str]) -> DataFrame:
    """Features as doubles; a missing value is a value of its own below all others."""
    return features.select(*[c for c in features.columns if c not in columns], *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(MISSING)), F.lit(MISSING)).alias(c) for c in columns])


def fit(features: DataFrame, columns: list[str], kind: str = "gbt", seed: int = 1, valid: str | None = None, **how) -> PipelineModel:
    """Boosted trees, stopped early on the rows where `valid` is true, or a forest."""
    if kind == "gbt":
        model = GBTClassifier(labelCol="label", featuresCol="x", seed=seed, **{"maxIter": 20, "maxDepth": 5, **how})
        if valid:
            model = model.setValidationIndicatorCol(valid)
    else:
        model = RandomForestClassifier(labelCol="label", featuresCol="x", seed=seed, **{"numTrees": 20, "maxDepth": 6, **how})
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x"), model]).fit(prepared(features, columns))


def score(model: PipelineModel, features: DataFrame, columns: list[str], name: str = "p") -> DataFrame:
    """The keys and label of features plus the probability."""
    out = model.transform(prepared(features, columns))
    return out.select(*[c for c in features.columns if c not in columns], vector_to_array("probability")[1].alias(name))


def gain(model: PipelineModel, columns: list[str]) -> list[tuple[str, float]]:
    """Features by importance."""
    return sorted(zip(columns, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))


def out_of_fold(features: DataFrame, columns: list[str], folds: int = 5, kind: str = "gbt", **how) -> DataFrame:
    """Each entry's pairs scored by the model of the other folds.  One fit a fold, a fixed few."""
    f = features.withColumn("fold", fold(F.col("s1"), folds))
    parts = [score(fit(f.filter(F.col("fold") != i), columns, kind, **how), f.filter(F.col("fold") == i), columns) for i in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def blend(scored: DataFrame, alphas: list[float]) -> DataFrame:
    """alpha and the blended p of two scores p_a, p_b, for every alpha."""
    return scored.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas)))).withColumn("p", F.round(F.col("alpha") * F.col("p_a") + (1 - F.col("alpha")) * F.col("p_b"), 9))


def two_step(first: PipelineModel, second: PipelineModel, features: DataFrame, columns: list[str], alpha: float, stop: float) -> DataFrame:
    """Blend of both models; pairs that the first puts below `stop` are not shown to the second."""
    a = score(first, features, columns, "p_a")
    keys = ["q", "s1"]
    go = features.join(a.filter(F.col("p_a") >= stop).select(*keys), keys, "left_semi")
    b = score(second, go, columns, "p_b").select(*keys, "p_b")
    return a.join(b, keys, "left").withColumn("p", F.when(F.col("p_b").isNull(), alpha * F.col("p_a")).otherwise(alpha * F.col("p_a") + (1 - alpha) * F.col("p_b")))


def calibrate(scored: DataFrame) -> IsotonicRegressionModel:
    return IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(scored.select(F.col("p").cast("double"), F.col("label").cast("double")))


def calibrated(model: IsotonicRegressionModel, scored: DataFrame, clip: float = 1e-5) -> DataFrame:
    out = model.transform(scored)
    return out.withColumn("calibrated", F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col("calibrated"))))
