"""Classification, regression and clustering of rows by Spark's own learners, and regression that varies over a grid."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.kernels import distance_kernel
from cellweave.operators.focal import offsets

CLASSIFIERS = {"logistic": LogisticRegression, "tree": DecisionTreeClassifier, "forest": RandomForestClassifier, "bayes": NaiveBayes}
REGRESSORS = {"linear": LinearRegression, "forest": RandomForestRegressor}


def train_classifier(df: DataFrame, label: str, features: Sequence[str], method: str = "forest", seed: int = 1, **options) -> PipelineModel:
    """A fitted pipeline from rows without nulls; labels of any type are indexed by their text."""
    ok = df.dropna(subset=[label, *features]).withColumn("_label", F.col(label).cast("string"))
    extra = {"seed": seed} if method in ("tree", "forest") else {}
    learner = CLASSIFIERS[method](featuresCol="_features", labelCol="_index", predictionCol="_prediction", **extra, **options)
    steps = [StringIndexer(inputCol="_label", outputCol="_index", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=list(features), outputCol="_features"), learner]
    return Pipeline(stages=steps).fit(ok)


def classify(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``predicted``, null where a feature is null."""
    names = model.stages[0].labels
    features = model.stages[1].getInputCols()
    ok = df.dropna(subset=features)
    scored = model.stages[2].transform(model.stages[1].transform(ok))
    known = scored.select(*df.columns, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_prediction").cast("int") + 1).alias("predicted"))
    missing = F.lit(False)
    for c in features:
        missing = missing | F.col(c).isNull()
    return known.unionByName(df.where(missing).withColumn("predicted", F.lit(None).cast("string")))


def train_regressor(df: DataFrame, target: str, features: Sequence[str], method: str = "linear", **options) -> PipelineModel:
    """A fitted pipeline from rows without nulls."""
    learner = REGRESSORS[method](featuresCol="_features", labelCol=target, predictionCol="predicted", **options)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), learner]).fit(df.dropna(subset=[target, *features]))


def fold_scores(df: DataFrame, label: str, features: Sequence[str], key: str, folds: int = 3, method: str = "forest", **options) -> DataFrame:
    """Accuracy on each fold by a model of the others; folds come from a hash of ``key``."""
    split = df.withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    out = None
    for k in range(folds):
        got = classify(train_classifier(split.where(F.col("_fold") != k), label, features, method, **options), split.where(F.col("_fold") == k))
        row = got.agg(F.avg((F.col("predicted") == F.col(label).cast("string")).cast("int")).alias("accuracy")).select(F.lit(k).alias("fold"), "accuracy")
        out = row if out is None else out.unionByName(row)
    return out


def cluster(df: DataFrame, features: Sequence[str], k: int, seed: int = 1, scale: bool = True) -> DataFrame:
    """Adds the number of each row's cluster; rows with a null feature are left out."""
    ok = df.dropna(subset=list(features))
    steps = [VectorAssembler(inputCols=list(features), outputCol="_raw")]
    if scale:
        steps.append(StandardScaler(inputCol="_raw", outputCol="_features", withMean=True))
    steps.append(KMeans(k=k, seed=seed, featuresCol="_features" if scale else "_raw", predictionCol="cluster"))
    return Pipeline(stages=steps).fit(ok).transform(ok).select(*df.columns, "cluster")


def varying_regression(cells: DataFrame, xs: Sequence[str], y: str, bandwidth: int, kernel: str = "epanechnikov") -> DataFrame:
    """At each cell a regression of its neighbours within ``bandwidth``, weighted by a kernel of their distance.

    Each cell's products are dealt to the cells that it serves and summed there; the sums, a few numbers per cell, are then solved
    in batches. Cells whose neighbours don't determine a fit get nulls.
    """
    names = ["1", *xs]
    value = {"1": F.lit(1.0)} | {x: F.col(x).cast("double") for x in xs}
    n = len(names)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    deal = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(float(i * i + j * j)).alias("d2")) for i, j in offsets(bandwidth, True)]))
    ok = cells.dropna(subset=[*xs, y])
    dealt = ok.select("x", "y", *xs, y, deal.alias("m")).withColumn("w", distance_kernel(F.col("m.d2"), bandwidth, kernel))
    sums = dealt.groupBy((F.col("x") - F.col("m.dx")).alias("x"), (F.col("y") - F.col("m.dy")).alias("y")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("w") * value[names[i]] * value[names[j]]).alias(f"_a{i}_{j}") for i, j in pairs], *[F.sum(F.col("w") * value[names[i]] * F.col(y)).alias(f"_b{i}") for i in range(n)]
    ).join(cells.select("x", "y"), ["x", "y"], "left_semi")
    kinds = f"x {dict(sums.dtypes)['x']}, y {dict(sums.dtypes)['y']}, n long, intercept double" + "".join(f", b_{x} double" for x in xs)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            a = np.zeros((len(part), n, n))
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = part[f"_a{i}_{j}"]
            rhs = part[[f"_b{i}" for i in range(n)]].to_numpy()
            scale = np.sqrt(np.maximum(np.einsum("kii->ki", a), 1e-300))
            norm = a / scale[:, :, None] / scale[:, None, :]
            good = (np.linalg.matrix_rank(norm, tol=1e-9) == n) & (part["n"].to_numpy() > n) if len(part) else np.zeros(0, bool)
            b = np.full((len(part), n), np.nan)
            if good.any():
                b[good] = np.linalg.solve(norm[good], (rhs / scale)[good][:, :, None])[:, :, 0] / scale[good]
            out = part[["x", "y", "n"]].copy()
            for i, c in enumerate(["intercept", *[f"b_{x}" for x in xs]]):
                out[c] = pd.Series(b[:, i], index=part.index).astype(object).where(good, None)
            yield out

    return sums.mapInPandas(solve, kinds)
