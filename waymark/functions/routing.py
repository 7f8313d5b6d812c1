"""Routing rules as Column expressions, and a logistic head."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def d(x: float) -> Column:
    return F.lit(float(x))


def hedge(p_dense: Column, p_sparse: Column, t_dense: float, t_sparse: float, delta: float) -> Column:
    """Neither head fires, or both are about equal: the fused route; else the head that fires, the more probable of two."""
    fires_d, fires_s = p_dense >= d(t_dense), p_sparse >= d(t_sparse)
    better = F.when(p_dense > p_sparse, "dense_only").otherwise("sparse_only")
    return F.when(~fires_d & ~fires_s, "pure_rrf").when(F.abs(p_dense - p_sparse) < d(delta), "pure_rrf").when(fires_d & fires_s, better).when(fires_d, "dense_only").otherwise("sparse_only")


def serve_most_probable(heads: Mapping[str, Column], threshold: float, hedge_bar: float = 0.0) -> Column:
    """The most probable head that fires; if none does, the most probable at all, unless all stay under ``hedge_bar``."""
    fired = {r: F.when(p >= d(threshold), p) for r, p in heads.items()}
    best, any_best = F.greatest(*fired.values()), F.greatest(*heads.values())
    out = F.lit(None).cast("string")
    for r in reversed(heads):
        out = F.when(heads[r] == any_best, r).otherwise(out)
    out = F.when(any_best < d(hedge_bar), "pure_rrf").otherwise(out)
    for r in reversed(heads):
        out = F.when(best.isNotNull() & (fired[r] == best), r).otherwise(out)
    return out


def rarity_rule(rare_share: Column, oov_share: Column, mean_zipf: Column, rare: float = 0.30, oov: float = 0.20, common: float = 4.5) -> Column:
    return F.when((rare_share >= d(rare)) | (oov_share >= d(oov)), "sparse_only").when(mean_zipf >= d(common), "dense_only").otherwise("sparse_only")


def logistic_head(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``rows`` with the probability ``p`` of a balanced logistic regression on standardised features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    positive = rows.agg(F.avg(label)).first()[0] or 0.0
    weight = F.when(F.col(label) == 1, 0.5 / max(positive, 1e-9)).otherwise(0.5 / max(1 - positive, 1e-9))
    weighted = rows.withColumn("_w", weight)
    stages = [VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol=label, weightCol="_w", regParam=1e-3, maxIter=30)]
    scored = Pipeline(stages=stages).fit(weighted).transform(weighted)
    return scored.withColumn("p", F.round(vector_to_array("probability")[1], 6)).drop("_w", "_x", "_z", "rawPrediction", "probability", "prediction")
