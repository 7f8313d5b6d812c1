"""Feature spaces of routers: columns that fire, principal components, hashed character n-grams, a small neural network.

Models are fitted by Spark ML; what reaches the driver depends on the number of features, never on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def firing(df: DataFrame, columns: Sequence[str], least: int) -> list[str]:
    """The columns that are neither zero nor null in at least ``least`` rows."""
    counts = df.agg(*[F.count(F.when(F.col(c) != 0, 1)).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c] >= least]


def _signed(basis: np.ndarray) -> np.ndarray:
    """Each column with the sign that makes its largest entry positive, as a direction has none of its own."""
    top = basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])]
    return basis * np.where(top < 0, -1.0, 1.0)


def _projected(df: DataFrame, key: str, vector: str, basis: np.ndarray, name: str) -> DataFrame:
    """(key, name): the product of each row's sparse or dense vector with the basis, in Arrow batches. The basis is features x components."""
    shared = df.sparkSession.sparkContext.broadcast(basis)
    parts = df.select(key, F.expr(vector + ".at").alias("at"), F.expr(vector + ".value").alias("value"))

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [np.asarray(v, float) @ shared.value[np.asarray(a, int)] for a, v in zip(rows["at"], rows["value"], strict=True)]
            yield pd.DataFrame({key: rows[key], name: out})

    return parts.mapInPandas(product, f"{key} {df.schema[key].dataType.simpleString()}, {name} array<double>")


def principal_components(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, components): projections of the centred arrays on their first ``k`` principal directions (all there are, if fewer).

    Arrays are equally long; null arrays give null. An empty table gives no rows."""
    from pyspark.ml.feature import PCA

    rows = df.select(key, F.col(vector).alias("_a")).withColumn("_x", F.when(F.col("_a").isNotNull(), array_to_vector(F.col("_a").cast("array<double>"))))
    known = rows.where(F.col("_x").isNotNull())
    first = known.select(F.size("_a").alias("n")).first()
    if first is None:
        return rows.select(key, F.lit(None).cast("array<double>").alias("components"))
    basis = _signed(PCA(k=min(k, first["n"]), inputCol="_x", outputCol="_p").fit(known).pc.toArray())
    means = known.agg(*[F.avg(F.col("_a")[i]) for i in range(first["n"])]).first()
    centre = F.array(*[F.lit(float(m)) for m in means])
    shifted = F.zip_with(F.col("_a").cast("array<double>"), centre, lambda x, m: x - m)
    spread = known.select(key, F.struct(F.sequence(F.lit(0), F.lit(first["n"] - 1)).alias("at"), shifted.alias("value")).alias("v"))
    found = _projected(spread, key, "v", basis, "components")
    return found.unionByName(rows.where(F.col("_x").isNull()).select(key, F.lit(None).cast("array<double>").alias("components")))


def border_grams(text: Column, shortest: int = 3, longest: int = 5) -> Column:
    """Character n-grams, repeats included, of every lower-cased word between two spaces; none crosses a word border. Null has none."""

    def grams(word: Column) -> Column:
        def of(n: int) -> Column:
            return F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

        return F.concat(*[of(n) for n in range(shortest, longest + 1)])

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: grams(F.concat(F.lit(" "), w, F.lit(" ")))))


def hashed_grams(df: DataFrame, key: str, text: str, width: int = 1 << 15) -> DataFrame:
    """(key, x): counts of hashed n-grams as a sparse vector of length one; a text without words is the zero vector."""
    from pyspark.ml.feature import HashingTF, Normalizer

    grams = df.select(key, border_grams(F.col(text)).alias("_grams"))
    counted = HashingTF(numFeatures=width, inputCol="_grams", outputCol="_tf").transform(grams)
    return Normalizer(p=2.0, inputCol="_tf", outputCol="x").transform(counted).select(key, "x")


def truncated_svd(vectors: DataFrame, key: str, k: int) -> DataFrame:
    """(key, components): projections of sparse vectors ``x`` on their first ``k`` right singular directions.

    Fitted by distributed Lanczos steps, each a pass over the cached rows; the basis (features x k) is bounded by the width of the hash.
    A matrix of smaller rank gives fewer components."""
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    kept = vectors.persist()
    try:
        matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(kept.select("x"), "x"))
        # Lanczos asks for fewer directions than the rank can hold
        basis = _signed(matrix.computeSVD(min(k, max(kept.count() - 1, 1)), computeU=False, rCond=1e-6).V.toArray())
    finally:
        kept.unpersist()
    sparse = F.unwrap_udt("x")  # as HashingTF gives it: the places of its non-zero values, and these
    return _projected(vectors.select(key, F.struct(sparse["indices"].alias("at"), sparse["values"].alias("value")).alias("v")), key, "v", basis, "components")


def neural_head(rows: DataFrame, features: Sequence[str], label: str, hidden: Sequence[int] = (8,), seed: int = 1) -> DataFrame:
    """``rows`` with ``p``, the probability of label 1 by a multilayer perceptron on standardised features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    network = MultilayerPerceptronClassifier(featuresCol="_z", labelCol=label, layers=[len(features), *hidden, 2], maxIter=40, seed=seed)
    stages = [VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), network]
    scored = Pipeline(stages=stages).fit(rows).transform(rows)
    return scored.withColumn("p", F.round(vector_to_array("probability")[1], 6)).drop("_x", "_z", "rawPrediction", "probability", "prediction")
