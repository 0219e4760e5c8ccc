"""Principal components: covariance in Spark, the d x d eigenproblem on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .kmeans import cluster_vs_label, kmeans_fit
from .ranking import percentiles
from .scale import covariance_matrix, standardize


def pca_fit(df: DataFrame, cols: list[str]) -> DataFrame:
    """(pc, eigenvalue, loading) by falling eigenvalue; the first of the largest loadings of a component is positive."""
    return pca_fit_vector(df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("v")), "v", len(cols))


def pca_fit_vector(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """As :func:`pca_fit`, of the components of a column of arrays of ``dim`` numbers."""
    values, vectors = np.linalg.eigh(covariance_matrix(df, vector, dim))
    rows = []
    for k, i in enumerate(np.argsort(-values, kind="stable")):
        v = vectors[:, i]
        v = v * (1 if v[np.argmax(np.round(np.abs(v), 9))] > 0 else -1)
        rows.append((k + 1, float(values[i]), [float(x) for x in v]))
    return df.sparkSession.createDataFrame(rows, "pc int, eigenvalue double, loading array<double>")


def pca_project(df: DataFrame, model: DataFrame, cols: list[str], k: int) -> DataFrame:
    """Scores ``pc1`` .. ``pck`` as linear expressions of the columns."""
    for r in model.where(F.col("pc") <= k).collect():
        score = sum((F.col(c) * F.lit(w) for c, w in zip(cols, r["loading"])), F.lit(0.0))
        df = df.withColumn(f"pc{r['pc']}", score)
    return df


def pca_contribution(model: DataFrame) -> DataFrame:
    """Share of each component and the running total; one row per component."""
    w = W.orderBy("pc")
    total = F.sum("eigenvalue").over(W.partitionBy(F.lit(1)))
    return model.select("pc", "eigenvalue", (F.col("eigenvalue") / total).alias("ratio")).withColumn("cum_ratio", F.sum("ratio").over(w))


def pca_library(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """(pc, variance share, loading sizes) by Spark ML: a second way to the same components, up to their signs."""
    from pyspark.ml.feature import PCA, VectorAssembler

    v = VectorAssembler(inputCols=cols, outputCol="v").transform(df)
    m = PCA(k=k, inputCol="v", outputCol="s").fit(v)
    pc, share = m.pc.toArray(), m.explainedVariance.toArray()
    return df.sparkSession.createDataFrame([(j + 1, float(share[j]), [abs(float(x)) for x in pc[:, j]]) for j in range(k)], "pc int, ratio double, size array<double>")


def cluster_on_components(df: DataFrame, cols: list[str], label: str, k: int = 3) -> DataFrame:
    """K-means on the first two scores of the standardised columns, against the true classes. Starts at k spread-out rows by the first score."""
    z = standardize(df, cols)
    s = pca_project(z, pca_fit(z, cols), cols, 2).persist()
    b = s.agg(F.avg("pc2")).first()[0]
    fitted = kmeans_fit(s, ["pc1", "pc2"], [[x, float(b)] for x in percentiles(s, "pc1", [(i + 0.5) / k for i in range(k)])])
    return cluster_vs_label(fitted.labels, label)
