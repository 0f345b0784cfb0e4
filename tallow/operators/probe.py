"""A class-weighted linear probe on hidden vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_probe(df: DataFrame, id_col: str, vector_col: str, label_col: str, iterations: int = 30) -> DataFrame:
    """``id_col``, ``label`` and ``probability`` of label 1 by a logistic regression with weights n / (2 * n_class)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    totals = df.groupBy(label_col).count().collect()  # two rows
    n = sum(r["count"] for r in totals)
    weight = F.lit(1.0)
    for r in totals:
        weight = F.when(F.col(label_col) == r[label_col], n / (2 * r["count"])).otherwise(weight)
    rows = df.select(id_col, F.col(label_col).cast("double").alias("label"), array_to_vector(vector_col).alias("features"), weight.alias("weight"))
    model = LogisticRegression(weightCol="weight", maxIter=iterations, regParam=1e-3).fit(rows)
    return model.transform(rows).select(id_col, F.col("label").cast("int").alias("label"), F.get(vector_to_array("probability"), 1).alias("probability"))
