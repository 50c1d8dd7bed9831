"""Classifiers over all rows: logistic regression, random forest and gradient-boosted trees."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial
from typing import Any

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from cohortwise.operators.cleaning import union_all
from cohortwise.operators.metrics import METRICS, evaluate
from cohortwise.operators.scaling import with_class_weight
from cohortwise.session import at_once

# Hyper-parameters of the two candidate sets. `weighted` fits with class weights.
# "activity" regularises with a fixed strength on internally scaled rows; "scaled" states the
# inverse strength `C` per weighted row, on rows that are already scaled.
ACTIVITY_MODELS: dict[str, dict[str, Any]] = {
    "LR": {"weighted": True, "maxIter": 300, "regParam": 0.01, "standardization": True},
    "RF": {"weighted": False, "numTrees": 100, "maxDepth": 8, "minInstancesPerNode": 5, "seed": 42},
    "GBT": {"weighted": False, "maxIter": 30, "maxDepth": 6, "stepSize": 0.1, "seed": 42},
}
SCALED_MODELS: dict[str, dict[str, Any]] = {
    "LR": {"weighted": True, "maxIter": 500, "C": 1.0, "standardization": False, "tol": 1e-10},
    "RF": {"weighted": True, "numTrees": 100, "maxDepth": 8, "seed": 42},
    "GBT": {"weighted": False, "maxIter": 50, "maxDepth": 5, "stepSize": 0.1, "seed": 42},
}
KINDS = {"LR": LogisticRegression, "RF": RandomForestClassifier, "GBT": GBTClassifier}


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the `features` vector; rows with NULL or NaN in a feature are dropped."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def fit_pooled(train: DataFrame, test: DataFrame, kind: str, params: Mapping[str, Any], label: str = "label") -> DataFrame:
    """Fit one model on assembled rows and return the test rows with `prob` and `pred`."""
    params = dict(params)
    if params.pop("weighted", False):
        params["weightCol"] = "class_weight"
    if "C" in params:
        weight = train.agg(F.sum("class_weight").alias("s")).first()["s"]
        params["regParam"] = 1.0 / (params.pop("C") * weight)
    model = KINDS[kind](labelCol=label, featuresCol="features", **params).fit(train)
    # a training summary holds the session, which no task can be sent once it has an observation
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(train.sparkSession._jvm.scala.Option.empty())
    out = model.transform(test).withColumn("prob", vector_to_array("probability")[1])
    return out.withColumn("pred", F.col("prediction").cast("int"))


def compare_models(
    df: DataFrame,
    features: Sequence[str],
    candidates: Mapping[str, Mapping[str, Any]],
    label: str = "label",
    average: str = "binary",
    weights_on: str = "train",
    id_cols: Sequence[str] = (),
) -> DataFrame:
    """Rows (model, auc, accuracy, f1, precision, recall, tn, fp, fn, tp, n_train, n_test, is_best).

    `df` has `is_test`. Class weights are counted over the training rows, or over all rows before the
    split. With fewer than two classes or ten rows the result is empty. Equal AUCs keep the order given.
    The candidates are fitted at once.
    """
    rows = df.select(*id_cols, label, "is_test", *features).filter(F.col(label).isNotNull())
    rows = assemble(rows, features).select(*id_cols, label, "is_test", "features")
    base = rows if weights_on == "all" else rows.filter(F.col("is_test") == 0)
    rows = with_class_weight(rows, label, fit_on=base).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, test = rows.filter(F.col("is_test") == 0), rows.filter(F.col("is_test") == 1)
        sizes = rows.agg(
            F.count("*").alias("n"),
            F.count_if(F.col("is_test") == 0).alias("n_train"),
            F.count_if(F.col("is_test") == 1).alias("n_test"),
            F.count_distinct(label).alias("classes"),
        ).first()
        enough = sizes["classes"] >= 2 and sizes["n"] >= 10

        def compared(kind: str, params: Mapping[str, Any]) -> dict[str, Any]:
            scored = fit_pooled(train, test, kind, params, label).select(label, "prob", "pred")
            scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
            found = evaluate(scored, label=label, average=average).first().asDict()
            scored.unpersist()
            return found

        fits = [partial(compared, kind, params) for kind, params in candidates.items() if enough]
        parts = []
        for position, (kind, found) in enumerate(zip(candidates, at_once(df.sparkSession, fits), strict=False)):
            cells = [found[c] for c in ("tn", "fp", "fn", "tp")]
            parts.append((position, kind, *[found[m] for m in METRICS], *cells, sizes["n_train"], sizes["n_test"]))
    finally:
        rows.unpersist()
    best = max(parts, key=lambda row: (row[2] or 0.0, -row[0]))[0] if parts else None
    columns = ", ".join(f"{m} double" for m in METRICS) + ", tn bigint, fp bigint, fn bigint, tp bigint"
    schema = f"position int, model string, {columns}, n_train bigint, n_test bigint, is_best boolean"
    return df.sparkSession.createDataFrame([(*row, row[0] == best) for row in parts], schema)


def compare_by(
    parts: Mapping[str, DataFrame], features: Sequence[str], candidates: Mapping[str, Mapping[str, Any]], **options: Any
) -> DataFrame:
    """`compare_models` for several row sets, one after the other, under a `dataset` column."""
    return union_all(
        [
            compare_models(df, features, candidates, **options).withColumn("dataset", F.lit(name))
            for name, df in parts.items()
        ]
    )
