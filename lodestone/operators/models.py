"""Rankers that learn: forests, boosted trees and pairwise preference."""

from __future__ import annotations

import tempfile

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=sorted(features), outputCol="features", handleInvalid="keep")


def split(rows: DataFrame, keys: list[str], part: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Rows for fitting and for testing, by a hash of the keys within each label."""
    test = F.pmod(F.xxhash64(*keys), F.lit(1000)) < int(1000 * part)
    return rows.filter(~test), rows.filter(test)


def fit_forest(rows: DataFrame, features: list[str], trees: int = 100, depth: int = 10, seed: int = 42) -> PipelineModel:
    return Pipeline(stages=[assembler(features), RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)]).fit(rows)


def fit_boosted(rows: DataFrame, features: list[str], rounds: int = 200, depth: int = 6, step: float = 0.1, seed: int = 42, held: str | None = None) -> PipelineModel:
    """``rounds`` trees; with ``held``, a column that is true for rows held back, it stops once these do not gain from another one.

    Each round reads what the one before left, so this is put down every ten rounds, in ``spark.checkpoint.dir``; a local session without one takes a temporary folder.
    """
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir() and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    boosted = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.8, seed=seed)
    return Pipeline(stages=[assembler(features), boosted.setValidationIndicatorCol(held) if held else boosted]).fit(rows)


def fit_pairwise(rows: DataFrame, features: list[str], rounds: int = 100) -> PipelineModel:
    """A linear scorer from preferences: for two passages of a query the difference of their features tells which is better."""
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.relevance") != F.col("b.relevance")))
    pairs = both.select(*[(F.col(f"a.{f}") - F.col(f"b.{f}")).alias(f) for f in features], (F.col("a.relevance") > F.col("b.relevance")).cast("double").alias("label"))
    return Pipeline(stages=[assembler(features), LogisticRegression(maxIter=rounds, fitIntercept=False, regParam=0.001)]).fit(pairs)


def ranked(model: PipelineModel, rows: DataFrame, k: int | None = None) -> DataFrame:
    """Rows (query_id, doc_id, features) with ranking_score, the chance of the better class, and final_rank."""
    scored = model.transform(rows).withColumn("ranking_score", F.round(vector_to_array("probability")[1], 9)).drop("features", "rawPrediction", "probability", "prediction")
    out = scored.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ranking_score"), "doc_id")))
    return out.filter(F.col("final_rank") <= k) if k else out


def untrained(rows: DataFrame) -> DataFrame:
    """The score that stands in for a model: 1 less a tenth for each rank after the first."""
    return rows.withColumn("ranking_score", F.round(1.0 - 0.1 * (F.col("rank") - 1), 6))


def importances(model: PipelineModel, features: list[str]) -> dict[str, float]:
    return dict(zip(sorted(features), model.stages[-1].featureImportances.toArray().tolist(), strict=True))


def save(model: PipelineModel, folder: str) -> None:
    model.write().overwrite().save(folder)


def load(folder: str) -> PipelineModel:
    return PipelineModel.load(folder)
