"""Measures of retrieval and classification, as long tables or one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 5, 10, 20, 50, 100)


def recall_at(ranked: DataFrame, truth: DataFrame, cuts=CUTS) -> DataFrame:
    """k, recall: the part of queries of ``truth(query_id, doc_id)`` one of whose documents is among the first k."""
    hit = ranked.select("query_id", "doc_id", "rank").join(truth, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    best = truth.select("query_id").distinct().join(hit, "query_id", "left")
    return best.select("query_id", "rank", F.explode(F.array(*map(F.lit, cuts))).alias("k")).groupBy("k").agg(F.round(F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)), 6).alias("recall"))


def reciprocal(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: mrr, the mean of 1 by the rank of the first right document, 0 without one, and precision_1."""
    hit = ranked.select("query_id", "doc_id", "rank").join(truth, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    best = truth.select("query_id").distinct().join(hit, "query_id", "left")
    return best.agg(F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg((F.coalesce("rank", F.lit(0)) == 1).cast("int")), 6).alias("precision_1"))


def classification(scored: DataFrame, by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, f1 of ``scored(label, score)``, over all or by the given columns; 0 where there is nothing to divide by."""
    said, true = F.col("score") >= threshold, F.col("label") == 1
    n = lambda c: F.sum(c.cast("double"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    grouped = scored.groupBy(*by) if by else scored.groupBy()
    sums = grouped.agg(F.count("*").alias("n"), n(said == true).alias("right"), n(said & true).alias("tp"), n(said).alias("said"), n(true).alias("true"))
    precision, recall = part(F.col("tp"), F.col("said")), part(F.col("tp"), F.col("true"))
    return sums.select(*(by or []), "n", F.round(part(F.col("right"), F.col("n")), 6).alias("accuracy"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(part(2 * precision * recall, precision + recall), 6).alias("f1"))


def auc(scored: DataFrame) -> DataFrame:
    """One row: the chance that a positive has a higher score than a negative, ties half; 0.5 if one of them is missing.

    Equal scores are one row before they are put in order, so the window gets the different scores only.
    """
    per = scored.groupBy("score").agg(F.sum((F.col("label") == 1).cast("double")).alias("p"), F.sum((F.col("label") != 1).cast("double")).alias("m"))
    below = F.coalesce(F.sum("m").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    won = per.withColumn("won", F.col("p") * (below + F.col("m") / 2)).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("m").alias("m"))
    return won.select(F.round(F.coalesce(F.try_divide(F.col("won"), F.col("p") * F.col("m")), F.lit(0.5)), 6).alias("auc"))


def ranking(scored: DataFrame, k: int = 5) -> DataFrame:
    """One row: ndcg, mrr and precision_1 over queries of two or more rows of ``scored(query_id, relevance, score)``.

    Gain is the relevance itself, and tied scores share the mean of their gains.
    """
    rows = scored.withColumn("many", F.count("*").over(Window.partitionBy("query_id"))).filter("many >= 2")
    by_score, by_gain = Window.partitionBy("query_id").orderBy(F.desc("score")), Window.partitionBy("query_id").orderBy(F.desc("relevance"))
    placed = rows.withColumns({"r": F.row_number().over(by_score), "i": F.row_number().over(by_gain)})
    gain = F.avg("relevance").over(Window.partitionBy("query_id", "score"))
    discounted = lambda g, r: F.sum(F.when(F.col(r) <= k, g / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    first = F.rank().over(by_score)
    sums = placed.withColumns({"gain": gain, "first": first}).groupBy("query_id").agg(
        discounted(F.col("gain"), "r").alias("dcg"), discounted(F.col("relevance").cast("double"), "i").alias("best"), F.min(F.when(F.col("relevance") > 0, F.col("first"))).alias("hit")
    )
    ndcg = F.coalesce(F.try_divide("dcg", "best"), F.lit(0.0))
    return sums.agg(F.round(F.avg(ndcg), 6).alias("ndcg"), F.round(F.avg(F.coalesce(1 / F.col("hit"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg((F.coalesce("hit", F.lit(0)) == 1).cast("int")), 6).alias("precision_1"))


def compare_models(scored: DataFrame) -> DataFrame:
    """model with its measures rounded to 4 places and whether it is the best by f1."""
    table = classification(scored, ["model"])
    short = table.select("model", *[F.round(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1")])
    return short.withColumn("best", F.row_number().over(Window.orderBy(F.desc("f1"), "model")) == 1)


def pipeline_measures(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: success_rate, the part of ``asked(query_id)`` that has a confirmed answer, and stage1_recall, the part that has any; 0 without queries.

    ``answers`` are the confirmed hits (query_id, match) that the engine returns for all queries at once, so there is no time of a single query.
    """
    best = answers.groupBy("query_id").agg(F.max(F.col("match").cast("int")).alias("ok"))
    rows = asked.select("query_id").distinct().join(best, "query_id", "left")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg(F.coalesce("ok", F.lit(0))), 6), F.lit(0.0)).alias("success_rate"), F.coalesce(F.round(F.avg(F.col("ok").isNotNull().cast("int")), 6), F.lit(0.0)).alias("stage1_recall"))
