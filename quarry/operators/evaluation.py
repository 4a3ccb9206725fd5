"""Retrieval and generation metrics, review merging and binary classification figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def context_precision(verdicts: DataFrame) -> DataFrame:
    """verdicts(sample_id, position from 1, verdict) -> average precision in retrieved order; 0 if none is relevant."""
    so_far = F.sum("verdict").over(Window.partitionBy("sample_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    part = verdicts.withColumn("gain", so_far / F.col("position") * F.col("verdict"))
    return part.groupBy("sample_id").agg(F.coalesce(F.sum("gain") / F.nullif(F.sum("verdict"), F.lit(0)), F.lit(0.0)).alias("context_precision"))


def share_of(rows: DataFrame, flag: str, name: str) -> DataFrame:
    """Context recall and faithfulness: the share of rows whose flag is 1; samples without rows have none."""
    return rows.groupBy("sample_id").agg(F.avg(flag).alias(name))


def answer_relevancy(generated: DataFrame) -> DataFrame:
    """generated(sample_id, similarity, noncommittal): mean similarity, 0 if all are noncommittal."""
    return generated.groupBy("sample_id").agg((F.avg("similarity") * (1 - F.min("noncommittal"))).alias("answer_relevancy"))


def average_scores(scores: DataFrame, *keys: str) -> DataFrame:
    """Mean of the finite values per metric (and keys); null without any."""
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    return scores.groupBy(*keys, "metric_name").agg(F.avg(finite).alias("mean"))


def compare_configs(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Both means of each metric and b less a, null if either is missing."""
    pivot = average_scores(scores, "config").groupBy("metric_name").pivot("config", [a, b]).agg(F.first("mean"))
    return pivot.select("metric_name", F.col(a).alias("mean_a"), F.col(b).alias("mean_b"), (F.col(b) - F.col(a)).alias("delta"))


def aggregate_reviews(reviews: DataFrame) -> DataFrame:
    """reviews(task_id, reviewer, approved, issues array<struct<severity,text>>[, suggestions array]): approved iff all approve and nothing is high.

    Issues and suggestions of a task follow each other by reviewer; null arrays count as empty, null suggestions go.
    """
    if "suggestions" not in reviews.columns:
        reviews = reviews.withColumn("suggestions", F.array().cast("array<string>"))
    level = lambda i: F.lower(F.coalesce(i["severity"], F.lit("")))
    severity = lambda name: F.size(F.filter("all_issues", lambda i: F.when(level(i).isin("high", "medium"), level(i)).otherwise("low") == name)).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct("reviewer", F.coalesce("issues", F.array().cast(reviews.schema["issues"].dataType)).alias("issues"), F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))))
    total = reviews.groupBy("task_id").agg(F.bool_and("approved").alias("all"), F.count_if("approved").alias("yes"), F.count("*").alias("n"), ordered.alias("o"))
    total = total.withColumn("all_issues", F.flatten(F.transform("o", lambda x: x["issues"])))
    suggestions = F.filter(F.flatten(F.transform("o", lambda x: x["suggestions"])), lambda x: x.isNotNull())
    ratio = F.concat_ws("/", F.col("yes").cast("string"), F.col("n").cast("string"))
    return total.select("task_id", (F.col("all") & (severity("high") == 0)).alias("approved"), ratio.alias("ratio"), *[severity(x).alias(x) for x in ("high", "medium", "low")], F.col("all_issues").alias("issues"), suggestions.alias("suggestions"))


def confusion_metrics(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: tp, tn, fp, fn, accuracy, precision, recall, f1; a zero denominator gives 0."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    c = rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    c = c.withColumn("accuracy", share(tp + tn, tp + tn + fp + fn)).withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn))
    both = F.col("precision") + F.col("recall")
    return c.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0)), F.lit(0.0)))
