"""Retrieval metrics over ranked lists, and ratios over judge answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evaluate(questions: DataFrame, hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per question (qid): hit rate at k, reciprocal rank over the whole list, NDCG at k.

    ``hits`` (qid, id, rank), ``truth`` (qid, id, grade).  A question without hits or truth scores 0.
    """
    graded = hits.join(truth, ["qid", "id"], "left").select("qid", "rank", F.coalesce("grade", F.lit(0)).alias("grade"))
    relevant, near = F.col("grade") > 0, F.col("rank") <= k
    gain = lambda place: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(place + 1)
    got = graded.groupBy("qid").agg(F.max(F.when(relevant & near, 1.0).otherwise(0.0)).alias("hit"), (1.0 / F.min(F.when(relevant, F.col("rank")))).alias("mrr"), F.sum(F.when(near, gain(F.col("rank"))).otherwise(0.0)).alias("dcg"))
    order = Window.partitionBy("qid").orderBy(F.desc("grade"), "id")
    ideal = truth.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).groupBy("qid").agg(F.sum(gain(F.col("place"))).alias("idcg"))
    out = questions.join(got, "qid", "left").join(ideal, "qid", "left")
    ndcg = F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))
    zero = F.lit(0.0)
    return out.select("qid", F.coalesce("hit", zero).alias("hit"), F.coalesce("mrr", zero).alias("mrr"), F.coalesce(ndcg, zero).alias("ndcg"))


def summary(per_question: DataFrame) -> DataFrame:
    mean = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(name)
    return per_question.agg(F.count("*").alias("questions"), mean("hit", "hit_rate"), mean("mrr", "mrr"), mean("ndcg", "ndcg"))


def ensured_list(raw: Column) -> Column:
    """A JSON list of strings; anything else is an empty list."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, part / whole).otherwise(0.0), 4)


def faithfulness(supported: Column, unsupported: Column, not_found: Column) -> Column:
    return _share(F.size(supported), F.size(supported) + F.size(unsupported) + F.size(not_found))


def context_precision(verdicts: Column, n: Column) -> Column:
    """Share of true verdicts; a wrong number of verdicts counts as all false."""
    return F.when(F.size(verdicts) == n, _share(F.size(F.filter(verdicts, lambda x: x)), n)).otherwise(0.0)


def context_recall(attributed: Column, not_attributed: Column) -> Column:
    return _share(F.size(attributed), F.size(attributed) + F.size(not_attributed))


def answer_relevancy(raw: Column) -> Column:
    """A number from 0 to 1, else 0."""
    score = raw.try_cast("double")
    return F.when(score.between(0, 1), score).otherwise(0.0)
