"""Trace scores, validity, and traces chosen under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as X


def log_sum_exp(values: Column) -> Column:
    return F.transform(F.array(F.array_max(values)), lambda m: m + F.log(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - m))))[0]


def plus_minus(plus: Column, minus: Column) -> tuple[Column, Column, Column]:
    """p_plus, p_minus and margin of two sets of logits."""
    p = 1 / (1 + F.exp(log_sum_exp(minus) - log_sum_exp(plus)))
    return p, 1 - p, p - (1 - p)


def step_summary(p: Column) -> dict[str, Column]:
    """Minimum, mean, and number and share of the leading steps with 0.5 or more; zeros without steps. Sums run in step order."""
    n = F.size(p)
    lead = F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, x: F.struct(F.when(a["go"] & (x >= 0.5), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["go"] & (x >= 0.5)).alias("go")))["n"]
    return {
        "num_scored_steps": n,
        "min_step_score": F.coalesce(F.array_min(p), F.lit(0.0)),
        "mean_step_score": F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.greatest(n, F.lit(1)),
        "prefix_high_len": lead,
        "prefix_high_ratio": lead / F.greatest(n, F.lit(1)).cast("double"),
    }


def score_final(answer: Column, p_plus: Column) -> tuple[Column, Column]:
    """Score and margin of the final answer; a missing answer has 0 and -1."""
    return F.when(answer.isNull(), 0.0).otherwise(p_plus), F.when(answer.isNull(), -1.0).otherwise(2 * p_plus - 1)


def trace_scores(df: DataFrame) -> DataFrame:
    """Adds base_trace_score, gold_match_bonus and trace_score."""
    base = X.MIN_STEP_WEIGHT * F.col("min_step_score") + X.MEAN_STEP_WEIGHT * F.col("mean_step_score") + X.PREFIX_WEIGHT * F.col("prefix_high_ratio") + X.FINAL_WEIGHT * F.col("final_answer_score")
    bonus = F.when(F.col("final_answer") == F.col("gold_answer"), X.GOLD_BONUS).otherwise(X.GOLD_PENALTY)
    return df.withColumns({"base_trace_score": base, "gold_match_bonus": bonus}).withColumn("trace_score", F.col("base_trace_score") + F.col("gold_match_bonus"))


def validity(answer: Column, steps: Column) -> Column:
    """The reason why a trace is not valid, or ok."""
    return F.when(answer.isNull(), "missing_final_answer").when(steps < X.MIN_STEPS, "too_few_scored_steps").when(steps > X.MAX_STEPS, "too_many_scored_steps").otherwise("ok")


def sample_budget(attempts: DataFrame, per_model: int = X.VALID_PER_MODEL, attempts_per_model: int = X.ATTEMPTS_PER_MODEL, in_all: int = X.VALID_IN_ALL) -> DataFrame:
    """The attempts (qid, model, model_rank, attempt, valid) that a loop would make, with their sample_index.

    First each model attempts until it has ``per_model`` valid traces; then the models take
    turns until a question has ``in_all``. Both are running counts: one
    shuffle by qid serves all windows.
    """
    own = W.partitionBy("qid", "model_rank").orderBy("attempt")
    q = W.partitionBy("qid")
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    one = F.col("valid").cast("int")
    a = attempts.filter(F.col("attempt") <= attempts_per_model).repartition("qid")
    a = a.withColumn("_first", F.coalesce(F.sum(one).over(before(own)), F.lit(0)) < per_model)
    a = a.withColumn("_k", F.when(~F.col("_first"), F.row_number().over(W.partitionBy("qid", "model_rank", "_first").orderBy("attempt")) - 1))
    a = a.withColumn("_have", F.coalesce(F.sum(F.when(F.col("_first"), one)).over(q), F.lit(0)))
    turn = W.partitionBy("qid").orderBy("_first", "_k", "model_rank")
    more = F.coalesce(F.sum(F.when(~F.col("_first"), one)).over(before(turn)), F.lit(0))
    a = a.withColumn("_made", F.col("_first") | (F.col("_have") + more < in_all)).filter("_made")
    order = W.partitionBy("qid").orderBy((~F.col("_first")).cast("int"), F.when(F.col("_first"), F.col("model_rank")).otherwise(F.col("_k")), F.when(F.col("_first"), F.col("attempt")).otherwise(F.col("model_rank")))
    return a.withColumn("sample_index", F.row_number().over(order) - 1).withColumn("phase", F.when(F.col("_first"), 1).otherwise(2)).select(*attempts.columns, "phase", "sample_index")
