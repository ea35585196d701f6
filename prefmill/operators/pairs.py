"""Ranking, votes, and chosen/rejected pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import pair_prompt, pair_signature, signature


def rank_traces(traces: DataFrame, key: str = "trace_score") -> DataFrame:
    """Adds rank within qid, best first; a missing score is last, ties keep the order of generation."""
    w = W.partitionBy("qid").orderBy(F.coalesce(F.col(key), F.lit(-1e9)).desc(), "sample_index")
    return traces.withColumn("rank", F.row_number().over(w))


def best_of_n(traces: DataFrame, key: str = "trace_score") -> DataFrame:
    return rank_traces(traces, key).filter("rank = 1").drop("rank")


def vote(traces: DataFrame, key: str = "trace_score") -> DataFrame:
    """A cluster for each answer, ranked by total and then mean final score."""
    answer = F.coalesce("final_answer", F.lit("UNKNOWN"))
    c = traces.groupBy("qid", answer.alias("answer")).agg(
        F.count("*").alias("count"), F.sum(key).alias("total_score"), F.avg(key).alias("mean_score"), F.max(key).alias("best_score"),
        F.avg("final_answer_score").alias("mean_final_answer_score"), F.min("sample_index").alias("_first"),
    )
    w = W.partitionBy("qid").orderBy(F.round("total_score", 9).desc(), F.round("mean_final_answer_score", 9).desc(), "_first")
    return c.withColumn("rank", F.row_number().over(w)).drop("_first")


def build_pairs(traces: DataFrame, key: str = "trace_score", top_k: int = X.TOP_K, bottom_k: int = X.BOTTOM_K, most: int = X.MAX_PAIRS, chosen_is_gold: bool = True, rejected_not_gold: bool = True) -> DataFrame:
    """Pairs of up to ``top_k`` chosen and ``bottom_k`` rejected traces of a question, same-answer pairs first.

    Both pools are cut to their best by windows before they meet, so the
    join makes at most top_k * bottom_k rows a question; it and all windows share one partitioning by qid.
    """
    t = traces.filter(F.col("final_answer").isNotNull() & (F.col("num_scored_steps") >= X.MIN_STEPS)).repartition("qid")
    q = W.partitionBy("qid")
    t = t.withColumn("_gap", F.max(key).over(q) - F.min(key).over(q)).withColumn("_n", F.count("*").over(q)).filter("_n >= 2")
    gold = F.col("final_answer") == F.col("gold_answer")
    good, poor = F.col("final_answer_score") >= X.CHOSEN_FINAL, F.col("final_answer_score") <= X.REJECTED_FINAL
    chosen = t.filter(gold & good if chosen_is_gold else good)
    rejected = t.filter(~gold | poor if rejected_not_gold else poor)
    best, worst = q.orderBy(F.col(key).desc(), "sample_index"), q.orderBy(F.col(key).asc(), "sample_index")
    fields = {"trace_id": "trace_id", "score": key, "final_answer_score": "final_answer_score", "answer": "final_answer", "text": "raw_generation"}
    side = lambda df, name: df.select("qid", *[F.col(v).alias(f"{name}_{k}") for k, v in fields.items()], F.col("_r").alias(f"_{name}"), F.col("_gap").alias(f"_gap_{name}"))
    c = side(chosen.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= top_k), "chosen")
    r = side(rejected.withColumn("_r", F.row_number().over(worst)).filter(F.col("_r") <= bottom_k), "rejected")
    margin = F.greatest(F.lit(X.MIN_MARGIN), X.MARGIN_SHARE * F.col("_gap_chosen"))
    p = c.join(r, "qid").filter(F.col("chosen_trace_id") != F.col("rejected_trace_id"))
    p = p.filter((F.col("chosen_score") - F.col("rejected_score") >= margin) & (F.col("chosen_final_answer_score") - F.col("rejected_final_answer_score") >= X.MIN_FINAL_DIFF))
    same = F.col("chosen_answer") == F.col("rejected_answer")
    p = p.withColumns({"score_margin": F.col("chosen_score") - F.col("rejected_score"), "pair_type": F.when(same, "same_answer").otherwise("cross_answer")})
    order = q.orderBy((~same).cast("int"), "_chosen", "_rejected")
    p = p.withColumn("pair_index", F.row_number().over(order)).filter(F.col("pair_index") <= most)
    return p.drop("_chosen", "_rejected", "_gap_chosen", "_gap_rejected")


def dedup_pairs(pairs: DataFrame) -> DataFrame:
    """Of equal pairs of texts of a question the one with the largest margin, at the place of the first."""
    p = pairs.withColumn("_s", pair_signature(F.col("chosen_text"), F.col("rejected_text")))
    w = W.partitionBy("qid", "_s")
    p = p.withColumn("_at", F.min("pair_index").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.col("score_margin").desc(), "pair_index"))).filter("_r = 1")
    return p.withColumn("pair_index", F.row_number().over(W.partitionBy("qid").orderBy("_at"))).drop("_s", "_at", "_r")


def pair_diagnostics(pairs: DataFrame) -> DataFrame:
    """Counts of pairs, of their types and of distinct texts, one row for each question with pairs."""
    sig = lambda c: signature(F.col(c))
    return pairs.groupBy("qid").agg(
        F.count("*").alias("n_pairs"), F.count_if(F.col("pair_type") == "same_answer").alias("n_same_answer"), F.count_if(F.col("pair_type") == "cross_answer").alias("n_cross_answer"),
        F.count_distinct(sig("chosen_text")).alias("n_chosen_texts"), F.count_distinct(sig("rejected_text")).alias("n_rejected_texts"),
        F.count_distinct(pair_signature(F.col("chosen_text"), F.col("rejected_text"))).alias("n_dedup_pairs"),
    )


def export_pairs(pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """Pairs with the prompt and the gold answer of their question."""
    q = questions.select("qid", "dataset", pair_prompt(F.col("question"), F.col("docs")).alias("prompt"), "gold_answer", "gold_answer_text")
    return pairs.join(q, "qid").withColumnsRenamed({"chosen_text": "chosen", "rejected_text": "rejected"})


def answer_histogram(traces: DataFrame, by: str = "final_answer") -> DataFrame:
    """qid with a map from value to count."""
    n = traces.groupBy("qid", F.coalesce(F.col(by), F.lit("UNKNOWN")).alias("k")).agg(F.count("*").alias("n"))
    return n.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("histogram"))


def progress(traces: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counters of every question, with an outcome also for those without a valid trace."""
    t = traces.groupBy("qid").agg(F.count("*").alias("n_attempts"), F.count_if("is_valid").alias("n_valid"), (F.max(F.when(F.col("is_valid"), F.col("trace_score"))) - F.min(F.when(F.col("is_valid"), F.col("trace_score")))).alias("score_gap"))
    out = t.join(pairs.groupBy("qid").agg(F.count("*").alias("n_pairs")), "qid", "left").fillna(0, ["n_pairs", "score_gap"])
    return out.withColumn("outcome", F.when(F.col("n_valid") == 0, "no_valid_traces").when(F.col("n_pairs") == 0, "no_pairs").otherwise("pairs"))


def progress_counters(traces: DataFrame, pairs: DataFrame, dedup: DataFrame, questions: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """The counters of every tried question, attempts_{model} for each model, with an outcome also for those without a valid trace."""
    valid = F.col("is_valid")
    t = traces.groupBy("qid").agg(
        F.count_if(valid).alias("num_valid_traces"), F.count_if(~valid).alias("num_discarded_traces"), F.count("*").alias("all_attempts"),
        *[F.count_if(F.col("model") == m).alias(f"attempts_{m}") for m in models],
        F.coalesce(F.max(F.when(valid, F.col("trace_score"))) - F.min(F.when(valid, F.col("trace_score"))), F.lit(0.0)).alias("score_gap"),
    )
    by = answer_histogram(traces.filter(valid), "model").withColumnRenamed("histogram", "valid_traces_by_model")
    n = lambda p, c: p.groupBy("qid").agg(F.count("*").alias(c))
    out = questions.select("qid", "dataset", "gold_answer").join(t, "qid").join(by, "qid", "left").join(n(pairs, "raw_pair_count"), "qid", "left").join(n(dedup, "dedup_pair_count"), "qid", "left")
    out = out.fillna(0, ["raw_pair_count", "dedup_pair_count"]).withColumn("valid_traces_by_model", F.coalesce("valid_traces_by_model", F.create_map().cast("map<string,bigint>")))
    out = out.withColumns({"raw_rows_appended": F.col("raw_pair_count"), "dedup_rows_appended": F.col("dedup_pair_count")})
    return out.withColumn("outcome", F.when(F.col("num_valid_traces") == 0, "no_valid_traces").when(F.col("raw_pair_count") == 0, "no_pairs").otherwise("pairs"))


def question_results(traces: DataFrame, pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """One nested row for each tried question: its ranked valid traces, the best of them, vote clusters, pairs with diagnostics, and discarded traces.

    All groups are of one question and no larger than its sampling budget.
    """
    own = [c for c in traces.columns if c not in ("qid", "question", "docs", "gold_answer")]
    valid = rank_traces(traces.filter("is_valid"))
    in_order = lambda key, *cols: F.array_sort(F.collect_list(F.struct(F.col(key).alias("_at"), F.struct(*cols).alias("_row"))))
    ranked = valid.groupBy("qid").agg(F.transform(in_order("rank", *own), lambda x: x["_row"]).alias("ranked_traces"), F.count("*").alias("num_valid_traces"))
    lost = traces.filter("NOT is_valid").groupBy("qid").agg(F.transform(in_order("sample_index", *own), lambda x: x["_row"]).alias("discarded_traces"), F.count("*").alias("num_discarded_traces"))
    clusters = ["answer", "count", "total_score", "mean_score", "best_score", "mean_final_answer_score"]
    voted = vote(traces.filter("is_valid")).groupBy("qid").agg(F.transform(in_order("rank", *clusters), lambda x: x["_row"]).alias("clusters"))
    made = pairs.groupBy("qid").agg(F.transform(in_order("pair_index", *[c for c in pairs.columns if c not in ("qid", "pair_index")]), lambda x: x["_row"]).alias("dpo_pairs"))
    told = pair_diagnostics(pairs).withColumnRenamed("qid", "_q")
    told = told.select(F.col("_q").alias("qid"), F.struct(*[c for c in told.columns if c != "_q"]).alias("pair_diagnostics"))
    tried = traces.groupBy("qid").agg(F.count("*").alias("all_attempts"))
    out = questions.select("qid", "dataset", "question", "docs", "gold_answer", "gold_answer_text").join(tried, "qid")
    for part in (ranked, lost, voted, made, told, answer_histogram(traces.filter("is_valid")).withColumnRenamed("histogram", "answer_histogram")):
        out = out.join(part, "qid", "left")
    out = out.fillna(0, ["num_valid_traces", "num_discarded_traces"]).withColumn("best_of_n", F.get("ranked_traces", F.lit(0)))
    out = out.withColumn("sc_rm", F.struct("clusters", F.get("clusters", F.lit(0))["answer"].alias("selected_answer_by_sc_rm"))).drop("clusters")
    none = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("ranked_traces", "discarded_traces", "dpo_pairs")}
    score = lambda x: x["trace_score"]
    gap = F.coalesce(F.array_max(F.transform("ranked_traces", score)) - F.array_min(F.transform("ranked_traces", score)), F.lit(0.0))
    return out.withColumns(none).withColumn("score_gap", gap)
