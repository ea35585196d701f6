"""The stages as jobs over JSON lines: unify, queries, retrieve, pairs. A job that is run again does what is left."""

from __future__ import annotations

import logging
import platform
import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import fixed as X
from ..functions.prompts import answer_prompt, flat, step_prompt
from ..functions.text import final_answer, reasoning_steps
from ..operators import pairs as P
from ..operators import queries as Q
from ..operators import retrieve as R
from ..operators import traces as T
from ..operators import unify as U
from ..sources.loaders import existing, exists
from ..sources.tables import completed, not_completed, read_jsonl, read_table_if_any, replace_table, stored, upsert, write_json, write_jsonl
from .seams import DocumentSource, PromptScorer, TraceGenerator

log = logging.getLogger("prefmill")
QUERY_CACHE = "qid string, dataset string, split string, query string, query_candidates array<string>, pmids array<string>, retmax int"
DOCUMENT_CACHE = "pmid string, title string, abstract string, journal string, year string"


def unify(sets: list[DataFrame], out: str) -> DataFrame:
    """All records by dataset and split; the counts of each."""
    records = U.union_all(*sets)
    write_jsonl(records, out, by=("dataset", "split"))
    return U.counts(records)


def queries(records: DataFrame, out: str, email: str = "", sample: int | None = None) -> None:
    write_jsonl(Q.build_queries(Q.sample_rows(records, sample, "qid"), email), out)


#: Rows of each dataset and split of the small plan.
SMALL_PLAN = {
    "medqa_train": 200, "medqa_validation": 100, "medqa_test": 100, "medmcqa_train": 200, "medmcqa_validation": 100, "medmcqa_test": 100, "pubmedqa_train": 200,
}


def query_files(spark: SparkSession, unified: str, out: str, schema: StructType | str, email: str = "", small: dict[str, int] | None = None) -> list[str]:
    """Queries of every unified file that is there: {name}_queries_small for a sample of so many rows, and {name}_queries for all. Returns what was written."""
    small = SMALL_PLAN if small is None else small
    written = []
    for path in existing(spark, [f"{unified}/{n}.jsonl" for n in small]):
        name = path.rsplit("/", 1)[-1].removesuffix(".jsonl")
        rows = read_jsonl(spark, path, schema)
        for suffix, n in (("_queries_small", small[name]), ("_queries", None)):
            queries(rows, f"{out}/{name}{suffix}.jsonl", email, n)
            written.append(f"{name}{suffix}.jsonl")
    return written


def evidence_subset(records: DataFrame, out: str, size: int | None = 1000, seed: int = 42, source: str = "") -> dict:
    """Rows with evidence, in order of qid, a sample of them with its ids, and the counts of both; returns the counts."""
    rows = R.evidence(records)
    kept = rows.filter(F.size("docs") > 0)
    write_jsonl(kept.orderBy(F.col("qid").cast("string")), f"{out}/evidence_all.jsonl")
    kept = read_jsonl(records.sparkSession, f"{out}/evidence_all.jsonl", kept.schema)
    n = kept.count()
    write_jsonl(Q.sample_rows(kept, size if size and size < n else None, "qid", seed).orderBy(F.col("qid").cast("string")), f"{out}/evidence_subset.jsonl")
    some = read_jsonl(records.sparkSession, f"{out}/evidence_subset.jsonl", kept.schema)
    ids = [r.qid for r in some.select("qid").orderBy(F.col("qid").cast("string")).collect()]  # the size of the subset is a parameter
    raw = rows.count()
    stats = {"source_file": source, "raw_rows": raw, "kept_rows_after_doc_filter": n, "skipped_no_docs": raw - n, "subset_size": len(ids), "seed": seed, "max_docs_per_question": X.DOCS, "max_title_chars_per_doc": X.TITLE_CHARS, "max_abstract_chars_per_doc": X.ABSTRACT_CHARS}
    write_json(records.sparkSession, {"dataset": "medqa", "source_file": source, "keep_only_with_docs": True, "seed": seed, "subset_size": len(ids), "qids": ids}, f"{out}/evidence_subset_qids.json")
    write_json(records.sparkSession, stats, f"{out}/evidence_stats.json")
    return stats


def retrieve(records: DataFrame, source: DocumentSource) -> DataFrame:
    """As many rows as records: the documents of the first candidate query that finds any."""
    hits = source.search(R.candidate_rows(records))
    return R.docs_records(records, source.fetch(R.first_nonempty(records, hits)))


def retrieve_with_caches(records: DataFrame, source: DocumentSource, out: str, refresh_queries: bool = False, refresh_documents: bool = False) -> DataFrame:
    """As ``retrieve``, but only queries and documents that the caches below ``out`` do not hold go to the source, and what it says goes into them.

    As many rows as records; one whose query could not be answered has empty lists and an
    error, and is asked again by the next run, as one that found nothing.
    """
    spark = records.sparkSession
    records = R.own_candidates(records)
    known = read_table_if_any(spark, f"{out}/query_cache", QUERY_CACHE)
    hit, miss = R.with_query_cache(records, known.limit(0) if refresh_queries else known)
    miss = stored(miss, f"{out}/searched")
    hits = stored(source.search(R.candidate_rows(miss)), f"{out}/hits")
    errors = R.search_errors(hits)
    found = R.first_nonempty(miss, hits.filter("pmid IS NOT NULL")).join(errors.select("qid"), "qid", "left_anti")
    lists = hit.select("qid", "pmids").union(found.select("qid", "pmids")).union(errors.select("qid", F.array().cast("array<string>")))
    lists = stored(lists, f"{out}/lists")  # made from the cache as it was
    replace_table(upsert(known, R.query_cache_rows(miss, found), "qid"), f"{out}/query_cache")
    have = read_table_if_any(spark, f"{out}/document_cache", DOCUMENT_CACHE)
    new = source.documents(R.missing_documents(lists, have.limit(0) if refresh_documents else have))
    replace_table(upsert(have, stored(new.select(*have.columns).dropDuplicates(["pmid"]), f"{out}/fetched"), "pmid"), f"{out}/document_cache")
    told = R.docs_records(records, R.fetch(lists, spark.read.schema(DOCUMENT_CACHE).parquet(f"{out}/document_cache")))
    return told.join(errors, "qid", "left")


def parsed(attempts: DataFrame) -> DataFrame:
    """Attempts with their steps, final answer and validity, which need no model."""
    t = attempts.withColumns({"steps": reasoning_steps(F.col("raw_generation")), "final_answer": final_answer(F.col("raw_generation"))})
    t = t.withColumn("invalid_reason", T.validity(F.col("final_answer"), F.size("steps")))
    return t.withColumn("is_valid", F.col("invalid_reason") == "ok").withColumn("valid", F.col("is_valid"))


def score_traces(attempts: DataFrame, questions: DataFrame, scorer: PromptScorer) -> DataFrame:
    """Parses attempts, scores steps and answers in batches and composes the trace score."""
    t = attempts if "steps" in attempts.columns else parsed(attempts)
    t = t.withColumn("trace_id", F.concat_ws("_", "qid", "model", F.col("attempt").cast("string"))).join(questions.select("qid", "question", "docs", "gold_answer"), "qid")
    each = t.select("trace_id", "docs", "question", F.posexplode("steps").alias("i", "step"))
    steps = scorer.score(each.select("trace_id", "i", flat(step_prompt(F.col("docs"), F.col("question"), F.col("step"), F.col("i") + 1)).alias("prompt")))
    p = steps.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p_plus"))), lambda x: x["p_plus"]).alias("p"))
    asked = flat(answer_prompt(F.col("docs"), F.col("question"), F.col("steps"), F.col("final_answer"))).alias("prompt")
    final = scorer.score(t.filter("final_answer IS NOT NULL").select("trace_id", asked)).select("trace_id", F.col("p_plus").alias("_final"))
    t = t.join(p, "trace_id", "left").join(final, "trace_id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<double>")))
    score, margin = T.score_final(F.col("final_answer"), F.col("_final"))
    t = t.withColumns(T.step_summary(F.col("p"))).withColumns({"final_answer_score": score, "final_answer_margin": margin})
    return T.trace_scores(t).drop("_final")


def pairs(spark: SparkSession, questions: DataFrame, generator: TraceGenerator, scorer: PromptScorer, out: str, models: tuple[str, ...] = ("ft8b", "8b")) -> dict:
    """Traces are chosen under the budget, scored and written once; all else is made from what was written, and returned are the counts of the run.

    A sink takes the questions that it has not got yet, and the progress rows that mark questions as done
    come last, so after a crash at any place a rerun ends with the same rows as a run without it.
    """
    started = time.time()
    with_docs, skipped = R.split_by_evidence(questions)
    done = completed(spark, f"{out}/progress")
    todo = stored(not_completed(with_docs, done), f"{out}/todo")
    missing = todo if not exists(spark, f"{out}/traces/_SUCCESS") else not_completed(todo, spark.read.parquet(f"{out}/traces").select("qid").distinct())
    chosen = stored(T.sample_budget(parsed(generator.attempts(missing))), f"{out}/chosen")
    score_traces(chosen, todo, scorer).write.mode("append").parquet(f"{out}/traces")
    traces = spark.read.parquet(f"{out}/traces").join(todo.select("qid"), "qid", "left_semi")
    made = stored(P.build_pairs(traces.filter("is_valid")), f"{out}/made")
    dedup = P.dedup_pairs(made)
    for rows, name in ((P.export_pairs(made, todo), "pairs"), (P.export_pairs(dedup, todo), "dedup_pairs"), (P.question_results(traces, made, todo), "results")):
        write_jsonl(not_completed(rows, completed(spark, f"{out}/{name}")), f"{out}/{name}", "append")
    write_jsonl(skipped, f"{out}/skipped")
    write_jsonl(P.progress_counters(traces, made, dedup, todo, models), f"{out}/progress", "append")
    n = todo.count()
    report = {
        "time_utc": datetime.now(timezone.utc).isoformat(), "env": {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version},
        "config": {k.lower(): v for k, v in vars(X).items() if k.isupper() and isinstance(v, (int, float))},
        "total_loaded_questions": with_docs.count(), "processed_questions": n, "elapsed_seconds": time.time() - started,
    }
    report["skipped_existing_questions"] = report["total_loaded_questions"] - n
    write_json(spark, report, f"{out}/report.json")
    log.info("pairs: %d questions done, %d skipped", n, report["skipped_existing_questions"])
    return report
