"""Retrieval of documents for queries, with caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed import DOCS, RETRIEVED
from ..functions.text import format_question, normalize, render_documents, tokenize

#: Rows of query tokens up to which they are broadcast (some 100 bytes each).
BROADCAST_ROWS = 1_000_000


def search(queries: DataFrame, docs: DataFrame, most: int = RETRIEVED, match: str = "any") -> DataFrame:
    """(qid, cand) queries over (pmid, text) documents -> qid, cand, pmid, score, rank: distinct common tokens, ties by pmid.

    Documents are scanned once; each task counts its documents' tokens against
    the query tokens, so what is shuffled are (query, document) counts that are
    not empty, and the window keeps the best of each task before it.
    """
    q = queries.select("qid", "cand", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("token"))
    size = q.groupBy("qid", "cand").agg(F.count("*").alias("n_tokens"))
    d = docs.select("pmid", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("token"))
    few = queries.count() <= BROADCAST_ROWS // 12
    hits = d.join(F.broadcast(q) if few else q, "token").groupBy("qid", "cand", "pmid").agg(F.count("*").alias("score"))
    if match == "all":
        hits = hits.join(size, ["qid", "cand"]).filter(F.col("score") == F.col("n_tokens")).drop("n_tokens")
    w = W.partitionBy("qid", "cand").orderBy(F.col("score").desc(), F.col("pmid"))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def candidate_rows(records: DataFrame) -> DataFrame:
    return records.select("qid", F.posexplode("query_candidates").alias("cand", "query"))


def first_nonempty(records: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, cand, query and pmids, in order of rank, of the first candidate that finds anything; empty if none does."""
    lists = hits.groupBy("qid", "cand").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pmid"))), lambda x: x["pmid"]).alias("pmids"))
    found = candidate_rows(records).join(lists, ["qid", "cand"]).groupBy("qid").agg(F.min_by(F.struct("cand", "query", "pmids"), "cand").alias("hit"))
    out = records.select("qid").join(found, "qid", "left")
    return out.select("qid", F.coalesce("hit.cand", F.lit(-1)).alias("cand"), F.coalesce("hit.query", F.lit("")).alias("query_used"), F.coalesce("hit.pmids", F.array().cast("array<string>")).alias("pmids"))


def with_query_cache(records: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): the cache is keyed by qid, and an empty list counts as a miss."""
    have = cache.filter(F.size("pmids") > 0)
    return records.join(have.select("qid", "pmids"), "qid"), records.join(have, "qid", "left_anti")


def own_candidates(records: DataFrame) -> DataFrame:
    """query_candidates normalised, distinct and not empty; the primary and the fallback query where there are none."""
    some = lambda a: F.array_distinct(F.filter(F.transform(a, normalize), lambda x: x != ""))
    two = F.array(*[F.col(c) if c in records.columns else F.lit("") for c in ("query_primary", "query_fallback")])
    given = F.coalesce("query_candidates", F.array().cast("array<string>"))
    return records.withColumn("query_candidates", some(F.when(F.size(given) > 0, given).otherwise(two)))


def query_cache_rows(records: DataFrame, found: DataFrame, most: int = RETRIEVED) -> DataFrame:
    """What a cache keeps of searched records: qid, dataset, split, the query that found something, the candidates, pmids and retmax."""
    kept = records.filter(F.size("query_candidates") > 0).select("qid", "dataset", "split", "query_candidates")
    return kept.join(found.select("qid", F.col("query_used").alias("query"), "pmids"), "qid").select("qid", "dataset", "split", "query", "query_candidates", "pmids", F.lit(most).alias("retmax"))


def search_errors(hits: DataFrame) -> DataFrame:
    """(qid, error) of the questions with a query that could not be answered before one that found something."""
    if "error" not in hits.columns:
        return hits.select("qid", F.lit(None).cast("string").alias("error")).limit(0)
    g = hits.groupBy("qid").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("cand", "error"))).alias("e"), F.min(F.when(F.col("pmid").isNotNull(), F.col("cand"))).alias("found"))
    return g.filter("e IS NOT NULL AND (found IS NULL OR e.cand < found)").select("qid", F.col("e.error").alias("error"))


def missing_documents(lists: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct pmids of the lists that are not in the cache."""
    return lists.select(F.explode("pmids").alias("pmid")).distinct().join(cache, "pmid", "left_anti")


def fetch(lists: DataFrame, documents: DataFrame) -> DataFrame:
    """qid with retrieved_docs in the order of pmids; documents that are not there are left out."""
    rows = lists.select("qid", F.posexplode("pmids").alias("pos", "pmid"))
    rows = rows.join(documents.select("pmid", "title", "abstract", "journal", "year"), "pmid")
    doc = F.struct("pmid", "title", "abstract", "journal", "year")
    got = rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", doc.alias("d")))), lambda x: x["d"]).alias("retrieved_docs"))
    return lists.join(got, "qid", "left").withColumn("retrieved_docs", F.coalesce("retrieved_docs", F.expr("cast(array() as array<struct<pmid:string,title:string,abstract:string,journal:string,year:string>>)")))


def docs_records(records: DataFrame, fetched: DataFrame) -> DataFrame:
    """As many rows as records: without meta and retrieval_meta, with pmids and documents."""
    return records.drop("meta", "retrieval_meta").join(fetched.select("qid", "pmids", "retrieved_docs"), "qid", "left")


def evidence(records: DataFrame, most: int = DOCS) -> DataFrame:
    """The question as shown, rendered documents and the gold answer."""
    docs = render_documents(F.col("retrieved_docs"), most)
    raw = ("query", "query_primary", "query_fallback", "query_candidates", "pmids")
    return records.select(
        "qid", F.coalesce("dataset", F.lit("medqa")).alias("dataset"), F.coalesce("split", F.lit("train")).alias("split"), format_question(F.col("question"), F.col("options")).alias("question"),
        docs.alias("docs"), F.size(docs).alias("num_docs"), normalize(F.col("answer")).alias("gold_answer"), normalize(F.col("answer_text")).alias("gold_answer_text"),
        F.struct(*[F.col(c) for c in ("question", "options", *raw) if c in records.columns]).alias("raw_record"),
    )


def split_by_evidence(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with documents, and the skip rows of those without."""
    return rows.filter(F.size("docs") > 0), rows.filter(F.size("docs") == 0).select("qid", "dataset", F.lit("no_retrieved_docs").alias("reason"))
