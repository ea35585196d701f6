"""Queries that run the jobs, loaders, caches and exports over the driver's tables, with their SQL. Files go to a scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import prompts as M
from ..operators import pairs as P
from ..operators import traces as S
from ..operators import unify as U
from ..sources import loaders as L
from ..sources.tables import articles, completed, not_completed, read_jsonl, read_jsonl_if_any, safe_name, scratch, table, write_jsonl
from . import jobs
from .registry import _EVIDENCE, _NORM, _PAIRS, _PQ, _SEARCH, _STRIP, benchmark_search, document_rows, order_traces, part_questions, query
from .seams import TableSource

_LIT = lambda x: "'" + x.replace("'", "''") + "'"


# --- Loaders and files ------------------------------------------------------------------------
@query(
    f"""WITH r AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'train' ELSE 'test' END AS split FROM part WHERE p_partkey % 3 < 2),
i AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY p_partkey) - 1 AS i, CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(CAST(p_size AS DOUBLE) AS VARCHAR) END AS c FROM r)
SELECT 'medmcqa_' || split || '_' || lpad(CAST(i AS VARCHAR), 8, '0') AS qid, split, CASE p_size % 4 WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE '' END AS answer,
  CASE p_size % 4 WHEN 1 THEN {_NORM('p_type')} WHEN 2 THEN {_NORM('p_brand')} WHEN 3 THEN c ELSE '' END AS answer_text, CASE WHEN c = '' THEN 2 ELSE 3 END AS n_options, split || '-00000-of-00001.parquet' AS file FROM i WHERE p_size % 5 <> 0"""
)
def load_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Two of three split files are there; ids count the rows of a file, those without a question too; NaN is null."""
    folder = scratch(spark)
    p = table(spark, sf, "part")
    for k, split in ((0, "train"), (1, "test")):
        rows = p.filter(F.col("p_partkey") % 3 == k).orderBy("p_partkey").select(
            F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("question"), F.col("p_type").alias("opa"), F.col("p_brand").alias("opb"),
            F.when(F.col("p_size") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("p_size").cast("double")).alias("opc"), F.lit("").alias("opd"), (F.col("p_size") % 4).alias("cop"),
        )
        rows.coalesce(1).write.parquet(f"{folder}/{L.SPLIT_FILES[split]}")
    u = L.load_medmcqa(spark, folder)
    return u.select("qid", "split", "answer", "answer_text", F.size("options").alias("n_options"), F.element_at(F.split("meta.source_path", "/"), -1).alias("file"))


@query(f"SELECT 'medqa_train_' || lpad(CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS VARCHAR), 8, '0') AS qid, {_NORM('p_name')} AS meta_info, {_NORM('p_type')} || '|' || {_NORM('p_brand')} || '|' || p_size AS phrases FROM part")
def flat_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Notes of any shape as their distinct texts, depth first."""
    folder = scratch(spark)
    two = F.struct(F.array(F.col("p_type"), F.lit(None).cast("string")).alias("a"), F.create_map(F.lit("k"), F.col("p_brand")).alias("b"), F.col("p_size").alias("c"))
    rows = table(spark, sf, "part").orderBy("p_partkey").select(F.col("p_name").alias("question"), F.array(F.lit("x"), F.lit("y")).alias("options"), F.struct(F.col("p_name").alias("n"), F.lit(" ").alias("e")).alias("meta_info"), F.array(two, two).alias("metamap_phrases"))
    rows.coalesce(1).write.parquet(f"{folder}/{L.SPLIT_FILES['train']}")
    return L.load_medqa(spark, folder).select("qid", "meta.meta_info", F.array_join("meta.metamap_phrases", "|").alias("phrases"))


@query(f"WITH {_PQ} SELECT 'medmcqa' AS dataset, 'train' AS split, count(*) AS n, count(*) AS n_again, 0::BIGINT AS n_missing, count(*) FILTER (answer <> '') AS n_left FROM u WHERE len(opts) >= 2")
def jsonl_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Written by dataset and split, read back, appended to, and what is left after the completed ones."""
    folder = scratch(spark)
    write_jsonl(part_questions(spark, sf), f"{folder}/u", by=("dataset", "split"))
    rows = read_jsonl(spark, f"{folder}/u", "qid string, answer string, dataset string, split string")
    write_jsonl(rows.filter("answer = ''").select("qid"), f"{folder}/done")
    write_jsonl(rows.filter("answer <> ''").select("qid"), f"{folder}/all")
    write_jsonl(rows.filter("answer = ''").select("qid"), f"{folder}/all", "append")
    none = read_jsonl_if_any(spark, f"{folder}/none", "qid string").count()
    again = read_jsonl(spark, f"{folder}/all", "qid string").count()
    left = not_completed(rows, completed(spark, f"{folder}/done")).groupBy("dataset", "split").agg(F.count("*").alias("n_left"))
    return U.counts(rows).join(left, ["dataset", "split"]).select("dataset", "split", "n", F.lit(again).cast("long").alias("n_again"), F.lit(none).cast("long").alias("n_missing"), "n_left")


@query(
    """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS qid, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS f, o_orderkey AS k, o_orderkey % 4 > 0 AS has FROM orders),
c AS (SELECT * FROM o WHERE has QUALIFY row_number() OVER (ORDER BY f, k) <= 500), e AS (SELECT max(row(f, k)) AS e, count(*) AS n FROM c)
SELECT qid, 'question' AS kind FROM c UNION ALL SELECT qid, 'no_retrieved_docs' FROM o, e WHERE NOT has AND (n < 500 OR row(f, k) < e)"""
)
def question_cap(spark: SparkSession, sf: str) -> DataFrame:
    """A question cap over two files, a third of which is missing: its size is the feature."""
    folder = scratch(spark)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("qid"), F.lit("orders").alias("dataset"), F.when(F.col("o_orderkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderpriority")).alias("docs"), "o_orderkey", "o_orderstatus")
    for name, some in (("a", "o_orderstatus = 'F'"), ("b", "o_orderstatus <> 'F'")):
        write_jsonl(o.filter(some).orderBy("o_orderkey").select("qid", "dataset", "docs").coalesce(1), f"{folder}/{name}.jsonl")
    got, skipped = L.load_questions(spark, [f"{folder}/{n}.jsonl" for n in "axb"], "qid string, dataset string, docs array<string>", 500)
    return got.select("qid", F.lit("question").alias("kind")).union(skipped.select("qid", "reason"))


@query(f"WITH {_PQ}, n AS (SELECT count(*) AS n FROM u WHERE len(opts) >= 2) SELECT 'medmcqa_train_queries_small.jsonl' AS file, least(n, 200) AS n FROM n UNION ALL SELECT 'medmcqa_train_queries.jsonl', n FROM n")
def query_plans(spark: SparkSession, sf: str) -> DataFrame:
    """The small and the full plan over the unified files that are there; the small plan's sizes are its feature."""
    folder = scratch(spark)
    u = part_questions(spark, sf)
    write_jsonl(u, f"{folder}/medmcqa_train.jsonl")
    out = None
    for name in jobs.query_files(spark, folder, f"{folder}/out", u.schema):
        rows = read_jsonl(spark, f"{folder}/out/{name}", "qid string, query string").filter("query IS NOT NULL").agg(F.lit(name).alias("file"), F.count("*").alias("n"))
        out = rows if out is None else out.union(rows)
    return out


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS pmid, 'R&D < "A" é – ' || doc_id AS title, 'AIM: ' || lang || chr(10) || 'a < b' AS abstract, CAST(1990 + doc_id % 10 AS VARCHAR) AS year, {_NORM("'J & ' || source")} AS journal FROM documents WHERE doc_id IS NOT NULL""")
def article_texts(spark: SparkSession, sf: str) -> DataFrame:
    """References that were escaped twice, by name and by number, and another abstract beside the first."""
    i = F.col("doc_id").cast("string")
    parts = [
        "<S><PubmedArticle><MedlineCitation><PMID>", i, "</PMID><Article><Journal><JournalIssue><PubDate><Year> ", (F.col("doc_id") % 10 + 1990).cast("string"),
        " </Year></PubDate></JournalIssue><Title>J &amp;amp; ", F.coalesce("source", F.lit("")), "</Title></Journal><ArticleTitle>R&amp;amp;D &amp;lt; &amp;#34;A&amp;quot; &amp;eacute; &amp;#x2013; ", i,
        "</ArticleTitle><Abstract><AbstractText Label='AIM'>", F.col("lang"), "</AbstractText><AbstractText>a &amp;lt; b</AbstractText></Abstract></Article><OtherAbstract><AbstractText>no</AbstractText></OtherAbstract></MedlineCitation></PubmedArticle></S>",
    ]
    xml = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return articles(table(spark, sf, "documents").filter("doc_id IS NOT NULL").select(xml.alias("xml"))).select("pmid", "title", "abstract", "year", "journal")


# --- Retrieval and evidence -------------------------------------------------------------------
@query(
    f"""WITH {_SEARCH}, f AS (SELECT qid, min(cand) AS cand FROM r GROUP BY qid), l AS (SELECT qid, string_agg(pmid, ',' ORDER BY rank) AS pmids, count(*) AS n FROM r JOIN f USING (qid, cand) GROUP BY qid)
SELECT i.qid, coalesce(pmids, '') AS pmids, CAST(coalesce(n, 0) AS BIGINT) AS n_docs, CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT qid FROM q) i LEFT JOIN l ON i.qid = l.qid"""
)
def retrieval_job(spark: SparkSession, sf: str) -> DataFrame:
    """A first run over some of the questions fills the caches; the second asks for the others."""
    folder = scratch(spark)
    records = benchmark_search(spark, sf)[0].withColumns({"dataset": F.lit("other"), "split": F.lit("train")})
    documents = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("pmid"), F.lit("").alias("title"), F.col("text").alias("abstract"), F.col("source").alias("journal"), F.lit("1999").alias("year"))
    source = TableSource(documents)
    jobs.retrieve_with_caches(records.filter(F.crc32("qid") % 2 == 0), source, folder).count()
    out = jobs.retrieve_with_caches(records, source, folder)
    return out.select("qid", F.array_join("pmids", ",").alias("pmids"), F.size("retrieved_docs").cast("long").alias("n_docs"), "error")


@query(
    _EVIDENCE
    + """, k AS (SELECT b.qid FROM b JOIN e ON b.qid = e.qid), picked AS (SELECT qid FROM k QUALIFY row_number() OVER (ORDER BY md5('42|' || qid), qid) <= 15)
SELECT (SELECT count(*) FROM b) AS raw_rows, (SELECT count(*) FROM k) AS kept, (SELECT count(*) FROM b) - (SELECT count(*) FROM k) AS skipped, count(*) AS subset_size, md5(string_agg(qid, ',' ORDER BY qid)) AS digest FROM picked"""
)
def evidence_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence subset with its ids and counts; its size is the feature."""
    folder = scratch(spark)
    told = jobs.evidence_subset(document_rows(spark, sf), folder, 15)
    rows = spark.read.option("multiline", "true").json(f"{folder}/evidence_subset_qids.json")
    return rows.select(*[F.lit(told[k]).cast("long").alias(n) for k, n in (("raw_rows", "raw_rows"), ("kept_rows_after_doc_filter", "kept"), ("skipped_no_docs", "skipped"), ("subset_size", "subset_size"))], F.md5(F.array_join("qids", ",")).alias("digest"))


# --- Prompts and scores -----------------------------------------------------------------------
_ABOUT = f"'Documents:' || chr(10) || {_STRIP('x || chr(10) || chr(10) || l')} || chr(10) || chr(10)"
_ASK = f"'Question:' || chr(10) || {_STRIP('x')} || chr(10) || chr(10)"


@query(
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(lang, '') AS l, {_STRIP("left(coalesce(text, ''), 60)")} AS s FROM documents),
p AS (SELECT doc_id, {_LIT(M.STEP_SYSTEM)} || chr(10) || chr(10) || {_ABOUT} || {_ASK} || 'CURRENT STEP #2:' || chr(10) || '```text' || chr(10) || s || chr(10) || '```' || chr(10) || chr(10) || {_LIT(M.VERIFIER_END)} AS a,
  {_LIT(M.ANSWER_SYSTEM)} || chr(10) || chr(10) || {_ABOUT} || {_ASK} || 'Reasoning Trace:' || chr(10) || {_STRIP("'- ' || s || chr(10) || '- ' || l")} || chr(10) || chr(10) || 'Chosen Final Answer: (B)' || chr(10) || chr(10) || {_LIT(M.VERIFIER_END)} AS b,
  {_LIT(M.POLICY_WITH_DOCS)} || chr(10) || chr(10) || {_ABOUT} || {_ASK} || {_LIT(M.POLICY_END)} AS c, {_LIT(M.POLICY_WITHOUT_DOCS)} || chr(10) || chr(10) || {_ASK} || {_LIT(M.POLICY_END)} AS d,
  {_LIT(M.POLICY_STRICT)} || chr(10) || chr(10) || {_ABOUT} || {_ASK} || {_LIT(M.POLICY_STRICT_END)} AS e FROM d)
SELECT doc_id, md5(a) AS step, md5(b) AS answer, md5(c) AS policy, md5(d) AS policy_without, md5(e) AS policy_strict FROM p"""
)
def chat_prompts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("x"), F.coalesce("lang", F.lit("")).alias("l"))
    docs, s, q = F.array("x", "l"), F.substring("x", 1, 60), F.col("x")
    each = {
        "step": M.step_prompt(docs, q, s, F.lit(2)), "answer": M.answer_prompt(docs, q, F.array(M.strip(s), F.col("l")), F.lit("B")), "policy": M.policy_prompt(docs, q),
        "policy_without": M.policy_prompt(docs, q, with_docs=False), "policy_strict": M.policy_prompt(docs, q, strict=True),
    }
    return d.select("doc_id", *[F.md5(M.flat(p)).alias(n) for n, p in each.items()])


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, ln(exp(l_discount * 10) + exp(l_tax * 10)) AS p, ln(exp(l_quantity / 50) + exp(l_discount)) AS m, l_returnflag = 'N' AS none FROM lineitem)
SELECT l_orderkey, l_linenumber, round(p, 9) AS plus, round(1 / (1 + exp(m - p)), 9) AS p_plus, round(CASE WHEN none THEN 0 ELSE 1 / (1 + exp(m - p)) END, 9) AS score, round(CASE WHEN none THEN -1 ELSE 2 / (1 + exp(m - p)) - 1 END, 9) AS margin FROM l"""
)
def answer_scores(spark: SparkSession, sf: str) -> DataFrame:
    plus, minus = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10), F.array(F.col("l_quantity") / 50, F.col("l_discount"))
    p = S.plus_minus(plus, minus)[0]
    score, margin = S.score_final(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), p)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.log_sum_exp(plus), 9).alias("plus"), F.round(p, 9).alias("p_plus"), F.round(score, 9).alias("score"), F.round(margin, 9).alias("margin"))


# --- Exports and results ----------------------------------------------------------------------
def order_questions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("qid"), F.lit("orders").alias("dataset"), F.col("o_orderpriority").alias("question"), F.array("o_orderstatus", "o_orderpriority").alias("docs"), F.col("o_orderstatus").alias("gold_answer"), F.col("o_orderpriority").alias("gold_answer_text"))


_PROMPT = _LIT(X.PAIR_PROMPT).replace("{docs}", "' || o_orderstatus || chr(10) || o_orderpriority || '").replace("{question}", "' || o_orderpriority || '")


@query(
    f"""WITH {_PAIRS}, y AS (SELECT *, min(i) OVER (PARTITION BY qid, sig) AS place FROM z QUALIFY row_number() OVER (PARTITION BY qid, sig ORDER BY margin DESC, i) = 1),
x AS (SELECT qid, a, b, i AS n, 'raw' AS kind, ta, tb FROM z UNION ALL SELECT qid, a, b, row_number() OVER (PARTITION BY qid ORDER BY place), 'dedup', ta, tb FROM y)
SELECT qid, kind, n AS pair_index, a AS chosen_trace_id, b AS rejected_trace_id, ta AS chosen, tb AS rejected, md5({_PROMPT}) AS prompt, o_orderstatus AS gold_answer FROM x JOIN orders ON qid = o_orderkey"""
)
def pair_exports(spark: SparkSession, sf: str) -> DataFrame:
    made, q = P.build_pairs(order_traces(spark, sf)), order_questions(spark, sf)
    out = P.export_pairs(made, q).withColumn("kind", F.lit("raw")).unionByName(P.export_pairs(P.dedup_pairs(made), q).withColumn("kind", F.lit("dedup")))
    return out.select("qid", "kind", "pair_index", "chosen_trace_id", "rejected_trace_id", "chosen", "rejected", F.md5("prompt").alias("prompt"), "gold_answer")


def tried(spark: SparkSession, sf: str) -> DataFrame:
    t = order_traces(spark, sf).withColumns({"is_valid": F.col("final_answer_score") > 0.3, "model": F.split("raw_generation", " ")[1]})
    return t


_VALID = _PAIRS.replace("FROM b),", "FROM b WHERE final_answer_score > 0.3::DOUBLE),").replace("t AS (SELECT *,", "every AS (SELECT qid, final_answer_score > 0.3::DOUBLE AS v, split_part(raw_generation, ' ', 2) AS model FROM o),\nt AS (SELECT *,")
_RESULT = f"""WITH {_VALID}, n AS (SELECT qid, count(*) AS n, count(DISTINCT sig) AS nd FROM z GROUP BY qid),
a AS (SELECT qid, count(*) AS tries, count(*) FILTER (v) AS valid, count(*) FILTER (model = 'O') AS o, count(*) FILTER (model = 'F') AS f FROM every GROUP BY qid),
gp AS (SELECT qid, max(trace_score) - min(trace_score) AS gap, arg_max(trace_id, row(trace_score, -sample_index)) AS best FROM t GROUP BY qid)"""


@query(
    _RESULT
    + """, mk AS (SELECT qid, string_agg(model || '=' || k, ',' ORDER BY model) AS told FROM (SELECT qid, model, count(*) AS k FROM every WHERE v GROUP BY ALL) GROUP BY qid)
SELECT a.qid, o_orderstatus AS gold_answer, valid AS num_valid_traces, tries - valid AS num_discarded_traces, tries AS all_attempts, a.o AS attempts_o, a.f AS attempts_f, coalesce(told, '') AS by_model, round(coalesce(gap, 0), 6) AS score_gap,
  coalesce(n, 0) AS raw_pair_count, coalesce(nd, 0) AS dedup_pair_count, CASE WHEN valid = 0 THEN 'no_valid_traces' WHEN n IS NULL THEN 'no_pairs' ELSE 'pairs' END AS outcome
FROM a JOIN orders ON a.qid = o_orderkey LEFT JOIN n ON a.qid = n.qid LEFT JOIN gp ON a.qid = gp.qid LEFT JOIN mk ON a.qid = mk.qid"""
)
def progress_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = tried(spark, sf)
    made = P.build_pairs(t.filter("is_valid"))
    p = P.progress_counters(t, made, P.dedup_pairs(made), order_questions(spark, sf), ("O", "F"))
    by = F.array_join(F.transform(F.map_entries("valid_traces_by_model"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return p.select("qid", "gold_answer", "num_valid_traces", "num_discarded_traces", "all_attempts", F.col("attempts_O").alias("attempts_o"), F.col("attempts_F").alias("attempts_f"), by.alias("by_model"), F.round("score_gap", 6).alias("score_gap"), "raw_pair_count", "dedup_pair_count", "outcome")


@query(
    _RESULT
    + """, v AS (SELECT qid, final_answer AS answer, round(sum(trace_score), 9) AS total, round(avg(final_answer_score), 9) AS fin, min(sample_index) AS f FROM t GROUP BY ALL),
w AS (SELECT qid, answer FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY total DESC, fin DESC, f) = 1),
k AS (SELECT qid, string_agg(trace_id, ',' ORDER BY trace_score DESC, sample_index) AS ids FROM t GROUP BY qid)
SELECT a.qid, coalesce(ids, '') AS ranked, best, answer AS voted, tries - valid AS n_discarded, coalesce(n, 0) AS n_pairs, nd AS n_dedup, round(coalesce(gap, 0), 6) AS score_gap
FROM a JOIN orders ON a.qid = o_orderkey LEFT JOIN n ON a.qid = n.qid LEFT JOIN gp ON a.qid = gp.qid LEFT JOIN w ON a.qid = w.qid LEFT JOIN k ON a.qid = k.qid"""
)
def question_results(spark: SparkSession, sf: str) -> DataFrame:
    """The nested result of every question, told by some of its parts."""
    t = tried(spark, sf)
    r = P.question_results(t.drop("p"), P.build_pairs(t.filter("is_valid")), order_questions(spark, sf))
    return r.select(
        "qid", F.array_join(F.transform("ranked_traces", lambda x: x["trace_id"]), ",").alias("ranked"), F.col("best_of_n.trace_id").alias("best"), F.col("sc_rm.selected_answer_by_sc_rm").alias("voted"),
        F.size("discarded_traces").cast("long").alias("n_discarded"), F.size("dpo_pairs").cast("long").alias("n_pairs"), F.col("pair_diagnostics.n_dedup_pairs").alias("n_dedup"), F.round("score_gap", 6).alias("score_gap"),
    )


@query("SELECT doc_id, regexp_replace(coalesce(source, '') || '/' || left(coalesce(text, ''), 40), '[^A-Za-z0-9_.-]+', '_', 'g') AS name FROM documents")
def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.substring(F.coalesce("text", F.lit("")), 1, 40))
    return table(spark, sf, "documents").select("doc_id", safe_name(name).alias("name"))
