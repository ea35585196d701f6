"""All queries by name over the driver's tables and, for each, the same query as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..functions import tokens as K
from ..operators import pairs as P
from ..operators import queries as Q
from ..operators import retrieve as R
from ..operators import traces as S
from ..operators import unify as U
from ..sources.tables import articles, not_completed, table
from .seams import hash01

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- SQL forms of the expressions -------------------------------------------------------------
_IN = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
_NORM = lambda x: f"trim(regexp_replace(coalesce({x}, ''), '{X.WS}+', ' ', 'g'), ' ')"
_SHORT = lambda x, n: f"(CASE WHEN length({_NORM(x)}) > {n} THEN rtrim(left({_NORM(x)}, {n - 3}), ' ') || '...' ELSE {_NORM(x)} END)"
_TOK = lambda x: f"regexp_extract_all(lower({_NORM(x)}), '[a-zA-Z0-9\\-]+')"
_CLEAN = lambda a, extra=(): (
    f"list_filter({a}, lambda t: t IN {_IN(X.KEEP_SHORT)} OR NOT (t IN {_IN(sorted({*X.GENERAL_STOPWORDS, *extra}))} OR regexp_full_match(t, '\\d+|\\d+-(year|month)-old') OR length(t) <= 2))"
)
_CONTENT = lambda a: f"list_filter({a}, lambda t: t IN {_IN(X.KEEP_SHORT)} OR length(t) >= 5 OR regexp_matches(t, '({'|'.join(X.CONTENT_SUFFIXES)})$'))"
_DEDUPE = lambda a: f"list_transform(list_filter(list_zip({a}, range(1, len({a}) + 1)), lambda x: x[1] <> '' AND list_position({a}, x[1]) = x[2]), lambda x: x[1])"
_JOIN = lambda a, n: f"coalesce(array_to_string(({a})[1:{n}], ' '), '')"
_HASH = lambda x: f"(CAST(('0x' || left(md5({x}), 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


# --- Text -------------------------------------------------------------------------------------
@query(f"SELECT doc_id, {_NORM('text')} AS t, {_SHORT('text', 300)} AS s FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normalize(F.col("text")).alias("t"), T.shorten(F.col("text"), 300).alias("s"))


@query(f"WITH t AS (SELECT doc_id, {_TOK('text')} AS a FROM documents) SELECT doc_id, len(a) AS n, array_to_string({_CLEAN('a')}, ' ') AS clean, array_to_string({_CONTENT(_CLEAN('a', X.CASE_STOPWORDS))}, ' ') AS content FROM t")
def tokenize_clean(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", T.tokenize(F.col("text")).alias("a"))
    return t.select("doc_id", F.size("a").cast("long").alias("n"), F.array_join(K.clean_tokens(F.col("a")), " ").alias("clean"), F.array_join(K.content_tokens(F.col("a"), X.CASE_STOPWORDS), " ").alias("content"))


_VARIANTS = ["{}", "{} Final Answer: (b)", "The answer is (C). {}", "{}\nAnswer: D", "Answer: (A) then {} final  answer : E", "Final Answer: **(C)** {}"]
_ANSWER_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(x, '{p}', 1), '')" for p in X.ANSWER_PATTERNS) + ")"


@query(
    f"WITH v AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations), w AS ("
    + " UNION ALL ".join("SELECT conv_id, turn, {} AS k, '{}' || t || '{}' AS x FROM v".format(i, *p.split("{}")) for i, p in enumerate(_VARIANTS))
    + f") SELECT conv_id, turn, k, upper({_ANSWER_SQL}) AS answer FROM w"
)
def extract_answer(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    each = [F.struct(F.lit(i).alias("k"), F.concat(F.lit(a), F.col("t"), F.lit(b)).alias("x")) for i, (a, b) in enumerate(p.split("{}") for p in _VARIANTS)]
    return c.select("conv_id", "turn", F.explode(F.array(*each)).alias("v")).select("conv_id", "turn", "v.k", T.final_answer(F.col("v.x")).alias("answer"))


_STRIP = lambda x: f"regexp_replace({x}, '^{X.WS}+|{X.WS}+$', '', 'g')"
_TRACE = lambda x: _STRIP(f"regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _step_sql(x: str) -> str:
    x = _STRIP(x)
    for p in (rf"^\*+{X.WS}*", rf"^#+{X.WS}*", rf"(?i)^Step{X.WS}*\d+{X.WS}*[:\-]{X.WS}*", rf"^\d+[.)]{X.WS}*", rf"^[-*]{X.WS}*"):
        x = f"regexp_replace({x}, '{p}', '')"
    return _STRIP(f"regexp_replace({x}, '^\\*+|\\*+$', '', 'g')")


_LOW = lambda x: (
    f"(length({x}) < 25 OR list_contains(list_transform([{_IN(X.LOW_VALUE_PREFIXES)[1:-1]}], lambda p: starts_with(lower({x}), p)), true) OR regexp_full_match({x}, '(?i)\\(?[A-E]\\)?') OR regexp_full_match({x}, '[A-Za-z ]{{1,30}}:'))"
)
_CUT = "|".join([f"{X.WS}*;{X.WS}*", *(f"{X.WS}+{w}{X.WS}+" for w in ("therefore,", "however,", "but", "because", "which means"))])
_PARTS = lambda x: f"list_transform(list_filter(string_split_regex({x}, '(?i){_CUT}'), lambda y: {_STRIP('y')} <> ''), lambda y: regexp_replace(y, '^[ ,;:]+|[ ,;:]+$', '', 'g'))"
_SUB = lambda x: f"(CASE WHEN length({x}) <= 220 OR len({_PARTS(x)}) < 2 THEN [{x}] ELSE {_PARTS(x)} END)"
_MARK = f"(?i)\\b(Step{X.WS}*\\d+{X.WS}*[:\\-])"
_SOME = lambda a: f"list_filter(list_transform({a}, lambda y: {_STRIP('y')}), lambda y: y <> '')"


@query(f"""WITH a AS (SELECT conv_id, turn, {_STRIP(f"regexp_replace({_TRACE("coalesce(text, '')")}, '(?i)Final{X.WS}*Answer{X.WS}*:[^" + chr(92) + "n]*', '', 'g')")} AS t FROM conversations),
b AS (SELECT *, {_SOME('string_split(t, chr(10))')} AS ls FROM a),
c AS (SELECT *, list_transform(list_filter(ls, lambda y: regexp_matches(y, '^(\\d+[.)]|[-*]){X.WS}+')), lambda y: {_STRIP(f"regexp_replace(y, '^(" + chr(92) + f"d+[.)]|[-*]){X.WS}+', '')")}) AS num, list_filter(ls, lambda y: NOT regexp_matches(y, '^(\\d+[.)]|[-*]){X.WS}+')) AS plain FROM b),
d AS (SELECT conv_id, turn, t, CASE WHEN regexp_matches(t, '{_MARK}') THEN {_SOME(f"string_split(regexp_replace(t, '{_MARK}', chr(1) || '" + chr(92) + "1', 'g'), chr(1))")} WHEN len(num) >= 2 THEN num
  ELSE {_SOME(f"string_split(regexp_replace(CASE WHEN len(plain) > 0 THEN array_to_string(plain, ' ') ELSE t END, '([.!?]){X.WS}+', '" + chr(92) + "1' || chr(1), 'g'), chr(1))")} END AS c FROM c),
e AS (SELECT conv_id, turn, t, list_filter(list_transform(c, lambda x: {_step_sql('x')}), lambda x: x <> '') AS c FROM d),
f AS (SELECT conv_id, turn, t, list_transform(flatten(list_transform(c, lambda x: {_SUB('x')})), lambda x: {_step_sql('x')}) AS c FROM e),
g AS (SELECT conv_id, turn, {_step_sql('t')} AS w, list_filter(c, lambda x: x <> '' AND NOT {_LOW('x')}) AS c FROM f),
h AS (SELECT conv_id, turn, w, c, list_transform(c, lambda x: lower(x)) AS low FROM g),
i AS (SELECT conv_id, turn, w, list_filter(c, lambda x, i: list_position(low, lower(x)) = i) AS c FROM h),
j AS (SELECT conv_id, turn, CASE WHEN len(c) > 0 THEN c WHEN w <> '' AND NOT {_LOW('w')} THEN [w] ELSE [] END AS s FROM i)
SELECT conv_id, turn, CAST(len(s) AS INTEGER) AS n, coalesce(array_to_string(s, chr(10)), '') AS steps FROM j""")
def split_steps(spark: SparkSession, sf: str) -> DataFrame:
    steps = T.reasoning_steps(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", steps.alias("s")).select("conv_id", "turn", F.size("s").alias("n"), F.array_join("s", "\n").alias("steps"))


@query(f"""WITH a AS (SELECT conv_id, turn, {_TRACE("coalesce(text, '')")} AS t, {_step_sql("'  **Step 3: - ' || coalesce(text, '') || '** '")} AS s, {_STRIP("coalesce(text, '')")} AS raw FROM conversations)
SELECT conv_id, turn, md5(t) AS trace, md5(s) AS step, {_LOW('raw')} AS low, CAST(len({_SUB('raw')}) AS INTEGER) AS n_parts, md5(array_to_string({_SUB('raw')}, '|')) AS parts FROM a""")
def step_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.coalesce("text", F.lit(""))
    parts = T.substeps(raw)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(T.clean_trace(raw)).alias("trace"), F.md5(T.clean_step(F.concat(F.lit("  **Step 3: - "), raw, F.lit("** ")))).alias("step"),
        T.low_value(raw).alias("low"), F.size(parts).alias("n_parts"), F.md5(F.array_join(parts, "|")).alias("parts"),
    )


_XML = "regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS pmid, 'On ' || lang AS title, CASE WHEN {_NORM(_XML)} = '' THEN '' ELSE 'BACKGROUND: ' || {_NORM(_XML)} END AS abstract, source AS journal, '1998' AS year FROM documents")
def abstract_xml(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as articles and parsed again."""
    e = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), F.col("doc_id").cast("string"), F.lit("</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>Spring 1998</MedlineDate></PubDate></JournalIssue><Title>"), e("source"),
        F.lit("</Title></Journal><ArticleTitle>On <i>"), e("lang"), F.lit("</i></ArticleTitle><Abstract><AbstractText Label=\"BACKGROUND\">"), e("text"), F.lit("</AbstractText><AbstractText/></Abstract></Article></MedlineCitation></PubmedArticle>"),
    )
    return articles(table(spark, sf, "documents").select(F.concat(F.lit("<PubmedArticleSet>"), F.regexp_replace(body, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), F.lit("</PubmedArticleSet>")).alias("xml")))


# --- Records and queries ----------------------------------------------------------------------
_PART = "p_partkey, p_name AS question, p_type AS a, p_brand AS b, p_name AS c, p_type || ' ' || p_brand AS d"


def part_questions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return U.unify_columns(
        p.select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.col("p_type").alias("opa"), F.col("p_brand").alias("opb"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("opc"),
            F.concat_ws(" ", "p_type", "p_brand").alias("opd"), (F.col("p_size") % 5).alias("cop"), F.col("p_type").alias("subject_name"), F.col("p_brand").alias("topic_name"),
        ), "train", F.col("id"),
    )


_PQ = f"""
r AS (SELECT p_partkey AS id, {_NORM('p_name')} AS q, {_NORM('p_type')} AS a, {_NORM('p_brand')} AS b, CASE WHEN p_size % 3 = 0 THEN '' ELSE {_NORM('p_name')} END AS c, {_NORM("p_type || ' ' || p_brand")} AS d, p_size % 5 AS cop FROM part),
u AS (SELECT *, 'medmcqa_train_' || lpad(CAST(id AS VARCHAR), 8, '0') AS qid, list_filter([a, b, c, d], lambda x: x <> '') AS opts,
      CASE cop WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 4 THEN 'D' ELSE '' END AS answer, CASE cop WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN c WHEN 4 THEN d ELSE '' END AS answer_text
      FROM r WHERE q <> '')"""


@query(f"WITH {_PQ} SELECT qid, 'medmcqa' AS dataset, q AS question, answer, answer_text, CAST(len(opts) AS BIGINT) AS n_options, array_to_string(opts, '|') AS options FROM u WHERE len(opts) >= 2")
def unify_mcq(spark: SparkSession, sf: str) -> DataFrame:
    u = part_questions(spark, sf)
    return u.select("qid", "dataset", "question", "answer", "answer_text", F.size("options").cast("long").alias("n_options"), F.array_join(K.option_texts(F.col("options")), "|").alias("options"))


@query(
    f"WITH l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'Yes' WHEN quality = 1 THEN 'no ' ELSE 'maybe' END AS said FROM labels) "
    f"SELECT 'pubmedqa_train_' || lpad(CAST(l.doc_id AS VARCHAR), 8, '0') AS qid, CASE trim(lower(said)) WHEN 'yes' THEN 'A' WHEN 'no' THEN 'B' ELSE 'C' END AS answer, trim(lower(said)) AS answer_text, {_NORM('text')} AS context "
    f"FROM l JOIN documents d ON l.doc_id = d.doc_id"
)
def unify_labels(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("toxic") == 1, "Yes").when(F.col("quality") == 1, "no ").otherwise("maybe")
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    rows = rows.select(F.col("doc_id").alias("pubid"), F.lit("Is it?").alias("question"), F.struct(F.array("text").alias("contexts")).alias("context"), said.alias("final_decision"))
    return U.unify_decisions(rows, "train", F.col("pubid")).select("qid", "answer", "answer_text", "context")


@query(f"""WITH p AS (SELECT p_partkey, {_NORM('p_name')} AS n, {_NORM('p_type')} AS t, {_NORM('p_brand')} AS b, p_size FROM part)
SELECT 'medqa_train_' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS qid, CASE WHEN p_size % 4 = 3 THEN 'B' ELSE CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END END AS answer,
CASE WHEN p_size % 4 IN (1, 3) THEN t WHEN p_size % 4 = 0 THEN n ELSE b END AS answer_text FROM p""")
def unify_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Options as a list; the answer as an index, or as a text in other case."""
    p = table(spark, sf, "part")
    rows = p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("question"), F.array("p_name", "p_type", "p_brand").alias("options"),
        F.when(F.col("p_size") % 4 == 3, F.lit(None)).otherwise((F.col("p_size") % 4).cast("string")).alias("answer_idx"), F.when(F.col("p_size") % 4 == 3, F.upper("p_type")).alias("answer"),
    )
    return U.unify_keyed(rows, "train", F.col("id")).select("qid", "answer", "answer_text")


@query(f"""WITH {_PQ} SELECT dataset, count(*) AS n FROM (SELECT 'medmcqa' AS dataset FROM u WHERE len(opts) >= 2 UNION ALL SELECT 'pubmedqa' FROM labels l JOIN documents d ON l.doc_id = d.doc_id) GROUP BY 1""")
def union_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    other = U.unify_decisions(rows.select(F.col("doc_id").alias("pubid"), F.lit("Is it?").alias("question"), F.col("text").alias("context")), "train", F.col("pubid"))
    return U.counts(U.union_all(part_questions(spark, sf), other)).select("dataset", "n")


def benchmark_questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.lit("other").alias("dataset"), F.col("text").alias("question"))


@query(f"WITH t AS (SELECT item_id, {_CLEAN(_TOK('text'))} AS a FROM benchmark) SELECT CAST(item_id AS VARCHAR) AS qid, {_JOIN(_DEDUPE('a'), 12)} AS query, CAST(CASE WHEN len(a) > 0 THEN 1 ELSE 0 END AS BIGINT) AS n FROM t")
def query_default(spark: SparkSession, sf: str) -> DataFrame:
    return Q.build_queries(benchmark_questions(spark, sf)).select("qid", "query", F.size("query_candidates").cast("long").alias("n"))


_OPT = lambda n: f"flatten(list_transform((opts)[1:{n}], lambda x: {_CLEAN(_TOK('x'), X.CASE_STOPWORDS)}))"


@query(
    f"""WITH {_PQ}, t AS (SELECT qid, {_CLEAN(_TOK('q'), X.EXAM_STOPWORDS)} AS qt, {_CLEAN(_TOK('b'), X.EXAM_STOPWORDS)} AS tt, {_CLEAN(_TOK('a'), X.EXAM_STOPWORDS)} AS st, {_OPT(3)} AS o3, {_OPT(4)} AS o4 FROM u WHERE len(opts) >= 2),
m AS (SELECT qid, list_concat(list_concat(qt, tt), list_concat(st, o3)) AS p, list_concat(list_concat(tt, o4), qt[1:4]) AS f FROM t)
SELECT qid, {_JOIN(_DEDUPE('p'), 12)} AS query, {_JOIN(_DEDUPE('f'), 8)} AS query_fallback FROM m"""
)
def query_mcq(spark: SparkSession, sf: str) -> DataFrame:
    return Q.build_queries(part_questions(spark, sf)).select("qid", "query", "query_fallback")


@query(
    f"""WITH b AS (SELECT item_id, {_CLEAN(_TOK('b.text'))} AS q, {_CLEAN(_TOK('d.text'))} AS c FROM benchmark b JOIN documents d ON b.item_id = d.doc_id),
m AS (SELECT item_id, q, list_concat(q[1:8], c[1:10]) AS p FROM b)
SELECT CAST(item_id AS VARCHAR) AS qid, {_JOIN(_DEDUPE('p'), 18)} AS query, {_JOIN(_DEDUPE('q'), 10)} AS query_fallback FROM m"""
)
def query_context(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").join(table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("context")), "item_id")
    b = b.select(F.col("item_id").cast("string").alias("qid"), F.lit("pubmedqa").alias("dataset"), F.col("text").alias("question"), "context")
    return Q.build_queries(b).select("qid", "query", "query_fallback")


_C = lambda x: _CONTENT(_CLEAN(x, X.CASE_STOPWORDS))


@query(
    f"""WITH {_PQ}, t AS (SELECT qid, {_C(_DEDUPE(f"flatten(list_transform({_DEDUPE('opts')}, lambda x: {_TOK('x')}))"))} AS o, {_C(_TOK('q'))} AS qt, {_C(_DEDUPE(_TOK('a')))} AS ph, {_C(_DEDUPE(_TOK('b')))} AS inf FROM u WHERE len(opts) >= 2),
m AS (SELECT qid, list_concat(ph, o) AS x1, list_concat(inf, o) AS x2, list_concat(qt, o) AS x3, o, ph FROM t),
c AS (SELECT qid, [{_JOIN(_DEDUPE('x1'), 10)}, {_JOIN(_DEDUPE('x2'), 10)}, {_JOIN(_DEDUPE('x3'), 10)}, {_JOIN(_DEDUPE('o'), 8)}, {_JOIN(_DEDUPE('ph'), 8)}] AS c FROM m)
SELECT qid, array_to_string({_DEDUPE('c')}, '|') AS candidates FROM c"""
)
def query_multi(spark: SparkSession, sf: str) -> DataFrame:
    p = part_questions(spark, sf).withColumn("dataset", F.lit("medqa"))
    p = p.withColumn("meta", F.struct(F.array("meta.subject_name").alias("metamap_phrases"), F.col("meta.topic_name").alias("meta_info")))
    return Q.build_queries(p).select("qid", F.array_join("query_candidates", "|").alias("candidates"))


# --- Retrieval and evidence -------------------------------------------------------------------
_SEARCH = f"""
q0 AS (SELECT CAST(item_id AS VARCHAR) AS qid, unnest([0, 1]) AS cand, {_CLEAN(_TOK('text'))} AS a FROM benchmark),
q AS (SELECT qid, cand, CASE cand WHEN 0 THEN {_JOIN(_DEDUPE('a'), 12)} ELSE {_JOIN(_DEDUPE('a'), 3)} END AS query FROM q0),
qt AS (SELECT DISTINCT qid, cand, unnest({_TOK('query')}) AS token FROM q),
dt AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS pmid, unnest({_TOK('text')}) AS token FROM documents),
h AS (SELECT qid, cand, pmid, count(*) AS score FROM qt JOIN dt USING (token) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, cand ORDER BY score DESC, pmid) AS rank FROM h QUALIFY rank <= 20)"""


def benchmark_search(spark: SparkSession, sf: str, match: str = "any") -> tuple[DataFrame, DataFrame]:
    b = Q.with_tokens(benchmark_questions(spark, sf))
    two = F.array(K.join_words(K.dedupe(F.col("_q")), 12), K.join_words(K.dedupe(F.col("_q")), 3))
    records = b.select("qid", "question", two.alias("query_candidates"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("pmid"), "text")
    return records, R.search(R.candidate_rows(records), docs, match=match)


@query(f"WITH {_SEARCH} SELECT qid, cand, pmid, score, rank FROM r")
def retrieve_topk(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark_search(spark, sf)[1]


_ALL = f"""WITH {_SEARCH}, n AS (SELECT qid, cand, count(*) AS n FROM qt GROUP BY ALL), ha AS (SELECT h.* FROM h JOIN n USING (qid, cand) WHERE score = n.n),
ra AS (SELECT *, row_number() OVER (PARTITION BY qid, cand ORDER BY score DESC, pmid) AS rank FROM ha QUALIFY rank <= 20),
l AS (SELECT qid, cand, string_agg(pmid, ',' ORDER BY rank) AS pmids FROM ra GROUP BY ALL),
f AS (SELECT qid, min(cand) AS cand FROM l GROUP BY qid)"""


@query(_ALL + " SELECT i.qid, CAST(coalesce(f.cand, -1) AS INTEGER) AS cand, coalesce(pmids, '') AS pmids FROM (SELECT DISTINCT qid FROM q) i LEFT JOIN f ON i.qid = f.qid LEFT JOIN l ON l.qid = f.qid AND l.cand = f.cand")
def first_nonempty(spark: SparkSession, sf: str) -> DataFrame:
    records, hits = benchmark_search(spark, sf, "all")
    return R.first_nonempty(records, hits).select("qid", "cand", F.array_join("pmids", ",").alias("pmids"))


def document_rows(spark: SparkSession, sf: str) -> DataFrame:
    records, hits = benchmark_search(spark, sf)
    documents = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("pmid"), F.col("lang").alias("title"), F.col("text").alias("abstract"), F.col("source").alias("journal"), F.lit("1999").alias("year"))
    options = F.create_map(F.lit("B"), F.lit("no"), F.lit("A"), F.lit("yes"))
    full = records.withColumns({"dataset": F.lit("medqa"), "split": F.lit("train"), "options": options, "answer": F.lit("A"), "answer_text": F.lit("yes")})
    return R.docs_records(full, R.fetch(R.first_nonempty(records, hits), documents))


def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    return R.evidence(document_rows(spark, sf))


_EVIDENCE = f"""WITH {_SEARCH}, f AS (SELECT qid, min(cand) AS cand FROM r GROUP BY qid), s AS (SELECT r.* FROM r JOIN f USING (qid, cand) WHERE rank <= 6),
d AS (SELECT qid, rank, 'Document ' || rank || ': PMID ' || pmid || ' | Title: ' || {_SHORT('lang', 300)} || ' | Source: ' || {_NORM('source')} || ' 1999' || CASE WHEN {_NORM('text')} = '' THEN '' ELSE ' | Abstract: ' || {_SHORT('text', 1800)} END AS x
      FROM s JOIN documents ON CAST(doc_id AS VARCHAR) = pmid),
e AS (SELECT qid, string_agg(x, chr(10) ORDER BY rank) AS docs, count(*) AS n FROM d GROUP BY qid),
b AS (SELECT CAST(item_id AS VARCHAR) AS qid, {_NORM('text')} || chr(10) || chr(10) || '(A) yes' || chr(10) || '(B) no' AS question FROM benchmark)"""


@query(_EVIDENCE + " SELECT b.qid, question, coalesce(docs, '') AS docs, CAST(coalesce(n, 0) AS BIGINT) AS num_docs FROM b LEFT JOIN e ON b.qid = e.qid")
def evidence_docs(spark: SparkSession, sf: str) -> DataFrame:
    return evidence_rows(spark, sf).select("qid", "question", F.array_join("docs", "\n").alias("docs"), F.col("num_docs").cast("long").alias("num_docs"))


@query(
    _EVIDENCE
    + ", p AS (SELECT b.qid, '"
    + X.PAIR_PROMPT.replace("'", "''").replace("{docs}", "' || docs || '").replace("{question}", "' || question || '")
    + "' AS prompt FROM b JOIN e ON b.qid = e.qid) SELECT qid, md5(prompt) AS digest, CAST(length(prompt) AS BIGINT) AS n, "
    + _HASH("prompt")
    + " AS p_plus FROM p"
)
def prompt_scores(spark: SparkSession, sf: str) -> DataFrame:
    some, _ = R.split_by_evidence(evidence_rows(spark, sf))
    p = some.select("qid", T.pair_prompt(F.col("question"), F.col("docs")).alias("prompt"))
    return p.select("qid", F.md5("prompt").alias("digest"), F.length("prompt").cast("long").alias("n"), hash01(F.col("prompt")).alias("p_plus"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) <= 100")
def subset_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: its size is the feature."""
    return Q.sample_rows(table(spark, sf, "documents").select("doc_id", "source"), 100, "doc_id")


@query("SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS pmid FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def cache_anti(spark: SparkSession, sf: str) -> DataFrame:
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("pmids"))
    return R.missing_documents(lists, table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").cast("string").alias("pmid")))


@query("SELECT o_orderkey AS qid, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("qid")).distinct()
    return not_completed(table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), "o_orderstatus"), done)


@query("SELECT o_orderkey AS qid, n, n = 0 AS miss FROM (SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS n FROM orders)")
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of documents by key; an empty or absent one is a miss."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"))
    few = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.array_compact(F.collect_list(F.when(F.col("l_quantity") > 45, F.col("l_partkey").cast("string")))).alias("pmids"))
    hit, miss = R.with_query_cache(o, few)
    return hit.select("qid", F.size("pmids").cast("long").alias("n"), F.lit(False).alias("miss")).union(miss.select("qid", F.lit(0).cast("long"), F.lit(True)))


# --- Traces and pairs -------------------------------------------------------------------------
_TRACES = f"""
o AS (SELECT l_orderkey AS qid, l_returnflag AS final_answer, CASE l_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS gold_answer, [l_discount * 10, l_tax * 12.5::DOUBLE, l_quantity / 50] AS p, l_quantity / 50 AS final_answer_score,
  l_returnflag || ' ' || l_linestatus || ' ' || CAST(CAST(l_quantity AS BIGINT) % 4 AS VARCHAR) AS raw_generation, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS sample_index FROM lineitem),
s AS (SELECT *, qid || '_' || sample_index AS trace_id, list_min(p) AS min_step_score, list_reduce(p, lambda x, y: x + y) / 3 AS mean_step_score,
  CASE WHEN p[1] < 0.5 THEN 0 WHEN p[2] < 0.5 THEN 1 WHEN p[3] < 0.5 THEN 2 ELSE 3 END AS prefix_high_len FROM o),
b AS (SELECT *, prefix_high_len / 3.0::DOUBLE AS prefix_high_ratio, CASE WHEN final_answer = gold_answer THEN {X.GOLD_BONUS}::DOUBLE ELSE {X.GOLD_PENALTY}::DOUBLE END AS bonus FROM s),
t AS (SELECT *, {X.MIN_STEP_WEIGHT}::DOUBLE * min_step_score + {X.MEAN_STEP_WEIGHT}::DOUBLE * mean_step_score + {X.PREFIX_WEIGHT}::DOUBLE * prefix_high_ratio + {X.FINAL_WEIGHT}::DOUBLE * final_answer_score + bonus AS trace_score FROM b)"""


def order_traces(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    li = table(spark, sf, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    t = li.select(
        F.col("l_orderkey").alias("qid"), F.col("l_returnflag").alias("final_answer"), F.get(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.pmod("l_orderkey", F.lit(3)).cast("int")).alias("gold_answer"),
        F.array(F.col("l_discount") * 10, F.col("l_tax") * 12.5, F.col("l_quantity") / 50).alias("p"), (F.col("l_quantity") / 50).alias("final_answer_score"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus", (F.col("l_quantity").cast("long") % 4).cast("string")).alias("raw_generation"), (F.row_number().over(w) - 1).alias("sample_index"),
    )
    t = t.withColumn("trace_id", F.concat_ws("_", F.col("qid").cast("string"), F.col("sample_index").cast("string"))).withColumns(S.step_summary(F.col("p")))
    return S.trace_scores(t)


@query(f"WITH {_TRACES} SELECT trace_id, round(min_step_score, 6) AS lo, round(mean_step_score, 6) AS mean, prefix_high_len, round(trace_score, 6) AS score FROM t")
def trace_score(spark: SparkSession, sf: str) -> DataFrame:
    return order_traces(spark, sf).select("trace_id", F.round("min_step_score", 6).alias("lo"), F.round("mean_step_score", 6).alias("mean"), "prefix_high_len", F.round("trace_score", 6).alias("score"))


@query(f"WITH {_TRACES} SELECT qid, trace_id, round(trace_score, 6) AS score FROM t QUALIFY row_number() OVER (PARTITION BY qid ORDER BY trace_score DESC, sample_index) = 1")
def rank_best(spark: SparkSession, sf: str) -> DataFrame:
    return P.best_of_n(order_traces(spark, sf)).select("qid", "trace_id", F.round("trace_score", 6).alias("score"))


@query(
    f"""WITH {_TRACES}, c AS (SELECT qid, final_answer AS answer, count(*) AS n, sum(trace_score) AS total, avg(trace_score) AS mean, max(trace_score) AS best, avg(final_answer_score) AS fin, min(sample_index) AS f FROM t GROUP BY ALL)
SELECT qid, answer, n AS count, round(total, 9) AS total_score, round(mean, 9) AS mean_score, round(best, 9) AS best_score, row_number() OVER (PARTITION BY qid ORDER BY round(total, 9) DESC, round(fin, 9) DESC, f) AS rank FROM c"""
)
def vote(spark: SparkSession, sf: str) -> DataFrame:
    v = P.vote(order_traces(spark, sf))
    return v.select("qid", "answer", "count", *[F.round(c, 9).alias(c) for c in ("total_score", "mean_score", "best_score")], "rank")


_PAIRS = f"""{_TRACES},
g AS (SELECT *, max(trace_score) OVER (PARTITION BY qid) - min(trace_score) OVER (PARTITION BY qid) AS gap, count(*) OVER (PARTITION BY qid) AS n FROM t QUALIFY n >= 2),
c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY trace_score DESC, sample_index) AS r FROM g WHERE final_answer = gold_answer AND final_answer_score >= {X.CHOSEN_FINAL}::DOUBLE QUALIFY r <= 4),
j AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY trace_score, sample_index) AS r FROM g WHERE final_answer <> gold_answer OR final_answer_score <= {X.REJECTED_FINAL}::DOUBLE QUALIFY r <= 4),
m AS (SELECT c.qid, c.trace_id AS a, j.trace_id AS b, c.trace_score - j.trace_score AS margin, c.final_answer = j.final_answer AS same, c.raw_generation AS ta, j.raw_generation AS tb, c.r AS ra, j.r AS rb FROM c JOIN j ON c.qid = j.qid
  WHERE c.trace_id <> j.trace_id AND c.trace_score - j.trace_score >= greatest({X.MIN_MARGIN}::DOUBLE, {X.MARGIN_SHARE}::DOUBLE * c.gap) AND c.final_answer_score - j.final_answer_score >= {X.MIN_FINAL_DIFF}::DOUBLE),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY NOT same, ra, rb) AS i FROM m QUALIFY i <= 12),
z AS (SELECT *, md5(left({_NORM('lower(ta)')}, 250)) || '__' || md5(left({_NORM('lower(tb)')}, 250)) AS sig FROM p)"""


@query(f"WITH {_PAIRS} SELECT qid, a AS chosen_trace_id, b AS rejected_trace_id, round(margin, 6) AS score_margin, CASE WHEN same THEN 'same_answer' ELSE 'cross_answer' END AS pair_type, i AS pair_index FROM p")
def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return P.build_pairs(order_traces(spark, sf)).select("qid", "chosen_trace_id", "rejected_trace_id", F.round("score_margin", 6).alias("score_margin"), "pair_type", "pair_index")


@query(
    f"""WITH {_PAIRS}, y AS (SELECT *, min(i) OVER (PARTITION BY qid, sig) AS place FROM z QUALIFY row_number() OVER (PARTITION BY qid, sig ORDER BY margin DESC, i) = 1)
SELECT qid, a AS chosen_trace_id, b AS rejected_trace_id, row_number() OVER (PARTITION BY qid ORDER BY place) AS pair_index FROM y"""
)
def pair_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return P.dedup_pairs(P.build_pairs(order_traces(spark, sf))).select("qid", "chosen_trace_id", "rejected_trace_id", "pair_index")


@query(
    f"""WITH {_PAIRS} SELECT qid, count(*) AS n_pairs, count(*) FILTER (same) AS n_same_answer, count(*) FILTER (NOT same) AS n_cross_answer, count(DISTINCT md5({_NORM('lower(ta)')})) AS n_chosen_texts,
count(DISTINCT md5({_NORM('lower(tb)')})) AS n_rejected_texts, count(DISTINCT sig) AS n_dedup_pairs FROM z GROUP BY qid"""
)
def pair_diag(spark: SparkSession, sf: str) -> DataFrame:
    return P.pair_diagnostics(P.build_pairs(order_traces(spark, sf)))


@query(
    f"""WITH {_PAIRS}, n AS (SELECT qid, count(*) AS n FROM p GROUP BY qid), a AS (SELECT qid, count(*) AS n_attempts, count(*) FILTER (final_answer_score > 0.3::DOUBLE) AS n_valid,
coalesce(max(trace_score) FILTER (final_answer_score > 0.3::DOUBLE) - min(trace_score) FILTER (final_answer_score > 0.3::DOUBLE), 0) AS gap FROM t GROUP BY qid)
SELECT a.qid, n_attempts, n_valid, round(gap, 6) AS score_gap, coalesce(n, 0) AS n_pairs, CASE WHEN n_valid = 0 THEN 'no_valid_traces' WHEN n IS NULL THEN 'no_pairs' ELSE 'pairs' END AS outcome FROM a LEFT JOIN n ON a.qid = n.qid"""
)
def progress_report(spark: SparkSession, sf: str) -> DataFrame:
    t = order_traces(spark, sf)
    return P.progress(t.withColumn("is_valid", F.col("final_answer_score") > 0.3), P.build_pairs(t)).withColumn("score_gap", F.round("score_gap", 6))


@query("SELECT l_orderkey AS qid, string_agg(k || '=' || n, ',' ORDER BY k) AS histogram FROM (SELECT l_orderkey, l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def histograms(spark: SparkSession, sf: str) -> DataFrame:
    h = P.answer_histogram(order_traces(spark, sf))
    return h.select("qid", F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("histogram"))


@query(
    _EVIDENCE + " SELECT b.qid, 'medqa' AS dataset, 'no_retrieved_docs' AS reason FROM b LEFT JOIN e ON b.qid = e.qid WHERE n IS NULL"
    " UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'orders', 'no_retrieved_docs' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"
)
def skip_report(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("docs"))
    o = table(spark, sf, "orders").join(docs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = o.select(F.col("o_orderkey").cast("string").alias("qid"), F.lit("orders").alias("dataset"), F.coalesce("docs", F.array().cast("array<string>")).alias("docs"))
    return R.split_by_evidence(evidence_rows(spark, sf))[1].union(R.split_by_evidence(o)[1])


@query(
    """WITH e AS (SELECT user_id AS qid, event_id % 2 AS m, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS attempt, CASE event_type WHEN 'error' THEN NULL ELSE event_type END AS answer,
  CAST(floor(value) AS BIGINT) % 11 AS steps FROM events QUALIFY attempt <= 24),
v AS (SELECT *, CASE WHEN answer IS NULL THEN 'missing_final_answer' WHEN steps < 3 THEN 'too_few_scored_steps' WHEN steps > 8 THEN 'too_many_scored_steps' ELSE 'ok' END AS reason FROM e),
a AS (SELECT *, CASE reason WHEN 'ok' THEN 1 ELSE 0 END AS one FROM v),
f AS (SELECT *, coalesce(sum(one) OVER (PARTITION BY qid, m ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 4 AS first FROM a),
k AS (SELECT *, CASE WHEN NOT first THEN row_number() OVER (PARTITION BY qid, m, first ORDER BY attempt) - 1 END AS k, coalesce(sum(one) FILTER (first) OVER (PARTITION BY qid), 0) AS have FROM f),
n AS (SELECT *, coalesce(sum(one) FILTER (NOT first) OVER (PARTITION BY qid ORDER BY first, k, m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS more FROM k)
SELECT qid, m AS model_rank, attempt, reason, CASE WHEN first THEN 1 ELSE 2 END AS phase, row_number() OVER (PARTITION BY qid ORDER BY NOT first, CASE WHEN first THEN m ELSE k END, CASE WHEN first THEN attempt ELSE m END) - 1 AS sample_index
FROM n WHERE first OR have + more < 8"""
)
def sample_budget(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = table(spark, sf, "events").withColumn("model_rank", F.col("event_id") % 2)
    e = e.withColumn("attempt", F.row_number().over(W.partitionBy("user_id", "model_rank").orderBy("event_id")))
    answer, steps = F.when(F.col("event_type") != "error", F.col("event_type")), F.floor("value") % 11
    e = e.select(F.col("user_id").alias("qid"), "model_rank", "attempt", S.validity(answer, steps).alias("reason"))
    return S.sample_budget(e.withColumn("valid", F.col("reason") == "ok")).drop("valid")
