"""Keyword queries from question records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed import CASE_STOPWORDS, EXAM_STOPWORDS
from ..functions.text import tokenize
from ..functions.tokens import clean_tokens, content_tokens, dedupe, join_words, option_texts, option_tokens, phrase_tokens


def with_tokens(df: DataFrame) -> DataFrame:
    """Stages the token arrays as columns, so that none is computed twice. Columns that a record lacks are empty."""
    col = lambda n, empty: F.col(n) if n in df.columns else empty
    none = F.array().cast("array<string>")
    content = lambda t: content_tokens(t, CASE_STOPWORDS)
    options = col("options", F.create_map().cast("map<string,string>"))
    meta = df.schema["meta"].dataType.names if "meta" in df.columns else []
    inner = lambda n, empty: F.coalesce(F.col("meta")[n], empty) if n in meta else empty
    return df.withColumns(
        {
            "_q": clean_tokens(tokenize(F.col("question"))),
            "_q_exam": clean_tokens(tokenize(F.col("question")), EXAM_STOPWORDS),
            "_q_content": content(tokenize(F.col("question"))),
            "_context": clean_tokens(tokenize(col("context", F.lit("")))),
            "_topic": clean_tokens(tokenize(inner("topic_name", F.lit(""))), EXAM_STOPWORDS),
            "_subject": clean_tokens(tokenize(inner("subject_name", F.lit(""))), EXAM_STOPWORDS),
            "_opt3": option_tokens(options, CASE_STOPWORDS, 3),
            "_opt4": option_tokens(options, CASE_STOPWORDS, 4),
            "_opt": content(phrase_tokens(dedupe(option_texts(options)))),
            "_phrases": content(phrase_tokens(dedupe(inner("metamap_phrases", none)))),
            "_info": content(phrase_tokens(dedupe(F.array(inner("meta_info", F.lit("")))))),
        }
    )


def multi_candidates() -> Column:
    """Up to five queries: phrases, notes and question with the options, then options and phrases alone."""
    both = lambda a: join_words(dedupe(F.concat(a, "_opt")), 10)
    each = F.array(both("_phrases"), both("_info"), both("_q_content"), join_words(dedupe(F.col("_opt")), 8), join_words(dedupe(F.col("_phrases")), 8))
    return dedupe(each)


def exam_queries() -> tuple[Column, Column]:
    primary = join_words(dedupe(F.concat("_q_exam", "_topic", "_subject", "_opt3")), 12)
    return primary, join_words(dedupe(F.concat("_topic", "_opt4", F.slice("_q_exam", 1, 4))), 8)


def context_queries() -> tuple[Column, Column]:
    primary = F.array_join(dedupe(F.concat(F.slice("_q", 1, 8), F.slice("_context", 1, 10))), " ")
    return primary, join_words(dedupe(F.col("_q")), 10)


def default_query() -> Column:
    return join_words(dedupe(F.col("_q")), 12)


def build_queries(records: DataFrame, email: str = "") -> DataFrame:
    """Adds query, query_primary, query_fallback, query_candidates and retrieval_meta by the record's dataset."""
    kind = F.lower(F.col("dataset"))
    (ep, ef), (cp, cf) = exam_queries(), context_queries()
    two = lambda a, b: dedupe(F.array(a, b))
    out = with_tokens(records).withColumn("_multi", multi_candidates())
    candidates = F.when(kind == "medqa", F.col("_multi")).when(kind == "medmcqa", two(ep, ef)).when(kind == "pubmedqa", two(cp, cf)).otherwise(dedupe(F.array(default_query())))
    first = F.coalesce(F.get("_multi", F.lit(0)), F.lit(""))
    primary = F.when(kind == "medqa", first).when(kind == "medmcqa", ep).when(kind == "pubmedqa", cp).otherwise(default_query())
    fallback = F.when(kind == "medqa", F.coalesce(F.get("_multi", F.lit(1)), first)).when(kind == "medmcqa", ef).when(kind == "pubmedqa", cf).otherwise(default_query())
    out = out.withColumns({"query_primary": primary, "query_fallback": fallback, "query_candidates": candidates, "retrieval_meta": F.struct(F.lit("pubmed").alias("source"), F.lit(email).alias("contact_email"))})
    return out.withColumn("query", F.col("query_primary")).drop(*[c for c in out.columns if c.startswith("_")])


def sample_rows(df: DataFrame, n: int | None, key: str, seed: int = 42) -> DataFrame:
    """n rows by the order of a seeded hash, ties by key, and then in the order of their keys as strings; all for n null, not positive or too large. Top n of each partition first, so no sort of all rows."""
    if not n or n <= 0:
        return df
    rank = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return df.withColumn("_rank", rank).orderBy("_rank", key).limit(n).drop("_rank").orderBy(F.col(key).cast("string"))


def sample_by_group(df: DataFrame, n: int, group: str, key: str, seed: int = 42) -> DataFrame:
    rank = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return df.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(rank, key))).filter(F.col("_n") <= n).drop("_n")
