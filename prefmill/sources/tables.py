"""Scans and sinks: parquet, JSON lines, keyed caches, XML articles."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import normalize, year_of


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names; a temporary one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    path = f"{named or tempfile.mkdtemp(prefix='prefmill-')}/work-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(spark: SparkSession, path: str) -> tuple[DataFrame, Column]:
    """A parquet file and the column that is a row's place in it, before any filter."""
    df = spark.read.parquet(path)
    return df, F.col("_metadata.row_index")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Blank lines are skipped; a broken line or a missing path is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_if_any(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """As read_jsonl, but no rows if the path does not exist."""
    try:
        return read_jsonl(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], spark.read.schema(schema).json(spark.sparkContext.emptyRDD()).schema)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = ()) -> None:
    """One JSON object a line, nulls kept; partitioned by columns for a file set for each split."""
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    (w.partitionBy(*by) if by else w).json(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small JSON document, indented, over what was there."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, default=str).encode()))
    out.close()


def completed(spark: SparkSession, path: str, key: str = "qid") -> DataFrame:
    """Distinct keys of a result table that may not exist yet."""
    return read_jsonl_if_any(spark, path, f"{key} string").select(key).distinct()


def not_completed(rows: DataFrame, done: DataFrame, key: str = "qid") -> DataFrame:
    return rows.join(done, key, "left_anti")


def upsert(cache: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The cache with new rows in place of old ones of the same key."""
    return cache.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows as a table, so that they are made once; over what was there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a table that may be made from its own old rows: the new one takes the old one's place when it is complete.

    If a run ends between the two steps the old rows are at ``path``.old, where read_table_if_any finds them.
    """
    df.write.mode("overwrite").parquet(f"{path}.new")
    sc = df.sparkSession.sparkContext
    new, now, old = (sc._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.new", path, f"{path}.old"))
    fs = now.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.exists(now):
        fs.delete(old, True)
        fs.rename(now, old)
    fs.rename(new, now)
    fs.delete(old, True)


def read_table_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    for p in (path, f"{path}.old"):
        try:
            return spark.read.schema(schema).parquet(p)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema)


def safe_name(key: Column) -> Column:
    return F.regexp_replace(key, r"[^A-Za-z0-9_.-]+", "_")


def xml_article(xml: Column) -> Column:
    """The document (pmid, title, abstract, journal, year) of one article element: of its first Abstract only, with texts that were escaped twice unescaped."""
    from .loaders import unescape

    one = lambda p: F.xpath_string(xml, F.lit("//PubmedArticle" + p))
    told = lambda x: normalize(unescape(x))
    first = F.regexp_extract(xml, r"(?s)<Abstract(?:\s[^>]*)?>(.*?)</Abstract>", 1)
    sections = F.regexp_extract_all(first, F.lit(r"(?s)<AbstractText\b[^>]*?(?:/>|>.*?</AbstractText>)"), F.lit(0))

    def section(x: Column) -> Column:
        text, label = told(F.xpath_string(x, F.lit("/AbstractText"))), F.xpath_string(x, F.lit("/AbstractText/@Label"))
        return F.when((text != "") & (label != ""), F.concat(label, F.lit(": "), text)).otherwise(text)

    return F.struct(
        one("//MedlineCitation/PMID").alias("pmid"), told(one("//Article/ArticleTitle")).alias("title"), F.array_join(F.filter(F.transform(sections, section), lambda t: t != ""), "\n").alias("abstract"),
        told(one("//Article/Journal/Title")).alias("journal"), year_of(one("//Article/Journal/JournalIssue/PubDate/Year"), one("//Article/Journal/JournalIssue/PubDate/MedlineDate")).alias("year"),
    )


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Articles from XML files with a row for each PubmedArticle."""
    raw = spark.read.format("text").option("wholetext", "true").load(path)
    return articles(raw.select(F.col("value").alias("xml")))


def articles(raw: DataFrame) -> DataFrame:
    """pmid, title, abstract, journal, year of every article in the xml column: sections as 'LABEL: text', empty ones left out, tags inside titles flattened."""
    parts = raw.select(F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<PubmedArticle\b.*?</PubmedArticle>"), F.lit(0))).alias("a"))
    return parts.select(xml_article(F.col("a")).alias("d")).select("d.*")
