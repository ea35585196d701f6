"""The three question sets from parquet files by split, unified and question files as JSON lines, and what of them exists."""

from __future__ import annotations

import html.entities
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import unify as U
from .tables import numbered, read_jsonl

#: File of each split below the folder of a set.
SPLIT_FILES = {s: f"{s}-00000-of-00001.parquet" for s in ("train", "validation", "test")}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there, in their order; a warning for each other."""
    for p in (missing := [p for p in paths if not exists(spark, p)]):
        warnings.warn(f"missing input: {p}", stacklevel=2)
    return [p for p in paths if p not in missing]


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN in columns of floating numbers is null."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def load_set(spark: SparkSession, folder: str, convert: Callable[[DataFrame, str, Column], DataFrame], files: dict[str, str] | None = None) -> DataFrame | None:
    """The rows of all splits that are there; ids count the rows of a file before any is left out. None without a file."""
    out = None
    files = files or SPLIT_FILES
    there = existing(spark, [f"{folder}/{f}" for f in files.values()])
    for split, name in files.items():
        if (path := f"{folder}/{name}") in there:
            df, at = numbered(spark, path)
            rows = convert(nan_as_null(df.withColumn("_row_index", at)), split, F.col("_row_index"))
            rows = rows.withColumn("meta", F.col("meta").withField("source_path", F.lit(path)))
            out = rows if out is None else out.unionByName(rows)
    return out


def load_medqa(spark: SparkSession, folder: str) -> DataFrame | None:
    return load_set(spark, folder, U.unify_keyed)


def load_medmcqa(spark: SparkSession, folder: str) -> DataFrame | None:
    return load_set(spark, folder, U.unify_columns)


def load_pubmedqa(spark: SparkSession, folder: str) -> DataFrame | None:
    """This set has a train split only."""
    return load_set(spark, folder, U.unify_decisions, {"train": SPLIT_FILES["train"]})


def load_questions(spark: SparkSession, paths: list[str], schema: T.StructType | str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Questions with evidence, file after file and line after line, ``most`` of them over all files, and the skip rows of those without that come before the last of them."""
    out = None
    for i, path in enumerate(existing(spark, paths)):
        place = F.struct(F.lit(i).alias("file"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        rows = read_jsonl(spark, path, schema).withColumn("_place", place)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], schema).withColumn("_place", F.struct(F.lit(0).alias("file")))
    if out.filter("qid IS NULL").limit(1).count():
        raise ValueError("a question has no qid")
    some, none = out.filter(F.size("docs") > 0), out.filter(F.coalesce(F.size("docs"), F.lit(0)) <= 0)
    if most:
        some = some.orderBy("_place").limit(most)
        end = some.agg(F.count("*").alias("n"), F.max("_place").alias("last")).first()  # one row
        if end.n == most:
            none = none.filter(F.col("_place") < F.struct(*[F.lit(x).alias(k) for k, x in end.last.asDict().items()]))
    return some.drop("_place"), none.select("qid", "dataset", F.lit("no_retrieved_docs").alias("reason"))


def unescape(text: Column) -> Column:
    """Character references with a semicolon, by number or by any of their names, as the characters that they stand for."""
    reference = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
    names = F.create_map(*[F.lit(x) for k, v in html.entities.html5.items() if k.endswith(";") for x in (k[:-1], v)])

    def character(name: Column) -> Column:
        digits = F.when(F.rlike(name, F.lit("^#[xX]")), F.upper(F.substring(name, 3, 6))).when(F.startswith(name, F.lit("#")), F.hex(F.substring(name, 2, 7).cast("long")))
        code = F.conv(digits, 16, 10).cast("long")
        known = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")).otherwise(F.try_element_at(names, name))

    parts, found = F.split(text, reference, -1), F.regexp_extract_all(text, F.lit(reference), F.lit(1))
    made = F.transform(found, lambda n, i: F.concat(F.coalesce(character(n), F.concat(F.lit("&"), n, F.lit(";"))), F.get(parts, i + 1)))
    return F.when(F.contains(text, F.lit("&")), F.concat(F.get(parts, F.lit(0)), F.array_join(made, ""))).otherwise(text)
