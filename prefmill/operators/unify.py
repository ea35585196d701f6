"""Differently shaped question sets to one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize, strip


def letter(i: Column) -> Column:
    return F.char(i + 65)


def first_of(df: DataFrame, *names: str) -> Column:
    """The first non-null of the columns that exist."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def question_id(dataset: str, split: str, position: Column) -> Column:
    return F.concat(F.lit(f"{dataset}_{split}_"), F.lpad(position.cast("string"), 8, "0"))


def entries_map(entries: Column) -> Column:
    """A map of (key, value) entries without empty values; of equal keys the last holds."""
    full = F.filter(entries, lambda e: e["value"] != "")
    last = F.filter(full, lambda e, i: ~F.exists(F.slice(full, i + 2, F.size(full)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def standard_record(df: DataFrame) -> DataFrame:
    """Normalises question and options, drops empty options and looks up the answer's text. Rows without a question or with fewer than two options go."""
    options = F.map_filter(F.transform_values("options", lambda k, v: normalize(v)), lambda k, v: v != "")
    df = df.withColumns({"question": normalize(F.col("question")), "options": options, "answer": F.coalesce("answer", F.lit("")), "context": normalize(F.col("context"))})
    df = df.filter((F.col("question") != "") & (F.size("options") >= 2))
    return df.withColumn("answer_text", F.coalesce(F.try_element_at("options", F.col("answer")), F.lit("")))


def flat_strings(c: Column, kind: T.DataType) -> Column:
    """The distinct texts of a column of any shape, depth first: values of lists, maps and structs, without names and keys; none of null."""

    def leaves(x: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            inner = [leaves(x[f.name], f.dataType) for f in kind]
            return F.concat(*inner) if inner else F.array().cast("array<string>")
        if isinstance(kind, T.MapType):
            return F.coalesce(F.flatten(F.transform(F.map_values(x), lambda v: leaves(v, kind.valueType))), F.array().cast("array<string>"))
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.flatten(F.transform(x, lambda v: leaves(v, kind.elementType))), F.array().cast("array<string>"))
        return F.array(normalize(x.cast("string")))

    return F.array_distinct(F.filter(leaves(c, kind), lambda x: x != ""))


def keyed_options(df: DataFrame, name: str = "options") -> Column:
    """(key, value) entries of any of the known shapes of an options column, decided by its type."""
    kind, c = df.schema[name].dataType, F.col(name)
    entry = lambda k, v: F.struct(k.alias("key"), normalize(v.cast("string")).alias("value"))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(c, lambda e: entry(F.upper(strip(e["key"].cast("string"))), e["value"]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e, i: entry(letter(i), e))
    if isinstance(kind, T.StructType) and {"text", "label"} <= set(kind.names):
        return F.transform(c["text"], lambda e, i: entry(F.coalesce(F.get(c["label"], i), letter(i)), e))
    if isinstance(kind, T.StructType):
        c = F.map_from_arrays(F.array(*[F.lit(n) for n in kind.names]), F.array(*[c[n].cast("string") for n in kind.names]))
    every = F.transform(F.map_entries(c), lambda e: entry(F.upper(strip(e["key"])), e["value"]))
    direct = F.filter(every, lambda e: F.rlike(e["key"], F.lit(r"\A[A-F]\z")) & (e["value"] != ""))
    digits = F.filter(every, lambda e: F.rlike(e["key"], F.lit(r"\A\d+\z")) & (e["value"] != ""))
    numeric = F.transform(digits, lambda e: F.struct(letter(e["key"].cast("int")).alias("key"), e["value"].alias("value")))
    return F.when(F.size(direct) >= 2, direct).when(F.size(numeric) >= 2, numeric)


def resolve_answer(options: Column, answer_idx: Column, answer: Column) -> Column:
    """An option key, else a 0-based index, else the answer as a key, else as an option's text in any case; empty if nothing fits."""
    idx, ans = F.upper(normalize(answer_idx)), normalize(answer)
    keys = F.map_keys(options)
    known = lambda k: F.when(F.array_contains(keys, k), k)
    same = F.filter(F.map_entries(options), lambda e: F.lower(e["value"]) == F.lower(ans))
    return F.coalesce(known(idx), known(letter(F.try_to_number(idx, F.lit("9999")).cast("int"))), known(F.upper(ans)), F.get(same, 0)["key"], F.lit(""))


def unify_keyed(df: DataFrame, split: str, position: Column, dataset: str = "medqa") -> DataFrame:
    """Rows with options in any shape and an answer by key, index or text."""
    out = df.withColumn("_position", position).withColumn("_options", keyed_options(df)).filter("_options IS NOT NULL")
    out = out.withColumn("_map", entries_map(F.col("_options")))
    notes = {c: (flat_strings(F.col(c), df.schema[c].dataType) if c in df.columns else F.array().cast("array<string>")) for c in ("meta_info", "metamap_phrases")}
    meta = F.struct(
        F.lit(dataset).alias("source_dataset"), F.lit(split).alias("source_split"), first_of(df, "id").cast("string").alias("original_id"),
        F.array_join(notes["meta_info"], " ").alias("meta_info"), notes["metamap_phrases"].alias("metamap_phrases"),
    )
    return standard_record(
        out.select(
            question_id(dataset, split, F.col("_position")).alias("qid"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), first_of(df, "question").alias("question"),
            F.col("_map").alias("options"), resolve_answer(F.col("_map"), first_of(df, "answer_idx"), first_of(df, "answer")).alias("answer"), F.lit("").alias("context"), meta.alias("meta"),
        )
    )


def unify_columns(df: DataFrame, split: str, position: Column, label_base: int = 1, dataset: str = "medmcqa") -> DataFrame:
    """Rows with an option a column and the answer as a number from ``label_base`` on, or as a letter."""
    texts = [first_of(df, *x) for x in (("opa", "option_a", "A"), ("opb", "option_b", "B"), ("opc", "option_c", "C"), ("opd", "option_d", "D"))]
    entries = F.array(*[F.struct(F.lit(k).alias("key"), normalize(x.cast("string")).alias("value")) for k, x in zip("ABCD", texts, strict=True)])
    given = F.upper(normalize(first_of(df, "cop", "answer", "label", "target").cast("string")))
    number = F.try_to_number(given, F.lit("9999")).cast("int") - label_base
    out = df.withColumn("_position", position).withColumn("_map", entries_map(entries))
    answer = F.when(number.between(0, 3), letter(number)).when(F.array_contains(F.map_keys("_map"), given), given).otherwise("")
    meta = F.struct(
        F.lit(dataset).alias("source_dataset"), F.lit(split).alias("source_split"), first_of(df, "id").cast("string").alias("original_id"),
        normalize(first_of(df, "subject_name")).alias("subject_name"), normalize(first_of(df, "topic_name")).alias("topic_name"),
    )
    return standard_record(
        out.select(
            question_id(dataset, split, F.col("_position")).alias("qid"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), first_of(df, "question", "query", "stem").alias("question"),
            F.col("_map").alias("options"), answer.alias("answer"), F.lit("").alias("context"), meta.alias("meta"),
        )
    )


def context_text(df: DataFrame, name: str) -> Column:
    """A text, a list of texts, a struct with a list of contexts, or else JSON."""
    kind, c = df.schema[name].dataType, F.col(name)
    joined = lambda a: normalize(F.array_join(F.filter(F.transform(a, normalize), lambda x: x != ""), " "))
    if isinstance(kind, T.ArrayType):
        return joined(c)
    if isinstance(kind, T.StructType):
        return joined(c["contexts"]) if "contexts" in kind.names else normalize(F.to_json(c))
    return normalize(c.cast("string"))


def unify_decisions(df: DataFrame, split: str, position: Column, dataset: str = "pubmedqa") -> DataFrame:
    """Rows answered by yes, no or maybe."""
    said = F.lower(normalize(first_of(df, "final_decision", "answer", "label").cast("string")))
    answer = F.when(said == "yes", "A").when(said == "no", "B").when(said.isin("maybe", "unknown"), "C").otherwise("")
    options = F.create_map(*[F.lit(x) for x in ("A", "yes", "B", "no", "C", "maybe")])
    name = next((n for n in ("context", "long_answer", "abstract", "content") if n in df.columns), None)
    meta = F.struct(F.lit(dataset).alias("source_dataset"), F.lit(split).alias("source_split"), first_of(df, "pubid", "id").alias("original_id"))
    return standard_record(
        df.withColumn("_position", position).select(
            question_id(dataset, split, F.col("_position")).alias("qid"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), first_of(df, "question", "query").alias("question"),
            options.alias("options"), answer.alias("answer"), (context_text(df, name) if name else F.lit("")).alias("context"), meta.alias("meta"),
        )
    )


def union_all(*sets: DataFrame) -> DataFrame:
    """Rows of all sets; meta keeps what all have in common."""
    common = [f for f in sets[0].schema["meta"].dataType.names if all(f in s.schema["meta"].dataType.names for s in sets)]
    same = [s.withColumn("meta", F.struct(*[F.col("meta")[f].cast("string").alias(f) for f in common])) for s in sets]
    out = same[0]
    for s in same[1:]:
        out = out.unionByName(s)
    return out


def counts(records: DataFrame) -> DataFrame:
    return records.groupBy("dataset", "split").agg(F.count("*").alias("n"))
