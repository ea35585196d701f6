"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import ABSTRACT_CHARS, ANSWER_PATTERNS, DOCS, LOW_VALUE_PREFIXES, PAIR_PROMPT, TITLE_CHARS, WS

BOTH_ENDS = rf"\A{WS}+|{WS}+\z"


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once for all of its uses in ``body``, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, BOTH_ENDS, "")


def normalize(text: Column) -> Column:
    """Null becomes empty, runs of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{WS}+", " "))


def shorten(text: Column, most: int | None) -> Column:
    t = normalize(text)
    if not most or most <= 0:
        return t
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("..."))).otherwise(t)


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(normalize(text)), F.lit(r"[a-zA-Z0-9\-]+"), F.lit(0))


def format_question(question: Column, options: Column) -> Column:
    """The question, an empty line and a line for each option in order of its key."""
    lines = F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(F.lit("("), e["key"], F.lit(") "), normalize(e["value"])))
    return F.array_join(F.concat(F.array(normalize(question), F.lit("")), lines), "\n")


def final_answer(text: Column) -> Column:
    """The letter that the first matching pattern finds, in upper case; null if none does."""
    return F.upper(F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in ANSWER_PATTERNS]))


def clean_trace(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def clean_step(step: Column) -> Column:
    s = strip(step)
    for p in (rf"\A\*+{WS}*", rf"\A#+{WS}*", rf"(?i)\AStep{WS}*\d+{WS}*[:\-]{WS}*", rf"\A\d+[.)]{WS}*", rf"\A[-*]{WS}*"):
        s = F.regexp_replace(s, p, "")
    return strip(F.regexp_replace(s, r"\A\*+|\*+\z", ""))


def low_value(step: Column) -> Column:
    """Too short, a stock opening, a bare option letter or a heading."""
    s = strip(step)
    opening = F.exists(F.array(*map(F.lit, LOW_VALUE_PREFIXES)), lambda p: F.startswith(F.lower(s), p))
    return (F.length(s) < 25) | opening | F.rlike(s, F.lit(r"(?i)\A\(?[A-E]\)?\z")) | F.rlike(s, F.lit(r"\A[A-Za-z ]{1,30}:\z"))


def substeps(step: Column) -> Column:
    """Parts of a step of over 220 characters at semicolons and connecting words, if there are two or more."""
    s = strip(step)
    cut = rf"(?i){WS}*;{WS}*|{WS}+therefore,{WS}+|{WS}+however,{WS}+|{WS}+but{WS}+|{WS}+because{WS}+|{WS}+which means{WS}+"
    parts = F.transform(F.filter(F.split(s, cut), lambda x: strip(x) != ""), lambda x: F.regexp_replace(x, r"\A[ ,;:]+|[ ,;:]+\z", ""))
    return F.when(F.length(s) <= 220, F.array(s)).otherwise(let(parts, lambda p: F.when(F.size(p) >= 2, p).otherwise(F.array(s))))


def reasoning_steps(text: Column) -> Column:
    """The ordered, distinct steps of a trace that say something."""
    marker = rf"(?i)\bStep{WS}*\d+{WS}*[:\-]"
    item = rf"\A(\d+[.)]|[-*]){WS}+"
    some = lambda a: F.filter(F.transform(a, strip), lambda x: x != "")

    def from_lines(t: Column, lines: Column) -> Column:
        numbered = F.transform(F.filter(lines, lambda x: F.rlike(x, F.lit(item))), lambda x: strip(F.regexp_replace(x, item, "")))
        plain = F.filter(lines, lambda x: ~F.rlike(x, F.lit(item)))
        merged = let(plain, lambda p: F.when(F.size(p) > 0, F.array_join(p, " ")).otherwise(t))
        return let(numbered, lambda n: F.when(F.size(n) >= 2, n).otherwise(some(F.split(merged, rf"(?<=[.!?]){WS}+"))))

    def candidates(t: Column) -> Column:
        marked = some(F.split(t, rf"(?={marker})".replace("(?=(?i)", "(?i)(?=")))
        return F.when(F.rlike(t, F.lit(marker)), marked).otherwise(let(some(F.split(t, "\n")), lambda ls: from_lines(t, ls)))

    def kept(t: Column) -> Column:
        cleaned = F.filter(F.transform(candidates(t), clean_step), lambda x: x != "")
        parts = F.transform(F.flatten(F.transform(cleaned, substeps)), clean_step)
        good = F.filter(parts, lambda x: (x != "") & ~low_value(x))
        first = lambda g: let(F.transform(g, lambda x: strip(F.lower(x))), lambda low: F.filter(g, lambda x, i: F.array_position(low, strip(F.lower(x))) == i + 1))
        whole = let(clean_step(t), lambda w: F.when((w != "") & ~low_value(w), F.array(w)).otherwise(F.array().cast("array<string>")))
        return let(let(good, first), lambda d: F.when(F.size(d) > 0, d).otherwise(whole))

    return let(strip(F.regexp_replace(clean_trace(F.coalesce(text, F.lit(""))), rf"(?id)Final{WS}*Answer{WS}*:.*", "")), kept)


def signature(text: Column, keep: int = 300) -> Column:
    """md5 of the first characters, lower case, white space collapsed."""
    return F.md5(F.substring(normalize(F.lower(F.coalesce(text, F.lit("")))), 1, keep))


def pair_signature(chosen: Column, rejected: Column) -> Column:
    return F.concat_ws("__", signature(chosen, 250), signature(rejected, 250))


def render_documents(docs: Column, most: int = DOCS) -> Column:
    """'Document i: PMID x | Title: ... | Source: ... | Abstract: ...' of the first documents; an empty one keeps its number to itself."""

    def one(d: Column, i: Column) -> Column:
        told = lambda label, x: F.when(x != "", F.concat(F.lit(label), x))
        source = F.trim(F.concat_ws(" ", F.nullif(normalize(d["journal"]), F.lit("")), F.nullif(normalize(d["year"]), F.lit(""))))
        parts = F.array_compact(F.array(told("PMID ", normalize(d["pmid"])), told("Title: ", shorten(d["title"], TITLE_CHARS)), told("Source: ", source), told("Abstract: ", shorten(d["abstract"], ABSTRACT_CHARS))))
        return F.when(F.size(parts) > 0, F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(": "), F.array_join(parts, " | ")))

    return F.array_compact(F.transform(F.slice(docs, 1, most), one))


def pair_prompt(question: Column, docs: Column) -> Column:
    head, rest = PAIR_PROMPT.split("{docs}")
    middle, tail = rest.split("{question}")
    return F.concat(F.lit(head), strip(F.array_join(docs, "\n")), F.lit(middle), question, F.lit(tail))


def year_of(year: Column, medline_date: Column) -> Column:
    return F.coalesce(F.nullif(strip(year), F.lit("")), F.nullif(F.regexp_extract(medline_date, r"\b(19|20)\d{2}\b", 0), F.lit("")))
