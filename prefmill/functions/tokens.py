"""Token filters and array functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CONTENT_SUFFIXES, GENERAL_STOPWORDS, KEEP_SHORT
from .text import normalize, tokenize

NUMBER = r"\A(\d+|\d+-(year|month)-old)\z"


def keep_token(t: Column, extra: list[str], keep: list[str]) -> Column:
    """Kept short words come first, then stop words, numbers and ages, and words of one or two characters go."""
    return t.isin(keep) | ~(t.isin(sorted({*GENERAL_STOPWORDS, *extra})) | F.rlike(t, F.lit(NUMBER)) | (F.length(t) <= 2))


def clean_tokens(tokens: Column, extra: list[str] = (), keep: list[str] = KEEP_SHORT) -> Column:
    return F.filter(tokens, lambda t: keep_token(t, list(extra), keep))


def content_token(t: Column) -> Column:
    return t.isin(KEEP_SHORT) | (F.length(t) >= 5) | F.rlike(t, F.lit("(" + "|".join(CONTENT_SUFFIXES) + r")\z"))


def content_tokens(tokens: Column, extra: list[str] = ()) -> Column:
    return F.filter(clean_tokens(tokens, extra), content_token)


def dedupe(items: Column) -> Column:
    """First occurrences in order, without empty ones."""
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def option_texts(options: Column) -> Column:
    """Normalised values in order of their keys, without empty ones."""
    return F.filter(F.transform(F.array_sort(F.map_entries(options)), lambda e: normalize(e["value"])), lambda x: x != "")


def option_tokens(options: Column, extra: list[str], most: int = 4) -> Column:
    return dedupe(F.flatten(F.transform(F.slice(option_texts(options), 1, most), lambda x: clean_tokens(tokenize(x), extra))))


def phrase_tokens(phrases: Column) -> Column:
    return dedupe(F.flatten(F.transform(phrases, tokenize)))


def join_words(words: Column, most: int) -> Column:
    return F.array_join(F.slice(words, 1, most), " ")
