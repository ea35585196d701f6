"""What lies outside the engine, behind interfaces with local stand-ins that give the same results anywhere.

DocumentSource: finds and fetches documents (stand-in: token overlap over a table; or a search service over HTTP). Hits may have an
    error column; a row with an error says that the query could not be answered.
PromptScorer: (prompt) -> p_plus (stand-in: a hash of the prompt; or any function over batches).
TraceGenerator: attempts of models at questions (stand-in: a table).
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import retrieve
from ..sources.tables import articles


class DocumentSource(Protocol):
    def search(self, queries: DataFrame) -> DataFrame: ...

    def fetch(self, lists: DataFrame) -> DataFrame: ...

    def documents(self, pmids: DataFrame) -> DataFrame: ...


class PromptScorer(Protocol):
    def score(self, prompts: DataFrame) -> DataFrame: ...


class TraceGenerator(Protocol):
    def attempts(self, questions: DataFrame) -> DataFrame: ...


class TableSource:
    """Documents (pmid, title, abstract, journal, year) of a table."""

    def __init__(self, documents: DataFrame, most: int = 20, match: str = "any"):
        self.table, self.most, self.match = documents, most, match

    def search(self, queries: DataFrame) -> DataFrame:
        text = F.concat_ws(" ", "title", "abstract")
        return retrieve.search(queries, self.table.select("pmid", text.alias("text")), self.most, self.match)

    def fetch(self, lists: DataFrame) -> DataFrame:
        return retrieve.fetch(lists, self.table)

    def documents(self, pmids: DataFrame) -> DataFrame:
        """The documents with these ids that there are."""
        return self.table.join(pmids.select("pmid").distinct(), "pmid", "left_semi")


class HttpSource:
    """A search service: ``get(path, parameters)`` returns the body of a reply or raises.

    "search" replies with JSON {"esearchresult": {"idlist": [...]}}, best first; "fetch" takes ids
    joined by commas and replies with XML articles. A worker asks one query after the other and waits ``pause`` seconds after each
    reply; a failed query is a row with an error, a failed fetch an error of the job.
    """

    def __init__(self, get: Callable[[str, dict], str], parameters: dict | None = None, most: int = 20, pause: float = 0.4, workers: int = 1, batch: int = 100):
        self.get, self.parameters, self.most, self.pause, self.workers, self.batch = get, parameters or {}, most, pause, workers, batch

    def search(self, queries: DataFrame) -> DataFrame:
        get, own, most, pause = self.get, self.parameters, self.most, self.pause

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for r in b.itertuples():
                    try:
                        found = json.loads(get("search", own | {"term": r.query, "retmax": most, "sort": "relevance", "retmode": "json"}))["esearchresult"]["idlist"]
                        rows += [(r.qid, r.cand, str(x), i + 1, None) for i, x in enumerate(found[:most])]
                        time.sleep(pause)
                    except Exception as e:  # noqa: BLE001 the row tells what went wrong
                        rows.append((r.qid, r.cand, None, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["qid", "cand", "pmid", "rank", "error"]).astype({"rank": "Int64"})

        return queries.select("qid", "cand", "query").repartition(self.workers, "qid").mapInPandas(run, "qid string, cand int, pmid string, rank long, error string")

    def documents(self, pmids: DataFrame) -> DataFrame:
        get, own, pause, size = self.get, self.parameters, self.pause, self.batch

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in range(0, len(b), size):
                    yield pd.DataFrame({"xml": [get("fetch", own | {"id": ",".join(b["pmid"][i : i + size]), "retmode": "xml"})]})
                    time.sleep(pause)

        wanted = pmids.select("pmid").filter("pmid <> ''").distinct().repartition(self.workers, "pmid")
        return articles(wanted.mapInPandas(run, "xml string")).filter("pmid <> ''")

    def fetch(self, lists: DataFrame) -> DataFrame:
        return retrieve.fetch(lists, self.documents(lists.select(F.explode("pmids").alias("pmid"))))


def hash01(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


class HashScorer:
    def score(self, prompts: DataFrame) -> DataFrame:
        """Adds p_plus, p_minus and margin to the rows of a prompt column."""
        return prompts.withColumn("p_plus", hash01(F.col("prompt"))).withColumns({"p_minus": 1 - F.col("p_plus"), "margin": 2 * F.col("p_plus") - 1})


class BatchScorer:
    """A model's function from a list of prompts to p_plus values, run on Arrow batches."""

    def __init__(self, model: Callable[[list[str]], list[float]]):
        self.model = model

    def score(self, prompts: DataFrame) -> DataFrame:
        model = self.model

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                p = pd.Series(model(b["prompt"].tolist()), index=b.index, dtype="float64")
                yield b.assign(p_plus=p, p_minus=1 - p, margin=2 * p - 1)

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
        return prompts.mapInPandas(run, f"{kinds}, p_plus double, p_minus double, margin double")


class TableGenerator:
    """Attempts (qid, model, model_rank, attempt, raw_generation) of a table."""

    def __init__(self, table: DataFrame):
        self.table = table

    def attempts(self, questions: DataFrame) -> DataFrame:
        return self.table.join(questions.select("qid"), "qid", "left_semi")
