"""Substring dedup by sliding spans of sentences.

A sentence ends after a word that ends in . ! ? or another full stop, closing quotes and brackets
aside, and at a line end. What has over LONGEST words without such an end is a list or a table and no
sentence; it alone is cut, after the word of the least md5 of every WINDOW in a row, so that two copies of it are
cut alike. Every run of consecutive sentences with at least RUN sentences and MIN_WORDS words is
hashed (128 bits); runs met before, in the order of doc_id and place, are found with one global aggregation
and one join; the sentences that such a run covers are removed.

Defined cases: null, empty and blank texts have no sentences and stay as they are;
texts of fewer sentences or words than a run have no run; rows equal in doc_id
and text are one document; a null doc_id comes after all others and then by text hash. Very
long texts are handled whole. Other columns pass through, whatever their names; the added ones replace
those of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, salted_join, shielded, small_batches, table, text_key
from .hashing import Q, Spans, Words, blocks

RUN, MIN_WORDS = 3, 12
#: Words of the longest sentence; of so many words in a row of what is longer one ends a part.
LONGEST, WINDOW = 40, 8
#: What ends a sentence, and what may follow it in the word.
STOPS, CLOSERS = ".!?\u2026\u3002\uff01\uff1f", "\"')]}\u00bb\u201d\u2019"


def ends_in(data: np.ndarray, start: np.ndarray, end: np.ndarray, signs: str) -> np.ndarray:
    """For each [start, end) the bytes of the sign that it ends in, or 0."""
    out = np.zeros(len(start), np.int64)
    for sign in signs:
        raw = sign.encode()
        same = end - len(raw) >= start
        for i, x in enumerate(raw):
            same &= data[np.maximum(end - len(raw) + i, 0)] == x
        out[same] = len(raw)
    return out


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each sentence of a block."""
    if not len(w.starts):
        return w.starts, w.starts
    lines = np.concatenate([[0], np.cumsum(w.data == 10)])
    last = np.append((lines[w.starts[1:]] > lines[w.ends[:-1]]) | (w.row[1:] != w.row[:-1]), True)
    open_, end = np.arange(len(last)), w.ends.copy()
    while len(open_):
        n = ends_in(w.data, w.starts[open_], end[open_], CLOSERS)
        end[open_] -= n
        open_ = open_[n > 0]
    last |= ends_in(w.data, w.starts, end, STOPS) > 0
    to = np.flatnonzero(last)
    first = np.append(0, to[:-1] + 1)
    long = to - first >= LONGEST
    if long.any():
        n = (to - first + 1)[long]
        stretch = np.repeat(np.arange(len(n)), n)
        word = np.arange(len(stretch)) + np.repeat(first[long] - np.append(0, np.cumsum(n)[:-1]), n)
        _, one, kind = np.unique(w.hash[word], return_index=True, return_inverse=True)
        raw = w.data.tobytes()
        order = np.array([int.from_bytes(md5(raw[w.starts[i] : w.ends[i]]).digest()[:8], "big") for i in word[one]], np.uint64)[kind]
        # Of equal words the last one counts.
        at = np.arange(len(order) - WINDOW + 1) + WINDOW - 1 - np.lib.stride_tricks.sliding_window_view(order, WINDOW)[:, ::-1].argmin(1)
        last[word[at[stretch[: len(at)] == stretch[WINDOW - 1 :]]]] = True
        to = np.flatnonzero(last)
        first = np.append(0, to[:-1] + 1)
    return first, to


def span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in blocks(batches):
        w = Words(data, offsets)
        first, last = sentences(w)
        n = len(first)
        to = np.maximum(np.arange(n) + RUN - 1, np.searchsorted(last, first + MIN_WORDS - 1))
        ok = to < n
        ok[ok] = w.row[first[ok]] == w.row[first[to[ok]]]
        i, j = np.flatnonzero(ok), to[ok]
        row, end = w.row[first[i]], last[j] + 1
        hashes = [pa.array(Spans(h, Q).of(first[i], end).view(np.int64)) for h in (w.hash, w.hash ^ np.uint64(0x5851F42D4C957F2D))]
        yield pa.RecordBatch.from_arrays(
            [
                *hashes, batch.column("doc_id").take(pa.array(row)), batch.column("_key").take(pa.array(row)),
                pa.array((first[i] - w.first[row]).astype(np.int32)), pa.array((end - w.first[row]).astype(np.int32)),
            ],
            ["a", "b", "doc_id", "_key", "at", "end"],
        )


def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the words of _spans, up to the next word that stays, and counts."""
    for batch, data, offsets in blocks(batches):
        w = Words(data, offsets)
        first, _ = sentences(w)
        per_row = np.bincount(w.row[first], minlength=batch.num_rows) if len(first) else np.zeros(batch.num_rows, int)
        gone = np.zeros(len(w.starts) + 1, np.int32)
        spans = batch.column("_spans")
        if len(spans.values):
            row = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
            flat = spans.flatten()
            np.add.at(gone, flat.field("at").to_numpy() + w.first[row], 1)
            np.add.at(gone, flat.field("end").to_numpy() + w.first[row], -1)
        gone = np.cumsum(gone)[:-1] > 0
        to = np.append(w.starts[1:], len(data)) if len(w.starts) else w.starts
        to = np.minimum(to, offsets[w.row + 1])
        mark = np.zeros(len(data) + 1, np.int8)
        np.add.at(mark, w.starts[gone], 1)
        np.add.at(mark, to[gone], -1)
        keep = np.cumsum(mark)[:-1] == 0
        texts = []
        hit = np.bincount(w.row[gone], minlength=batch.num_rows)
        dropped = np.bincount(w.row[first[gone[first]]], minlength=batch.num_rows) if len(first) else per_row
        old = batch.column("text")
        for i in range(batch.num_rows):
            a, b = offsets[i], offsets[i + 1]
            texts.append(data[a:b][keep[a:b]].tobytes().decode().rstrip(" \t\n\x0b\x0c\r") if hit[i] else old[i].as_py())
        names = [c for c in batch.schema.names if c != "_spans"]
        cols = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(per_row.astype(np.int64)), pa.array(dropped.astype(np.int64)), pa.array(hit.astype(np.int64))], [*names, "n_sentences", "n_removed", "n_removed_words"])


@shielded
def dedup_spans(docs: DataFrame) -> DataFrame:
    """docs with the repeated sentences removed from text, and n_sentences, n_removed and n_removed_words."""
    docs = docs.drop("n_sentences", "n_removed", "n_removed_words")
    small_batches(docs.sparkSession)
    keyed = docs.withColumn("_key", text_key(F.col("text")))
    schema = "a long, b long, doc_id long, _key long, at int, end int"
    rows = keyed.select(F.col("doc_id").cast("long"), "_key", "text").mapInArrow(span_rows, schema)
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_key", "at")
    met = cut_lineage(rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("f")).filter("n > 1"))
    later = salted_join(rows, met, ["a", "b"], "n").filter(~(F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("_key") == F.col("f._key")) & (F.col("at") == F.col("f.at"))))
    spans = cut_lineage(later.groupBy("doc_id", "_key").agg(F.collect_set(F.struct("at", "end")).alias("_spans")).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "_spans"))
    found = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")), "left").select(*docs.columns, F.coalesce("_spans", F.expr("array()")).alias("_spans"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return found.mapInArrow(cut_rows, f"{out}, n_sentences long, n_removed long, n_removed_words long")


def op10_spans(spark, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "n_removed_words", "text")


def _sql() -> str:
    """Words with what follows them, sentence numbers by running sums, and runs by a join within the text."""
    blank, quote = r"[\x20\x09-\x0D]", CLOSERS.replace("'", "''").replace("]", r"\]")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY doc_id NULLS LAST, text NULLS FIRST) AS o, doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+{blank}*') AS ps FROM documents),
w0 AS (SELECT r, o, len(ps) AS n, unnest(ps) AS p, unnest(generate_series(1, len(ps))) AS i FROM d WHERE len(ps) > 0),
w1 AS (SELECT *, regexp_extract(p, '^[^\x20\x09-\x0D]+') AS x FROM w0),
w2 AS (SELECT *, regexp_matches(x, '[{STOPS}][{quote}]*$') OR contains(p, chr(10)) OR i = n AS e FROM w1),
w3 AS (SELECT *, coalesce(sum(CAST(e AS INTEGER)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w2),
w4 AS (SELECT *, count(*) OVER (PARTITION BY r, s) AS c, row_number() OVER (PARTITION BY r, s ORDER BY i) AS k FROM w3),
cut AS (SELECT DISTINCT r, -b[2] AS i FROM (SELECT r, k, min([CAST(CAST('0x' || left(md5(x), 16) AS UBIGINT) AS HUGEINT), -i]) OVER (PARTITION BY r, s ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS b FROM w4 WHERE c > {LONGEST}) WHERE k >= {WINDOW}),
w5 AS (SELECT w4.r, o, w4.i, p, x, e OR cut.i IS NOT NULL AS e FROM w4 LEFT JOIN cut ON w4.r = cut.r AND w4.i = cut.i),
w AS (SELECT *, coalesce(sum(CAST(e AS INTEGER)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w5),
t AS (SELECT r, o, list(x ORDER BY i) AS xs FROM w GROUP BY r, o),
z AS (SELECT r, s, min(i) AS a, max(i) AS b FROM w GROUP BY r, s),
j AS (SELECT z.r, z.a, min(y.b) AS b FROM z JOIN z y ON z.r = y.r AND y.s BETWEEN z.s + {RUN - 1} AND z.s + {max(RUN, MIN_WORDS) - 1} WHERE y.b - z.a + 1 >= {MIN_WORDS} GROUP BY z.r, z.a),
g AS (SELECT j.r, o, a, b, array_to_string(xs[a:b], ' ') AS gram FROM j JOIN t USING (r)),
v AS (SELECT r, a, b FROM (SELECT *, min(row(o, a)) OVER (PARTITION BY gram) AS f FROM g) WHERE row(o, a) <> f),
gone AS (SELECT DISTINCT r, unnest(generate_series(a, b)) AS i FROM v),
m AS (SELECT w.r, w.i, w.s, w.p, gone.i IS NOT NULL AS x FROM w LEFT JOIN gone ON w.r = gone.r AND w.i = gone.i),
q AS (SELECT r, count(DISTINCT s) AS ns, count(DISTINCT s) FILTER (x) AS nr, count(*) FILTER (x) AS nw, string_agg(p, '' ORDER BY i) FILTER (NOT x) AS kept FROM m GROUP BY r)
SELECT doc_id, CAST(coalesce(ns, 0) AS BIGINT) AS n_sentences, CAST(coalesce(nr, 0) AS BIGINT) AS n_removed, CAST(coalesce(nw, 0) AS BIGINT) AS n_removed_words,
  CASE WHEN coalesce(nw, 0) = 0 THEN text ELSE regexp_replace(regexp_extract(text, '^{blank}*') || coalesce(kept, ''), '{blank}+$', '') END AS text
FROM d LEFT JOIN q USING (r)"""


SQL = _sql()
