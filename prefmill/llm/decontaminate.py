"""Benchmark decontamination by a broadcast hash set of test n-grams.

Test items and documents are normalised alike; every window of ``n`` item words
(a shorter item is one window) goes into a hash set that is broadcast after its
size is checked. Documents are scanned window by window, hits are verified word
by word, and covered words are counted.

Defined cases: null and empty texts have no words, items without words have
no window; equal rows get equal results; item_id may be null (its windows
count, its id does not); an empty benchmark hits nothing. Documents longer than
any limit are scanned whole. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, let, shielded, table, text_key

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOKEN_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
N = 10
#: Bytes of the windows of the test set, with the ids of their items, up to which they are broadcast.
BROADCAST_BYTES = 64 << 20


def tokens(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, GAP), "")


def test_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """Distinct windows: width, hash, words and the items that have them."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("width", F.least(F.lit(n), F.size("w"))).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1)))
    w = w.select("item", "width", F.concat_ws(" ", F.slice("w", F.col("at"), F.col("width"))).alias("gram"))
    return w.groupBy("width", "gram").agg(F.collect_set("item").alias("items")).withColumn("hash", F.xxhash64("gram"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """For each (doc_id, _key) with a hit: _spans, the sorted hit (start, width), and _items, the ids of the items hit."""
    grams = cut_lineage(test_windows(benchmark, n))
    sizes = [r[0] for r in grams.select("width").distinct().collect()]  # at most n values
    told = F.octet_length("gram") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16)
    few = (grams.agg(F.sum(told + 64)).first()[0] or 0) <= BROADCAST_BYTES
    rows = docs.select("doc_id", text_key(F.col("text")).alias("_key"), tokens(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "_key", "w", F.posexplode("w").alias("at", "_word"))
    gram = lambda k: F.concat_ws(" ", F.slice("w", F.col("at") + 1, F.lit(k)))
    windows = F.array(*[F.when(F.col("at") + k <= F.size("w"), F.struct(F.lit(k).alias("width"), F.xxhash64(gram(k)).alias("hash"))) for k in sizes])
    if not sizes:
        windows = F.array().cast("array<struct<width:int,hash:bigint>>")
    if len(sizes) == 1:
        rows = rows.filter(F.col("at") + sizes[0] <= F.size("w")).select("doc_id", "_key", "w", "at", F.lit(sizes[0]).alias("width"), F.xxhash64(gram(sizes[0])).alias("hash"))
    else:
        rows = rows.select("doc_id", "_key", "w", "at", F.explode(windows).alias("x")).filter("x IS NOT NULL").select("doc_id", "_key", "w", "at", "x.width", "x.hash")
    if not few:
        rows = rows.select("doc_id", "_key", "at", "width", "hash", F.concat_ws(" ", F.slice("w", F.col("at") + 1, F.col("width"))).alias("seen"))
    found = rows.join(F.broadcast(grams) if few else grams, ["width", "hash"])
    found = found.filter((F.concat_ws(" ", F.slice("w", F.col("at") + 1, F.col("width"))) if few else F.col("seen")) == F.col("gram"))
    return found.groupBy("doc_id", "_key").agg(
        F.sort_array(F.collect_set(F.struct("at", "width"))).alias("_spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items")
    )


def covered(spans: Column) -> Column:
    """Number of words in the union of sorted (at, width) spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(a: Column, s: Column) -> Column:
        end = F.greatest(a["end"], s["at"] + s["width"])
        return F.struct(end.alias("end"), (a["n"] + end - F.greatest(a["end"], F.least(end, s["at"]))).alias("n"))

    return F.aggregate(spans, start, add)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, _items and contaminated."""
    base = docs.select("doc_id", text_key(F.col("text")).alias("_key"), F.size(tokens(F.col("text"))).cast("long").alias("n_words")).alias("d")
    h = hits(docs, benchmark, n).alias("h")
    out = base.join(h, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d._key") == F.col("h._key")), "left")
    none = F.array().cast("array<string>")
    return out.select("d.doc_id", "n_words", F.coalesce(covered(F.col("_spans")), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("_items", none).alias("_items"))


def merged(spans: Column) -> Column:
    """The union of sorted (at, width) spans as disjoint (start, end) in order."""

    def add(a: Column, s: Column) -> Column:
        one = F.struct(s["at"].alias("start"), (s["at"] + s["width"]).alias("end"))
        last = F.element_at(a, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], one["end"]).alias("end"))
        return F.when(F.size(a) == 0, F.array(one)).when(last["end"] < one["start"], F.concat(a, F.array(one))).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(longer)))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), add)


def without_words(words: Column, gaps: Column, runs: Column) -> Column:
    """The text of gaps and words without the words of the runs, each place looked at once."""

    def joined(low: Column, high: Column, each) -> Column:
        return F.when(low < high, F.array_join(F.transform(F.sequence(low, high - 1), each), "")).otherwise("")

    both, gap = (lambda i: F.concat(F.get(gaps, i), F.get(words, i))), (lambda i: F.get(gaps, i))
    before = lambda i: F.coalesce(F.get(runs, i - 1)["end"], F.lit(0))
    parts = F.transform(runs, lambda r, i: F.concat(joined(before(i), r["start"], both), joined(r["start"], r["end"], gap)))
    return F.concat(F.array_join(parts, ""), joined(before(F.size(runs)), F.size(words), both), F.element_at(gaps, -1))


@shielded
def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, spans: bool = False) -> DataFrame:
    """Without the documents that hold a test window, or, with ``spans``, without the hit words only; columns as before."""
    h = hits(docs, benchmark, n).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), F.col("_spans").alias("_hit_spans"))
    # As a table, whose bytes decide whether it is broadcast: then no text is shuffled.
    h = cut_lineage(h if spans else h.drop("_hit_spans"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_k"))
    if not spans:
        return docs.join(h, same, "left_anti")
    own, gaps = F.array_remove(F.split("text", GAP_ANY_CASE), ""), F.split("text", TOKEN_ANY_CASE)
    rest = let(own, lambda w: let(gaps, lambda g: let(merged(F.col("_hit_spans")), lambda r: without_words(w, g, r))))
    return docs.join(h, same, "left").withColumn("text", F.when(F.col("_hit_spans").isNull(), F.col("text")).otherwise(rest)).select(*docs.columns)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM bw),
ks AS (SELECT DISTINCT k FROM g),
dw AS (SELECT r, k, unnest(generate_series(1, len(w) - k + 1)) AS i, w FROM d, ks WHERE len(w) >= k),
m AS (SELECT DISTINCT dw.r, dw.i, dw.k, g.item FROM (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM dw) dw JOIN g USING (k, gram)),
p AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS j FROM (SELECT DISTINCT r, i, k FROM m)) GROUP BY r),
q AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)
"""
