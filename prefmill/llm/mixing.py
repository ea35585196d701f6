"""Mixing sources to target weights.

Every document gets a hash-random key. The keys of a source are cut into equal
ranges, word counts are summed by range, by groups of ranges, and so on, 2 ** FAN_BITS to one; a prefix sum
over the topmost groups finds the one that holds the source's budget, one over the ranges of that group the
range, so no task sees over that many sums of a source. Only that range is sorted to find the
exact cut. No text is shuffled: the cut goes back to the scan as a few columns
for each source.

Defined cases: a null text has size 0; a null source is a source of its own,
ordered last; a null doc_id is an id like any other; rows that agree in doc_id
and text share a key and, at the cut, share the words that are left evenly
(rounded down). An empty table gives an empty mix. Other columns pass through, whatever their names;
those named like an added one are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut_lineage, shielded, table

KEY_BITS = 60
#: Groups (a power of 2) that a prefix sum of one source runs over.
FAN_BITS = 6
#: Bytes of the cuts (one row for each source) up to which they are broadcast.
BROADCAST_BYTES = 32 << 20


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column, text: Column) -> Column:
    told = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame, ratio: float, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size) -> with target. One row for each source.

    Sources are filled by weight up to ``most`` times their size: with the sources
    ordered by limit / weight, those before the first that stays below its limit
    are full, and the level of that one holds for it and all after it.
    """
    everything = W.partitionBy()
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    t = totals.withColumn("_i", F.row_number().over(by_name) - 1)
    t = t.withColumn("_w", F.get(F.array(*map(F.lit, weights)), F.pmod("_i", F.lit(len(weights))).cast("int")))
    t = t.withColumn("_limit", F.col("source_size") * most)
    before = W.orderBy(F.col("_limit") / F.col("_w"), "_i").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("_full", F.coalesce(F.sum("_limit").over(before), F.lit(0)))
    t = t.withColumn("_rest", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    t = t.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(ratio) - F.col("_full")) / F.col("_rest"))
    t = t.withColumn("_open", F.col("_w") * F.col("_level") < F.col("_limit"))
    first = F.min(F.when(F.col("_open"), F.struct(F.col("_limit") / F.col("_w"), "_i", "_level"))).over(everything)
    t = t.withColumn("_at", first["_level"])
    limit = F.col("_limit").cast("double")
    return t.select("source", "source_size", F.when(F.col("_at").isNull(), limit).otherwise(F.least(limit, F.col("_w") * F.col("_at"))).alias("target"))


def cuts(sized: DataFrame, ratio: float, weights: tuple[int, ...], most: int, rows_per_range: int) -> DataFrame:
    """(source, size, _key) -> for each source: source_size, target, whole epochs, cut key and the words left for it."""
    bits = max(1, math.ceil(math.log2(max(2, sized.count() / rows_per_range))))
    sized = sized.withColumn("_range", F.shiftright("_key", KEY_BITS - bits))
    sums = cut_lineage(sized.groupBy("source", "_range").agg(F.sum("size").alias("_sum")))
    t = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), ratio, weights, most)
    budget = F.floor("target")
    t = t.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    t = cut_lineage(t.withColumn("_left", budget - F.col("_epochs") * F.col("source_size")))
    at = t.select(F.col("source").alias("_src"), F.lit(0).cast("long").alias("_cut_range"), F.col("_left").alias("_need"))
    for shift in reversed(range(0, bits, FAN_BITS)):
        # The groups of one size that are in the group found so far; the first level has all that there are.
        low = sums.groupBy("source", F.shiftright("_range", shift).alias("_group")).agg(F.sum("_sum").alias("_sum"))
        inside = F.col("source").eqNullSafe(F.col("_src")) & (F.shiftright("_group", FAN_BITS) == F.col("_cut_range"))
        end = F.sum("_sum").over(W.partitionBy("_src").orderBy("_group").rowsBetween(W.unboundedPreceding, 0))
        at = low.join(at, inside).withColumn("_end", end).filter((F.col("_end") - F.col("_sum") <= F.col("_need")) & (F.col("_need") < F.col("_end")))
        at = cut_lineage(at.select("_src", F.col("_group").alias("_cut_range"), (F.col("_need") - F.col("_end") + F.col("_sum")).alias("_need")))
    near = sized.join(at, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_range") == F.col("_cut_range")))
    near = near.groupBy("_src", "_need", "_key").agg(F.sum("size").alias("_size"), F.count("*").alias("_rows"))
    end = F.sum("_size").over(W.partitionBy("_src").orderBy("_key").rowsBetween(W.unboundedPreceding, 0))
    near = near.withColumn("_end", end).filter((F.col("_end") - F.col("_size") <= F.col("_need")) & (F.col("_need") < F.col("_end")))
    near = near.select("_src", F.col("_key").alias("_cut"), F.floor((F.col("_need") - F.col("_end") + F.col("_size")) / F.col("_rows")).alias("_part"))
    return t.join(near, F.col("source").eqNullSafe(F.col("_src")), "left").select(F.col("source").alias("_source"), "source_size", "target", "_epochs", "_cut", "_part")


@shielded
def mix_sources(docs: DataFrame, sized: DataFrame | None = None, ratio: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), most: int = 2, rows_per_range: int = 4096) -> DataFrame:
    """Adds size, source_size, target and taken, the number of the document's words that the mix holds.

    ``ratio``: words of the mix over words of the input. ``weights``: repeated over
    the sources in order of their names. ``most``: epochs of a source at most. ``sized``:
    the rows of docs with size and _key, without text, if they have been computed.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    if sized is None:
        docs = docs.withColumn("size", size_of(F.col("text"))).withColumn("_key", key_of(F.col("doc_id"), F.col("text")))
        sized = cut_lineage(docs.select("source", "size", "_key"))
    else:
        docs = sized
    c = cut_lineage(cuts(sized.select("source", "size", "_key"), ratio, weights, most, rows_per_range))
    n = c.agg(F.sum(F.coalesce(F.octet_length("_source"), F.lit(0)) + 64)).first()[0] or 0
    out = docs.join(F.broadcast(c) if n <= BROADCAST_BYTES else c, F.col("source").eqNullSafe(F.col("_source")), "left")
    part = F.when(F.col("_key") < F.col("_cut"), F.col("size")).when(F.col("_key") == F.col("_cut"), F.col("_part")).otherwise(0)
    return out.withColumn("taken", (F.col("_epochs") * F.col("size") + part).cast("long")).drop("_key", "_source", "_epochs", "_cut", "_part")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = cut_lineage(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), F.col("text")).alias("_key")))
    return mix_sources(docs, sized).select("doc_id", "source", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 15) AS BIGINT) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 2 AS lim FROM n),
f AS (SELECT *, coalesce(sum(lim) OVER b, 0) AS before, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS rest, sum(source_size) OVER () AS total
      FROM w WINDOW b AS (ORDER BY CAST(lim AS DOUBLE) / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (CAST(total AS DOUBLE) * 1.5::DOUBLE - CAST(before AS DOUBLE)) / CAST(rest AS DOUBLE) AS level FROM f),
a AS (SELECT arg_min(level, row(CAST(lim AS DOUBLE) / w, i)) AS level FROM l WHERE w * level < lim),
t AS (SELECT l.source, l.source_size, coalesce(least(CAST(lim AS DOUBLE), w * a.level), CAST(lim AS DOUBLE)) AS target FROM l, a),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, e.source_size, e.target, e.epochs, CAST(floor(target) AS BIGINT) - e.epochs * e.source_size AS need,
             sum(size) OVER (PARTITION BY d.source ORDER BY k) AS e2, sum(size) OVER (PARTITION BY d.source, k) AS s2,
             count(*) OVER (PARTITION BY d.source, k) AS r2
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target,
       CAST(epochs * size + CASE WHEN e2 <= need THEN size WHEN e2 - s2 <= need THEN (need - (e2 - s2)) // r2 ELSE 0 END AS BIGINT) AS taken
FROM p
"""
