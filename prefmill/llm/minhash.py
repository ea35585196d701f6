"""Near-duplicate documents by BagMinHash signatures of weighted shingles.

A document is the multiset of its five-word shingles. A shingle of weight w owns
Poisson processes over the dyadic weight intervals (0,1], (1,2], (2,4], ...; each
point has a time, a register and, halving the interval bit by bit, a place
in it. A document sees the points below its weight, and a register keeps
its earliest one. Two documents keep the same point with a probability equal to their
weighted Jaccard similarity. Points are made in order of time up to a limit
that leaves no register empty, doubled where one stays empty, so the work is
about M log M points and not one for each shingle and register.

BANDS bands of ROWS registers propose candidates; the overlap of the multisets decides.
Inside a band bucket documents are compared with its centre only; those that differ
from it, and those that the triangle inequality leaves open (the distance is a metric), are
compared where they share one of their rarest shingles, so no link is lost and no group is expanded into
pairs. Components come from repeated minima over the links.

Defined cases: rows with equal word sequences are one node; texts without
words (null, empty, blank) are duplicates of nothing; texts of fewer than five words have one
shingle, all their words; of a class the smallest doc_id stays, null last, then by text hash, and
of rows equal in doc_id and text one. Very long texts are handled whole. Other columns pass
through; added ones replace those of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, salted_join, shielded, small_batches, table, text_key
from .hashing import Q, Spans, Words, blocks, mix

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
M = BANDS * ROWS
#: Five standard deviations of an estimate from M registers at SIMILARITY, and the chance agreement of one-byte registers.
SLACK = 5.0 * (SIMILARITY * (1 - SIMILARITY) / M) ** 0.5
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of a block."""
    count = np.diff(w.first)
    n = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    row = np.repeat(np.arange(len(count)), n)
    start = w.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, Spans(w.hash, Q).of(start, np.minimum(start + SHINGLE, w.first[row + 1]))


def weighted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) with their numbers."""
    if not len(h):
        return row, h, np.zeros(0, np.int64)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int, m: int = M) -> np.ndarray:
    """For each row the ids of the earliest points of m registers."""
    ids = np.full((rows, m), EMPTY, np.uint64)
    total = np.bincount(row, weight, rows)
    todo = np.flatnonzero(total > 0)
    level = np.ceil(np.log2(np.maximum(weight, 1))).astype(int)
    factor = np.log(m) + 2.5
    while len(todo):
        limit = np.zeros(rows)
        limit[todo] = m * factor / total[todo]
        now = limit[row] > 0
        r, e, wt, lv = row[now], h[now], weight[now], level[now]
        rs, ts, ps = [], [], []
        for k in range(int(lv.max()) + 1):
            use = lv >= k
            r0, e0, w0 = r[use], mix(e[use] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))), wt[use]
            low, wide = (0, 1) if k == 0 else (1 << (k - 1), 1 << (k - 1))
            t, state = np.zeros(len(r0)), e0
            while len(r0):
                state = mix(state + np.uint64(0xD1B54A32D192ED03))
                t = t - np.log(uniform(state)) / wide
                on = t <= limit[r0]
                r0, w0, t, state = r0[on], w0[on], t[on], state[on]
                seen = slice(None)
                if wide > 1:
                    seen = low + (mix(state ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(wide)).astype(np.int64) < w0
                rs.append(r0[seen])
                ts.append(t[seen])
                ps.append(state[seen])
        rr, tt, pp = np.concatenate(rs), np.concatenate(ts), np.concatenate(ps)
        register = (mix(pp ^ np.uint64(0x8CB92BA72F3D8DD7)) % np.uint64(m)).astype(np.int64)
        slot = rr * m + register
        earliest = np.full(rows * m, np.inf)
        np.minimum.at(earliest, slot, tt)
        first = tt == earliest[slot]
        ids.reshape(-1)[slot[first]] = pp[first]
        todo = todo[(ids[todo] == EMPTY).any(axis=1)]
        ids[todo] = EMPTY
        factor *= 2
    return ids


def signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's node (two hashes of its word sequence), band hashes and one byte of each register."""
    for batch, data, offsets in blocks(batches):
        w = Words(data, offsets)
        n = batch.num_rows
        s1, s2 = Spans(w.hash, Q), Spans(w.hash ^ np.uint64(0x5851F42D4C957F2D))
        a, b = s1.of(w.first[:-1], w.first[1:]), s2.of(w.first[:-1], w.first[1:])
        ids = signatures(*weighted(*shingles(w)), n)
        bands = np.zeros((n, BANDS), np.uint64)
        for k in range(ROWS):
            bands = mix(bands + ids[:, k::ROWS])
        bands = mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        byte = (mix(ids) & np.uint64(255)).astype(np.uint8)
        count = np.diff(w.first)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("_key"), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(count.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1))),
                pa.array([x.tobytes() for x in byte], pa.binary()),
            ],
            ["doc_id", "_key", "n1", "n2", "n_words", "bands", "sketch"],
        )


def multiset_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's multiset as a set: the k-th equal shingle has a hash of its own."""
    for batch, data, offsets in blocks(batches):
        w = Words(data, offsets)
        row, h = shingles(w)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        kth = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h)))) if len(h) else at
        h = mix(h + kth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["id", "bag"])


def agreement(a: Column, b: Column) -> Column:
    """Similarity estimated from two sketches, freed of the chance that two bytes agree."""
    share = F.aggregate(F.sequence(F.lit(1), F.lit(M)), F.lit(0), lambda n, i: n + F.when(F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)), 1).otherwise(0)) / F.lit(float(M))
    return (share - 1 / 256) * (256 / 255)


def bags_of(ids: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, bag) of nodes, from one join with the texts, planned alike at every size."""
    at = cut_lineage(ids.join(reps.select("id", "doc_id", "_key"), "id").select("id", F.col("doc_id").alias("_id"), F.col("_key").alias("_k")))
    d = docs.select("doc_id", text_key(F.col("text")).alias("_key"), "text")
    d = d.join(at.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k"))).select("id", "text")
    return cut_lineage(d.mapInArrow(multiset_rows, "id long, bag array<long>").dropDuplicates(["id"]))


def verified(pairs: DataFrame, reps: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b) with near, and the distance if near, else a lower bound of it. A b may be in any number of pairs; such joins are split by AQE."""
    s = reps.select("id", "sketch")
    p = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b")
    p = cut_lineage(p.select("a", "b", agreement(F.col("sa"), F.col("sb")).alias("est")))
    q = p.filter(F.col("est") >= SIMILARITY - SLACK).select("a", "b").join(bags.toDF("a", "ba"), "a").join(bags.toDF("b", "bb"), "b")
    both = F.size(F.array_intersect("ba", "bb"))
    q = q.select("a", "b", (both / (F.size("ba") + F.size("bb") - both)).alias("j"))
    far = p.filter(F.col("est") < SIMILARITY - SLACK).select("a", "b", F.lit(False).alias("near"), F.greatest(F.lit(1 - SIMILARITY), 1 - F.col("est") - SLACK).alias("d"))
    return cut_lineage(q.select("a", "b", (F.col("j") >= SIMILARITY - 1e-12).alias("near"), (1 - F.col("j")).alias("d")).union(far))


def rare_pairs(nodes: DataFrame, bags: DataFrame) -> DataFrame:
    """(a, b) of nodes (id, root) with different roots that may be near: all pairs that share one of their rarest shingles.

    If two texts agree in SIMILARITY of their shingles, each has a shingle of the other among its
    rarest 1 - SIMILARITY, in one order for all; what edited copies have in common is frequent and
    last in that order. Sizes have to fit too. Nothing near is missed.
    """
    own = cut_lineage(nodes.join(bags, "id").select("id", "root", F.size("bag").alias("size"), F.explode("bag").alias("s")))
    often = own.groupBy("s").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("id").orderBy("n", "s"))
    rare = own.join(often, "s").withColumn("r", rank).filter(F.expr(f"n > 1 AND r <= size - ceil({SIMILARITY} * size - 1e-6) + 1"))
    rare = cut_lineage(rare.select("s", "id", "root", "size", "r"))
    other = rare.select("s", F.col("id").alias("b"), F.col("root").alias("rb"), F.col("size").alias("sb"), F.col("r").alias("q"))
    # The overlap that these sizes need leaves so many places for the first shingle in common.
    need = f"ceil({SIMILARITY / (1 + SIMILARITY)!r} * (size + sb) - 1e-6)"
    fits = F.expr(f"id < b AND root <> rb AND r <= size - {need} + 1 AND q <= sb - {need} + 1")
    return rare.join(other, "s").filter(fits).select(F.col("id").alias("a"), "b").distinct()


def links(reps: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Links (a, b) between nodes whose components are those of all links with at least SIMILARITY.

    Every member of a bucket meets its centre, the member whose buckets are fullest, which in a group of edited copies is
    the one with the fewest edits. Members that differ from it, and those near it that may still have a link to one that
    differs, are few; among these links are found exactly, by their rarest shingles.
    """
    members = reps.select("id", F.posexplode("bands").alias("j", "key"))
    some = cut_lineage(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    if some.isEmpty():
        return None
    members = cut_lineage(salted_join(members, some, "key", "n"))
    full = members.groupBy("id").agg(F.sum("n").alias("full"))
    bags = bags_of(full.select("id"), reps, docs)
    centre = members.join(full, "id").groupBy("key", "n").agg(F.max(F.struct("full", "id"))["id"].alias("b"))
    m = cut_lineage(salted_join(members.drop("n"), cut_lineage(centre), "key", "n").filter("id <> b").select("key", "j", F.col("id").alias("a"), "b"))
    v = verified(m.select("a", "b").distinct(), reps, bags)
    out = cut_lineage(v.filter("near").select("a", "b"))
    m = m.join(v, ["a", "b"])
    ring = m.filter("NOT near").groupBy("key").agg(F.min("d").alias("ring"))
    rest = m.join(ring, "key").filter(F.expr(f"NOT near OR d >= ring - {1 - SIMILARITY} - 1e-9")).select(F.col("a").alias("id"))
    rest = cut_lineage(rest.select("id").distinct().join(components(out), "id", "left").select("id", F.coalesce("root", "id").alias("root")))
    more = verified(rare_pairs(rest, bags), reps, bags)
    return cut_lineage(out.union(more.filter("near").select("a", "b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each node's component, for the nodes of edges. A centre of many links, and a root of many nodes, is dealt over tasks."""
    both = cut_lineage(edges.union(edges.select("b", "a")).distinct().toDF("a", "b"))
    label = cut_lineage(both.groupBy("a").agg(F.min("b").alias("l"), F.count("*").alias("n")).select(F.col("a").alias("id"), F.least("a", "l").alias("root"), "n"))
    while True:
        told = salted_join(both, label.withColumnRenamed("id", "b"), "b", "n")
        seen = told.groupBy("a").agg(F.min("root").alias("m")).withColumnRenamed("a", "id")
        new = cut_lineage(label.join(seen, "id").select("id", "root", "n", F.least("root", "m").alias("low")))
        lows = new.groupBy("low").agg(F.count("*").alias("n_low")).join(label.select(F.col("id").alias("low"), F.col("root").alias("jump")), "low")
        new = cut_lineage(salted_join(new, cut_lineage(lows), "low", "n_low").select("id", "root", "n", F.least("low", "jump").alias("low")))
        if new.filter("low <> root").isEmpty():
            return label.select("id", "root")
        label = new.select("id", F.col("low").alias("root"), "n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, _key, class_id (smallest doc_id), class_size, same (rows equal in doc_id and text) and first."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, _key long, n1 long, n2 long, n_words long, bands array<long>, sketch binary"
    signed = cut_lineage(docs.withColumn("_key", text_key(F.col("text"))).mapInArrow(signed_rows, schema))
    seed = 0
    while True:  # one number for both hashes; another seed in the rare case that two nodes share it
        id_ = F.when(F.col("n_words") > 0, F.xxhash64(F.lit(seed), "n1", "n2"))
        nodes = signed.filter("n_words > 0").select("n1", "n2").distinct()
        if nodes.groupBy(F.xxhash64(F.lit(seed), "n1", "n2")).count().filter("count > 1").isEmpty():
            break
        seed += 1
    signed = signed.withColumn("id", id_)
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_key")
    best = signed.filter("id IS NOT NULL").groupBy("id").agg(F.min(place).alias("p"), F.count("*").alias("n"))
    best = cut_lineage(best.select("id", F.col("p.doc_id").alias("_i"), F.col("p._key").alias("_k"), "n"))
    reps = salted_join(signed.select("id", "doc_id", "_key", "bands", "sketch"), best, "id", "n").filter(F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")))
    reps = cut_lineage(reps.select("id", "doc_id", "_key", "bands", "sketch").dropDuplicates(["id"]))
    edges = links(reps, docs)
    roots = None if edges is None else components(edges)
    rows = signed.select("doc_id", "_key", "id")
    rows = rows.withColumn("root", F.col("id")) if roots is None else salted_join(rows, cut_lineage(roots.join(best.select("id", "n"), "id")), "id", "n", "left").drop("n").withColumn("root", F.coalesce("root", "id"))
    rows = cut_lineage(rows.withColumn("root", F.struct(F.col("root"), F.when(F.col("root").isNull(), F.struct(F.col("doc_id"), F.col("_key"))))))
    size = cut_lineage(rows.groupBy("root").agg(F.count("*").alias("class_size"), F.min(place).alias("p")))
    same = rows.groupBy("root", "doc_id", "_key").agg(F.count("*").alias("same"))
    out = salted_join(same, size, "root", "class_size").withColumn("first", F.col("doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("_key") == F.col("p._key")))
    out = out.select("doc_id", "_key", F.col("p.doc_id").alias("class_id"), F.when(F.col("root.root").isNull(), F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"), "same", (F.col("first") | F.col("root.root").isNull()).alias("first"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "same"))).select("doc_id", "_key", "class_id", "class_size", "same", "first", "copy")


@shielded
def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class, with its own columns."""
    told = cut_lineage(near_duplicates(docs).filter("copy = 1 AND (NOT first OR (same > 1 AND class_size > 1))").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "first"))
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_k"))
    out = docs.join(told.drop("first"), match, "left_anti")
    twice = told.filter("first")
    if twice.isEmpty():
        return out
    return out.union(docs.join(twice.drop("first"), match, "left_semi").dropDuplicates(["doc_id", "text"]))


def op7_minhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "class_size", (F.col("first") & (F.col("copy") == 1)).alias("kept"))
