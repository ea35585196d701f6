"""Line dedup with an edit join on segments.

Two distinct lines within ``tau`` edits agree in one of ``tau`` + 1 segments of the shorter one, at its
place or moved by a few characters: with p segments before it, p edits at most are before it and
tau - p after it. Lines are indexed under (length, segment number, segment) and probe the
indexes of their own and the ``tau`` next shorter lengths. Pairs are verified with the
bit-parallel edit distance in a band.

A segment that over ``hot`` index and probe rows share is not expanded into pairs. What its lines
have not agreed in yet, left and right of the segment, is cut into segments again, by the edits
that each side may have, and the lines meet under the first segment and the second, and so
on until few share a key. Where a region has no more characters than edits, its lines meet
under the characters that they keep; all that share such a key are within ``tau`` of each other. At
every level each line is verified against the earliest line of the other kind, and keys without
an open line are left. So lines differ in the number of levels only, and nothing is lost.

A line is removed if it, or a line within ``tau`` edits, comes earlier: in a smaller doc_id
(null last, then text hash), or earlier in the same text. Lines of fewer than ``min_chars`` code
points have to be equal. Lines are compared without white space at their ends; blank lines
stay where they are.

Defined cases: null texts have no lines and stay null; texts without a removed line stay as they
are; rows equal in doc_id and text are one document and lose the same lines. Very long texts and
lines are handled whole. Other columns pass through, whatever their names; n_lines and n_removed
replace columns of these names.
"""

from __future__ import annotations

import functools
import os.path
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import let, salted_join, shielded, small_batches, table, text_key
from .hashing import Spans, blocks, mix

TAU, MIN_CHARS, HOT = 1, 20, 32
ID = "binary"
#: Rows of which a worker holds the finer ones at once.
PART = 500
#: A region not agreed in yet: its start and length in the own line, its length in the indexed line, and its edits at most.
REGIONS = "array<struct<start:int,n:int,indexed:int,edits:int>>"
BLANK = " \t\n\x0b\x0c\r"
cut_lineage = functools.partial(common.cut_lineage, few=True)


def line_key(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.unhex(F.md5(line))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, _key, at, line for every line that is not blank."""
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("_key"), "text")  # once a text, not once a line
    rows = keyed.select("doc_id", "_key", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.withColumn("line", F.btrim("line", F.lit(BLANK))).filter("line <> ''")


def code_points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    return data, np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)


def shifts(p: int, longer: int, edits: int) -> range:
    """How far segment p of an indexed line can have moved in one that is ``longer`` by so much."""
    return range(max(-p, longer - (edits - p)), min(p, longer + edits - p) + 1)


def first_codes(tau: int) -> list[tuple[int, int, int]]:
    """(characters more than the indexed line, segment, shift): first the index rows, which also probe, then the other probes."""
    probes = [(d, p, s) for d in range(tau + 1) for p in range(tau + 1) for s in shifts(p, d, tau) if d or s]
    return [(0, p, 0) for p in range(tau + 1)] + probes


def segment_rows(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    """(key, id, code): the rows of the lines for each of first_codes. Of a block of lines at a time, so that a worker holds little beside its batch."""
    for batch, _, _ in blocks(batches, "line"):
        ids = batch.column("id")
        data, at = code_points(batch.column("line").to_pylist())
        spans, n, a = Spans(data), np.diff(at), at[:-1]
        for code, (d, p, s) in enumerate(first_codes(tau)):
            size = n - d  # of the indexed line
            start, end = size * p // (tau + 1) + s, size * (p + 1) // (tau + 1) + s
            ok = (start >= 0) & (end <= n) & (size > tau)
            key = mix(spans.of((a + start)[ok], (a + end)[ok]) ^ mix((size[ok] * (tau + 1) + p).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids.filter(pa.array(ok)), pa.array(np.full(len(key), code, np.int16))], ["key", "id", "code"])


def parted(start: int, n: int, indexed: int, edits: int, p: int, s: int) -> list[tuple[int, int, int, int]]:
    """What is left of a region around its segment p, moved by s; a side that may have no edit is agreed in."""
    low, high = indexed * p // (edits + 1), indexed * (p + 1) // (edits + 1)
    sides = ((start, low + s, low, p), (start + high + s, n - high - s, indexed - high, edits - p))
    return [x for x in sides if x[3]]


def opened(n: int, code: int, tau: int) -> list[tuple[int, int, int, int]]:
    """The regions of a line of n characters after its row of segment_rows."""
    d, p, s = first_codes(tau)[code]
    return parted(0, n, n - d, tau, p, s)


def kept_characters(line: str, start: int, n: int, indexed: int, edits: int, probe: bool) -> list[tuple]:
    """Keys of a region in which the indexed line has no more characters than edits: characters that both keep, with their places in the
    indexed line. A probe has those whose gaps need ``edits`` edits at most."""
    out = []
    for k in range(min(n, indexed) + 1):
        for places in combinations(range(indexed), k):
            for own in combinations(range(n), k) if probe else (places,):
                if probe:
                    gaps = zip((-1, *places), (*places, indexed), (-1, *own), (*own, n), strict=True)
                    if sum(max(b - a, d - c) - 1 for a, b, c, d in gaps) > edits:
                        continue
                out.append((places, "".join(line[start + i] for i in own)))
    return list(dict.fromkeys(out))


def finer(key: int, line: str, regions: list[dict], probe: bool) -> Iterator[tuple[int, list[tuple] | None]]:
    """The keys of the next level and their regions, or None if all lines that share the key are near."""

    def child(*told) -> int:
        return int.from_bytes(blake2b(repr((key, *told)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)

    each = [(r["start"], r["n"], r["indexed"], r["edits"]) for r in regions]
    i = max(range(len(each)), key=lambda j: (each[j][2] > each[j][3]) * each[j][2])
    start, n, indexed, edits = each[i]
    if indexed <= edits:
        for kept in product(*[kept_characters(line, *r, probe) for r in each]):
            yield child("kept", kept), None
        return
    rest = each[:i] + each[i + 1 :]
    for p in range(edits + 1):
        low, high = indexed * p // (edits + 1), indexed * (p + 1) // (edits + 1)
        for s in shifts(p, n - indexed, edits) if probe else (0,):
            if low + s >= 0 and high + s <= n:
                yield child(i, p, line[start + low + s : start + high + s]), [*rest, *parted(start, n, indexed, edits, p, s)]


def finer_rows(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    """(key, id, probe, regions, line) rows, or with code in place of probe and regions -> the rows of the next level."""
    for batch in (b.slice(low, PART) for b in batches for low in range(0, b.num_rows, PART)):
        keys, ids, probes, regions = [], [], [], []
        for r in batch.to_pylist():
            if "code" not in r:
                roles = [(r["probe"], r["regions"])]
            else:
                own = [dict(zip(("start", "n", "indexed", "edits"), x, strict=True)) for x in opened(len(r["line"]), r["code"], tau)]
                roles = [(True, own)] if r["code"] > tau else [(False, own), (True, own)]
            for probe, own in roles:
                for key, left in finer(r["key"], r["line"], own, probe):
                    keys.append(key)
                    ids.append(r["id"])
                    probes.append(probe)
                    regions.append(None if left is None else [dict(zip(("start", "n", "indexed", "edits"), x, strict=True)) for x in left])
        kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "n", "indexed", "edits")]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, batch.schema.field("id").type), pa.array(probes, pa.bool_()), pa.array(regions, kind)], ["key", "id", "probe", "regions"])


def within(a: str, b: str, tau: int) -> bool:
    """Whether the edit distance is at most tau. Bit k of a vector is row j - tau + k of column j, so 2 tau + 1 bits hold the band."""
    m, n = len(a), len(b)
    if abs(m - n) > tau:
        return False
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + tau)
    full, low = (1 << (2 * tau + 1)) - 1, 1 << (2 * tau)
    plus, minus, score = ((1 << (tau + 1)) - 1) << tau, 0, min(m, tau)
    for j, c in enumerate(b, 1):
        same = where.get(c, 0) >> (j - 1) & full
        diagonal = ((((same & plus) + plus) ^ plus) | same | minus) & full
        up, down = (minus | ~(diagonal | plus)) & full, diagonal & plus
        if j <= m - tau:
            score += not diagonal & low
        else:
            at = 1 << (m - j + tau)
            score += bool(up & at) - bool(down & at)
        if score > 3 * tau:
            return False
        plus, minus = (down | ~((diagonal >> 1) | up)) & full, (diagonal >> 1) & up
    return score <= tau


def unlike(a: str, b: str) -> tuple[str, str]:
    """Both without the characters that their ends share, which don't change their distance."""
    i = len(os.path.commonprefix([a, b]))
    a, b = a[i:], b[i:]
    j = len(os.path.commonprefix([a[::-1], b[::-1]]))
    return a[: len(a) - j], b[: len(b) - j]


def verify_rows(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [within(*unlike(x, y), tau) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def verified(pairs: DataFrame, long: DataFrame, tau: int) -> DataFrame:
    """The pairs (a, b) of different lines within tau edits. The lines that are in a pair are found by a join that is planned alike at every size."""
    pairs = cut_lineage(pairs.filter("a <> b").distinct())
    ids = cut_lineage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    text = cut_lineage(long.select("id", "line").join(ids.hint("merge"), "id", "left_semi"))
    met = pairs.join(text.toDF("a", "x"), "a").join(text.toDF("b", "y"), "b")
    return cut_lineage(met.select("a", "b", "x", "y").mapInArrow(lambda b: verify_rows(b, tau), f"a {ID}, b {ID}"))


def hot_pairs(rows: DataFrame, long: DataFrame, tau: int, hot: int) -> list[DataFrame]:
    """Near pairs (a, b), one table a level, of the rows (key, id, code) of hot keys. Every line with an earlier neighbour there is an a with an earlier b."""
    told = cut_lineage(long.join(cut_lineage(rows.select("id").distinct()), "id").select("id", "line", "f"))
    out: list[DataFrame] = []
    rows = rows.join(told.select("id", "line"), "id")
    kind = f"key long, id {ID}, probe boolean, regions {REGIONS}"
    while not rows.isEmpty():
        rows = cut_lineage(rows.mapInArrow(lambda b: finer_rows(b, tau), kind).join(told.select("id", "f"), "id"))
        first = lambda probe: F.min(F.when(F.col("probe") == probe, F.struct("f", "id")))
        g = rows.groupBy("key").agg(F.count("*").alias("n"), first(False).alias("i"), first(True).alias("p")).filter("i IS NOT NULL AND p IS NOT NULL")
        rows = cut_lineage(salted_join(rows, cut_lineage(g), "key", "n").withColumn("e", F.when(F.col("probe"), F.col("i")).otherwise(F.col("p"))).drop("i", "p"))
        few = rows.filter(F.col("n") <= hot)
        pairs = few.filter("probe").select("key", F.col("id").alias("a")).join(few.filter("NOT probe").select("key", F.col("id").alias("b")), "key").select("a", "b")
        rows = rows.filter(F.col("n") > hot)
        near = verified(pairs.union(rows.filter("e.f < f").select(F.col("id").alias("a"), F.col("e.id").alias("b"))), told, tau)
        out.append(near)
        # A line is open unless an earlier line has been found near it.
        place = told.select("id", "f")
        both = near.union(near.select("b", "a")).join(place.toDF("a", "fa"), "a").join(place.toDF("b", "fb"), "b").filter("fb < fa")
        done = cut_lineage(both.select(F.col("a").alias("id")).distinct().withColumn("done", F.lit(True)))
        rows = rows.join(done, "id", "left").filter("regions IS NOT NULL")
        keys = cut_lineage(rows.groupBy("key").agg(F.count("*").alias("m"), F.count_if(F.expr("done IS NULL AND e.f < f")).alias("open")).filter("open > 0").select("key", "m"))
        rows = cut_lineage(salted_join(rows.select("key", "id", "probe", "regions"), keys, "key", "m").drop("m")).join(told.select("id", "line"), "id")
    return out


def earlier_lines(distinct: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """(id, line, size, f) of distinct lines, f the first place -> (id, g): the first place of the lines found within tau edits; the least of them is earlier if any is."""
    long = distinct.filter(F.col("size") >= max(min_chars, 2 * tau + 1))
    rows = long.select("id", "line").mapInArrow(lambda b: segment_rows(b, tau), f"key long, id {ID}, code short")
    met = cut_lineage(rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("code") > tau).alias("p")).filter("n > 1 AND n > p"))
    rows = cut_lineage(salted_join(rows, met, "key", "n"))
    few = rows.filter(F.col("n") <= hot)
    pairs = few.filter(F.col("code") <= tau).select("key", F.col("id").alias("a")).join(few.select("key", F.col("id").alias("b"), "code"), "key")
    near = [verified(pairs.filter((F.col("code") > tau) | (F.col("a") < F.col("b"))).select("a", "b"), long, tau)]
    many = rows.filter(F.col("n") > hot).select("key", "id", "code")
    near += [] if many.isEmpty() else hot_pairs(many, long, tau, hot)
    pairs = functools.reduce(DataFrame.union, near)
    both = cut_lineage(pairs.union(pairs.select("b", "a")).toDF("id", "b").distinct())
    out = both.join(long.select(F.col("id").alias("b"), "f"), "b")
    return out.groupBy("id").agg(F.min("f").alias("g"))


@shielded
def dedup_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """docs with the repeated lines removed from text, and n_lines and n_removed, both without blank lines."""
    docs = docs.drop("n_lines", "n_removed")
    spark = docs.sparkSession
    small_batches(spark)
    rows = lines_of(docs.select("doc_id", "text")).withColumn("id", line_key(F.col("line")))
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_key", "at")
    distinct = cut_lineage(rows.groupBy("id").agg(F.min(place).alias("f"), F.first("line").alias("line"), F.count("*").alias("n")).withColumn("size", F.length("line")))
    near = cut_lineage(earlier_lines(distinct.select("id", "line", "size", "f"), tau, min_chars, hot))
    # Lines that occur once and have no earlier neighbour stay; only the others go back to their rows.
    known = distinct.select("id", "f", "n").join(near, "id", "left").filter("n > 1 OR g < f")
    known = cut_lineage(known.select("id", "n", "f", F.coalesce(F.col("g") < F.col("f"), F.lit(False)).alias("all")))
    gone = salted_join(rows.select("id", "doc_id", "_key", "at"), known, "id", "n").filter(F.col("all") | (place != F.col("f")))
    gone = gone.groupBy("doc_id", "_key").agg(F.collect_set("at").alias("_gone")).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "_gone")
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_k")), "left")
    # array_except has a hash set of the removed lines, so this is linear in the lines.
    left = let(F.split("text", "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "_gone"), lambda i: F.get(x, i)), "\n"))
    # A line that is not blank is its first other character and what follows up to its end.
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*")), F.lit(0)).cast("long")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left)
    return out.withColumns({"n_lines": n, "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"), "_new": text}).select(*[F.col("_new").alias("text") if c == "text" else c for c in docs.columns], "n_lines", "n_removed")


def op3_lines(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")
