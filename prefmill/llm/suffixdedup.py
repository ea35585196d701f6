"""Exact substring dedup over a sparse suffix array, sorted deep-shallow.

A byte goes if it lies in a string of WINDOW bytes that also starts earlier. Every such window
names as its anchor the K-gram in it with the smallest hash, so equal windows
name the same K-gram at the same place. The windows of a text with one anchor form a run.

Runs meet by their anchor's K-gram. Runs with equal bytes repeat the first of them in whole.
Where a K-gram has unequal runs, the first of each kind sends its bytes: the suffixes behind the
anchors are sorted by numpy's lexsort of two 8-byte keys to a shallow depth and, where their common
prefixes are longer, by blind tries; windows are equal if their right parts lie in one
interval of the array with common prefixes long enough, and their left parts are equal.
Runs that repeat one of the same block of texts are told apart before that and dealt out at random;
K-grams with over HOT kinds of runs are spread by offset and window hash, so no task holds all of one.

Defined cases: a null text is empty; texts of fewer than WINDOW bytes lose nothing; rows equal
in doc_id and text are one document and lose the same bytes; null doc_ids come last, then the
order is by text hash. Texts of any length are handled whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, small_batches, table, text_key
from .hashing import Spans, blocks, mix

WINDOW, K = 100, 20
#: Bytes behind the K-gram that the shallow sort looks at, eight at a time.
SHALLOW = 16
HOT, SALTS = 2000, 64
LOW32 = np.uint64(0xFFFFFFFF)


def anchors(data: np.ndarray, offsets: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window, its anchor): sliding minima of hash and place, from prefix and suffix minima of chunks."""
    m = WINDOW - K + 1
    starts = np.arange(max(0, len(data) - WINDOW + 1))
    inside = np.ones(len(starts), bool)
    for o in offsets[1:-1]:  # windows across the ends of texts
        inside[max(0, o - WINDOW + 1) : o] = False
    starts = starts[inside]
    if not len(starts):
        return starts, starts
    packed = (grams & ~LOW32) | np.arange(len(grams), dtype=np.uint64)
    full = np.full(-(-len(packed) // m) * m + m, ~np.uint64(0))
    full[: len(packed)] = packed
    left = np.minimum.accumulate(full.reshape(-1, m), axis=1).reshape(-1)
    right = np.minimum.accumulate(full.reshape(-1, m)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return starts, (np.minimum(right[starts], left[starts + m - 1]) & LOW32).astype(np.int64)


def repeats(batch: pa.RecordBatch, h: np.ndarray, s: np.ndarray, row: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Runs that repeat an earlier one of the same block. They go whatever else there is, so they need not meet the others of their K-gram."""
    doc, key = batch.column("doc_id"), batch.column("_key").to_numpy()
    none, doc = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
    by = np.lexsort((key, doc, none))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(np.append(0, (np.diff(doc[by]) != 0) | (np.diff(key[by]) != 0) | (np.diff(none[by].astype(int)) != 0))) if len(by) else by
    place = rank[row] << 32 | p
    order = np.lexsort((place, s, h))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (s[order][1:] != s[order][:-1])) if len(order) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    out = np.zeros(len(order), bool)
    out[order] = place[order] != place[order][head]
    return out


def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in blocks(batches):
        s = Spans(data)
        at = np.arange(max(0, len(data) - K + 1))
        grams = s.of(at, at + K)
        start, anchor = anchors(data, offsets, grams)
        row = np.searchsorted(offsets, start, "right") - 1
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)) if len(start) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(start)))
        p, a, row = start[first], anchor[first], row[first]
        same = s.of(p, p + n - 1 + WINDOW) ^ mix((a - p).astype(np.uint64))
        h, p, done = grams[a], p - offsets[row], repeats(batch, grams[a], same, row, p - offsets[row])
        h = np.where(done, mix(same ^ mix(p.astype(np.uint64) + (row.astype(np.uint64) << np.uint64(40)))), h)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(h.view(np.int64)), pa.array(same.view(np.int64)), batch.column("doc_id").take(take), batch.column("_key").take(take),
                pa.array(p.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array((a - start[first]).astype(np.int32)), pa.array(done),
            ],
            ["h", "s", "doc_id", "_key", "p", "n", "off", "done"],
        )


def met_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by K-gram, kind and place, in batches that may part a group: v = 0 for runs equal to an earlier one, v = 1 for the first of each kind where a K-gram has several.

    What is held from one batch to the next is the first run of the K-gram and of the kind that the batch ends in.
    """
    held = None
    for batch in batches:
        rows = batch if held is None else pa.Table.from_batches([*held.to_batches(), batch]).combine_chunks().to_batches()[0]
        old = 0 if held is None else held.num_rows
        if not rows.num_rows:
            continue
        h, s, key, p = (rows.column(k).to_numpy() for k in ("h", "s", "_key", "p"))
        doc, none = rows.column("doc_id").fill_null(0).to_numpy(), rows.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        at = np.arange(len(h))
        new_h = np.append(True, h[1:] != h[:-1])
        new_s = new_h | np.append(True, s[1:] != s[:-1])
        head_h, head_s = np.maximum.accumulate(np.where(new_h, at, 0)), np.maximum.accumulate(np.where(new_s, at, 0))
        done = rows.column("done").to_numpy(zero_copy_only=False)
        count = np.cumsum(new_s)
        rank = count - count[head_h]
        fresh = at >= old
        other = ~new_s & fresh & ((doc != doc[head_s]) | (none != none[head_s]) | (key != key[head_s]) | (p != p[head_s]))
        other |= done & fresh
        kinds = np.flatnonzero(new_s & fresh & ~done & (rank >= 1))
        firsts = head_h[kinds[rank[kinds] == 1]]
        out = np.concatenate([np.flatnonzero(other), firsts, kinds])
        v = np.concatenate([np.zeros(other.sum(), np.int32), np.ones(len(firsts) + len(kinds), np.int32)])
        part = rows.take(pa.array(out))
        yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("h", "doc_id", "_key", "p", "n", "off")), pa.array(v)], ["h", "doc_id", "_key", "p", "n", "off", "v"])
        last = [head_h[-1]] if head_h[-1] == head_s[-1] else [head_h[-1], head_s[-1]]
        held = pa.Table.from_batches([rows.take(pa.array(last))])


def context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, doc_id, _key, p, n, off, bytes up to WINDOW behind the anchor) of the runs in _runs; those of hot K-grams window by window."""
    for batch, data, offsets in blocks(batches):
        runs = batch.column("_runs")
        if not len(runs.values):
            continue
        row = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
        flat = runs.flatten()
        h, p, n, off, v = (flat.field(k).to_numpy() for k in ("h", "p", "n", "off", "v"))
        hot = v > HOT
        each = np.where(hot, n, 1)
        i = np.repeat(np.arange(len(h)), each)
        shift = np.where(hot[i], np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each), 0)
        row, h, p, off, n = row[i], h[i], p[i] + shift, off[i] - shift, np.where(hot[i], 1, n[i])
        begin = offsets[row] + p
        end = np.minimum(begin + off + WINDOW, offsets[row + 1])
        salt = Spans(data).of(begin, begin + WINDOW) % np.uint64(SALTS)
        g = np.where(hot[i], mix(h.view(np.uint64) ^ mix(off.astype(np.uint64) * np.uint64(SALTS) + salt)), h.view(np.uint64)).view(np.int64)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(g), batch.column("doc_id").take(take), batch.column("_key").take(take), pa.array(p.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)),
                pa.array([data[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary()),
            ],
            ["g", "doc_id", "_key", "p", "n", "off", "bytes"],
        )


def blind_trie(strings: list[bytes]) -> list[tuple[int, int]]:
    """(number, common prefix with the one before it) of strings in order. A node knows its depth and the next bytes only; a leaf holds equal strings."""
    size = max(map(len, strings))
    value = [int.from_bytes(s.ljust(size, b"\0"), "big") for s in strings]
    root: list = [None, [0]]  # a leaf: [None, numbers]; a node: [depth, {byte: child}]
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while node[0] is not None:
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
        other = node[1][0]
        diff = value[i] ^ value[other]
        if not diff:
            node[1].append(i)
            continue
        common = size - (diff.bit_length() + 7) // 8
        byte = lambda x: x[common] if common < len(x) else -1  # noqa: B023, E731
        node = root
        while node[0] is not None and node[0] < common:
            node = node[1][s[node[0]]]
        if node[0] == common:
            node[1][byte(s)] = [None, [i]]
        else:
            node[:] = [common, {byte(strings[other]): list(node), byte(s): [None, [i]]}]
    out: list[tuple[int, int]] = []
    todo = [(root, 0)]
    while todo:
        node, common = todo.pop()
        if node[0] is None:
            out.append((node[1][0], common))
            out += [(i, size) for i in node[1][1:]]
        else:
            keys = sorted(node[1])
            todo += [(node[1][k], node[0]) for k in reversed(keys[1:])] + [(node[1][keys[0]], common)]
    return out


def sorted_suffixes(group: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes [start, end) by group and bytes, and common prefixes with the one before (0 at the start of a group). Bytes are 1 to 255; 0 stands for the end."""
    padded = np.append(data, np.zeros(SHALLOW + 8, np.uint8))
    words = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
    depth = np.minimum(end - start, SHALLOW)
    keys = []
    for k in range(0, SHALLOW, 8):
        w = words[np.minimum(start + k, len(data))].astype(np.uint64)
        have = np.clip(end - start - k, 0, 8)
        keys.append(np.where(have > 0, w & ~((np.uint64(1) << ((8 - np.maximum(have, 1)) * 8).astype(np.uint64)) - np.uint64(1)), np.uint64(0)))
    order = np.lexsort([*reversed(keys), group])
    common = np.zeros(len(order), np.int64)
    alive = np.append(False, group[order][1:] == group[order][:-1])
    for key in keys:
        x = np.append(np.uint64(0), key[order][1:] ^ key[order][:-1])
        bytes_ = np.where(x == 0, 8, 7 - np.frexp(x.astype(np.float64))[1].clip(1, 64).astype(np.int64).__sub__(1) // 8)
        common += np.where(alive, bytes_, 0)
        alive &= x == 0
    common = np.minimum(common, np.minimum(depth[order], np.append(0, depth[order][:-1])))
    deep = alive
    first = np.flatnonzero(~deep)
    size = np.diff(np.append(first, len(order)))
    for a, n in zip(first[size > 1], size[size > 1], strict=True):
        part = order[a : a + n]
        tails = [data[min(start[i] + SHALLOW, end[i]) : end[i]].tobytes() for i in part]
        done = blind_trie(tails)
        order[a : a + n] = part[[i for i, _ in done]]
        common[a + 1 : a + n] = [SHALLOW + c for _, c in done[1:]]
    return order, common


def equal_windows(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """(doc_id, _key, start, end) of the windows of whole groups that have an earlier equal one, joined where they overlap in a run."""
    data = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8) + np.uint8(1)
    size = rows.column("bytes").combine_chunks()
    length = np.array([len(x) for x in size.to_pylist()])
    begin = np.cumsum(length) - length
    g, p, n, off = (rows.column(k).to_numpy() for k in ("g", "p", "n", "off"))
    anchor = begin + off
    doc = rows.column("doc_id").to_pandas()
    none, doc = doc.isna().to_numpy(), doc.fillna(0).to_numpy().astype(np.int64)
    key = rows.column("_key").to_numpy()
    by = np.lexsort((key, doc, none))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(np.append(0, (np.diff(doc[by]) != 0) | (np.diff(key[by]) != 0) | (np.diff(none[by].astype(int)) != 0)))
    order, common = sorted_suffixes(g, data, anchor + K, begin + length)
    new_group = np.append(True, g[order][1:] != g[order][:-1])
    s = Spans(data)
    found = np.zeros((len(g), WINDOW - K + 3), bool)
    for o in range(WINDOW - K + 1):
        has = (off >= o) & (off - o < n)
        if not has.any():
            continue
        interval = np.empty(len(g), np.int64)
        interval[order] = np.cumsum(new_group | (common < WINDOW - K - o))
        i = np.flatnonzero(has)
        left = s.of(anchor[i] - o, anchor[i])
        place = rank[i] << 32 | (p[i] + off[i] - o)
        by = np.lexsort((place, left, interval[i]))
        i, left, place = i[by], left[by], place[by]
        new = np.append(True, (interval[i][1:] != interval[i][:-1]) | (left[1:] != left[:-1]))
        head = np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
        later = place != place[head]
        found[i[later], off[i[later]] - o + 1] = True
    step = np.diff(found.astype(np.int8), axis=1)
    row, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    take = pa.array(row)
    yield pa.RecordBatch.from_arrays(
        [rows.column("doc_id").combine_chunks().take(take), rows.column("_key").combine_chunks().take(take), pa.array((p[row] + a).astype(np.int32)), pa.array((p[row] + b - 1 + WINDOW).astype(np.int32))], ["doc_id", "_key", "start", "end"]
    )


def window_rows(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows sorted by g, some 20,000 rows at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            t = pa.Table.from_batches(held)
            g = t.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1]))
            if cut:
                yield from equal_windows(t.slice(0, cut))
            held = t.slice(cut).to_batches()
    if held:
        yield from equal_windows(pa.Table.from_batches(held))


def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in blocks(batches):
        spans = batch.column("_gone")
        mark = np.zeros(len(data) + 1, np.int32)
        if len(spans.values):
            row = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
            flat = spans.flatten()
            np.add.at(mark, offsets[row] + flat.field("start").to_numpy(), 1)
            np.add.at(mark, offsets[row] + flat.field("end").to_numpy(), -1)
        gone = np.cumsum(mark)[:-1] > 0
        total = np.append(0, np.cumsum(gone))
        edge = gone & ~np.append(False, gone[:-1])
        first = offsets[:-1][np.diff(offsets) > 0]
        edge[first] = gone[first]
        edges = np.append(0, np.cumsum(edge))
        kept = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(np.diff(edges[offsets])), pa.array(kept)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, _key, _gone): the byte spans that go, possibly overlapping, of every document that has any."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("_key"), "text")
    runs = d.mapInArrow(run_rows, "h long, s long, doc_id long, _key long, p int, n int, off int, done boolean").repartition("h")
    runs = runs.sortWithinPartitions("h", "s", F.col("doc_id").asc_nulls_last(), "_key", "p")
    met = cut_lineage(runs.mapInArrow(met_rows, "h long, doc_id long, _key long, p int, n int, off int, v int"), free=True)
    whole = met.filter("v = 0").select("doc_id", "_key", F.col("p").alias("start"), (F.col("p") + F.col("n") - 1 + WINDOW).alias("end"))
    kinds = met.filter("v = 1").drop("v")
    many = kinds.groupBy("h").agg(F.count("*").alias("v")).filter(f"v > {HOT}")
    kinds = kinds.join(many, "h", "left").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), F.struct("h", "p", "n", "off", F.coalesce(F.col("v").cast("int"), F.lit(2)).alias("v")).alias("r"))
    sent = kinds.groupBy("_id", "_k").agg(F.collect_set("r").alias("_runs"))
    some = d.join(sent, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k"))).select("doc_id", "_key", "text", "_runs")
    parts = some.mapInArrow(context_rows, "g long, doc_id long, _key long, p int, n int, off int, bytes binary").repartition("g").sortWithinPartitions("g")
    # In tables of their own, so that the exchanges of runs, texts and spans are never on disk together.
    windows = cut_lineage(parts.mapInArrow(window_rows, "doc_id long, _key long, start int, end int"), free=True)
    return cut_lineage(whole.union(windows).groupBy("doc_id", "_key").agg(F.collect_set(F.struct("start", "end")).alias("_gone")), free=True)


def op9_suffix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    small_batches(spark)
    gone = repeated_spans(docs).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "_gone")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("_key"), "text")
    d = d.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")), "left")
    d = d.select("doc_id", "text", F.coalesce("_gone", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("_gone"))
    return d.mapInArrow(cut_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
