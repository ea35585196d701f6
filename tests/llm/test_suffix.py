"""Substring dedup against a dictionary of all windows, and its sorting against sorted()."""

import hashlib
import random

import numpy as np
import pytest

from prefmill.llm import suffixdedup as S


def brute(docs):
    first, out = {}, {}
    rows = sorted(set(docs), key=lambda r: (r[0] is None, r[0] or 0))
    for d, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - S.WINDOW + 1):
            w = b[p : p + S.WINDOW]
            if first.setdefault(w, (d, p)) != (d, p):
                gone[p : p + S.WINDOW] = b"\1" * S.WINDOW
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def run(spark, df):
    df.write.mode("overwrite").parquet(path := f"/tmp/prefmill-suffix-{random.random()}/documents.parquet")
    try:
        return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op9_suffix(spark, path.rsplit("/", 1)[0]).collect()}
    finally:
        import shutil

        shutil.rmtree(path.rsplit("/", 1)[0])


def test_sf001(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert run(spark, df) == brute([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("hot", [False, True])
def test_edited_copies(spark, monkeypatch, hot):
    """Copies with edits, shared passages, periodic and short texts, also with every K-gram taken as hot."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcd é\n") for _ in range(n))
    base, passage = text(900), text(130)
    docs = [(0, base), (1, "ab" * 300), (2, "ab" * 150 + "x" + "ab" * 150), (3, ""), (4, None), (5, passage[:99]), (6, passage[:100]), (7, "\0" * 220)]
    for i in range(8, 60):
        s = list(base)
        for _ in range(rng.randrange(4)):
            s[rng.randrange(len(s))] = rng.choice(["", "Z", "yy"])
        docs.append((i, "".join(s)[rng.randrange(300) :] if rng.random() < 0.6 else text(rng.randrange(200)) + passage + text(rng.randrange(200)) + passage))
    if hot:
        from pyspark import cloudpickle

        monkeypatch.setattr(S, "HOT", 1)
        cloudpickle.register_pickle_by_value(S)
    try:
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert run(spark, df) == brute(docs)
    finally:
        if hot:
            cloudpickle.unregister_pickle_by_value(S)


def test_odd_rows(spark):
    docs = [(1, "a" * 150), (1, "a" * 150), (None, "a" * 150), (2, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert run(spark, df) == brute(docs)
    assert run(spark, df.limit(0)) == {}


def test_sorting():
    rng = random.Random(2)
    strings = []
    for _ in range(400):
        s = bytes(rng.choice([1, 2, 255]) for _ in range(rng.randrange(60)))
        strings.append(rng.choice([s, b"\2" * rng.randrange(50), (strings[-1][: rng.randrange(len(strings[-1]) + 1)] if strings else b"") + s]))
    group = np.array([rng.randrange(3) for _ in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    end = np.cumsum([len(s) for s in strings])
    order, common = S.sorted_suffixes(group, data, end - np.array([len(s) for s in strings]), end)
    got = [(group[i], strings[i]) for i in order]
    assert got == sorted(got)
    for k in range(1, len(got)):
        want = 0
        if got[k][0] == got[k - 1][0]:
            a, b = got[k][1], got[k - 1][1]
            want = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            if a == b:
                assert common[k] >= want
                continue
        assert common[k] == want


def test_shuffles_go_with_their_step(spark, monkeypatch):
    """What a step shuffled is off the disk when the next one begins, without waiting for a garbage collection; the setting for that is as it was."""
    import time

    files = lambda: {str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if str(f).endswith(".data")}
    steps, cut, before = [], S.cut_lineage, files()

    def watched(df, *args, **kwargs):
        out = cut(df, *args, **kwargs)
        until = time.time() + 5
        while (left := files() - before) and time.time() < until:
            time.sleep(0.1)
        steps.append(len(left))
        return out

    monkeypatch.setattr(S, "cut_lineage", watched)
    text = "".join(chr(97 + i * i % 23) for i in range(400))
    docs = spark.createDataFrame([(i, text + str(i) * 50) for i in range(20)], "doc_id long, text string")
    assert S.repeated_spans(docs).count() == 20
    assert len(steps) == 3 and not any(steps)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
