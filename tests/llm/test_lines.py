"""Line dedup against brute force."""

import random
import time
from pathlib import Path

import pytest

from prefmill.llm import linededup as L
from prefmill.llm.common import ADVISED, shared_folder

EDGE = "\t\n\x0b\x0c\r "


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bit_parallel_distance():
    rng = random.Random(0)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(3)
            i = rng.randrange(len(b) + 1)
            if k == 0:
                b.insert(i, rng.choice("abc"))
            elif b and i < len(b):
                b[i : i + 1] = [] if k == 1 else [rng.choice("abc")]
        b = "".join(b)
        for tau in (1, 2, 3):
            assert L.within(a, b, tau) == L.within(*L.unlike(a, b), tau) == (distance(a, b) <= tau), (a, b, tau)


def brute(docs, tau=L.TAU):
    """Texts left over, with a scan of all lines before each line."""
    seen, out = [], []
    exact = set()
    for _, text in docs:
        keep = []
        for line in text.split("\n"):
            s = line.strip(EDGE)
            gone = False
            if s:
                gone = s in exact or len(s) >= L.MIN_CHARS and any(abs(len(s) - len(t)) <= tau and len(t) >= L.MIN_CHARS and L.within(*L.unlike(s, t), tau) for t in seen)
                if s not in exact:
                    exact.add(s)
                    seen.append(s)
            if not gone:
                keep.append(line)
        out.append("\n".join(keep))
    return out


def noisy(rng, base):
    s = list(base)
    k, i = rng.randrange(4), rng.randrange(len(s))
    if k == 1:
        s[i] = rng.choice("xyz")
    elif k == 2:
        s.insert(i, rng.choice("xyz"))
    elif k == 3:
        del s[i]
    return "".join(s)


@pytest.mark.parametrize(("tau", "hot", "one_base"), [(1, 32, False), (1, 32, True), (1, 2, True), (2, 32, False), (2, 3, True), (3, 4, True)])
def test_matches_brute_force(spark, tau, hot, one_base):
    """With few rows a key, segments are split again level by level, down to characters."""
    rng = random.Random(3)
    bases = ["".join(rng.choice("abcdefg h") for _ in range(n)) for n in ([30] if one_base else (10, 19, 20, 21, 22, 40, 60, 80))]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(5):
            s = rng.choice(bases)
            for _ in range(rng.randrange(2, 2 * tau + 2)):
                s = noisy(rng, s)
            lines.append(s if rng.random() < 0.8 else rng.choice(["", "  ", " x ", "y"]))
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.dedup_lines(df, tau, hot=hot).collect()}
    assert [got[i] for i in range(60)] == brute(docs, tau)


def shared(tau, a, b, code_a, code_b):
    """Whether the lines meet in a key that says they are near, with the finer levels followed to their end."""
    todo = [(0, L.opened(len(a), code_a, tau), L.opened(len(b), code_b, tau))]
    named = lambda regions: [dict(zip(("start", "n", "indexed", "edits"), x)) for x in regions]
    while todo:
        key, ra, rb = todo.pop()
        x = dict(L.finer(key, a, named(ra), False))
        for k, left in L.finer(key, b, named(rb), True):  # a key may be there with more than one shift
            if k in x and x[k] is None:
                return True
            if k in x:
                todo.append((k, x[k], left))
    return False


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_levels_end_in_near_lines_only(tau):
    """Two lines meet in a last key if and only if they are within tau edits."""
    rng = random.Random(tau)
    codes = L.first_codes(tau)
    for _ in range(400):
        a = b = "".join(rng.choice("abc") for _ in range(rng.randrange(2 * tau + 1, 16)))
        for _ in range(rng.randrange(2 * tau + 1)):
            b = noisy(rng, b).replace("x", "a").replace("y", "b")
        if len(b) < len(a):
            a, b = b, a
        if len(a) <= tau or len(b) - len(a) > tau:
            continue
        n, met = len(a), False
        for i, (d, p, s) in enumerate(codes):
            low, high = n * p // (tau + 1), n * (p + 1) // (tau + 1)
            if d == len(b) - n and 0 <= low + s and high + s <= len(b) and a[low:high] == b[low + s : high + s]:
                met = met or shared(tau, a, b, p, i)
        assert met == (distance(a, b) <= tau), (a, b)


def test_many_lines_of_one_document(spark):
    """What is removed from a document is found in time linear in its lines."""
    text = "\n".join(f"{i % 20000:05d} a line that is there twice" for i in range(40000))
    started = time.time()
    row = L.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), min_chars=100).first()
    assert row.n_removed == 20000 and row.text == text[: len(text) // 2] and time.time() - started < 30


def test_whole_table_exact_and_near(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = sorted((r.doc_id, r.text) for r in df.collect())
    got = {r.doc_id: r.text for r in L.dedup_lines(df).collect()}
    assert [got[i] for i, _ in docs] == brute(docs)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, empty):
    rows = [(1, None, "a"), (2, "", None), (None, "one line here that is long enough", "b"), (3, "one line here that is long enough\n\n  \nx", "c"), (3, "one line here that is long enough\n\n  \nx", "c"), (4, "One line here that is long enough", "c")]
    df = spark.createDataFrame([] if empty else rows, "doc_id long, text string, n_lines string")
    out = sorted((str(r.doc_id), str(r.text), r.n_removed) for r in L.dedup_lines(df).collect())
    want = [("1", "None", 0), ("2", "", 0), ("3", "one line here that is long enough\n\n  \nx", 0), ("3", "one line here that is long enough\n\n  \nx", 0), ("4", "", 1), ("None", "", 1)]
    assert out == ([] if empty else want)


def test_tables_are_written_in_few_files(spark):
    """Each file and folder that a task makes on a local disk costs the fork of a chmod."""
    rng = random.Random(8)
    text = lambda: "\n".join("".join(rng.choice("abcdef") for _ in range(200)) for _ in range(800))
    folder = Path(shared_folder(spark).removeprefix("file:"))
    old, before = spark.conf.get(ADVISED), set(folder.iterdir())
    spark.conf.set(ADVISED, "64k")
    try:
        rows = L.lines_of(spark.createDataFrame([(i, text()) for i in range(40)], "doc_id long, text string"))
        out = L.cut_lineage(rows.repartition("line").sortWithinPartitions("line"))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        few = L.cut_lineage(rows.groupBy("line").count())
        assert spark.conf.get(ADVISED) == "64k"
    finally:
        spark.conf.set(ADVISED, old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    assert out.count() == few.count() == 32000 and len(few.inputFiles()) == 1
    new = [f for d in set(folder.iterdir()) - before for f in d.rglob("*")]
    assert new and not [f for f in new if f.name.endswith(".crc")]
