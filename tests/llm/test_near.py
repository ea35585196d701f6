"""Near-duplicate and span operators against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from prefmill.llm import minhash, spandedup

SF = "/root/testdata/sf0.01"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bag(text):
    w = split(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(texts):
    """Components of the links with a weighted Jaccard similarity of 0.8 or more."""
    bags = [bag(t) for t in texts]
    where = defaultdict(list)
    for i, b in enumerate(bags):
        for s in b:
            where[s].append(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, b in enumerate(bags):
        for j in {j for s in b for j in where[s] if j > i}:
            both = sum((b & bags[j]).values())
            if both / (sum(b.values()) + sum(bags[j].values()) - both) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_classes_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    want = dict(zip([r.doc_id for r in rows], [rows[i].doc_id for i in classes([r.text for r in rows])], strict=True))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == want
    assert len(set(want.values())) < len(want)


def test_hot_group_and_chains(spark):
    """Many near copies, and texts that share half of their words and a bucket but not 0.8."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randrange(3)):
            t[rng.randrange(120)] = word()
        texts.append(" ".join(t))
    texts += [" ".join(passage + [word() for _ in range(rng.choice([10, 14, 40, 60]))]) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert got == dict(enumerate(classes(texts)))


def test_signature_is_unbiased():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    row, weight = np.repeat([0, 1], 60), np.concatenate([a, b])
    s = minhash.signatures(row, np.concatenate([h, h]), weight, 2, m=6000)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - true) < 0.03


ODD = [(1, None, "x", "s"), (None, "", "y", None), (2, "   \n\t ", None, "s"), (3, "one two three", "z", "s"), (3, "one two three", "z", "s"), (None, "one two three", "z", "s"), (None, None, None, None)]


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, empty):
    df = spark.createDataFrame([] if empty else ODD, "doc_id long, text string, class_id string, source string")
    out = minhash.near_duplicates(df).collect()
    assert len(out) == (0 if empty else len(ODD))
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect()[:4] + df.collect()[6:] if not empty else []))


def runs(text):
    """Words of a text and the places (at, end) of its runs of sentences, word by word."""
    words, found, here, n = split(text), [], [], 0
    pieces = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text or "")
    for i, p in enumerate(pieces):
        here.append(i)
        if "\n" in p or i + 1 == len(pieces) or words[i].rstrip("\"')]}\u00bb\u201d\u2019")[-1:] in tuple(".!?\u2026\u3002\uff01\uff1f"):
            ends = {i}
            if len(here) > 40:
                for k in range(len(here) - 7):
                    ends.add(min(here[k : k + 8], key=lambda j: (hashlib.md5(words[j].encode()).hexdigest()[:16], -j)))
            at = here[0]
            for e in sorted(ends):
                found.append((at, e + 1))
                at = e + 1
            here = []
    out = []
    for k in range(len(found)):
        n = next((m for m in range(k + 2, len(found)) if found[m][1] - found[k][0] >= 12), None)
        if n is not None:
            out.append((found[k][0], found[n][1]))
    return words, out


def test_spans_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    seen, want = set(), {}
    for r in sorted(docs.collect()):
        words, rs = runs(r.text)
        gone = set()
        for a, b in rs:
            if (k := tuple(words[a:b])) in seen:
                gone |= set(range(a, b))
            seen.add(k)
        want[r.doc_id] = [x for i, x in enumerate(words) if i not in gone]
    got = {r.doc_id: r for r in spandedup.dedup_spans(docs).collect()}
    assert {k: split(v.text) for k, v in got.items()} == want
    assert all(len(split(r.text)) + got[r.doc_id].n_removed_words == len(split(r.text)) + len(split(r.text)) - len(want[r.doc_id]) for r in docs.collect())
    assert sum(v.n_removed for v in got.values()) > 100


@pytest.mark.parametrize("empty", [False, True])
def test_spans_odd_rows(spark, empty):
    df = spark.createDataFrame([] if empty else ODD, "doc_id long, text string, n_removed string, source string")
    out = spandedup.dedup_spans(df)
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, df.select("doc_id", "text").collect()))


def test_real_sentences_are_not_cut():
    """Up to 40 words, whatever the words; quotes and brackets may follow the stop."""
    from prefmill.llm.hashing import Words, text_bytes

    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(n))
    own = [words(40) + ".", words(9) + '!"', words(3) + "?')", words(17) + "\u2026\u201d", words(2) + "\u3002", words(30) + "\n", words(5) + " 3.5 (see)"]
    w = Words(*text_bytes(pa.array([" ".join(own), words(41)])))
    first, last = spandedup.sentences(w)
    n = [len(x.split()) for x in own]
    assert (last - first + 1)[: len(n)].tolist() == n and len(first) > len(n) + 1


def test_passage_inside_sentences(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(60)) + "."
    texts = [" ".join([*(word() for _ in range(40)), passage, *(word() for _ in range(40))]) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.n_removed_words for r in spandedup.dedup_spans(df).collect()}
    assert out[0] == 0
    assert all(30 <= out[i] <= 60 for i in range(1, 30))


def test_every_passage_of_50_words_holds_a_run(spark):
    """Without any stop, wherever it is pasted; and no sentence is longer than the window."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(300):
        passage = [word() for _ in range(50)]
        texts += [" ".join([*(word() for _ in range(rng.randrange(5, 40))), *passage, *(word() for _ in range(40))]) for _ in range(2)]
    out = {r.doc_id: r.n_removed_words for r in spandedup.dedup_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(out[i] == 0 for i in range(0, 600, 2)) and all(12 <= out[i] <= 50 for i in range(1, 600, 2))
