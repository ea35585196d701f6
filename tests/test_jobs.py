"""Jobs, resuming, seams, sinks, and the sampling budget against a loop."""

import json
import random

import pytest
from pyspark.sql import functions as F

from prefmill.operators import traces as S
from prefmill.plans import jobs
from prefmill.plans.seams import BatchScorer, HashScorer, HttpSource, TableGenerator, TableSource
from prefmill.sources import loaders
from prefmill.sources.tables import completed, read_jsonl_if_any, safe_name, upsert, write_jsonl
from prefmill.streaming.incremental import each_new_file


def loop(valid):
    """Attempts (model, attempt) that a sequential sampler makes; valid[m] are the outcomes of model m."""
    made, used = [], [0, 0]
    for m in (0, 1):
        n = 0
        while n < 4 and used[m] < len(valid[m]):
            n += valid[m][used[m]]
            used[m] += 1
            made.append((m, used[m]))
    n = sum(valid[m][a - 1] for m, a in made)
    turn = 0
    while n < 8 and (used[0] < len(valid[0]) or used[1] < len(valid[1])):
        m = turn if used[turn] < len(valid[turn]) else 1 - turn
        n += valid[m][used[m]]
        used[m] += 1
        made.append((m, used[m]))
        turn = 1 - turn if used[1 - turn] < len(valid[1 - turn]) else turn
    return made


def test_sampling_budget(spark):
    rng = random.Random(0)
    cases, rows = [], []
    for q in range(300):
        share = rng.choice([0, 0.1, 0.4, 0.9, 1])
        valid = [[rng.random() < (share if m else rng.choice([0, share])) for _ in range(24)] for m in (0, 1)]
        cases.append(valid)
        rows += [(q, m, a + 1, valid[m][a]) for m in (0, 1) for a in range(24)]
    df = spark.createDataFrame(rows, "qid long, model_rank long, attempt int, valid boolean")
    got = {}
    for r in S.sample_budget(df).collect():
        got.setdefault(r.qid, []).append((r.sample_index, (r.model_rank, r.attempt)))
    firsts = lambda v: [x for x in v]
    for q, valid in enumerate(cases):
        have = [x for _, x in sorted(got[q])]
        want = loop(valid)
        assert set(have) == set(want) and len(have) == len(want), (q, firsts(have), want)


def test_pair_job_resumes(spark, tmp_path):
    questions = spark.createDataFrame([(f"q{i}", "medqa", f"Question {i}", ["Document 1: PMID 1"] if i else [], "A", "x") for i in range(6)], "qid string, dataset string, question string, docs array<string>, gold_answer string, gold_answer_text string")
    step = "This is a step that is long enough to be kept, number"
    rows = [(f"q{q}", f"m{m}", m, a, f"Step 1: {step} {q} {a}.\nStep 2: {step} {q} {m}.\nStep 3: {step} {a} {m} again.\nFinal Answer: ({'ABC'[(q + a + m) % 3]})") for q in range(6) for m in (0, 1) for a in range(1, 9)]
    attempts = TableGenerator(spark.createDataFrame(rows, "qid string, model string, model_rank int, attempt int, raw_generation string"))
    out = str(tmp_path)
    jobs.pairs(spark, questions, attempts, HashScorer(), out)
    n = spark.read.json(f"{out}/pairs").count()
    assert n > 0 and completed(spark, f"{out}/progress").count() == 5 and spark.read.json(f"{out}/skipped").count() == 1
    jobs.pairs(spark, questions, attempts, HashScorer(), out)
    assert spark.read.json(f"{out}/pairs").count() == n


class Crash(Exception):
    pass


def test_pair_job_asks_once_and_survives(spark, tmp_path, monkeypatch):
    """A model that never says the same twice is asked once a prompt, and a crash before any sink leaves nothing out and nothing twice."""
    n = 5
    questions = spark.createDataFrame([(f"q{i}", "medqa", f"Question {i}", ["Document 1: PMID 1"], "A", "x") for i in range(n)], "qid string, dataset string, question string, docs array<string>, gold_answer string, gold_answer_text string")
    step = "This is a step that is long enough to be kept, number"
    rows = [(f"q{q}", f"m{m}", m, a, f"Step 1: {step} {q} {a}.\nStep 2: {step} {q} {m}.\nStep 3: {step} {a} {m} again.\nFinal Answer: ({'AB'[(q + a + m) % 2]})") for q in range(n) for m in (0, 1) for a in range(1, 25)]
    attempts = TableGenerator(spark.createDataFrame(rows, "qid string, model string, model_rank int, attempt int, raw_generation string"))
    asked = spark.sparkContext.accumulator(0)

    def model(prompts):
        asked.add(len(prompts))
        return [random.random() for _ in prompts]

    real = jobs.write_jsonl
    for i, name in enumerate(("pairs", "dedup_pairs", "results", "skipped", "progress")):
        out = f"{tmp_path}/{name}"

        def broken(df, path, *args, at=name, **kwargs):
            if path.endswith(f"/{at}"):
                raise Crash
            real(df, path, *args, **kwargs)

        asked.value = 0
        monkeypatch.setattr(jobs, "write_jsonl", broken)
        with pytest.raises(Crash):
            jobs.pairs(spark, questions, attempts, BatchScorer(model), out, ("m0", "m1"))
        monkeypatch.setattr(jobs, "write_jsonl", real)
        report = jobs.pairs(spark, questions, attempts, BatchScorer(model), out, ("m0", "m1"))
        traces, made = spark.read.parquet(f"{out}/traces"), spark.read.json(f"{out}/pairs")
        needed = traces.select(F.sum(F.size("steps") + F.col("final_answer").isNotNull().cast("int")).alias("n"), F.count_if("is_valid").alias("v")).first()
        assert asked.value == needed.n and needed.v == n * 8
        assert made.count() == made.select("qid", "chosen_trace_id", "rejected_trace_id").distinct().count() > 0
        assert completed(spark, f"{out}/progress").count() == spark.read.json(f"{out}/results").count() == n == report["processed_questions"]
        if i == 0:
            again = jobs.pairs(spark, questions, attempts, BatchScorer(model), out, ("m0", "m1"))
            assert again["processed_questions"] == 0 and again["skipped_existing_questions"] == n and spark.read.json(f"{out}/pairs").count() == made.count()
            p = spark.read.json(f"{out}/progress").first().asDict()
            assert p["num_valid_traces"] == 8 and p["attempts_m0"] + p["attempts_m1"] == p["all_attempts"] >= 8 and p["raw_rows_appended"] == p["raw_pair_count"]
            assert json.loads((tmp_path / name / "report.json").read_text())["config"]["docs"] == 6


def test_search_service(spark, tmp_path):
    """Over HTTP: order of hits, a query that fails, a second candidate, caches that spare questions and documents."""
    folder = tmp_path / "calls"
    folder.mkdir()

    def get(path, p, folder=str(folder)):
        import json
        import uuid

        with open(f"{folder}/{path}-{uuid.uuid4().hex}", "w") as f:
            f.write(p.get("term") or p["id"])
        if path == "search":
            if p["term"] == "broken":
                raise OSError("no answer")
            return json.dumps({"esearchresult": {"idlist": {"two": ["9", "3"], "three": ["3", "404"]}.get(p["term"], [])}})
        return "<S>" + "".join(f"<PubmedArticle><MedlineCitation><PMID>{x}</PMID><Article><ArticleTitle>T{x}</ArticleTitle></Article></MedlineCitation></PubmedArticle>" for x in p["id"].split(",") if x != "404") + "</S>"

    source = HttpSource(get, {"email": "a@b"}, pause=0)
    rows = [("a", ["nothing", " two ", "two"]), ("b", ["three"]), ("c", ["broken", "two"]), ("d", []), ("e", ["two", "broken"])]
    records = spark.createDataFrame([(q, "x", "train", "Q", c) for q, c in rows], "qid string, dataset string, split string, question string, query_candidates array<string>")
    told = lambda: {r.qid: (r.pmids, [x.pmid for x in r.retrieved_docs], r.error) for r in jobs.retrieve_with_caches(records, source, f"{tmp_path}/out").collect()}
    want = {"a": (["9", "3"], ["9", "3"], None), "b": (["3", "404"], ["3"], None), "c": ([], [], "OSError: no answer"), "d": ([], [], None), "e": (["9", "3"], ["9", "3"], None)}
    assert told() == want
    calls = lambda k: sorted(f.read_text() for f in folder.glob(f"{k}-*"))
    assert len(calls("fetch")) == 1 and sorted(calls("fetch")[0].split(",")) == ["3", "404", "9"]
    for f in folder.iterdir():
        f.unlink()
    assert told() == want
    assert set(calls("search")) == {"broken", "two"} and calls("fetch") == ["404"]
    assert sorted(r.qid for r in spark.read.parquet(f"{tmp_path}/out/query_cache").collect()) == ["a", "b", "e"]


def test_missing_files(spark, tmp_path):
    with pytest.warns(UserWarning, match="missing input"):
        assert loaders.load_pubmedqa(spark, str(tmp_path)) is None
    assert loaders.existing(spark, []) == []
    with pytest.raises(ValueError, match="no qid"):
        write_jsonl(spark.createDataFrame([(None, "d", ["x"])], "qid string, dataset string, docs array<string>"), f"{tmp_path}/q")
        loaders.load_questions(spark, [f"{tmp_path}/q"], "qid string, dataset string, docs array<string>")


def test_references(spark):
    given = ["a &amp; b", "&lt;&#60;&#x3C;&#X3c;", "&nope; &amp", "&#0;&#xD800;&#1114112;", "&eacute;&NotEqualTilde;", "", None, "none"]
    df = spark.createDataFrame([(x,) for x in given], "x string")
    assert [r[0] for r in df.select(loaders.unescape(F.col("x"))).collect()] == ["a & b", "<<<<", "&nope; &amp", "&#0;&#xD800;&#1114112;", "é≂̸", "", None, "none"]


def test_scorers_agree_across_partitions(spark):
    p = spark.createDataFrame([(i, f"prompt {i}") for i in range(50)], "i long, prompt string")
    a, b = HashScorer().score(p).orderBy("i").collect(), HashScorer().score(p.repartition(7)).orderBy("i").collect()
    assert a == b
    got = BatchScorer(lambda xs: [len(x) / 100 for x in xs]).score(p).orderBy("i").first()
    assert (got.p_plus, got.p_minus) == (0.08, 0.92)


def test_retrieval_keeps_rows(spark):
    docs = spark.createDataFrame([("1", "alpha", "beta gamma", "j", None), ("2", "delta", "", "j", "1999")], "pmid string, title string, abstract string, journal string, year string")
    records = spark.createDataFrame([("a", "x", ["nothing here", "gamma"]), ("b", "x", []), ("c", "x", ["delta alpha"])], "qid string, question string, query_candidates array<string>")
    got = {r.qid: (r.pmids, [d.pmid for d in r.retrieved_docs]) for r in jobs.retrieve(records, TableSource(docs)).collect()}
    assert got == {"a": (["1"], ["1"]), "b": ([], []), "c": (["1", "2"], ["1", "2"])}


def test_sinks_and_caches(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "é")], "qid string, x string")
    write_jsonl(df, f"{tmp_path}/t")
    assert '"x":null' in "".join(p.read_text() for p in (tmp_path / "t").glob("part*"))
    assert read_jsonl_if_any(spark, f"{tmp_path}/t", "qid string, x string").count() == 2
    assert read_jsonl_if_any(spark, f"{tmp_path}/none", "qid string").count() == 0
    assert sorted(tuple(r) for r in upsert(df, spark.createDataFrame([("b", "n"), ("c", "m")], df.schema), "qid").collect()) == [("a", None), ("b", "n"), ("c", "m")]
    assert df.select(safe_name(F.lit("a/b c"))).first()[0] == "a_b_c"


def test_new_files_once(spark, tmp_path):
    write_jsonl(spark.createDataFrame([("a",)], "qid string"), f"{tmp_path}/in")
    seen = []
    for _ in range(2):
        each_new_file(spark, f"{tmp_path}/in", "qid string", f"{tmp_path}/ck", lambda df, i: seen.append(df.count())).awaitTermination()
    assert seen == [1]
    write_jsonl(spark.createDataFrame([("b",), ("c",)], "qid string"), f"{tmp_path}/in", "append")
    each_new_file(spark, f"{tmp_path}/in", "qid string", f"{tmp_path}/ck", lambda df, i: seen.append(df.count())).awaitTermination()
    assert seen == [1, 2]
