"""Hand-derived results of the column functions."""

import re

import pytest
from pyspark.sql import functions as F

from prefmill.functions import fixed as X
from prefmill.functions import prompts as M
from prefmill.functions import text as T
from prefmill.functions import tokens as K
from prefmill.operators import pairs as P
from prefmill.operators import traces as S
from prefmill.operators import unify as U
from prefmill.sources.tables import articles


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: T.normalize(F.lit(None).cast("string")), ""),
        (lambda: T.normalize(F.lit(" a\t\n b ")), "a b"),
        (lambda: T.normalize(F.lit("a\xa0b")), "a b"),
        (lambda: T.shorten(F.lit("abcdefgh"), 8), "abcdefgh"),
        (lambda: T.shorten(F.lit("abcd efgh"), 8), "abcd..."),
        (lambda: T.tokenize(F.lit("Anti-HIV, 3-year-old β-cell")), ["anti-hiv", "3-year-old", "-cell"]),
        (lambda: K.clean_tokens(F.array(*map(F.lit, "the hiv ct 45 3-year-old ab fever".split()))), ["hiv", "ct", "fever"]),
        (lambda: F.transform(F.array(*map(F.lit, ["coma", "rash", "fever", "tb"])), K.content_token), [True, False, True, True]),
        (lambda: T.format_question(F.lit("Q"), F.create_map(F.lit("B"), F.lit("y"), F.lit("A"), F.lit("x"))), "Q\n\n(A) x\n(B) y"),
        (lambda: T.final_answer(F.lit("Answer: (B) then Final Answer: (C)")), "C"),
        (lambda: T.final_answer(F.lit("Final Answer: Diabetes")), "D"),
        (lambda: T.final_answer(F.lit("the answer is clear")), "C"),
        (lambda: T.final_answer(F.lit("Final Answer: **(C)**")), None),
        (lambda: T.low_value(F.lit("x" * 24)), True),
        (lambda: T.low_value(F.lit("x" * 25)), False),
        (lambda: T.low_value(F.lit("Analysis: a long text that goes on and on")), True),
        (lambda: T.clean_step(F.lit(" **Step 2: - do it** ")), "do it"),
        (lambda: T.year_of(F.lit(None).cast("string"), F.lit("Spring 1998-99")), "1998"),
        (lambda: T.year_of(F.lit(" 2001 "), F.lit(None).cast("string")), "2001"),
        (lambda: S.validity(F.lit(None).cast("string"), F.lit(2)), "missing_final_answer"),
        (lambda: S.validity(F.lit("A"), F.lit(2)), "too_few_scored_steps"),
        (lambda: S.validity(F.lit("A"), F.lit(8)), "ok"),
        (lambda: S.validity(F.lit("A"), F.lit(9)), "too_many_scored_steps"),
        (lambda: S.step_summary(F.array(*map(F.lit, [0.9, 0.6, 0.4, 0.8])))["prefix_high_ratio"], 0.5),
        (lambda: S.step_summary(F.array().cast("array<double>"))["mean_step_score"], 0.0),
        (lambda: S.score_final(F.lit(None).cast("string"), F.lit(0.7))[1], -1.0),
        (lambda: K.dedupe(F.array(*map(F.lit, ["b", "", "a", "b"]))), ["b", "a"]),
    ],
)
def test_function(spark, column, want):
    assert one(spark, column()) == want


def test_documents_keep_their_numbers(spark):
    docs = spark.createDataFrame([([("", "", "", "", None), ("7", "", "", "", None)],)], "docs array<struct<pmid:string,title:string,abstract:string,journal:string,year:string>>")
    assert docs.select(T.render_documents(F.col("docs"))).first()[0] == ["Document 2: PMID 7"]


def test_trace_score(spark):
    row = spark.createDataFrame([(0.4, 0.6, 0.5, 0.8, "A", "A")], "min_step_score double, mean_step_score double, prefix_high_ratio double, final_answer_score double, final_answer string, gold_answer string")
    assert S.trace_scores(row).first().trace_score == pytest.approx(0.925)


def test_plus_minus(spark):
    p, m, d = S.plus_minus(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(2.0)))
    assert one(spark, F.struct(p, m, d)) == (0.5, 0.5, 0.0)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (
            "Step 1: The first step says something useful.\nStep 2 - the second step says something as well; STEP 3: the first step.\nFinal Answer: (B)\nmore text after the final answer line",
            ["The first step says something useful.", "the second step says something as well;", "the first step.\n\nmore text after the final answer line"],
        ),
        (
            "Intro line that is long enough to count.\n1. The first numbered claim is right here.\n2) The second numbered claim is right here.\n- The third, a bullet, is right here too.",
            ["The first numbered claim is right here.", "The second numbered claim is right here.", "The third, a bullet, is right here too."],
        ),
        ("1. Only one numbered line, which goes away here.\nThe plain text stays. It has two sentences of length.", ["It has two sentences of length."]),
        ("* One bullet alone makes the whole text the candidate.", ["One bullet alone makes the whole text the candidate."]),
        ("Same sentence twice, in other case here. SAME SENTENCE TWICE, IN OTHER CASE HERE.", ["Same sentence twice, in other case here."]),
        ("A sentence of two hundred and twenty characters or more " + "goes on and on " * 11 + "but it has a second part that is long enough because it is", ["A sentence of two hundred and twenty characters or more" + " goes on and on" * 11, "it has a second part that is long enough"]),
        ("\r\nA\r\rB\t\tC", []), ("", []), (None, []), ("**Bold heading:**", []), ("(A)", []),
    ],
)
def test_reasoning_steps(spark, text, want):
    got = spark.createDataFrame([(text,)], "text string").select(T.reasoning_steps(F.col("text"))).first()[0]
    assert got == want


def test_steps_say_something_once(spark):
    """Of any text: no step twice in any case, none short, none with its marker."""
    steps = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select(T.reasoning_steps(F.col("text")).alias("s")).collect()
    assert sum(len(r.s) for r in steps) > 500
    for r in steps:
        assert len({x.lower() for x in r.s}) == len(r.s) and all(len(x) >= 25 and x == x.strip() and not re.match(r"(?i)step\s*\d+\s*[:-]", x) for x in r.s)


@pytest.mark.parametrize(
    ("schema", "rows", "want"),
    [
        ("options array<struct<key:string,value:string>>", [([("A", "x"), ("B", "y")], "B", None), ([("A", "x"), ("B", "y")], "1", None), ([("A", "x"), ("B", "y")], "9", "X")], ["B", "B", "A"]),
        ("options array<string>", [(["x", "", "z"], "C", None), (["x", "", "z"], None, "nothing")], ["C", ""]),
        ("options map<string,string>", [({"0": "x", "1": "y"}, "0", None), ({"A": "x", "1": "y"}, "A", None)], ["A"]),
        ("options struct<text:array<string>,label:array<string>>", [((["x", "y"], ["A", "B"]), None, "y")], ["B"]),
        ("options struct<A:string,B:string,C:string>", [(("x", "y", None), "C", "b")], ["B"]),
    ],
)
def test_option_shapes(spark, schema, rows, want):
    df = spark.createDataFrame([(i, "q", *r) for i, r in enumerate(rows)], f"i long, question string, {schema}, answer_idx string, answer string")
    assert [r.answer for r in U.unify_keyed(df, "train", F.col("i")).orderBy("qid").collect()] == want


def test_gaps_and_labels(spark):
    df = spark.createDataFrame([(0, "q", "x", "y", "1"), (1, None, "x", "y", "1"), (2, "q", "x", "y", "0"), (3, "q", "x", "y", "B"), (4, "q", "x", "", "1")], "i long, question string, opa string, opb string, cop string")
    got = [(r.qid, r.answer) for r in U.unify_columns(df, "dev", F.col("i")).orderBy("qid").collect()]
    assert got == [("medmcqa_dev_00000000", "A"), ("medmcqa_dev_00000002", ""), ("medmcqa_dev_00000003", "B")]


def test_xml(spark):
    xml = """<S><PubmedArticle><MedlineCitation><PMID>5</PMID><Article><Journal><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue><Title>J &amp; K</Title></Journal>
      <ArticleTitle>On <i>E. coli</i>  growth</ArticleTitle><Abstract><AbstractText Label="AIM">To see</AbstractText><AbstractText/><AbstractText>Seen <b>it</b></AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>
      <PubmedArticle><MedlineCitation><PMID>6</PMID></MedlineCitation></PubmedArticle></S>"""
    got = [tuple(r) for r in articles(spark.createDataFrame([(xml,)], "xml string")).collect()]
    assert got == [("5", "On E. coli growth", "AIM: To see\nSeen it", "J & K", "2001"), ("6", "", "", "", None)]


def test_pairs_and_dedup(spark):
    rows = [("q", f"t{i}", i, "A" if i < 4 else "B", "A", 4, 0.9 - 0.01 * i if i < 4 else 0.1 + 0.01 * i, 0.9 - 0.01 * i if i < 4 else 0.2, f"text {i}") for i in range(8)]
    t = spark.createDataFrame(rows, "qid string, trace_id string, sample_index int, final_answer string, gold_answer string, num_scored_steps int, trace_score double, final_answer_score double, raw_generation string")
    p = P.build_pairs(t).orderBy("pair_index").collect()
    assert len(p) == 12 and [r.chosen_trace_id for r in p] == ["t0"] * 4 + ["t1"] * 4 + ["t2"] * 4
    assert P.build_pairs(t.withColumn("gold_answer", F.lit(""))).count() == 0
    d = spark.createDataFrame([("q", 1, "a", "b", 0.1), ("q", 2, "A ", "b", 0.3), ("q", 3, "a", "b", 0.3), ("q", 4, "c", "b", 0.2)], "qid string, pair_index int, chosen_text string, rejected_text string, score_margin double")
    assert [(r.chosen_text, r.pair_index) for r in P.dedup_pairs(d).orderBy("pair_index").collect()] == [("A ", 1), ("c", 2)]


def test_vote(spark):
    t = spark.createDataFrame([("q", 0, "A", 0.9), ("q", 1, "B", 0.5), ("q", 2, "B", 0.5)], "qid string, sample_index int, final_answer string, trace_score double").withColumn("final_answer_score", F.lit(0.5))
    assert P.vote(t).filter("rank = 1").first().answer == "B"


def test_prompts(spark):
    docs, q = F.array(F.lit("d1"), F.lit("d2")), F.lit(" q ")
    assert one(spark, M.step_prompt(docs, q, F.lit(" s "), F.lit(2))["user"]) == "Documents:\nd1\n\nd2\n\nQuestion:\nq\n\nCURRENT STEP #2:\n```text\ns\n```\n\nOutput one symbol (+ or -)."
    assert one(spark, M.answer_prompt(docs, q, F.array(F.lit("a"), F.lit("b")), F.lit("C"))["user"]).endswith("Reasoning Trace:\n- a\n- b\n\nChosen Final Answer: (C)\n\nOutput one symbol (+ or -).")
    assert one(spark, M.policy_prompt(docs, q, with_docs=False)["user"]) == "Question:\nq\n\nPlease follow the required format exactly."
    assert one(spark, M.policy_prompt(docs, q, strict=True)["system"]) == M.POLICY_STRICT
