"""Chat prompts of the generator and the two verifiers, as (system, user) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The models were made for these words.
STEP_SYSTEM = (
    "You are a medical step verifier.\n"
    "You will be given documents, a medical multiple-choice question, and ONE current reasoning step.\n"
    "Judge whether the CURRENT step should be accepted as reasonably correct.\n"
    "Accept '+' when the step is medically reasonable, consistent with the documents, and a plausible intermediate inference or summary.\n"
    "Minor paraphrases, short intermediate conclusions, and logically necessary bridging statements are allowed.\n"
    "Reject '-' only if the step clearly contradicts the documents, contains a wrong medical claim, or is seriously illogical.\n"
    "Do not be overly strict just because the wording is not explicitly copied from the documents.\n"
    "Output exactly one character: '+' or '-'."
)
ANSWER_SYSTEM = (
    "You are a medical answer verifier.\n"
    "You will be given documents, a multiple-choice medical question, a reasoning trace, and the chosen final answer.\n"
    "Judge whether the chosen final answer is the BEST supported option.\n"
    "Accept '+' only if the chosen option is well supported and more compatible with the documents than the main alternatives.\n"
    "Reject '-' if the chosen option is contradicted by the documents, or if another option is clearly better supported.\n"
    "Be stricter here than for individual reasoning steps.\n"
    "Output exactly one character: '+' or '-'."
)
POLICY_WITH_DOCS = (
    "You are a medical reasoning assistant.\n"
    "Use the provided evidence documents to solve the multiple-choice clinical question step by step.\n"
    "If the documents conflict with your prior intuition, follow the documents.\n"
    "Your final answer must be the option best supported by the provided evidence.\n"
    "Use the EXACT format below:\n"
    "Step 1: ...\nStep 2: ...\nStep 3: ...\nFinal Answer: (X)\n"
    "Rules:\n"
    "- Use 3 to 6 reasoning steps.\n"
    "- Each step must be a medically meaningful claim or inference.\n"
    "- Prefer evidence-grounded reasoning.\n"
    "- Do not write markdown bullets or extra headings.\n"
    "- Do not leave out the final answer line.\n"
    "- X must be one of A, B, C, D, E."
)
POLICY_WITHOUT_DOCS = (
    "You are a medical reasoning assistant.\n"
    "Solve the multiple-choice clinical question step by step.\n"
    "Use the EXACT format below:\n"
    "Step 1: ...\nStep 2: ...\nStep 3: ...\nFinal Answer: (X)\n"
    "Rules:\n"
    "- Use 3 to 6 reasoning steps.\n"
    "- Each step must be a medically meaningful claim or inference.\n"
    "- Do not leave out the final answer line.\n"
    "- X must be one of A, B, C, D, E."
)
POLICY_STRICT = (
    "You are a medical reasoning assistant.\n"
    "Use the provided evidence documents to solve the multiple-choice clinical question step by step.\n"
    "If the documents conflict with your prior intuition, follow the documents.\n"
    "Your final answer must be the option best supported by the provided evidence.\n\n"
    "You MUST follow this EXACT output format with NO deviation:\n\n"
    "Step 1: <one medically meaningful reasoning sentence>\n"
    "Step 2: <one medically meaningful reasoning sentence>\n"
    "Step 3: <one medically meaningful reasoning sentence>\n"
    "Final Answer: (X)\n\n"
    "STRICT RULES:\n"
    "- You MUST use exactly 3 to 6 steps. No more, no less.\n"
    "- You MUST end with 'Final Answer: (X)' where X is A, B, C, D, or E.\n"
    "- NEVER omit the Final Answer line. It is MANDATORY.\n"
    "- Each step must be a single concrete medical claim or inference, not a vague summary.\n"
    "- Do NOT write bullet points, markdown, sub-steps, or extra headings.\n"
    "- Do NOT write anything after the Final Answer line."
)
POLICY_END = "Please follow the required format exactly."
POLICY_STRICT_END = "Respond using ONLY the Step 1/2/3/.../Final Answer format. Do NOT forget the Final Answer line."
VERIFIER_END = "Output one symbol (+ or -)."


def _chat(system: str, *parts: Column) -> Column:
    return F.struct(F.lit(system).alias("system"), F.concat_ws("\n\n", *parts).alias("user"))


def _about(docs: Column, question: Column) -> tuple[Column, Column]:
    return F.concat(F.lit("Documents:\n"), strip(F.array_join(docs, "\n\n"))), F.concat(F.lit("Question:\n"), strip(question))


def step_prompt(docs: Column, question: Column, step: Column, number: Column) -> Column:
    current = F.concat(F.lit("CURRENT STEP #"), number.cast("string"), F.lit(":\n```text\n"), strip(step), F.lit("\n```"))
    return _chat(STEP_SYSTEM, *_about(docs, question), current, F.lit(VERIFIER_END))


def answer_prompt(docs: Column, question: Column, steps: Column, answer: Column) -> Column:
    trace = F.concat(F.lit("Reasoning Trace:\n"), strip(F.array_join(F.transform(steps, lambda s: F.concat(F.lit("- "), s)), "\n")))
    chosen = F.concat(F.lit("Chosen Final Answer: ("), answer, F.lit(")"))
    return _chat(ANSWER_SYSTEM, *_about(docs, question), trace, chosen, F.lit(VERIFIER_END))


def policy_prompt(docs: Column, question: Column, with_docs: bool = True, strict: bool = False) -> Column:
    about = _about(docs, question)
    if strict:
        return _chat(POLICY_STRICT, *about, F.lit(POLICY_STRICT_END))
    return _chat(POLICY_WITH_DOCS, *about, F.lit(POLICY_END)) if with_docs else _chat(POLICY_WITHOUT_DOCS, about[1], F.lit(POLICY_END))


def flat(chat: Column) -> Column:
    """A chat as one text, for scorers without a template of their own."""
    return F.concat_ws("\n\n", chat["system"], chat["user"])
