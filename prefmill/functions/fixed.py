"""They have to be exactly these for results to be right."""

GENERAL_STOPWORDS = """
a an the of in on at to for from with and or by is are was were be been being which what who whom whose this that these those most least likely
following except not does do did can could would should may might it as into than then also often usually because about between under over all none
each such their there here after before during within without using used use has have had having been being due secondary associated undergoing
""".split()

CASE_STOPWORDS = """
man woman male female boy girl child children patient patients year years old month months presents present presented comes come brought reports
report states history known past medical family visit clinic office department emergency hospital underwent seen follow follow-up evaluation exam
examination days weeks hours months today yesterday noted note shows showed show found findings returned initial stable monitoring close currently
""".split()

EXAM_STOPWORDS = "aiims aipg neet dnb pgi year newer hypothesis except incorrect correct true false choose best following regarding according".split()

KEEP_SHORT = """
hiv tb copd bph uti dna rna mrna rrna trna ecg eeg mri ct pet csf abg psa fsh lh tsh acth hcg pt aptt hbv hcv cmv ebv hsv ivf pcos osa gerd ibd ibs
""".split()

CONTENT_SUFFIXES = "itis osis emia uria pathy oma genic tomy scopy".split()

#: White space as Python's \s has it, spelled out so that Java and RE2 agree.
WS = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: In order of priority; the first that matches gives the letter.
ANSWER_PATTERNS = [
    rf"(?i)Final{WS}*Answer{WS}*:{WS}*\(([A-E])\)",
    rf"(?i)Final{WS}*Answer{WS}*:{WS}*([A-E])",
    rf"(?i)Answer{WS}*:{WS}*\(([A-E])\)",
    rf"(?i)Answer{WS}*:{WS}*([A-E])",
    rf"(?i)\bthe answer is{WS}*\(?([A-E])\)?",
]

LOW_VALUE_PREFIXES = [
    "given information",
    "understanding the question",
    "evaluating each option",
    "let's evaluate",
    "let us evaluate",
    "let's consider",
    "let us consider",
    "analysis:",
    "reasoning:",
    "conclusion:",
    "final reasoning:",
    "we need to determine",
    "the question asks",
    "this question asks",
]

#: Weights of the trace score and the limits of validity and pairs.
MIN_STEP_WEIGHT, MEAN_STEP_WEIGHT, PREFIX_WEIGHT, FINAL_WEIGHT = 0.05, 0.20, 0.05, 0.70
GOLD_BONUS, GOLD_PENALTY = 0.20, -0.50
MIN_STEPS, MAX_STEPS = 3, 8
CHOSEN_FINAL, REJECTED_FINAL, MIN_MARGIN, MARGIN_SHARE, MIN_FINAL_DIFF = 0.55, 0.45, 0.03, 0.25, 0.05
TOP_K, BOTTOM_K, MAX_PAIRS = 4, 4, 12
VALID_PER_MODEL, ATTEMPTS_PER_MODEL, VALID_IN_ALL = 4, 24, 8
RETRIEVED, DOCS, TITLE_CHARS, ABSTRACT_CHARS = 20, 6, 300, 1800

PAIR_PROMPT = (
    "You are a medical reasoning assistant.\n"
    "Use the provided evidence documents to solve the multiple-choice question step by step.\n\n"
    "Documents:\n{docs}\n\n"
    "Question:\n{question}\n\n"
    "Please answer in the format:\n"
    "Step 1: ...\n"
    "Step 2: ...\n"
    "Step 3: ...\n"
    "Final Answer: (X)"
)
