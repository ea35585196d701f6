"""Quality rules with risk-controlled thresholds.

Fixed base rules reject short and repetitive texts. Beside them, each statistic
gets a cutoff for each stratum (language): on labelled documents a cutoff may
be used only if an exact binomial test shows that it rejects at most ``alpha``
/ number of statistics of the good documents of the stratum. The cutoffs of one stratum and statistic are
tested in a fixed order, from the loosest on, up to the first that fails, which needs no correction among
them (a tighter cutoff rejects more, so its test is the weaker one); the sequences of all strata and statistics
share ``delta`` (Bonferroni). So with probability 1 - delta no stratum loses more than ``alpha`` of its good documents. Of
the cutoffs that pass, the one that parts bad from good documents best is
taken, and none where none helps.

Defined cases: a null or empty text has no words and fails the base rules; a null
language is a stratum of its own; strata without labels have no cutoff; a
document labelled more than once counts once, as good if any label says so; null labels
count for nothing; of the rows that share a labelled doc_id the least counts (by language, then by its counts). Equal rows get equal
results. Other columns pass through, whatever their names, and those named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, let, shielded, table, text_key, words

ALPHA, DELTA = 0.02, 0.05
MIN_WORDS, MAX_REPEAT = 50, 50
#: A good document's rejection weighs as much as this many bad ones' acceptance.
PRICE = 10.0
#: Statistics as numerator, denominator and grid step; a document is rejected above the cutoff.
STATS = {
    "long_words": ("word_chars", "n_words", 0.25),
    "symbols": ("n_symbols", "n_words", 0.01),
    "dup_lines": ("n_dup_lines", "n_lines", 0.025),
    "repeats": ("n_repeat_words", "n_words", 0.025),
}
GRID = 40
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeat_words(w: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more in the text, windows told apart by 64-bit hashes."""

    def covered(g: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
            twice = F.filter(s, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        at = let(ordered, places)
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))

    def grams(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    found = let(let(hashes, grams), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(found)


def measured(docs: DataFrame) -> DataFrame:
    """Adds the counts and base_failed. All in one projection of each row; nothing is shuffled."""
    docs = docs.drop(*COUNTS, "base_failed", "_m")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)

    def stats(w: Column, ls: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        )

    docs = docs.withColumn("_m", let(words(F.col("text")), lambda w: let(lines, lambda ls: stats(w, ls))))
    docs = docs.withColumns({c: F.col("_m")[c] for c in COUNTS}).drop("_m")
    return docs.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly from the top term down, in logarithms where terms are small."""
    ln = lambda x: F.log(x.cast("double"))
    top = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, j: a + ln(n - j + 1) - ln(j))).otherwise(0.0)
    top = top + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def below(a: Column, i: Column) -> Column:
        j = k - i
        term = a["term"] * (j + 1) / (n - j) * odds
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    sums = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, below)["sum"]).otherwise(1.0)
    return F.when(k > n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top + F.log(sums))))


def cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(lang, counts) with labels by doc_id -> for each lang a map from statistic to cutoff. A row for each language."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_good"))
    held = stats.filter(~F.col("base_failed")).join(known, "doc_id")
    held = held.groupBy("doc_id").agg(F.min(F.struct(F.col("lang").isNull().alias("none"), "lang", *COUNTS)).alias("r"), F.first("_good").alias("_good")).select("doc_id", "r.*", "_good")
    value = lambda a, b, step: F.least(F.lit(GRID), F.ceil(F.col(a) / F.greatest(F.col(b), F.lit(1)) / step - 1e-9)).cast("int")
    cells = held.select("lang", "_good", F.explode(F.create_map(*[x for s, v in STATS.items() for x in (F.lit(s), value(*v))])).alias("stat", "cell"))
    cells = cells.groupBy("lang", "stat", "cell").agg(F.sum(F.when(F.col("_good") > 0, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("_good") > 0, 0).otherwise(1)).alias("bad"))
    # A cutoff at step c rejects the cells above c.
    whole = W.partitionBy("lang", "stat")
    above = whole.orderBy(F.col("cell").desc()).rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumns({"k": F.coalesce(F.sum("good").over(above), F.lit(0)), "hit": F.coalesce(F.sum("bad").over(above), F.lit(0)), "n": F.sum("good").over(whole), "n_bad": F.sum("bad").over(whole)})
    cells = cut_lineage(cells.withColumn("p", binomial_cdf(F.col("k"), F.col("n"), alpha / len(STATS))))
    tests = cells.select("lang").distinct().count() * len(STATS)
    gain = F.col("hit") / F.greatest(F.col("n_bad"), F.lit(1)) - PRICE * F.col("k") / F.greatest(F.col("n"), F.lit(1))
    best = cells.filter((F.col("p") <= delta / max(1, tests)) & (F.col("hit") > 0)).withColumn("gain", gain).filter("gain > 0")
    best = best.groupBy("lang", "stat").agg(F.max(F.struct(F.round("gain", 9).alias("g"), "cell"))["cell"].alias("cell"))
    return best.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("stat", "cell"))).alias("_cut")).withColumnRenamed("lang", "_lang")


def judged(stats: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds kept and failed_rules, the names of the statistics above their cutoff."""
    n = cuts.count()
    out = stats.drop("kept", "failed_rules").join(F.broadcast(cuts) if n <= 10_000 else cuts, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    over = [F.when(F.ceil(F.col(a) / F.greatest(F.col(b), F.lit(1)) / step - 1e-9) > F.try_element_at("_cut", F.lit(s)), F.lit(s)) for s, (a, b, step) in STATS.items()]
    out = out.withColumn("failed_rules", F.concat_ws(",", *over))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "")).drop("_lang", "_cut")


@shielded
def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns. The cutoffs are fitted on the labelled documents only.

    Texts are measured once, into a table of counts; what is rejected leaves by its key, in an anti-join that is planned alike at every size.
    """
    counts = docs.select("doc_id", "lang", "text").withColumn("_key", text_key(F.col("text")))
    stats = cut_lineage(measured(counts).drop("text"))
    gone = judged(stats, cut_lineage(cutoffs(stats, labels))).filter("NOT kept")
    gone = cut_lineage(gone.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_in"), F.col("_key").alias("_k")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("lang").eqNullSafe(F.col("_in")) & (text_key(F.col("text")) == F.col("_k"))
    return docs.join(gone.hint("merge"), same, "left_anti")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = cut_lineage(measured(docs.select("doc_id", "lang", "text")).drop("text"))
    return judged(stats, cut_lineage(cutoffs(stats, labels))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def _sql() -> str:
    """The counts by unnesting lines and words; the binomial sums from lgamma."""
    cells = " UNION ALL ".join(
        f"SELECT r, doc_id, lang, base_failed, '{s}' AS stat, CAST(ceil(CAST({a} AS DOUBLE) / greatest({b}, 1) / {step!r}::DOUBLE - 1e-9::DOUBLE) AS BIGINT) AS v FROM m" for s, (a, b, step) in STATS.items()
    )
    cut = f"{DELTA!r}::DOUBLE / (nl * {len(STATS)})"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, hash(w[i], w[i + 1], w[i + 2]) AS h, w[i:i + 2] AS x FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 3)),
g2 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h, x) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g2) GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m0 AS (SELECT d.r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(ln.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.r = d.r LEFT JOIN ln ON ln.r = d.r),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m0),
v AS ({cells}),
k AS (SELECT doc_id, max(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT r FROM m JOIN k USING (doc_id) WHERE NOT base_failed QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lang NULLS LAST, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) = 1),
c AS (SELECT lang, stat, least(v, {GRID}) AS cell, sum(CASE WHEN good > 0 THEN 1 ELSE 0 END) AS good, sum(CASE WHEN good > 0 THEN 0 ELSE 1 END) AS bad FROM v JOIN h USING (r) JOIN k USING (doc_id) GROUP BY ALL),
n AS (SELECT lang, stat, cell, CAST(coalesce(sum(good) OVER a, 0) AS BIGINT) AS k, CAST(coalesce(sum(bad) OVER a, 0) AS BIGINT) AS hit, CAST(sum(good) OVER p AS BIGINT) AS n, CAST(sum(bad) OVER p AS BIGINT) AS n_bad,
  (SELECT count(*) FROM (SELECT DISTINCT lang FROM c)) AS nl FROM c
  WINDOW p AS (PARTITION BY lang, stat), a AS (PARTITION BY lang, stat ORDER BY cell DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, list_sum(list_transform(generate_series(0, k), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA / len(STATS)!r}::DOUBLE) + (n - j) * ln({1 - ALPHA / len(STATS)!r}::DOUBLE)))) AS p,
  CAST(hit AS DOUBLE) / greatest(n_bad, 1) - {PRICE!r}::DOUBLE * k / greatest(n, 1) AS gain FROM n WHERE n > 0),
z AS (SELECT lang, stat, max(row(round(gain, 9), cell)) AS best FROM b WHERE p <= {cut} AND k <= n * {ALPHA / len(STATS)!r} AND hit > 0 AND gain > 0 GROUP BY ALL),
f AS (SELECT v.r, string_agg(v.stat, ',' ORDER BY list_position({list(STATS)!r}, v.stat)) AS failed FROM v JOIN z ON v.stat = z.stat AND v.lang IS NOT DISTINCT FROM z.lang AND v.v > struct_extract(z.best, 2) GROUP BY v.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed_rules
FROM m LEFT JOIN f USING (r)"""


SQL = _sql()
