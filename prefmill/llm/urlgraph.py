"""URL filters by propagation over the link graph of hosts.

Explicit rules decide first, the longest that fits. For the rest, hosts of allowed
pages seed a personalised PageRank along the links and hosts of blocked pages
seed one against the links, each from seeds of sum 1. What reaches a host without further links
goes back to the seeds; that makes all scores larger by one factor, so it is done at the end by
dividing by their sum. A host is blocked if its distrust exceeds its trust, each times the
number of hosts that seed it, so a host without links is judged by the shares of its own pages. The
propagation runs until what is still under way is too little to change a verdict.

Defined cases: a null url, or one without "://", has an empty host and path, and is
allowed; hosts without links or seeds score 0 on both sides and are allowed; links to
the own host, relative ones included, are no edges; equal edges count once; a null
html has no links. Equal rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut_lineage, salted_join, table

#: (verdict, host, path); a rule's name is host and path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
#: Distrust over trust from which a host is blocked, and by how much at least.
RATIO, MARGIN = 1.0, 1e-8
#: Weight moved in a round, of 1 for each seed, at which the propagation ends. That round and all later ones move at most 1 / (1 - damping) = 6.7 times that, which is under MARGIN.
TOLERANCE = 1e-9
#: A host with over this share of all links is dealt over SALTS tasks.
HOT_SHARE, SALTS = 10_000, 64
#: The href of an a element, and not the end of another attribute's name.
HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?((?:https?:)?//[^\s"'>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), r"\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = None, None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links between different hosts, from href values in double, single or no quotes; those without a scheme keep the page's."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)))).alias("to"))
    to = host_of(F.when(F.startswith("to", F.lit("//")), F.concat(F.lit(":"), "to")).otherwise(F.col("to")))
    return links.select("src", to.alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from seeds (host, seed_trust, seed_distrust), both directions in one join and one sum a round; each of the two sums to 1 over all hosts, as the seeds, divided by their sum, do.

    The score is the sum of what arrives: 1 - damping of the seeds, then in every round
    ``damping`` of what arrived in the round before (t, d), in equal parts over the links (trust
    along, distrust against). It ends when a round moves ``tolerance`` or less; the weight falls
    by ``damping`` a round at least, so it does. Lineage is cut every round. Links of hosts with very many are dealt over several tasks.
    """
    both = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.lit(True).alias("along")).union(edges.select(F.col("dst"), F.col("src"), F.lit(False)))
    degree = cut_lineage(both.groupBy("host", "along").agg(F.count("*").alias("degree")))
    n = degree.agg(F.sum("degree")).first()[0] or 0
    # Fewer than HOT_SHARE hosts, whatever the input.
    hot = degree.groupBy("host").agg(F.sum("degree").alias("n")).filter((F.col("n") > n / HOT_SHARE) & (F.col("n") > 2_000)).select("host", F.lit(True).alias("hot"))
    hot = cut_lineage(hot)
    none, hot = hot.isEmpty(), F.broadcast(hot)
    both = both.join(hot, "host", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("to"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    # By the same hot list as the links: a host may be hot by both directions together and have few links in one.
    wide = degree.join(hot, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), F.lit(SALTS - 1)).otherwise(0)))).drop("hot")
    both = cut_lineage(both.join(wide, ["host", "along", "salt"]))
    score = cut_lineage(seeds.select("host", ((1 - damping) * F.col("seed_trust")).alias("trust"), ((1 - damping) * F.col("seed_distrust")).alias("distrust")))
    if not both.isEmpty():
        score = score.select("*", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        while True:
            now = score.filter("t > 0 OR d > 0").select("host", "t", "d")
            if not none:
                now = now.join(hot, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), F.lit(SALTS - 1)).otherwise(0)))).drop("hot")
            sent = both.join(now, ["host"] if none else ["host", "salt"]).select(
                F.col("to").alias("host"), F.when(F.col("along"), damping * F.col("t") / F.col("degree")).otherwise(0.0).alias("t"),
                F.when(F.col("along"), 0.0).otherwise(damping * F.col("d") / F.col("degree")).alias("d"),
            )
            rows = sent.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"), "t", "d").union(score.select("host", "trust", "distrust", F.lit(0.0), F.lit(0.0)))
            moved = Observation()
            score = cut_lineage(rows.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "t", "d")]).observe(moved, F.sum(F.col("t") + F.col("d")).alias("n")))
            if moved.get["n"] <= tolerance:
                break
    whole = score.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    return score.select("host", (F.col("trust") / F.lit(whole.t or 1.0)).alias("trust"), (F.col("distrust") / F.lit(whole.d or 1.0)).alias("distrust"))


def judge_urls(pages: DataFrame, rules=RULES, ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict for each page."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": name, "_said": verdict})
    share = p.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("_said") == "allow").alias("a"), F.count_if(F.col("_said") == "block").alias("b"))
    seeds = cut_lineage(share.select("host", "n", (F.col("a") / F.col("n")).alias("seed_trust"), (F.col("b") / F.col("n")).alias("seed_distrust")))
    mass = seeds.agg(F.sum("seed_trust").alias("t"), F.sum("seed_distrust").alias("d")).first()
    score = propagate(seeds.drop("n"), host_edges(pages))
    worse = F.col("distrust") * F.lit(mass.d or 0.0) > ratio * F.col("trust") * F.lit(mass.t or 0.0) + MARGIN
    bad = cut_lineage(score.filter(worse).join(seeds.select("host", "n"), "host").select("host", "n", F.lit("block").alias("_bad")))
    return salted_join(p, bad, "host", "n", "left").select("page_id", "host", "path", "rule", F.coalesce("_said", "_bad", F.lit("allow")).alias("verdict"))


def op8_urls(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _sql() -> str:
    cases = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in cases]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, cases, strict=True)) + " END"
    said = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, cases, strict=True)) + " END"
    lower = f"translate(%s, '{UPPER}', '{LOWER}')"
    rest = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
    host = "coalesce(" + lower % ("regexp_extract(" + rest + ", '^([^/?#]*)', 1)") + ", '')"
    rounds = 230  # of a million seeds and any links, what moves then is under TOLERANCE
    return f"""WITH RECURSIVE u AS (SELECT page_id, html, {host.format('url')} AS host, coalesce(regexp_extract({rest.format('url')}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT page_id, html, host, path, {rule} AS rule, {said} AS said FROM u),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '{HREF.replace("'", "''")}', 1)) AS t FROM p),
e AS (SELECT DISTINCT src, dst FROM (SELECT src, {host.format("(CASE WHEN starts_with(t, '//') THEN ':' || t ELSE t END)")} AS dst FROM l) WHERE src <> '' AND dst <> '' AND src <> dst),
o AS (SELECT src, count(*) AS n FROM e GROUP BY src), i AS (SELECT dst, count(*) AS n FROM e GROUP BY dst),
s AS (SELECT host, CAST(count(*) FILTER (said = 'allow') AS DOUBLE) / count(*) AS a, CAST(count(*) FILTER (said = 'block') AS DOUBLE) / count(*) AS b FROM p WHERE host <> '' GROUP BY host),
n AS (SELECT sum(a) AS a, sum(b) AS b FROM s),
x AS (SELECT 0 AS k, host, {1 - DAMPING!r}::DOUBLE * coalesce(s.a / nullif(n.a, 0), 0) AS t, {1 - DAMPING!r}::DOUBLE * coalesce(s.b / nullif(n.b, 0), 0) AS d FROM s, n
  UNION ALL SELECT k + 1, host, sum(t), sum(d) FROM (
    SELECT k, e.dst AS host, {DAMPING!r}::DOUBLE * x.t / o.n AS t, 0::DOUBLE AS d FROM x JOIN e ON x.host = e.src JOIN o ON o.src = e.src
    UNION ALL SELECT k, e.src, 0::DOUBLE, {DAMPING!r}::DOUBLE * x.d / i.n FROM x JOIN e ON x.host = e.dst JOIN i ON i.dst = e.dst) WHERE k < {rounds} GROUP BY k, host),
y AS (SELECT host, sum(t) AS t, sum(d) AS d FROM x GROUP BY host),
z AS (SELECT host, t / nullif(sum(t) OVER (), 0) * n.a AS t, d / nullif(sum(d) OVER (), 0) * n.b AS d FROM y, n)
SELECT page_id, p.host, path, rule, coalesce(said, CASE WHEN coalesce(d, 0) > {RATIO!r}::DOUBLE * coalesce(t, 0) + {MARGIN!r}::DOUBLE THEN 'block' END, 'allow') AS verdict FROM p LEFT JOIN z ON p.host = z.host"""

SQL = _sql()
