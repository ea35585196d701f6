"""Secret scans through a trigram inverted index.

Each rule's regular expression is reduced to a Boolean query over lower-case
trigrams that any match must hold. The index has a posting (trigram, document)
for every trigram that some query uses; postings meet by document, queries are
answered there, and only the candidates of a rule are verified with its
expression. Rules without a mandatory trigram scan every text.

Defined cases: a null text is empty; equal rows get equal results; a null doc_id is an id like any
other; an empty table gives an empty result. Texts are scanned whole.
"""

from __future__ import annotations

from itertools import product
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, let, table, text_key

#: kind -> (expression, characters that a match, or its group 2, needs, whether group 2 counts). Base kinds in their order, then the added ones.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = {
    "assign": (ASSIGN, 8, True),
    "access": (r"AKIA[A-Z0-9]+", 16, False),
    "hex": (r"[0-9a-f]{32,}", 32, False),
    # The key itself up to its end line (six lone hyphens may be in its headers), or what can be its body where the end line is missing.
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,6}-----END [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/=\x09-\x0D]*)", 1, False),
    "github": (r"gh[oprsu]_[A-Za-z0-9]{36,}", 1, False),
    "github_pat": (r"github_pat_[A-Za-z0-9_]{36,}", 1, False),
    "gitlab": (r"glpat-[A-Za-z0-9_-]{20,}", 1, False),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 1, False),
    "webhook": (r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}", 1, False),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 1, False),
    "bearer": (r"[bB]earer [A-Za-z0-9._~+/-]{20,}", 1, False),
    "google": (r"AIza[A-Za-z0-9_-]{35}", 1, False),
    "stripe": (r"[rs]k_(live|test)_[A-Za-z0-9]{16,}", 1, False),
    "sendgrid": (r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", 1, False),
    "npm": (r"npm_[A-Za-z0-9]{36}", 1, False),
    "azure": (r"AccountKey=[A-Za-z0-9+/]{40,}={0,2}", 1, False),
    "url": (r"://[^/?#@:\x20\x09-\x0D]{1,64}:[^/?#@\x20\x09-\x0D]{1,128}@", 1, False),
}
BASE = ("assign", "access", "hex")
MOST_STRINGS = 64
#: Trigrams of one alternative that the index holds, spread over it; a text without one of them has no match.
MOST_TRIGRAMS = 3


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, each a set of trigrams that a match must all hold; None if a match may hold none."""

    def small(s: set[str]) -> bool:
        return len(s) <= MOST_STRINGS

    def both(a, b):
        return b if a is None else a if b is None else tidy([x | y for x, y in product(a, b)])

    def tidy(q):
        q = list(dict.fromkeys(q))
        return None if any(not x for x in q) else [x for x in q if not any(y < x for y in q)]

    def of(strings: set[str]):
        return tidy([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])

    def item(op, arg) -> tuple[set[str] | None, list | None]:
        """(all strings that it matches, or None if they are many; query)"""
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}, None
        if name == "IN":
            chars: set[str] = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    chars.add(chr(x).lower())
                elif str(kind) == "RANGE" and x[1] - x[0] < 4:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None, None
            return (chars, None) if len(chars) <= 5 else (None, None)
        if name == "SUBPATTERN":
            return sequence(arg[-1])
        if name == "BRANCH":
            parts = [sequence(x) for x in arg[1]]
            if all(e is not None for e, _ in parts) and small(u := set().union(*(e for e, _ in parts))):
                return u, None
            queries = [both(q, of(e) if e is not None else None) for e, q in parts]
            return None, None if any(q is None for q in queries) else tidy([x for q in queries for x in q])
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = arg
            e, q = sequence(body)
            if high == low == 1:
                return e, q
            if (low, high) == (0, 1) and e is not None:
                return e | {""}, None
            return None, (both(q, of(e) if e is not None else None) if low else None)
        return None, None

    def sequence(nodes):
        """Runs of exactly known strings are joined; a run ends where they become unknown or too many."""
        run, query, exact = {""}, None, True
        for op, arg in nodes:
            if str(op) == "AT":
                continue
            e, q = item(op, arg)
            if e is not None and small(joined := {a + b for a, b in product(run, e)}):
                run = joined
                continue
            query, run, exact = both(query, of(run)), (e if e is not None else {""}), False
            query = both(query, q)
        return (run, None) if exact else (None, both(query, of(run)))

    e, q = sequence(_parser.parse(pattern))
    return both(q, of(e) if e is not None else None)


def fewer(query: list[frozenset[str]], most: int = MOST_TRIGRAMS) -> list[frozenset[str]]:
    """A weaker query of at most ``most`` trigrams an alternative; any text that satisfies the query satisfies it."""
    spread = lambda x: [x[i * (len(x) - 1) // max(1, min(most, len(x)) - 1)] for i in range(min(most, len(x)))]
    return list(dict.fromkeys(frozenset(spread(sorted(a))) for a in query))


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The inverted index, a row for each trigram of the vocabulary and document that has it."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    has = let(lower, lambda t: F.filter(F.array(*map(F.lit, vocabulary)), lambda g: F.contains(t, g)))
    return docs.select("doc_id", text_key(F.col("text")).alias("_key"), has.alias("_has")).select("doc_id", "_key", F.explode("_has").alias("trigram"))


def candidates(docs: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """Documents with the rules whose query their postings satisfy."""
    vocabulary = sorted(set().union(*(a for q in queries.values() for a in q)))
    met = postings(docs, vocabulary).groupBy("doc_id", "_key").agg(F.collect_set("trigram").alias("_has"))

    def holds(q: list[frozenset[str]]) -> Column:
        terms = [F.size(F.array_intersect("_has", F.array(*map(F.lit, sorted(a))))) == len(a) for a in q]
        out = terms[0]
        for t in terms[1:]:
            out = out | t
        return out

    rules = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]))
    return met.select("doc_id", "_key", rules.alias("_rules")).filter(F.size("_rules") > 0)


def spans(text: Column, order: int, kind: str, pattern: str, least: int, group: bool) -> Column:
    """(start, order, kind, end) of the matches: lengths of the pieces between and of the matches add up to the places."""

    def places(found: Column, parts: Column, values: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>").alias("out"))

        def add(a: Column, x: Column) -> Column:
            i = x["i"]
            begin = a["end"] + F.length(F.get(parts, i))
            end = begin + F.length(x["m"])
            one = F.array(F.struct(begin.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), end.alias("end")))
            return F.struct(end.alias("end"), F.when(F.length(F.get(values, i)) >= least, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

        return F.aggregate(F.transform(found, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), start, add)["out"]

    p = F.lit(pattern)
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    values = F.regexp_extract_all(text, p, F.lit(2)) if group else None
    return let(
        F.regexp_extract_all(text, p, F.lit(0)),
        lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda s: places(m, s, m) if values is None else let(values, lambda v: places(m, s, v)))),
    )


def scan_secrets(docs: DataFrame, rules: dict[str, tuple[str, int, bool]] | None = None) -> DataFrame:
    """doc_id and found, an array of (start, order, kind, end) sorted by start and then order; code points, end exclusive."""
    rules = rules or RULES
    queries = {k: fewer(q) for k, (p, _, _) in rules.items() if (q := trigram_query(p)) is not None}
    d = docs.select("doc_id", text_key(F.col("text")).alias("_key"), F.coalesce("text", F.lit("")).alias("text")).alias("d")
    # A merge join at every size: texts are shuffled once, over small tables too.
    c = cut_lineage(candidates(docs, queries)).hint("merge").alias("c")
    d = d.join(c, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d._key") == F.col("c._key")), "left").select("d.doc_id", "text", "_rules")
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    found = []
    for order, (k, (p, least, group)) in enumerate(rules.items()):
        s = spans(F.col("text"), order, k, p, least, group)
        found.append(s if k not in queries else F.when(F.array_contains("_rules", k), s).otherwise(none))
    return d.select("doc_id", F.sort_array(F.concat(*found)).alias("found"))


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    f = scan_secrets(table(spark, sf_dir, "documents"))
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["order"] < len(BASE))
    number = lambda i: F.size(F.filter("found", lambda x: x["order"] == i)).cast("long")
    n = [number(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return f.select("doc_id", *n, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))


def _sql() -> str:
    """For each kind the matches with the ends of all text up to them, from the lengths of pieces and matches."""
    parts = []
    for order, (k, (p, least, group)) in enumerate(RULES.items()):
        q = p.replace("'", "''")
        parts.append(
            f"SELECT r, {order} AS o, '{k}' AS k, unnest(string_split_regex(t, '{q}')) AS piece, unnest(list_concat(regexp_extract_all(t, '{q}'), [NULL])) AS m, "
            f"unnest(list_concat(regexp_extract_all(t, '{q}', {2 if group else 0}), [NULL])) AS v, {least} AS least, unnest(generate_series(1, len(regexp_extract_all(t, '{q}')) + 1)) AS i FROM d"
        )
    return (
        "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),\np AS ("
        + "\nUNION ALL ".join(parts)
        + """),
e AS (SELECT *, CAST(sum(length(piece) + coalesce(length(m), 0)) OVER (PARTITION BY r, o ORDER BY i) AS BIGINT) AS e FROM p),
f AS (SELECT r, o, e - length(m) AS s, k || ':' || (e - length(m)) || ':' || e AS x FROM e WHERE m IS NOT NULL AND length(v) >= least),
a AS (SELECT r, count(*) FILTER (o = 0) AS a, count(*) FILTER (o = 1) AS b, count(*) FILTER (o = 2) AS c,
             string_agg(x, ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg(x, ',' ORDER BY s, o) AS every FROM f GROUP BY r)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN a USING (r)"""
    )


SQL = _sql()
