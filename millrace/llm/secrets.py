"""Secret scans: base patterns, and sliding-window Shannon entropy over candidate strings. DataFrame expressions only.

Spark has no function for the places of all matches, so they are rebuilt: split() gives the text between matches and
regexp_extract_all() the matches, and a running sum of their lengths gives each start and end in code points.

Entropy: a candidate is a long run of key-like characters. A window slides over it; the counts of its characters and the sum of
c * log2(c) are carried along and changed only for the character that enters and the one that leaves. The counts are the signs of a
string, one place for each character of the candidate, so a change is an overlay of one sign. Each character class has
a threshold of its own. Candidates that fit the allow list are suppressed. Base spans are never suppressed.

Very long texts: a fold that appends to an array copies it each time, so folds over matches run in blocks of PART and join the blocks' results. A
text of a million characters full of matches, or one run of a hundred thousand key-like characters, takes seconds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: kind: (pattern, group whose length counts, least length, cheap test of a text). Listed order breaks ties of a start.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i:passw|secret|token|api_?key)"),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, r"AKIA"),
    "hex": (r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
}
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: class: (what a candidate of it looks like, least entropy of a window in bits). The first class that fits holds. Both need a digit.
CLASSES = {"hex": (r"^[0-9a-fA-F]+$", 3.0), "mixed": (r"^(?=.*[A-Za-z])[A-Za-z0-9+/_-]+$", 3.7)}
#: Candidates that fit one of these are no secrets: ids, counters, paths and words made up of letters, placeholders.
ALLOW = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|dummy|changeme|xxxx",
    r"(?i)0123456789|123456789|abcdefghij",
    r"^[0-9+/_-]+$",
    r"^[A-Za-z]*+(?:[/_+-][A-Za-z]++)*+[/_+-]?[0-9]{0,4}$",
]
#: Matches or spans that one inner fold goes over.
PART = 512
#: A count's sign in the string of counts.
SIGNS = "".join(chr(48 + k) for k in range(WINDOW + 2))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_parts(rows: Column, start: Callable[[Column], Column], step: Callable[[Column, Column, Column], Column], kind: str, end: Callable[[Column, Column], Column] | None = None) -> Column:
    """Folds rows with the state (p int, o array<kind>), o being what was put out. start(part) gives what step(state, row, it) may use of a part.

    The inner fold of a part starts with an empty o; the outer one joins them: the cost is n * (PART + n / PART) for n rows, not n * n.
    """
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / PART).cast("int")), lambda k: F.slice(rows, k * PART + 1, F.lit(PART)))
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, part: Column) -> Column:
        inner = let(start(acc["p"], part), lambda it: F.aggregate(part, F.struct(acc["p"].alias("p"), none.alias("o")), lambda a, row: step(a, row, it)))
        return let(inner, lambda i: F.struct(i["p"].alias("p"), F.concat(acc["o"], i["o"]).alias("o")))

    whole = F.aggregate(parts, F.struct(F.lit(0).alias("p"), none.alias("o")), one)
    return F.when(F.size(rows) > 0, let(whole, lambda a: end(a["p"], a["o"])) if end else whole["o"])


def match_spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<s int, e int, m string>>: all matches, leftmost and non-overlapping, of which group has at least least code points."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(found)), lambda g: F.length(g)).alias("g"), found.alias("m"), F.transform(counted, lambda c: F.length(c) >= least).alias("k"))
    kind = "struct<s:int,e:int,m:string>"

    def step(acc: Column, row: Column, _: Column) -> Column:
        s = acc["p"] + row["g"]
        e = s + F.length(row["m"])
        one = F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), row["m"].alias("m"))
        return F.struct(e.cast("int").alias("p"), F.when(row["k"], F.array_append(acc["o"], one)).otherwise(acc["o"]).alias("o"))

    return F.coalesce(let(rows, lambda r: in_parts(r, lambda *_: F.lit(0), step, kind)), F.array().cast(f"array<{kind}>"))


def entropy_span(candidate: Column, threshold: Column, window: int = WINDOW) -> Column:
    """struct<s, e>: from the first to the end of the last window of the candidate whose entropy reaches the threshold; null without one. Candidates are ASCII, of window characters or more."""
    f = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])

    def count(counts: Column, place: Column) -> Column:
        return F.ascii(F.substring(counts, place, F.lit(1))) - 48

    def with_count(counts: Column, place: Column, value: Column) -> Column:
        return F.overlay(counts, F.substring(F.lit(SIGNS), value + 1, F.lit(1)), place, F.lit(1))

    def body(x: Column) -> Column:
        places, need = x["x"], x["need"]
        head = F.slice(places, 1, window)
        counts = F.aggregate(head, F.repeat(F.lit("0"), x["n"]), lambda n, i: with_count(n, i, count(n, i) + 1))
        total = lambda n: F.aggregate(F.sequence(F.lit(1), x["n"]), F.lit(0.0), lambda t, i: t + F.get(f, count(n, i)))
        nothing = F.lit(None).cast("int")

        def mark(n: Column, t: Column, s: Column, e: Column, at: Column) -> Column:
            hit = t <= need
            return F.struct(n.alias("n"), t.alias("t"), F.when(hit & s.isNull(), at).otherwise(s).alias("s"), F.when(hit, at + window).otherwise(e).alias("e"))

        def slide(acc: Column, i: Column) -> Column:
            """Window i: character i + window - 1 enters, character i - 1 leaves."""

            def moved(v: Column) -> Column:
                fewer = let(count(acc["n"], v["o"]), lambda c: F.struct(with_count(acc["n"], v["o"], c - 1).alias("n"), (acc["t"] + F.get(f, c - 1) - F.get(f, c)).alias("t")))
                more = lambda a: let(count(a["n"], v["i"]), lambda c: F.struct(with_count(a["n"], v["i"], c + 1).alias("n"), (a["t"] + F.get(f, c + 1) - F.get(f, c)).alias("t")))
                return F.when(v["i"] == v["o"], F.struct(acc["n"].alias("n"), acc["t"].alias("t"))).otherwise(let(fewer, more))

            ends = F.struct(F.get(places, i + window - 1).alias("i"), F.get(places, i - 1).alias("o"))
            return let(let(ends, moved), lambda a: mark(a["n"], a["t"], acc["s"], acc["e"], i))

        steps = F.when(F.size(places) > window, F.sequence(F.lit(1), F.size(places) - window)).otherwise(F.array().cast("array<int>"))
        first = let(counts, lambda n: mark(n, total(n), nothing, nothing, F.lit(0)))
        done = F.aggregate(steps, first, slide)
        return let(done, lambda a: F.when(a["s"].isNotNull(), F.struct(a["s"].alias("s"), a["e"].alias("e"))))

    chars = F.filter(F.split(candidate, ""), lambda c: c != "")
    need = (math.log2(window) - threshold) * window + 1e-9  # entropy = log2(window) - t / window
    known = let(chars, lambda c: F.struct(c.alias("c"), F.array_join(F.array_distinct(c), "").alias("a")))
    ready = let(known, lambda x: F.struct(F.length(x["a"]).alias("n"), F.transform(x["c"], lambda c: F.position(c, x["a"])).alias("x"), need.alias("need")))
    return let(ready, body)


def _without(found: Column, pattern: Column) -> Column:
    return F.filter(found, lambda c: ~F.rlike(c["m"], pattern))


def _of_kind(found: Column, k: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e")))


def _count(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda v: v["k"] == k)).cast("long")


def entropy_spans(text: Column, allow: list[str] = ALLOW) -> Column:
    """array<struct<s, e, m>> of the method's own findings."""
    found = F.filter(match_spans(text, CANDIDATE), lambda c: F.rlike(c["m"], F.lit("[0-9]")))
    for pattern in map(F.lit, allow):
        found = _without(found, pattern)

    def judge(c: Column) -> Column:
        limit = F.lit(None).cast("double")
        for pattern, least in reversed(CLASSES.values()):
            limit = F.when(F.rlike(c["m"], F.lit(pattern)), F.lit(least)).otherwise(limit)
        span = entropy_span(c["m"], limit)
        return let(span, lambda v: F.struct((c["s"] + v["s"]).cast("int").alias("s"), (c["s"] + v["e"]).cast("int").alias("e"), c["m"].alias("m")))

    return F.filter(F.transform(found, judge), lambda v: v["s"].isNotNull())


KINDS = [*BASE, "entropy"]


def secret_spans(text: Column) -> Column:
    """array<struct<s int, k int, e int>> sorted: every span of the text, k its kind's place in KINDS. A null text has none."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    parts = []
    for k, (pattern, group, least, test) in enumerate(BASE.values()):
        # Runs of one class that are too short can be left out of the pattern itself: they hide nothing.
        exact = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}.get(KINDS[k], pattern)
        spans = _of_kind(match_spans(t, exact, group, least), k)
        parts.append(F.when(F.rlike(t, F.lit(test)), spans).otherwise(none))
    own = _of_kind(entropy_spans(t), len(BASE))
    parts.append(F.when(F.rlike(t, F.lit(CANDIDATE[:-2] + "}")), own).otherwise(none))
    return F.sort_array(F.concat(*parts))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda v: F.concat(F.get(names, v["k"]), F.lit(":"), v["s"].cast("string"), F.lit(":"), v["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mark. spans are sorted by start."""

    def piece(p: Column, part: Column) -> Column:
        """The stretch of the text that a part of the spans is in, and where it starts."""
        last = F.greatest(p, F.array_max(F.transform(part, lambda v: v["e"])))
        return F.struct(p.alias("at"), F.substring(text, p + 1, last - p).alias("t"))

    def step(acc: Column, v: Column, it: Column) -> Column:
        before = F.substring(it["t"], acc["p"] - it["at"] + 1, v["s"] - acc["p"])
        fresh = v["s"] >= acc["p"]
        return F.struct(F.greatest(acc["p"], v["e"]).alias("p"), F.when(fresh, F.concat(acc["o"], F.array(before, F.lit(mark)))).otherwise(acc["o"]).alias("o"))

    whole = lambda v: in_parts(v, piece, step, "string", lambda p, o: F.concat(F.array_join(o, ""), F.substring(text, p + 1, F.length(text))))
    return F.coalesce(let(spans, whole), text)


def scan_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secret_spans") -> DataFrame:
    """docs with out_col: the sorted spans of each text. Null and empty texts have none. No shuffle; repeated rows and extra columns stay, but for one named like out_col."""
    return docs.withColumn(out_col, secret_spans(F.col(text_col)))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of documents."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    v = F.col("secret_spans")
    counts = [_count(v, k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    base = F.filter(v, lambda x: x["k"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(v).alias("spans"))


def _anycase(words: str) -> str:
    """The words as a pattern in either case, for engines whose case folding goes beyond A-Z."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _matches(kind: int, pattern: str, group: int, least: int) -> str:
    """SQL for the matches of a base pattern: the text between matches and the matches give the places."""
    pattern = pattern.replace("'", "''")
    return f"""SELECT n, {kind} AS k, m, sum(length(g) + length(m)) OVER (PARTITION BY n ORDER BY i) - length(m) AS s, length(c) >= {least} AS ok FROM (
        SELECT n, unnest(range(len(f))) AS i, unnest(f) AS m, unnest(c) AS c, unnest(gaps[1:len(f)]) AS g FROM (
            SELECT n, regexp_extract_all(t, '{pattern}') AS f, regexp_extract_all(t, '{pattern}', {group}) AS c, string_split_regex(t, '{pattern}') AS gaps FROM d) WHERE len(f) > 0)"""


_KEYS = _anycase("password") + "|" + _anycase("passwd") + "|" + _anycase("secret") + "|" + _anycase("token") + "|" + _anycase("api") + "_?" + _anycase("key")
_NOT = " AND ".join("NOT regexp_matches(m, '{}')".format(p.replace("*+", "*").replace("++", "+")) for p in ALLOW)
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
b AS ({_matches(0, BASE["assign"][0].replace("(?i:password|passwd|secret|token|api_?key)", _KEYS), BASE["assign"][1], BASE["assign"][2])}
 UNION ALL {_matches(1, BASE["access"][0], 0, BASE["access"][2])} UNION ALL {_matches(2, BASE["hex"][0], 0, BASE["hex"][2])}),
c AS (SELECT row_number() OVER () AS id, n, s, m, CASE WHEN regexp_matches(m, '^[0-9a-fA-F]+$') THEN {CLASSES["hex"][1]} WHEN regexp_matches(m, '[A-Za-z]') THEN {CLASSES["mixed"][1]} END AS least
      FROM ({_matches(3, CANDIDATE, 0, WINDOW)}) WHERE regexp_matches(m, '[0-9]') AND {_NOT}),
w AS (SELECT id, n, s, least, pos, string_split(substr(m, pos + 1, {WINDOW}), '') AS x FROM (SELECT *, CAST(unnest(range(length(m) - {WINDOW - 1})) AS INTEGER) AS pos FROM c)),
h AS (SELECT id, n, s, pos FROM w WHERE log2({WINDOW}) - list_sum(list_transform(list_distinct(x), lambda y: len(list_filter(x, lambda z: z = y)) * log2(len(list_filter(x, lambda z: z = y))))) / {WINDOW} >= least - 1e-10),
v AS (SELECT n, k, s, s + length(m) AS e FROM b WHERE ok UNION ALL SELECT n, 3, s + min(pos), s + max(pos) + {WINDOW} FROM h GROUP BY id, n, s),
o AS (SELECT n, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(CASE WHEN k < 3 THEN ['assign', 'access', 'hex'][k + 1] || ':' || s || ':' || e END, ',' ORDER BY s, k, e) AS base,
        string_agg(['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM v GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (n)
"""
