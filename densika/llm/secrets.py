"""Secret scan: base patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of 20 or more characters of the base-64 alphabets.  A window of 20 characters slides
over it; the counts of its characters change by one that enters and one that leaves, and with them the sum
of ``c * log2(c)``, from which the entropy follows.  The threshold depends on the class of the candidate:
hexadecimal, one case of letters with digits, or mixed.  The flagged windows' hull is a span of kind
``entropy``.  The allow list drops candidates that are no secrets by their form: letters alone, digits
alone, UUIDs, words joined by hyphens or slashes, and strings marked as examples.  It never drops a span of
the base patterns.  An entropy span inside a base span adds nothing and is left out.

Positions are code points, the end exclusive.  A null text counts as empty, and a row without spans has the
digest of the empty string.  Rows are independent: repeated rows repeat their result, an empty table gives
an empty one, and columns besides ``text`` are carried in ``doc`` untouched, whatever their names.  Texts of
any length are searched whole: no pattern repeats a group, so that the matcher's stack does not grow with a
run, and lists of matches are worked off in chunks, so that time grows with the matches and not their square.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Texts without a match of this have no span at all, so that one pass over them is enough.
ANY = r"""[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]|[A-Za-z0-9+/_=-]{20}"""
WINDOW = 20
CHUNK = 256  # matches whose offsets are added up together
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Class of a candidate, and the bits a window needs.
CLASSES = ((r"^[0-9A-Fa-f]+$", 3.0), (r"^([0-9a-z]+|[0-9A-Z]+)$", 3.6), (r".", 3.9))
ALLOWED = (
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[A-Za-z]*[-_/=+][-_/=+A-Za-z]*[0-9]{0,4}$",
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]",
)
SPAN = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` as ``array<struct<start, text>>``: the pieces between them give the positions.

    Offsets run within chunks of matches first and then over the chunks, so that lists grow by short appends.
    """
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,text:string>>")

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["piece"])
        found = F.array(F.struct(at.alias("start"), x["hit"].alias("text")))
        return F.struct((at + F.length(x["hit"])).alias("at"), F.concat(acc["out"], found).alias("out"))

    def chunked(pairs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        chunks = F.sequence(F.lit(1), F.size(pairs), F.lit(CHUNK))
        return F.transform(chunks, lambda c: F.aggregate(F.slice(pairs, c, F.lit(CHUNK)), start, step))

    def shifted(chunks: Column) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("bases"))
        bases = F.aggregate(chunks, empty, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases")))
        moved = F.zip_with(chunks, bases["bases"], lambda x, base: F.transform(x["out"], lambda m: F.struct((m["start"] + base).alias("start"), m["text"].alias("text"))))
        return F.flatten(moved)

    def of(hit: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        pairs = F.arrays_zip(hit.alias("hit"), F.slice(pieces, 1, F.size(hit)).alias("piece"))
        return F.when(F.size(hit) > 0, let(let(pairs, chunked), shifted))

    return let(hit, of)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["text"])).alias("end")))


def reached(spans: Column, counts: Callable[[Column], Column]) -> Column:
    """Chunks of the sorted ``spans``, each span with ``reach``: the largest end of those before it that count.

    Chunks give their own largest end first, then run from the largest end before them.
    """

    def chunked(spans: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(spans), F.lit(CHUNK)), lambda c: F.slice(spans, c, F.lit(CHUNK)))

    def further(at: Column, x: Column) -> Column:
        return F.when(counts(x), F.greatest(at, x["end"])).otherwise(at)

    def run(chunk: Column, at: Column) -> Column:
        first = F.slice(chunk, 1, 0)
        start = F.struct(at.alias("at"), F.transform(first, lambda x: F.struct(x.alias("span"), F.lit(0).alias("reach"))).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            return F.struct(further(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(F.struct(x.alias("span"), acc["at"].alias("reach")))).alias("out"))

        return F.aggregate(chunk, start, step, lambda acc: acc["out"])

    def of(chunks: Column) -> Column:
        own = F.transform(chunks, lambda chunk: F.aggregate(chunk, F.lit(0), further))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(own, empty, lambda acc, x: F.struct(F.greatest(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
        return F.zip_with(chunks, before["out"], run)

    return F.when(F.size(spans) > 0, let(let(spans, chunked), of))


def outside(spans: Column, base: Column) -> Column:
    """Those of ``spans`` (start, end, text) that lie in no base span, in the order of their starts."""
    own = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(True).alias("own"), x["end"].alias("end"), x["text"].alias("text")))
    bases = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(False).alias("own"), b["end"].alias("end"), F.lit(None).cast("string").alias("text")))
    both = F.array_sort(F.concat(bases, own))  # of equal starts the base spans come first
    open_ = F.filter(F.flatten(let(both, lambda x: reached(x, lambda s: ~s["own"]))), lambda x: x["span"]["own"] & (x["reach"] < x["span"]["end"]))
    return F.when(F.size(spans) > 0, F.transform(open_, lambda x: F.struct(x["span"]["start"].alias("start"), x["span"]["end"].alias("end"), x["span"]["text"].alias("text"))))


def base_spans(text: Column) -> Column:
    """Spans of the three base patterns, sorted by start and kind.  Short matches are consumed, then dropped."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = let(values, lambda value: F.filter(_spans(located(text, ASSIGN), 0), lambda x, i: F.length(F.get(value, i)) >= 6))
    none = F.array().cast(SPAN)
    found = [F.coalesce(x.cast(SPAN), none) for x in (assign, _spans(located(text, ACCESS), 1), _spans(located(text, HEX), 2))]
    return F.array_sort(F.concat(*found))


def window_hull(candidate: Column, bits: Column) -> Column:
    """First start and last end of the windows whose entropy reaches ``bits``; null if there is none."""
    cost = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    state = F.struct(
        F.lit("A" * len(ALPHABET)).alias("n"), F.lit(0.0).alias("sum"),  # a letter for each count: A is 0
        F.lit(-1).alias("first"), F.lit(-1).alias("last"),
    )

    def step(acc: Column, i: Column, letters: Column) -> Column:
        def place(i: Column) -> Column:
            return F.instr(F.lit(ALPHABET), F.get(letters, i - 1))

        def held(counts: Column, at: Column) -> Column:
            return F.ascii(F.substring(counts, at, F.lit(1))) - ord("A")

        def put(counts: Column, at: Column, n: Column) -> Column:
            return F.overlay(counts, F.chr((n + ord("A")).cast("long")), at, F.lit(1))

        def leave(acc: Column) -> Column:
            at = place(i - WINDOW)
            n = held(acc["n"], at)
            return F.struct(put(acc["n"], at, n - 1).alias("n"), (acc["sum"] - F.get(cost, n) + F.get(cost, n - 1)).alias("sum"))

        def enter(acc: Column) -> Column:
            at = place(i)
            n = held(acc["n"], at)
            return F.struct(put(acc["n"], at, n + 1).alias("n"), (acc["sum"] - F.get(cost, n) + F.get(cost, n + 1)).alias("sum"))

        kept = F.struct(acc["n"].alias("n"), acc["sum"].alias("sum"))
        moved = let(F.when(i > WINDOW, leave(acc)).otherwise(kept), enter)
        return let(moved, lambda m: judged(acc, i, m["n"], m["sum"]))

    def judged(acc: Column, i: Column, n: Column, total: Column) -> Column:
        flagged = (i >= WINDOW) & (F.round(F.lit(math.log2(WINDOW)) - total / WINDOW, 6) >= bits)
        first = F.when(flagged & (acc["first"] < 0), i - WINDOW).otherwise(acc["first"])
        return F.struct(n.alias("n"), total.alias("sum"), first.alias("first"), F.when(flagged, i).otherwise(acc["last"]).alias("last"))

    def slid(letters: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(candidate))
        return F.aggregate(places, state, lambda acc, i: step(acc, i, letters), lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return let(let(F.split(candidate, ""), slid), lambda done: F.when(done["first"] >= 0, done))


def entropy_spans(text: Column, base: Column) -> Column:
    def bits(s: Column) -> Column:
        return F.when(s.rlike(CLASSES[0][0]), F.lit(CLASSES[0][1])).when(s.rlike(CLASSES[1][0]), F.lit(CLASSES[1][1])).otherwise(F.lit(CLASSES[2][1]))

    def allowed(s: Column) -> Column:
        out = F.lit(False)
        for pattern in ALLOWED:
            out = out | s.rlike(pattern)
        return out

    left = F.filter(located(text, CANDIDATE), lambda x: ~allowed(x["text"]))
    left = F.transform(left, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["text"])).alias("end"), x["text"].alias("text")))

    def hulls(open_: Column) -> Column:
        found = F.transform(open_, lambda x: F.struct(x["start"].alias("start"), let(bits(x["text"]), lambda b: window_hull(x["text"], b)).alias("hull")))
        found = F.filter(found, lambda x: x["hull"].isNotNull())
        return F.transform(
            found, lambda x: F.struct((x["start"] + x["hull"]["first"]).alias("start"), (x["start"] + x["hull"]["last"]).alias("end"), F.lit(None).cast("string").alias("text"))
        )

    # What lies inside a base span is left out before the entropy is counted; a shorter hull may do so after.
    spans = let(outside(left, base), lambda x: let(hulls(x), lambda h: outside(h, base)))
    return F.coalesce(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"))).cast(SPAN), F.array().cast(SPAN))


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Every row as ``doc`` with its spans: ``base`` and ``spans`` (both sorted), arrays of start, kind and end."""
    suspect = F.when(F.col("doc.text").rlike(ANY), F.col("doc.text"))
    rows = docs.select(F.struct("*").alias("doc")).withColumn("suspect", suspect)
    none = F.array().cast(SPAN)
    rows = rows.withColumn("base", F.when(F.col("suspect").isNull(), none).otherwise(base_spans(F.col("suspect"))))
    more = F.when(F.col("suspect").isNull(), none).otherwise(F.array_sort(F.concat("base", entropy_spans(F.col("suspect"), F.col("base")))))
    return rows.withColumn("spans", more).drop("suspect")


def redacted(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """``text`` with every span, overlapping and touching ones together, replaced by ``mark``.

    Each chunk of spans cuts its part of the text once, so that places are counted within that part only.
    """

    def last(chunk: Column) -> Column:
        return F.aggregate(chunk, F.lit(0), lambda at, x: F.greatest(at, x["reach"], x["span"]["end"]))

    def cut(chunk: Column) -> Column:
        base = F.get(chunk, F.lit(0))["reach"]

        def gap(part: Column, x: Column) -> Column:
            fresh = (x["reach"] == 0) | (x["span"]["start"] > x["reach"])
            return F.when(fresh, F.concat(F.substring(part, x["reach"] - base + 1, x["span"]["start"] - x["reach"]), F.lit(mark))).otherwise(F.lit(""))

        return let(F.substring(text, base + 1, last(chunk) - base), lambda part: F.array_join(F.transform(chunk, lambda x: gap(part, x)), ""))

    def joined(chunks: Column) -> Column:
        end = last(F.get(chunks, F.size(chunks) - 1))
        return F.concat(F.array_join(F.transform(chunks, cut), ""), let(end, lambda e: F.substring(text, e + 1, F.length(text))))

    return F.when(F.size(spans) == 0, text).otherwise(let(reached(spans, lambda x: F.lit(True)), joined))


def op1(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


def _sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql() -> str:
    """The same in SQL, with each window's entropy counted afresh."""

    def kind(name: str, order: int, pattern: str, rule: str = "true") -> str:
        p = _sql_literal(pattern)
        return f"""
{name}_m AS (SELECT doc_id, t, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS s, regexp_extract_all(t, {p}, {2 if name == "assign" else 0}) AS v FROM d),
{name} AS (SELECT doc_id, {order} AS kind, a AS start, a + length(m[i]) AS "end", m[i] AS str FROM (
    SELECT doc_id, m, v, i, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
    FROM (SELECT *, unnest(range(1, CAST(len(m) + 1 AS BIGINT))) AS i FROM {name}_m)) WHERE {rule})"""

    bits = f"CASE WHEN regexp_matches(str, {_sql_literal(CLASSES[0][0])}) THEN {CLASSES[0][1]} WHEN regexp_matches(str, {_sql_literal(CLASSES[1][0])}) THEN {CLASSES[1][1]} ELSE {CLASSES[2][1]} END"
    allow = " OR ".join(f"regexp_matches(str, {_sql_literal(p)})" for p in ALLOWED)
    names = "['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || \"end\""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{kind("assign", 0, ASSIGN, "length(v[i]) >= 6")},{kind("access", 1, ACCESS)},{kind("hex", 2, HEX)},{kind("candidate", 3, CANDIDATE)},
base AS (SELECT doc_id, kind, start, "end" FROM assign UNION ALL SELECT doc_id, kind, start, "end" FROM access UNION ALL SELECT doc_id, kind, start, "end" FROM hex),
w AS (SELECT doc_id, start, str, unnest(range(0, CAST(length(str) - {WINDOW - 1} AS BIGINT))) AS i FROM candidate WHERE NOT ({allow})),
ch AS (SELECT doc_id, start, str, i, unnest(string_split(substring(str, CAST(i + 1 AS BIGINT), {WINDOW}), '')) AS c FROM w),
ent AS (SELECT doc_id, start, str, i, round(log2({WINDOW}) - sum(n * log2(n)) / {WINDOW}, 6) AS h FROM (SELECT doc_id, start, str, i, c, count(*) AS n FROM ch GROUP BY ALL) GROUP BY ALL),
hull AS (SELECT doc_id, 3 AS kind, start + min(i) AS a, start + max(i) + {WINDOW} AS b FROM ent WHERE h >= {bits} GROUP BY doc_id, start, str),
extra AS (SELECT doc_id, kind, a AS start, b AS "end" FROM hull WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = hull.doc_id AND base.start <= a AND base."end" >= b)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
bs AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, string_agg({names}, ',' ORDER BY start, kind, "end") AS s FROM base GROUP BY doc_id),
al AS (SELECT doc_id, string_agg({names}, ',' ORDER BY start, kind, "end") AS s FROM every GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(bs.s, '')) AS base_sha256, coalesce(al.s, '') AS spans
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN al USING (doc_id)
"""


SQL = _sql()
