"""Benchmark decontamination with a hash set of normalised test n-grams.

The benchmark's distinct windows of ``n`` words (a shorter item is one window) are hashed.  Every window of
every document is looked up by length and hash alone, so that a probe is a few bytes however long the document;
the set of hashes is broadcast while its measured size stays under ``BROADCAST_BYTES`` and joined by shuffle
beyond.  Documents that hold a hash are read once more: what stands at the hit is cut out and counts once its
words are equal to a window's.

Nulls: a null text has no words.  Items without words have no window.  An item whose id is null marks words
but is not listed; rows that repeat an item id are one item.  Documents are told apart by id and text, so
repeated rows each get the same result.  Empty tables give empty or all-clean results.  Texts are searched
whole, however long; further columns, whatever their names, are carried in ``doc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densika.llm.storage import scratch, store

#: What stands between words, before and after A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_BYTES, ENTRY_BYTES = 64 << 20, 80


def words_of(text: Column) -> Column:
    """Splitting takes a tenth of the time of matching; empty strings come of gaps at the ends."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS), "")


def benchmark_windows(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """``(len, hash, window, item)``, distinct."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.lit(n), F.size("words"))
    at = items.select("item", "words", length.alias("len"), F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("start"))
    cut = F.slice("words", F.col("start"), F.col("len"))
    return at.select("len", F.xxhash64(cut).alias("hash"), F.array_join(cut, " ").alias("window"), "item").distinct()


def _sized(df: DataFrame, bytes_of: Column) -> DataFrame:
    """Broadcast if its rows, each with an entry of a hash table, stay under the limit."""
    size = df.agg(F.sum(bytes_of + ENTRY_BYTES)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """One row a document that holds a window: ``id, mark, spans`` (start from 1, length; sorted) and ``items``."""
    with scratch(docs.sparkSession):
        windows = store(benchmark_windows(benchmark, n), "benchmark-windows")
        lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # n values at most
        hashes = store(windows.select("len", "hash").distinct(), "benchmark-hashes")
        rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), "text")
        words = rows.select("id", "mark", words_of(F.col("text")).alias("words"))
        some = words.select("*", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("len")).where(F.size("words") >= F.col("len"))
        every = some.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("start"))
        probes = every.select("id", "mark", "len", "start", F.xxhash64(F.slice("words", F.col("start"), F.col("len"))).alias("hash"))
        likely = probes.join(_sized(hashes, F.lit(12)), ["len", "hash"], "left_semi")
        likely = store(likely.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "len")).alias("likely")), "benchmark-hits")
        again = likely.select(F.col("id").alias("of"), F.col("mark").alias("of_mark"), "likely")
        same = F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark"))
        # Texts without a hash are left out before any text is shuffled, as long as the list of the others is small.
        held = rows.join(_sized(again.drop("likely"), F.lit(16)), same, "left_semi").join(again, same)
        cut = held.select("id", "mark", "likely", words_of(F.col("text")).alias("words"))
        cut = cut.select("id", "mark", F.explode(F.transform("likely", lambda x: F.struct(x.alias("at"), F.array_join(F.slice(F.col("words"), x["start"], x["len"]), " ").alias("window")))).alias("x"))
        found = cut.select("id", "mark", "x.at", "x.window").join(_sized(windows.select("window", "item").distinct(), F.octet_length("window")), "window")
        per_doc = found.groupBy("id", "mark").agg(F.array_sort(F.collect_set("at")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
        return store(per_doc, "benchmark-spans", keep=True)


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))).cast("long").alias("n"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, one_in: int = 20, carry: list[str] | None = None) -> DataFrame:
    """Every row as ``doc`` (its columns ``carry``, by default all) with ``n_words, n_hit, items, contaminated`` (a hit, and 1 in ``one_in`` words or more)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("doc"), F.xxhash64("text").alias("mark"), F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), CASED_GAPS), "")).cast("long").alias("n_words"))
    found = hits(docs, benchmark, n).withColumnRenamed("mark", "mark_")
    joined = rows.join(found, F.col("doc.doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("mark_")), "left")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("long"))
    out = joined.select("doc", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def op10(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    got = decontaminate(docs.select("doc_id", "text"), benchmark, carry=["doc_id"])
    return got.select(
        "doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, least(13, len(w)) AS n, unnest(range(1, CAST(len(w) - least(13, len(w)) + 2 AS BIGINT))) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bw),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
ns AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, w, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, ns WHERE len(w) >= n),
hit AS (SELECT doc_id, i, dw.n, item FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM dw) dw JOIN win ON dw.n = win.n AND dw.k = win.k),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(CAST(i AS BIGINT), CAST(i + n AS BIGINT))) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
