"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a cap of ``max_epochs`` times its words.  A common level is raised until the
targets ``min(cap, weight * level)`` add up to the words wanted, which is the fixed point of clamping the
sources over their cap and sharing the excess among the others by weight.  Sorted by cap / weight, the
clamped sources are a prefix, so running sums over the table of sources give the level without iterating.

A target is met by whole repetitions of each document and one further, fractional repetition: documents in
the order of a seeded digest take one more copy up to the point at which the source's words are nearest the
target.  That point is found from sums by digest prefix; only the one prefix that holds it is looked into, by longer
prefixes first where it has very many documents.

Nulls: a null text has no words; a null source is a source of its own, last in order; a null ``doc_id``
digests as its own value.  Rows with the same ``doc_id`` in a source share a digest and are taken alike.
An empty table gives an empty result, and a source without words the target 0.  Texts are counted whole,
however long, and columns of any name are carried in ``doc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densika.llm.storage import scratch, store

GAPS = r"[\x20\x09-\x0D]+"
PREFIX = 3  # hex digits of the digest: 4096 sums a source, and as many within one of their buckets if it is large
LARGE = 1_000_000  # documents of a bucket that one task sorts


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")).cast("long")


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def digest(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """``(skey, source_size)`` to the same with ``target``; one row a source, so the windows are small.

    Sources take the weights in turn, by code point, the null source (key ``n``) last.
    """
    by_name = Window.orderBy((F.col("skey") == "n").asc(), F.col("skey").asc())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("cap", F.col("source_size") * max_epochs)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("skey"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.select(
        "*",
        F.row_number().over(by_cap).alias("rank"),
        ((F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)).alias("level"),
    )
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("rank", "level"))
    chosen = levels.withColumn("chosen", F.min(fits).over(whole))
    target = F.when(F.col("rank") < F.coalesce(F.col("chosen.rank"), F.col("rank") + 1), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("chosen.level"))
    return chosen.select("skey", "source_size", target.alias("target"))


def plan(meta: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """``(skey, key, size)`` of all documents to one row a source: ``skey, source_size, target, whole, cut``.

    A document takes ``whole`` copies, and one more if its digest is at most ``cut``.
    """
    bucket = F.substring("key", 1, PREFIX).alias("bucket")
    buckets = store(meta.groupBy("skey", bucket).agg(F.sum("size").alias("words"), F.count("*").alias("n")), "mix-buckets")
    targets = water_fill(buckets.groupBy("skey").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    epochs = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, epochs).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    level = targets.select("skey", "rest", F.lit(0).cast("long").alias("base"))
    first = store(targets.join(_cut(buckets, level), "skey", "left"), "mix-targets")
    cuts, digits, part = first.select("skey", F.col("full").alias("cut")), PREFIX, _part(first)
    if (first.agg(F.max("part.n")).first()[0] or 0) > LARGE:
        # The bucket that holds the cut is cut up the same way, so that no task sorts a share of a very large source.
        above = F.substring("key", 1, digits).alias("above")
        fine = meta.select("*", above).join(part, ["skey", "above"]).groupBy("skey", F.substring("key", 1, 2 * PREFIX).alias("bucket"))
        fine = fine.agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        second = store(part.select("skey", "rest").join(_cut(fine, part), "skey"), "mix-cut")
        cuts, digits, part = cuts.unionByName(second.select("skey", F.col("full").alias("cut"))), 2 * PREFIX, _part(second)
    inside = meta.select("*", F.substring("key", 1, digits).alias("above")).join(part, ["skey", "above"])
    inside = inside.groupBy("skey", "key").agg(F.sum("size").alias("size"), F.first("base").alias("base"), F.first("rest").alias("rest"))
    by_key = Window.partitionBy("skey").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.col("base") + F.sum("size").over(by_key))
    near = inside.where(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest")).groupBy("skey").agg(F.max("key").alias("cut"))
    cuts = cuts.unionByName(near).groupBy("skey").agg(F.max("cut").alias("cut"))
    # A source at its cap has no fractional repetition left, not even for documents without words.
    cut = F.when(F.col("whole") < max_epochs, F.coalesce("cut", F.lit(""))).otherwise(F.lit(""))
    return first.join(cuts, "skey", "left").select("skey", "source_size", "target", "whole", cut.alias("cut"))


def _cut(buckets: DataFrame, level: DataFrame) -> DataFrame:
    """``(skey, full, part)`` of ``(skey, bucket, words, n)`` and ``(skey, rest, base)``.

    ``full`` is just beyond the last bucket that ends under ``rest``, and ``part`` the one that holds it, with what is before it.
    """
    running = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = buckets.withColumn("upto", F.sum("words").over(running)).join(level.select("skey", "rest", "base"), "skey")  # one row a source
    upto = F.col("upto") + F.col("base")
    before = upto - F.col("words")
    under = F.max(F.when(upto <= F.col("rest"), F.concat("bucket", F.lit("g"))))
    holds = F.max(F.when((upto > F.col("rest")) & (before < F.col("rest")), F.struct("bucket", before.alias("base"), "n")))
    return summed.groupBy("skey").agg(under.alias("full"), holds.alias("part"))


def _part(cut: DataFrame) -> DataFrame:
    return cut.where("part is not null").select("skey", "rest", F.col("part.bucket").alias("above"), F.col("part.base").alias("base"))


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Columns ``doc`` (the whole row), ``size``, ``source_size``, ``target``, ``copies``.

    ``copies`` is how often the mix repeats the document, from 0 to ``max_epochs``.
    """
    sized = docs.select(
        F.struct("*").alias("doc"),
        n_words(docs["text"]).alias("size"),
        source_key(docs["source"]).alias("skey"),
        digest(docs["doc_id"], seed).alias("key"),
    )
    with scratch(docs.sparkSession):
        sources = store(plan(store(sized.select("skey", "key", "size"), "mix-meta"), weights, share, max_epochs), "mix-plan", keep=True)
    return _apply(sized, sources)


def _apply(sized: DataFrame, sources: DataFrame) -> DataFrame:
    copies = F.col("whole") + (F.col("key") <= F.col("cut")).cast("long")
    return sized.join(sources, "skey").select("doc", "size", "source_size", "target", copies.alias("copies"))


def op6(docs: DataFrame, seed: int = 17) -> DataFrame:
    meta = docs.select(
        F.struct("doc_id").alias("doc"),
        n_words(docs["text"]).alias("size"),
        source_key(docs["source"]).alias("skey"),
        digest(docs["doc_id"], seed).alias("key"),
    )
    with scratch(docs.sparkSession):
        meta = store(meta, "mix-meta", keep=True)
        sources = store(plan(meta.select("skey", "key", "size")), "mix-plan", keep=True)
    mixed = _apply(meta, sources)
    return mixed.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, 2 * source_size AS cap,
        [5, 2, 1][1 + (row_number() OVER (ORDER BY (skey = 'n'), skey) - 1) % 3] AS weight FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY cap / weight, skey) AS rank,
        (CAST(1.5 AS DOUBLE) * (SELECT CAST(sum(source_size) AS BIGINT) FROM s)
          - coalesce(CAST(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
        / CAST(sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM w),
c AS (SELECT min(rank) AS r, min_by(level, rank) AS lv FROM l WHERE level <= cap / weight),
t AS (SELECT skey, source_size, CASE WHEN rank < coalesce(r, rank + 1) THEN CAST(cap AS DOUBLE) ELSE weight * lv END AS target FROM l, c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS whole FROM t),
q AS (SELECT *, greatest(0.0, target - whole * source_size) AS rest FROM p),
k AS (SELECT skey, key, CAST(sum(size) AS BIGINT) AS ks FROM d GROUP BY skey, key),
u AS (SELECT k.skey, k.key, (2 * sum(ks) OVER (PARTITION BY k.skey ORDER BY k.key ROWS UNBOUNDED PRECEDING) - ks) <= 2 * rest AS extra
      FROM k JOIN q USING (skey))
SELECT d.doc_id, d.size, q.source_size, q.target, d.size * CAST(q.whole + CASE WHEN u.extra THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM d JOIN q USING (skey) JOIN u ON d.skey = u.skey AND d.key = u.key
"""
