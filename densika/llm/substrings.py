"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the corpus itself, cut into blocks by content.  The smallest hash of ten consecutive words
among those of a 50-word window is its anchor; the words of all windows with one anchor, 50 to 90 of them,
are a block, and every distinct block is indexed under its anchor with the document that has it first.
Equal windows have equal anchors wherever they stand, so a window can only occur again in blocks of its
anchor, and each document is factored against every block that could hold one of its windows.

Parsing is greedy: matches start at windows that an earlier document holds, refer to the place of their first
occurrence, and go on along that document for as long as the text has its words, past blocks that still smaller
documents hold.  Of the matches at a place the one that reaches furthest is the factor; where it ends the next takes
over, without words taken twice.  A block that an earlier document holds is taken whole.  Where an anchor has several blocks a factor may end inside one; these boundaries are checked
window by window on 128-bit hashes of their words, against the blocks' first occurrences, which hold every
smallest document.  Factors are thus exactly the unions of windows whose words also start in a smaller document.

Work grows with the words: one index row for about 21 words, window rows at factor boundaries only, and
copies meet in minima that are taken before they are shuffled.

Nulls: a null text has no words; a null ``doc_id`` neither removes nor loses words.  Rows that share a
``doc_id`` are no source for each other.  Texts under 50 words are kept whole.  An empty table gives an
empty result, and further columns, whatever their names, are ignored.  Very long texts are read in pieces and
parsed whole.  Of several places in the first document that hold a window a factor refers to any one.  A stretch of
more than a window's words that all have their first place in a still smaller document is a factor of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densika.llm.storage import scratch, store
from densika.llm.wordbytes import finish, pieces, run_hashes, tidy, words

GRAM = 10  # words of an anchor


def blocks_of(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Owner, first and last window start (within the text), anchor and block hash of every block."""
    span = window - GRAM + 1
    n = len(hashes)
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    at = np.arange(n - GRAM + 1)
    grams = run_hashes(hashes, 1)(at, at + GRAM)
    bits = np.uint64((1 << int(n).bit_length()) - 1)
    least, have = (grams & ~bits) | at.astype(np.uint64), 1
    while 2 * have <= span:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    if have < span:
        least = np.minimum(least[: have - span], least[span - have :])
    counts = np.diff(first)
    ends = np.repeat(first[1:], counts)
    start = np.flatnonzero(np.arange(n - window + 1) + window <= ends[: n - window + 1])
    anchor = (least[start] & bits).astype(np.int64)
    opens = np.flatnonzero(np.diff(anchor, prepend=-1))
    closes = np.append(opens[1:], len(anchor)) - 1
    if not len(anchor):
        closes = opens
    lo, hi, anchor = start[opens], start[closes], anchor[opens]
    owner = np.repeat(np.arange(len(counts)), counts)[lo]
    content = finish(run_hashes(hashes, 0)(lo, hi + window) ^ ((anchor - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return owner, lo - first[owner], hi - first[owner], grams[anchor], content


def index_rows(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            w = words(batch.column("text"))
            owner, lo, hi, anchor, content = blocks_of(w.hashes(), w.first, window)
            taken = batch.select(["doc", "mark"]).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([
                *taken.columns, pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
                pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)),
            ], ["doc", "mark", "lo", "hi", "anchor", "block"])

    return docs.where("doc is not null").mapInArrow(tidy(run), "doc long, mark long, lo int, hi int, anchor long, block long")


def _boundary_windows(rows: DataFrame, window: int) -> DataFrame:
    """``(doc, mark, text, ranges)`` to the two hashes of each window whose start is in a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            w = words(batch.column("text"))
            hashes = w.hashes()
            ranges = batch.column("ranges")
            counts = np.diff(np.asarray(ranges.offsets))
            flat = ranges.flatten()
            lo, hi = np.asarray(flat.field("lo")).astype(np.int64), np.asarray(flat.field("hi")).astype(np.int64)
            owner = np.repeat(np.arange(len(counts)), counts)
            n = hi - lo + 1
            start = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            owner = np.repeat(owner, n)
            at = start + w.first[owner]
            a, b = (run_hashes(hashes, k)(at, at + window).view(np.int64) for k in (0, 1))
            taken = batch.select(["doc", "mark"]).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(start.astype(np.int32)), pa.array(a), pa.array(b)], ["doc", "mark", "lo", "a", "b"])

    return rows.mapInArrow(tidy(run), "doc long, mark long, lo int, a long, b long")


def duplicate_ranges(docs: DataFrame, window: int) -> DataFrame:
    """``(doc, mark, lo, hi, source, at)``: starts of windows whose words also start in a smaller document, at ``at``."""
    with scratch(docs.sparkSession):
        return _duplicate_ranges(docs, window)


def _duplicate_ranges(docs: DataFrame, window: int) -> DataFrame:
    index = index_rows(docs, window)
    met = index.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("z"), (F.min("block") != F.max("block")).alias("mixed"))
    # Minima are stored before they are joined: both sides of each join then come straight from a shuffle,
    # and adaptive execution splits a hot anchor or block.
    met = store(met.where("a < z").select("anchor", "mixed"), "shared-anchors")
    shared = store(index.join(met, "anchor"), "shared-blocks")
    heads = store(shared.groupBy("anchor", "block").agg(F.min("doc").alias("head"), F.min_by("lo", "doc").alias("at")), "heads")
    owned = shared.join(heads, ["anchor", "block"])
    out = ["doc", "mark", "lo", "hi", F.col("head").alias("source"), "at"]
    whole = store(owned.where("doc > head").select(out), "whole-blocks")
    cut = owned.where("mixed and doc = head").groupBy("doc", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    near = store(_boundary_windows(docs.join(cut, ["doc", "mark"]).select("doc", "mark", "text", "ranges"), window), "boundary-windows")
    least = near.groupBy("a", "b").agg(F.min("doc").alias("head"), F.max("doc").alias("last"), F.min_by("lo", "doc").alias("at")).where("head < last")
    least = store(least.select("a", "b", "head", "at"), "window-heads")
    edges = near.join(least, ["a", "b"]).where("doc > head").withColumn("hi", F.col("lo")).select(out)
    return store(whole.unionByName(edges), "duplicate-windows", keep=True)


def factors(ranges: dict[str, np.ndarray], window: int) -> dict[str, np.ndarray]:
    """Greedy factors of a text with these ranges of duplicate window starts: words ``lo`` to ``hi`` are those of ``source`` from ``at`` on.

    Ranges of one source at one distance from the text are one match where their windows overlap or touch, whatever other
    source holds a block between them: each word between is in a window of either side.  From the first word not yet
    covered on, the match that reaches furthest is the next factor.
    """
    order = np.lexsort((-ranges["hi"], ranges["lo"]))
    order = order[np.diff(ranges["lo"][order], prepend=-1) != 0]  # repeated rows have repeated ranges
    lo, until, source, at = ranges["lo"][order], ranges["hi"][order] + window, ranges["source"][order], ranges["at"][order]
    shift = at - lo
    by = np.lexsort((lo, shift, source))
    lo, until, source, shift = lo[by], until[by], source[by], shift[by]
    same = (source[1:] == source[:-1]) & (shift[1:] == shift[:-1])
    # Within a source and distance the ends rise with the starts, as ranges don't hold each other.
    opens = np.flatnonzero(np.append(True, ~(same & (lo[1:] <= until[:-1])))) if len(lo) else np.zeros(0, np.int64)
    first, last = lo[opens], until[np.append(opens[1:], len(lo)) - 1] if len(lo) else lo
    source, shift = source[opens], shift[opens]
    by = np.lexsort((-last, first))
    first, last, source, shift = first[by], last[by], source[by], shift[by]
    out: list[tuple[int, int, int, int]] = []
    covered, k = 0, 0
    while k < len(first):
        covered = max(covered, int(first[k]))
        best, reach = -1, covered
        while k < len(first) and first[k] <= covered:
            if last[k] > reach:
                best, reach = k, int(last[k])
            k += 1
        if best >= 0:
            out.append((covered, reach, int(source[best]), covered + int(shift[best])))
            covered = reach
    table = np.array(out, np.int64).reshape(-1, 4)
    return dict(zip(("lo", "hi", "source", "at"), table.T, strict=True))


FACTOR = {"lo": pa.int32(), "hi": pa.int32(), "source": pa.int64(), "at": pa.int32()}
FACTORS = "array<struct<lo:int,hi:int,source:bigint,at:int>>"


def parsed(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """``doc, n_words, n_removed, kept_sha256`` and, if asked for, ``kept`` (the text) and ``factors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            w = words(batch.column("text"))
            count = w.count()
            ranges = batch.column("ranges")
            offsets, flat = np.asarray(ranges.offsets), ranges.values
            every = {c: np.asarray(flat.field(c)).astype(np.int64) for c in FACTOR}
            gone = np.zeros(len(w.start) + 1, np.int64)
            spans = []
            for i in np.flatnonzero(np.diff(offsets)):
                found = factors({c: x[offsets[i] : offsets[i + 1]] for c, x in every.items()}, window)
                np.add.at(gone, w.first[i] + found["lo"], 1)
                np.add.at(gone, w.first[i] + found["hi"], -1)
                spans.append((i, found))
            keep = np.cumsum(gone)[:-1] == 0
            kept = np.concatenate(([0], np.cumsum(keep)))
            n_kept = kept[w.first[1:]] - kept[w.first[:-1]]
            out, digests = [], []
            joined = _joined(w.data, w.start[keep], w.end[keep])
            sizes = np.concatenate(([0], np.cumsum((w.end - w.start + 1)[keep])))
            upto = sizes[np.concatenate(([0], np.cumsum(n_kept)))]
            view = memoryview(joined)
            for i in range(len(count)):
                text = view[upto[i] : max(upto[i], upto[i + 1] - 1)]
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    out.append(bytes(text).decode("utf-8", "replace"))
            columns = [batch.column("doc"), pa.array(count.astype(np.int64)), pa.array((count - n_kept).astype(np.int64)), pa.array(digests, pa.string())]
            names = ["doc", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                lists: list[list[dict]] = [[] for _ in count]
                for i, found in spans:
                    lists[i] = [dict(zip(FACTOR, map(int, x), strict=True)) for x in zip(*found.values(), strict=True)]
                columns += [pa.array(out, pa.string()), pa.array(lists, pa.list_(pa.struct(FACTOR.items())))]
                names += ["kept", "factors"]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = f", kept string, factors {FACTORS}" if with_text else ""
    return docs.mapInArrow(tidy(run), "doc long, n_words long, n_removed long, kept_sha256 string" + more)


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The words, each followed by a space."""
    size = end - start + 1
    total = int(size.sum())
    take = np.ones(total, np.int64)
    first = np.cumsum(size) - size
    if total:
        take[0] = start[0]
        take[first[1:]] = start[1:] - end[:-1]
        take = np.cumsum(take)
        take[first + size - 1] = 0
    out = data[take] if total else np.zeros(0, np.uint8)
    out[first + size - 1] = 32
    return out


def remove_duplicates(docs: DataFrame, window: int = 50, with_text: bool = True) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("mark"), "text")
    ranges = duplicate_ranges(rows, window).groupBy("doc", "mark").agg(F.collect_list(F.struct(*FACTOR)).alias("ranges"))
    empty = F.array().cast(FACTORS)
    joined = rows.join(ranges, ["doc", "mark"], "left").select("doc", "text", F.coalesce("ranges", empty).alias("ranges"))
    return parsed(joined, window, with_text).withColumnRenamed("doc", "doc_id")


def op3(docs: DataFrame) -> DataFrame:
    return remove_duplicates(docs, 50, with_text=False)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, CAST(len(w) - 48 AS BIGINT))) AS i, w FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS m FROM k GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(CAST(i AS BIGINT), CAST(i + 50 AS BIGINT))) AS pos FROM k JOIN f USING (h) WHERE doc_id > m),
a AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id),
r AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN a USING (doc_id)),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS pos FROM d),
s AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.pos) AS kept FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.pos = g.pos WHERE g.pos IS NULL GROUP BY u.doc_id)
SELECT r.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM r LEFT JOIN s USING (doc_id)
"""
