"""Language of texts by error-correcting output codes.

Every language has a codeword of bits, and for each bit a binary classifier on byte n-grams tells the languages
with a 1 from those with a 0.  Up to five languages get the exhaustive code, one bit for each way to part them;
more get the best of many random codes of ``10 log2`` bits, by the smallest distance of two codewords.  A text's
margins are decoded by weighted loss: the logistic loss of each bit against a codeword counts by how often that
bit's classifier was right on that language in folds that it was not fitted on, and the language of the smallest
total is the nearest codeword.  ``score`` is its share of ``exp(-loss)``; where the second one has a quarter of the
first one's or more, the text is ``ambiguous``.  Wrong bits are thus outvoted by the others.

n-grams are of one to four bytes of words (letters, digits and non-ASCII bytes, A-Z lower-cased) with a space at
either end, hashed to 16 bits; a feature is the root of an n-gram's share of the text's.  Those whose shares differ
most between the languages are used.  Each fit is a ridge-penalised logistic regression of all bits at once, by
steps with the fixed bound of the curvature, which is factored once.

The model is fitted on the driver on at most ``sample`` documents with a language, shared among the ``LANGUAGES``
commonest of them, those with the smallest hashes of ``doc_id``; held-out rows are never among them.  Every document
is scored on its whole text where it lies.

Nulls: a text that is null or has no letter is ``und`` with score 0 and ambiguous, as is all where no language
is learned; with one learned it is always that one.  A null ``doc_id`` is neither held out nor learned from; of an
id that repeats the row of the smallest language and text counts.  Repeated rows score alike, an empty table gives
an empty result, and further columns, whatever their names, are carried in ``doc`` if they are named.  Very long
texts are read in pieces and scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densika.llm.substrings import _joined
from densika.llm.wordbytes import PIECE, finish, letters, pieces, ragged, tidy

SAMPLE, LANGUAGES = 4000, 256
BITS, GRAMS, FEATURES, FOLDS = 16, 4, 256, 3
RIDGE, STEPS, SCALE = 0.02, 60, 8.0
AMBIGUOUS = 0.25  # of the best language's probability
UNKNOWN = "und"
EXHAUSTIVE = 5  # languages up to which all partitions are bits
_TAGS = np.arange(GRAMS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # tell lengths of n-grams apart


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text and slot of all n-grams, some at a time.  None spans two words, so it doesn't matter how they are parted."""
    w = letters(texts)
    owner = np.repeat(np.arange(len(texts)), w.count())
    lo = 0
    while lo < len(owner):
        hi = max(lo + 1, int(np.searchsorted(w.end, w.start[lo] + PIECE, "right")))
        text = np.concatenate((np.full(1, 32, np.uint8), _joined(w.data, w.start[lo:hi], w.end[lo:hi])))
        mine, space = np.repeat(owner[lo:hi], w.end[lo:hi] - w.start[lo:hi] + 1), text == 32
        packed = np.zeros(len(mine), np.uint64)
        inner = np.ones(len(mine), bool)  # no space but at the ends
        for k in range(1, GRAMS + 1):
            n = len(text) - k + 1 if k > 1 else len(mine)
            packed = (packed[:n] << np.uint64(8)) | text[k - 1 : k - 1 + n]
            if k > 2:
                inner = inner[:n] & ~space[k - 2 : k - 2 + n]
            use = np.flatnonzero(inner[:n] if k > 1 else ~space[:n])
            yield mine[use], (finish(packed[use] + _TAGS[k]) >> np.uint64(64 - BITS)).astype(np.int64)
        lo = hi


def codewords(n: int, seed: int = 12) -> np.ndarray:
    """-1 and 1, a row a language and a column a bit; no bit is constant."""
    if n < 2:
        return np.zeros((n, 0), np.int64)
    if n <= EXHAUSTIVE:
        every = [(1, *rest) for rest in product((1, -1), repeat=n - 1)]
        return np.array([c for c in every if min(c) < 0]).T
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    tries = (rng.choice((-1, 1), (n, width)) for _ in range(200))
    return max((code[:, np.abs(code.sum(0)) < n] for code in tries), key=distance)


def distance(code: np.ndarray) -> int:
    """In how many bits the nearest two codewords differ."""
    apart = (code.shape[1] - code @ code.T) // 2
    np.fill_diagonal(apart, code.shape[1])
    return int(apart.min(initial=code.shape[1]))


def fit_bits(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights, a column for each column of ``y``, of logistic regressions; the last weight is the constant's."""
    x = np.concatenate((x, np.ones((len(x), 1))), 1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    step = np.linalg.inv(x.T @ x / 4 + np.diag(penalty))
    weights = np.zeros((x.shape[1], y.shape[1]))
    for _ in range(steps):
        slope = x.T @ (y / (1 + np.exp(np.clip(y * (x @ weights), -30, 30)))) - penalty[:, None] * weights
        weights += step @ slope
    return weights


def losses(margins: np.ndarray, code: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each text and language the weighted logistic loss of all bits."""
    right, wrong = np.logaddexp(0, -margins), np.logaddexp(0, margins)
    return right @ (weights * (code > 0)).T + wrong @ (weights * (code < 0)).T


@dataclass
class Decoder:
    languages: list[str] = field(default_factory=list)
    code: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    trust: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # of languages in bits
    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted, of the features
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))

    def margins(self, texts: pa.Array) -> np.ndarray:
        n, width = len(texts), len(self.slots)
        lookup = np.full(1 << BITS, -1, np.int64)
        lookup[self.slots] = np.arange(width)
        total, counts = np.zeros(n, np.int64), np.zeros(n * width, np.int64)
        for owner, slot in grams(texts):
            total += np.bincount(owner, minlength=n)
            known = lookup[slot]
            hit = known >= 0
            counts += np.bincount(owner[hit] * width + known[hit], minlength=n * width)
        x = np.sqrt(counts.reshape(n, width) / np.maximum(total, 1)[:, None]) * SCALE
        return x @ self.weights[:-1] + self.weights[-1]

    def decode(self, margins: np.ndarray, ratio: float = AMBIGUOUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword, the score, and whether another one is near."""
        loss = losses(margins, self.code, self.trust) / max(1, distance(self.code))
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        ordered = np.sort(share, axis=1)
        second = ordered[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
        return share.argmax(1), share.max(1), second >= ratio * ordered[:, -1]


def fit(ids: np.ndarray, langs: Sequence[str], slots: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> Decoder:
    """``slots`` and their ``counts`` of all texts, ``sizes`` of each."""
    languages = sorted(set(langs))  # by code point
    if not languages:
        return Decoder()
    label = np.array([languages.index(one) for one in langs])
    code = codewords(len(languages))
    if len(languages) == 1:
        return Decoder(languages, code, np.zeros((1, 0)))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.maximum(np.bincount(owner, counts, len(sizes)), 1)
    root = np.sqrt(counts / total[owner])
    members = np.bincount(label, minlength=len(languages))
    by_class = np.zeros((len(languages), 1 << BITS))
    np.add.at(by_class, (label[owner], slots), root)
    squares = np.bincount(slots, root**2, 1 << BITS)
    mean = by_class.sum(0) / len(label)
    between = (by_class**2 / members[:, None]).sum(0) - len(label) * mean**2
    within = squares - (by_class**2 / members[:, None]).sum(0)
    # What differs by much in all, and not by chance in a few texts.
    worth = between / (within / max(1, len(label) - len(languages)) + 1e-6)
    chosen = np.sort(np.lexsort((np.arange(1 << BITS), -worth))[:FEATURES])
    chosen = chosen[mean[chosen] > 0]
    at = np.minimum(np.searchsorted(chosen, slots), len(chosen) - 1)
    hit = chosen[at] == slots
    x = np.zeros((len(label), len(chosen)))
    x[owner[hit], at[hit]] = root[hit] * SCALE
    y = code[label]
    fold = (finish(ids.astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(int)
    right, seen = np.zeros(code.shape), np.zeros(len(languages))
    for k in range(FOLDS):
        rest, test = fold != k, fold == k
        if not rest.any() or not test.any():
            continue
        weights = fit_bits(x[rest], y[rest])
        good = (x[test] @ weights[:-1] + weights[-1]) * y[test] > 0
        np.add.at(right, label[test], good)
        seen += np.bincount(label[test], minlength=len(languages))
    trust = (right + 1) / (seen[:, None] + 2)
    trust *= code.shape[1] / trust.sum(1, keepdims=True)  # each language's bits weigh alike in all
    return Decoder(languages, code, trust, chosen, fit_bits(x, y))


def _usable(docs: DataFrame) -> DataFrame:
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & _lettered(F.col("text")))
    return rows.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")


def _lettered(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Decoder:
    usable = _usable(docs)
    known = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()
    if not known:
        return Decoder()
    quota = max(1, sample // len(known))
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, quota / r.n)) for r in known], "lang string, share double")
    turn = F.xxhash64("doc_id")
    drawn = usable.select("doc_id", "lang").join(F.broadcast(share), "lang")  # at most LANGUAGES rows
    drawn = drawn.where(F.shiftrightunsigned(turn, 11) * 2.0**-53 <= F.col("share")).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    drawn = drawn.orderBy(turn, "doc_id").limit(sample)
    rows = usable.join(F.broadcast(drawn), ["doc_id", "lang"])  # at most ``sample`` ids
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            keys = np.concatenate([np.zeros(0, np.int64), *((owner << BITS) | slot for owner, slot in grams(batch.column("text")))])
            key, n = np.unique(keys, return_counts=True)
            sizes = np.bincount(key >> BITS, minlength=batch.num_rows)
            slots = ragged((key & ((1 << BITS) - 1)).astype(np.int32), sizes, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), slots, ragged(n.astype(np.int32), sizes, pa.int32())], ["doc_id", "lang", "slots", "counts"])

    got = rows.mapInArrow(tidy(run), "doc_id long, lang string, slots array<int>, counts array<int>").toArrow().combine_chunks().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return Decoder()
    slots = got.column("slots").chunk(0)
    sizes = np.diff(np.asarray(slots.offsets)).astype(np.int64)
    flat = [np.asarray(got.column(c).chunk(0).flatten()).astype(np.int64) for c in ("slots", "counts")]
    return fit(np.asarray(got.column("doc_id")), got.column("lang").to_pylist(), *flat, sizes)


def identify(docs: DataFrame, decoder: Decoder, carry: Sequence[str] = ("doc_id",), ratio: float = AMBIGUOUS) -> DataFrame:
    """``doc`` (the columns ``carry``), ``lang_pred``, ``score``, ``ambiguous``."""
    names = [f"c{k}" for k in range(len(carry))]
    languages = pa.array(decoder.languages, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in pieces(batches, "text_"):
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                open_ = batch.column("lettered").to_numpy(zero_copy_only=False) & bool(decoder.languages)
                best, score, near = np.zeros(len(open_), np.int64), np.zeros(len(open_)), np.ones(len(open_), bool)
                if open_.any():
                    best[open_], score[open_], near[open_] = decoder.decode(decoder.margins(batch.column("text_").filter(pa.array(open_))), ratio)
                named = languages.take(pa.array(best, mask=~open_)).fill_null(UNKNOWN)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), named, pa.array(score), pa.array(near)], [*names, "lang_pred", "score", "ambiguous"])

    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(carry, names, strict=True)], F.col("text").alias("text_"), _lettered(F.col("text")).alias("lettered"))
    kinds = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(carry, names, strict=True))
    found = rows.mapInArrow(tidy(run), f"{kinds}, lang_pred string, score double, ambiguous boolean")
    return found.select(F.struct(*[F.col(k).alias(c) for c, k in zip(carry, names, strict=True)]).alias("doc"), "lang_pred", "score", "ambiguous")


def op12(docs: DataFrame) -> DataFrame:
    found = identify(docs, train(docs))
    return found.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
