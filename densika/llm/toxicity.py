"""Toxicity by a classifier chain of linear models.

The chain predicts ``severe``, ``dense`` and ``toxic`` in turn; each model sees the document's words and the
probabilities of the categories before it.  For training these are out-of-fold predictions, so a model learns
from earlier probabilities as uncertain as those it will get.  The last category is the label itself.  The
tables label no other, so the first two are degrees of it that are taken from the data, whatever its language.
Terms that mark toxic documents are found by their z-scores; toxic documents whose commonest mark is the same
are compared, so that languages aren't: a severe one holds as many marks as the median one of them or more, and
in a dense one they are as large a share of its terms.

Terms are runs of letters, digits and non-ASCII bytes, A-Z lower-cased, and their pieces of five bytes, which
catch stems under any ending; both as hashes.  A model keeps the terms whose presence differs most between
its classes, by a z-score of the shares, and fits a ridge-penalised logistic regression by Newton steps.  It is
fitted on the driver on at most ``sample`` labelled documents, those with the smallest hashes of ``doc_id``; of an
id that repeats the smallest text counts, so that no more than ``sample`` rows reach the driver.  Every document is
scored on its whole text.

Nulls: a null text has no terms and gets the base rates; labels that are null do not count, and several of
one document count as the largest.  Without labels all probabilities are 0.  Repeated rows score alike, an
empty table gives an empty result, and further columns, whatever their names, are ignored.  Very long texts are
read in pieces and scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densika.llm.wordbytes import PIECE, Words, finish, letters, pieces, ragged, tidy

SAMPLE, FOLDS, FEATURES, GRAM = 4000, 5, 400, 5
CATEGORIES = ("severe", "dense", "toxic")
MARKED = 5  # standard errors from which on a term marks a class


def _grams(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the pieces of words, and the word of each; a part of the words at a time."""
    lo = 0
    while lo < len(w.start):
        hi = max(lo + 1, int(np.searchsorted(w.end, w.start[lo] + PIECE, "right")))
        data = w.data[w.start[lo] : w.end[hi - 1]].astype(np.uint64)
        n = np.maximum(w.end[lo:hi] - w.start[lo:hi] - GRAM + 1, 0)
        at = np.repeat(w.start[lo:hi] - w.start[lo] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        packed = np.zeros(len(at), np.uint64)
        for k in range(GRAM):
            packed = (packed << np.uint64(8)) | data[at + k]
        yield finish(packed), np.repeat(np.arange(lo, hi), n)
        lo = hi


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each text, sorted, and their number by text."""
    w = letters(texts)
    whole = w.hashes()
    parts = list(_grams(w))
    grams = np.concatenate([g for g, _ in parts]) if parts else np.zeros(0, np.uint64)
    at = np.searchsorted(np.concatenate([o for _, o in parts]) if parts else np.zeros(0, np.int64), w.first)
    own = [np.unique(np.concatenate((whole[a:b], grams[c:d]))) for a, b, c, d in zip(w.first[:-1], w.first[1:], at[:-1], at[1:], strict=True)]
    return (np.concatenate(own) if own else np.zeros(0, np.uint64)), np.array([len(x) for x in own], np.int64)


def known_terms(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of the texts that are among the sorted ``known``, and the text of each; repeats stay."""
    w = letters(texts)
    owner = np.repeat(np.arange(len(texts)), w.count())
    sieve = np.zeros(1 << 16, bool)
    sieve[(known >> np.uint64(48)).astype(np.int64)] = True
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for hashes, word in [(w.hashes(), np.arange(len(owner))), *_grams(w)]:
        near = np.flatnonzero(sieve[(hashes >> np.uint64(48)).astype(np.int64)])
        hashes, word = hashes[near], word[near]
        hit = np.isin(hashes, known)
        out.append((hashes[hit], owner[word[hit]]))
    return np.concatenate([h for h, _ in out]), np.concatenate([o for _, o in out])


@dataclass
class Linear:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray  # of the words, the earlier probabilities and the constant

    def probability(self, hashes: np.ndarray, owner: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        x = np.concatenate((_presence(self.words, hashes, owner, len(earlier)), earlier, np.ones((len(earlier), 1))), 1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


@dataclass
class Chain:
    models: list[Linear] = field(default_factory=list)
    threshold: float = 0.5

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        if not self.models:
            return np.zeros((len(texts), len(CATEGORIES)))
        hashes, owner = known_terms(texts, np.unique(np.concatenate([m.words for m in self.models])))
        out = np.zeros((len(texts), 0))
        for model in self.models:
            out = np.concatenate((out, model.probability(hashes, owner, out)[:, None]), 1)
        return out


def _presence(known: np.ndarray, hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, len(known)))
    if len(known) and len(hashes):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = known[at] == hashes
        out[owner[hit], at[hit]] = 1
    return out


def _shares(hashes: np.ndarray, owner: np.ndarray, y: np.ndarray, n1: float, n0: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms and the z-score of the difference of their shares in the two classes."""
    word, code = np.unique(hashes, return_inverse=True)
    positive = y[owner] > 0
    a, b = np.bincount(code[positive], minlength=len(word)), np.bincount(code[~positive], minlength=len(word))
    pooled = (a + b + 1) / (n1 + n0 + 2)
    return word, (a / n1 - b / n0) / np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))


def _leading(word: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The terms with the largest scores, ``FEATURES`` at most, sorted."""
    return np.sort(word[np.lexsort((word, -z))[:FEATURES]][: int((z > MARKED).sum())])


def degrees(hashes: np.ndarray, sizes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Labels of the categories before the last."""
    n1 = toxic.sum()
    if not n1:
        return np.zeros((len(sizes), 2))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    marks = _leading(*_shares(hashes, owner, toxic, n1, max(1.0, len(toxic) - n1)))
    use = np.isin(hashes, marks) & (toxic[owner] > 0)
    at, owner = np.searchsorted(marks, hashes[use]), owner[use]
    common = np.lexsort((at, -np.bincount(at, minlength=len(marks))[at], owner))
    leads = common[np.diff(owner[common], prepend=-1) != 0]  # of each document its commonest mark
    docs, lead = owner[leads], at[leads]
    held = np.bincount(owner, minlength=len(sizes))[docs]
    out = np.zeros((len(sizes), 2))
    for k in np.unique(lead):
        same = lead == k
        for c, x in enumerate((held, held / sizes[docs])):
            out[docs[same], c] = x[same] >= np.median(x[same])
    return out


def _fit(hashes: np.ndarray, owner: np.ndarray, rows: np.ndarray, earlier: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> Linear:
    """A model from the documents ``rows``; the other arguments are those of all documents."""
    member = np.zeros(len(y), bool)
    member[rows] = True
    use = member[owner]
    n1 = y[rows].sum()
    word, z = _shares(hashes[use], owner[use], y, max(1.0, n1), max(1.0, len(rows) - n1))
    chosen = _leading(word, np.abs(z))
    local = np.cumsum(member) - 1
    x = _presence(chosen, hashes[use], local[owner[use]], len(rows))
    x = np.concatenate((x, earlier[member], np.ones((len(rows), 1))), 1)
    target, weights = y[member], np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - target) + penalty * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(curve, slope)
        weights -= move
        if np.abs(move).max() < 1e-6:
            break
    return Linear(chosen, weights)


def fit_chain(ids: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> Chain:
    """``labels`` has a column for each category.  Folds follow from the hash of the document's number."""
    if not len(sizes):
        return Chain()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    fold = (finish(ids.astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(int)
    earlier, chain = np.zeros((len(sizes), 0)), Chain()
    for c in range(labels.shape[1]):
        y = labels[:, c]
        out = np.zeros(len(y))
        for k in range(FOLDS):
            test = np.flatnonzero(fold == k)
            rows = np.flatnonzero(fold != k)
            if not len(test) or not len(rows):
                continue
            model = _fit(hashes, owner, rows, earlier, y)
            use = (fold == k)[owner]
            local = np.cumsum(fold == k) - 1
            out[test] = model.probability(hashes[use], local[owner[use]], earlier[test])
        chain.models.append(_fit(hashes, owner, np.arange(len(y)), earlier, y))
        earlier = np.concatenate((earlier, out[:, None]), 1)
    chain.threshold = _best_threshold(earlier[:, -1], labels[:, -1])
    return chain


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where the F1 of out-of-fold probabilities is largest: between the last one taken and the next."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    if not len(y) or not hits[-1]:
        return 0.5
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + hits[-1])
    f1[:-1][p[order][1:] == p[order][:-1]] = 0  # ties are taken together
    at = int(np.argmax(f1))
    return float(np.sqrt(p[order][at] * (p[order][at + 1] if at + 1 < len(y) else p[order][at])))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marked = usable.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashes, sizes = terms(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("y"), ragged(hashes.view(np.int64), sizes, pa.int64())], ["doc_id", "y", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marked), "doc_id")  # at most ``sample`` ids
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(tidy(run), "doc_id long, y double, words array<long>").toArrow().combine_chunks()
    got = got.sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return Chain()
    column = got.column("words").chunk(0)
    sizes = np.diff(np.asarray(column.offsets)).astype(np.int64)
    hashes = np.asarray(column.flatten()).view(np.uint64)
    toxic = np.asarray(got.column("y"))
    return fit_chain(np.asarray(got.column("doc_id")), hashes, sizes, np.concatenate((degrees(hashes, sizes, toxic), toxic[:, None]), 1))


def classify(docs: DataFrame, labels: DataFrame, threshold: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, a probability ``p_*`` for each category, and ``toxic``.

    By default the threshold is that with the best F1 on the training rows' out-of-fold probabilities.
    """
    chain = train(docs, labels, sample)
    threshold = chain.threshold if threshold is None else threshold
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            got = chain.probabilities(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(got[:, c]) for c in range(len(names)))], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(tidy(run), ", ".join([f"doc_id {kind}", *(f"{n} double" for n in names)]))
    return scored.withColumn("toxic", (F.col("p_toxic") >= threshold).cast("int"))


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
