"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

With features x, weights w and vectors v_f of rank ``RANK`` the score is the logistic of
``b + sum(w_i x_i) + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``; the pairwise part takes time
linear in the features by that identity.  Features are the distinct words of the text, hashed, with damped
counts; bins of structure statistics (kinds of characters, word and line lengths, repetition); and the bin
of the declared length, the one piece of metadata used.  Language, source, labels and ids are no features.

The model is fitted on the driver on at most ``sample`` labelled rows outside the held-out quarter, those
with the smallest hashes of ``doc_id``; of an id that repeats the smallest text counts, so that no more than
``sample`` rows reach the driver.  Every document is scored on its whole text where it lies.

Nulls: a null text is an empty one and gets a score too.  A null ``doc_id`` is never held out nor a label's.
Several labels of a document count as the smallest.  Without labels the score is 1.  Repeated rows score
alike, an empty table gives an empty result, and further columns, whatever their names, are carried in ``doc``.
Very long texts are read in pieces and scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densika.llm.wordbytes import PIECE, Words, pieces, ragged, tidy, words

BITS, RANK, BINS = 16, 8, 16
SIZE = 1 << BITS
SAMPLE = 8000
_KINDS = np.full(256, 9, np.uint8)
for _k, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), (32,), (10,), b".,;:'\"()-?", b"!$%#&*", b"|<>{}[]\\/", range(128, 256))):
    _KINDS[list(_set)] = _k


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def statistics(texts: pa.Array, w: Words, declared: np.ndarray) -> np.ndarray:
    """Structure statistics by text, each scaled to about 0..1."""
    n = len(texts)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    kinds = np.zeros(n * 10, np.int64)
    for lo in range(0, len(w.data), PIECE):
        part = w.data[lo : lo + PIECE]
        owner = np.searchsorted(ends, np.arange(lo, lo + len(part)), "right")
        kinds += np.bincount(owner * 10 + _KINDS[part], minlength=n * 10)
    share = kinds.reshape(n, 10) / np.maximum(sizes, 1)[:, None]
    count = w.count()
    safe = np.maximum(count, 1)
    length = np.zeros(len(w.start) + 1, np.int64)
    np.cumsum(w.end - w.start, out=length[1:])
    last = w.data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)

    def of(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return (sums[w.first[1:]] - sums[w.first[:-1]]) / safe

    hashes = w.hashes()
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    upper = _KINDS[w.data[w.start]] == 1 if len(w.start) else np.zeros(0, bool)
    mean = (length[w.first[1:]] - length[w.first[:-1]]) / safe
    columns = [
        *share.T, np.sqrt(share[:, 6]), of(again), of(upper), of(_KINDS[last] == 6), of(_KINDS[last] == 5), of((w.end - w.start) == 1),
        np.minimum(mean / 16, 1), np.log1p(count) / 12, np.minimum(share[:, 4] * 20, 1), np.log1p(np.maximum(declared, 0)) / 16,
    ]
    return np.stack(columns, 1)


N_STATS = 20
BIN_VALUE, WORD_NORM = 0.65, 0.5  # the value of a bin, the length of the vector of words


def features(texts: pa.Array, declared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices, values and the number of each text's features."""
    w = words(texts, lower=False)
    hashes, first = w.hashes(), w.first
    stats = statistics(texts, w, declared)
    index, value, counts = [], [], np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        own, n = np.unique(hashes[first[i] : first[i + 1]], return_counts=True)
        damped = np.log1p(n)
        total = max(1, int(n.sum()))
        repeated = [1 - len(own) / total, float(n.max()) / total if len(n) else 0.0]
        bins = np.minimum((np.append(stats[i], repeated) * BINS).astype(np.int64), BINS - 1)
        bins += np.arange(len(bins)) * BINS
        index.append(np.concatenate((bins, len(bins) * BINS + (own >> np.uint64(64 - BITS)).astype(np.int64))))
        value.append(np.concatenate((np.full(len(bins), BIN_VALUE), damped * (WORD_NORM / max(1e-9, np.sqrt((damped**2).sum()))))))
        counts[i] = len(index[-1])
    return np.concatenate(index).astype(np.int32), np.concatenate(value).astype(np.float32), counts


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, index: np.ndarray, value: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)  # every text has its statistics
        linear = np.add.reduceat(self.w[index] * value, at)
        scaled = self.v[index] * value[:, None]
        sums = np.add.reduceat(scaled, at, axis=0)
        squares = np.add.reduceat(scaled**2, at, axis=0)
        return self.bias + linear + 0.5 * (sums**2 - squares).sum(1)


def fit(index: np.ndarray, value: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.15, ridge: float = 1e-4, seed: int = 3) -> Machine:
    """Logistic loss by AdaGrad on shuffled batches; seeded, so that the same rows give the same model."""
    rng = np.random.default_rng(seed)
    size = (N_STATS + 2) * BINS + SIZE
    prior = (y.sum() + 1) / (len(y) + 1)
    m = Machine(float(np.log(prior / max(1e-6, 1 - prior))) if len(y) else 20.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32))
    if not len(y) or y.min() == y.max():
        m.v[:] = 0
        return m
    gw, gv = np.full(size, 1e-2, np.float32), np.full((size, RANK), 1e-2, np.float32)
    ends = np.cumsum(counts)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 64):
            rows = order[lo : lo + 64]
            n = counts[rows]
            take = np.repeat(ends[rows] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, x = index[take], value[take]
            at = np.cumsum(n) - n
            scaled = m.v[i] * x[:, None]
            sums = np.add.reduceat(scaled, at, axis=0)
            margin = m.bias + np.add.reduceat(m.w[i] * x, at) + 0.5 * (sums**2 - np.add.reduceat(scaled**2, at, axis=0)).sum(1)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]).astype(np.float32) / len(rows)
            each = np.repeat(slope, n) * x
            unique, inverse = np.unique(i, return_inverse=True)
            dw = np.bincount(inverse, each, len(unique)).astype(np.float32) + ridge * m.w[unique]
            by = each[:, None] * (np.repeat(sums, n, axis=0) - scaled)
            dv = np.stack([np.bincount(inverse, by[:, f], len(unique)) for f in range(RANK)], 1).astype(np.float32) + ridge * m.v[unique]
            gw[unique] += dw**2
            gv[unique] += dv**2
            m.w[unique] -= rate * dw / np.sqrt(gw[unique])
            m.v[unique] -= rate * 0.3 * dv / np.sqrt(gv[unique])
            m.bias -= rate * 0.3 * float(slope.sum())
    return m


def _declared(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(batch.column("n_chars").cast(pa.float64()), 0).to_numpy(zero_copy_only=False)


def _with_length(docs: DataFrame) -> Column:
    return F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.length("text").cast("long")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = usable.groupBy("doc_id").agg(F.min("quality").cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            index, value, counts = features(batch.column("text"), _declared(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), ragged(index, counts, pa.int32()), ragged(value, counts, pa.float32())], ["doc_id", "y", "index", "value"])

    rows = docs.select("doc_id", "text", _with_length(docs).alias("n_chars")).join(F.broadcast(marked), "doc_id")  # at most ``sample`` ids
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct("text", "n_chars")).alias("row")).select("doc_id", "y", "row.*")
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(tidy(run), f"doc_id {kind}, y double, index array<int>, value array<float>").toArrow().combine_chunks()
    got = got.sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(0))
    index = got.column("index").chunk(0)
    counts = np.diff(np.asarray(index.offsets)).astype(np.int64)
    return fit(np.asarray(index.flatten()), np.asarray(got.column("value").chunk(0).flatten()), counts, np.asarray(got.column("y")))


def score(docs: DataFrame, machine: Machine, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of every row, with ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text_"):
            index, value, counts = features(batch.column("text_"), _declared(batch))
            got = 1 / (1 + np.exp(-np.clip(machine.margins(index, value, counts).astype(np.float64), -30, 30)))
            kept = [batch.column("text_" if c == "text" else f"c{k}") for k, c in enumerate(carry)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(got)], [*(f"c{k}" for k in range(len(carry))), "score"])

    kinds = [docs.schema[c].dataType.simpleString() for c in carry]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry) if c != "text"], F.col("text").alias("text_"), _with_length(docs).alias("n_chars"))
    out = rows.mapInArrow(tidy(run), ", ".join([*(f"c{k} {kind}" for k, kind in enumerate(kinds)), "score double"]))
    return out.select(F.struct(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)]).alias("doc"), "score")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, carry: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """``doc`` (the columns ``carry``, by default all), ``held_out``, ``score``, ``predicted``."""
    scored = score(docs, train(docs, labels, sample), carry or docs.columns)
    return scored.select("doc", held_out(F.col("doc.doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels, carry=["doc_id"]).select("doc.doc_id", "held_out", "score", "predicted")
