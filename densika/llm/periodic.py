"""Periodic runs of words by the linear tandem-repeat method.

A run is a longest stretch of words that are equal ``period`` words apart, with no smaller such period, of
``min_exponent`` periods and ``min_length`` words at least.  The words of a batch of documents become one string
of symbols, whose suffix tree is held as a suffix array with the common prefixes of neighbours: a place in the
tree, node or not, is an interval of the array with a depth.  Then, as in the method's three phases:

1. Lempel-Ziv blocks.  The leftmost square of each kind crosses a border of blocks, so common extensions to both
   sides of each border, one for each possible period, give pairs (start, period) that cover all leftmost squares.
2. Suffix-link walks.  The place of each pair's square is marked in the tree.  From a place ``xb`` the suffix link
   leads to ``b``, and if the tree goes on from there with ``x``, the rotated square ``bx`` is marked next, until a
   marked place is met.  All kinds of squares that the string holds are marked then: its vocabulary.
3. The suffixes below the marked places are the squares' occurrences.  Squares of one period at consecutive starts
   are one run.

Squares whose half is itself a repetition are left out from phase 1 on: each has a primitive period beside it, and
only that can be a run's smallest.  All phases are NumPy arrays over the batch.

Only stretches that can hold a run go through this: a run holds a window of ``min_length (e - 1) / e`` words twice,
and the two copies' stretches of windows cover it.  Words outside all windows that their document repeats are thus in
no run, and maximal stretches of the others, with a symbol of its own after each, are the string.  Words are compared
by 64-bit hashes.

Each row is worked on where it lies, nothing is shuffled, and a task's memory grows with its longest document.
Nulls: a null text has no words and no run.  A null id is carried like any other, repeated rows give equal results,
an empty table an empty one, and further columns, whatever their names, are carried in ``doc`` if they are named.
Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densika.llm.mixing import GAPS
from densika.llm.wordbytes import finish, pieces, run_hashes, tidy, words
from densika.operators.ensemble import let

MIN_LENGTH, MIN_EXPONENT = 24, 3
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_FIRST_STEPS = 8  # rotations of a walk looked at in its first round; they double up to the most
_MOST_STEPS = 4096


class SuffixTree:
    """Of symbols of which the last occurs once.  ``names[k]`` numbers the stretches of 2**k symbols by their order."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.symbols = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.names, reach = [self.symbols.astype(np.int32)], 1
        while int(self.names[-1].max()) + 1 < n:
            rank = self.names[-1].astype(np.int64)
            onward = np.zeros(n, np.int64)
            onward[:-reach] = rank[reach:] + 1
            self.names.append(np.unique(rank * (n + 1) + onward, return_inverse=True)[1].astype(np.int32))
            reach *= 2
        self.rank = self.names[-1].astype(np.int64)
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[self.rank] = np.arange(n)
        common = np.zeros(n, np.int32)
        common[1:] = self.forward(self.suffixes[:-1], self.suffixes[1:])
        self.common = _least(common)

    def __len__(self) -> int:
        return len(self.symbols)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and j on are equal; i and j differ."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.names) - 2, -1, -1):
            same = (self.names[k][i] == self.names[k][j]).astype(np.int64) << k
            i += same
            j += same
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to and with i and j are equal; i and j differ and may be -1."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.names) - 2, -1, -1):
            a, b = i - (1 << k) + 1, j - (1 << k) + 1
            inside = np.minimum(a, b) >= 0
            same = (inside & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])).astype(np.int64) << k
            i -= same
            j -= same
        return start - i

    def place(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval [low, high) of the suffixes that begin with the ``depth`` symbols at ``at``."""
        low, n = self.rank[at].copy(), len(self)
        high = low + 1
        for k in range(len(self.common) - 1, -1, -1):
            least, last = self.common[k], len(self.common[k]) - 1
            wide = (low >= 1 << k) & (least[np.clip(low - (1 << k) + 1, 0, last)] >= depth)
            low -= wide.astype(np.int64) << k
            wide = (high + (1 << k) <= n) & (least[np.minimum(high, last)] >= depth)
            high += wide.astype(np.int64) << k
        return low, high

    def follow(self, at: np.ndarray, depth: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """A place of ``depth`` symbols as at ``at`` that ``symbol`` follows, or -1."""
        low, end = self.place(at, depth)
        high = end.copy()
        while (low < high).any():
            middle = (low + high) // 2
            after = self.suffixes[np.minimum(middle, len(self) - 1)] + depth
            less = (low < high) & (self.symbols[np.minimum(after, len(self) - 1)] < symbol)
            low, high = np.where(less, middle + 1, low), np.where(less | (low >= high), high, middle)
        found = self.suffixes[np.minimum(low, len(self) - 1)]
        fits = (low < end) & (self.symbols[np.minimum(found + depth, len(self) - 1)] == symbol)
        return np.where(fits, found, -1)

    def blocks(self) -> np.ndarray:
        """Where the Lempel-Ziv blocks start: each is the longest stretch that an earlier start has too, or one symbol."""
        n, least = len(self), _least(self.suffixes)
        left = np.arange(n)  # the suffix before in order that starts earlier, one too far, and the one after
        right = np.arange(n) + 1
        for k in range(len(least) - 1, -1, -1):
            last = len(least[k]) - 1
            skip = (left >= 1 << k) & (least[k][np.clip(left - (1 << k), 0, last)] > self.suffixes)
            left -= skip.astype(np.int64) << k
            skip = (right + (1 << k) <= n) & (least[k][np.minimum(right, last)] > self.suffixes)
            right += skip.astype(np.int64) << k
        longest = np.zeros(n, np.int64)
        for have, other in ((left > 0, left - 1), (right < n, right)):
            own = self.suffixes[have]
            longest[own] = np.maximum(longest[own], self.forward(own, self.suffixes[other[have]]))
        step, at, out = np.maximum(longest, 1).tolist(), 0, []
        while at < n:
            out.append(at)
            at += step[at]
        return np.array(out, np.int64)


def _least(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all stretches of 2**k values, by k."""
    out, reach = [values], 1
    while 2 * reach <= len(values):
        out.append(np.minimum(out[-1][:-reach], out[-1][reach:]))
        reach *= 2
    return out


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of so many items its owner and its number from 1 on."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(1, len(owner) + 1) - (np.cumsum(counts) - counts)[owner]


def leftmost_cover(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares that cover the leftmost one of each kind."""
    n, opens = len(tree), tree.blocks()
    bounds = np.concatenate((opens, [n, n]))
    size = np.diff(bounds)
    # Squares whose second half holds the next block's border, with a period within the block.
    owner, k = _counted(np.where(bounds[1:-1] < n, size[:-1], 0))
    border = bounds[owner + 1]
    q = border - k
    may = tree.symbols[np.minimum(border, n - 1)] == tree.symbols[q]
    border, q, k = border[may], q[may], k[may]
    ahead, back = tree.forward(border, q), tree.backward(border - 1, q - 1)
    one = ahead + back >= k
    start_a, k_a = np.maximum(q - back, q - k + 1)[one], k[one]
    # Squares whose first half holds the block's own border, with the second one starting in the block.
    owner, k = _counted(np.where(opens > 0, np.minimum(size[:-1] + size[1:], n - 1 - opens), 0))
    border, until = opens[owner], bounds[owner + 1]
    q = border + k
    may = (tree.symbols[border] == tree.symbols[q]) & (tree.symbols[np.maximum(border - 1, 0)] == tree.symbols[q - 1])
    border, until, q, k = border[may], until[may], q[may], k[may]
    ahead, back = tree.forward(border, q), tree.backward(border - 1, q - 1)
    start = np.maximum(border - back, border - k + 1)
    two = (ahead + back >= k) & (start + k <= until)
    return np.concatenate((start_a, start[two])), np.concatenate((k_a, k[two]))


def primitive(tree: SuffixTree, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the half of each square is no repetition itself."""
    most = int(k.max(initial=1))
    divisor = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if divisor[p] == p:
            multiples = divisor[p * p :: p]
            multiples[multiples == np.arange(p * p, most + 1, p)] = p
    out, rest = np.ones(len(k), bool), k.copy()
    while (open_ := np.flatnonzero(out & (rest > 1))).size:
        p = divisor[rest[open_]]
        shorter = k[open_] // p
        out[open_] = tree.forward(start[open_], start[open_] + shorter) < k[open_] - shorter
        rest[open_] //= p
    return out


def vocabulary(tree: SuffixTree, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals and periods of all places of squares that walks from the given ones reach, each once."""
    n, steps = len(tree), _FIRST_STEPS
    known, found = np.zeros(0, np.int64), []

    def shown(at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Further rotations that stand at the very next starts."""
        return np.minimum(tree.forward(at, at + k) - k, k - 1)

    left = shown(at, k)
    while len(at):
        now = np.minimum(left, steps - 1) + 1
        walk, turn = _counted(now)
        period = k[walk]
        low, high = tree.place(at[walk] + turn - 1, 2 * period)
        key = low * (n + 1) + period
        near = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
        met = known[near] == key if len(known) else np.zeros(len(key), bool)
        # Of walks that begin at one place in a round one goes on; the others stop where the next round sees its marks.
        stop = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(stop, walk[met], turn[met])
        begins = np.flatnonzero(turn == 1)
        first = np.unique(key[begins], return_index=True)[1]
        again = np.ones(len(at), bool)
        again[first] = False
        stop[again] = 0
        new = np.flatnonzero(turn < stop[walk])
        fresh, one = np.unique(key[new], return_index=True)
        found.append((low[new][one], high[new][one], period[new][one]))
        known = np.union1d(known, fresh)
        on = stop > now
        more = on & (left >= now)
        # At the end of what stands there the tree is asked for the next rotation: b, which x = symbol(at) follows.
        ends = np.flatnonzero(on & (left < now))
        last, own = at[ends] + now[ends] - 1, k[ends]
        onward = tree.follow(last + 1, 2 * own - 1, tree.symbols[last])
        goes = onward >= 0
        onward, own = onward[goes], own[goes]
        at = np.concatenate((at[more] + now[more], onward))
        left = np.concatenate((left[more] - now[more], shown(onward, own)))
        k = np.concatenate((k[more], own))
        steps = min(2 * steps, _MOST_STEPS)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    low, high, period = (np.concatenate(x) for x in zip(*found, strict=True))
    return low, high, period


def merged(tree: SuffixTree, low: np.ndarray, high: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs that the squares' occurrences make up."""
    owner, turn = _counted(high - low)
    at, k = tree.suffixes[low[owner] + turn - 1], period[owner]
    order = np.lexsort((at, k))
    at, k = at[order], k[order]
    opens = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(k, prepend=-1) != 0))
    closes = np.append(opens[1:], len(at)) - 1
    return at[opens], at[closes[: len(opens)]] - at[opens] + 2 * k[opens], k[opens]


def runs_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of at least two periods of symbols of which the last occurs once."""
    if len(symbols) < 3:
        return (np.zeros(0, np.int64),) * 3
    tree = SuffixTree(symbols)
    start, k = leftmost_cover(tree)
    single = primitive(tree, start, k)
    return merged(tree, *vocabulary(tree, start[single], k[single]))


def stretches(hashes: np.ndarray, first: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word, exclusive, of what may hold runs: covered by windows that their document repeats."""
    n, width = len(hashes), -(-min_length * (min_exponent - 1) // min_exponent)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < width:
        return none
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(n - width + 1)
    at = at[at + width <= first[1:][owner[at]]]
    grams = finish(run_hashes(hashes, 1)(at, at + width) + (owner[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, at[again], 1)
    np.add.at(edges, at[again] + width, -1)
    covered = np.cumsum(edges)[:-1] > 0
    opens, closes = covered.copy(), covered.copy()
    opens[1:] &= ~covered[:-1] | (owner[1:] != owner[:-1])
    closes[:-1] &= ~covered[1:] | (owner[1:] != owner[:-1])
    lo, hi = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    wide = hi - lo >= min_length
    return lo[wide], hi[wide]


def find_runs(hashes: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, ...]:
    """Owner, start, length and period of the runs of texts whose words begin at ``first``, by owner, start and period."""
    lo, hi = stretches(hashes, first, min_length, min_exponent)
    if not len(lo):
        return (np.zeros(0, np.int64),) * 4
    owner, turn = _counted(hi - lo + 1)
    word = lo[owner] + turn - 1
    mark = word == hi[owner]  # after each stretch a symbol of its own
    symbols = np.empty(len(word), np.int64)
    codes = np.unique(hashes[word[~mark]], return_inverse=True)[1]
    symbols[~mark] = codes
    symbols[mark] = codes.max() + 1 + np.arange(len(lo))
    start, length, period = runs_of(symbols)
    keep = (length >= min_length) & (length >= min_exponent * period)
    start, length, period = word[start[keep]], length[keep], period[keep]
    doc = np.searchsorted(first, start, "right") - 1
    order = np.lexsort((period, start))
    return doc[order], (start - first[doc])[order], length[order], period[order]


def collapse(docs: DataFrame, carry: Sequence[str] = ("doc_id",), min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``doc`` (the columns ``carry``), ``runs`` by start and period, and ``collapsed``.

    ``collapsed`` are the words, by one space, without those that a run contains after its first period.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    names = [f"c{k}" for k in range(len(carry))]
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text_"):
            w = words(batch.column("text_"))
            owner, start, length, period = find_runs(w.hashes(), w.first, min_length, min_exponent)
            gone = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(gone, w.first[owner] + start + period, 1)
            np.add.at(gone, w.first[owner] + start + length, -1)
            keep = np.cumsum(gone)[:-1] == 0
            has = np.zeros(batch.num_rows, bool)
            has[owner] = True
            out = []
            for i, text in enumerate(batch.column("text_").cast(pa.binary()).to_pylist()):
                own = (text or b"").split()
                out.append(b" ".join(compress(own, keep[w.first[i] : w.first[i + 1]].tolist()) if has[i] else own))
            offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(kind))
            listed = pa.ListArray.from_arrays(pa.array(offsets), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), listed, pa.array(out, pa.binary())], [*names, "runs", "collapsed"])

    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(carry, names, strict=True)], F.col("text").alias("text_"))
    kinds = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(carry, names, strict=True))
    found = rows.mapInArrow(tidy(run), f"{kinds}, runs {RUNS}, collapsed binary")
    return found.select(F.struct(*[F.col(k).alias(c) for c, k in zip(carry, names, strict=True)]).alias("doc"), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def with_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: the words of a tenth of the texts repeat with a period from some word on, as hashes of ids say."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))

    def tail(own: Column, n: Column, a: Column, p: Column) -> Column:
        repeated = F.transform(F.sequence(a, n - 1), lambda i: F.get(own, (a + (i - a) % p).cast("int")))
        return F.array_join(F.concat(F.slice(own, F.lit(1), a.cast("int")), repeated), " ")

    def planted(own: Column) -> Column:
        n, g = F.size(own).cast("long"), F.floor(h / 10)
        whole = F.when(n > 0, let(g % n, lambda a: let(F.floor((n - a) / (g % 8 + 3)) + 1, lambda p: tail(own, n, a, p))))
        return F.coalesce(whole, F.lit(""))

    changed = let(F.array_remove(F.split("text", GAPS), ""), planted)
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def longest(runs: Column) -> Column:
    """The run of most periods, exactly compared; of equal ones the first by start and period, and null of none."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def op11(docs: DataFrame) -> DataFrame:
    found = collapse(with_tails(docs)).select("doc.doc_id", "runs", "collapsed", longest(F.col("runs")).alias("best"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    written = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(written.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
