"""MinHash near-dedup with HyperMinHash sketches.

A document's set is its distinct two-word shingles (``width`` words in general), hashed to 64 bits.  A
HyperMinHash register keeps of its bucket's smallest hash the number of leading zeros and ten bits of
mantissa, sixteen bits in all; ``BANDS`` bands of ``ROWS`` registers are compared as wholes.  At similarity
0.8 a link escapes all bands with a chance of 4e-9 if all registers are full.  For banding, empty registers borrow from others, so that
no band of a small set rests on a single shingle.

Links are found in rounds that never pair up a bucket's members: each bucket tests its members against its
first one, then, among the members whose components still differ, against the next.  A document first tests
only the leader it shares most bands with; other leaders follow where the components differ.  Nothing is
capped: what ``ROUNDS`` rounds leave in buckets of several components meets in an exact prefix-filter join,
which pairs sets of different components that share one of the rarest shingles that two linked sets must
share.  How much of a set follows a shingle bounds the sizes it can be linked with, and is compared once for
the members of a component that have one size, so that a shingle of thousands of sets yields few pairs.
Tests run on distinct sets: copies share one, whatever their number.

A pair passes on the collision-corrected Jaccard estimate of its sketches, less five standard errors, and is
then decided on the full sets.

Nulls: a null or blank text has an empty set and is linked with nothing; a text with fewer words than the
width has its word sequence as its only shingle.  A null ``doc_id`` is linked with nothing and has a null
component; rows that share a ``doc_id`` are one node, linked by what any of their texts is linked with.  Very
long texts are read in pieces and their sets kept whole.  An empty table gives an empty result, and further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densika.llm.components import components
from densika.llm.storage import scratch, store
from densika.llm.wordbytes import Words, finish, pieces, tidy, words

BANDS, ROWS = 64, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
ROUNDS = 1
SPREAD = 64  # groups that a leader's members are dealt to
_MULTIPLIERS = np.random.default_rng(6).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_CHOICES = [np.random.default_rng(100 + k).permutation(REGISTERS) for k in range(8)]
_PRIORITY = np.random.default_rng(99).integers(0, 1 << 31, (REGISTERS, REGISTERS), dtype=np.int32)


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted by text and hash, and their number by text."""
    hashes, count, first = w.hashes(), w.count(), w.first
    out, sizes = [], np.zeros(len(count), np.int64)
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        rolled += hashes[k : len(hashes) - width + 1 + k] * _MULTIPLIERS[k]
    rolled = finish(rolled)
    for i in range(len(count)):
        if count[i] >= width:
            own = np.unique(rolled[first[i] : first[i + 1] - width + 1])
        elif count[i]:
            own = finish(np.add.reduce(hashes[first[i] : first[i + 1]] * _MULTIPLIERS[8 : 8 + count[i]], keepdims=True))
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def registers(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sketches, one row a set; ``hashes`` are sorted within each set.  0 is an empty register."""
    out = np.zeros((len(sizes), REGISTERS), np.uint16)
    if not len(hashes):
        return out
    scaled = (hashes >> np.uint64(32)) * np.uint64(REGISTERS)
    place = (scaled >> np.uint64(32)).astype(np.int64) + np.repeat(np.arange(len(sizes)), sizes) * REGISTERS
    least = np.flatnonzero(np.diff(place, prepend=-1))  # of a bucket the first is the smallest
    rest = (scaled[least] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    length = np.frexp(rest.astype(np.float64))[1]
    mantissa = ((rest << (32 - length)) >> (31 - MANTISSA)) & ((1 << MANTISSA) - 1)
    out.reshape(-1)[place[least]] = ((33 - length) << MANTISSA) | mantissa
    return out


def filled(sketches: np.ndarray) -> np.ndarray:
    """Sketches with each empty register filled from another, so that a band always compares ``ROWS`` elements.

    Which one is drawn alike for all sets: the first of eight fixed choices that is not empty, else the one
    of the smallest fixed priority.  Two filled registers agree about as often as the sets overlap.
    """
    out = sketches.copy()
    for choice in _CHOICES:
        out = np.where(out == 0, sketches[:, choice], out)
    for i in np.flatnonzero((out == 0).any(1)):
        have, lack = np.flatnonzero(sketches[i]), np.flatnonzero(out[i] == 0)
        if len(have):
            out[i, lack] = sketches[i, have[_PRIORITY[np.ix_(lack, have)].argmin(1)]]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """64-bit keys by band."""
    bands = filled(sketches).reshape(-1, BANDS, ROWS).astype(np.uint64)
    return finish((bands * _MULTIPLIERS[:ROWS]).sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _MULTIPLIERS[15])


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of sketches and the registers they rest on.

    Registers of unrelated minima agree by chance when their leading zeros and mantissas do.  That chance,
    from the leading zeros seen in each pair, is taken out: (matches - c) / (1 - c).
    """
    used = (a > 0) | (b > 0)
    n = np.maximum(used.sum(1), 1)
    same = ((a == b) & used).sum(1) / n
    zeros_a, zeros_b = a >> MANTISSA, b >> MANTISSA
    chance = np.zeros(len(a))
    for z in range(1, 34):
        chance += (zeros_a == z).sum(1) / n * ((zeros_b == z).sum(1) / n) / (1 << MANTISSA)
    return np.clip((same - chance) / (1 - chance), 0, 1), n


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, s1, s2, sketch`` of every row; (s1, s2) is a digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashes, sizes = shingles(words(batch.column("text"), lower=True), width)
            ends = np.cumsum(sizes)
            digests = []
            for k in (11, 12):
                sums = np.zeros(len(hashes) + 1, np.uint64)
                np.cumsum(finish(hashes ^ _MULTIPLIERS[k]), out=sums[1:])
                digests.append(pa.array((sums[ends] - sums[ends - sizes]).view(np.int64)))
            rows = registers(hashes, sizes)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * REGISTERS), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), *digests, flat.cast(pa.binary())], ["doc_id", "n", "s1", "s2", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n long, s1 long, s2 long, sketch binary")


def _bands(sketches: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                keys = band_keys(_matrix(part.column("sketch")))
                node = np.repeat(part.column("node").to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(node)], ["key", "node"])

    return sketches.select("node", "sketch").mapInArrow(tidy(run), "key long, node long")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _met(pairs: DataFrame, held: DataFrame, column: str, passes: Callable[[list[bytes], list[bytes]], np.ndarray]) -> DataFrame:
    """Pairs ``(u, v)`` of which some ``column`` of u and of v ``passes``.

    A leader's value is not joined to each of its pairs: it is sent once to each of ``SPREAD`` groups of its members at
    most, where it comes first and is held while theirs go by.
    """
    salted = pairs.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(SPREAD)).cast("int").alias("salt"))
    heads = salted.select("u", "salt").distinct().join(held.select(F.col("node").alias("u"), F.col(column).alias("data")), "u")
    members = salted.join(held.select(F.col("node").alias("v"), F.col(column).alias("data")), "v")
    rows = heads.select("u", "salt", F.lit(None).cast("long").alias("v"), "data").unionByName(members.select("u", "salt", "v", "data"))
    rows = rows.repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            u, salt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "salt"))
            head = batch.column("v").is_null().to_numpy(zero_copy_only=False)
            first, second, row = [], [], []
            for i, key in enumerate(zip(u.tolist(), salt.tolist(), strict=True)):
                if head[i]:
                    if key != now:
                        now, own = key, []
                    own.append(batch.column("data")[i].as_py())
                elif key == now:
                    data = batch.column("data")[i].as_py()
                    first += own
                    second += [data] * len(own)
                    row += [i] * len(own)
            keep = np.unique(np.array(row, np.int64)[passes(first, second)]) if row else np.zeros(0, np.int64)
            yield batch.take(pa.array(keep)).select(["u", "v"])

    return rows.mapInArrow(tidy(run), "u long, v long")


def _likely(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose estimate, with five standard errors added, reaches the threshold."""

    def passes(first: list[bytes], second: list[bytes]) -> np.ndarray:
        out = []
        for lo in range(0, len(first), 2000):
            x, y = (np.frombuffer(b"".join(side[lo : lo + 2000]), np.uint16).reshape(-1, REGISTERS) for side in (first, second))
            value, n = estimate(x, y)
            out.append(value + 5 * np.sqrt(threshold * (1 - threshold) / n) >= threshold)
        return np.concatenate(out)

    return _met(pairs, sketches, "sketch", passes)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with ``100 * intersection >= percent * union`` on full sets."""

    def passes(first: list[bytes], second: list[bytes]) -> np.ndarray:
        keep = np.zeros(len(first), bool)
        for i, (x, y) in enumerate(zip(first, second, strict=True)):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = np.concatenate((a, b))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(both) - common)
        return keep

    return _met(pairs, sets, "hashes", passes)


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashes, sizes = shingles(words(batch.column("text"), lower=True), width)
            raw, ends = hashes.tobytes(), np.cumsum(sizes) * 8
            out = [raw[e - 8 * n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], ["node", "hashes"])

    return docs.select("node", "text").mapInArrow(tidy(run), "node long, hashes binary")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``nodes`` (node, component) of different components that may reach ``percent``; none is missed.

    With shingles ordered from the rarest, sets of n and m that are linked have t / (1 + t) (n + m) shingles or
    more in common, all from their first common one on.  A set with so many left from a shingle on can thus be
    linked, by that shingle, with sets up to a size ``fits``.  Of the members of a component that have one size
    only the largest ``fits`` is compared, so that pairs inside a component are never looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                raw = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("hashes")]
                sizes = np.array([len(x) for x in raw], np.int64)
                node, component = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("node", "component"))
                mark = np.repeat(np.array([np.bitwise_xor.reduce(x) for x in raw], np.int64), sizes)  # tells the sets of one node apart
                columns = (node, mark, component, np.repeat(sizes, sizes), np.concatenate(raw))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["node", "mark", "component", "n", "shingle"])

    rows = nodes.join(sets, "node").select("node", "component", "hashes").mapInArrow(tidy(run), "node long, mark long, component long, n long, shingle long")
    rows = store(rows, "shingles")
    rarity = store(rows.groupBy("shingle").agg(F.count("*").alias("df"), (F.min("component") < F.max("component")).alias("mixed")), "rarity")
    rank = F.row_number().over(Window.partitionBy("node", "mark", "n").orderBy("df", "shingle"))
    ranked = rows.join(rarity, "shingle").withColumn("rank", rank)
    # ceil(a / b) of whole numbers is (a + b - 1) div b
    least = F.expr(f"(n * {percent} + 99) div 100")
    rest = F.col("n") - F.col("rank") + 1  # shingles from this one on
    fits = F.least(F.expr(f"{100 + percent} * (n - rank + 1) div {percent} - n"), F.expr(f"(100 * n) div {percent}"))
    ranked = ranked.where(F.col("mixed") & (rest >= least)).select("shingle", "component", "node", "n", fits.alias("fits"))
    ranked = store(ranked.where(F.col("fits") >= least), "prefixes")  # no set under ``least`` is linked

    groups = ranked.groupBy("shingle", "component", "n").agg(F.max("fits").alias("fits"))
    # Of two linked sets the smaller one, or either of one size, fits its own size: one side of each pair does.
    small = groups.where("fits >= n")
    other = groups.select("shingle", F.col("component").alias("other"), F.col("n").alias("m"), F.col("fits").alias("room"))
    crossed = small.join(other, "shingle").where("component != other and n <= m and m <= fits and n <= room and (n < m or component < other)")
    crossed = store(crossed.select("shingle", "component", "n", "other", "m"), "crossed")
    one = ranked.join(crossed, ["shingle", "component", "n"]).where("m <= fits").select("shingle", "node", "other", "n", "m")
    two = ranked.select("shingle", F.col("component").alias("other"), F.col("n").alias("m"), F.col("node").alias("v"), F.col("fits").alias("room"))
    pairs = one.join(two, ["shingle", "other", "m"]).where("n <= room")
    return pairs.select(F.least("v", "node").alias("u"), F.greatest("v", "node").alias("v")).distinct()


def _same_id(owned: DataFrame) -> DataFrame:
    """Links between a repeated ``doc_id`` and the nodes of its rows, where these differ or some have none."""
    held = owned.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("node").alias("n"), F.count("*").alias("rows"))
    mixed = store(held.where("low < high or (n > 0 and n < rows)").select("doc_id"), "repeated-ids")
    return owned.join(mixed, "doc_id").where("node is not null").select(F.col("doc_id").alias("u"), F.col("node").alias("v")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; a component keeps its smallest ``doc_id``."""
    with scratch(docs.sparkSession):
        owned, labels = _clustered(docs, width, percent)
    merged = owned.withColumn("own", F.coalesce("node", F.col("doc_id").cast("long"))).join(labels.withColumnRenamed("node", "own"), "own", "left")
    merged = merged.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "own")))
    return merged.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _clustered(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n_shingles, node)`` of every row, and ``(node, component)`` of the nodes that are not their own."""
    sketches = store(sketch(docs, width), "sketches")
    real = sketches.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = store(real.groupBy("s1", "s2", "n").agg(F.min("doc_id").cast("long").alias("node")), "classes")
    owned = sketches.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2").join(classes.withColumnRenamed("n", "n_shingles"), ["s1", "s2", "n_shingles"], "left")
    owned = store(owned.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), "owned", keep=True)
    heads = real.withColumn("node", F.col("doc_id").cast("long")).join(classes, ["node", "s1", "s2", "n"], "left_semi").dropDuplicates(["node", "s1", "s2"])
    heads = store(heads.select("node", "sketch"), "heads")

    bands = _bands(heads)
    # What is joined back is stored first: adaptive execution can then split the join of a hot bucket.
    leaders = bands.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("key", "leader")
    met = store(bands.join(store(leaders, "leaders"), "key").select("key", "node", "leader"), "buckets")
    some = met.select("node").distinct()
    heads = store(heads.join(some, "node", "left_semi"), "heads")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(some, "node", "left_semi")
    sets = store(_full_sets(texts, width), "sets")

    def tested(pairs: DataFrame) -> DataFrame:
        return _verified(store(_likely(pairs, heads, percent / 100), "likely"), sets, percent)

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        at_u = labels.select(F.col("node").alias("u"), F.col("component").alias("cu"))
        at_v = labels.select(F.col("node").alias("v"), F.col("component").alias("cv"))
        own = pairs.join(at_u, "u", "left").join(at_v, "v", "left")
        return own.select("u", "v", F.coalesce("cu", "u").alias("cu"), F.coalesce("cv", "v").alias("cv")).where("cu != cv")

    def grown(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """Labels after the links among ``pairs``: components are found on the graph of the former ones."""
        pairs = store(apart(pairs, labels), "pairs")
        new = store(pairs.join(tested(pairs), ["u", "v"], "left_semi").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct(), "links")
        if new.isEmpty():
            return labels
        merged = components(new)
        moved = labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
        moved = moved.select("node", F.coalesce("to", "component").alias("component"))
        return store(moved.unionByName(merged.join(labels, "node", "left_anti").select("node", "component")), "labels")

    starred = met.where(F.col("leader") < F.col("node")).groupBy(F.col("leader").alias("u"), F.col("node").alias("v")).agg(F.count("*").alias("bands"))
    starred = store(starred, "stars")
    best = starred.groupBy("v").agg(F.max_by("u", F.struct("bands", -F.col("u"))).alias("u")).select("u", "v")
    labels = components(store(tested(best).unionByName(_same_id(owned)), "links"))
    labels = grown(labels, starred.select("u", "v"))
    left = met.where(F.col("leader") != F.col("node")).select("key", "node")
    for turn in range(ROUNDS + 1):
        left = left.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        split = left.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("leader")).where("low < high")
        left = store(left.join(store(split.select("key", "leader"), "leaders"), "key"), "buckets")
        if left.isEmpty():
            break
        if turn == ROUNDS:
            labels = grown(labels, _prefix_pairs(left.select("node", "component").distinct(), sets, percent))
            break
        labels = grown(labels, left.where("leader < node").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct())
        left = left.where("leader < node").select("key", "node")
    return owned, store(labels, "labels", keep=True)


def op8(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, width=2)
