"""Periodic runs against all periods tried one by one."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from densika.llm import periodic

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, min_length=24, min_exponent=3):
    """Every period tried; a stretch that a smaller period spans too is not its run."""
    codes = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    out = []
    for q in range(1, len(codes) // min_exponent + 1):
        same = np.concatenate(([False], codes[:-q] == codes[q:], [False]))
        edges = np.flatnonzero(np.diff(same.astype(np.int8)))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            length = hi - lo + q
            if length >= max(min_length, min_exponent * q) and not any(s <= lo and lo + length <= s + n and p < q for s, n, p in out):
                out.append((lo, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    own = SPACE_WORD.findall(text or "")
    if doc_id is None or not own:
        return own
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0:
        n = len(own)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    return own


def plain_op11(doc_id, text):
    own = planted(doc_id, text)
    found = plain_runs(own)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(w for i, w in enumerate(own) if i not in gone))]
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest)


def strings():
    r = random.Random(5)
    for _ in range(400):
        k, n = r.choice([1, 2, 2, 3, 5]), r.randint(1, 70)
        s = [r.randrange(k) for _ in range(n)]
        if r.random() < 0.4:
            p = r.randint(1, 9)
            s = s[: r.randint(0, n)] + (s[:p] * 12)[: r.randint(2, 80)] + s
        yield s
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    yield b
    yield [0] * 300
    yield ([0, 0, 1] * 9 + [2]) * 4


def test_runs_of_symbols():
    for s in strings():
        got = [tuple(map(int, x)) for x in zip(*periodic.runs_of(np.array([*s, 99])), strict=True)]
        assert sorted(got) == sorted(plain_runs(s, 2, 2)), s
        assert len(set(got)) == len(got)


def test_vocabulary_holds_every_primitive_square():
    for s in list(strings())[:150]:
        tree = periodic.SuffixTree(np.array([*s, 99]))
        start, k = periodic.leftmost_cover(tree)
        keep = periodic.primitive(tree, start, k)
        low, high, period = periodic.vocabulary(tree, start[keep], k[keep])
        got = {tuple(s[tree.suffixes[a] : tree.suffixes[a] + 2 * q]) for a, q in zip(low, period, strict=True)}
        want = {tuple(s[i : i + 2 * q]) for i in range(len(s)) for q in range(1, (len(s) - i) // 2 + 1) if s[i : i + q] == s[i + q : i + 2 * q] and not any(s[i : i + q] == s[i : i + d] * (q // d) for d in range(1, q) if q % d == 0)}
        assert got == want and len(got) == len(low)


def test_blocks_are_longest_earlier_stretches():
    for s in list(strings())[:100]:
        whole, at, want = [*s, 99], 0, []
        while at < len(whole):
            want.append(at)
            n = 0
            while at + n + 1 <= len(whole) and any(whole[i : i + n + 1] == whole[at : at + n + 1] for i in range(at)):
                n += 1
            at += max(1, n)
        assert periodic.SuffixTree(np.array(whole)).blocks().tolist() == want


@pytest.mark.parametrize(("min_length", "min_exponent"), [(24, 3), (10, 2), (7, 4), (1, 2)])
def test_stretches_miss_no_run(min_length, min_exponent):
    texts = list(strings())
    first = np.cumsum([0, *map(len, texts)])
    codes = np.concatenate([np.array(t, np.uint64) for t in texts]) * np.uint64(0x9E3779B97F4A7C15)
    owner, *rest = periodic.find_runs(codes, first, min_length, min_exponent)
    got = list(zip(owner.tolist(), *(x.tolist() for x in rest), strict=True))
    assert got == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t, min_length, min_exponent)]


def test_op11(spark, odd_docs, odd_rows):
    from tests.llm.conftest import prose

    r = random.Random(2)
    more = [(100 + i, " ".join(prose(i, r.randint(1, 400)).split() + prose(i, r.randint(1, 30)).split() * r.randint(0, 6))) for i in range(150)]
    df = odd_docs.select("doc_id", "text", "size").unionByName(spark.createDataFrame([(*m, 3) for m in more], "doc_id long, text string, size int")).repartition(3)
    got = sorted((tuple(x) for x in periodic.op11(df).collect()), key=repr)
    want = sorted((plain_op11(*x[:2]) for x in [*odd_rows, *more]), key=repr)
    assert got == want
    assert sum(w[1] > 0 for w in want) > 20 and sum(zlib.crc32(str(m[0]).encode()) % 10 == 0 for m in more) > 5


def test_collapse_keeps_columns_and_empty_tables(spark, odd_docs, no_docs):
    got = periodic.collapse(odd_docs, carry=["doc_id", "text", "spans", "score"]).where("doc.doc_id = 14").first()
    assert got.doc.text == "same same same same " * 40 and got.collapsed == "same" and [tuple(x) for x in got.runs] == [(0, 160, 1)]
    assert periodic.op11(no_docs).count() == 0
    assert periodic.collapse(no_docs).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        periodic.collapse(no_docs, min_exponent=1)
