"""Language identification: n-grams and decoding against plain Python, and rows never seen."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from densika.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, score string, ambiguous string"
SYLLABLES = {"aa": ["ka", "lo", "mi", "ten"], "bb": ["sch", "ung", "er", "ö"], "cc": ["que", "ción", "la", "ito"], "dd": ["漢", "字", "語", "文"]}


def made(lang, seed, n=40):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", "x", "y") for r in rows], SCHEMA).repartition(3)


def plain_grams(text):
    out = Counter()
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode()):
        w = b" " + w.lower() + b" "
        for k in range(1, language.GRAMS + 1):
            for i in range(len(w) - k + 1):
                if w[i : i + k] != b" ":
                    out[w[i : i + k]] += 1
    return out


def test_grams_are_those_of_padded_words(monkeypatch):
    texts = ["Ab-c1 é!", "", "one", "a  b\nc", "x" * 50 + " yy", None, "WORD word Word", " .. "]
    got = {}
    for size in (1 << 21, 7):
        monkeypatch.setattr(language, "PIECE", size)
        got[size] = Counter(pair for owner, slot in language.grams(pa.array(texts)) for pair in zip(owner.tolist(), slot.tolist(), strict=True))
    assert got[7] == got[1 << 21]
    for i, t in enumerate(texts):
        mine = sorted(n for (owner, _), n in got[7].items() if owner == i)
        assert mine == sorted(plain_grams(t or "").values())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 9, 40])
def test_codewords(n):
    code = language.codewords(n)
    assert len(code) == n and not (np.abs(code.sum(0)) == n).any()
    if n > 1:
        assert min((a != b).sum() for a, b in combinations(code, 2)) == language.distance(code) >= (2 ** (n - 2) if n <= 5 else code.shape[1] / 5)


def test_wrong_bits_are_outvoted():
    code = language.codewords(5)
    found = language.Decoder(list("abcde"), code, np.ones(code.shape))
    wrong = (language.distance(code) - 1) // 2
    for row, word in enumerate(code):
        assert not found.decode(word[None] * 3.0)[2][0]
        for bits in list(combinations(range(code.shape[1]), wrong))[:200]:
            margins = word * 3.0
            margins[list(bits)] *= -1
            best, score, _ = found.decode(margins[None])
            assert best[0] == row
            each = [sum(math.log1p(math.exp(-c * m)) for c, m in zip(w, margins, strict=True)) / language.distance(code) for w in code]
            assert math.isclose(score[0], math.exp(-each[row]) / sum(math.exp(-e) for e in each), rel_tol=1e-9)


def test_rows_never_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = language.op12(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 3000 and right / n > 0.995


def test_what_is_no_input(spark):
    rows = [(i, made(lang, i), lang) for i, lang in enumerate(["aa", "bb", "cc", "dd"] * 40)]
    docs = table(spark, rows)
    one = {r.doc_id: tuple(r) for r in language.op12(docs).collect()}
    assert sum(one[i][2] == lang for i, _, lang in rows) >= 158
    changed = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("t"))
    assert {r.doc_id: tuple(r) for r in language.op12(changed).collect()} == one
    assert all(0 < s <= 1 for _, _, _, s, _ in one.values())


def test_mixed_texts_are_ambiguous(spark):
    rows = [(i, made(lang, i), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    decoder = language.train(table(spark, rows))
    both = [(i, made("aa", i, 30) + " " + made("bb", i, 30), None) for i in range(40)]
    got = language.identify(table(spark, both), decoder).collect()
    assert sum(r.ambiguous for r in got) > 20 and all(r.lang_pred in ("aa", "bb") for r in got)
    assert sum(r.ambiguous for r in language.identify(table(spark, rows), decoder).collect()) == 0


def test_odd_tables(spark, odd_docs, no_docs, odd_rows):
    got = language.op12(odd_docs).collect()
    assert len(got) == len(odd_rows)
    blank = {4, 5, 6}
    for r in got:
        if r.doc_id in blank:
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, True)
        elif r.doc_id is not None:
            assert (r.lang_pred, r.score) == ("en", 1.0)  # one language is learned
    assert language.op12(no_docs).count() == 0
    nothing = language.op12(table(spark, [(1, "abc", None), (2, "abc", "aa"), (7, "123", "aa"), (None, "abc", "aa")])).collect()
    assert {(r.doc_id, r.held_out, r.lang_pred, r.score) for r in nothing} == {(1, False, "und", 0.0), (2, True, "und", 0.0), (7, False, "und", 0.0), (None, False, "und", 0.0)}


def test_training_rows_are_bounded(spark, monkeypatch):
    rows = [(i, made(lang, i, 5), lang) for i, lang in enumerate(["aa", "bb", "cc", "dd"] * 100)]
    docs = table(spark, rows)
    copies = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit(made("dd", 3, 5)).alias("text"), F.lit("dd").alias("lang"))
    seen = []

    def kept(ids, *_):
        seen.append(len(ids))
        return language.Decoder()

    monkeypatch.setattr(language, "fit", kept)
    language.train(docs, sample=40)
    language.train(docs.select("doc_id", "text", "lang").unionByName(copies), sample=40)
    assert max(seen) <= 40 and min(seen) > 20
