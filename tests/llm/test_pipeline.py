"""Each stage of the pipeline on its own input, and all of them together."""

from __future__ import annotations

import pytest

import corpus_pipeline
from densika.llm import quality
from tests.llm.test_operators import contaminated, linked, rows, secret_spans

STAGE = dict(corpus_pipeline.STAGES)


def columns_kept(out, docs):
    return out.columns == docs.columns


def test_quality_stage(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = STAGE["quality classifier"](spark, docs, sf_dir)
    good = {r.doc_id for r in quality.op2(docs, labels).where("predicted = 1").collect()}
    assert columns_kept(out, docs) and {r.doc_id for r in out.collect()} == good
    assert set(rows(out)) <= set(rows(docs))


def test_near_duplicate_stage(spark, sf_dir, odd_docs, odd_rows):
    out = STAGE["near-duplicates"](spark, odd_docs, sf_dir)
    assert columns_kept(out, odd_docs)
    # Of the two rows 10 one stays, and the row without id that holds the text of 1 goes.
    kept = sorted((r[:2] for r in odd_rows if r[0] not in (2, 3, 8, 10) and not (r[0] is None and r[1])), key=repr)
    lonely = [x for x in sorted((tuple(r)[:2] for r in out.collect()), key=repr) if x[0] != 10]
    texts = {x[1] for x in lonely if x[0] is None or x[0] in (1, 2)}
    assert odd_rows[0][1] in texts and len([r for r in out.collect() if r.doc_id == 10]) == 1
    assert {x[0] for x in lonely if x[0] is not None} >= {x[0] for x in kept if x[0] not in (None, 1, 13, 15)}


def test_near_duplicates_lose_no_text(spark, sf_dir):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(60))
    docs = [(3, one), (5, one), (5, two), (7, two + " x"), (20, "u v w x y z"), (20, "u v w x y z"), (30, ""), (30, None), (31, "")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, row int")
    out = [(r.doc_id, r.text) for r in STAGE["near-duplicates"](spark, df, sf_dir).collect()]
    assert len(out) == len(set(out)) and {x for x in out if x[1]} >= {(3, one), (20, "u v w x y z")}
    assert len([x for x in out if x[1] and x[1].startswith("b0 ")]) == 1 and {x for x in out if not x[1]} == {(30, ""), (30, None), (31, "")}


def test_decontamination_stage(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = STAGE["benchmark decontamination"](spark, docs, sf_dir)
    clean = {x[0] for x in contaminated([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()]) if not x[5]}
    assert columns_kept(out, docs) and {r.doc_id for r in out.collect()} == clean and len(clean) < docs.count()


def test_secret_stage(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest table has no secret
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {r.doc_id: r for r in STAGE["secret scan"](spark, docs, sf_dir).collect()}
    changed = 0
    for r in docs.collect():
        spans = secret_spans(r.text)[1]
        if spans:
            changed += 1
            assert all(r.text[a:z] not in out[r.doc_id].text for a, _, z in spans) and "<SECRET>" in out[r.doc_id].text
            assert out[r.doc_id].n_chars == len(out[r.doc_id].text)
        else:
            assert out[r.doc_id] == r
    assert changed


def test_mixing_stage(spark, sf_dir, odd_docs):
    out = STAGE["source mixing"](spark, odd_docs, sf_dir).collect()
    assert out and all(r.repeats in (1, 2) for r in out)
    clash = STAGE["source mixing"](spark, odd_docs.withColumnRenamed("mark", "repeats"), sf_dir)
    assert clash.columns[-1] == "repeats_" and clash.count() == len(out)


@pytest.mark.parametrize("name", list(STAGE))
def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs, name):
    for docs in (odd_docs, no_docs):
        out = STAGE[name](spark, docs, sf_dir)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert out.count() <= docs.count()


def test_intermediate_tables_are_deleted(spark, sf_dir, tmp_path):
    from densika.llm import mixing, neardup, storage, substrings

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old = storage.shared_dir(spark)
    spark.sparkContext.setCheckpointDir(str(tmp_path))

    def tables():
        return sorted(p.name.rpartition("-")[0] for p in tmp_path.glob("*/*"))

    try:
        for f, left in ((neardup.op8, ["labels", "owned"]), (substrings.op3, ["duplicate-windows"]), (mixing.op6, ["mix-meta", "mix-plan"])):
            with storage.scratch(spark):
                out = f(docs)
                assert tables() == left and out.count() == docs.count()
            assert tables() == []
        corpus_pipeline.run(spark, sf_dir)
        assert tables() == ["source-mixing"]
    finally:
        spark.sparkContext.setCheckpointDir(old)


def test_run(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(out) < len(docs) and len({r.doc_id for r in out}) == len(out)
    step = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        step = spark.createDataFrame(stage(spark, step, sf_dir).collect(), stage(spark, step, sf_dir).schema)
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, step.collect()), key=repr)
