"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

Low-quality documents go, one document of every group of near-duplicates stays, documents contaminated by
the benchmark go, secrets are cut out of the texts, and sources are mixed to their target weights.  The last
stage adds ``repeats``, how often the mix takes a document; documents it takes no time are left out.

Texts of any length are judged whole.  Of an empty table every stage makes an empty one with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densika.llm import decontam, mixing, neardup, quality, secrets
from densika.llm.storage import drop, scratch, store
from densika.runtime import visible


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return visible(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are judged one by one on their texts; a null text is judged as an empty one."""
    return quality.classify(docs, _table(spark, sf_dir, "labels")).where("predicted = 1").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles at 0.8; of each group the row of the smallest ``doc_id`` stays.

    Rows, not ids, are judged: where a ``doc_id`` is null or repeats, its different texts get numbers of their
    own, above 2**62 and so after plain ids, and one may go while another stays; of rows with one id and one
    text a single one stays.  Texts that are null or empty are no copies of each other.
    """
    repeated = store(docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 or doc_id is null").select(F.col("doc_id").alias("of")), "repeated-ids")
    rows = docs.select(F.struct("*").alias("doc"))
    rows = rows.join(repeated.withColumn("again", F.lit(True)), F.col("doc.doc_id").eqNullSafe(F.col("of")), "left")
    again = F.col("again").isNotNull()
    number = F.when(again, F.shiftrightunsigned(F.xxhash64("doc.doc_id", "doc.text"), 2) + F.lit(1 << 62)).otherwise(F.col("doc.doc_id"))
    rows = rows.select("doc", again.alias("again"), number.alias("row"))
    copies = neardup.near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))).where("not kept")
    rest = rows.join(copies.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti")
    single = rest.where("again").groupBy("row").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return rest.where("not again").select("doc.*").unionByName(single.select("doc.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are judged by id and text, so that repeated ones go or stay together; texts without words stay."""
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark")).where("not contaminated").select("doc.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a span, null and empty ones too, are unchanged; where one is cut, ``n_chars`` follows the text."""
    found = secrets.scan(docs)
    text = secrets.redacted(F.col("doc.text"), F.col("spans"))
    rows = found.select("doc", text.alias("redacted"), F.size("spans").alias("cuts"))
    new = {"text": F.col("redacted"), "n_chars": F.when(F.col("cuts") > 0, F.length("redacted").cast("long")).otherwise(F.col("doc.n_chars"))}
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``repeats``, with underscores after it if the table has a column of that name; a null source is one more."""
    name = "repeats"
    while name in docs.columns:
        name += "_"
    return mixing.mix(docs).where("copies > 0").select("doc.*", F.col("copies").alias(name))


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", redact_secrets),
    ("source mixing", mix_sources),
]
#: The classifier can't be put in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; of an empty table none.  What the stages store between them is deleted."""
    docs = _table(spark, sf_dir, "documents")
    former = None
    for name, stage in STAGES:
        with scratch(spark):
            docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        if former is not None:
            drop(former)
        former = docs
    return docs
