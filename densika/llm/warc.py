"""WARC archives: a writer, and a reader that proves record boundaries by pointer jumping.

Written are uncompressed WARC/1.1 records through Spark's own text sink, whose line separator is the blank
lines that end a record; the files are committed as any Spark output is.  Of equal payloads that of the
smallest ``page_id`` is a response, the others are revisits which carry its digest and length but no body.

Read are the rows between one magic and the next, by splits of the files.  The magic is what all versions
begin with; a row that goes on with a known version, 1.0 or 1.1, is a candidate, as the magic may stand
inside a payload.  Every candidate gives its own offset and, from its declared length,
its successor's.  A split's candidates follow each other to where their chain leaves the split; among these
exits alone pointers of doubling reach are followed from the start of each file, and then within each split
from where the chain enters it.  What can't be reached is payload.  A reachable record that the magic inside
it cut up is put together from its pieces: offsets tell which rows these are, and the texts are then read again
by file and digest, so that it doesn't matter how the files are dealt to tasks that time.

A file whose chain doesn't end where the file does is refused: one of another version, with something before its
first record, or cut short.  ``lenient`` reads such a file up to the break instead.

Records of other writers keep their ids and types; ``page_id`` is null for ids that aren't this writer's.
Archives are read uncompressed and as UTF-8, and an HTTP head is taken off the block only where the record says
that it holds one.

Nulls: a null html is an empty payload, a null url is left out, a null ``page_id`` stays null and never is
the target of a revisit while another page has the same payload.  Rows that repeat a ``page_id`` with equal
payloads have equal results.  No pages give no record, and further columns, whatever their names, are ignored.
A payload of any length is one record and one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from densika.llm.storage import drop, new_path, scratch, store

MAGIC = "WARC/1."
VERSIONS = ("0\r\n", "1\r\n")
CRLF = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"
RECORDS_PER_FILE = 50_000


def base32(hexed: Column) -> Column:
    """160 bits in eight groups of twenty, each five hexadecimal digits and four letters."""
    groups = F.array(*[F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)])

    def letters(value: Column) -> Column:
        return F.concat(*[F.substring(F.lit(ALPHABET), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(groups, letters), "")


def _hex(payload: Column) -> Column:
    return F.sha1(payload.cast("binary"))


def classified(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, bytes, refers_to``; the last is null for responses."""
    payload = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", payload.alias("payload"))
    own = own.select("*", F.octet_length("payload").cast("long").alias("bytes"), _hex(F.col("payload")).alias("hexed"))
    own = own.select("page_id", "url", "payload", "bytes", base32(F.col("hexed")).alias("digest"))
    same = own.where(F.col("bytes") >= min_bytes).groupBy(F.col("digest").alias("twin"), F.col("bytes").alias("twin_bytes")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = store(same.where("n > 1").drop("n"), "twins")  # pages without a twin need no partner
    joined = own.join(shared, (F.col("digest") == F.col("twin")) & (F.col("bytes") == F.col("twin_bytes")), "left")
    revisit = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", "bytes", revisit.alias("refers_to"))


def write_warc(pages: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z", min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    rows = classified(pages, min_bytes)
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP + CRLF * 2), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))

    def line(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))

    head = F.concat(
        F.lit(MAGIC + VERSIONS[-1]),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.coalesce(F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))), F.lit("")),
        F.coalesce(F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    records = rows.select(F.concat(head, F.lit(CRLF), block).alias("value"))
    records.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows between magics with the place of each in its file."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        "value", F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"),
    )


def _offsets(rows: DataFrame) -> DataFrame:
    """``at``: the offset of the magic before each row, under 0 for what stands before a file's first."""
    upto = Window.partitionBy("file").orderBy("block", "turn").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("at", F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(upto), F.lit(0)) - len(MAGIC)).drop("turn")


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(F.concat(F.lit(CRLF), head), rf"(?i)\r\n{name}:[\x20\t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _parsed(rows: DataFrame) -> DataFrame:
    """Fields of a candidate; ``extent`` is what the record declares, from its magic to its successor's."""
    # One projection builds on the other, so that no costly expression is written out, and run, twice.
    own = [c for c in rows.columns if c != "value"]
    rows = rows.select(*own, F.octet_length("value").alias("size"), F.split("value", CRLF * 2, 3).alias("parts"))
    head, rest = F.get("parts", F.lit(0)), F.get("parts", F.lit(2))
    http = F.coalesce(_field(head, "Content-Type").startswith("application/http"), F.lit(False))
    # A block without HTTP head holds its own blank lines.
    block = F.when(http, rest).otherwise(F.concat_ws(CRLF * 2, F.get("parts", F.lit(1)), rest))
    rows = rows.select(*own, "size", head.alias("head"), block.alias("rest"))
    rows = rows.select(*own, "size", "head", F.substring("rest", F.lit(1), F.length("rest") - 4).alias("payload"))
    rows = rows.select(*own, "size", "head", F.octet_length("payload").cast("long").alias("bytes"), _hex(F.col("payload")).alias("hexed"))
    head = F.col("head")
    known = F.lit(False)
    for version in VERSIONS:
        known = known | head.startswith(version)
    rows = rows.select(
        *own, "size", "bytes", "hexed", known.alias("known"), F.octet_length("head").alias("head_bytes"), F.lower(_field(head, "WARC-Type")).alias("record_type"),
        _field(head, "Content-Length").try_cast("long").alias("length"), _field(head, "WARC-Payload-Length").try_cast("long").alias("full"),
        _field(head, "WARC-Payload-Digest").alias("named"), _field(head, "WARC-Record-ID").alias("record_id"), _field(head, "WARC-Refers-To").alias("first"),
    )

    def number(urn: str) -> Column:
        return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    return rows.select(
        *own,
        "size",
        F.when(F.col("known"), F.lit(len(MAGIC) + 4 + 4) + F.col("head_bytes") + F.col("length")).alias("extent"),
        "record_id",
        number("record_id").alias("page_id"),
        number("first").alias("refers_to"),
        "record_type",
        F.when(revisit, F.col("full")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("named", "^sha1:", "")).otherwise(base32(F.col("hexed"))).alias("payload_digest"),
    )


def _followed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of a split's candidates, sorted by offset: the place of each one's successor, and whether it is in the split."""
    at, onward = pdf["at"].to_numpy(), pdf["next"].to_numpy(np.float64, na_value=np.nan)
    place = np.minimum(np.searchsorted(at, onward), len(at) - 1)
    return place, (at[place] == onward) & (onward > at)


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate leaves its split."""
    pdf = pdf.sort_values("at", ignore_index=True)
    place, inside = _followed(pdf)
    jump = np.where(inside, place, np.arange(len(pdf)))
    while (jump[jump] != jump).any():
        jump = jump[jump]
    return pdf.assign(next=pdf["next"].to_numpy()[jump])[["file", "at", "next"]]


def _entered(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split that are on the chain from those marked."""
    pdf = pdf.sort_values("at", ignore_index=True)
    place, inside = _followed(pdf)
    jump, reached = np.where(inside, place, np.arange(len(pdf))), pdf["marked"].to_numpy(bool).copy()
    while True:
        before = reached.sum()
        reached[jump[reached]] = True
        jump = jump[jump]
        if reached.sum() == before:
            return pdf.loc[reached, ["file", "at"]]


def reachable(candidates: DataFrame) -> DataFrame:
    """``(file, block, at, next)`` to the ``(file, at)`` on the chain that starts at offset 0 of each file.

    A split's candidates are one group, bounded by the split's bytes.  Each round over the exits follows every
    marked one's pointer and then doubles all pointers, so rounds grow with the logarithm of a file's splits.
    """
    by_split = candidates.select("file", "block", "at", "next")
    left = store(by_split.groupBy("file", "block").applyInPandas(_exits, "file long, at long, next long"), "exits")
    targets = left.select("file", F.col("next").alias("at")).distinct()
    nodes = left.where("at = 0").unionByName(left.where("at > 0").join(targets, ["file", "at"], "left_semi"))
    nodes = store(nodes.withColumn("marked", F.col("at") == 0), "chain")
    known = nodes.where("marked").count()
    while True:
        hit = nodes.where("marked").select("file", F.col("next").alias("at"), F.lit(True).alias("hit")).distinct()
        onward = nodes.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        step = nodes.join(hit, ["file", "at"], "left").join(onward, ["file", "next"], "left")
        step = store(step.select("file", "at", F.col("far").alias("next"), (F.col("marked") | F.coalesce("hit", F.lit(False))).alias("marked")), "chain")
        drop(nodes)
        nodes, before = step, known
        known = nodes.where("marked").count()
        if known == before:
            break
    entries = nodes.where("marked").select("file", "at", F.lit(True).alias("hit"))
    marked = by_split.join(entries, ["file", "at"], "left").select("file", "block", "at", "next", F.coalesce("hit", F.lit(False)).alias("marked"))
    return marked.groupBy("file", "block").applyInPandas(_entered, "file long, at long")


def _read_again(spark: SparkSession, path: str) -> DataFrame:
    """``(file, key, value)``: the rows by what they hold, whatever their places."""
    raw = _rows(spark, path)
    return raw.select("file", F.md5(F.col("value").cast("binary")).alias("key"), "value")


def _require_whole(rows: DataFrame, records: DataFrame) -> None:
    """No file may go on after the last record that its chain reaches."""
    ends = rows.groupBy("file").agg(F.max(F.col("at") + len(MAGIC) + F.col("size")).alias("end"))
    until = records.groupBy("file").agg(F.max(F.col("at") + F.col("extent")).alias("until"))
    broken = ends.join(until, "file", "left").where("end > 0 and not (end <=> until)")
    if one := broken.orderBy("file").first():
        raise ValueError(f"not a chain of WARC/1.0 or 1.1 records: {broken.count()} files, of which one is read up to byte {one.until or 0} of {one.end}")


def read_warc(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """``record_id, page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record of the archives."""
    out = ["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    raw = _rows(spark, path).select("*", F.md5(F.col("value").cast("binary")).alias("key"))
    every = store(_offsets(_parsed(raw)), "candidates")
    rows = every.where("at >= 0")
    with scratch(spark):
        chain = store(reachable(rows.select("file", "block", "at", (F.col("at") + F.col("extent")).alias("next"))), "reachable", keep=True)
    records = rows.join(chain, ["file", "at"]).where("extent is not null")
    if not lenient:
        _require_whole(every, records)
    whole = F.col("extent") == F.col("size") + len(MAGIC)
    # The last row of a file has no magic after it, and the others' size leaves theirs out: both end alike.
    found = records.where(whole).select(out)
    broken = store(records.where(~whole).select("file", "at", F.col("at").alias("own"), (F.col("at") + F.col("extent")).alias("until")), "broken")
    if broken.isEmpty():
        return found
    # Which rows are pieces follows from offsets.  Rows of one content are one another's copies, so the text is read by that.
    places = rows.select("file", "at", "key").join(broken.select("file").distinct(), "file", "left_semi").join(broken, ["file", "at"], "left")
    latest = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.last(F.when(F.col("own").isNotNull(), F.struct("own", "until")), ignorenulls=True).over(latest)
    placed = places.withColumn("owner", owner).where(F.col("at") < F.col("owner.until")).select("file", "key", "at", F.col("owner.own").alias("own"))
    pieces = store(placed, "pieces")
    texts = _read_again(spark, path).join(pieces.select("file", "key").distinct(), ["file", "key"], "left_semi")
    texts = store(texts.groupBy("file", "key").agg(F.max("value").alias("value")), "texts")
    joined = pieces.join(texts, ["file", "key"]).groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
    joined = joined.select(F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC).alias("value"))
    return found.unionByName(_parsed(joined).select(out))


def op9(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_LETTERS = " || ".join(
    f"substring('{ALPHABET}', CAST((CAST('0x' || substring(h, {5 * g + 1}, 5) AS BIGINT) >> {s}) & 31 AS BIGINT) + 1, 1)" for g in range(8) for s in (15, 10, 5, 0)
)
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""
