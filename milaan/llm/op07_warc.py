"""WARC archives with revisit resolution.

Headers (id, digest, length), without payloads, are shuffled by payload digest, and the largest page_id of equal payloads becomes
the original.  Pages then meet their original's id and are written as records with fresh headers: the original as ``response``
with its payload, the others as ``revisit`` without one, naming the original's record, address and digest.  Archives are text
files whose record separator is the two line breaks the format asks for, gzip-compressed, so Spark's own writer makes them on
any file system; a rewritten task replaces its file.  ``read_archives`` parses records by their Content-Length, works out the
digests of the payloads anew, and ``resolve`` joins revisits to the responses they refer to.

Defined results: a null html is an empty payload; payloads below ``LEAST_BYTES`` bytes are always responses; rows that repeat the
largest page_id with its payload are all responses; a null page_id is smaller than any other, and rows without one are responses if
no page with an id has their payload; line breaks in an address are written as spaces; an empty table gives an empty archive.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from milaan.llm.common import prepare, table
from milaan.sources.writers import scratch_path

LEAST_BYTES = 1000
RECORDS_PER_FILE = 2000
DATE = "2024-01-01T00:00:00Z"
# Fixed by the format.
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column, digest: Column) -> Column:
    """A name made from id and digest, in the shape of a UUID."""
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def with_digests(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", " ")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))


def originals(headers: DataFrame) -> DataFrame:
    """(digest, orig, orig_url): of equal payloads that are long enough, the page with the largest id."""
    best = F.max(F.struct("page_id", "url")).alias("best")
    seen = headers.filter(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(best, F.count("digest").alias("copies"))
    return seen.filter("copies > 1").select("digest", F.col("best.page_id").alias("orig"), F.col("best.url").alias("orig_url"))


def records(pages: DataFrame) -> DataFrame:
    """One archive record per page, as text."""
    known = with_digests(pages)
    headers = known.drop("html")
    again = headers.join(originals(headers), "digest").filter(~F.col("page_id").eqNullSafe(F.col("orig")))
    again = again.select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "orig", "orig_url").distinct().withColumn("again", F.lit(True))
    met = known.join(again, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left")
    is_again = F.coalesce(F.col("again"), F.lit(False))
    http = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(END))
    head = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(is_again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest"))), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.when(is_again, F.concat_ws(
            "\r\n", F.lit(f"WARC-Profile: {PROFILE}"), F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("orig"), F.col("digest"))),
            F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("orig_url")), F.lit(f"WARC-Refers-To-Date: {DATE}"),
            F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("orig").cast("string")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(is_again, 0).otherwise(F.col("bytes"))).cast("string")),
    ]
    block = F.concat(http, F.when(is_again, F.lit("")).otherwise(F.col("html")))
    return met.select(F.concat(F.concat_ws("\r\n", *head), F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    records(pages).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and the payload of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        first = end + 4
        last = first + int(head["content-length"])
        yield head, data[data.index(b"\r\n\r\n", first, last) + 4 : last]
        at = last + 4


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("n", pa.int64()), ("digest", pa.string()), ("good", pa.bool_())])
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for head, payload in parse(gzip.decompress(content.as_py())):
                number = lambda key, head=head: int(head[key]) if key in head else None
                named = head["warc-payload-digest"].removeprefix("sha1:")
                real = hashlib.sha1(payload).hexdigest() if head["warc-type"] == "response" else named
                rows.append((number("x-page-id"), head["warc-type"], number("x-refers-to-page-id"), head.get("warc-target-uri"), len(payload), real, real == named))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], f.type) for f in kinds], schema=kinds)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; a revisit's digest is the one its header names, a response's is worked out from its bytes."""
    prepare(spark)
    schema = "page_id long, record_type string, refers_to long, url string, n long, digest string, good boolean"
    try:
        files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    except AnalysisException:  # an empty table leaves a folder without archives
        return spark.createDataFrame([], schema)
    return files.mapInArrow(_parsed, schema)


def resolve(read: DataFrame) -> DataFrame:
    """Give every revisit the length of the response it refers to."""
    full = read.filter("record_type = 'response' AND n >= %d" % LEAST_BYTES).groupBy(F.col("digest").alias("d")).agg(F.max("n").alias("full"))
    again = read.filter("record_type = 'revisit'").join(full, F.col("digest") == F.col("d"))
    again = again.withColumn("n", F.col("full")).drop("d", "full")
    return read.filter("record_type <> 'revisit'").unionByName(again)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolve(read_archives(spark, path)).select(
        "page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


ORACLE = """
WITH p AS (SELECT page_id, encode(COALESCE(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS orig FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> orig THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> orig THEN orig END AS refers_to
FROM o
"""
