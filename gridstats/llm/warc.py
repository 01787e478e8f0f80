"""Content-addressed web archive as two Parquet tables.

`payloads` holds each payload's bytes once under its SHA-256; `headers` holds the exact
record header block and the exact url of every record.  A record is put together again by a join on the
digest, which is computed anew from the bytes read and compared.

Among records of one payload of at least `min_revisit` bytes the one with the largest id is
the response and the others are revisits that refer to it; smaller payloads are responses
throughout.  Repeated rows (same id, same payload) are treated alike.  A null id sorts before every
other id; a record whose id is null is a response only if no other record has its payload.  Null html
is an empty payload, and a null url leaves its header line out.  Line breaks in a url are escaped in the header
block, as they would end the line; the url column keeps them.  An empty table gives an empty archive.  Payloads
of any length are kept whole.  Other columns of the input are ignored.

The date of capture is a parameter, as pages have none: the same input gives the same archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"
CONTENT_TYPE = "text/html; charset=utf-8"


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 1000) -> DataFrame:
    """One row per page, without payload: page_id, url, strong, digest, payload_bytes, keeper, record_type, refers_to.

    keeper: the id whose row gives the stored bytes (largest of the payload's records).
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    p = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        F.sha2(payload, 256).alias("strong"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    best = p.groupBy("strong").agg(F.max("page_id").alias("keeper"))
    revisit = (F.col("payload_bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return p.join(best, "strong").select(
        "page_id", "url", "strong", "digest", "payload_bytes", "keeper",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("keeper")).alias("refers_to"),
    )


def header_block(date: str = DATE) -> Column:
    """The record header of a row of records(), as a string that ends in an empty line."""
    revisit = F.col("record_type") == "revisit"
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", urn(F.col("refers_to"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )).otherwise(line("Content-Type", F.lit(CONTENT_TYPE))),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 1000, date: str = DATE) -> None:
    """Writes `folder`/headers and `folder`/payloads.

    The payload bytes move once: only rows that are their payload's keeper reach the store.
    """
    rec = records(pages, page_id, url, html, min_revisit)
    rec.select("page_id", "url", "strong", header_block(date).cast("binary").alias("header")).write.mode("overwrite").parquet(f"{folder}/headers")
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    bodies = pages.select(F.col(page_id).cast("long").alias("page_id"), payload.alias("payload"), F.sha2(payload, 256).alias("strong"))
    # The bytes of a payload come from its keeper; repeated rows of a keeper leave one.
    first = bodies.groupBy("strong").agg(F.max_by("payload", F.coalesce(F.col("page_id"), F.lit(-(2**63)))).alias("payload"))
    first.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/payloads")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Records as written: header fields, header bytes, payload (verified), and `verified`."""
    headers = spark.read.parquet(f"{folder}/headers")
    store = spark.read.parquet(f"{folder}/payloads")
    field = lambda name: F.regexp_extract(F.col("head"), rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)
    ident = lambda c: F.regexp_extract(c, r"<urn:page:(-?[0-9]+)>", 1)
    number = lambda c: F.when(c != "", c.cast("long"))
    parsed = headers.withColumn("head", F.decode("header", "utf-8")).select(
        "strong", "header", "url",
        number(ident(field("WARC-Record-ID"))).alias("page_id"),
        field("WARC-Type").alias("record_type"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        number(ident(field("WARC-Refers-To"))).alias("refers_to"),
        field("Content-Length").cast("long").alias("content_length"),
    )
    # Checked beside the store, so that readers who want no payload move none.
    checked = store.select(
        "strong", "payload", F.sha1("payload").alias("_sha1"), F.octet_length("payload").cast("long").alias("_n"),
        (F.sha2("payload", 256) == F.col("strong")).alias("_same"),
    )
    block = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("_n"))
    return parsed.join(checked, "strong", "left").select(
        "page_id", "url", "record_type", "payload_digest", F.col("_n").alias("payload_bytes"), "refers_to", "content_length", "header", "payload",
        F.coalesce(F.col("_same") & (F.col("_sha1") == F.col("payload_digest")) & (F.col("content_length") == block), F.lit(False)).alias("verified"),
    )


def with_record(archive: DataFrame) -> DataFrame:
    """Adds record, the bytes of each record: header, block, two line ends."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.withColumn("record", F.concat(F.col("header"), block, F.lit(b"\r\n\r\n")))


def record_bytes(archive: DataFrame) -> DataFrame:
    """page_id and the bytes of each record."""
    return with_record(archive).select("page_id", "record")
