"""WARC archives with revisit records in place of repeated payloads.

Record headers (id, URL, payload size and SHA-1) are shuffled by payload digest;
of records with equal payloads of at least ``min_bytes``, that with the largest
id is the response and the others revisit it.  The archives are written afresh:
each record gets new headers and its own length, and a revisit carries no
payload.  Reading parses the archives by ``Content-Length`` and joins revisits
to the responses they refer to.

Spark's text writer lays the records down, with the record end as its line
separator, so any file system Spark knows will do and a lost task is simply
written again.  Rows are dealt to as many files as their bytes ask for, in the
same shuffle that finds revisits; a reading task holds one packed file.  Null payloads are empty; a null URL leaves its header out; rows
that tie on the largest id (repeated rows) are all responses, and so is every
row with a null id.  Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, scratch_path, table, text_or_empty

CRLF = "\r\n"
RECORD_END = CRLF * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of an archive file on average, and records in one at most.
FILE_BYTES, FILE_RECORDS = 32 << 20, 4096
#: Payload bytes handed on at a time while reading.
BATCH_BYTES = 8 << 20


def resolve_revisits(headers: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Add ``refers_to`` to headers ``(id, bytes, digest)``: null for responses, else the response's id.

    Counting and the maximum combine before the shuffle, and only digests met
    more than once are joined back, so a payload shared by very many records
    stays one row on that side.
    """
    best = headers.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.max("id").alias("original"), F.count("*").alias("n"))
    joined = headers.join(best.where("n > 1").drop("n"), ["digest", "bytes"], "left")
    refers = F.when(F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original")), F.col("original"))
    return joined.withColumn("refers_to", refers).drop("original")


def _record_id(i: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">"))


def record_text(date: str) -> Column:
    """A record from columns ``id, url, payload, bytes, digest, refers_to``, without its end."""
    lines = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to")))),
        F.when(F.col("refers_to").isNotNull(), F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("Content-Length: "), F.when(F.col("refers_to").isNull(), F.col("bytes")).otherwise(F.lit(0)).cast("string")),
    )
    return F.concat(lines, F.lit(RECORD_END), F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit("")))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` as gzip WARC files under ``path``."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    heads = materialize(rows.select("id", "bytes", "digest"), "warc-headers")  # sizes and both sides of the join come from these
    total = heads.agg(F.sum("bytes")).first()[0] or 0
    revisits = resolve_revisits(heads, min_bytes).where("refers_to is not null").distinct()
    dealt = rows.repartition(1 + total // FILE_BYTES, "id", "bytes", "digest")
    marked = dealt.join(revisits, ["id", "bytes", "digest"], "left")
    marked.select(record_text(date).alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_archive(stream: IO[bytes]) -> Iterator[dict]:
    """Records of one archive, framed by their Content-Length."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record where {line[:40]!r} stands")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            head[name] = value
        size = int(head["Content-Length"])
        payload = stream.read(size)
        if len(payload) < size or stream.read(4) != RECORD_END.encode():
            raise ValueError(f"record {head.get('WARC-Record-ID')} has a wrong length")
        yield head | {"payload": payload}


def _page_of(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["id", "type", "digest", "refers_to", "url", "payload", "seen"]
    for content in (c for batch in batches for c in batch["content"]):
        rows, held = [], 0
        with gzip.open(io.BytesIO(content)) as stream:
            for r in parse_archive(stream):
                digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
                rows.append((_page_of(r["WARC-Record-ID"]), r["WARC-Type"], digest, _page_of(r.get("WARC-Refers-To")), r.get("WARC-Target-URI"), r["payload"], hashlib.sha1(r["payload"]).hexdigest()))
                held += len(r["payload"])
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=names).astype({"id": "Int64", "refers_to": "Int64"})
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=names).astype({"id": "Int64", "refers_to": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records ``(id, type, digest, refers_to, url, payload, seen)``; ``seen`` is the payload's own SHA-1."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(_parsed, "id bigint, type string, digest string, refers_to bigint, url string, payload binary, seen string")


def resolved_records(records: DataFrame) -> DataFrame:
    """``(id, type, refers_to, bytes, digest)``, with size and digest of the full payload.

    A revisit takes both from the response it refers to, found by id and digest.
    Records are read once, and written without their payloads.
    """
    slim = materialize(records.select("id", "type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("bytes"), "seen"), "warc-records")
    responses = slim.where("type = 'response'").select("id", "type", "refers_to", "bytes", F.col("seen").alias("digest"))
    originals = responses.select(F.col("id").alias("refers_to"), "digest", F.col("bytes").alias("full")).distinct()
    revisits = slim.where("type = 'revisit'").join(originals, ["refers_to", "digest"], "left").select("id", "type", "refers_to", F.col("full").alias("bytes"), "digest")
    return responses.unionByName(revisits)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return resolved_records(read_archives(spark, path)).select(
        F.col("id").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


OP3_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1, 2)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN o.original IS NULL OR o.original = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN o.original <> p.page_id THEN o.original END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest AND p.payload_bytes = o.payload_bytes
"""
