"""WARC archives by content address: payload bytes once by SHA-256, exact record headers apart, records rebuilt by joins.

``write_archive`` writes two Parquet parts below one path: ``part=payloads`` (digest, payload) with each payload once, and
``part=headers`` with each record's exact header block, its digest and its place in the archive order. ``read_archive``
gives the records back; a payload whose bytes do not have its digest fails the read.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the smallest page_id is a ``response``, the
others are ``revisit`` records that refer to it; shorter payloads are all responses.

Defined results: null html is an empty payload; null url is written as an empty target; a null
page_id sorts last, is written as an empty number and read as null; rows that repeat the page_id and
payload of a response are responses too, and their payload is still stored once; extra columns are ignored; an empty
table gives an empty archive. The decision shuffles digests only; payload bytes are moved once, to the store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrid.llm._util import scratch, table

MIN_REVISIT = 100
CRLF = "\r\n"
STAMP = "2000-01-01T00:00:00Z"  # the archive's fixed WARC-Date: the tables carry no fetch time


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html) -> page_id, digest, n_bytes, record_type, refers_to, header, payload (null where not stored)."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    first = rows.groupBy("digest", "page_id").agg(F.count("*").alias("copies")).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "copies")).alias("m")).select("digest", F.col("m.page_id").alias("first_id"), F.col("m.copies").alias("copies"))
    rows = rows.join(first.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d")).drop("d")
    revisit = (F.col("n_bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(k + ": "), v, F.lit(CRLF))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        line("WARC-Date", F.lit(STAMP)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("first_id"))))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
        F.lit(CRLF),
    )
    rows = rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id")))
    return rows.withColumn("header", header).withColumn("keeps", F.col("page_id").eqNullSafe(F.col("first_id")))


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    rows = records(pages, min_revisit)
    none, no = F.lit(None).cast("binary"), F.lit(None).cast("long")
    head = F.struct(F.lit("headers").alias("part"), "digest", F.col("header").cast("binary").alias("header"), none.alias("payload"), no.alias("copies"))
    body = F.struct(F.lit("payloads").alias("part"), "digest", none.alias("header"), F.col("payload"), F.col("copies"))
    parts = rows.select(F.explode(F.when(F.col("keeps"), F.array(head, body)).otherwise(F.array(head))).alias("r")).select("r.*")
    parts.write.partitionBy("part").option("compression", "zstd").parquet(path)


def _part(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    return spark.read.schema(schema + ", part string").parquet(path).where(F.col("part") == part).drop("part")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: header fields, payload of the record it refers to, and the record's exact bytes.

    Digest and length are taken from the stored bytes before the join, so a reader of only these moves no payload. Repeated
    rows of one page may have stored its payload more than once; ``copies`` tells, and the join takes one of them.
    """
    stored = _part(spark, path, "payloads", "digest string, payload binary, copies long")
    once = stored.where("copies = 1")
    stored = once.unionByName(stored.where("copies > 1").dropDuplicates(["digest"])).drop("copies")
    proof = F.sha2("payload", 256)
    stored = stored.withColumn("payload_digest", F.when(proof == F.col("digest"), proof).otherwise(F.raise_error(F.lit("payload does not have its digest"))))
    stored = stored.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    heads = _part(spark, path, "headers", "digest string, header binary").withColumn("h", F.col("header").cast("string"))
    field = lambda k: F.regexp_extract("h", rf"\r\n{k}: ([^\r]*)\r\n", 1)
    number = lambda k: F.regexp_extract(field(k), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    heads = heads.select("header", F.substring(field("WARC-Payload-Digest"), 8, 64).alias("digest"), number("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"), field("Content-Length").cast("long").alias("content_length"))
    rows = heads.join(stored, "digest")
    own = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return rows.withColumn("record", F.concat("header", own, F.lit(b"\r\n\r\n")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> f THEN f END AS refers_to FROM f
"""
