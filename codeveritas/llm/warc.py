"""A content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; the exact header block of every record is kept
separately; the records come back through a join of the two.  Of records with equal payloads the
one with the largest key is the response, all others revisit it.  Payloads shorter than
`least_bytes` are always responses, still stored once.

Digests are checked twice: a stored payload must have the SHA-256 it is filed under, and a record
that is read back must have the SHA-1, the length and the Content-Length its header states.

What is read back comes from the archived header blocks alone: the key of a record from its extension
field `Page-Key`, the key a revisit refers to from the record its WARC-Refers-To names.

Defined results: every row is a record, repeated rows too; a null payload is empty; a null address is
written as an empty target; of several records of the largest key one is the response; a null key
sorts before all others and has no `Page-Key`; other columns are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

CRLF = "\r\n"

#: Payload bytes of a bucket, whatever the size of the archive.
BUCKET_BYTES = 128 << 20

#: The RFC 4648 alphabet of base 32 (fixed values).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a 40-digit hexadecimal SHA-1: 5 hexadecimal digits give 4 characters."""
    parts = []
    for k in range(8):
        number = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(number, shift).bitwiseAND(31) + 1
            parts.append(F.substring(F.lit(BASE32), place, F.lit(1)))
    return F.concat(*parts)


def _header(date: str) -> Column:
    """The exact header block of a record, without the blank line that ends it."""
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), F.col("record_id"), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), F.col("refers_record"), F.lit(">"))),
        F.concat(F.lit("Page-Key: "), F.col("key").cast("string")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    return F.concat_ws(CRLF, *lines)


def _record_id() -> Column:
    """A stable name in the form of a UUID, from key, payload, address and number among equal rows."""
    h = F.md5(F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("null")), F.hex("sha256"), F.col("copy").cast("string"), "url"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


@dataclass
class Archive:
    """An archive: `headers` (sha256, header; one row a record) and `payloads` (sha256, payload; each once)."""

    path: str
    headers: DataFrame
    payloads: DataFrame
    table: str

    def forget(self) -> None:
        """Removes the catalog entry of the bucketed payloads; the files stay."""
        self.headers.sparkSession.sql(f"drop table if exists {self.table}")


def write_archive(
    pages: DataFrame,
    path: str | None = None,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> Archive:
    """Writes a record for every row below `path`, by default a new folder in the shared scratch.

    Rows equal in key, address and digest are counted, which combines map-side, and numbered from their
    count.  Digests alone decide which record is the response: the largest key of a digest is a map-side
    combined maximum, and its way back to the rows is a join of two written tables, which Spark
    splits where a digest is hot.  Of payloads each task sends on one of a digest at most.  They
    are stored bucketed by digest, in buckets of about BUCKET_BYTES, so reading back moves the narrow
    headers only.
    """
    spark = pages.sparkSession
    path = path or scratch_dir(spark, "warc")
    rows = pages.select(
        F.col(f"`{key}`").cast("long").alias("key"),
        F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    facts = (
        rows.select(
            "key", "url", "sha256", F.sha1("payload").alias("sha1"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
        )
        .groupBy("key", "url", "sha256")
        .agg(F.first("sha1").alias("sha1"), F.first("payload_bytes").alias("payload_bytes"), F.count(F.lit(1)).alias("copies"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .withColumn("record_id", _record_id()).drop("copy", "copies")
    )
    facts = _stored(facts, f"{path}/facts")
    owners = _stored(
        facts.groupBy("sha256").agg(F.max(F.struct("key", "record_id")).alias("owner"), F.first("payload_bytes").alias("n")), f"{path}/owners")
    held = owners.agg(F.sum("n")).first()[0] or 0
    # With fewer buckets than shuffle partitions Spark would exchange the payloads again on reading.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // BUCKET_BYTES))
    stored = rows.groupBy("sha256").agg(F.first("payload").alias("payload"))
    name = f"warc_payloads_{uuid.uuid4().hex}"
    (
        stored.repartition(buckets, "sha256").write.bucketBy(buckets, "sha256")
        .option("path", f"{path}/payloads").option("compression", "zstd").saveAsTable(name)
    )
    response = (F.col("record_id") == F.col("owner.record_id")) | (F.col("payload_bytes") < least_bytes)
    headers = (
        facts.join(owners.select("sha256", "owner"), "sha256")
        .withColumn("record_type", F.when(response, "response").otherwise("revisit"))
        .withColumn("refers_record", F.when(~response, F.col("owner.record_id")))
        .withColumn("payload_digest", base32_of_hex(F.col("sha1")))
        .select("sha256", _header(date).cast("binary").alias("header"))
    )
    return Archive(path, _stored(headers, f"{path}/headers"), spark.table(name), name)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _field(name: str) -> Column:
    found = F.regexp_extract(F.col("header").cast("string"), f"(?m)^{name}: ([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def read_archive(archive: Archive) -> DataFrame:
    """Original records: key, header, payload, and what the header states.

    The join puts header and payload together; a payload whose bytes do not have the digest it is
    filed under, or the digest in the header, fails the job, as does a revisit that does not name the
    response of its payload.  Payloads that are revisited have one response, so one narrow row a
    payload is joined, by the same key as the payload.
    """
    def named(field: str) -> Column:
        return F.regexp_extract(_field(field), "^<urn:uuid:(.*)>$", 1)

    parsed = archive.headers.withColumn("key", _field("Page-Key").cast("long")).withColumn("record_id", named("WARC-Record-ID"))
    responses = parsed.filter(_field("WARC-Type") == "response").groupBy("sha256").agg(F.max(F.struct("key", "record_id")).alias("response"))
    records = parsed.join(responses, "sha256", "left").join(archive.payloads, "sha256")
    refers = named("WARC-Refers-To")
    refers_to = F.when(refers.isNotNull() & (refers == F.col("response.record_id")), F.col("response.key"))
    unknown = refers.isNotNull() & ~F.coalesce(refers == F.col("response.record_id"), F.lit(False))
    sha256 = F.unhex(F.sha2("payload", 256))
    digest = base32_of_hex(F.sha1("payload"))
    stated = F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "")
    length = _field("Content-Length").cast("long")
    kind = _field("WARC-Type")
    size = F.octet_length("payload").cast("long")
    sound = ~unknown & (sha256 == F.col("sha256")) & (digest == stated) & (length == F.when(kind == "revisit", 0).otherwise(size))
    return records.select(
        "key", "record_id", refers_to.alias("refers_to"), "header", "payload", kind.alias("record_type"),
        size.alias("payload_bytes"),
        F.when(sound, digest).otherwise(
            F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id")))
        ).alias("payload_digest"),
    )


def export_warc(archive: Archive, path: str) -> None:
    """Writes the records as WARC files, text payloads only: a record ends with two line ends."""
    body = F.when(F.col("record_type") == "revisit", "").otherwise(F.col("payload").cast("string"))
    lines = read_archive(archive).select(
        F.concat(F.col("header").cast("string"), F.lit(CRLF + CRLF), body).alias("value")
    )
    lines.write.option("lineSep", CRLF + CRLF).text(path)
