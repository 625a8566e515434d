"""Authorship marks hidden in trailing whitespace.

The k-th non-blank line of a marked file ends in a space (bit 0) or a tab
(bit 1); the bits spell the first characters of the author's hash.  All of it
is array work inside the file's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..session import broadcast_if_small, hot_key_parts
from .symbols import KEY

DEFAULT_BITS = 64


def author_hash_of(author_id: Column, salt: Column) -> Column:
    salted = F.concat(author_id, F.lit(":"), F.coalesce(salt, F.lit("")))
    return F.sha2(salted.cast("binary"), 256)


def author_hash(authors: DataFrame) -> DataFrame:
    return authors.withColumn("author_hash", author_hash_of(F.col("author_id"), F.col("salt")))


def payload_bits_of(author_hash_col: Column, bits: int = DEFAULT_BITS) -> Column:
    """The first bits/8 characters of the hash as a string of 0 and 1."""
    chars = F.split(F.substring(author_hash_col, 1, bits // 8), "")
    return F.array_join(F.transform(chars, lambda c: F.lpad(F.bin(F.ascii(c)), 8, "0")), "")


def payload_bits(authors: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    return author_hash(authors).withColumn(
        "bits", payload_bits_of(F.col("author_hash"), bits)
    )


def marked_text(content: Column, bit_string: Column, bits: int = DEFAULT_BITS) -> Column:
    """Strips every line's tail, then marks the first ``bits`` non-blank lines."""

    def mark(bound: Column) -> Column:
        lines, carriers, code = bound["lines"], bound["carriers"], bound["bits"]

        def one(line: Column, i: Column) -> Column:
            k = F.array_position(carriers, i).cast("int")
            bit = F.substring(code, k, F.lit(1))
            tail = F.when(k == 0, "").when(bit == "0", " ").when(bit == "1", "\t").otherwise("")
            return F.concat(text.rstrip(line), tail)

        return F.array_join(F.transform(lines, one), "\n")

    def with_carriers(lines: Column) -> Column:
        solid_at = F.filter(
            F.transform(lines, lambda x, i: F.when(~text.is_blank(x), i)),
            lambda i: i.isNotNull(),
        )
        return F.struct(
            lines.alias("lines"),
            F.slice(solid_at, 1, bits).alias("carriers"),
            bit_string.alias("bits"),
        )

    return arrays.let(arrays.let(text.lines_of(content), with_carriers), mark)


def embed_watermark(files: DataFrame, authors: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    """Marks every file with its author's payload.

    ``files`` names the author in ``author_id``.  An author table of checked
    size is broadcast so no text moves; a larger one is joined by shuffle,
    salted because one author may own a third of all files.  Files of authors
    missing from the table keep their text.
    """
    known_authors = authors.select("author_id", F.coalesce("salt", F.lit("")).alias("salt"))
    small = broadcast_if_small(known_authors)
    if small is not None:
        joined = files.join(small, "author_id", "left")
    else:
        salts = hot_key_parts(files)
        parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        joined = (
            files.withColumn("part", F.pmod(F.xxhash64("file_path"), F.lit(salts)).cast("int"))
            .join(known_authors.withColumn("part", parts), ["author_id", "part"], "left")
            .drop("part")
        )
    code = payload_bits_of(author_hash_of(F.col("author_id"), F.col("salt")), bits)
    known = F.col("salt").isNotNull()
    return joined.withColumn(
        "content",
        F.when(known, marked_text(F.col("content"), code, bits)).otherwise(F.col("content")),
    ).drop("salt")


def embed_for_author(
    files: DataFrame, author_id: str, salt: str = "", bits: int = DEFAULT_BITS
) -> DataFrame:
    """Marks every file for one author; no join."""
    code = payload_bits_of(author_hash_of(F.lit(author_id), F.lit(salt)), bits)
    return files.withColumn("content", marked_text(F.col("content"), code, bits))


def embed_codebase(
    files: DataFrame, author_id: str, output: str, salt: str = "", bits: int = DEFAULT_BITS
) -> DataFrame:
    """Writes the marked files to a new place and returns files per scan."""
    embed_for_author(files, author_id, salt, bits).write.parquet(output)
    written = files.sparkSession.read.parquet(output)
    return written.groupBy("scan_id").agg(F.count("*").alias("files_marked"))


@arrays.built_once
def extracted_payload(content: Column, bits: int = DEFAULT_BITS) -> Column:
    """The payload of a text, or null when fewer than ``bits`` lines carry a bit."""

    def tail_bit(line: Column) -> Column:
        solid_length = F.length(text.rstrip(line))
        first = F.substring(line, solid_length + 1, F.lit(1))
        return F.when(solid_length > 0, F.when(first == " ", "0").when(first == "\t", "1"))

    found = F.filter(
        F.transform(text.lines_of(content), tail_bit), lambda b: b.isNotNull()
    )

    def decode(carried: Column) -> Column:
        joined = F.array_join(F.slice(carried, 1, bits), "")
        octets = [
            F.lpad(F.conv(F.substring(joined, 8 * k + 1, 8), 2, 16), 2, "0")
            for k in range(bits // 8)
        ]
        value = F.make_valid_utf8(F.unhex(F.concat(*octets)).cast("string"))
        return F.when(F.size(carried) >= bits, value)

    return arrays.let(found, decode)


def extract_watermark(files: DataFrame, bits: int = DEFAULT_BITS) -> DataFrame:
    payload = extracted_payload(F.col("content"), bits)
    return files.select(*KEY, payload.alias("payload")).withColumn(
        "payload_is_hex", F.coalesce(F.col("payload").rlike("^[0-9a-f]+$"), F.lit(False))
    )


def verify_watermark(
    extracted: DataFrame, claims: DataFrame, bits: int = DEFAULT_BITS
) -> DataFrame:
    """Compares payloads with the authors each scan claims.

    ``claims``: scan_id, author_id, salt; a scan may claim several authors.
    ``verified`` is null when the file has no mark or its scan claims nobody.
    The claims are reduced to their distinct payloads and repeated once per
    salt, so a scan holding a third of all files is spread over many tasks.
    """
    expected = (
        claims.select(
            "scan_id", author_hash_of(F.col("author_id"), F.col("salt")).alias("claimed_hash")
        )
        .withColumn("payload", F.substring("claimed_hash", 1, bits // 8))
        .groupBy("scan_id", "payload")
        .agg(F.min("claimed_hash").alias("claimed_hash"))
    )
    salts = hot_key_parts(extracted)
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    claimed_scans = expected.select("scan_id").distinct().withColumn("part", every).withColumn(
        "has_claim", F.lit(True)
    )
    part = F.pmod(F.xxhash64("file_path"), F.lit(salts)).cast("int")
    joined = (
        extracted.withColumn("part", part)
        .join(expected.withColumn("part", every), ["scan_id", "payload", "part"], "left")
        .join(claimed_scans, ["scan_id", "part"], "left")
    )
    watermarked = F.col("payload").isNotNull()
    has_claim = F.coalesce("has_claim", F.lit(False))
    verified = F.when(watermarked & has_claim, F.col("claimed_hash").isNotNull())
    return joined.select(
        *KEY,
        watermarked.alias("is_watermarked"),
        has_claim.alias("has_claim"),
        verified.alias("verified"),
        F.when(verified, F.substring("claimed_hash", 1, 16)).alias("author_hash"),
    )


def confidence() -> Column:
    """none 0.0, mark 0.7, matching claim 1.0, other claim 0.3."""
    return (
        F.when(~F.col("is_watermarked"), 0.0)
        .when(F.col("verified").isNull(), 0.7)
        .when(F.col("verified"), 1.0)
        .otherwise(0.3)
    )


def watermark_confidence(verified: DataFrame) -> DataFrame:
    return verified.withColumn("confidence", confidence())


def watermark_score(verified: DataFrame) -> DataFrame:
    """Per scan: verified share when authors are claimed, else marked share."""
    counted = verified.groupBy("scan_id").agg(
        F.count("*").alias("total_files"),
        F.count_if("is_watermarked").alias("watermarked_files"),
        F.count_if(F.coalesce("verified", F.lit(False))).alias("verified_files"),
        F.bool_or("has_claim").alias("has_claim"),
    )
    hits = F.when(F.col("has_claim"), F.col("verified_files")).otherwise(
        F.col("watermarked_files")
    )
    return counted.withColumn(
        "watermark_score",
        F.when(F.col("total_files") > 0, hits / F.col("total_files") * 100.0).otherwise(0.0),
    ).drop("has_claim")
