"""From directories or tables to the ``files`` table.

``files``: scan_id, file_path, size_bytes, content (and, once prepared, ext,
language and code).  One source file is one row; its text stays in that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from . import directories


def scan_files(
    spark: SparkSession, root: str, scan_id: str | None = None, *,
    supported_only: bool = False, skip_vendor: bool = False, max_bytes: int | None = None,
) -> DataFrame:
    """Every file below ``root`` with its bytes, empty ones included.

    ``file_path`` is relative to the scan root, so a root that itself lies
    below a skipped directory is not skipped.  Without ``scan_id`` the first
    directory below the root names the scan.  The filters work on the listing:
    what they drop is never opened.  A store that only Spark's readers reach
    is read through Spark's file index.
    """
    if not directories.can_open(root):
        files = scan_files_by_index(spark, root, scan_id)
        files = keep_supported(files) if supported_only else files
        files = drop_vendor_dirs(files) if skip_vendor else files
        return files if max_bytes is None else drop_oversize(files, max_bytes)
    listing = directories.list_tree(
        spark, root, skipped=schemas.SKIPPED_DIRECTORIES if skip_vendor else None,
        extensions=schemas.SOURCE_EXTENSIONS if supported_only else None, max_bytes=max_bytes,
    )
    if supported_only:
        # An ending is not yet an extension: "notes.xpy" ends in no dot and "py".
        kept = text.extension_of(F.col("path")).isin(schemas.SOURCE_EXTENSIONS)
        listing = listing.where(kept)
    scan = F.lit(scan_id) if scan_id is not None else F.split("path", "/")[0]
    return directories.read_files(listing, root).select(
        scan.alias("scan_id"), F.col("path").alias("file_path"), F.col("size").alias("size_bytes"), "content"
    )


def scan_files_by_index(
    spark: SparkSession, root: str, scan_id: str | None = None, keep_empty: bool = True
) -> DataFrame:
    """``scan_files`` by Spark's own file source, whose index holds every file name on the driver.

    Filters on size reach the source.  It passes over empty files;
    ``keep_empty`` adds them from its index.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length", "content")
    )
    if keep_empty:
        raw = raw.unionByName(_empty_files(spark, raw))
    root_uri = root.rstrip("/").removeprefix("file:")
    below = F.expr(f"substring(path, locate('{_sql_quote(root_uri)}/', path) + {len(root_uri) + 1})")
    scan = F.lit(scan_id) if scan_id is not None else F.split(below, "/")[0]
    return raw.select(
        scan.alias("scan_id"),
        below.alias("file_path"),
        F.col("length").alias("size_bytes"),
        F.col("content"),
    )


def _empty_files(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """Indexed files without a row in the scan; no content is read for this."""
    indexed = spark.createDataFrame([(uri,) for uri in raw.inputFiles()], "uri string")
    plain = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    one_slash = F.regexp_replace(plain, r"^([A-Za-z0-9+.-]+):///", "$1:/")
    return (
        indexed.select(one_slash.alias("path"))
        .join(raw.select("path"), "path", "left_anti")
        .select(
            "path",
            F.lit(0).cast("bigint").alias("length"),
            F.lit("").cast("binary").alias("content"),
        )
    )


def _sql_quote(value: str) -> str:
    return value.replace("\\", "\\\\").replace("'", "\\'")


def read_table_as_files(
    df: DataFrame, scan_id: Column, file_path: Column, content: Column
) -> DataFrame:
    """Any table with an id and a text column as ``files``."""
    return df.select(
        scan_id.cast("string").alias("scan_id"),
        file_path.alias("file_path"),
        F.octet_length(content).cast("bigint").alias("size_bytes"),
        content.alias("content"),
    )


def keep_supported(files: DataFrame) -> DataFrame:
    """Only files whose extension is a known source extension."""
    ext = text.extension_of(F.col("file_path"))
    return files.withColumn("ext", ext).where(F.col("ext").isin(schemas.SOURCE_EXTENSIONS))


def drop_vendor_dirs(files: DataFrame) -> DataFrame:
    """Drop files with a vendor, build or cache directory in their path."""
    skipped = F.array(*[F.lit(d) for d in schemas.SKIPPED_DIRECTORIES])
    return files.where(~F.arrays_overlap(F.split("file_path", "/"), skipped))


def drop_oversize(files: DataFrame, max_bytes: int = schemas.MAX_FILE_BYTES) -> DataFrame:
    return files.where(F.col("size_bytes") <= max_bytes)


def drop_oversize_scans(
    files: DataFrame, max_mb: float = schemas.MAX_SCAN_MEGABYTES
) -> DataFrame:
    """Drop whole scans above a total size.

    The totals read only the size column.  At most (corpus bytes / limit)
    scans can exceed the limit, and every dropped scan id is a short string,
    so that side is broadcast: 100 TB at 500 MB is at most 200,000 ids.
    """
    limit = int(max_mb * 1024 * 1024)
    too_big = (
        files.groupBy("scan_id")
        .agg(F.sum("size_bytes").alias("scan_bytes"))
        .where(F.col("scan_bytes") > limit)
        .select("scan_id")
    )
    if limit >= 64 * 1024 * 1024:
        too_big = F.broadcast(too_big)
    return files.join(too_big, "scan_id", "left_anti")


def decode_text(files: DataFrame) -> DataFrame:
    """Bytes or raw strings to text; unreadable content becomes empty."""
    return files.withColumn("content", text.text_or_empty(text.normalise(F.col("content"))))


def language_of(ext: Column) -> Column:
    # 58 literal entries; a map lookup per file needs no join.
    pairs = [F.lit(x) for item in schemas.LANGUAGE_BY_EXTENSION.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("unknown"))


def detect_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of(text.extension_of(F.col("file_path"))))


def coerce_language(df: DataFrame, column: str = "language") -> DataFrame:
    """Values outside the enumeration become ``unknown``."""
    lowered = F.lower(F.coalesce(F.col(column), F.lit("unknown")))
    known = lowered.isin(schemas.LANGUAGES)
    return df.withColumn(column, F.when(known, lowered).otherwise(F.lit("unknown")))


def classify_input(name: Column) -> Column:
    """archive / source / rejected for an uploaded file name."""
    lowered = F.lower(name)
    double = F.regexp_extract(lowered, r"(\.tar\.(?:gz|bz2|xz))$", 1)
    ext = F.when(double != "", double).otherwise(text.extension_of(name))
    return (
        F.when(ext.isin(schemas.ARCHIVE_EXTENSIONS), F.lit("archive"))
        .when(ext.isin(schemas.SOURCE_EXTENSIONS), F.lit("source"))
        .otherwise(F.lit("rejected"))
    )


def notebook_text(content: Column) -> Column:
    """Code cells of a notebook joined by a blank line.

    ``source`` may be a list of strings or one string.  Text that is not a
    JSON object stays as it is.
    """
    doc = F.try_parse_json(content)
    is_object = F.schema_of_variant(doc).startswith("OBJECT")
    cells = F.try_variant_get(doc, "$.cells", "array<variant>")
    code_cells = F.filter(
        cells, lambda c: F.try_variant_get(c, "$.cell_type", "string") == F.lit("code")
    )
    sources = F.transform(code_cells, _cell_source)
    joined = F.array_join(F.filter(sources, lambda s: s.isNotNull()), "\n\n")
    return F.when(F.coalesce(is_object, F.lit(False)), F.coalesce(joined, F.lit(""))).otherwise(
        content
    )


def _cell_source(cell: Column) -> Column:
    kind = F.coalesce(
        F.schema_of_variant(F.try_variant_get(cell, "$.source", "variant")), F.lit("ARRAY")
    )
    as_list = F.array_join(
        F.coalesce(
            F.try_variant_get(cell, "$.source", "array<string>"),
            F.array().cast("array<string>"),
        ),
        "",
    )
    return F.when(kind.startswith("ARRAY"), as_list).when(
        kind == "STRING", F.try_variant_get(cell, "$.source", "string")
    )


def notebook_code(files: DataFrame) -> DataFrame:
    """Adds ``code``: the analysable text (notebook cells extracted)."""
    is_notebook = F.lower("file_path").endswith(".ipynb")
    return files.withColumn(
        "code",
        F.when(is_notebook, text.normalise(notebook_text(F.col("content")))).otherwise(
            F.col("content")
        ),
    )


def content_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_sha256", F.sha2(F.col("content").cast("binary"), 256))


def prepare(files: DataFrame, max_bytes: int = schemas.MAX_FILE_BYTES) -> DataFrame:
    """Path and size filters first, then decoding, language and code text."""
    kept = drop_oversize(drop_vendor_dirs(keep_supported(files)), max_bytes)
    return notebook_code(detect_language(decode_text(kept)))


def corpus_totals(files: DataFrame) -> DataFrame:
    """Files, lines and languages per scan."""
    newlines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return (
        files.select("scan_id", "language", (newlines + 1).cast("bigint").alias("n"))
        .groupBy("scan_id")
        .agg(
            F.count("*").alias("total_files"),
            F.sum("n").alias("total_lines"),
            F.array_sort(F.collect_set("language")).alias("languages"),
        )
    )
