"""Derived views that give the test tables code-like content.

The view bodies are SQL text that Spark and the checking engine both accept,
so both sides start from the same rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from ..sources.files import prepare

BITS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Extension of a document by id; every document is a supported file outside skipped folders.
_EXT = (
    "CASE doc_id % 9 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.java' "
    "WHEN 4 THEN '.go' WHEN 5 THEN '.md' WHEN 6 THEN '.ipynb' WHEN 7 THEN '.R' ELSE '{}' END"
)
EXT = _EXT.format(".rs")
PATH = f"concat(source, '/src/f', doc_id, {EXT})"

# The same with unsupported files and skipped folders, for the operators that drop them.
MIXED_EXT = _EXT.format(".bin")
MIXED_DIR = "CASE WHEN doc_id % 10 = 9 THEN 'vendor' ELSE 'src' END"
MIXED_PATH = f"concat(source, '/', {MIXED_DIR}, '/f', doc_id, {MIXED_EXT})"

# Extra lines by document id: imports, code shapes, one risky line.
IMPORT_LINES = (
    "CASE WHEN doc_id % 9 = 0 THEN concat('import os, pkg_', doc_id % 50, '.sub as p', chr(10), "
    "'from pkg_', (doc_id * 7) % 50, ' import thing') "
    "WHEN doc_id % 9 IN (1, 2) THEN concat('import thing from ''pkg_', doc_id % 50, '''', "
    "chr(10), 'import ''./local''', chr(10), 'import {a, b} from \"pkg_', (doc_id * 3) % 50, "
    "'\"') END"
)
CODE_LINES = (
    "CASE doc_id % 7 "
    "WHEN 0 THEN '# ----- section -----' "
    "WHEN 1 THEN concat('# Step 1 load', chr(10), '// step 2 run') "
    "WHEN 2 THEN concat('// Validate a', chr(10), '// Validate b', chr(10), '// ensure c') "
    "WHEN 3 THEN concat('/** @param a */', chr(10), 'function f_', doc_id, '(a) { return a }', "
    "chr(10), 'export class Box { }') "
    "WHEN 4 THEN concat('# TODO: tidy', chr(10), 'logger.info(x) # note') "
    "WHEN 5 THEN concat('def f(a: int, b):', chr(10), '    \"\"\"doc\"\"\"', chr(10), chr(10), "
    "'    return a', chr(10), chr(10), 'async def g( ):', chr(10), '    pass', chr(10), chr(10), "
    "'class Thing:', chr(10), '    size: int = 3') END"
)
RISKY_LINES = (
    "CASE doc_id % 5 "
    "WHEN 0 THEN 'p = f\"hello {user_name}\"' "
    "WHEN 1 THEN 'exec(result)' "
    "WHEN 2 THEN '  r = openai.chat.create(model)' "
    "WHEN 3 THEN 'temperature = 1.5' END"
)
FILE_COLUMNS = {
    "scan_id": "source", "file_path": PATH, "doc_id": "doc_id", "content": "text",
}
MIXED_COLUMNS = {**FILE_COLUMNS, "file_path": MIXED_PATH}
CODE_COLUMNS = {
    **FILE_COLUMNS,
    "content": f"concat_ws(chr(10), {IMPORT_LINES}, {CODE_LINES}, {RISKY_LINES}, text)",
}
EVENT_COLUMNS = {
    "scan_id": "CAST(user_id AS VARCHAR(20))",
    "event_id": "event_id",
    "ts": "ts",
    "status": (
        "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'cloning' WHEN 'click' "
        "THEN 'authorship' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"
    ),
    "error": "CASE WHEN event_type = 'error' THEN props END",
}


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{body} AS {name}" for name, body in columns.items())


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(
        table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id"
    )


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{body} AS {name}" for name, body in columns.items()])


def _as_files(df: DataFrame) -> DataFrame:
    return df.withColumn("size_bytes", F.octet_length("content").cast("bigint"))


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of supported and other kinds, nothing added or filtered."""
    return _as_files(_select(_documents(spark, sf_dir), MIXED_COLUMNS))


def raw_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with imports, code shapes and risky lines in front."""
    return _as_files(_select(_documents(spark, sf_dir), CODE_COLUMNS))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(_as_files(_select(_documents(spark, sf_dir), FILE_COLUMNS)))


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(raw_code(spark, sf_dir))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The two registry names are a literal list, so this is no pairing of tables.
    part = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0")
    return part.select(
        F.explode(F.array(F.lit("pypi"), F.lit("npm"))).alias("registry"),
        F.concat(F.lit("pkg_"), "p_partkey").alias("package"),
    )


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier keys stand in for authors."""
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("author"), "s_suppkey").alias("author_id"),
        F.concat(F.lit("s"), F.col("s_suppkey") % 3).alias("salt"),
    )


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared documents marked for ``author{doc_id % 4}``; every third is not."""
    from ..operators.watermark import embed_watermark

    base = files(spark, sf_dir).withColumn(
        "author_id",
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("author"), F.col("doc_id") % 4)),
    )
    return embed_watermark(base, authors(spark, sf_dir), BITS)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans with an even number claim author 0 and author 1."""
    scans = table(spark, sf_dir, "documents").select(F.col("source").alias("scan_id")).distinct()
    even = F.regexp_extract("scan_id", "([0-9]+)$", 1).cast("int") % 2 == 0
    claimed = scans.where(even).select(
        "scan_id", F.explode(F.array(F.lit("author0"), F.lit("author1"))).alias("author_id")
    )
    number = F.regexp_extract("author_id", "([0-9]+)$", 1).cast("int")
    return claimed.withColumn("salt", F.concat(F.lit("s"), (number % 3).cast("string")))


def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_utc_time(_select(table(spark, sf_dir, "events"), EVENT_COLUMNS))


def with_utc_time(events: DataFrame) -> DataFrame:
    """The zone-less ``ts`` read as UTC, whatever the session's zone is."""
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts"))
    return events.withColumn("ts", local.cast("timestamp"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: label 1 is low quality, problem_id is the source."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return labels.join(documents, "doc_id").select(
        "doc_id",
        F.col("text").alias("code"),
        (1 - F.col("quality")).cast("int").alias("label"),
        F.col("source").alias("problem_id"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' deterministic scores for the labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    both = labels.join(documents, "doc_id").select(
        "doc_id",
        F.col("toxic").cast("int").alias("label"),
        F.explode(
            F.array(
                F.struct(
                    F.lit("boosted").alias("model"),
                    (F.col("n_chars") % 97 / 96.0).alias("probability"),
                ),
                F.struct(
                    F.lit("forest").alias("model"),
                    (F.col("n_chars") % 13 / 12.0).alias("probability"),
                ),
            )
        ).alias("m"),
    )
    return both.select("doc_id", "label", "m.model", "m.probability")


# Python programs that parse: the text becomes comments below generated code.
MODULE_BLOCK = (
    "concat('def work(a, b):', chr(10), '    \"\"\"doc\"\"\"', chr(10), '    for i in a:', chr(10), "
    "'        if i and b:', chr(10), '            b = b + 1  # step', chr(10), "
    "'    return [x for x in b]', chr(10))"
)
MODULE_TAIL = (
    "CASE doc_id % 7 WHEN 0 THEN 'eval(result)' "
    "WHEN 1 THEN 'x = client.chat.completions.create(model, temperature=1)' "
    "WHEN 2 THEN concat('try:', chr(10), '    x = client.chat.completions.create(m)', chr(10), "
    "'except ValueError:', chr(10), '    pass') "
    "WHEN 3 THEN 'p = f\"hi {user_name}\"' "
    "WHEN 4 THEN '\"{}\".format(value)' "
    "WHEN 5 THEN 'openai.api_key = \"abc\"' ELSE 'class Box: pass' END"
)
MODULE_COLUMNS = {
    **FILE_COLUMNS,
    "file_path": "concat(source, '/src/m', doc_id, '.py')",
    "content": (
        f"concat('import os', chr(10), 'from pkg import thing', chr(10), "
        f"repeat({MODULE_BLOCK}, CAST(doc_id % 3 AS INT)), {MODULE_TAIL}, chr(10), '# ', "
        "replace(text, chr(10), concat(chr(10), '# ')))"
    ),
}


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(_as_files(_select(_documents(spark, sf_dir), MODULE_COLUMNS)))


# JavaScript lines for the two JavaScript rules.
JS_TAIL = (
    "CASE doc_id % 4 WHEN 0 THEN 'const p = base + userName;' "
    "WHEN 1 THEN concat('const q = `ask $', '{req.body}`;') "
    "WHEN 2 THEN 'const r = a + b;' ELSE concat('const s = `$', '{total}`;') END"
)
SCRIPT_COLUMNS = {
    **FILE_COLUMNS,
    "file_path": "concat(source, '/src/s', doc_id, '.ts')",
    "content": f"concat({JS_TAIL}, chr(10), '// ', replace(text, chr(10), concat(chr(10), '// ')))",
}


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(_as_files(_select(_documents(spark, sf_dir), SCRIPT_COLUMNS)))


# Model replies about documents: good, unknown severity, not a list, not JSON.
REPLY_COLUMNS = {
    "scan_id": "source",
    "file_path": PATH,
    "doc_id": "doc_id",
    "reply": (
        "CASE doc_id % 4 WHEN 0 THEN concat('[{\"line\": ', doc_id % 90 + 1, "
        "', \"severity\": \"low\", \"category\": \"jailbreak_risk\", \"message\": \"m', doc_id, "
        "'\", \"fix\": \"f\"}, {\"line\": 2}]') "
        "WHEN 1 THEN '[{\"line\": 1, \"severity\": \"severe\"}]' "
        "WHEN 2 THEN '{\"line\": 1}' ELSE 'no findings' END"
    ),
}


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return _select(documents, REPLY_COLUMNS)


# Upload names of every kind.
UPLOAD_COLUMNS = {
    "doc_id": "doc_id",
    "name": (
        f"concat('Up', doc_id, CASE doc_id % 8 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '.ZIP' "
        f"WHEN 2 THEN '.7z' WHEN 3 THEN '.exe' WHEN 4 THEN '' ELSE {MIXED_EXT} END)"
    ),
}

NOTEBOOK_PATH = "concat(source, '/src/n', doc_id, '.ipynb')"


def notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks whose code cells hold the document once as a list of lines and
    once as a string; every fifth is cut off and no valid JSON."""
    documents = _documents(spark, sf_dir)
    lines = F.split("text", "\n", -1)
    with_breaks = F.transform(
        lines, lambda x, i: F.when(i < F.size(lines) - 1, F.concat(x, F.lit("\n"))).otherwise(x)
    )
    as_list = F.to_json(with_breaks)
    single = F.to_json(F.array("text"))
    as_string = F.expr("substring(s, 2, length(s) - 2)")
    body = documents.withColumn("l", as_list).withColumn("s", single).withColumn("s", as_string)
    doc = F.concat(
        F.lit('{"cells":[{"cell_type":"markdown","source":'), "s",
        F.lit('},{"cell_type":"code","source":'), "l",
        F.lit('},{"cell_type":"code","source":'), "s", F.lit('},{"cell_type":"code"}]'),
        F.when(F.col("doc_id") % 5 != 0, F.lit("}")).otherwise(F.lit("")),
    )
    return _as_files(
        body.select(
            F.col("source").alias("scan_id"), F.expr(NOTEBOOK_PATH).alias("file_path"),
            "doc_id", doc.alias("content"),
        )
    )


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One zip per document: the text, and a member that tries to escape."""
    @F.pandas_udf("binary")
    def zipped(texts: pd.Series) -> pd.Series:
        import io
        import zipfile

        def pack(text: str) -> bytes:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("src/main.py", text)
                archive.writestr("../escape.py", "x = 1")
            return buffer.getvalue()

        return texts.map(pack)

    return _documents(spark, sf_dir).select(
        F.col("source").alias("scan_id"),
        F.concat("source", F.lit("/a"), "doc_id", F.lit(".zip")).alias("file_path"),
        zipped("text").alias("content"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per event user, stamped with the user's last event."""
    return scan_events(spark, sf_dir).groupBy("scan_id").agg(
        F.max("ts").alias("generated_at"), F.count("*").alias("events")
    )
