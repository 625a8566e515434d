"""Registered queries: sources, symbols, style features, heuristic signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import heuristics, style, symbols, syntax
from ..operators.symbols import KEY
from ..session import scratch_dir
from ..sources import archives, directories, feature_store, reports
from ..sources import files as files_source
from . import oracle as o
from . import views
from .catalog import query
from .oracle import q, with_

RAW = o.base(views.MIXED_COLUMNS)


def long(name: str):
    return F.col(name).cast("bigint").alias(name)


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


@query("scan_files", with_(RAW) + " SELECT scan_id, file_path, strlen(content) AS size_bytes, "
       "sha256(content) AS content_sha256 FROM raw")
def _(spark, sf):
    # Every document as a file of a directory tree, listed and read back.
    root = scratch_dir(spark, "tree")
    directories.write_files(views.raw_files(spark, sf), root)
    read = files_source.scan_files(spark, root)
    return files_source.content_hash(read).select(*KEY, "size_bytes", "content_sha256")


@query("scan_supported_files", with_(RAW) + " SELECT scan_id, file_path, strlen(content) AS "
       "size_bytes FROM raw WHERE doc_id % 9 <> 8 AND doc_id % 10 <> 9 AND strlen(content) <= 4096")
def _(spark, sf):
    root = scratch_dir(spark, "tree")
    directories.write_files(views.raw_files(spark, sf), root)
    kept = files_source.scan_files(
        spark, root, supported_only=True, skip_vendor=True, max_bytes=4096
    )
    return kept.select(*KEY, "size_bytes")


@query("keep_supported", with_(RAW) + " SELECT scan_id, file_path, "
       f"lower({views.MIXED_EXT}) AS ext FROM raw WHERE doc_id % 9 <> 8")
def _(spark, sf):
    return files_source.keep_supported(views.raw_files(spark, sf)).select(*KEY, "ext")


@query("drop_vendor_dirs",
       with_(RAW) + " SELECT scan_id, file_path FROM raw WHERE doc_id % 10 <> 9")
def _(spark, sf):
    return files_source.drop_vendor_dirs(views.raw_files(spark, sf)).select(*KEY)


@query("drop_oversize", with_(RAW) + " SELECT scan_id, file_path, strlen(content) AS size_bytes "
       "FROM raw WHERE strlen(content) <= 4096")
def _(spark, sf):
    kept = files_source.drop_oversize(views.raw_files(spark, sf), 4096)
    return kept.select(*KEY, "size_bytes")


@query("drop_oversize_scans", with_(RAW) + " SELECT scan_id, file_path FROM raw WHERE scan_id IN "
       "(SELECT scan_id FROM raw GROUP BY 1 HAVING sum(strlen(content)) <= 125829)")
def _(spark, sf):
    return files_source.drop_oversize_scans(views.raw_files(spark, sf), 0.12).select(*KEY)


# Spaces become the three newline styles by id.
_BREAKS = ("CASE doc_id % 3 WHEN 0 THEN concat(chr(13), chr(10)) WHEN 1 THEN chr(13) "
           "ELSE chr(10) END")


@query("decode_text", with_(RAW) + " SELECT scan_id, file_path, "
       "sha256(replace(content, ' ', chr(10))) AS text_hash FROM raw")
def _(spark, sf):
    broken = views.raw_files(spark, sf).withColumn(
        "content", F.encode(F.expr(f"replace(content, ' ', {_BREAKS})"), "UTF-8")
    )
    return files_source.decode_text(broken).select(
        *KEY, F.sha2(F.col("content").cast("binary"), 256).alias("text_hash")
    )


@query("classify_input", "SELECT doc_id, "
       f"{views.UPLOAD_COLUMNS['name']} AS name, CASE WHEN doc_id % 8 IN (0, 1, 2) THEN 'archive' "
       "WHEN doc_id % 8 IN (3, 4) OR doc_id % 9 = 8 OR doc_id % 9 = 6 AND false THEN 'rejected' "
       "ELSE 'source' END AS kind FROM documents")
def _(spark, sf):
    names = views._select(
        views.table(spark, sf, "documents").select("doc_id"), views.UPLOAD_COLUMNS
    )
    return names.select(
        "doc_id", "name", files_source.classify_input(F.col("name")).alias("kind")
    )


@query("notebook_code", "SELECT source AS scan_id, "
       f"{views.NOTEBOOK_PATH} AS file_path, CASE WHEN doc_id % 5 = 0 THEN 'raw' ELSE "
       "sha256(concat(text, chr(10), chr(10), text, chr(10), chr(10))) END AS code_hash "
       "FROM documents")
def _(spark, sf):
    notebooks = files_source.notebook_code(views.notebooks(spark, sf))
    # The cut-off ones keep their raw text, which differs from any code text.
    digest = F.sha2(F.col("code").cast("binary"), 256)
    return notebooks.select(
        *KEY, F.when(F.col("code") == F.col("content"), "raw").otherwise(digest).alias("code_hash")
    )


@query("detect_language", with_(RAW) + f" SELECT scan_id, file_path, CASE WHEN doc_id % 9 = 8 "
       f"THEN 'unknown' ELSE {o.LANGUAGE} END AS language FROM raw")
def _(spark, sf):
    return files_source.detect_language(views.raw_files(spark, sf)).select(*KEY, "language")


@query("coerce_language", "SELECT doc_id, CASE doc_id % 9 WHEN 3 THEN 'java' WHEN 4 THEN 'go' "
       "WHEN 7 THEN 'r' ELSE 'unknown' END AS language FROM documents")
def _(spark, sf):
    upper = views.table(spark, sf, "documents").selectExpr(
        "doc_id", f"upper(substr({views.MIXED_EXT}, 2)) AS language"
    )
    return files_source.coerce_language(upper)


@query("corpus_totals", with_(*o.CODE, o.LINES) + " SELECT scan_id, count(DISTINCT file_path) "
       "AS total_files, count(*) AS total_lines, string_agg(DISTINCT language, ',' "
       "ORDER BY language) AS languages FROM lines GROUP BY 1")
def _(spark, sf):
    totals = files_source.corpus_totals(views.code(spark, sf))
    return totals.withColumn("languages", F.array_join("languages", ","))


@query("read_table_as_files", "SELECT split_part(split_part(url, '://', 2), '/', 1) AS scan_id, "
       "concat('page', page_id, '.html') AS file_path, strlen(html) AS size_bytes, "
       "sha256(html) AS content_hash FROM pages")
def _(spark, sf):
    pages = views.table(spark, sf, "pages")
    made = files_source.read_table_as_files(
        pages,
        F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)),
        F.concat(F.lit("page"), "page_id", F.lit(".html")),
        F.col("html"),
    )
    return made.select(
        *KEY, "size_bytes", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash")
    )


@query("read_conversations_as_files", "SELECT concat('conv', conv_id) AS scan_id, concat('turn', "
       "turn, '.md') AS file_path, 'markdown' AS language, length(text) - length(replace(text, "
       "chr(10), '')) + 1 AS line_count FROM conversations")
def _(spark, sf):
    turns = files_source.read_table_as_files(
        views.table(spark, sf, "conversations"),
        F.concat(F.lit("conv"), "conv_id"),
        F.concat(F.lit("turn"), "turn", F.lit(".md")),
        F.col("text"),
    )
    return symbols.file_profile(files_source.prepare(turns)).select(
        *KEY, "language", "line_count"
    )


@query("content_hash", with_(RAW) + " SELECT scan_id, file_path, sha256(content) "
       "AS content_sha256 FROM raw")
def _(spark, sf):
    return files_source.content_hash(views.raw_files(spark, sf)).select(*KEY, "content_sha256")


_NOW = "2024-01-30 23:00:00"


@query("expire_reports", with_(o.EVENTS) + " SELECT scan_id, epoch_us(max(ts)) AS generated_us "
       f"FROM scan_events GROUP BY 1 HAVING max(ts) > TIMESTAMP '{_NOW}' - INTERVAL 6 HOUR")
def _(spark, sf):
    live = reports.expire_reports(views.reports(spark, sf), f"{_NOW}Z", 6 * 3600)
    return live.select("scan_id", F.unix_micros("generated_at").alias("generated_us"))


@query("write_reports", with_(o.EVENTS) + " SELECT scan_id, epoch_us(max(ts)) AS generated_us, "
       "strftime(max(ts), '%Y-%m-%d') AS generated_date, count(*) AS events FROM scan_events "
       "GROUP BY 1")
def _(spark, sf):
    path = scratch_dir(spark, "reports")
    reports.write_reports(views.reports(spark, sf), path)
    return spark.read.parquet(path).select(
        "scan_id", F.unix_micros("generated_at").alias("generated_us"),
        F.col("generated_date").cast("string").alias("generated_date"), "events",
    )


@query("lookup_report", with_(o.EVENTS) + " SELECT scan_id, count(*) AS events FROM scan_events "
       "WHERE scan_id = '42' GROUP BY 1")
def _(spark, sf):
    path = scratch_dir(spark, "reports")
    reports.write_reports(views.reports(spark, sf), path)
    return reports.lookup_report(spark, path, "42").select("scan_id", "events")


@query("reports_as_json", with_(o.EVENTS) + " SELECT scan_id, concat('{\"scan_id\":\"', scan_id, "
       "'\",\"events\":', count(*), '}') AS report FROM scan_events GROUP BY 1")
def _(spark, sf):
    return reports.reports_as_json(views.reports(spark, sf).select("scan_id", "events"))


@query("feature_cache", "SELECT DISTINCT sha256(text) AS content_sha256, length(text) AS n_chars "
       "FROM documents")
def _(spark, sf):
    path = scratch_dir(spark, "features")
    hashed = files_source.content_hash(views.raw_files(spark, sf)).withColumn("code", F.col("content"))

    def compute(rows):
        return rows.select("content_sha256", F.length("code").cast("bigint").alias("n_chars"))

    # The first run fills the store from half of the scans; the second adds the rest.
    feature_store.feature_cache(hashed.where(F.col("scan_id").endswith("1")), path, compute)
    return feature_store.feature_cache(hashed, path, compute)


@query("explode_archives", "SELECT source AS scan_id, 'src/main.py' AS file_path, strlen(text) "
       "AS size_bytes, sha256(text) AS content_hash FROM documents")
def _(spark, sf):
    members = archives.explode_archives(views.archives(spark, sf))
    return members.select(*KEY, "size_bytes", F.sha2("content", 256).alias("content_hash"))


@query("blocked_members", "SELECT source AS scan_id, 'blocked' AS status, count(*) AS members "
       "FROM documents GROUP BY 1")
def _(spark, sf):
    return archives.blocked_members(views.archives(spark, sf))


# ---------------------------------------------------------------------------
# Symbols
# ---------------------------------------------------------------------------


@query("explode_lines", with_(*o.CODE, o.LINES) + " SELECT scan_id, file_path, line_no, line "
       "FROM lines")
def _(spark, sf):
    lines = symbols.explode_lines(views.code(spark, sf))
    return lines.select(*KEY, long("line_no"), "line")


@query("line_metrics", with_(*o.CODE, o.LINES, o.SOLID, o.PROFILE) + " SELECT scan_id, file_path, "
       "line_count, blank_lines, round(avg_line_length, 6) AS avg_line_length, max_line_length "
       "FROM profile")
def _(spark, sf):
    m = symbols.line_metrics(views.code(spark, sf))
    return m.withColumn("avg_line_length", F.round("avg_line_length", 6))


@query("comment_lines", with_(*o.CODE, o.LINES, o.COMMENTS) + " SELECT scan_id, file_path, "
       "comment_lines FROM files JOIN comments USING (doc_id)")
def _(spark, sf):
    return symbols.comment_lines(views.code(spark, sf))


_PARAMS = (
    "len(list_filter(string_split(params, ','), lambda p: trim(p) <> ''))"
)


@query("python_functions", with_(*o.CODE, o.LINES) + f" SELECT scan_id, file_path, name, line_no, "
       f"{_PARAMS} AS parameter_count FROM (SELECT *, regexp_extract(line, "
       f"{o.rx(symbols.PY_FUNCTION)}, 3) AS name, regexp_extract(line, "
       f"{o.rx(symbols.PY_FUNCTION)}, 4) AS params FROM lines WHERE {o.PYTHON} AND "
       f"{o.hits('line', symbols.PY_FUNCTION)})")
def _(spark, sf):
    found = symbols.python_functions(views.code(spark, sf))
    return found.select(*KEY, "name", long("line_no"), long("parameter_count"))


@query("js_functions", with_(*o.CODE, o.LINES) + " SELECT scan_id, file_path, "
       f"regexp_extract(line, {o.rx(symbols.JS_FUNCTION)}, 3) AS name, line_no, "
       f"0::BIGINT AS parameter_count FROM lines WHERE {o.JS} AND "
       f"{o.hits('line', symbols.JS_FUNCTION)}")
def _(spark, sf):
    found = symbols.js_functions(views.code(spark, sf))
    return found.select(*KEY, "name", long("line_no"), long("parameter_count"))


@query("class_counts", with_(*o.CODE, o.SYMBOL_COUNTS) + " SELECT scan_id, file_path, class_count "
       "FROM files JOIN symbol_counts USING (doc_id)")
def _(spark, sf):
    return symbols.class_counts(views.code(spark, sf))


@query("python_imports", with_(*o.CODE, o.LINES, o.PY_IMPORT_LINES, o.IMPORTS) + " SELECT scan_id, "
       "file_path, module, line_no, is_from FROM imports WHERE registry = 'pypi'")
def _(spark, sf):
    found = symbols.python_imports(views.code(spark, sf))
    return found.select(*KEY, "module", long("line_no"), "is_from")


@query("js_imports", with_(*o.CODE, o.LINES, o.PY_IMPORT_LINES, o.IMPORTS) + " SELECT scan_id, "
       "file_path, module, line_no, is_from FROM imports WHERE registry = 'npm'")
def _(spark, sf):
    found = symbols.js_imports(views.code(spark, sf))
    return found.select(*KEY, "module", long("line_no"), "is_from")


@query("type_hint_flag", with_(*o.CODE, o.SYMBOL_COUNTS) + " SELECT scan_id, file_path, "
       "has_type_hints FROM files JOIN symbol_counts USING (doc_id)")
def _(spark, sf):
    return symbols.type_hint_flag(views.code(spark, sf))


@query("function_count", with_(*o.CODE, o.SYMBOL_COUNTS) + " SELECT scan_id, file_path, "
       "function_count FROM files JOIN symbol_counts USING (doc_id)")
def _(spark, sf):
    return symbols.function_count(views.code(spark, sf))


@query("file_profile", with_(*o.CODE, o.LINES, o.SOLID, o.PROFILE, o.COMMENTS, o.SYMBOL_COUNTS,
                             o.PY_IMPORT_LINES, o.IMPORTS)
       + " SELECT p.scan_id, p.file_path, p.language, line_count, blank_lines, "
       "round(avg_line_length, 6) AS avg_line_length, max_line_length, comment_lines, class_count, "
       "function_count, coalesce(i.n, 0) AS import_count, has_type_hints FROM profile p "
       "JOIN comments USING (doc_id) JOIN symbol_counts USING (doc_id) LEFT JOIN "
       "(SELECT doc_id, count(*) AS n FROM imports GROUP BY 1) i USING (doc_id)")
def _(spark, sf):
    profile = symbols.file_profile(views.code(spark, sf))
    return profile.withColumn("avg_line_length", F.round("avg_line_length", 6))


# ---------------------------------------------------------------------------
# Style features
# ---------------------------------------------------------------------------


@query("explode_tokens", None)
def _(spark, sf):
    return syntax.explode_tokens(views.modules(spark, sf))


@query("explode_ast_nodes", None)
def _(spark, sf):
    return syntax.explode_ast_nodes(views.modules(spark, sf))


@query("token_bigrams", None)
def _(spark, sf):
    return syntax.token_bigrams(syntax.explode_tokens(views.modules(spark, sf)))


@query("shannon_entropy", with_(*o.CODE, o.ENTROPY) + " SELECT scan_id, file_path, "
       "round(coalesce(h, 0), 6) AS char_entropy FROM files LEFT JOIN entropy USING (doc_id)")
def _(spark, sf):
    files = heuristics.with_char_level(views.code(spark, sf), F.col("code"), F.lit(True))
    return files.select(
        *KEY, F.round(heuristics.LEVEL, 6).alias("char_entropy")
    )


@query("word_entropy", with_(*o.CODE, o.WORDS) + ", n AS (SELECT doc_id, w, count(*) AS n "
       "FROM words GROUP BY 1, 2) SELECT scan_id, file_path, round(coalesce(h, 0), 6) "
       "AS word_entropy FROM files LEFT JOIN (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / "
       "sum(n) AS h FROM n GROUP BY 1) USING (doc_id)")
def _(spark, sf):
    from ..functions import arrays

    entropy = arrays.symbol_entropy(text.words_of(F.col("code")))
    return views.code(spark, sf).select(*KEY, F.round(entropy, 6).alias("word_entropy"))


_LINE_FEATURES = [
    "avg_line_length", "max_line_length", "std_line_length", "blank_line_ratio",
    "avg_indentation", "max_indentation", "std_indentation", "trailing_whitespace_ratio",
    "comment_density", "inline_comment_ratio",
]
_INLINE = (
    f"rtrim(line, {o.SPACE}) <> '' AND NOT ltrim(line, {o.SPACE}) LIKE '#%' AND contains("
    f"regexp_replace(trim(line, {o.SPACE}), {q(chr(91) + chr(39) + chr(34) + chr(93))} || "
    f"{q('[^' + chr(39) + chr(34) + ']*(?:[' + chr(39) + chr(34) + ']|$)')}, '', 'g'), '#')"
)


@query("line_style_features", with_(*o.CODE, o.LINES, o.SOLID)
       + ", a AS (SELECT doc_id, avg(length(line)) AS avg_line_length, max(length(line)) "
       "AS max_line_length, stddev_samp(length(line)) AS std_line_length, count(*) AS n, "
       f"count(*) FILTER (WHERE {_INLINE}) AS inline FROM lines GROUP BY 1), "
       "b AS (SELECT doc_id, avg(indent) AS avg_indentation, max(indent) AS max_indentation, "
       "stddev_samp(indent) AS std_indentation, count(*) AS n, "
       f"count(*) FILTER (WHERE rtrim(line, {o.SPACE}) <> line) AS n_trailing, "
       f"count(*) FILTER (WHERE ltrim(line, {o.SPACE}) LIKE '#%') AS comments "
       "FROM solid GROUP BY 1) SELECT scan_id, file_path, "
       "round(avg_line_length, 6) AS avg_line_length, max_line_length::DOUBLE AS max_line_length, "
       "round(coalesce(std_line_length, 0), 6) AS std_line_length, "
       "round((a.n - coalesce(b.n, 0)) / a.n, 6) AS blank_line_ratio, "
       "round(coalesce(avg_indentation, 0), 6) AS avg_indentation, "
       "coalesce(max_indentation, 0)::DOUBLE AS max_indentation, "
       "round(coalesce(std_indentation, 0), 6) AS std_indentation, "
       "round(coalesce(n_trailing, 0) / greatest(coalesce(b.n, 0), 1), 6) "
       "AS trailing_whitespace_ratio, round(coalesce(comments, 0) / a.n, 6) AS comment_density, "
       "round(inline / a.n, 6) AS inline_comment_ratio "
       "FROM files JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)")
def _(spark, sf):
    rows = views.code(spark, sf).select(*KEY, style.line_features(F.col("code")).alias("f"))
    return rows.select(*KEY, "f.*").select(*KEY, *[r6(c) for c in _LINE_FEATURES])


@query("style_features", None)
def _(spark, sf):
    return style.features_batch(views.modules(spark, sf))


# Closed form: k generated functions, one closing statement by id, comments.
_K = "(doc_id % 3)"
_COMMENTED = "(length(text) - length(replace(text, chr(10), '')) + 1)"


@query("syntax_shape", "SELECT source AS scan_id, concat(source, '/src/m', doc_id, '.py') "
       f"AS file_path, {_K}::DOUBLE AS num_functions, CASE WHEN doc_id % 7 = 6 THEN 1.0 ELSE 0.0 "
       f"END AS num_classes, 2.0 AS import_count, CASE WHEN {_K} > 0 THEN 2.0 WHEN doc_id % 7 = 2 "
       f"THEN 1.0 ELSE 0.0 END AS max_nesting_depth, CASE WHEN {_K} > 0 THEN 1.0 ELSE 0.0 END "
       f"AS has_docstrings, 1.0 + {_K} * 4 + CASE WHEN doc_id % 7 = 2 THEN 1 ELSE 0 END "
       f"AS cyclomatic_complexity, CASE WHEN {_K} > 0 THEN 5.0 ELSE 0.0 END "
       "AS avg_function_complexity FROM documents")
def _(spark, sf):
    rows = style.style_features(views.modules(spark, sf))
    return rows.select(
        *KEY, "num_functions", "num_classes", "import_count", "max_nesting_depth",
        "has_docstrings", "cyclomatic_complexity", "avg_function_complexity",
    )


@query("clean_features", "SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 0.0 ELSE n_chars * 1.0 "
       "END AS x FROM documents")
def _(spark, sf):
    dirty = views.table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("n_chars") % 6 == 0, F.lit(float("nan")))
        .when(F.col("n_chars") % 3 == 0, F.lit(float("-inf")))
        .otherwise(F.col("n_chars").cast("double")).alias("x"),
    )
    return style.clean_features(dirty, ["x"])


# ---------------------------------------------------------------------------
# Heuristic
# ---------------------------------------------------------------------------

_SIGNALS = list(heuristics.SIGNAL_WEIGHTS)
_ROUNDED = ", ".join(f"round({s}, 6) AS {s}" for s in _SIGNALS)


@query("heuristic_signals", with_(*o.CODE, *o.HEURISTIC)
       + f" SELECT scan_id, file_path, {_ROUNDED} FROM scored")
def _(spark, sf):
    rows = heuristics.heuristic_signals(views.code(spark, sf))
    return rows.select(*KEY, "signals.*").select(*KEY, *[r6(s) for s in _SIGNALS])


@query("heuristic_signals_plain", with_(*o.PLAIN, *o.HEURISTIC)
       + f" SELECT scan_id, file_path, {_ROUNDED} FROM scored")
def _(spark, sf):
    rows = heuristics.heuristic_signals(views.files(spark, sf))
    return rows.select(*KEY, "signals.*").select(*KEY, *[r6(s) for s in _SIGNALS])


@query("heuristic_score", with_(*o.CODE, *o.HEURISTIC)
       + " SELECT scan_id, file_path, round(heuristic, 6) AS ai_probability FROM scored")
def _(spark, sf):
    rows = heuristics.heuristic_score(views.code(spark, sf))
    return rows.select(*KEY, r6("ai_probability"))

