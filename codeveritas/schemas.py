"""Explicit table schemas and the fixed enumerations behind them."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# enumerations
# ---------------------------------------------------------------------------

SEVERITIES = ["critical", "high", "medium", "low", "info"]

SEVERITY_PENALTY = {"critical": 25.0, "high": 15.0, "medium": 8.0, "low": 3.0, "info": 1.0}

CATEGORIES = [
    "hallucinated_dependency", "prompt_injection", "insecure_llm_call",
    "unvalidated_ai_output", "jailbreak_risk", "hardcoded_secret",
    "missing_error_handling",
]

INPUT_TYPES = ["github_url", "zip_upload", "file_upload"]

# Stage -> progress in percent, in life-cycle order.
STAGE_PROGRESS = {
    "queued": 0.0, "cloning": 10.0, "parsing": 20.0, "authorship": 40.0,
    "findings": 65.0, "watermark": 85.0, "scoring": 95.0, "completed": 100.0,
}
TERMINAL_STAGES = ["completed", "failed"]

# Stage -> the coarser step a progress bar shows.
STAGE_STEP = {
    "queued": "queued", "cloning": "ingesting", "parsing": "ingesting",
    "authorship": "analyzing", "findings": "analyzing", "watermark": "analyzing",
    "scoring": "scoring", "completed": "completed", "failed": "completed",
}
STEPS = ["queued", "ingesting", "analyzing", "scoring", "completed"]

# ---------------------------------------------------------------------------
# Languages by file extension (lower case)
# ---------------------------------------------------------------------------

EXTENSIONS_BY_LANGUAGE = {
    "python": [".py", ".pyw", ".pyi", ".ipynb"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "typescript": [".ts", ".tsx"],
    "java": [".java"],
    "kotlin": [".kt", ".kts"],
    "scala": [".scala"],
    "groovy": [".groovy"],
    "go": [".go"],
    "rust": [".rs"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".hpp"],
    "csharp": [".cs"],
    "swift": [".swift"],
    "dart": [".dart"],
    "objective-c": [".m", ".mm"],
    "ruby": [".rb"],
    "php": [".php"],
    "lua": [".lua"],
    "perl": [".pl"],
    "r": [".r"],
    "shell": [".sh", ".bash", ".zsh"],
    "powershell": [".ps1"],
    "batch": [".bat", ".cmd"],
    "html": [".html", ".htm"],
    "css": [".css"],
    "scss": [".scss"],
    "sass": [".sass"],
    "less": [".less"],
    "vue": [".vue"],
    "svelte": [".svelte"],
    "json": [".json"],
    "yaml": [".yaml", ".yml"],
    "toml": [".toml"],
    "xml": [".xml"],
    "ini": [".ini", ".cfg"],
    "sql": [".sql"],
    "markdown": [".md"],
    "restructuredtext": [".rst"],
    "terraform": [".tf"],
    "hcl": [".hcl"],
    "dockerfile": [".dockerfile"],
}
LANGUAGES = [*EXTENSIONS_BY_LANGUAGE, "unknown"]
LANGUAGE_BY_EXTENSION = {
    ext: language for language, exts in EXTENSIONS_BY_LANGUAGE.items() for ext in exts
}
SOURCE_EXTENSIONS = list(LANGUAGE_BY_EXTENSION)

ARCHIVE_EXTENSIONS = [
    ".zip", ".rar", ".7z", ".tar", ".gz", ".tgz", ".tar.gz", ".tar.bz2", ".bz2",
    ".xz", ".tar.xz",
]

SKIPPED_DIRECTORIES = [
    "node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next",
    ".tox", ".eggs", "vendor", "third_party", ".ipynb_checkpoints",
]

MAX_FILE_BYTES = 500 * 1024
MAX_SCAN_MEGABYTES = 500
REPORT_TTL_SECONDS = 3600

# ---------------------------------------------------------------------------
# Tables
# ---------------------------------------------------------------------------

FILES = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("content", T.StringType()),
])

REGISTRY = T.StructType([
    T.StructField("registry", T.StringType()),
    T.StructField("package", T.StringType()),
])

FINDING = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("line_start", T.IntegerType()),
    T.StructField("line_end", T.IntegerType()),
    T.StructField("message", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("fix_suggestion", T.StringType()),
])

FINDINGS = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    *FINDING.fields,
])

EXTERNAL_FINDING = T.ArrayType(T.StructType([
    T.StructField("line", T.IntegerType()),
    T.StructField("severity", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("fix", T.StringType()),
]))

SAMPLES = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("problem_id", T.StringType()),
])

SCAN_EVENTS = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])
