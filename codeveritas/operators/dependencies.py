"""Imports checked against a snapshot of the public package registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import hot_key_parts
from .symbols import KEY

# Standard-library modules that are never looked up.
PYTHON_STDLIB = [
    "os", "sys", "re", "json", "math", "datetime", "collections", "functools", "itertools",
    "pathlib", "typing", "abc", "io", "hashlib", "logging", "unittest", "dataclasses", "enum",
    "asyncio", "contextlib", "copy", "csv", "http", "urllib", "socket", "threading",
    "subprocess", "shutil", "tempfile", "textwrap", "time", "uuid", "warnings", "zipfile",
    "argparse", "configparser", "email", "html", "xml", "sqlite3", "string", "struct",
    "traceback", "pickle", "pprint", "inspect",
]
UNKNOWN_PENALTY = 0.10


def lookup_name(registry: Column, module: Column) -> Column:
    """PyPI knows packages by their root, npm by the whole module string."""
    return F.when(registry == "pypi", F.substring_index(module, ".", 1)).otherwise(module)


def root_package(imports: DataFrame) -> DataFrame:
    return imports.withColumn("package", lookup_name(F.col("registry"), F.col("module")))


def skip_stdlib(imports: DataFrame) -> DataFrame:
    known = (F.col("registry") == "pypi") & F.col("package").isin(PYTHON_STDLIB)
    return imports.where(~known)


def skip_relative(imports: DataFrame) -> DataFrame:
    local = F.col("module").startswith(".") | F.col("module").startswith("/")
    return imports.where(~((F.col("registry") == "npm") & local))


def checkable(imports: DataFrame) -> DataFrame:
    return skip_relative(skip_stdlib(root_package(imports)))


def unknown_packages(imports: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct imported packages that their registry does not list.

    Distinct first: however often one package is imported, the lookup sees it
    once.  A registry without any snapshot row reports nothing (fail open).
    """
    snapshot = registry.select("registry", "package").distinct()
    covered = snapshot.select("registry").where(F.col("registry").isin("pypi", "npm")).distinct()
    # Two rows at most, so their side may be broadcast.
    wanted = checkable(imports).select("registry", "package").distinct().join(
        F.broadcast(covered), "registry", "left_semi"
    )
    return wanted.join(snapshot, ["registry", "package"], "left_anti")


def unknown_dependencies(imports: DataFrame, registry: DataFrame) -> DataFrame:
    """Every import occurrence of an unknown package.

    The join back is salted on the occurrence side, so one package imported by
    a third of all files is spread over many tasks; the other side is a
    list of distinct names, repeated once per salt.
    """
    salts = hot_key_parts(imports)
    unknown = unknown_packages(imports, registry).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    salted = checkable(imports).withColumn(
        "salt", F.pmod(F.xxhash64("file_path", "line_no"), F.lit(salts)).cast("int")
    )
    hits = salted.join(unknown, ["registry", "package", "salt"], "left_semi")
    return hits.select(*KEY, F.col("module").alias("package_name"), "line_no", "registry")


def penalised(probability: Column, unknown_imports: Column) -> Column:
    raised = F.least(
        F.lit(1.0), probability + F.coalesce(unknown_imports, F.lit(0)) * UNKNOWN_PENALTY
    )
    return F.greatest(F.lit(0.0), raised)


def dependency_penalty(files: DataFrame, unknown: DataFrame) -> DataFrame:
    """Raises ``ai_probability`` by 0.10 per unknown import occurrence."""
    per_file = unknown.groupBy(*KEY).agg(F.count("*").alias("unknown_imports"))
    return (
        files.join(per_file, KEY, "left")
        .withColumn("unknown_imports", F.coalesce("unknown_imports", F.lit(0)).cast("bigint"))
        .withColumn(
            "ai_probability", penalised(F.col("ai_probability"), F.col("unknown_imports"))
        )
    )
