"""A training-text pipeline of five stages over `documents`.

Every stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns a
DataFrame; the caller writes it as Parquet and reads it back as the next stage's input.  All but
the last return the columns they got.  A stage begins by removing the intermediate tables of the one
before it, whose result has been written by then; so the disk holds those of one stage.  Nulls, repeated rows, empty texts and empty tables follow
the docstrings of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeveritas.llm import decontaminate, jaccard_join, mixing, suffix_dedup, toxicity
from codeveritas.llm.base import table
from codeveritas.session import drop_scratch, scratch_made, write_and_read


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col="toxicity score").filter("`toxicity score` < 0.5").select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near duplicates."""
    return jaccard_join.one_of_each(docs)


def substrings_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that strings of 100 bytes repeat; n_chars counted anew."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = suffix_dedup.dedup(docs, carry=carry, with_text=True)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hit") == 0).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of the documents that the mix takes words of."""
    return mixing.mix(docs).filter("taken > 0")


#: Intermediate tables of the stage that ran last.
_LEFT: list[str] = []

#: Bytes of an Arrow batch, set for the session: Spark's own limit lets a batch of texts, its arrays and
#: their copies take several hundred MB of an executor with two tasks.
BATCH_BYTES = 16 << 20


def _tidy(stage, first: bool = False):
    """The stage, after the tables that the stage before has left, unless `docs` is read from them."""

    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        if not first:
            drop_scratch(spark, _LEFT, docs)
        before = set(scratch_made())
        out = stage(spark, docs, sf_dir)
        _LEFT[:] = [path for path in scratch_made() if path not in before]
        return out

    return staged


STAGES = [
    ("toxicity", _tidy(toxicity_stage, first=True)),
    ("ngram_jaccard_join", _tidy(near_duplicates_stage)),
    ("suffix_array_dedup", _tidy(substrings_stage)),
    ("benchmark_decontamination", _tidy(decontamination_stage)),
    ("mixing", _tidy(mixing_stage)),
]

#: A trained model decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
