"""The training-corpus pipeline: five of the operators in ``corvane.llm``, each over all that the one before it kept.

1. language ID: learns from the rows that have a language, and drops documents of unknown language (no letter at all).
2. line dedup: lines of at least 40 characters in at least 5 documents stay in one of them only.
3. SimHash near-dedup: five-word shingles, similarity 0.8 or more; the least doc_id of each group stays.
4. benchmark decontamination: documents that hold a benchmark item (similarity 0.8 or more) go.
5. BPE encoding and decoding: adds the id list, its length and whether decoding gives the text back.

Every stage returns the columns of ``documents`` (the last one adds ``ids``, ``n_tokens`` and ``round_trip``, in place of columns
named so); ``n_chars`` follows the text. Columns beyond those pass through, whatever their names. Null texts have no letter and go in the first stage. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._shared import discard, saved, table, temporary_tables
from corvane.llm.bpe import bpe_decode, bpe_encode
from corvane.llm.decontam import remove_contaminated
from corvane.llm.langid import keep_known, train_languages
from corvane.llm.linededup import drop_lines
from corvane.llm.simhash import keep_first_of_groups

TOKENIZER = "byte_bpe_50k.json"


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name in docs.columns:
        name += "_"
    return name


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known(docs, train_languages(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    info = _unused(docs, "line_dedup")
    return drop_lines(docs, info_col=info).drop(info).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first_of_groups(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    decoded = _unused(docs, "decoded")
    coded = bpe_decode(bpe_encode(docs, path), path, text_col=decoded)
    whole = F.col(decoded) == F.coalesce("text", F.lit(""))
    return coded.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("round_trip", whole).drop(decoded)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither the classifiers nor the fingerprints; tests hold the rows against a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = docs
        with temporary_tables() as held:
            docs = stage(spark, before, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
            discard(*held, before)
    return docs
