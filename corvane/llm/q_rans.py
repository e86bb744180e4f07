"""Query of operator 9: write every document's ids as coded blocks, read the files back, and report digests."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvane.llm._shared import table
from corvane.llm.rans import read_digests, write_ids


def op9_token_id_output(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    out, _ = write_ids(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))
    return read_digests(spark, out)
