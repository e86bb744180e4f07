"""Query of operator 8: fingerprint and component of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm._shared import table
from corvane.llm.simhash import fingerprint_hex, simhash_components


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id (least doc_id reachable by links) of every document."""
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", fingerprint_hex(out["node"]).alias("fingerprint"), "component_id")
