"""Recursive text splitting into overlapping pieces, with offsets, and its invariants."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corvane.functions.text import canonical_sha256, text_sha256
from corvane.operators.scan import text_batches

#: Separators from coarse to fine; the empty one splits characters.
SEPARATORS = ("\n\n", "\n", "。", "、", " ", "")
SIZE, OVERLAP = 1000, 150


def _spans(text: str, begin: int, end: int, size: int, separators: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """Cuts a span at the first separator it holds, which stays with the piece after it; long pieces are cut further."""
    if end - begin <= size:
        yield begin, end
        return
    nth = next(k for k, s in enumerate(separators) if not s or text.find(s, begin, end) >= 0)
    sep, finer = separators[nth], separators[nth + 1 :]
    if not sep:
        yield from ((k, k + 1) for k in range(begin, end))
        return
    at = begin
    while at < end:
        cut = text.find(sep, at + len(sep) if text.startswith(sep, at) else at, end)
        cut = end if cut < 0 else cut
        if cut - at <= size:
            yield at, cut
        else:
            yield from _spans(text, at, cut, size, finer)
        at = cut


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, int]]:
    """(piece, offset) of a text: pieces of at most ``size`` characters that share up to ``overlap`` with the one before."""
    if len(text) <= size:
        return [(text, 0)] if text.strip() else []
    out: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    for span in _spans(text, 0, len(text), size, SEPARATORS):
        if held and span[1] - held[0][0] > size:
            out.append((held[0][0], held[-1][1]))
            while held and (held[-1][1] - held[0][0] > overlap or span[1] - held[0][0] > size):
                held.pop(0)
        held.append(span)
    if held:
        out.append((held[0][0], held[-1][1]))
    pieces = []
    for begin, end in out:
        piece = text[begin:end]
        lead = len(piece) - len(piece.lstrip())
        if piece := piece.strip():
            pieces.append((piece, begin + lead))
    return pieces


PIECES = "array<struct<text:string,start_index:int>>"
_PIECES = pa.list_(pa.struct([("text", pa.string()), ("start_index", pa.int32())]))


def pieces_column(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("need size >= 1 and 0 <= overlap < size")

    @arrow_udf(PIECES)
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[{"text": p, "start_index": at} for p, at in split_text(t or "", size, overlap)] for t in batch.to_pylist()], _PIECES)

    return split(text)


def chunk_sections(sections: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Sections to chunks: chunk_index and start_index within the stripped section; blank sections give none."""
    bare = sections.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where(F.col("text") != "")
    text_batches(sections.sparkSession)
    rows = bare.select("*", F.posexplode(pieces_column(F.col("text"), size, overlap)).alias("__index", "__piece"))
    kept = [c for c in sections.columns if c not in ("text", "chunk_index", "start_index")]
    return rows.select(*kept, F.col("__piece.text").alias("text"), F.col("__index").alias("chunk_index"), F.col("__piece.start_index").alias("start_index"))


def parent_id() -> Column:
    """Stable id of a chunk as a parent, from its citation key."""
    return canonical_sha256(source_url=F.col("source_url"), chunk_index=F.col("chunk_index"), start_index=F.col("start_index"))


#: The fields that name a section.
SECTION_FIELDS = ("anchor", "category", "page_title", "python_version", "section_title", "source_path", "source_url")


def section_id() -> Column:
    """Stable id of a section, from its fields other than the text."""
    return canonical_sha256(**{n: F.col(n) for n in SECTION_FIELDS})


def child_chunks(parents: DataFrame, size: int = 400, overlap: int = 100) -> DataFrame:
    """Children of parent chunks, with the mapping to them."""
    text_batches(parents.sparkSession)
    cut = parents.select("position", "source_url", "page_title", "section_title", "category", parent_id().alias("parent_id"), text_sha256(F.col("text")).alias("parent_text_sha256"), F.posexplode(pieces_column(F.col("text"), size, overlap)).alias("child_index", "piece"))
    return cut.select("parent_id", "parent_text_sha256", F.col("position").alias("parent_position"), "source_url", "page_title", "section_title", "category", "child_index", F.col("piece.start_index").alias("child_start_index"), F.col("piece.text").alias("text"))


def mapping_summary(children: DataFrame) -> DataFrame:
    """Parents, children, and children a parent on average and at most."""
    per = children.groupBy("parent_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("parent_count"), F.sum("n").alias("child_count"), F.avg("n").alias("average_children"), F.max("n").alias("maximum_children"))


def chunk_violations(texts: DataFrame, chunks: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """Counts that must be zero: pieces off their place or too long, ordinals with gaps, and uncovered non-blank text."""
    met = chunks.join(texts.select(key, F.col("text").alias("whole")), key)
    placed = F.substr("whole", F.col("start_index") + 1, F.length("text")) == F.col("text")
    by = Window.partitionBy(key).orderBy("chunk_index")
    seen = F.max(F.col("start_index") + F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(F.col("start_index") > F.coalesce(seen, F.lit(0)), F.substr("whole", F.coalesce(seen, F.lit(0)) + 1, F.col("start_index") - F.coalesce(seen, F.lit(0))))
    checked = met.select((~placed).alias("misplaced"), (F.length("text") > size).alias("too_long"), (F.col("chunk_index") != F.row_number().over(by) - 1).alias("bad_ordinal"), (F.coalesce(F.regexp_replace(gap, r"(?U)\s+", ""), F.lit("")) != "").alias("uncovered"))
    return checked.agg(*(F.count_if(c).alias(c) for c in ("misplaced", "too_long", "bad_ordinal", "uncovered")))
