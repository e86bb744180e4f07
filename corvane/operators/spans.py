"""Paragraphs as rows, their interval join with matches, and windows that grow by paragraphs under a budget.

A section is a table of paragraph spans. Matches meet the paragraphs within their reach by a binned range join: both sides
list the bins of ``BIN`` characters that they touch, an equality join brings them together, and a pair counts in the first
bin that both touch only. So the join goes by (section, bin), however many paragraphs or matches a section has, and a match
never meets a paragraph that its budget can't reach.

Growth takes the side whose next paragraph adds less (the earlier one on ties) until a side's next doesn't fit, then goes on
with the other. That order of two lists is the order of their running maxima, so two running sums find the window: up to the
first paragraph that doesn't fit, and from there those of the other side alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corvane.functions import prompts as P
from corvane.operators.context import paragraph_spans

BIN = 4096
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def spans_column(text: Column) -> Column:
    """The paragraph spans of a text; none of a null."""

    @arrow_udf("array<struct<start:bigint,end:bigint>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[{"start": a, "end": b} for a, b in paragraph_spans(t)] if t is not None else [] for t in batch.to_pylist()], _SPANS)

    return spans(text)


def paragraphs(sections: DataFrame, key: str = "section_id", text_col: str = "text") -> DataFrame:
    """key, nth (from 0), start, end of every paragraph."""
    return sections.select(key, F.posexplode(spans_column(F.col(f"`{text_col}`"))).alias("nth", "span")).select(key, "nth", "span.start", "span.end")


def _bins(start: Column, end: Column) -> Column:
    """The bins that a span touches; an empty span touches that of its start."""
    return F.sequence(F.floor(start / BIN), F.floor(F.greatest(end - 1, start) / BIN))


def overlapping(spans: DataFrame, matches: DataFrame, key: str = "section_id") -> DataFrame:
    """Rows of ``spans`` (key, start, end, ...) and ``matches`` (key, begin, until, ...) with start < until and begin < end,
    each pair once."""
    left = spans.withColumn("__bin", F.explode(_bins(F.col("start"), F.col("end"))))
    right = matches.withColumn("__bin", F.explode(_bins(F.col("begin"), F.col("until"))))
    met = left.join(right, [key, "__bin"])
    once = F.col("__bin") == F.greatest(F.floor(F.col("start") / BIN), F.floor(F.col("begin") / BIN))
    return met.where(once & (F.col("start") < F.col("until")) & (F.col("begin") < F.col("end"))).drop("__bin")


def grown_windows(sections: DataFrame, matches: DataFrame, key: str = "section_id", text_col: str = "text") -> DataFrame:
    """match_id, start, end, scope of each match (match_id, key, match_start, match_end, room).

    ``room`` is how many characters there are for this text. A section that fits is taken whole (``full_section``), else the
    match grows by whole paragraphs (``section_window``); where its own paragraphs don't fit, it is the bare match, and where
    that doesn't either, there is no row. Match ids are keys. A match out of its text, empty, or in no paragraph raises an
    error when the row is read.
    """
    length = sections.select(key, F.length(F.col(f"`{text_col}`")).cast("long").alias("length"))
    sized = matches.join(length, key)
    whole = sized.where("length <= room").select("match_id", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), F.lit("full_section").alias("scope"))
    rest = sized.where("length > room")
    inside = (F.col("match_start") >= 0) & (F.col("match_end") <= F.col("length")) & (F.col("match_start") < F.col("match_end"))
    # A window of ``room`` characters that holds the match reaches no farther, and the paragraphs at its ends start before that.
    reach = rest.select(
        "match_id", key, "room", F.when(inside, F.col("match_start")).otherwise(F.raise_error(F.lit("a match must lie in its text")).cast("long")).alias("match_start"), "match_end",
        F.greatest(F.lit(0), F.col("match_start") - F.col("room")).alias("begin"), F.least("length", F.col("match_end") + F.col("room")).alias("until"),
    )
    of_match = Window.partitionBy("match_id")
    near = overlapping(paragraphs(sections, key, text_col), reach, key)
    held = (F.col("start") < F.col("match_end")) & (F.col("match_start") < F.col("end"))
    near = near.withColumn("held", held).withColumn("low", F.min(F.when(F.col("held"), F.col("start"))).over(of_match)).withColumn("high", F.max(F.when(F.col("held"), F.col("end"))).over(of_match))
    near = near.withColumn("low", F.when(F.col("low").isNull(), F.raise_error(F.lit("no paragraph holds the match")).cast("long")).otherwise(F.col("low")))
    # Each further paragraph adds what lies between its far end and the one before it.
    side = F.when(F.col("held"), -1).when(F.col("start") < F.col("low"), 0).otherwise(1)
    near = near.withColumn("side", side).withColumn("away", F.when(F.col("side") == 0, F.col("low") - F.col("start")).when(F.col("side") == 1, F.col("end") - F.col("high")).otherwise(F.lit(0)))
    outward = Window.partitionBy("match_id", "side").orderBy("away")
    near = near.withColumn("adds", F.col("away") - F.coalesce(F.lag("away").over(outward), F.lit(0)))
    near = near.withColumn("turn", F.max("adds").over(outward.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("side") >= 0) | (F.col("start") == F.col("low")))
    near = near.withColumn("base", F.col("high") - F.col("low"))
    order = of_match.orderBy("turn", "side", "away")
    size = F.col("base") + F.sum("adds").over(order.rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("turn", F.when(F.col("side") < 0, F.lit(0)).otherwise(F.col("turn"))).withColumn("fits", size <= F.col("room"))
    # A taken paragraph has only taken ones before it; the first that doesn't fit ends its side.
    first = F.min_by(F.when(~F.col("fits"), F.col("side")), F.when(~F.col("fits"), F.struct("turn", "side", "away"))).over(of_match)
    near = near.withColumn("ended", first).withColumn("more", ~F.col("fits") & (F.col("side") != F.col("ended")))
    taken_other = F.max(F.when(F.col("fits") & (F.col("side") == F.col("ended")), F.col("away"))).over(of_match)
    near = near.withColumn("other", F.coalesce(taken_other, F.lit(0)))
    taken = F.col("fits") | (F.col("more") & (F.col("base") + F.col("other") + F.col("away") <= F.col("room")))
    grown = near.groupBy("match_id", "match_start", "match_end", "room", "low", "high", "base").agg(
        F.coalesce(F.max(F.when(taken & (F.col("side") == 0), F.col("away"))), F.lit(0)).alias("left"), F.coalesce(F.max(F.when(taken & (F.col("side") == 1), F.col("away"))), F.lit(0)).alias("right"),
    )
    fits = F.col("base") <= F.col("room")
    windows = grown.where(fits | (F.col("match_end") - F.col("match_start") <= F.col("room"))).select(
        "match_id", F.when(fits, F.col("low") - F.col("left")).otherwise(F.col("match_start")).cast("long").alias("start"),
        F.when(fits, F.col("high") + F.col("right")).otherwise(F.col("match_end")).cast("long").alias("end"), F.lit("section_window").alias("scope"),
    )
    return whole.unionByName(windows)


def room_left(question: Column, selected: Column, page_title: Column, section_title: Column, budget: int) -> Column:
    """The characters that a text may have, as one more context after those ``selected`` (structs with page_title,
    section_title, text), so that the first and the repair prompt keep to ``budget``. Negative where even none fits.

    It counts text as prompts show it, so sections and matches are those of ``text.sanitised`` texts.
    """
    parts = lambda c: F.struct(c["page_title"].alias("page_title"), c["section_title"].alias("section_title"), c["text"].alias("text"))
    one = F.struct(page_title.alias("page_title"), section_title.alias("section_title"), F.lit("").alias("text"))
    contexts = P.prompt_contexts(F.concat(F.transform(selected, parts), F.array(one)))
    longest = F.greatest(F.length(P.generation_prompt(question, contexts)), F.length(P.regeneration_prompt(question, contexts)))
    return (F.lit(budget) - longest).cast("long")
