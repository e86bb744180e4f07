"""Which texts hold which passages, as a join on anchors.

A passage that is a substring of a text brings its inner words with it, whole and in order: those between its first and last
white space. So each passage is looked for by one run of ``RUN`` inner words only, the one that the fewest texts have; texts
meet it by an equality join of hashes, and what meets is verified by ``contains``. Passages with fewer inner words use one of
them, and those with none a run of their first characters, which texts give at every place.

Scale: texts are read once for their runs, of which only those of some passage are kept, and once more for the verification
of candidates. Nothing is broadcast but what was counted to be small. A run that very many texts hold is the anchor of those
passages alone that have no rarer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import scratch
from corvane.operators.retrieve import small

RUN = 3
#: Fixed value: the white space that parts words here.
SPACE = r"[ \t\n\x0B\f\r]+"
#: How many first characters stand for a passage without inner words: the largest of these that it has.
PREFIXES = (32, 8, 3, 1)


def word_runs(words: Column, n: int) -> Column:
    """A hash of each run of ``n`` words."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(n), *(F.get(words, i + k) for k in range(n))))


def character_runs(text: Column, n: int) -> Column:
    """A hash of the ``n`` characters from each place of a text."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(-n), F.substr(text, i, F.lit(n))))


def passage_runs(passages: DataFrame) -> DataFrame:
    """passage_id, kind, run: what each passage (passage_id, passage) may be looked for by; ``kind`` is n, or -n of characters."""
    inner = F.split("passage", SPACE)
    rows = passages.where(F.col("passage") != "").withColumn("inner", F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0))))
    kind = F.when(F.size("inner") >= RUN, RUN).when(F.size("inner") >= 1, 1)
    short = F.coalesce(*(F.when(F.length("passage") >= n, -n) for n in PREFIXES))
    rows = rows.withColumn("kind", F.coalesce(kind, short))
    runs = F.when(F.col("kind") == RUN, word_runs(F.col("inner"), RUN)).when(F.col("kind") == 1, word_runs(F.col("inner"), 1))
    for n in PREFIXES:
        runs = runs.when(F.col("kind") == -n, F.array(F.xxhash64(F.lit(-n), F.left("passage", F.lit(n)))))
    return rows.select("passage_id", "kind", F.explode(F.array_distinct(runs)).alias("run"))


def containing(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """passage_id, position of every text (position, text) that holds a passage (passage_id, passage), each pair once.

    Ids and positions are keys. An empty or null passage is in no text.
    """
    asked = scratch.written(passage_runs(passages), "passage-runs")
    kinds = sorted(r["kind"] for r in asked.select("kind").distinct().collect())  # a handful
    if not kinds:
        return asked.select("passage_id").join(texts.select("position").limit(0))
    words = texts.select("position", "text", F.split("text", SPACE).alias("words"))
    of_kind = [word_runs(F.col("words"), n) if n > 0 else character_runs(F.col("text"), -n) for n in kinds]
    runs = words.select("position", F.explode(F.concat(*of_kind) if len(of_kind) > 1 else of_kind[0]).alias("run"))
    held = scratch.written(runs.join(small(asked.select("run").distinct()), "run", "left_semi").distinct(), "held-runs")
    counts = held.groupBy("run").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("passage_id").orderBy(F.coalesce("n", F.lit(0)), "run")
    # A passage with a run that no text has is in none.
    known = asked.join(counts, "run", "left").withColumn("nth", F.row_number().over(rarest))
    anchors = known.where("nth = 1 AND n IS NOT NULL").select("passage_id", "run")
    met = scratch.written(held.join(small(anchors), "run").select("passage_id", "position"), "candidates")
    whole = met.join(passages.select("passage_id", "passage"), "passage_id")
    return texts.select("position", "text").join(small(whole), "position").where(F.contains("text", F.col("passage"))).select("passage_id", "position")
