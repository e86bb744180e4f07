"""Selecting evidence under a budget of tokens, which don't add up over the parts of a prompt.

A chunk stays, in rank order, iff every prompt with it and those before it that stayed has at most ``budget`` tokens. The
provider counts the tokens of whole prompts; each step of the fold counts those of all questions of an Arrow batch at once.
``context.select_within_budget`` is the same with a character as a token, as a JVM expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from corvane.functions import prompts as P
from corvane.functions import text as T

Counter = Callable[[list[str]], list[int]]
Prompt = Callable[[str, list[dict]], str]


def _shown(contexts: list[dict]) -> tuple[str, str]:
    labels = ", ".join(f"[{c['label']}]" for c in contexts)
    return labels, "\n\n".join(f"[{c['label']}]\n{P.PAGE}{c['page_title']}{P.SECTION}{c['section_title']}{P.BODY}{c['text']}" for c in contexts)


def generation_text(question: str, contexts: list[dict], scope: str = T.SCOPE) -> str:
    """``prompts.generation_prompt`` of sanitised values."""
    labels, blocks = _shown(contexts)
    return f"あなたは{scope}に基づいて回答します。\n{P.ONLY_THESE}{P.LABELS}{labels}\n{P.CITE_AFTER}{''.join(P.RULES)}{P.QUESTION}{question}{P.SOURCES}{blocks}{P.ANSWER}"


def regeneration_text(question: str, contexts: list[dict]) -> str:
    """``prompts.regeneration_prompt`` of sanitised values."""
    labels, blocks = _shown(contexts)
    return f"{P.FAILED_BEFORE}{P.ONLY_THESE}{P.LABELS}{labels}\n{P.CITE_AT_LEAST}{''.join(P.RULES)}{P.QUESTION}{question}{P.SOURCES}{blocks}{P.FIXED_ANSWER}"


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


def library_counter(path: str) -> Callable[[], Counter]:
    """The provider over a file of the tokenizers library, which every node has; special tokens don't count."""
    return lambda: lambda texts: [len(x.ids) for x in _library(path).encode_batch(texts, add_special_tokens=False)]


def select_by_tokens(rows: DataFrame, budget: int, counter: Callable[[], Counter], prompts: tuple[Prompt, ...] = (generation_text, regeneration_text)) -> DataFrame:
    """query_id, question, selected, fits from rows of ``context.gathered``; ``counter`` is made once in each worker's batch stream.

    ``fits`` is false where no chunk fits although there are some. A null question counts as empty.
    """

    @arrow_udf("array<int>")
    def kept(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        count = counter()
        for questions, contexts in batches:
            asked, shown = [q or "" for q in questions.to_pylist()], [c or [] for c in contexts.to_pylist()]
            held: list[list[int]] = [[] for _ in asked]
            for nth in range(max(map(len, shown), default=0)):
                tried = [k for k, c in enumerate(shown) if nth < len(c)]
                # Labels go by the place among the chunks that stay.
                lists = [[shown[k][i] | {"label": f"S{n}"} for n, i in enumerate([*held[k], nth], 1)] for k in tried]
                sizes = iter(count([prompt(asked[k], some) for k, some in zip(tried, lists, strict=True) for prompt in prompts]))
                for k in tried:
                    if max(next(sizes) for _ in prompts) <= budget:
                        held[k].append(nth)
            yield pa.array(held, pa.list_(pa.int32()))

    found = rows.withColumn("__kept", kept(T.sanitised(F.col("question")), P.prompt_contexts(F.col("chunks"))))
    selected = F.transform("__kept", lambda i: F.get(F.col("chunks"), i))
    return found.select("query_id", "question", selected.alias("selected"), (F.size("__kept") > 0).alias("fits"))
