"""The index tokens of one text in Python, counted: what ``text.unfolded_tokens`` and ``text.folded`` give as rows.

A text's names are counted first, so only distinct ones are taken apart, and the forms of frequent names are remembered.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

from corvane.functions import text as T

_NAMES = re.compile(T.IDENTIFIER).findall
_RUNS = re.compile(T.JAPANESE_RUN).findall
_COMPOUND = re.compile(T.COMPOUND).search
_SUBSCRIPT = re.compile(r"\[[0-9]+\]$")


def unfolded_variants(name: str) -> list[str]:
    """``text.unfolded_variants`` of one name."""
    call = name.endswith("()")
    bare = name[:-2] if call else name
    plain = _SUBSCRIPT.sub("", bare)
    parts = plain.split(".")
    suffixes = [".".join(parts[i:]) for i in range(len(parts))]
    called = [form for s in suffixes for form in (s, s + "()")] if call else suffixes
    return list(dict.fromkeys([name, bare, plain, *called, *parts]))


@functools.lru_cache(maxsize=1 << 16)
def name_forms(name: str) -> tuple[str, ...]:
    """The tokens that one occurrence of a name stands for; equal forms may repeat."""
    out = []
    for form in unfolded_variants(name) if _COMPOUND(name) else (name,):
        out.append(form)
        if (low := form.lower()) != form:
            out.append(low)
    return tuple(out)


def names(text: str) -> Counter[str]:
    """Every identifier of a text with its number."""
    return Counter(_NAMES(text))


def grams(text: str, sizes: tuple[int, ...]) -> Counter[str]:
    """Every n-gram of the text's Japanese runs with its number."""
    out: Counter[str] = Counter()
    if sizes and not text.isascii():
        for run in _RUNS(text):
            for n in sizes:
                out.update(run[i : i + n] for i in range(len(run) - n + 1))
    return out


def counted(text: str, sizes: tuple[int, ...]) -> dict[str, int]:
    """Every index token of a text with its number."""
    out: dict[str, int] = dict(grams(text, sizes))
    for name, n in names(text).items():
        for form in name_forms(name):
            out[form] = out.get(form, 0) + n
    return out


def symbols(text: str) -> dict[str, int]:
    """Every variant of the text's identifiers, once."""
    return {form: 1 for name in names(text) for form in name_forms(name)}
