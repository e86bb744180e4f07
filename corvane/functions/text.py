"""Identifiers, n-grams, tokens, prompt sanitising and hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shapes of identifiers, Japanese runs, URLs, paths and citations, and the redaction marks.
IDENTIFIER = r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*(?:\[[0-9]+\])?(?:\(\))?"
JAPANESE_RUN = "[぀-ヿ㐀-䶿一-鿿々〆ヵヶー]+"
URL = r"(?i)(?:https?://|ftp://|www\.)\S+"
POSIX_PATH = r"(?<![A-Za-z0-9_])/(?:[A-Za-z0-9._~+-]+/)+[A-Za-z0-9._~%+-]+"
WINDOWS_PATH = r"(?i)(?<![A-Za-z0-9_])[A-Z]:\\(?:[^\\\s]+\\)+[^\\\s]+"
URL_MARK = "[URL除去済み]"
PATH_MARK = "[パス除去済み]"
PAGE_LABEL, SECTION_LABEL, BODY_LABEL = "ページタイトル: ", "セクションタイトル: ", "本文: "
SCOPE = "Python 3.13日本語公式ドキュメント"


def identifiers(text: Column) -> Column:
    """Every identifier of a text, in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def distinct_identifiers(text: Column) -> Column:
    """Identifiers in order of first appearance."""
    return F.array_distinct(identifiers(text))


def _with_folded(variants: Column) -> Column:
    """Each variant followed by its lower-case form where that differs; equal forms may repeat."""
    return F.flatten(F.transform(variants, lambda v: F.when(F.lower(v) != v, F.array(v, F.lower(v))).otherwise(F.array(v))))


COMPOUND = r"[.\[(]"


def unfolded_variants(name: Column) -> Column:
    """Call, subscript, qualified-suffix and part forms of one identifier, each once."""
    call = name.endswith("()")
    bare = F.when(call, F.left(name, F.length(name) - 2)).otherwise(name)
    plain = F.regexp_replace(bare, r"\[[0-9]+\]$", "")
    parts = F.split(plain, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    called = F.when(call, F.flatten(F.transform(suffixes, lambda s: F.array(s, F.concat(s, F.lit("()")))))).otherwise(suffixes)
    return F.array_distinct(F.concat(F.array(name, bare, plain), called, parts))


def identifier_variants(name: Column) -> Column:
    """The forms of one identifier, each followed by its lower-case form where that differs."""
    return F.when(name.rlike(COMPOUND), _with_folded(unfolded_variants(name))).otherwise(_with_folded(F.array(name)))


def unfolded_tokens(text: Column, sizes: tuple[int, ...]) -> Column:
    """The index tokens of a text before lower-casing, in any order: only compound identifiers go through lambdas."""
    names = identifiers(text)
    simple = F.filter(names, lambda n: ~n.rlike(COMPOUND))
    compound = F.flatten(F.transform(F.filter(names, lambda n: n.rlike(COMPOUND)), unfolded_variants))
    return F.concat(simple, compound, character_ngrams(text, sizes))


def folded(token: Column) -> Column:
    """A token, and its lower-case form where that differs."""
    return F.when(F.lower(token) != token, F.array(token, F.lower(token))).otherwise(F.array(token))


def character_ngrams(text: Column, sizes: tuple[int, ...]) -> Column:
    """All n-grams of each Japanese run, by size and then by place."""
    def grams(run: Column, n: int) -> Column:
        starts = F.when(F.length(run) >= n, F.sequence(F.lit(1), F.length(run) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(run, i, F.lit(n)))

    runs = F.regexp_extract_all(text, F.lit(JAPANESE_RUN), F.lit(0))
    return F.flatten(F.transform(runs, lambda run: F.concat(*(grams(run, n) for n in sizes))))


def tokens(text: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Index tokens: variants of every identifier, then character n-grams."""
    return F.concat(F.flatten(F.transform(identifiers(text), identifier_variants)), character_ngrams(text, sizes))


def searchable_text(page_title: Column, section_title: Column, text: Column) -> Column:
    """The labelled text that is indexed, embedded and reranked."""
    return F.concat(F.lit(PAGE_LABEL), page_title, F.lit("\n" + SECTION_LABEL), section_title, F.lit("\n" + BODY_LABEL), text)


def unquoted(text: Column) -> Column:
    """Percent-decoding that keeps ``+`` as it is."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def symbol_fields(page_title: Column, section_title: Column, url: Column, text: Column) -> Column:
    """The text whose identifiers make a chunk's symbol record."""
    path = F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit(""))
    fragment = F.coalesce(F.parse_url(url, F.lit("REF")), F.lit(""))
    return F.concat_ws("\n", page_title, section_title, unquoted(F.concat(path, F.lit(" "), fragment)), text)


def symbols(fields: Column) -> Column:
    """Distinct variants of all identifiers of ``symbol_fields``."""
    return F.array_distinct(F.flatten(F.transform(distinct_identifiers(fields), identifier_variants)))


def normal_space(text: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def folded_fact(text: Column) -> Column:
    """Case-insensitive, white-space-normal form of a fact."""
    return normal_space(F.lower(F.replace(F.replace(text, F.lit("ẞ"), F.lit("ss")), F.lit("ß"), F.lit("ss"))))


def sanitised(text: Column) -> Column:
    """URLs, then Windows paths, then POSIX paths, become marks."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, URL, URL_MARK), WINDOWS_PATH, PATH_MARK), POSIX_PATH, PATH_MARK)


def document_scope(text: Column | None) -> Column:
    """One-line, sanitised label of a knowledge base; blank is an error."""
    if text is None:
        return F.lit(SCOPE)
    line = normal_space(sanitised(text))
    return F.when(line == "", F.raise_error(F.lit("document_scope must not be blank"))).otherwise(line)


def text_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def canonical_json(**fields: Column) -> Column:
    """One JSON object with sorted keys, no spaces and nulls kept."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def canonical_sha256(**fields: Column) -> Column:
    return text_sha256(canonical_json(**fields))


def page_of(url: Column) -> Column:
    """URL without its fragment."""
    return F.substring_index(url, "#", 1)
