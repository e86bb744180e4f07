"""URL normalisation, crawl scope and page identity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import unquoted

#: Suffixes of files that are not HTML, unsupported link schemes, and HTML media types.
NON_HTML_SUFFIXES = (
    ".7z .avi .css .csv .doc .docx .epub .gif .gz .ico .jpeg .jpg .js .json .mp3 .mp4 .pdf .png .ppt .pptx .svg .tar .tgz "
    ".txt .webp .xls .xlsx .xml .zip"
).split()
UNSUPPORTED_SCHEMES = ("mailto:", "tel:", "javascript:", "data:")
HTML_TYPES = ("text/html", "application/xhtml+xml")

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def _scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def _raw_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def _quoted(path: Column) -> Column:
    """Percent-encoding that keeps ``/%:@-._~``."""
    kept = F.url_encode(path)
    for code, plain in (("+", "%20"), ("%2F", "/"), ("%25", "%"), ("%3A", ":"), ("%40", "@"), ("%7E", "~"), ("*", "%2A")):
        kept = F.replace(kept, F.lit(code), F.lit(plain))
    return kept


def _plain_segments(path: Column) -> Column:
    """Empty and ``.`` segments removed; a final slash stays."""
    kept = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(path.endswith("/") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def normalised(url: Column, retain_query: bool = False) -> Column:
    """Fetch identity of an HTTP(S) URL; null if it is none, has user information, or climbs with ``..``."""
    authority = F.regexp_extract(url, _AUTHORITY, 1)
    host = F.lower(F.regexp_extract(authority, r"^([^:@]*)", 1))
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    scheme = _scheme(url)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    decoded = unquoted(_raw_path(url))
    ok = scheme.isin("http", "https") & (host != "") & ~authority.contains("@") & ~F.array_contains(F.split(F.replace(decoded, F.lit("\\"), F.lit("/")), "/"), "..")
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1) if retain_query else F.lit("")
    return F.when(ok, F.concat(scheme, F.lit("://"), host, F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)), _quoted(_plain_segments(decoded)), query))


def boundary(url: Column) -> Column:
    """The directory of a start URL, which bounds its crawl."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"[^/]*$", "")


def in_scope(url: Column, boundaries: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, boundaries)), lambda b: F.startswith(url, b))


def is_html_candidate(url: Column) -> Column:
    """False for paths with a suffix of ``NON_HTML_SUFFIXES``."""
    name = F.regexp_extract(unquoted(_raw_path(url)), r"([^/]*)/*$", 1)
    suffix = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    return ~suffix.isin(NON_HTML_SUFFIXES)


def is_html_type(content_type: Column) -> Column:
    return F.lower(F.btrim(F.substring_index(content_type, ";", 1))).isin(*HTML_TYPES)


def logical_path(url: Column) -> Column:
    """``netloc/path``, with ``index.html`` for a directory."""
    path = F.ltrim(unquoted(_raw_path(url)), F.lit("/"))
    return F.concat(F.regexp_extract(url, _AUTHORITY, 1), F.lit("/"), path, F.when((path == "") | path.endswith("/"), F.lit("index.html")).otherwise(F.lit("")))


def is_external(url: Column, boundaries: list[str]) -> Column:
    """True for unsupported schemes and for absolute URLs beyond the crawl's scope."""
    lowered = F.lower(F.trim(url))
    unsupported = F.exists(F.array(*map(F.lit, UNSUPPORTED_SCHEMES)), lambda s: F.startswith(lowered, s))
    plain = normalised(url)
    return unsupported | (plain.isNotNull() & ~in_scope(plain, boundaries))


def source_url(base: str, path: Column) -> Column:
    """URL of a safe relative path below ``base``; an unsafe path raises."""
    parts = F.split(path, "/")
    unsafe = (path == "") | path.startswith("/") | path.contains("\\") | F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.when(unsafe, F.raise_error(F.concat(F.lit("unsafe logical path: "), path))).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), _quoted(path)))


def with_anchor(url: Column, anchor: Column) -> Column:
    return F.when(F.coalesce(anchor, F.lit("")) == "", url).otherwise(F.concat(F.substring_index(url, "#", 1), F.lit("#"), F.replace(F.url_encode(anchor), F.lit("+"), F.lit("%20"))))
