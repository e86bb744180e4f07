"""Site configuration: strict TOML, and the registry of loaders and parsers."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path

from corvane.operators.html import ParserSettings

#: Which parser may read which loader's pages.
PAIRS = {("local_html_tree", "sphinx"), ("zip_html", "generic"), ("zip_html", "sphinx"), ("bounded_http", "generic")}
PARSERS = {"generic": ParserSettings(), "sphinx": ParserSettings(sphinx=True)}
_ALLOWED = {"site_id": str, "base_url": str, "loader": str, "parser": str, "chunk_size": int, "chunk_overlap": int, "max_pages": int, "include_prefixes": list}
_BOUNDS = {"chunk_size": (1, 100_000), "chunk_overlap": (0, 99_999), "max_pages": (1, 1_000_000)}


@dataclass(frozen=True)
class SiteConfig:
    site_id: str
    base_url: str
    loader: str
    parser: str
    chunk_size: int = 1000
    chunk_overlap: int = 150
    max_pages: int = 1000
    include_prefixes: tuple[str, ...] = ("",)

    @property
    def parser_settings(self) -> ParserSettings:
        return PARSERS[self.parser]


def load_config(path: str | Path) -> SiteConfig:
    """A config file; unknown keys, wrong types, values out of bounds and unknown pairs raise ``ValueError``."""
    raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    if unknown := set(raw) - set(_ALLOWED):
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    for key, value in raw.items():
        if not isinstance(value, _ALLOWED[key]) or isinstance(value, bool):
            raise ValueError(f"{key} must be {_ALLOWED[key].__name__}")
        low, high = _BOUNDS.get(key, (None, None))
        if low is not None and not low <= value <= high:
            raise ValueError(f"{key} must be from {low} to {high}")
    if "include_prefixes" in raw:
        raw["include_prefixes"] = tuple(raw["include_prefixes"])
    try:
        config = SiteConfig(**raw)
    except TypeError as e:
        raise ValueError(str(e)) from e
    if (config.loader, config.parser) not in PAIRS:
        raise ValueError(f"parser {config.parser} does not read loader {config.loader}")
    if config.chunk_overlap >= config.chunk_size:
        raise ValueError("chunk_overlap must be smaller than chunk_size")
    return config
