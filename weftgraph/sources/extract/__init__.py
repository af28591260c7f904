"""Source text -> symbols and edges, by language."""

from __future__ import annotations

from collections.abc import Callable

from .builder import Builder
from .golang import extract_go
from .python import extract_python
from .ruby import extract_ruby
from .rust import extract_rust
from .script import extract_script

Extractor = Callable[[str, str], Builder]

EXTRACTORS: dict[str, Extractor] = {
    "python": extract_python,
    "javascript": extract_script,
    "typescript": extract_script,
    "tsx": extract_script,
    "rust": extract_rust,
    "go": extract_go,
    "ruby": extract_ruby,
}


def register_extractor(language: str, extractor: Extractor) -> None:
    """Adds a language or replaces one: extractor(source, path) returns a filled Builder."""
    EXTRACTORS[language] = extractor
