"""Languages: what extensions they have and how their files are parsed."""

from __future__ import annotations

import os
import threading
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial

from srcgraph.schema import LANGUAGES
from srcgraph.sources import extract

#: text -> (symbols, imports), as ``extract.parse`` gives them
Parser = Callable[[str], tuple[list[dict], list[dict]]]


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    parse: Parser


class Registry:
    """Languages by name and by extension; scans take a registry with them to the executors."""

    def __init__(self, languages: Iterable[Language] = ()):
        self._lock = threading.Lock()
        self._languages: dict[str, Language] = {}
        self._extensions: dict[str, str] = {}
        for one in languages:
            self.register(one)

    def __getstate__(self) -> tuple[dict[str, Language], dict[str, str]]:
        with self._lock:
            return dict(self._languages), dict(self._extensions)

    def __setstate__(self, state: tuple[dict[str, Language], dict[str, str]]) -> None:
        self._lock = threading.Lock()
        self._languages, self._extensions = state

    def register(self, language: Language) -> None:
        """Add a language, or take the place of the one of its name; a later language takes over an extension."""
        with self._lock:
            self._languages[language.name] = language
            self._extensions |= {e.lower(): language.name for e in language.extensions}

    def get(self, name: str) -> Language | None:
        with self._lock:
            return self._languages.get(name)

    def detect(self, path: str) -> str | None:
        """The language of a path by its extension, whatever its case."""
        extension = os.path.splitext(os.path.basename("x" + path))[1].lower()
        with self._lock:
            return self._extensions.get(extension)

    def supported(self) -> list[str]:
        with self._lock:
            return sorted(self._languages)


def built_in() -> Registry:
    by: dict[str, list[str]] = {}
    for extension, name in LANGUAGES.items():
        by.setdefault(name, []).append(extension)
    return Registry(Language(n, tuple(e), partial(extract.parse, language=n)) for n, e in by.items())


DEFAULT = built_in()
