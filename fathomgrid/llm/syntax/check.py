"""Files by extension, and their faults."""

from __future__ import annotations

import sys
from dataclasses import dataclass

from fathomgrid.llm.syntax.ecma import EcmaLexer, EcmaParser
from fathomgrid.llm.syntax.golang import GoLexer, GoParser
from fathomgrid.llm.syntax.java import JavaLexer, JavaParser
from fathomgrid.llm.syntax.php import PhpLexer, PhpParser
from fathomgrid.llm.syntax.python import PythonLexer, PythonParser
from fathomgrid.llm.syntax.ruby import RubyLexer, RubyParser
from fathomgrid.llm.syntax.rust import RustLexer, RustParser


class TypeParser(EcmaParser):
    typed = True


LANGUAGES = {
    "py": ("python", PythonLexer, PythonParser), "ts": ("typescript", EcmaLexer, TypeParser), "js": ("javascript", EcmaLexer, EcmaParser), "go": ("go", GoLexer, GoParser),
    "java": ("java", JavaLexer, JavaParser), "rs": ("rust", RustLexer, RustParser), "php": ("php", PhpLexer, PhpParser), "rb": ("ruby", RubyLexer, RubyParser),
}


@dataclass(frozen=True)
class Parsed:
    """language: of the file's extension, None where it has no grammar here. errors: (line, cause) of all faults, in order."""

    language: str | None
    errors: tuple[tuple[int, str], ...] = ()

    @property
    def valid(self) -> bool:
        return not self.errors


def language_of(path: str | None) -> str | None:
    """The extension's language, as a key of LANGUAGES."""
    ext = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if path else ""
    return ext if ext in LANGUAGES else None


def parse(path: str | None, content: str | None) -> Parsed:
    """All faults of a file. A null or empty file has none, a leading byte-order mark is no part of it, and a file of an unknown extension isn't judged. Nesting may be of any depth."""
    ext = language_of(path)
    if ext is None:
        return Parsed(None)
    name, lexer, parser = LANGUAGES[ext]
    text = (content or "").removeprefix("﻿")
    if not text.strip():
        return Parsed(name)
    limit = sys.getrecursionlimit()
    try:
        # rules call less than 200 of each other for one character that nests; such calls take no room on the system's stack
        sys.setrecursionlimit(min(2**31 - 1, max(limit, 20_000 + 200 * len(text))))
        faults = parser(lexer(text).run()).program()
    finally:
        sys.setrecursionlimit(limit)
    return Parsed(name, tuple(sorted({(f.line, f.cause) for f in faults})))
