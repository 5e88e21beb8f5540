"""Lexers and recursive-descent parsers that say whether a source file is syntactically valid."""

from fathomgrid.llm.syntax.check import LANGUAGES, language_of, parse

__all__ = ["LANGUAGES", "language_of", "parse"]
