"""The languages by file extension, with their tables built once a process."""

from __future__ import annotations

from hunkmill.llm.parsing import java_lang, javascript_lang, json_lang, python_lang
from hunkmill.llm.parsing.tables import Parser, Tables

#: Extension (lower case) -> language.
EXTENSIONS = {".py": "python", ".js": "javascript", ".java": "java", ".json": "json"}
_MODULES = {"python": python_lang, "javascript": javascript_lang, "java": java_lang, "json": json_lang}
_parsers: dict[str, Parser] = {}


def parser(language: str) -> Parser:
    if language not in _parsers:
        tables = Tables(_MODULES[language].GRAMMAR)
        if language == "javascript":
            _parsers[language] = Parser(tables, javascript_lang.FIRST, javascript_lang.VIRTUAL, javascript_lang.CLOSERS)
        else:
            _parsers[language] = Parser(tables)
    return _parsers[language]


def first_error(language: str, body: str) -> tuple[int, str] | None:
    """None if ``body`` parses in ``language``; else (line, token kind) of the first token that no parse can take."""
    tokens = _MODULES[language].tokens
    return parser(language).error((lambda can: tokens(body, can)) if language == "javascript" else tokens(body))
