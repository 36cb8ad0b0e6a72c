"""Table-driven parsers of source code, from bundled grammars."""
