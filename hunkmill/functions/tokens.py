"""Column expressions over patterns: arrays of tokens, each a marker (``-`` gone, ``+`` new, ``=`` kept) and a text.

Everything here is built from Spark's own functions, so that it stays inside generated code. Null patterns give null; null tokens count as
tokens without marker and text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters a symbol token may consist of, in their usual order (a token counts if it is a run of this very string).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BRACKETS = {"(": ")", "[": "]", "{": "}"}
#: What a placeholder stands for when a pattern is searched as a regular expression (fixed values).
NAME_CLASS = r"[a-zA-Z_][a-zA-Z0-9_]*"
STRING_CLASS = r"""['"]([^'"]*)['"]"""
NUMBER_CLASS = r"\b\d+\b"
_META = r"([\\^$.|?*+()\[\]{}\-&~#\s])"
#: A lexer for lines of code: names, numbers, strings, then operators, the longest first.
LEXER = (
    r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?"""
    r"""|\*\*=|//=|>>=|<<=|\.\.\.|===|!==|->|\*\*|//|<<|>>|<=|>=|==|!=|:=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[^\sA-Za-z0-9_])"""
)


def _has_marker(token: Column, *markers: str) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(F.coalesce(token, F.lit("")), F.lit(m)) for m in markers])


def text_of(token: Column) -> Column:
    """A token without its marker."""
    return F.coalesce(F.substring(token, 2, 1 << 30), F.lit(""))


def with_marker(pattern: Column, *markers: str) -> Column:
    return F.filter(pattern, lambda t: _has_marker(t, *markers))


def all_symbols(pattern: Column) -> Column:
    """Every text is a substring of ``PUNCTUATION`` (so ``()`` and ``<=`` are, ``==`` and ``->`` are not); true for an empty pattern."""
    return F.forall(pattern, lambda t: F.contains(F.lit(PUNCTUATION), text_of(t)))


def brackets_paired(pattern: Column) -> Column:
    """The texts that are exactly one bracket nest correctly; all other tokens are passed over; true for an empty pattern.

    The fold keeps the closers still owed as a string, the next one first; ``!`` marks a mismatch for good.
    """

    def step(owed: Column, token: Column) -> Column:
        text = text_of(token)
        out = F.when(owed == "!", owed)
        for opening, closing in BRACKETS.items():
            out = out.when(text == opening, F.concat(F.lit(closing), owed))
        closes = text.isin(*BRACKETS.values())
        out = out.when(closes & (F.substring(owed, 1, 1) == text), F.substring(owed, 2, 1 << 30))
        return out.when(closes, F.lit("!")).otherwise(owed)

    return F.aggregate(pattern, F.lit(""), step) == ""


def is_subsequence(sub: Column, seq: Column) -> Column:
    """The tokens of ``sub`` stand in ``seq`` in order, gaps allowed; an empty ``sub`` always does."""
    met = F.aggregate(seq, F.lit(0), lambda i, t: F.when(F.get(sub, i) == t, i + 1).otherwise(i))
    return met == F.size(sub)


def removes_and_adds(pattern: Column) -> Column:
    """At least one ``-`` and one ``+`` token."""
    return F.exists(pattern, lambda t: _has_marker(t, "-")) & F.exists(pattern, lambda t: _has_marker(t, "+"))


def changes(pattern: Column) -> Column:
    """Two or more tokens, at least one of them ``+`` or ``-``: what mining keeps."""
    return (F.size(pattern) > 1) & F.exists(pattern, lambda t: _has_marker(t, "+", "-"))


def longer_than(pattern: Column, n: int) -> Column:
    return F.size(pattern) > n


def defines(pattern: Column) -> Column:
    """Some text holds ``def``, ``class`` or ``FUNCTION``."""
    return F.exists(pattern, lambda t: text_of(t).rlike("def|class|FUNCTION"))


def _wanted(pattern: Column, marker: str) -> Column:
    """Texts of the tokens of one side, without the run of its marker and ``=`` at their start (``-==`` is left with nothing)."""
    return F.transform(with_marker(pattern, marker, "="), lambda t: F.regexp_replace(t, rf"^[\{marker}=]+", ""))


def joined(lines: Column) -> Column:
    """All lines of a side as one text, as the two tests below take it; compute it once a row. Null lines and sides are empty."""
    return F.array_join(F.coalesce(lines, F.array().cast("array<string>")), "")


def triggers(pattern: Column, before: Column) -> Column:
    """Every ``-`` and ``=`` text stands in the text ``before`` (anywhere, any order); false for a pattern without such tokens."""
    wanted = _wanted(pattern, "-")
    return (F.size(wanted) > 0) & F.forall(wanted, lambda t: F.contains(before, t))


def applied(pattern: Column, after: Column) -> Column:
    """Every ``+`` and ``=`` text stands in the text ``after``; false for a pattern without such tokens."""
    wanted = _wanted(pattern, "+")
    return (F.size(wanted) > 0) & F.forall(wanted, lambda t: F.contains(after, t))


def wanted_before(pattern: Column) -> Column:
    return F.array_distinct(_wanted(pattern, "-"))


def wanted_after(pattern: Column) -> Column:
    return F.array_distinct(_wanted(pattern, "+"))


def is_abstracted(pattern: Column) -> Column:
    return F.exists(pattern, lambda t: F.coalesce(t, F.lit("")).rlike("VAR|STRING|NUMBER"))


def before_texts(pattern: Column) -> Column:
    """Texts of the ``-`` and ``=`` tokens, only the marker taken off."""
    return F.transform(with_marker(pattern, "-", "="), text_of)


def after_texts(pattern: Column) -> Column:
    """Texts of the ``+`` and ``=`` tokens, only the marker taken off."""
    return F.transform(with_marker(pattern, "+", "="), text_of)


def as_regex(texts: Column) -> Column:
    """A regular expression that finds the texts one after the other: placeholders as classes, everything else literally.

    ``rlike`` takes the result as a column. A text that holds VAR or FUNCTION is a name, whatever else it holds.
    """

    def part(t: Column) -> Column:
        return (
            F.when(t.rlike("VAR|FUNCTION"), F.lit(NAME_CLASS))
            .when(F.contains(t, F.lit("STRING")), F.lit(STRING_CLASS))
            .when(F.contains(t, F.lit("NUMBER")), F.lit(NUMBER_CLASS))
            .otherwise(F.regexp_replace(t, _META, r"\\$1"))
        )

    return F.array_join(F.transform(texts, part), "")


def rendered(pattern: Column) -> Column:
    """Each token in back quotes with a blank behind it, as in ```-a` `+b` ``; empty for an empty pattern."""
    return F.array_join(F.transform(pattern, lambda t: F.concat(F.lit("`"), t, F.lit("` "))), "")


def lexed(line: Column) -> Column:
    """Tokens of a line of code. The reference's own tokenizer is private; this lexer stands in for it (see ``LEXER``)."""
    return F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(LEXER), F.lit(1))


def lexed_lines(lines: Column) -> Column:
    """Tokens of all lines of a side, in order; null lines give none."""
    kept = F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.flatten(F.transform(kept, lexed))


def merge_runs(pattern: Column) -> Column:
    """Neighbours with the same marker become one token: ``-a -b +c`` is ``-ab +c``."""
    empty = F.array().cast("array<string>")

    def step(done: Column, token: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        same = _has_marker(token, "-", "+", "=") & (F.substring(last, 1, 1) == F.substring(token, 1, 1))
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, text_of(token))))
        return F.when(same, grown).otherwise(F.concat(done, F.array(token)))

    return F.aggregate(pattern, empty, step)


def n_chars(pattern: Column) -> Column:
    """Characters of all tokens together, markers included."""
    return F.aggregate(pattern, F.lit(0), lambda n, t: n + F.length(t))


def signed_words(condition: Column, consequent: Column) -> Column:
    """``-word`` for each word of the lines of ``condition``, then ``+word`` for those of ``consequent``; null lines and sides give none."""

    def side(lines: Column, sign: str) -> Column:
        kept = F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x.isNotNull())
        found = F.regexp_extract_all(F.array_join(kept, "\n"), F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
        return F.transform(found, lambda w: F.concat(F.lit(sign), w))

    return F.concat(side(condition, "-"), side(consequent, "+"))
