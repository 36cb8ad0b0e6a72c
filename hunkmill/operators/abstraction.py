"""Placeholders for names, numbers and strings in hunks, and the line pairs that updates touch.

The reference asks an external syntax-tree differ which nodes of the two sides match; it is not part of the engine. Here tokens of the two
sides are aligned instead, so which names count as matched differs from it; placeholders, their numbering and their replacement are the same.
"""

from __future__ import annotations

import builtins
import difflib
import keyword
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkmill.functions import tokens as T

#: Names that are never replaced, beside the builtins and keywords of Python (fixed values).
COMMON = frozenset("__init__ __str__ __repr__ append extend pop clear update dispose cancel close get set validate check".split())
_LEXER = re.compile(T.LEXER)
_OPEN, _CLOSE = "([{", ")]}"
_SCHEMA = "struct<condition:array<string>,consequent:array<string>>"


def preserved(more: Iterable[str] = ()) -> frozenset[str]:
    """The names that stay: fixed at the driver, so that all workers agree whatever their Python."""
    return frozenset(dir(builtins)) | frozenset(keyword.kwlist) | COMMON | frozenset(more)


def _kind(token: str) -> str:
    c = token[0]
    if c.isalpha() or c == "_":
        return "VAR"
    if c.isdigit():
        return "NUMBER" if token.isdigit() else ""
    return "STRING" if c in "\"'" and len(token) > 1 else ""


def finished(line: str) -> bool:
    """Whether the line closes the brackets and strings it opens."""
    depth = 0
    for t in _LEXER.findall(line):
        if t in ('"', "'"):
            return False
        depth += (t in _OPEN) - (t in _CLOSE)
        if depth < 0:
            return False
    return depth == 0


def functions_named(old: list[str], new: list[str], drop_unfinished: bool = False) -> tuple[list[str], list[str]]:
    """Both sides with the name behind the first ``def`` of a line as FUNCTION_n, numbered by first sight; a line that ends in ``def`` goes.

    ``drop_unfinished`` also drops lines that do not lex alone, as the reference's tokenizer makes it do.
    """
    names: dict[str, str] = {}

    def side(lines: list[str]) -> list[str]:
        out = []
        for line in lines:
            if drop_unfinished and not finished(line):
                continue
            words = _LEXER.findall(line)
            if "def" in words:
                at = words.index("def") + 1
                if at == len(words):
                    continue
                line = line.replace(words[at], names.setdefault(words[at], f"FUNCTION_{len(names) + 1}"))
            out.append(line)
        return out

    return side(old), side(new)


def matched(old: list[str], new: list[str]) -> list[tuple[str, str, str]]:
    """(kind, old token, new token) of names, integers and strings that stand at the same place of the two sides, in order."""
    left, right = ([t for line in lines for t in _LEXER.findall(line)] for lines in (old, new))
    out = []
    for tag, a, b, c, d in difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if tag == "equal" or tag == "replace" and b - a == d - c:
            out += [(_kind(x), x, y) for x, y in zip(left[a:b], right[c:d]) if _kind(x) and _kind(x) == _kind(y)]
    return out


def abstract_hunk(old: list[str], new: list[str], keep: frozenset[str], number_label: str = "NUMBER", drop_unfinished: bool = False) -> tuple[list[str], list[str]]:
    """Both sides with functions, then matched names, integers and strings as placeholders.

    Each distinct token has its own number within its kind; it is replaced wherever it stands, also inside longer names.
    """
    old, new = functions_named(old, new, drop_unfinished)
    labels = {"VAR": "VAR", "STRING": "STRING", "NUMBER": number_label}
    count = dict.fromkeys(labels, 0)
    names: dict[str, str] = {}
    for kind, x, y in matched(old, new):
        if kind == "VAR" and (x in keep or "FUNCTION" in x or "FUNCTION" in y):
            continue
        for token, lines in ((x, old), (y, new)):
            if token not in names and any(token in line for line in lines):
                count[kind] += 1
                names[token] = f"{labels[kind]}_{count[kind]}"
        old = [line.replace(x, names[x]) for line in old] if x in names else old
        new = [line.replace(y, names[y]) for line in new] if y in names else new
    return old, new


def abstracted(hunks: DataFrame, hunk: str = "diff_hunk", more_names: Iterable[str] = (), number_label: str = "NUMBER", drop_unfinished: bool = False) -> DataFrame:
    """``hunks`` with each hunk abstracted, in Arrow batches; null sides are empty and null lines are left out.

    ``number_label="NUBER"`` gives the label that the reference writes for numbers.
    """
    keep = hunks.sparkSession.sparkContext.broadcast(preserved(more_names))
    rest = [c for c in hunks.columns if c != hunk]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.struct([("condition", pa.list_(pa.string())), ("consequent", pa.list_(pa.string()))])
        for b in batches:
            out = []
            for h in b.column(hunk).to_pylist():
                sides = [[x for x in (h or {}).get(c) or [] if x is not None] for c in ("condition", "consequent")]
                old, new = abstract_hunk(*sides, keep.value, number_label, drop_unfinished)
                out.append({"condition": old, "consequent": new})
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(out, kind)], [*rest, hunk])

    types = dict(hunks.dtypes)
    return hunks.select(*rest, hunk).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in rest), f"`{hunk}` {_SCHEMA}"]))


def updated_lines(old: Column, new: Column) -> Column:
    """Numbers of the lines that differ between two sides of equally many lines: what stands in for the differ's updates."""
    n = F.size(old)
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: ~F.get(old, i).eqNullSafe(F.get(new, i)))


def update_pairs(hunks: DataFrame, condition: str = "condition", consequent: str = "consequent", actions: str = "actions") -> DataFrame:
    """(*other columns, before, after): for each ``update-node`` action the lines of both sides at the line in which it starts.

    An action's place is the first number in the last square brackets of its ``tree``, an offset into the lines joined by line ends. The last
    line ends, as in the reference, where the lines without line ends would, so late offsets find no line. Repeated actions give repeated rows.
    """
    lines, n = F.col(condition), F.size(condition)
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    begins = F.transform(places, lambda i: F.aggregate(F.slice(lines, 1, i), F.lit(0), lambda a, x: a + F.length(x) + 1))
    rest = [c for c in hunks.columns if c not in (condition, consequent, actions)]
    rows = hunks.select(*rest, lines.alias("_old"), F.col(consequent).alias("_new"), begins.alias("_begins"), T.joined(lines).alias("_text"), F.explode(actions).alias("_action"))
    at = F.regexp_extract(F.col("_action.tree"), r"\[(\d+),\s*\d+\][^\[]*$", 1).try_cast("int")
    rows = rows.filter(F.col("_action.action") == "update-node").withColumn("_at", at)
    later = F.filter("_begins", lambda s: s > F.col("_at"))
    line = F.size("_begins") - F.size(later) - 1
    inside = (F.size(later) > 0) | (F.col("_at") < F.length("_text"))
    return rows.withColumn("_line", line).filter(inside & (F.col("_line") >= 0)).select(*rest, F.get("_old", F.col("_line")).alias("before"), F.get("_new", F.col("_line")).alias("after"))
