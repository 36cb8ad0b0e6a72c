"""Line hunks between two versions of a file, and signed token sequences of hunks.

The line matcher and the token matcher are Python's own ``difflib``; they run in Arrow batches, after all native filters, and each row stays
where it is.
"""

from __future__ import annotations

import ast
import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from hunkmill.functions import files as P
from hunkmill.functions import tokens as T
from hunkmill.operators.abstraction import abstracted, updated_lines

HUNK = "struct<condition:array<string>,consequent:array<string>>"
_LEXER = re.compile(T.LEXER)


def remove_docstrings(source: str) -> str:
    """Source without the docstrings of modules, functions and classes, written anew from its syntax tree; unchanged if it does not parse.

    Docstrings of async functions stay, as in the reference. The writer is ``ast.unparse``, so layout differs from other writers.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return source
    for node in ast.walk(tree):
        if isinstance(node, (ast.Module, ast.FunctionDef, ast.ClassDef)) and ast.get_docstring(node):
            del node.body[0]
            if not node.body and not isinstance(node, ast.Module):
                node.body.append(ast.Pass())
    return ast.unparse(tree)


def remove_comment_lines(source: str) -> str:
    return "\n".join(x for x in source.splitlines() if not x.lstrip().startswith("#"))


def line_hunks(base: str, target: str, skip_hints: bool = True, clean: bool = True) -> list[tuple[list[str], list[str]]]:
    """(condition, consequent) of each run of old lines that a run of new lines follows at once, blanks stripped, empty lines left out.

    The marks of the line diff are read as one string, in which such a place is a match of ``-* +*``. Hint lines (``?``) may stand among the
    old lines with ``skip_hints``; without it, as in the variant over commits, they part old and new, so that hunk is lost. Pure insertions
    and deletions give none.
    """
    if clean:
        base, target = (remove_docstrings(remove_comment_lines(x)) for x in (base, target))
    diff = list(difflib.Differ().compare(base.splitlines(), target.splitlines()))
    marks = "".join(x[0] for x in diff)
    out = []
    for m in re.finditer(r"([-?]*)(\++)" if skip_hints else r"(-*)(\++)", marks):
        old = [diff[i][1:].strip() for i in range(*m.span(1)) if marks[i] == "-"]
        new = [diff[i][1:].strip() for i in range(*m.span(2))]
        old, new = [x for x in old if x], [x for x in new if x]
        if old and new:
            out.append((old, new))
    return out


def file_hunks(pairs: DataFrame, base: str = "base_body", target: str = "target_body", skip_hints: bool = True, clean: bool = True) -> DataFrame:
    """Every row of ``pairs`` once for each hunk between its two texts, as ``diff_hunk``; rows with a null text give none."""
    keep = [c for c in pairs.columns if c not in (base, target)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found, at = [], []
            for i, (old, new) in enumerate(zip(b.column(base).to_pylist(), b.column(target).to_pylist(), strict=True)):
                for c, a in line_hunks(old, new, skip_hints, clean):
                    found.append({"condition": c, "consequent": a})
                    at.append(i)
            rows = b.select(keep).take(pa.array(at, pa.int64()))
            kind = pa.struct([("condition", pa.list_(pa.string())), ("consequent", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, kind)], [*keep, "diff_hunk"])

    whole = pairs.filter(F.col(base).isNotNull() & F.col(target).isNotNull())
    schema = ", ".join([*(f"`{c}` {t}" for c, t in whole.select(*keep).dtypes), f"diff_hunk {HUNK}"])
    return whole.mapInArrow(run, schema)


def token_diff(old: list[str], new: list[str]) -> list[str]:
    """Signed tokens of two token lists: kept ones with ``=``, then at each place the gone ones with ``-`` before the new ones with ``+``."""
    out: list[str] = []
    for tag, a, b, c, d in difflib.SequenceMatcher(None, old, new).get_opcodes():
        if tag == "equal":
            out.extend("=" + t for t in old[a:b])
        else:
            out.extend("-" + t for t in old[a:b])
            out.extend("+" + t for t in new[c:d])
    return out


def token_sequences(hunks: DataFrame, hunk: str = "diff_hunk", name: str = "tokens") -> DataFrame:
    """``hunks`` with the signed token sequence of each hunk. Lines are lexed in the JVM; only the matching runs in Python.

    Null sides and lines give no tokens; a hunk without tokens gives an empty sequence.
    """
    lexed = hunks.withColumns({"_old": T.lexed_lines(F.col(f"{hunk}.condition")), "_new": T.lexed_lines(F.col(f"{hunk}.consequent"))})
    keep = hunks.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = [token_diff(o, n) for o, n in zip(b.column("_old").to_pylist(), b.column("_new").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(rows, pa.list_(pa.string()))], [*keep, name])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in hunks.dtypes), f"`{name}` array<string>"])
    return lexed.mapInArrow(run, schema)


def routed_hunks(diffs: DataFrame, language: str = "Python", max_lines: int = 5, both_sides: bool = True, hunk: str = "diff_hunk", number_label: str = "NUMBER") -> DataFrame:
    """The hunks that sequences are made of: files of ``language``, both sides with lines, abstracted, at most ``max_lines`` a side; a hunk with
    equally many lines (two or more) on both sides is split into the line pairs that an update touches, any other stays whole.

    The filters that need no abstraction come first, natively. ``both_sides=False`` keeps hunks with an empty side, as the generator form does.
    """
    rows = diffs.filter(P.language(F.col("file_name")) == language).filter(F.col(hunk).isNotNull())
    n_old, n_new = (F.coalesce(F.size(f"{hunk}.{c}"), F.lit(0)) for c in ("condition", "consequent"))
    if both_sides:
        rows = rows.filter((n_old > 0) & (n_new > 0))
    keep = [c for c in diffs.columns if c != hunk]
    made = abstracted(rows.select(*keep, F.col(hunk).alias("diff_hunk")), number_label=number_label)
    made = made.filter((F.size("diff_hunk.condition") <= max_lines) & (F.size("diff_hunk.consequent") <= max_lines))
    whole = (F.size("diff_hunk.condition") != F.size("diff_hunk.consequent")) | (F.size("diff_hunk.condition") == 1)
    lines = F.col("diff_hunk.condition"), F.col("diff_hunk.consequent")
    pairs = F.transform(updated_lines(*lines), lambda i: F.struct(F.array(F.get(lines[0], i)).alias("condition"), F.array(F.get(lines[1], i)).alias("consequent")))
    parts = F.when(whole, F.array(F.struct(lines[0].alias("condition"), lines[1].alias("consequent")))).otherwise(pairs)
    return made.select(*keep, F.explode(parts).alias("diff_hunk"))


def same_tree(a: str | None, b: str | None) -> bool:
    """Whether two sources have the same syntax tree, after escapes are written out (so that sources of several lines hardly ever have)."""
    if a is None or b is None:
        return False
    try:
        x, y = (ast.dump(ast.parse(t.encode("unicode_escape").decode("utf-8"))) for t in (a, b))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return x == y


def trees_equal(a: Column, b: Column) -> Column:
    @pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([same_tree(p, q) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def escapes_decoded(text: Column) -> Column:
    """Escape sequences written out and the bytes they stand for read as UTF-8; null for what is no such text."""
    def one(t):
        try:
            return None if t is None else t.encode("utf-8").decode("unicode_escape").encode("latin1").decode("utf-8")
        except (UnicodeDecodeError, UnicodeEncodeError):
            return None

    @pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in x], dtype=object)

    return run(text)
