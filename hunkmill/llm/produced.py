"""Files that nobody wrote by hand in the project: generated, minified, vendored, or data saved as code."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTENSIONS = frozenset(("py", "js", "java", "json"))

#: Path rules for columns and SQL, which see only file names: folders of other people's or produced code, and name endings that tools give.
#: ``vendor_admin``, ``external_ports``, ``generators`` and ``lockfile.py`` are ordinary names and match none.
_FOLDERS = r"(^|/)(_?vendor|vendored|third[_-]?party|3rd[_-]?party|external|node_modules|deps|site-packages|bower_components|gen|generated)/"
_ENDINGS = r"([._-](min|bundle)|[._](generated|autogen|gen)|_pb2|_pb2_grpc|_wire)\.(py|js|java|json)$"
_NOT_BUNDLE = re.compile(r"_bundle\.[a-z]+$", re.I)

#: The same rules as patterns of an automaton for the files themselves, and ``bundled``, ``autogen`` and ``dist``, which the SQL lacks.
FOLDERS = (
    "vendor", "_vendor", "vendored", "thirdparty", "third_party", "third-party", "3rdparty", "3rd_party", "3rd-party", "external", "node_modules", "deps",
    "site-packages", "bower_components", "gen", "generated", "bundled", "autogen", "dist",
)
ENDINGS = (
    ".min", "_min", "-min", ".bundle", "-bundle", ".generated", "_generated", ".autogen", "_autogen", ".gen", "_gen", "_pb2", "_pb2_grpc", "_wire",
)

#: What a tool or a copier writes at the start of a file; ``%`` stands for a version number. All parts of one tuple must stand in one comment.
MARKERS = (
    ("@generated",), ("generated by", "edit"), ("generated by", "changes will be lost"), ("autogenerated file",), ("auto-generated file",),
    ("automatically generated by",), ("automatically produced",), ("do not modify by hand",), ("machine-made from",), ("automatisch erzeugt",),
    ("nicht bearbeiten",), ("généré automatiquement",), ("generado automáticamente",), ("source:", "compiler:"),
    ("%", "local copy"), ("%", "copied from upstream"), ("taken unchanged from", "%"), ("upstream:", "@%"), ("%", "vendored from"),
)
_VERSION = re.compile(r"\bv?\d+\.\d+(\.\d+)*\b")
_COMMENT = re.compile(r'^\s*(#(?!!)|//|/\*+!?|\*(?!/)|[rRuU]?"""|[rRuU]?\'\'\')(.*)$')
#: Comments count as the head of a file only before this many lines with text.
_HEAD = 30


class Automaton:
    """Aho-Corasick: the numbers of all given patterns that stand in a text, in one pass over it."""

    def __init__(self, patterns: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.out: list[set[int]] = [set()]
        for n, p in enumerate(patterns):
            at = 0
            for c in p:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.out.append(set())
                at = self.next[at][c]
            self.out[at].add(n)
        self.fail = [0] * len(self.next)
        todo = deque(self.next[0].values())
        while todo:
            at = todo.popleft()
            for c, to in self.next[at].items():
                back = self.fail[at]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(c, 0)
                self.out[to] |= self.out[self.fail[to]]
                todo.append(to)

    def find(self, text: str) -> set[int]:
        found: set[int] = set()
        at = 0
        for c in text:
            while at and c not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(c, 0)
            found |= self.out[at]
        return found


_PARTS = sorted({p for m in MARKERS for p in m})
_RULES = [frozenset(_PARTS.index(p) for p in m) for m in MARKERS]
_AUTOMATON = Automaton(_PARTS)
#: Over a path between a slash and a zero, so that a folder stands between slashes and an ending at the end.
_PATHS = Automaton([f"/{f}/" for f in FOLDERS] + [f"{e}.{x}\0" for e in ENDINGS for x in sorted(EXTENSIONS)])


def marked(body: str) -> bool:
    """Whether a comment among the first lines of ``body`` says that it was produced or copied."""
    seen = 0
    for line in body.splitlines():
        if not line.strip():
            continue
        seen += 1
        if seen > _HEAD:
            return False
        m = _COMMENT.match(line)
        if m:
            found = _AUTOMATON.find(_VERSION.sub("%", m[2].lower()))
            if any(rule <= found for rule in _RULES):
                return True
    return False


def path_rule(path: str) -> bool:
    """Whether a folder or the ending of ``path`` says that it was produced or copied, in any letter case: all rules in one pass."""
    return bool(_PATHS.find("/" + path.lower().replace("\0", " ") + "\0"))


def minified(body: str, ext: str) -> bool:
    """Long lines that are mostly signs, with hardly a blank, make up at least half of the body. A long string of words has few signs."""
    if ext == "json":
        return False
    long = [x for x in body.splitlines() if len(x) >= 200]
    text = "".join(long)
    if not text or len(text) < len(body) / 2:
        return False
    blanks = sum(c in " \t" for c in text)
    signs = sum(not (c.isalnum() or c in " \t_") for c in text)
    return blanks < 0.12 * len(text) and signs > 0.2 * len(text)


_ACCESSOR = re.compile(
    r"^\s*(?:def [gs]et_\w+_\d+\(|\w+ = _d\.Field\(|exports\.\w+\d+ = function|public \w+ [gs]et[A-Z]\d+\(|private \w+ [a-z]\d+;"
    r"|return o\._slots\[\d+\]|o\._slots\[\d+\] = )"
)


def stamped(body: str) -> bool:
    """Numbered accessors and fields, line after line, as tools emit them: at least six and a quarter of the lines with text."""
    lines = [x for x in body.splitlines() if x.strip()]
    hits = sum(bool(_ACCESSOR.match(x)) for x in lines)
    return hits >= 6 and hits >= len(lines) / 4


def is_data(body: str) -> bool:
    """Rows of numbers or of separated fields (digits are over a quarter of the text), or long runs of encoded bytes (half of it)."""
    text = "".join(body.split())
    encoded = sum(len(x) for x in re.findall(r"[A-Za-z0-9+/]{48,}", body))
    return len(text) >= 150 and (sum(c.isdigit() for c in text) > 0.25 * len(text) or encoded > 0.5 * len(text))


def by_hand(path: str | None, body: str) -> bool:
    """False if the file was produced, compressed, copied from third parties, or is data stored as code."""
    path = path or ""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext not in EXTENSIONS:
        return True
    return not (path_rule(path) or marked(body) or minified(body, ext) or stamped(body) or is_data(body))


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, paths, bodies = (b.column(c).to_pylist() for c in ("blob_id", "path", "body"))
        yield pa.RecordBatch.from_pydict(
            {"blob_id": pa.array([i for i, p, x in zip(ids, paths, bodies, strict=True) if not by_hand(p, x)], pa.int64())}
        )


def not_by_hand(sources: DataFrame) -> DataFrame:
    """(blob_id) of the files that were not written by hand in the project; every body is read whole, where it lies, without a shuffle.

    ``file_path`` starts with where the blob is stored (``blobs/<project>/<period>/<sha>/<side>/``); path rules see only what follows.
    Defined results: null bodies and other extensions are never flagged; an empty body is flagged by its path alone.
    """
    path = F.regexp_replace("file_path", r"^blobs/[^/]+/[^/]+/[^/]+/(base|target)/", "").alias("path")
    return sources.filter("body is not null").select("blob_id", path, "body").mapInArrow(_flag, "blob_id bigint")


def name_flag(file_name: Column) -> Column:
    """The path rules of the SQL as a column, for tables that hold only file names (diffs, hunk_records)."""
    ending = file_name.rlike("(?i)" + _ENDINGS) & ~file_name.rlike("(?i)" + _NOT_BUNDLE.pattern)
    code = F.lower(F.substring_index(file_name, ".", -1)).isin(*sorted(EXTENSIONS))
    return F.coalesce(code & (file_name.rlike("(?i)" + _FOLDERS) | ending), F.lit(False))


def flagged_names(*tables: DataFrame) -> DataFrame:
    """(file_name) of the produced or vendored files named in the ``file_name`` of the tables, each once."""
    first, *more = (t.select("file_name") for t in tables)
    for t in more:
        first = first.union(t)
    return first.filter(name_flag(F.col("file_name"))).distinct()
