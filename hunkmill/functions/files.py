"""Column expressions over file names, periods, dates and encoded texts. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension -> language (fixed values).
LANGUAGES = {"ts": "JavaScript", "js": "JavaScript", "py": "Python", "java": "Java", "c": "CPP", "php": "PHP", "dart": "Dart", "r": "R"}


def extension(path: Column) -> Column:
    """What stands behind the last dot of the base name, without a leading dot of the name itself; '' if there is none."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_extract(base, r"^\.*[^.].*\.([^.]*)$", 1)


def language(path: Column) -> Column:
    """Language by extension (letter case counts); null where the extension is unknown, where the reference raises."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, F.lit(name)).otherwise(out)
    return out


def stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:(?<=[^./])\.[^./]*)?$", 1)


def project_of(file_name: Column, owner: str) -> Column:
    """The project in ``{owner}_{project}_Python_master.json``; null for any other name."""
    found = F.regexp_extract(file_name, "^" + _quoted(owner) + r"_(.+?)_Python_master\.json$", 1)
    return F.nullif(found, F.lit(""))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)


def period_of(when: Column) -> Column:
    """Yearly partition value of a time, as in ``2019to2020``."""
    y = F.year(when)
    return F.concat(y.cast("string"), F.lit("to"), (y + 1).cast("string"))


def period_label(start: int | None, end: int | None) -> str:
    """Partition value of a range that may be open at one end or both."""
    if start is not None and end is not None:
        return f"{start}to{end}"
    return f"from{start}" if start is not None else f"to{end}" if end is not None else ""


def encoded(text: Column) -> Column:
    """UTF-8 text as base64."""
    return F.base64(F.encode(text, "UTF-8"))


def decoded(text: Column) -> Column:
    """Base64 as UTF-8 text."""
    return F.decode(F.unbase64(text), "UTF-8")


def quoted_id(text: Column) -> Column:
    """An identifier as one segment of an URL: every sign but letters, digits, ``_ . - ~`` is escaped, a blank as %20."""
    escaped = F.url_encode(text)
    return F.replace(F.replace(F.replace(escaped, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def review_time(text: Column) -> Column:
    """``2021-03-04 05:06:07.000000000`` as a time without zone, fractions dropped."""
    return F.try_to_timestamp(F.regexp_replace(text, r"\..*$", ""), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def pull_time(text: Column) -> Column:
    """``2021-03-04T05:06:07Z`` as a time without zone."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, "Z$", ""), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def day_of(text: Column) -> Column:
    """The date in the first blank-separated field of a text."""
    return F.to_date(F.try_to_timestamp(F.split(F.ltrim(text), r"\s+")[0], F.lit("yyyy-MM-dd")))


def without_comment_lines(source: Column, sign: str = "#") -> Column:
    """The text without the lines that begin, after blanks, with ``sign``; lines end with \\n, \\r or \\r\\n and come back joined by \\n."""
    lines = F.split(F.regexp_replace(source, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")
    kept = F.filter(lines, lambda x: ~F.startswith(F.regexp_replace(x, r"^\s+", ""), F.lit(sign)))
    return F.array_join(kept, "\n")


def lines_of(source: Column) -> Column:
    """The lines of a text, without a last empty one; an empty text has none."""
    body = F.regexp_replace(source, r"(\r\n|\r|\n)\z", "")
    return F.when(source == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r\n|\r|\n"))
