"""Queries of the training-data operators (pN_...) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkmill.llm import bpe, copies, leaks, mining, names, produced, reading
from hunkmill.llm.parsing import validity
from hunkmill.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return mining.change_patterns(table(spark, folder, "diffs")).select(F.array_join("pattern", " ").alias("pattern"))


def p1_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return mining.change_patterns(table(spark, folder, "diffs")).select(F.array_join("pattern", " ").alias("pattern"), "support")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    fields = names.committers(*(table(spark, folder, t) for t in ("change_data", "base_metadata", "target_metadata")))
    return names.variants(fields, table(spark, folder, "name_forms"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return validity.unparsable(table(spark, folder, "source_files"))


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    return validity.rates(table(spark, folder, "source_files"), table(spark, folder, "files"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return produced.not_by_hand(table(spark, folder, "source_files"))


def p4_named_files(spark: SparkSession, folder: str) -> DataFrame:
    return produced.flagged_names(*(table(spark, folder, t) for t in ("files", "diffs", "hunk_records")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copies(table(spark, folder, "hunk_records"))


def p5_copy_counts(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copy_counts(table(spark, folder, "hunk_records"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_paraphrased(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.paraphrased(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_patterns, p2_found, p3_found, p3_rates, p4_found, p4_named_files, p5_found, p5_copy_counts, p6_ids, p7_found, p7_paraphrased, p8_found)}

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_SIDES = """SELECT record_id, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS doc FROM hunk_records WHERE payload IS NOT NULL"""
_STRIPPED = f"""SELECT record_id, {{0}} AS a, {{1}} AS b FROM ({_SIDES}) WHERE doc IS NOT NULL AND json_type(doc) = 'OBJECT'
 AND (json_type(doc -> 'condition') = 'ARRAY' OR json_type(doc -> 'consequent') = 'ARRAY')""".format(
    *(f"regexp_replace(lower(coalesce(array_to_string(CAST(doc -> '{c}' AS VARCHAR[]), ' '), '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')" for c in ("condition", "consequent"))
)
_KEPT = f"SELECT record_id, min(record_id) OVER (PARTITION BY a, b) AS keep_id FROM (SELECT DISTINCT record_id, a, b FROM ({_STRIPPED}) WHERE a <> '' OR b <> '')"



def _mined(least: str, sizes: tuple[int, int] = (3, 5)) -> str:
    """Patterns by distinct change_id, level by level: a pattern's prefix has at least its support."""
    words = "list_transform(regexp_extract_all(array_to_string(list_filter(coalesce(diff_hunk.{0}, CAST([] AS VARCHAR[])), lambda x: x IS NOT NULL), chr(10)), '[A-Za-z_][A-Za-z0-9_]*'), lambda w: '{1}' || w)"
    parts = [
        f"s0 AS MATERIALIZED (SELECT DISTINCT change_id, CAST('' AS VARCHAR) AS prefix, list_concat({words.format('condition', '-')}, {words.format('consequent', '+')}) AS suffix FROM diffs WHERE change_id IS NOT NULL)",
        f"least AS MATERIALIZED (SELECT {least} AS k FROM diffs)",
    ]
    for n in range(1, sizes[1] + 1):
        gap = "' ' ||" if n > 1 else ""
        parts.append(f"x{n} AS MATERIALIZED (SELECT change_id, prefix, suffix, unnest(list_distinct(suffix)) AS item FROM s{n - 1})")
        parts.append(f"f{n} AS MATERIALIZED (SELECT prefix, item, count(DISTINCT change_id) AS support FROM x{n} GROUP BY ALL HAVING count(DISTINCT change_id) >= (SELECT k FROM least))")
        parts.append(f"s{n} AS MATERIALIZED (SELECT DISTINCT change_id, prefix || {gap} item AS prefix, suffix[list_position(suffix, item) + 1:] AS suffix FROM x{n} JOIN f{n} USING (prefix, item))")
    union = " UNION ALL ".join(f"SELECT prefix || ' ' || item AS pattern, support FROM f{n}" for n in range(sizes[0], sizes[1] + 1))
    return f"WITH {', '.join(parts)} {union}"


_LEAST = "greatest(8, CAST(ceil(3 * count(DISTINCT change_id) / 100) AS BIGINT))"
_CODE = "lower(split_part(file_name, '.', -1)) IN ('java', 'js', 'json', 'py')"
_FLAGGED = f"{_CODE} AND (regexp_matches(file_name, '{produced._FOLDERS}', 'i') OR regexp_matches(file_name, '{produced._ENDINGS}', 'i') AND NOT regexp_matches(file_name, '{produced._NOT_BUNDLE.pattern}', 'i'))"

#: SQL for the problems that SQL can express; the others are tested against brute force or held-out rows in tests/llm.
SQL = {
    "p1_found": f"SELECT pattern FROM ({_mined(_LEAST)})",
    "p1_patterns": _mined(_LEAST),
    "p4_named_files": " UNION ".join(f"SELECT file_name FROM {t} WHERE {_FLAGGED}" for t in ("files", "diffs", "hunk_records")),
    "p5_found": f"SELECT keep_id, record_id AS copy_id FROM ({_KEPT}) WHERE record_id <> keep_id",
    "p5_copy_counts": f"SELECT keep_id, count(*) AS copies FROM ({_KEPT}) GROUP BY keep_id",
    "p7_found": f"""WITH g AS (SELECT of, id, array_to_string(w[i:i + 11], ' ') AS run FROM (SELECT of, id, w, unnest(range(1, len(w) - 10)) AS i FROM (
 SELECT 'd' AS of, doc_id AS id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'i', item_id, {_WORDS} FROM eval_items WHERE text IS NOT NULL) WHERE len(w) >= 12))
 SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM g a JOIN g b USING (run) WHERE a.of = 'd' AND b.of = 'i'""",
}
