"""Named queries over the test tables, each with SQL that gives the same rows where SQL can express it.

A query takes (spark, folder) and reads whole tables. Arrays come out as texts joined by the unit separator, counts as bigint, ratios unrounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkmill.functions import files as P
from hunkmill.functions import tokens as T
from hunkmill.operators import abstraction, cleaning, confidence, diffing, growth, mining, patterns, review, similarity, triggers
from hunkmill.plans import pipeline
from hunkmill.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_US = "\x1f"
#: A pattern whose two forms are frequent in the test tables.
PATTERN = ["-self", "=def", "+self"]


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _text(c: str | Column) -> Column:
    return F.array_join(c, _US)


def _sequences(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "diffs")
    return d.select("diff_id", "project", "merged_at", T.signed_words(F.col("diff_hunk.condition"), F.col("diff_hunk.consequent")).alias("tokens"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """(line): every distinct line of both sides of the hunks."""
    d = table(spark, folder, "diffs").select("diff_hunk.*")
    return d.select(F.explode("condition").alias("line")).union(d.select(F.explode("consequent"))).filter("line is not null").distinct()


# SQL for the same things
def _words(side: str, sign: str) -> str:
    lines = f"array_to_string(list_filter(coalesce(diff_hunk.{side}, CAST([] AS VARCHAR[])), lambda x: x IS NOT NULL), chr(10))"
    return f"list_transform(regexp_extract_all({lines}, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: '{sign}' || w)"


_SEQ = f"SELECT diff_id, project, merged_at, list_concat({_words('condition', '-')}, {_words('consequent', '+')}) AS tokens FROM diffs"
_LINES = """SELECT DISTINCT line FROM (SELECT unnest(diff_hunk.condition) AS line FROM diffs UNION ALL SELECT unnest(diff_hunk.consequent) FROM diffs)
 WHERE line IS NOT NULL"""
_LEX = "regexp_extract_all(line, '" + T.LEXER.replace("'", "''") + "', 1)"
_JOIN = "array_to_string({}, chr(31))"


def _sql_text(x: str) -> str:
    return f"array_to_string({x}, chr(31))"


def _literal(tokens: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in tokens) + "]"


_PUNCT = "'" + T.PUNCTUATION.replace("'", "''") + "'"
_BRACKETS = """list_reduce({0}, lambda owed, t: CASE WHEN owed = '!' THEN owed WHEN t = '(' THEN ')' || owed WHEN t = '[' THEN ']' || owed WHEN t = '{{' THEN '}}' || owed
 WHEN t IN (')', ']', '}}') AND owed[1:1] = t THEN owed[2:] WHEN t IN (')', ']', '}}') THEN '!' ELSE owed END, '') = ''"""


def _strip(pattern: str, marker: str) -> str:
    return f"list_transform(list_filter({pattern}, lambda t: t[1:1] IN ('{marker}', '=')), lambda t: ltrim(t, '{marker}='))"


def _holds(pattern: str, marker: str, text: str) -> str:
    w = _strip(pattern, marker)
    return f"(len({w}) > 0 AND len(list_filter({w}, lambda t: NOT contains({text}, t))) = 0)"


def _side(name: str) -> str:
    return f"coalesce(array_to_string(list_filter(coalesce(diff_hunk.{name}, CAST([] AS VARCHAR[])), lambda x: x IS NOT NULL), ''), '')"


# mining -------------------------------------------------------------------------------------------------------------------------------


def _unrolled(depth: int, support: int, cap: int | None, source: str) -> str:
    gate = f"WHERE len(suffix) <= {cap}" if cap else ""
    parts = [f"s0 AS (SELECT CAST([] AS VARCHAR[]) AS prefix, tokens AS suffix FROM ({source}) WHERE len(tokens) > 0)"]
    for k in range(1, depth + 1):
        parts.append(
            f"f{k} AS (SELECT list_append(prefix, item) AS pattern, prefix, item, count(*) AS support FROM"
            f" (SELECT prefix, unnest(list_distinct(suffix)) AS item FROM s{k - 1} {gate}) GROUP BY prefix, item HAVING count(*) >= {support})"
        )
        parts.append(
            f"s{k} AS (SELECT f.pattern AS prefix, s.suffix[list_position(s.suffix, f.item) + 1:] AS suffix FROM"
            f" (SELECT prefix, suffix, unnest(list_distinct(suffix)) AS item FROM s{k - 1}) s JOIN f{k} f ON s.prefix = f.prefix AND s.item = f.item"
            f" WHERE list_position(s.suffix, f.item) < len(s.suffix))"
        )
    union = " UNION ALL ".join(f"SELECT pattern, support FROM f{k}" for k in range(1, depth + 1))
    return f"WITH {', '.join(parts)} SELECT {_sql_text('pattern')} AS pattern, support FROM ({union})"


@_query(_unrolled(3, 40, 15, _SEQ))
def prefixspan_gated(spark, folder):
    found = mining.prefix_patterns(_sequences(spark, folder), min_support=40, cap=15, max_len=3)
    return found.select(_text("pattern").alias("pattern"), "support")


@_query(_unrolled(3, 60, None, _SEQ))
def prefixspan_ungated(spark, folder):
    found = mining.prefix_patterns(_sequences(spark, folder), min_support=60, cap=None, max_len=3)
    return found.select(_text("pattern").alias("pattern"), "support")


def weekly_events(spark: SparkSession, folder: str) -> DataFrame:
    """(tokens): the types of a user's events of a week, in order."""
    e = table(spark, folder, "events").groupBy("user_id", F.date_trunc("week", "ts").alias("week"))
    return e.agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type")))["event_type"].alias("tokens"))


_WEEKLY = "SELECT list(event_type ORDER BY ts, event_id) AS tokens FROM events GROUP BY user_id, date_trunc('week', ts)"


@_query(_unrolled(3, 10, 15, _WEEKLY))
def prefixspan_events(spark, folder):
    found = mining.prefix_patterns(weekly_events(spark, folder), min_support=10, cap=15, max_len=3)
    return found.select(_text("pattern").alias("pattern"), "support")


_YEARS = f"SELECT year(merged_at) AS y, tokens FROM ({_SEQ}) WHERE merged_at IS NOT NULL AND len(tokens) > 0"


@_query(
    f"""WITH s0 AS ({_YEARS}), f1 AS (SELECT y, item, count(*) AS support FROM (SELECT y, unnest(list_distinct(tokens)) AS item FROM s0 WHERE len(tokens) <= 15) GROUP BY ALL HAVING count(*) >= 10),
 s1 AS (SELECT s.y, s.item AS a, s.tokens[list_position(s.tokens, s.item) + 1:] AS suffix FROM (SELECT y, tokens, unnest(list_distinct(tokens)) AS item FROM s0) s JOIN f1 USING (y, item)),
 f2 AS (SELECT y, a, item AS b, count(*) AS support FROM (SELECT y, a, unnest(list_distinct(suffix)) AS item FROM s1 WHERE len(suffix) <= 15) GROUP BY ALL HAVING count(*) >= 10)
 SELECT y || 'to' || (y + 1) AS period, a || chr(31) || b AS pattern, support FROM f2 WHERE a[1:1] IN ('+', '-') OR b[1:1] IN ('+', '-')"""
)
def mine_periods(spark, folder):
    rows = _sequences(spark, folder).filter("merged_at is not null").select(P.period_of(F.col("merged_at")).alias("period"), "tokens")
    return mining.mine_periods(rows, min_support=10, max_len=2).select("period", _text("pattern").alias("pattern"), "support")


# patterns -----------------------------------------------------------------------------------------------------------------------------

_MERGED = "SELECT pattern, CAST(coalesce(sum(support), 0) AS BIGINT) AS support FROM mined_patterns WHERE pattern IS NOT NULL GROUP BY pattern"
_CHAIN = "array_to_string(list_transform(pattern, lambda t: chr(31) || t || chr(31)), '')"
_LIKE = "'%' || array_to_string(list_transform(pattern, lambda t: chr(31) || replace(t, '_', '\\_') || chr(31) || '%'), '')"


def _maximal_sql(source: str, by: str = "") -> str:
    cols = f"{by}, " if by else ""
    same = f"q.{by} IS NOT DISTINCT FROM p.{by} AND " if by else ""
    return (
        f"SELECT {cols}pattern, support FROM (SELECT {cols}pattern, max(support) AS support, {_LIKE} AS form FROM ({source}) GROUP BY ALL) p WHERE NOT EXISTS"
        f" (SELECT 1 FROM (SELECT DISTINCT {cols}len(pattern) AS n, {_CHAIN} AS chain FROM ({source})) q WHERE {same}q.n > len(p.pattern) AND q.chain LIKE p.form ESCAPE '\\')"
    )


@_query(f"SELECT {_sql_text('pattern')} AS pattern, support FROM ({_MERGED})")
def pattern_merge_support(spark, folder):
    return patterns.merge(table(spark, folder, "mined_patterns")).select(_text("pattern").alias("pattern"), "support")


@_query(f"SELECT {_sql_text('pattern')} AS pattern, support FROM ({_maximal_sql(_MERGED)})")
def maximal_patterns(spark, folder):
    top = patterns.maximal(patterns.merge(table(spark, folder, "mined_patterns")))
    return top.select(_text("pattern").alias("pattern"), "support")


_PERIODS = "SELECT period, pattern, CAST(coalesce(sum(support), 0) AS BIGINT) AS support FROM mined_patterns WHERE pattern IS NOT NULL GROUP BY ALL"


def _per_period(spark, folder) -> DataFrame:
    p = table(spark, folder, "mined_patterns").filter("pattern is not null")
    return p.groupBy("period", "pattern").agg(F.coalesce(F.sum("support"), F.lit(0)).cast("bigint").alias("support"))


@_query(f"SELECT period, {_sql_text('pattern')} AS pattern, support FROM ({_maximal_sql(_PERIODS, 'period')})")
def maximal_by_period(spark, folder):
    return patterns.maximal(_per_period(spark, folder), ("period",)).select("period", _text("pattern").alias("pattern"), "support")


_STAGED = f"SELECT pattern, CAST(sum(support) AS BIGINT) AS support FROM ({_maximal_sql(_PERIODS, 'period')}) GROUP BY pattern"


@_query(
    f"""SELECT {_sql_text('pattern')} AS pattern, support FROM ({_maximal_sql(_STAGED)})
 WHERE len(list_filter(pattern, lambda t: t[1:1] = '-')) > 0 AND len(list_filter(pattern, lambda t: t[1:1] = '+')) > 0"""
)
def filtered_changing(spark, folder):
    return patterns.filter_patterns(_per_period(spark, folder))["changing"].select(_text("pattern").alias("pattern"), "support")


@_query(
    f"""WITH m AS ({_STAGED}), t AS ({_maximal_sql(_STAGED)}), s AS (SELECT * FROM t WHERE len(list_filter(pattern, lambda x: NOT contains({_PUNCT}, x[2:]))) > 0
 AND {_BRACKETS.format('list_transform(pattern, lambda x: x[2:])')})
 SELECT (SELECT count(*) FROM m) AS merged, (SELECT count(*) FROM m) - (SELECT count(*) FROM t) AS contained, (SELECT count(*) FROM t) - (SELECT count(*) FROM s) AS malformed"""
)
def filter_losses(spark, folder):
    return patterns.loss_counts(patterns.filter_patterns(_per_period(spark, folder)))


@_query(f"SELECT {_sql_text('pattern')} AS pattern, support, rank() OVER (ORDER BY support DESC) AS rank FROM ({_MERGED})")
def pattern_rank(spark, folder):
    ranked = patterns.ranked(patterns.merge(table(spark, folder, "mined_patterns")))
    return ranked.select(_text("pattern").alias("pattern"), "support", "rank")


@_query("SELECT CAST(len(pattern) AS BIGINT) AS length, count(*) AS n FROM mined_patterns WHERE pattern IS NOT NULL GROUP BY ALL")
def pattern_length_hist(spark, folder):
    return patterns.length_histogram(table(spark, folder, "mined_patterns"))


@_query(f"SELECT {_sql_text('pattern')} AS pattern, support FROM ({_MERGED}) WHERE support >= 20")
def pattern_min_support(spark, folder):
    return patterns.at_least(patterns.merge(table(spark, folder, "mined_patterns")), 20).select(_text("pattern").alias("pattern"), "support")


_TOP = f"""SELECT '{{0}}' AS source, row_number() OVER (ORDER BY support DESC, pattern) AS place, array_to_string(list_transform(pattern, lambda t: '`' || t || '` '), '') AS pattern, support
 FROM ({{1}}) QUALIFY place <= 100"""


@_query(_TOP.format("merged", _MERGED) + " UNION ALL " + _TOP.format("maximal", _maximal_sql(_MERGED)))
def first_hundred(spark, folder):
    merged = patterns.merge(table(spark, folder, "mined_patterns"))
    return patterns.first_rows({"merged": merged, "maximal": patterns.maximal(merged)})


_TOKENS = f"SELECT year(merged_at) AS y, list_concat(list_transform({{0}}, lambda t: '-' || t), list_transform({{1}}, lambda t: '+' || t)) AS tokens FROM diffs"


def _lexed_sql(side: str) -> str:
    return _LEX.replace("(line,", f"(array_to_string(list_filter(coalesce(diff_hunk.{side}, CAST([] AS VARCHAR[])), lambda x: x IS NOT NULL), chr(10)),")


def _lexed_sequences(spark, folder) -> DataFrame:
    d = table(spark, folder, "diffs")
    sign = lambda c, s: F.transform(T.lexed_lines(F.col(f"diff_hunk.{c}")), lambda t: F.concat(F.lit(s), t))
    return d.select(P.period_of(F.col("merged_at")).alias("period"), F.concat(sign("condition", "-"), sign("consequent", "+")).alias("tokens"))


@_query(
    f"""SELECT CASE WHEN y IS NOT NULL THEN y || 'to' || (y + 1) END AS period, CAST(grouping(y) AS INTEGER) AS is_total, count(*) AS total,
 count(*) FILTER (len(list_filter(tokens, lambda x: NOT contains({_PUNCT}, x[2:]))) = 0) AS all_symbols,
 count(*) FILTER (NOT ({_BRACKETS.format('list_transform(tokens, lambda x: x[2:])')})) AS unpaired FROM ({_TOKENS.format(_lexed_sql('condition'), _lexed_sql('consequent'))}) GROUP BY ROLLUP (y)"""
)
def sequence_filter_counts(spark, folder):
    return patterns.sequence_counts(_lexed_sequences(spark, folder))


# predicates and token functions -------------------------------------------------------------------------------------------------------


@_query(f"SELECT line, len(list_filter({_LEX}, lambda t: NOT contains({_PUNCT}, t))) = 0 AS symbols, {_BRACKETS.format(_LEX)} AS paired FROM ({_LINES})")
def pred_symbols_brackets(spark, folder):
    signed = F.transform(T.lexed(F.col("line")), lambda t: F.concat(F.lit("="), t))
    return _lines(spark, folder).select("line", T.all_symbols(signed).alias("symbols"), T.brackets_paired(signed).alias("paired"))


@_query(
    f"""SELECT {_sql_text('pattern')} AS pattern, len(list_filter(pattern, lambda t: t[1:1] = '-')) > 0 AND len(list_filter(pattern, lambda t: t[1:1] = '+')) > 0 AS both,
 len(pattern) > 1 AND len(list_filter(pattern, lambda t: t[1:1] IN ('-', '+'))) > 0 AS changes, len(pattern) > 4 AS longer,
 len(list_filter(pattern, lambda t: regexp_matches(t[2:], 'def|class|FUNCTION'))) > 0 AS defines, len(list_filter(pattern, lambda t: regexp_matches(t, 'VAR|STRING|NUMBER'))) > 0 AS abstracted
 FROM (SELECT DISTINCT pattern FROM mined_patterns WHERE pattern IS NOT NULL)"""
)
def pred_change(spark, folder):
    p = F.col("pattern")
    rows = table(spark, folder, "mined_patterns").filter("pattern is not null").select("pattern").distinct()
    return rows.select(
        _text(p).alias("pattern"), T.removes_and_adds(p).alias("both"), T.changes(p).alias("changes"), T.longer_than(p, 4).alias("longer"), T.defines(p).alias("defines"), T.is_abstracted(p).alias("abstracted")
    )


@_query(
    f"""SELECT diff_id, list_position(tokens, '-self') > 0 AND coalesce(list_position(tokens[list_position(tokens, '-self') + 1:], '+self'), 0) > 0 AS held
 FROM ({_SEQ}) WHERE list_position(tokens, '-self') > 0"""
)
def pred_subsequence(spark, folder):
    wanted = F.array(F.lit("-self"), F.lit("+self"))
    return _sequences(spark, folder).filter(F.array_contains("tokens", "-self")).select("diff_id", T.is_subsequence(wanted, F.col("tokens")).alias("held"))


@_query(f"SELECT line, {_sql_text(_LEX)} AS tokens FROM ({_LINES})")
def lexer(spark, folder):
    return _lines(spark, folder).select("line", _text(T.lexed(F.col("line"))).alias("tokens"))


@_query(
    """SELECT pattern, string_agg(merged, chr(31) ORDER BY run) AS merged FROM (
 SELECT pattern, run, min(marker) || string_agg(body, '' ORDER BY place) AS merged FROM (
 SELECT pattern, place, marker, body, sum(fresh) OVER (PARTITION BY pattern ORDER BY place) AS run FROM (
 SELECT pattern, place, marker, body, CASE WHEN lag(marker) OVER (PARTITION BY pattern ORDER BY place) = marker THEN 0 ELSE 1 END AS fresh FROM (
 SELECT array_to_string(pattern, chr(31)) AS pattern, unnest(range(len(pattern))) AS place, unnest(list_transform(pattern, lambda t: t[1:1])) AS marker, unnest(list_transform(pattern, lambda t: t[2:])) AS body
 FROM (SELECT DISTINCT pattern FROM mined_patterns WHERE len(pattern) > 0)))) GROUP BY ALL) GROUP BY pattern"""
)
def merge_consecutive(spark, folder):
    rows = table(spark, folder, "mined_patterns").filter(F.size("pattern") > 0).select("pattern").distinct()
    return rows.select(_text("pattern").alias("pattern"), _text(T.merge_runs(F.col("pattern"))).alias("merged"))


_REGEX = """array_to_string(list_transform(list_transform(list_filter(pattern, lambda t: t[1:1] IN ('{0}', '=')), lambda t: t[2:]), lambda t: CASE WHEN regexp_matches(t, 'VAR|FUNCTION') THEN '[a-zA-Z_][a-zA-Z0-9_]*'
 WHEN contains(t, 'STRING') THEN '[''"]([^''"]*)[''"]' WHEN contains(t, 'NUMBER') THEN '\\b\\d+\\b' ELSE regexp_replace(t, '([\\\\^$.|?*+()\\[\\]{{}}\\-&~#\\s])', '\\\\\\1', 'g') END), '')"""


@_query(
    f"""SELECT {_sql_text('pattern')} AS pattern, array_to_string(list_transform(pattern, lambda t: '`' || t || '` '), '') AS rendered,
 {_sql_text("list_transform(list_filter(pattern, lambda t: t[1:1] IN ('-', '=')), lambda t: t[2:])")} AS old_texts,
 {_sql_text("list_transform(list_filter(pattern, lambda t: t[1:1] IN ('+', '=')), lambda t: t[2:])")} AS new_texts, {_REGEX.format('-')} AS old_regex, {_REGEX.format('+')} AS new_regex
 FROM (SELECT DISTINCT pattern FROM mined_patterns WHERE pattern IS NOT NULL)"""
)
def pattern_texts(spark, folder):
    p = F.col("pattern")
    rows = table(spark, folder, "mined_patterns").filter("pattern is not null").select("pattern").distinct()
    old, new = T.before_texts(p), T.after_texts(p)
    return rows.select(
        _text(p).alias("pattern"), T.rendered(p).alias("rendered"), _text(old).alias("old_texts"), _text(new).alias("new_texts"), T.as_regex(old).alias("old_regex"), T.as_regex(new).alias("new_regex")
    )


@_query(
    f"""SELECT diff_id, regexp_matches({_side('consequent')}, '[a-zA-Z_][a-zA-Z0-9_]*\\(self') AS found FROM diffs"""
)
def regex_search(spark, folder):
    wanted = T.as_regex(F.array(F.lit("VAR_1"), F.lit("("), F.lit("self")))
    return table(spark, folder, "diffs").select("diff_id", F.regexp(T.joined(F.col("diff_hunk.consequent")), wanted).alias("found"))


# confidence and trends ----------------------------------------------------------------------------------------------------------------


@_query(
    f"""WITH p AS (SELECT DISTINCT pattern FROM mined_patterns WHERE pattern IS NOT NULL), h AS (SELECT {_side('condition')} AS b, {_side('consequent')} AS a FROM diffs),
 s AS (SELECT pattern, count(*) FILTER ({_holds('pattern', '-', 'b')}) AS triggered, count(*) FILTER ({_holds('pattern', '-', 'b')} AND {_holds('pattern', '+', 'a')}) AS changed FROM p, h GROUP BY pattern)
 SELECT {_sql_text('pattern')} AS pattern, triggered, changed, CASE WHEN triggered = 0 THEN 0.0::DOUBLE ELSE changed::DOUBLE / triggered END AS confidence FROM s"""
)
def trigger_confidence(spark, folder):
    d = table(spark, folder, "diffs").select("diff_hunk.*")
    return confidence.confidence(table(spark, folder, "mined_patterns"), d).withColumn("pattern", _text("pattern"))


_P = _literal(PATTERN)
_TIMES = f"""SELECT merged_at FROM diffs WHERE len(diff_hunk.condition) > 0 AND len(diff_hunk.consequent) > 0
 AND {_holds(_P, '-', _side('condition'))} AND {_holds(_P, '+', _side('consequent'))}"""


@_query(_TIMES)
def change_times(spark, folder):
    return confidence.change_times(table(spark, folder, "diffs"), PATTERN)


@_query(f"SELECT DISTINCT merged_at, count(*) OVER (ORDER BY merged_at) AS adopted FROM ({_TIMES}) WHERE merged_at IS NOT NULL")
def cumulative_adoption(spark, folder):
    return confidence.adoption(confidence.change_times(table(spark, folder, "diffs"), PATTERN))


_BODY_LINES = "unnest(string_split_regex(regexp_replace(body, '(\\r\\n|\\r|\\n)$', ''), '\\r\\n|\\r|\\n'))"


@_query(
    f"""SELECT year, count(*) FILTER ({_holds(_P, '-', 'line')}) AS old_lines, count(*) FILTER ({_holds(_P, '+', 'line')}) AS new_lines FROM (
 SELECT year(merged_at) AS year, {_BODY_LINES} AS line FROM source_files s JOIN files f ON s.file_id = f.id WHERE body <> '' AND lower(s.file_path) LIKE '%.py') GROUP BY year"""
)
def yearly_occurrence(spark, folder):
    s = table(spark, folder, "source_files").filter(F.lower("file_path").endswith(".py") & (F.col("body") != ""))
    f = table(spark, folder, "files").select(F.col("id").alias("file_id"), F.year("merged_at").alias("year"))
    lines = s.select("file_id", "body").join(f, "file_id").select("year", F.explode(P.lines_of(F.col("body"))).alias("line"))
    return confidence.yearly_occurrence(lines, PATTERN).select(F.col("year").cast("string").alias("year"), "old_lines", "new_lines")


SQL["yearly_occurrence"] = SQL["yearly_occurrence"].replace("SELECT year, count", "SELECT CAST(year AS VARCHAR) AS year, count")

_COMBOS = f"""WITH s AS (SELECT (row_number() OVER (ORDER BY diff_id) - 1) // 10 AS batch, tokens FROM ({_SEQ})),
 c2 AS (SELECT batch, tokens, i, unnest(range(i + 1, len(tokens) + 1)) AS j FROM (SELECT batch, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM s)),
 firsts AS (SELECT c, min(batch) AS batch FROM (SELECT batch, tokens[i] || chr(31) || tokens[j] AS c FROM c2) GROUP BY c),
 n AS (SELECT batch, count(*) AS n FROM s GROUP BY batch), g AS (SELECT batch, count(*) AS fresh FROM firsts GROUP BY batch)
 SELECT batch, CAST(sum(n) OVER w AS BIGINT) AS sequences, CAST(sum(coalesce(fresh, 0)) OVER w AS BIGINT) AS combinations FROM n LEFT JOIN g USING (batch) WINDOW w AS (ORDER BY batch)"""


@_query(_COMBOS)
def cumulative_distinct(spark, folder):
    return growth.growth_curve(_sequences(spark, folder), "diff_id", max_size=2)


# developers and projects --------------------------------------------------------------------------------------------------------------

_AUTHORS = "SELECT project, target.committer AS author, count(*) AS n FROM diffs WHERE target.committer IS NOT NULL GROUP BY ALL"


def _authors(spark, folder) -> DataFrame:
    d = table(spark, folder, "diffs").select("project", F.col("target.committer").alias("author"))
    return similarity.author_counts(d)


@_query(_AUTHORS)
def author_counts(spark, folder):
    return _authors(spark, folder)


@_query(f"SELECT project, count(*) AS developers, CAST(sum(n) AS BIGINT) AS commits FROM ({_AUTHORS}) GROUP BY project")
def dev_counter(spark, folder):
    return similarity.totals(_authors(spark, folder))


_PAIRS = f"""WITH a AS ({_AUTHORS}), s AS (SELECT project, count(*) AS size, CAST(sum(n * n) AS BIGINT) AS square FROM a WHERE project IS NOT NULL GROUP BY project),
 m AS (SELECT x.project AS pa, y.project AS pb, count(*) AS shared, CAST(sum(x.n * y.n) AS BIGINT) AS dot FROM a x JOIN a y USING (author) WHERE x.project < y.project GROUP BY ALL)"""


@_query(
    _PAIRS
    + """ SELECT x.project AS project_a, y.project AS project_b, coalesce(shared, 0) AS shared, x.size + y.size - coalesce(shared, 0) AS either,
 coalesce(shared, 0)::DOUBLE / (x.size + y.size - coalesce(shared, 0)) AS jaccard FROM s x JOIN s y ON x.project < y.project LEFT JOIN m ON pa = x.project AND pb = y.project"""
)
def dev_jaccard(spark, folder):
    return similarity.developer_overlap(_authors(spark, folder))


@_query(
    _PAIRS
    + """ SELECT x.project AS project_a, y.project AS project_b, coalesce(dot, 0) AS dot, coalesce(dot, 0)::DOUBLE / (sqrt(x.square::DOUBLE) * sqrt(y.square::DOUBLE)) AS cosine
 FROM s x JOIN s y ON x.project < y.project LEFT JOIN m ON pa = x.project AND pb = y.project"""
)
def dev_cosine(spark, folder):
    return similarity.commit_cosine(_authors(spark, folder))


_TWO = "SELECT pattern, max(support) AS {0} FROM mined_patterns WHERE pattern IS NOT NULL AND period {1} '2021to2022' GROUP BY pattern"


def _early_late(spark, folder) -> tuple[DataFrame, DataFrame]:
    p = table(spark, folder, "mined_patterns")
    return p.filter("period < '2021to2022'"), p.filter("period >= '2021to2022'")


_CELLS = f"WITH u AS (SELECT * FROM ({_TWO.format('a', '<')}) FULL JOIN ({_TWO.format('b', '>=')}) USING (pattern))"


@_query(_CELLS + " SELECT shared, either, CASE WHEN either = 0 THEN 0.0::DOUBLE ELSE shared::DOUBLE / either END AS jaccard FROM (SELECT count(*) FILTER (a >= 0 AND b >= 0) AS shared, count(*) FILTER (a >= 0 OR b >= 0) AS either FROM u)")
def pattern_jaccard(spark, folder):
    return similarity.pattern_overlap(*_early_late(spark, folder))


@_query(
    _CELLS
    + """, t AS (SELECT unnest(range(2, 21, 2)) AS k) SELECT min_a, min_b, shared, either, CASE WHEN either = 0 THEN 0.0::DOUBLE ELSE shared::DOUBLE / either END AS jaccard FROM (
 SELECT x.k AS min_a, y.k AS min_b, count(*) FILTER (a >= x.k AND b >= y.k) AS shared, count(*) FILTER (a >= x.k OR b >= y.k) AS either FROM t x, t y, u GROUP BY ALL)"""
)
def pattern_jaccard_grid(spark, folder):
    return similarity.overlap_grid(*_early_late(spark, folder))


# review model -------------------------------------------------------------------------------------------------------------------------

_SIDES = "hash, committer, subject, commit_message"
_LATEST = "SELECT * FROM change_data WHERE change_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY fetched_at DESC) = 1"


@_query(
    f"""WITH r AS (SELECT change_id, unnest(range(len(revisions))) AS place, unnest(revisions) AS r FROM ({_LATEST})),
 f AS (SELECT change_id, place, r, unnest(list_distinct(r.changed_files)) AS file_name FROM r WHERE r IS NOT NULL)
 SELECT change_id, file_name, count(*) AS revisions, arg_min(r.hash, place) AS base_hash, arg_max(r.hash, place) AS target_hash FROM f WHERE file_name IS NOT NULL GROUP BY ALL HAVING count(*) >= 2"""
)
def first_last_revision(spark, folder):
    pairs = review.revision_pairs(review.latest_changes(table(spark, folder, "change_data")))
    return pairs.select("change_id", "file_name", "revisions", F.col("base.hash").alias("base_hash"), F.col("target.hash").alias("target_hash"))


@_query(
    """SELECT f.id, f.change_id, f.file_name, b.hash AS base_hash, b.committer AS base_committer, t.hash AS target_hash, t.committer AS target_committer
 FROM files f LEFT JOIN base_metadata b ON b.file_id = f.id LEFT JOIN target_metadata t ON t.file_id = f.id"""
)
def file_metadata_join(spark, folder):
    f = review.with_sides(*(table(spark, folder, n) for n in ("files", "base_metadata", "target_metadata")))
    return f.select(
        "id", "change_id", "file_name", F.col("base.hash").alias("base_hash"), F.col("base.committer").alias("base_committer"), F.col("target.hash").alias("target_hash"), F.col("target.committer").alias("target_committer")
    )


@_query("SELECT id, change_id, file_name FROM files ORDER BY id LIMIT 100 OFFSET 100")
def file_page(spark, folder):
    return review.page(table(spark, folder, "files"), 100, 100).select("id", "change_id", "file_name")


@_query("SELECT id, change_id, file_name FROM files WHERE id = 7")
def file_by_id(spark, folder):
    return review.by_id(table(spark, folder, "files"), 7).select("id", "change_id", "file_name")


@_query("SELECT f.id, f.change_id, f.file_name FROM files f WHERE f.change_id = (SELECT change_id FROM files WHERE id = 7)")
def files_of_change(spark, folder):
    f = table(spark, folder, "files")
    row = review.by_id(f, 7).select("change_id").first()
    return review.by_change(f, row[0] if row else "").select("id", "change_id", "file_name")


@_query("SELECT id, CASE WHEN id = 7 THEN 'renamed.py' ELSE file_name END AS file_name FROM files WHERE id <> 9")
def file_update_delete(spark, folder):
    changed = review.updated(table(spark, folder, "files"), 7, file_name="renamed.py", unknown=1)
    return review.deleted(changed, 9).select("id", "file_name")


# cleaning -----------------------------------------------------------------------------------------------------------------------------

_RAW = "SELECT diff_id, project, target.committer AS author, diff_hunk.condition AS condition, diff_hunk.consequent AS consequent, strftime(merged_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM diffs"


def _raw(spark, folder) -> DataFrame:
    d = table(spark, folder, "diffs")
    return d.select("diff_id", "project", F.col("target.committer").alias("author"), "diff_hunk.condition", "diff_hunk.consequent", F.date_format("merged_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


_CLEAN = "coalesce(author, '') AS author, array_to_string(coalesce(condition, CAST([] AS VARCHAR[])), chr(31)) AS condition, array_to_string(coalesce(consequent, CAST([] AS VARCHAR[])), chr(31)) AS consequent"
_DAY = "CAST(split_part(created_at, ' ', 1) AS DATE)"


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({c: _text(c) for c in ("condition", "consequent")})


@_query(f"SELECT diff_id, {_CLEAN}, created_at FROM ({_RAW}) WHERE {_DAY} BETWEEN DATE '2020-01-01' AND DATE '2023-12-31'")
def term_extract(spark, folder):
    return _flat(cleaning.term(_raw(spark, folder), "2020-01-01", "2023-12-31", more=("diff_id",)))


@_query(f"SELECT project, CAST(min({_DAY}) AS VARCHAR) AS oldest FROM ({_RAW}) GROUP BY project")
def oldest_date(spark, folder):
    return cleaning.oldest(_raw(spark, folder)).withColumn("oldest", F.col("oldest").cast("string"))


@_query(f"SELECT project FROM ({_RAW}) GROUP BY project HAVING min({_DAY}) < DATE '2016-03-01' AND count(*) FILTER ({_DAY} BETWEEN DATE '2016-03-01' AND DATE '2023-12-31') > 0")
def project_eligibility(spark, folder):
    return cleaning.eligible(_raw(spark, folder), "2016-03-01", "2023-12-31")


@_query(
    f"""SELECT project, diff_id, {_CLEAN}, CASE WHEN row_number() OVER (PARTITION BY project ORDER BY diff_id) <= floor(count(*) OVER (PARTITION BY project) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM ({_RAW})"""
)
def split_80_20(spark, folder):
    return _flat(cleaning.split(_raw(spark, folder), "diff_id", more=("diff_id",)))


# files and texts ----------------------------------------------------------------------------------------------------------------------


@_query(
    """SELECT file_name, CASE regexp_extract(file_name, '\\.([^./]*)$', 1) WHEN 'ts' THEN 'JavaScript' WHEN 'js' THEN 'JavaScript' WHEN 'py' THEN 'Python' WHEN 'java' THEN 'Java' WHEN 'c' THEN 'CPP'
 WHEN 'php' THEN 'PHP' WHEN 'dart' THEN 'Dart' WHEN 'r' THEN 'R' END AS language, regexp_extract(file_name, '([^/]*?)(\\.[^./]*)?$', 1) AS stem, count(*) AS n FROM diffs WHERE file_name IS NOT NULL GROUP BY file_name"""
)
def language_filter(spark, folder):
    d = table(spark, folder, "diffs").filter("file_name is not null").groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    return d.select("file_name", P.language(F.col("file_name")).alias("language"), P.stem(F.col("file_name")).alias("stem"), "n")


@_query(
    """SELECT blob_id, md5(array_to_string(list_filter(string_split_regex(regexp_replace(body, '(\\r\\n|\\r|\\n)$', ''), '\\r\\n|\\r|\\n'), lambda x: NOT starts_with(regexp_replace(x, '^\\s+', ''), '#')), chr(10))) AS kept
 FROM source_files WHERE body IS NOT NULL"""
)
def comment_strip(spark, folder):
    s = table(spark, folder, "source_files").filter("body is not null")
    return s.select("blob_id", F.md5(P.without_comment_lines(F.col("body"))).alias("kept"))


@_query("SELECT doc_id, base64(encode(text)) AS encoded, text AS decoded FROM documents WHERE text IS NOT NULL")
def base64_round_trip(spark, folder):
    d = table(spark, folder, "documents").filter("text is not null")
    return d.select("doc_id", F.regexp_replace(P.encoded(F.col("text")), r"\s", "").alias("encoded"), P.decoded(P.encoded(F.col("text"))).alias("decoded"))


@_query("SELECT id, url_encode(file_name) AS quoted, CASE WHEN merged_at IS NOT NULL THEN year(merged_at) || 'to' || (year(merged_at) + 1) END AS period FROM files")
def quoted_ids(spark, folder):
    return table(spark, folder, "files").select("id", P.quoted_id(F.col("file_name")).alias("quoted"), P.period_of(F.col("merged_at")).alias("period"))


# sub-patterns and triggers ------------------------------------------------------------------------------------------------------------

_ANCHORED = """SELECT pattern FROM (SELECT list_filter(p, lambda x, i: i = 1 OR (mask >> (i - 2)) & 1 = 1) AS pattern FROM (
 SELECT pattern AS p, unnest(range(1, (1 << (len(pattern) - 1)))) AS mask FROM mined_patterns WHERE len(pattern) > 1)) WHERE len(list_filter(pattern, lambda t: t[1:1] IN ('-', '+'))) > 0"""


@_query(f"SELECT {_sql_text('pattern')} AS pattern, count(*) AS n FROM ({_ANCHORED}) GROUP BY pattern")
def anchored_subsequences(spark, folder):
    found = triggers.counted(triggers.anchored_subsequences(table(spark, folder, "mined_patterns"), "pattern"))
    return found.select(_text("pattern").alias("pattern"), "n")


_COUNTED = "SELECT pattern, count(*) AS n FROM mined_patterns WHERE pattern IS NOT NULL GROUP BY pattern"
_TRIGGER = "list_filter(pattern, lambda t: t[1:1] <> '+')"


@_query(
    f"""WITH c AS ({_COUNTED}), t AS (SELECT {_TRIGGER} AS trigger, CAST(sum(n) AS BIGINT) AS places FROM c GROUP BY ALL)
 SELECT {_sql_text('pattern')} AS pattern, n FROM c JOIN t ON {_TRIGGER} = t.trigger WHERE n >= 2 AND n::DOUBLE / places >= 0.5"""
)
def confident_patterns(spark, folder):
    counts = triggers.counted(table(spark, folder, "mined_patterns"))
    places = counts.groupBy(triggers.trigger_of(F.col("pattern")).alias("pattern")).agg(F.sum("n").alias("n"))
    return triggers.confident(counts, places, counts, 0.5).select(_text("pattern").alias("pattern"), "n")


@_query(
    """SELECT diff_id, place, before, after FROM (SELECT diff_id, unnest(range(greatest(len(c), len(t)))) AS place, unnest(list_resize(c, greatest(len(c), len(t)))) AS before, unnest(list_resize(t, greatest(len(c), len(t)))) AS after
 FROM (SELECT diff_id, diff_hunk.condition AS c, diff_hunk.consequent AS t FROM diffs WHERE diff_hunk.condition IS NOT NULL AND diff_hunk.consequent IS NOT NULL))"""
)
def line_pairs(spark, folder):
    d = table(spark, folder, "diffs").select("diff_id", "diff_hunk.*")
    pairs = F.posexplode(F.arrays_zip(F.col("condition").alias("before"), F.col("consequent").alias("after"))).alias("place", "p")
    return d.select("diff_id", pairs).select("diff_id", F.col("place").cast("bigint").alias("place"), "p.before", "p.after")


@_query(
    f"""SELECT {_sql_text(_TRIGGER)} AS trigger, count(*) AS n FROM (SELECT DISTINCT pattern FROM mined_patterns WHERE pattern IS NOT NULL) GROUP BY ALL"""
)
def trigger_keys(spark, folder):
    written = F.concat(F.lit("('"), F.array_join("pattern", "', '"), F.lit("')"))
    keys = table(spark, folder, "mined_patterns").filter("pattern is not null").select("pattern").distinct().select(written.alias("key"))
    return keys.groupBy(_text(triggers.trigger_of(triggers.parsed_key(F.col("key")))).alias("trigger")).agg(F.count(F.lit(1)).alias("n"))


# Python's own text matcher: rows only --------------------------------------------------------------------------------------------------


def _body_pairs(spark, folder) -> DataFrame:
    s = table(spark, folder, "source_files").filter("body is not null")
    old = s.filter("side = 'base'").select("file_id", F.col("body").alias("base_body"))
    new = s.filter("side = 'target'").select("file_id", F.col("body").alias("target_body"))
    return old.join(new, "file_id")


def _hunk_text(df: DataFrame) -> DataFrame:
    return df.withColumns({"condition": _text("diff_hunk.condition"), "consequent": _text("diff_hunk.consequent")}).drop("diff_hunk")


@_query()
def line_diff(spark, folder):
    return _hunk_text(diffing.file_hunks(_body_pairs(spark, folder)))


@_query()
def commit_line_diff(spark, folder):
    return _hunk_text(diffing.file_hunks(_body_pairs(spark, folder), skip_hints=False))


@_query()
def token_diff(spark, folder):
    d = diffing.token_sequences(table(spark, folder, "diffs").select("diff_id", "diff_hunk"))
    return d.select("diff_id", _text("tokens").alias("tokens"))


@_query()
def abstraction_hunks(spark, folder):
    return _hunk_text(abstraction.abstracted(table(spark, folder, "diffs").select("diff_id", "diff_hunk")))


@_query()
def routed_hunks(spark, folder):
    return _hunk_text(diffing.routed_hunks(table(spark, folder, "diffs").select("diff_id", "file_name", "diff_hunk")))


@_query()
def pipeline_patterns(spark, folder):
    stages = pipeline.mine(table(spark, folder, "diffs"), min_support=10, max_len=3)
    return stages["maximal"].select(_text("pattern").alias("pattern"), "support")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Gated mining over the hunks of a folder, ranked by support."""
    found = mining.prefix_patterns(_sequences(spark, folder), min_support=10, cap=15, max_len=3)
    return patterns.ranked(found.filter(T.changes(F.col("pattern")))).select(_text("pattern").alias("pattern"), "support", "rank")
