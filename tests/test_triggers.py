from pyspark.sql import functions as F

from hunkmill.functions import tokens as T
from hunkmill.operators import diffing, triggers

ONE = ["=i=dic", "-[", "+.get(", "=STRING", "-]", "+)"]
TWO = [*ONE, "+get(STRING)"]


def frame(spark, rows):
    return spark.createDataFrame([(list(p), n) for p, n in rows], "pattern array<string>, n bigint")


def test_subsequences_and_counts(spark):
    df = spark.createDataFrame([(ONE,), (None,), ([],), (["-a"],)], "tokens array<string>")
    one = triggers.counted(triggers.anchored_subsequences(df))
    assert one.count() == 30 and {r["n"] for r in one.collect()} == {1}
    two = triggers.counted(triggers.anchored_subsequences(spark.createDataFrame([(TWO,)], "tokens array<string>")))
    both = {tuple(r[0]): r[1] for r in triggers.added(one, two).collect()}
    assert len(both) == 62 and both[tuple(ONE)] == 2 and both[tuple(TWO)] == 1


def test_trigger_and_filter(spark):
    df = frame(spark, [(ONE, 2), (("=x=y", "-+", "+*", "=z"), 1), (("=foo=", "-bar()", "+baz()"), 1), (("=i=dic", "-[", "=VAR", "-]"), 3)])
    assert df.select(triggers.trigger_of(F.col("pattern"))).first()[0] == ["=i=dic", "-[", "=STRING", "-]"]
    places = frame(spark, [(("=i=dic", "-[", "=STRING", "-]"), 3), (("=x=y", "-+", "=z"), 2), (("=foo=", "-bar()"), 2)])
    assert [(tuple(r[0]), r[1]) for r in triggers.confident(df, places, df).collect()] == [(tuple(ONE), 2)]


def test_patch_pairs(spark):
    pairs = [("i = dic[STRING]", "i = dic.get(STRING)")] * 2 + [("x = y + z", "x = y * z"), ("foo = bar()", "foo = baz()")]
    df = spark.createDataFrame([((([a]), [b]),) for a, b in pairs], "diff_hunk struct<condition:array<string>,consequent:array<string>>")
    got = triggers.repeated_changes(diffing.token_sequences(df)).collect()
    assert [(tuple(r[0]), r[1]) for r in got] == [(tuple(ONE), 2)]


def test_texts(spark):
    row = spark.range(1).select(T.lexed(triggers.without_placeholders(F.lit("  class ${0:NAME}:"))))
    assert row.first()[0] == ["class", "NAME", ":"]
    df = spark.createDataFrame([(["a", "b"], ["c"]), (None, None)], "condition array<string>, consequent array<string>")
    assert [tuple(r) for r in triggers.line_pairs(df).collect()] == [("a", "c"), ("b", None)]
    keys = spark.createDataFrame([("('=i=dic', '-[', '+.get(', '=STRING', '-]', '+)')",), ("('=i=dic', '-[', '+.get(', ='NUMBER', '-]', '+)')",), (None,)], "key string")
    assert {tuple(r[0]) for r in triggers.triggers_of_keys(keys).collect()} == {("=i=dic", "-[", "='NUMBER", "-]"), ("=i=dic", "-[", "=STRING", "-]")}
