"""Column expressions against plain Python models, on fixed cases and random tokens."""

import random
import re
import string

from pyspark.sql import functions as F

from hunkmill.functions import files as P
from hunkmill.functions import tokens as T

TEXTS = ["(", ")", "[", "]", "{", "}", "()", "==", "<=", "", "a", "def", "class_x", "VAR_1", "STRING_2", "x.y", "NUMBER_1", "=", "-", "𝒳"]


def random_patterns(n=400, seed=1):
    rng = random.Random(seed)
    return [[rng.choice("-+=") + rng.choice(TEXTS) for _ in range(rng.randint(0, 7))] for _ in range(n)]


def paired(p):
    stack = []
    for t in (x[1:] for x in p):
        if t in tuple("([{"):
            stack.append({"(": ")", "[": "]", "{": "}"}[t])
        elif t in tuple(")]}") and (not stack or stack.pop() != t):
            return False
    return not stack


def in_order(sub, seq):
    rest = iter(seq)
    return all(any(x == y for y in rest) for x in sub)


def wanted(p, marker):
    return [t.lstrip(marker + "=") for t in p if t[0] in marker + "="]


def test_predicates_equal_their_models(spark):
    rows = [(i, p, q) for i, (p, q) in enumerate(zip(random_patterns(), random_patterns(seed=2)))]
    df = spark.createDataFrame(rows, "i int, p array<string>, q array<string>")
    p, q, code = F.col("p"), F.col("q"), F.lit("a(def x.y)VAR_1==")
    got = df.select(
        "p", "q", T.all_symbols(p), T.brackets_paired(p), T.is_subsequence(F.slice(p, 2, 2), q), T.removes_and_adds(p), T.changes(p), T.longer_than(p, 3),
        T.defines(p), T.triggers(p, code), T.applied(p, code), T.is_abstracted(p), T.merge_runs(p), T.rendered(p), T.n_chars(p), T.before_texts(p), T.after_texts(p),
    )
    text = "a(def x.y)VAR_1=="
    for r in got.collect():
        a, b = r[0], r[1]
        assert r[2] == all(t[1:] in string.punctuation for t in a)
        assert r[3] == paired(a)
        assert r[4] == in_order(a[1:3], b)
        assert r[5] == (any(t[0] == "-" for t in a) and any(t[0] == "+" for t in a))
        assert r[6] == (len(a) > 1 and any(t[0] in "+-" for t in a))
        assert r[7] == (len(a) > 3)
        assert r[8] == any(w in t[1:] for t in a for w in ("def", "class", "FUNCTION"))
        assert r[9] == (bool(wanted(a, "-")) and all(t in text for t in wanted(a, "-")))
        assert r[10] == (bool(wanted(a, "+")) and all(t in text for t in wanted(a, "+")))
        assert r[11] == any(w in t for t in a for w in ("VAR", "STRING", "NUMBER"))
        runs = []
        for t in a:
            if runs and runs[-1][0] == t[0]:
                runs[-1] += t[1:]
            else:
                runs.append(t)
        assert r[12] == runs
        assert r[13] == "".join(f"`{t}` " for t in a)
        assert r[14] == sum(map(len, a))
        assert r[15] == [t[1:] for t in a if t[0] in "-="] and r[16] == [t[1:] for t in a if t[0] in "+="]


def test_merge_of_runs_known_case(spark):
    seq = ["=i", "==", "=dic", "-[", "+.get", "+(", "=STRING", "-]", "+)"]
    assert spark.range(1).select(T.merge_runs(F.array(*map(F.lit, seq)))).first()[0] == ["=i=dic", "-[", "+.get(", "=STRING", "-]", "+)"]


def test_regular_expression_of_a_pattern(spark):
    pattern = ["=VAR_1", "==", "+objects", "+.", "+from_dict", "+(", "+self", "+.", "+test_VAR_1", "+)", "-{"]
    a = F.array(*map(F.lit, pattern))
    old, new = spark.range(1).select(T.as_regex(T.before_texts(a)), T.as_regex(T.after_texts(a))).first()
    text = "image_meta=objects.from_dict(self.test_image_meta)"
    assert re.search(new, text) and not re.search(old, text)
    assert spark.range(1).select(F.regexp(F.lit(text), T.as_regex(T.after_texts(a)))).first()[0]
    assert re.search(spark.range(1).select(T.as_regex(F.array(F.lit("a+b(c)[d]$^|?*\\{}")))).first()[0], "a+b(c)[d]$^|?*\\{}")


def test_lexer_and_signed_words(spark):
    line = "x = foo('a b', 3.5) -> y  # z"
    assert spark.range(1).select(T.lexed(F.lit(line))).first()[0] == ["x", "=", "foo", "(", "'a b'", ",", "3.5", ")", "->", "y", "#", "z"]
    df = spark.createDataFrame([(["a b", None], None), (None, ["c"]), ([], [])], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(T.signed_words(F.col("x"), F.col("y"))).collect()] == [["-a", "-b"], ["+c"], []]


def test_null_patterns_give_null(spark):
    df = spark.createDataFrame([(None,)], "p array<string>")
    p = F.col("p")
    assert list(df.select(T.all_symbols(p), T.brackets_paired(p), T.removes_and_adds(p), T.changes(p), T.merge_runs(p)).first()) == [None] * 5


def test_file_names(spark):
    names = ["a/b.py", "a.b/c", ".bashrc", "x.tar.gz", "A.PY", "", "d/.x.js", "nova_a_b_Python_master.json", "nova_c_master.json", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(P.extension(F.col("n")), P.language(F.col("n")), P.stem(F.col("n")), P.project_of(F.col("n"), "nova")).collect()
    import os

    for n, r in zip(names, got):
        if n is None:
            assert list(r) == [None] * 4
            continue
        assert r[0] == os.path.splitext(os.path.basename(n))[1][1:], n
        assert r[2] == os.path.splitext(os.path.basename(n))[0], n
        assert r[1] == {"py": "Python", "js": "JavaScript"}.get(r[0]), n
    assert [r[3] for r in got[7:9]] == ["a_b", None]


def test_texts_and_times(spark):
    from urllib.parse import quote

    odd = "a b/c*~ü+%"
    row = spark.range(1).select(
        P.quoted_id(F.lit(odd)), P.decoded(P.encoded(F.lit(odd))), P.review_time(F.lit("2021-03-04 05:06:07.000000000")).cast("string"),
        P.pull_time(F.lit("2021-03-04T05:06:07Z")).cast("string"), P.day_of(F.lit("2021-03-04 5:6")).cast("string"), P.period_of(F.lit("2021-03-04").cast("date")),
        P.without_comment_lines(F.lit("# a\r\nb # c\n  # d\re\n")), P.day_of(F.lit("bad")),
    ).first()
    assert list(row) == [quote(odd, safe=""), odd, "2021-03-04 05:06:07", "2021-03-04 05:06:07", "2021-03-04", "2021to2022", "b # c\ne", None]
    assert [P.period_label(*x) for x in ((1, 2), (1, None), (None, 2), (None, None))] == ["1to2", "from1", "to2", ""]
