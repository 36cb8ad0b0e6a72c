"""Operators against brute force on small tables, with the odd cases: nulls, ties, repeats, empty tables, extra columns."""

import datetime as dt
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from hunkmill.operators import abstraction, cleaning, confidence, diffing, growth, mining, patterns, review, similarity
from hunkmill.plans import order, pipeline


def gated(db, least, cap, prefix=(), max_len=9):
    out, counts = {}, {}
    for s in db:
        if cap is None or len(s) <= cap:
            for x in set(s):
                counts[x] = counts.get(x, 0) + 1
    for x, n in counts.items():
        if n >= least:
            out[(*prefix, x)] = n
            rest = [s[s.index(x) + 1 :] for s in db if x in s and s.index(x) + 1 < len(s)]
            if len(prefix) + 1 < max_len:
                out |= gated(rest, least, cap, (*prefix, x), max_len)
    return out


@pytest.mark.parametrize("cap", [4, None])
def test_gated_mining_equals_the_model(spark, cap):
    rng = random.Random(5)
    seqs = [[rng.choice("abcd") for _ in range(rng.randint(0, 7))] for _ in range(60)] + [["a", "b"]] * 3
    df = spark.createDataFrame([(s, i) for i, s in enumerate(seqs)] + [(None, 0)], "tokens array<string>, sid int")
    got = {tuple(r[0]): r[1] for r in mining.prefix_patterns(df, min_support=6, cap=cap, max_len=4).collect()}
    assert got == gated([s for s in seqs if s], 6, cap, max_len=4) != {}


def test_mining_by_group_and_the_library_form(spark):
    from pyspark.ml.fpm import PrefixSpan

    rng = random.Random(6)
    rows = [(rng.choice(["x", "y", None]), [rng.choice("abc") for _ in range(rng.randint(1, 5))]) for _ in range(80)]
    df = spark.createDataFrame(rows, "g string, tokens array<string>")
    got = {(r[0], tuple(r[1])): r[2] for r in mining.prefix_patterns(df, min_support=5, by=("g",)).collect()}
    want = {(g, p): n for g in ("x", "y", None) for p, n in gated([s for k, s in rows if k == g], 5, 15).items()}
    assert got == want
    lib = PrefixSpan(minSupport=4.5 / 80, maxPatternLength=10).findFrequentSequentialPatterns(df.select(F.transform("tokens", lambda t: F.array(t)).alias("sequence")))
    lib = {tuple(x[0] for x in r[0]): r[1] for r in lib.collect()}
    assert {tuple(r[0]): r[1] for r in mining.prefix_patterns(df, min_support=5).collect()} == lib


def test_mining_refuses_and_empty(spark):
    empty = spark.createDataFrame([], "tokens array<string>")
    assert mining.prefix_patterns(empty).collect() == []
    with pytest.raises(ValueError):
        mining.prefix_patterns(empty, min_support=0)


def maximal(ps):
    out = []
    for p in sorted(set(ps), key=len, reverse=True):
        rest = lambda q: iter(q)
        if not any(len(q) > len(p) and (lambda it: all(x in it for x in p))(rest(q)) for q in set(ps)):
            out.append(p)
    return set(out)


def test_maximal_merge_and_idempotence(spark):
    rng = random.Random(7)
    ps = [tuple(rng.choice("-+") + rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(150)]
    df = spark.createDataFrame([(list(p), i % 7, i % 3) for i, p in enumerate(ps)] + [(None, 1, 1)], "pattern array<string>, support bigint, period int")
    top = patterns.maximal(df)
    assert {tuple(r[0]) for r in top.collect()} == maximal(ps) and top.count() == len(maximal(ps))
    assert {tuple(r[0]) for r in patterns.maximal(top).collect()} == maximal(ps)
    by = {(r[0], tuple(r[1])) for r in patterns.maximal(df, ("period",)).select("period", "pattern").collect()}
    assert by == {(k, p) for k in range(3) for p in maximal([p for i, p in enumerate(ps) if i % 3 == k])}
    merged = {tuple(r[0]): r[1] for r in patterns.merge(df).collect()}
    assert merged == {p: sum(i % 7 for i, q in enumerate(ps) if q == p) for p in set(ps)}
    assert {tuple(r[0]): r[1] for r in patterns.merge(df.repartition(5)).collect()} == merged
    none = df.filter("false")
    assert patterns.maximal(none).collect() == [] == patterns.merge(none).collect()
    assert [tuple(r[0]) for r in patterns.maximal(spark.createDataFrame([([], 3)], "pattern array<string>, support bigint")).collect()] == [()]


def test_filter_scopes_and_losses(spark):
    rows = [("a", ["-x", "+y"], 5), ("a", ["-x"], 9), ("b", ["-x"], 4), ("b", ["-(", "+)"], 2), ("b", ["=("], 1)]
    df = spark.createDataFrame(rows, "period string, pattern array<string>, support bigint")
    staged, whole = patterns.filter_patterns(df), patterns.filter_patterns(df, "global")
    assert {tuple(r[0]): r[1] for r in staged["merged"].collect()}[("-x",)] == 4
    assert {tuple(r[0]): r[1] for r in whole["merged"].collect()}[("-x",)] == 13
    assert {tuple(r[0]) for r in staged["maximal"].collect()} == {("-x", "+y"), ("-(", "+)"), ("=(",)}
    assert {tuple(r[0]) for r in staged["structural"].collect()} == {("-x", "+y")}
    assert {tuple(r[0]) for r in staged["changing"].collect()} == {("-x", "+y"), ("-(", "+)")}
    assert list(patterns.loss_counts(staged).first()) == [4, 1, 2]
    with pytest.raises(ValueError):
        patterns.filter_patterns(df, "other")


def test_ranks_histogram_and_counts(spark):
    df = spark.createDataFrame([([c], s) for c, s in zip("abcdef", (9, 9, 7, 7, 7, None))], "pattern array<string>, support bigint")
    assert sorted((r["pattern"][0], r["rank"]) for r in patterns.ranked(df).collect()) == list(zip("abcdef", (1, 1, 3, 3, 3, 6)))
    assert [tuple(r) for r in patterns.rank_of(df, ["c"]).collect()] == [(3, 7)] and patterns.rank_of(df, ["z"]).collect() == []
    assert [tuple(r) for r in patterns.length_histogram(df).collect()] == [(1, 6)]
    assert [r["place"] for r in patterns.first_rows({"t": df}, 2).orderBy("place").collect()] == [1, 2]
    seqs = spark.createDataFrame([("p", ["-("]), ("p", ["-a"]), (None, ["+)"]), ("p", None)], "period string, tokens array<string>")
    assert sorted(map(tuple, patterns.sequence_counts(seqs).collect()), key=str) == sorted([("p", 0, 2, 1, 1), (None, 0, 1, 1, 1), (None, 1, 3, 2, 2)], key=str)


def test_positions_and_running_sums(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    assert {(r["k"], r["index"]) for r in order.indexed(df, "k").collect()} == {(i, i) for i in range(1000)}
    sums = order.running_sum(df, "k", F.desc("k")).collect()
    assert {r["k"]: r["running"] for r in sums}[990] == sum(range(990, 1000))
    assert order.indexed(df.filter("false"), "k").collect() == []


@pytest.mark.parametrize("rows", [2, 1000])
def test_confidence(spark, rows):
    ps = [["-a", "+b"], ["-a", "=c"], ["+b"], ["-zz", "+b"], ["-=", "+b"], []]
    hunks = [(["x a"], ["b"]), (["a", "c"], ["c"]), (None, ["b"]), (["q", None], None), (["a"], ["bc"])]
    df = spark.createDataFrame([(p,) for p in ps] * 2 + [(None,)], "pattern array<string>")
    h = spark.createDataFrame(hunks, "condition array<string>, consequent array<string>")
    want = {}
    for p in map(tuple, ps):
        old, new = ([t.lstrip(m + "=") for t in p if t[0] in m + "="] for m in "-+")
        sides = [("".join(x for x in a or [] if x), "".join(x for x in b or [] if x)) for a, b in hunks]
        hit = [b for a, b in sides if old and all(t in a for t in old)]
        want[p] = (len(hit), sum(bool(new) and all(t in b for t in new) for b in hit))
    got = {tuple(r[0]): (r[1], r[2], r[3]) for r in confidence.confidence(df, h, slice_rows=rows).collect()}
    assert got == {p: (t, c, c / t if t else 0.0) for p, (t, c) in want.items()}
    assert confidence.confidence(df.filter("false"), h).collect() == []


def test_adoption_and_years(spark):
    day = lambda n: dt.datetime(2020, 1, n)
    rows = [(day(2), (["a"], ["b"])), (day(1), (["a"], ["b"])), (day(2), (["a"], ["b"])), (None, (["a"], ["b"])), (day(3), (["a"], [])), (day(4), None)]
    df = spark.createDataFrame(rows, "merged_at timestamp_ntz, diff_hunk struct<condition:array<string>,consequent:array<string>>")
    times = confidence.change_times(df, ["-a", "+b"])
    assert times.count() == 4
    assert [tuple(r) for r in confidence.adoption(times).orderBy("merged_at").collect()] == [(day(1), 1), (day(2), 3)]
    lines = spark.createDataFrame([(1, "a b"), (1, "b"), (2, None)], "year int, line string")
    assert sorted(map(tuple, confidence.yearly_occurrence(lines, ["-a", "+b"]).collect())) == [(1, 1, 2), (2, 0, 0)]


def test_overlap_of_developers(spark):
    names = {"p": ["ann", "bob", "cy", "dee"], "q": ["cy", "dee", "eve", "flo"], "r": ["gil"]}
    rows = [(p, a) for p, who in names.items() for a in who] + [("p", "ann"), ("q", None), (None, "cy")]
    counts = similarity.author_counts(spark.createDataFrame(rows, "project string, author string"))
    got = {(r[0], r[1]): tuple(r[2:]) for r in similarity.developer_overlap(counts).collect()}
    assert got == {("p", "q"): (2, 6, 2 / 6), ("p", "r"): (0, 5, 0.0), ("q", "r"): (0, 5, 0.0)}
    cos = {(r[0], r[1]): r[2:] for r in similarity.commit_cosine(counts).collect()}
    assert cos["p", "q"] == (2, 2 / (7**0.5 * 2)) and cos["p", "r"] == (0, 0.0)
    assert {r[0]: tuple(r[1:]) for r in similarity.totals(counts).collect()}["p"] == (4, 5)
    wide = similarity.matrix(similarity.developer_overlap(counts), "jaccard").collect()
    assert [r["project"] for r in wide] == ["p", "q", "r"] and wide[0]["p"] == 0.0 and wide[1]["p"] == 2 / 6
    assert similarity.developer_overlap(counts.filter("false")).collect() == []


def test_overlap_of_patterns(spark):
    rng = random.Random(8)
    a, b = ([([rng.choice("abcdefgh"), rng.choice("xy")], rng.choice([None, *range(25)])) for _ in range(40)] for _ in range(2))
    one, two = (spark.createDataFrame(x, "pattern array<string>, support bigint") for x in (a, b))
    keep = lambda x, n: {tuple(p) for p, s in x if s is not None and s >= n}
    for r in similarity.overlap_grid(one, two).collect():
        x, y = keep(a, r["min_a"]), keep(b, r["min_b"])
        assert (r["shared"], r["either"], r["jaccard"]) == (len(x & y), len(x | y), len(x & y) / len(x | y) if x | y else 0.0)
    assert list(similarity.pattern_overlap(one.filter("false"), two.filter("false")).first()) == [0, 0, 0.0]


def test_growth(spark):
    seqs = [["a", "b"], ["a", "b", "a"], None, [], ["c"], ["b", "a", "c"]]
    df = spark.createDataFrame(list(enumerate(seqs)), "i int, tokens array<string>")
    seen, want = set(), []
    for n in range(0, 6, 2):
        for s in seqs[n : n + 2]:
            seen |= {c for k in (2, 3) for c in combinations(s or [], k)}
        want.append((n // 2, n + 2, len(seen)))
    assert sorted(map(tuple, growth.growth_curve(df, "i", batch=2, max_size=3).collect())) == want
    assert sorted(map(tuple, growth.growth_curve(df.filter("i < 3"), "i", batch=2, max_size=3, exact_total=False).collect()))[-1][1] == 4


def test_cleaning(spark):
    rows = [(i, "p" if i < 8 else "q", None if i == 3 else f"a{i}", ["x"], None, f"20{19 + i % 3}-05-0{i % 9 + 1} 1:2:3") for i in range(11)] + [(11, None, "z", None, [], None)]
    df = spark.createDataFrame(rows, "id int, project string, author string, condition array<string>, consequent array<string>, created_at string")
    parts = {r["id"]: r["part"] for r in cleaning.split(df, "id", more=("id",)).collect()}
    assert parts == {i: "test" if i == 0 else "train" for i in range(12)}
    kept = cleaning.term(df, "2020-05-01", "2020-12-31", more=("id",)).collect()
    assert {r["id"] for r in kept} == {i for i in range(11) if i % 3 == 1} and all(r["consequent"] == [] for r in kept)
    assert {r[0] for r in cleaning.eligible(df, "2020-01-01", "2020-12-31").collect()} == {"p", "q"}
    assert {r[0]: str(r[1]) for r in cleaning.oldest(df).collect()} == {"p": "2019-05-01", "q": "2019-05-01", None: "None"}


def test_review_model(spark):
    side = "struct<hash:string,committer:string,subject:string,commit_message:string,changed_files:array<string>>"
    rev = lambda h, *f: (h, "c", "s", "m", list(f) or None)
    rows = [
        ("i1", "p", "b", None, [rev("h1", "x", "y", "x"), rev("h2", "x"), rev("h3", "x", None)], dt.datetime(2020, 1, 1)),
        ("i1", "p", "b", None, [rev("h1", "x"), rev("h4", "x")], dt.datetime(2020, 1, 2)),
        ("i2", "p", "b", None, None, dt.datetime(2020, 1, 1)), (None, "p", "b", None, [rev("h9", "x"), rev("h8", "x")], dt.datetime(2020, 1, 1)),
    ]
    df = spark.createDataFrame(rows, f"change_id string, project string, branch string, merged_at timestamp_ntz, revisions array<{side}>, fetched_at timestamp_ntz")
    got = review.revision_pairs(review.latest_changes(df)).collect()
    assert [(r["change_id"], r["file_name"], r["revisions"], r["base"]["hash"], r["target"]["hash"]) for r in got] == [("i1", "x", 2, "h1", "h4")]
    assert {(r["file_name"], r["target"]["hash"]) for r in review.revision_pairs(df.limit(1)).collect()} == {("x", "h3")}
    pulls = spark.createDataFrame([(1, "2020-01-02T00:00:00Z", "x"), (2, "2020-03-01T00:00:00Z", "x"), (3, "2020-01-02T00:00:00Z", None)], "number int, updated_at string, merged_at string")
    assert [r[0] for r in review.merged_pulls(pulls, "2020-01-01", "2020-02-01").collect()] == [1]
    commits = spark.createDataFrame([(1, "f", None, k, f"h{k}", "m") for k in range(3)] + [(1, "g", None, 0, "h", "m")], "pr_number int, file_name string, merged_date string, position int, hash string, message string")
    assert [(r["file_name"], r["base_hash"], r["target_hash"]) for r in review.pull_revisions(commits).collect()] == [("f", "h0", "h2")]
    repos = spark.createDataFrame([("a", ["Python"], '<u?page=2>; rel="next", <u?per_page=1&page=77>; rel="last"'), ("b", ["C"], None), ("c", ["Python"], None)], "name string, languages array<string>, link string")
    assert {tuple(r) for r in review.catalog(repos).collect()} == {("a", 77), ("c", 1)}


def test_line_hunks():
    base, target = "a = 1\nb = 2\n# gone\nc = 3\nsame = 0\n", "a = 10\nb = 20\nc = 3\nsame = 0\nnew = 1\n"
    assert diffing.line_hunks(base, target) == [(["a = 1"], ["a = 10"]), (["b = 2"], ["b = 20"])]
    assert diffing.line_hunks("x = 1\n", "y_long_name = f(2)\n", skip_hints=False) == [(["x = 1"], ["y_long_name = f(2)"])]
    assert diffing.line_hunks("value = compute(12)\n", "value = compute(1)\n", skip_hints=False) == []  # the hint parts the sides
    assert diffing.line_hunks("", "a\n") == [] == diffing.line_hunks("a\n", "a\n")
    assert diffing.remove_docstrings('def f():\n    """d"""\n    return 1\n') == "def f():\n    return 1"
    assert diffing.remove_docstrings("def f(:\n") == "def f(:\n"


def test_token_diff_and_tables(spark):
    assert diffing.token_diff(["a", "b", "c"], ["a", "x", "c", "d"]) == ["=a", "-b", "+x", "=c", "+d"]
    rows = [(1, (["a = b", None], ["a = c"])), (2, None), (3, ([], None))]
    df = spark.createDataFrame(rows, "id int, diff_hunk struct<condition:array<string>,consequent:array<string>>")
    assert {r["id"]: r["tokens"] for r in diffing.token_sequences(df).collect()} == {1: ["=a", "==", "-b", "+c"], 2: [], 3: []}
    pairs = spark.createDataFrame([(1, "a = 1\n", "a = 2\n"), (2, None, "x"), (3, "q", "q")], "id int, base_body string, target_body string")
    assert [(r["id"], r["diff_hunk"]["condition"], r["diff_hunk"]["consequent"]) for r in diffing.file_hunks(pairs).collect()] == [(1, ["a = 1"], ["a = 2"])]


def test_abstraction(spark):
    keep = abstraction.preserved(["stay"])
    assert abstraction.abstract_hunk(["def run(x):", "y = x + 5"], ["def run(x, y):", "y = x + 7"], keep) == (
        ["def FUNCTION_1(VAR_1):", "VAR_2 = VAR_1 + NUMBER_1"], ["def FUNCTION_1(VAR_1, VAR_2):", "VAR_2 = VAR_1 + NUMBER_2"])
    assert abstraction.abstract_hunk(["stay(len('a'))"], ["stay(len('b'))"], keep, "NUBER") == (["stay(len(STRING_1))"], ["stay(len(STRING_2))"])
    assert abstraction.functions_named(["def", "x"], ["f(", "g()"], drop_unfinished=True) == (["x"], ["g()"])
    df = spark.createDataFrame([("k", None), ("l", (["a"], None))], "k string, diff_hunk struct<condition:array<string>,consequent:array<string>>")
    assert {r["k"]: tuple(r["diff_hunk"]) for r in abstraction.abstracted(df).collect()} == {"k": ([], []), "l": (["a"], [])}


def test_update_pairs(spark):
    old = ["ASSERT_EQ(expected, actual);", "ASSERT_EQ(expected2, actual2);", "ASSERT_EQ(expected3, actual3);"]
    new = [x.replace("ASSERT", "EXPECT") for x in old]
    acts = [("update-node", "identifier: ASSERT_EQ [0,9]"), ("update-node", "identifier: ASSERT_EQ [61,70]"), ("insert-node", "x [0,1]"), ("update-node", "x [89,91]"), ("update-node", "x [900,910]")]
    df = spark.createDataFrame([(1, old, new, acts)], "id int, condition array<string>, consequent array<string>, actions array<struct<action:string,tree:string>>")
    assert [(r["before"], r["after"]) for r in abstraction.update_pairs(df).collect()] == [(old[0], new[0]), (old[2], new[2])]


def test_routing_and_pipeline(spark):
    hunks = [("a.py", (["x = 1"], ["x = 2"])), ("a.js", (["x"], ["y"])), ("b.py", (["p", "q"], ["p", "r"])), ("c.py", ([], ["r"])), ("d.py", (list("abcdef"), list("ghijkl"))), ("e.py", None)]
    rows = [(n, dt.datetime(2020, 1, 1), h) for n, h in hunks]
    df = spark.createDataFrame(rows, "file_name string, merged_at timestamp_ntz, diff_hunk struct<condition:array<string>,consequent:array<string>>")
    got = {r["file_name"]: [r["diff_hunk"]["condition"], r["diff_hunk"]["consequent"]] for r in diffing.routed_hunks(df).collect()}
    assert set(got) == {"a.py", "b.py"} and len(got["b.py"][0]) == 1
    stages = pipeline.mine(df.union(df).union(df), min_support=3)
    assert {r["period"] for r in stages["periods"].collect()} == {"2020to2021"} and stages["maximal"].count() > 0


def test_trees_and_escapes(spark):
    df = spark.createDataFrame([("a+b", "a + b", "caf\\xc3\\xa9"), ("a", "b", "\\x"), (None, "b", None), ("a\nb", "a\nb", "x")], "a string, b string, c string")
    got = df.select(diffing.trees_equal(F.col("a"), F.col("b")), diffing.escapes_decoded(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(True, "café"), (False, None), (False, None), (False, "x")]
