import base64
import random
import re

from pyspark.sql import SparkSession

from hunkmill.llm import produced

HAND = "import os\n\n\ndef write(out):\n    out.write('# Generated by probe. DO NOT EDIT.\\n')\n"
AT = "blobs/x/2020to2021/ab/target/x/"


def test_automaton_finds_overlapping_patterns():
    assert produced.Automaton(["he", "she", "hers", "zz"]).find("ushers") == {0, 1, 2}


def test_flags_and_spares():
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    encoded = "B = [\n" + repr(base64.b64encode(bytes(range(256))).decode()) + "\n]\n"
    flagged = [
        ("a/b.py", "# Generated by wiregen. DO NOT EDIT!\n" + HAND), ("a/b_pb2.py", HAND), ("vendor/z/b.py", HAND), ("a/b.PY", "# zip 1.2.3, (c) x; local copy\n" + HAND),
        ("a/b.js", "!function(){" + "a=b(c)||d[e];" * 40 + "}()\n"), ("a/b.json", "[" + ", ".join(str(i) for i in range(200)) + "]"), ("a/b2.py", encoded), ("node_modules/q.js", ""),
    ]
    spared = [
        ("vendor_admin/b.py", HAND), ("a/x_bundle.py", HAND), ("generators/generate.py", "# auto-generated ids are never reused\n" + HAND), ("a/b.cfg", "# @generated\n"),
        ("a/q.py", "QUERY = 'select " + "alpha_beta, " * 60 + "'\n"), ("a/s.json", '{"port": 8080}'), ("vendor/n.py", None),
    ]
    rows = [(i, AT + p, b) for i, (p, b) in enumerate(flagged + spared)]
    got = produced.not_by_hand(spark.createDataFrame(rows, "blob_id bigint, file_path string, body string"))
    assert sorted(r[0] for r in got.collect()) == list(range(len(flagged)))
    names = spark.createDataFrame([("vendor/a.py",), ("vendor/a.py",), ("a/b.min.js",), ("a/b.py",), (None,)], "file_name string")
    assert sorted(r[0] for r in produced.flagged_names(names, names).collect()) == ["a/b.min.js", "vendor/a.py"]


def test_paths_go_through_the_automaton_and_give_what_the_expressions_give():
    rng = random.Random(5)
    words = ["vendor", "_Vendor", "vendor_admin", "third-party", "3RDparty", "external_ports", "gen", "generators", "a", "", "x.min.js", "x_bundle.js", "x-bundle.js", "a_pb2.py", "a.gen.JAVA", "a_wire.json", "a.min.js.txt", "min.js", "a_pb2"]
    folders, endings, bundle = (re.compile(x, re.I) for x in (produced._FOLDERS, produced._ENDINGS, produced._NOT_BUNDLE.pattern))
    for _ in range(5000):
        path = "/".join(rng.choices(words, k=rng.randint(1, 4)))
        want = bool(folders.search(path) or endings.search(path) and not bundle.search(path))
        assert produced.path_rule(path) == want == bool(produced._PATHS.find(f"/{path.lower()}\0")), path


def test_copies_in_bundled_and_build_output_are_flagged():
    flagged = ["p/bundled/q/base.py", "BUNDLED/q.json", "p/static/dist/a.js", "p/autogen/a.java"]
    spared = ["p/bundle/a.py", "p/bundled.py", "p/unbundled/a.py", "p/distance/a.js", "p/dist.js", "p/autogenerate/a.py"]
    assert [p for p in flagged + spared if not produced.by_hand(p, HAND)] == flagged
