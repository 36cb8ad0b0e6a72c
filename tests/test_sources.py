"""Sources and sinks on temporary folders and a local service; streams of files; the driver's contract."""

import datetime as dt
import json
import subprocess
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from hunkmill.sources import jsonfiles, review_rest
from hunkmill.sources.store import ReviewStore
from hunkmill.streaming import trends

ANSWERS = {}


class Service(BaseHTTPRequestHandler):
    def do_GET(self):
        at = urllib.parse.urlsplit(self.path)
        ask = dict(urllib.parse.parse_qsl(at.query))
        text = ANSWERS["get"](at.path, ask)
        self.send_response(200 if text is not None else 404)
        self.end_headers()
        self.wfile.write((text or "").encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_json_round_trips(spark, tmp_path):
    rows = [{"pattern": ["-a", "+b"], "support": 3}, {"pattern": [], "support": None}]
    (tmp_path / "o/2020to2021").mkdir(parents=True)
    (tmp_path / "o/2020to2021/nova.json").write_text(json.dumps(rows, indent=2))
    got = jsonfiles.read_period(spark, str(tmp_path), "o", "nova", "2020to2021")
    assert {(tuple(r["pattern"]), r["support"]) for r in got.collect()} == {(("-a", "+b"), 3), ((), None)}
    assert jsonfiles.read_period(spark, str(tmp_path), "o", "nova", "1999to2000").collect() == []
    assert jsonfiles.count_rows(spark, str(tmp_path / "o/2020to2021/nova.json")) == 2
    assert [r[0] for r in jsonfiles.list_files(spark, str(tmp_path / "o/2020to2021")).collect()] == ["nova.json"]
    assert jsonfiles.list_files(spark, str(tmp_path / "none")).collect() == []
    out = str(tmp_path / "lines")
    jsonfiles.write_json(got, out)
    jsonfiles.write_json(got, out, "append")
    assert jsonfiles.read_lines(spark, out, jsonfiles.PATTERNS).count() == 4
    jsonfiles.write_csv(got, str(tmp_path / "csv"))
    assert {r["pattern"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"`-a` `+b` ", None}


def test_typed_diffs_fail_on_broken_files(spark, tmp_path):
    good = {"change_id": "i", "branch": "b", "file_name": "f.py", "merged_at": "2020-01-02T03:04:05", "diff_hunk": {"condition": ["a"], "consequent": ["b"]}, "base": None, "target": None}
    (tmp_path / "d.json").write_text(json.dumps([good]))
    df = jsonfiles.read_diffs(spark, str(tmp_path / "d.json"))
    assert df.first()["merged_at"] == dt.datetime(2020, 1, 2, 3, 4, 5)
    jsonfiles.append_diffs(df, str(tmp_path / "out"), "o")
    assert spark.read.json(str(tmp_path / "out")).first()["period"] == "2020to2021"
    (tmp_path / "bad.json").write_text('[{"change_id": ')
    with pytest.raises(Exception):
        jsonfiles.read_diffs(spark, str(tmp_path / "bad.json")).collect()


def test_source_tree(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.py").write_text("one\ntwo\n")
    (tmp_path / "a/y.txt").write_text("no\n")
    assert {r["line"] for r in jsonfiles.read_tree(spark, str(tmp_path)).collect()} == {"one", "two"}


def test_store(spark, tmp_path):
    store = ReviewStore(spark, str(tmp_path / "store"))
    side = "struct<hash:string,committer:string,subject:string,commit_message:string,file_path:string>"
    rows = [(i, f"c{i % 2}", "b", f"f{i}", None, "p", ("h", "c", "s", "m", "p"), None) for i in range(5)]
    store.insert(spark.createDataFrame(rows, f"id bigint, change_id string, branch string, file_name string, merged_at timestamp_ntz, project string, base {side}, target {side}"))
    assert store.get(3).first()["file_name"] == "f3" and store.get(9).collect() == []
    assert {r["id"] for r in store.of_change("c1").collect()} == {1, 3}
    assert [r["id"] for r in store.page(1, 2).collect()] == [1, 2]
    assert store.update(3, file_name="new", nothing=1).first()["file_name"] == "new" and store.update(9, file_name="x") is None
    assert store.delete(0) and not store.delete(0)
    assert store.table("files").count() == 4 == store.table("base_metadata").count()
    store.register()
    assert spark.sql("select count(*) from files join base_metadata on files.id = file_id").first()[0] == 4


def test_review_changes(spark, service):
    def change(n, more):
        rev = lambda k: {"created": f"2020-01-0{k} 00:00:00.000000000", "commit": {"committer": {"name": "c"}, "subject": "s", "message": "m"}, "files": {"/COMMIT_MSG": {}, "x.py": {}}}
        return {"change_id": f"I{n}", "project": "o/r", "branch": "main", "submitted": "2020-02-03 04:05:06.700000000", "revisions": {"h2": rev(2), "h1": rev(1)}, **({"_more_changes": True} if more else {})}

    def get(path, ask):
        year = int(ask["q"].split("after:")[1][:4])
        items = [change(year * 10 + int(ask["S"]), int(ask["S"]) < 1)] if year < 2022 else []
        return ")]}'\n" + json.dumps(items)

    ANSWERS["get"] = get
    spark.dataSource.register(review_rest.ReviewChanges)
    df = spark.read.format("review_changes").option("url", service).option("project", "o/r").option("start", "2020-03-01").option("end", "2022-02-01").option("pause", "0").load()
    got = df.orderBy("change_id").collect()
    assert [r["change_id"] for r in got] == ["I20200", "I20201", "I20210", "I20211"]
    assert got[0]["merged_at"] == dt.datetime(2020, 2, 3, 4, 5, 6) and [(r["hash"], r["changed_files"]) for r in got[0]["revisions"]] == [("h1", ["x.py"]), ("h2", ["x.py"])]


def test_pull_requests_and_contents(spark, service):
    days = ["2020-03-05", "2020-02-05", "2020-01-05", "2019-12-05"]

    def get(path, ask):
        if path.endswith("/content"):
            return None if "gone" in path else "aGk="
        page = int(ask["page"])
        one = [{"number": page, "state": "closed", "updated_at": f"{days[page - 1]}T00:00:00Z", "merged_at": None, "base": {"sha": "b"}, "head": {"sha": "h"}}] if page <= 4 else []
        return json.dumps(one)

    ANSWERS["get"] = get
    spark.dataSource.register(review_rest.PullRequests)
    df = spark.read.format("pull_requests").option("url", service).option("project", "o/r").option("start", "2020-01-01").option("end", "2020-02-28").option("pause", "0").load()
    assert sorted(r["number"] for r in df.collect()) == [2, 3]
    rows = spark.createDataFrame([("I1", "h", "a/b c.py"), ("I1", "h", "gone"), (None, "h", "x")], "change_id string, hash string, file_name string")
    assert [r["body"] for r in review_rest.with_contents(rows, service, pause=0).collect()] == ["hi", None, None]
    assert review_rest.content_url("u", "a~b", "1", "x/y z") == "u/changes/a~b/revisions/1/files/x%2Fy%20z/content"
    assert review_rest.basic_auth("u", "t") == {"Authorization": "Basic dTp0"} and review_rest.basic_auth(None, None) == {}
    assert not review_rest.notify(None, "x")


def test_git_blobs(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "f.py").write_text("one\n")
    git("add", ".")
    git("commit", "-qm", "m")
    rows = spark.createDataFrame([("HEAD", "f.py"), ("HEAD", "none"), (None, "f.py"), ("--output=x", "f.py")], "hash string, file_name string")
    assert [r["body"] for r in review_rest.git_blobs(rows, str(tmp_path)).collect()] == ["one\n", None, None, None]
    review_rest.checkout(str(tmp_path), "HEAD")


def test_adoption_stream(spark, tmp_path):
    rows = [(dt.datetime(2020, 1, 1 + i), (["a"], ["b"])) for i in range(5)] + [(dt.datetime(2021, 1, 1), (["a"], ["b"])), (dt.datetime(2021, 1, 1), (["a"], ["c"]))]
    schema = "merged_at timestamp_ntz, diff_hunk struct<condition:array<string>,consequent:array<string>>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = trends.adoption_by_window(stream, ["-a", "+b"], "3650 days").writeStream.outputMode("complete").format("memory").queryName("adopted").start()
    lines = stream.select("merged_at", F.concat_ws(" ", "diff_hunk.condition", "diff_hunk.consequent").alias("line"))
    r = trends.occurrence_by_window(lines, ["-a", "+b"], window="3650 days").writeStream.outputMode("complete").format("memory").queryName("occurred").start()
    for one in (q, r):
        one.processAllAvailable()
        one.stop()
    assert sum(x["adopted"] for x in spark.table("adopted").collect()) == 6
    assert sum(x["old_lines"] for x in spark.table("occurred").collect()) == 7


def test_contract(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 45
    assert entry.entry(spark).limit(1).count() == 1
