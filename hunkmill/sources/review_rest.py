"""Review and code-host services as Spark data sources, and Git blobs.

``spark.dataSource.register(ReviewChanges)`` and then ``spark.read.format("review_changes").option("url", ...)`` read merged changes page by
page; the periods between ``start`` and ``end`` are read in parallel. ``url`` may be a ``file:`` folder of saved answers.
"""

from __future__ import annotations

import base64
import json
import subprocess
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHANGE = (
    "change_id string, project string, branch string, merged_at timestamp_ntz,"
    " revisions array<struct<hash:string,committer:string,subject:string,commit_message:string,changed_files:array<string>>>"
)
PULL = "number bigint, state string, title string, updated_at timestamp_ntz, merged_at timestamp_ntz, base_hash string, head_hash string"


def basic_auth(user: str | None, token: str | None) -> dict[str, str]:
    """The header of basic authentication; none without a user."""
    if not user:
        return {}
    return {"Authorization": "Basic " + base64.b64encode(f"{user}:{token or ''}".encode()).decode()}


def fetch(url: str, headers: dict[str, str] | None = None, pause: float = 0.0, tries: int = 3) -> str | None:
    """The answer as text; null for 404. A 403 with a reset time is waited for and asked again, other errors are raised."""
    for left in range(tries, 0, -1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=60) as answer:
                text = answer.read().decode("utf-8")
            if pause:
                time.sleep(pause)
            return text
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if e.code != 403 or left == 1:
                raise
            time.sleep(max(0.0, float(e.headers.get("X-RateLimit-Reset", 0)) - time.time()) or pause)
    return None


def unguarded(text: str) -> str:
    """JSON without the line that review services put before it."""
    return text.split("\n", 1)[1] if text.startswith(")]}'") else text


def content_url(url: str, change: str, revision: str, path: str) -> str:
    """Address of a file at a revision; every identifier is one escaped segment."""
    c, r, p = (urllib.parse.quote(x, safe="") for x in (change, revision, path))
    return f"{url}/changes/{c}/revisions/{r}/files/{p}/content"


def _time(text: str | None, form: str) -> datetime | None:
    return datetime.strptime(text.split(".")[0], form) if text else None


def parse_change(item: dict) -> tuple:
    """One change of an answer: revisions by their time of creation, changed files by name, the commit's own entry left out."""
    revisions = []
    for sha, r in sorted(item.get("revisions", {}).items(), key=lambda x: (x[1].get("created") or "", x[0])):
        commit = r.get("commit", {})
        files = [f for f in r.get("files", {}) if not f.startswith("/")]
        revisions.append((sha, commit.get("committer", {}).get("name"), commit.get("subject"), commit.get("message"), files))
    when = _time(item.get("submitted") or item.get("updated"), "%Y-%m-%d %H:%M:%S")
    return item.get("change_id"), item.get("project"), item.get("branch"), when, revisions


def years(start: str, end: str) -> list[tuple[str, str]]:
    """The range cut at the ends of years: what one task reads."""
    a, b = date.fromisoformat(start), date.fromisoformat(end)
    out = []
    while a < b:
        stop = min(b, date(a.year + 1, 1, 1))
        out.append((a.isoformat(), stop.isoformat()))
        a = stop
    return out


class _Range(InputPartition):
    def __init__(self, start: str, end: str):
        self.start, self.end = start, end


class _Paged(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = options
        self.size = int(options.get("page_size", "100"))
        self.pause = float(options.get("pause", "1.0"))
        self.headers = basic_auth(options.get("user"), options.get("token"))

    def partitions(self):
        return [_Range(a, b) for a, b in years(self.o["start"], self.o["end"])]


class _ChangeReader(_Paged):
    def read(self, partition: _Range) -> Iterator[tuple]:
        skip = 0
        while True:
            q = f"project:{self.o['project']} status:merged after:{partition.start} before:{partition.end}"
            ask = [("q", q), ("o", "ALL_REVISIONS"), ("o", "ALL_COMMITS"), ("o", "ALL_FILES"), ("n", self.size), ("S", skip)]
            text = fetch(f"{self.o['url']}/changes/?{urllib.parse.urlencode(ask)}", self.headers, self.pause)
            items = json.loads(unguarded(text)) if text else []
            yield from map(parse_change, items)
            if not items or not items[-1].get("_more_changes"):
                return
            skip += len(items)


class ReviewChanges(DataSource):
    """Merged changes of ``project`` from ``start`` to ``end`` (ISO dates) of the review service at ``url``."""

    @classmethod
    def name(cls) -> str:
        return "review_changes"

    def schema(self) -> str:
        return CHANGE

    def reader(self, schema) -> DataSourceReader:
        return _ChangeReader(dict(self.options))


class _PullReader(_Paged):
    def partitions(self):
        return [_Range(self.o["start"], self.o["end"])]  # pages go back in time and stop at the start: one reader

    def read(self, partition: _Range) -> Iterator[tuple]:
        form, page = "%Y-%m-%dT%H:%M:%SZ", 1
        while True:
            ask = urllib.parse.urlencode({"state": "closed", "sort": "updated", "direction": "desc", "per_page": self.size, "page": page})
            text = fetch(f"{self.o['url']}/repos/{self.o['project']}/pulls?{ask}", self.headers, self.pause)
            items = json.loads(text) if text else []
            for x in items:
                day = x["updated_at"][:10]
                if day < partition.start:
                    return
                if day <= partition.end:
                    yield x["number"], x["state"], x.get("title"), _time(x["updated_at"], form), _time(x.get("merged_at"), form), x.get("base", {}).get("sha"), x.get("head", {}).get("sha")
            if not items:
                return
            page += 1


class PullRequests(DataSource):
    """Closed pull requests of ``project`` updated from ``start`` to ``end`` at the code host ``url``."""

    @classmethod
    def name(cls) -> str:
        return "pull_requests"

    def schema(self) -> str:
        return PULL

    def reader(self, schema) -> DataSourceReader:
        return _PullReader(dict(self.options))


def with_contents(rows: DataFrame, url: str, change: str = "change_id", revision: str = "hash", path: str = "file_name", pause: float = 1.0, encoded: bool = True) -> DataFrame:
    """``rows`` with ``body``: the file's text at that revision, null where the service has none. ``encoded``: the answer is base64."""
    names = rows.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            bodies = []
            for c, r, p in zip(*(b.column(x).to_pylist() for x in (change, revision, path)), strict=True):
                text = fetch(content_url(url, c, r, p), None, pause) if None not in (c, r, p) else None
                bodies.append(base64.b64decode(text).decode("utf-8", "replace") if text is not None and encoded else text)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bodies, pa.string())], [*names, "body"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "body string"]))


def clone(url: str, folder: str, since: str = "2015-12-01") -> None:
    """A clone with the history since a day; the folder must be one that all workers see if ``git_blobs`` reads it."""
    subprocess.run(["git", "clone", "--quiet", f"--shallow-since={since}", url, folder], check=True)


def checkout(folder: str, revision: str) -> None:
    subprocess.run(["git", "-C", folder, "checkout", "--quiet", "--force", revision], check=True)


def git_blobs(rows: DataFrame, repository: str, commit: str = "hash", path: str = "file_name") -> DataFrame:
    """``rows`` with ``body``: the file at that commit of the repository folder, null where there is none."""
    names = rows.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            bodies = []
            for c, p in zip(b.column(commit).to_pylist(), b.column(path).to_pylist(), strict=True):
                done = subprocess.run(["git", "-C", repository, "show", f"{c}:{p}"], capture_output=True) if c and p and not c.startswith("-") else None
                bodies.append(done.stdout.decode("utf-8", "replace") if done and done.returncode == 0 else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bodies, pa.string())], [*names, "body"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "body string"]))


def notify(url: str | None, text: str) -> bool:
    """Posts a message to a webhook; does nothing without an address."""
    if not url:
        return False
    body = json.dumps({"content": text}).encode()
    urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=30).close()
    return True
