"""Connectors as data sources: paging, pruning, errors, and a service that answers."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from lexispark.sources import exports as X
from lexispark.sources.connect import PullRequestReader, register_sources


def pull(n, state="open", **more):
    return {"number": n, "title": f"t{n}", "state": state, "user": {"login": f"u{n}"}, "labels": [{"name": "a"}] * (n % 2), "html_url": f"https://x/{n}", "body": None} | more


def save(root, pages):
    for (repo, n), rows in pages.items():
        folder = root / f"repo={repo.replace('/', '%2F')}" / f"page={n}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text(rows if isinstance(rows, str) else json.dumps(rows))
        (folder / "_SUCCESS").write_text("")
    return str(root)


@pytest.fixture
def service():
    """Three pages of one repository, an empty one, an error, and a sheet."""
    asked = []

    class Answers(BaseHTTPRequestHandler):
        def do_GET(self):
            url, q = urlparse(self.path), parse_qs(urlparse(self.path).query)
            asked.append((self.path, self.headers.get("Authorization")))
            status, out = 200, []
            if url.path == "/repos/o/many/pulls":
                page, size = int(q["page"][0]), int(q["per_page"][0])
                out = [pull(n) for n in range(1, 8)][(page - 1) * size : page * size]
            elif url.path == "/repos/o/bad/pulls":
                status, out = 403, {"message": "rate limit " + "x" * 2000}
            elif url.path.startswith("/none/"):
                out = {"range": "A1"}
            elif url.path == "/s1/values/A1%3AB2":
                out = {"range": "A1:B2", "values": [["h", 1], ["x", None]]}
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_saved_pages(spark, tmp_path):
    assert register_sources(spark) == ["pull_requests", "sheet_values"]
    pages = {("o/a", 1): [pull(1), pull(2, "closed")], ("o/a", 3): [pull(5, merged_at="d")], ("o/a", 4): [], ("o/b_c", 1): [pull(9)], ("o/b_c", 25): [pull(300)]}
    read = spark.read.format("pull_requests").option("path", save(tmp_path / "p", pages))
    got = read.load()
    assert sorted((r["repo"], r["number"], r["state"], r["user"], tuple(r["labels"])) for r in got.collect()) == [
        ("o/a", 1, "open", "u1", ("a",)), ("o/a", 2, "closed", "u2", ()), ("o/a", 5, "open", "u5", ("a",)), ("o/b_c", 9, "open", "u9", ("a",)), ("o/b_c", 300, "open", "u300", ()),
    ]
    assert got.rdd.getNumPartitions() == 1 + 3  # ten pages a task
    assert read.option("pages", "1").load().rdd.getNumPartitions() == 4 + 25
    assert [r["number"] for r in read.load().filter("state = 'closed'").collect()] == [2]
    assert {r["repo"] for r in read.load().filter("repo = 'o/b_c'").collect()} == {"o/b_c"}
    assert {tuple(r) for r in read.schema("title string, number int").load().collect()} == {(f"t{n}", n) for n in (1, 2, 5, 9, 300)}
    assert read.option("repos", "o/a, none/such").load().count() == 3
    learned = {r["topic"]: r for r in X.CONNECTORS["github_prs"][1](spark, {"path": str(tmp_path / "p")}).collect()}
    assert "PR #5 [merged] o/a @u5 labels:a" in learned["github-o-a-pr-5"]["content"] and learned["github-o-b-c-pr-9"]["tags"] == ["github", "pull-request", "o-b-c", "a"]


def test_filters_leave_out_partitions(tmp_path):
    from pyspark.sql.datasource import EqualTo

    reader = PullRequestReader(["number"], {"path": save(tmp_path / "p", {("o/a", 1): [], ("o/b", 1): []})})
    f = EqualTo(("repo",), "o/b")
    assert list(reader.pushFilters([f, EqualTo(("state",), "open")])) == [f, EqualTo(("state",), "open")]
    assert [p.repo for p in reader.partitions()] == ["o/b"] and reader.state == "open"


def test_bad_pages_and_options(spark, tmp_path):
    register_sources(spark)
    read = lambda **o: spark.read.format("pull_requests").options(**o).load().collect()
    for k, text in enumerate(("{oops", '{"number": 1}')):
        with pytest.raises(Exception, match="o/a, page 2"):
            read(path=save(tmp_path / str(k), {("o/a", 1): [pull(1)], ("o/a", 2): text}))
    for options in ({}, {"url": "http://x", "path": "/y"}, {"url": "http://x"}):
        with pytest.raises(Exception, match="must be"):
            read(**options)
    with pytest.raises(Exception, match="no such columns: nothing"):
        spark.read.format("pull_requests").schema("nothing string").option("path", str(tmp_path)).load().collect()
    assert read(path=str(tmp_path / "empty")) == []


def test_a_service(spark, service):
    url, asked = service
    register_sources(spark)
    read = spark.read.format("pull_requests").option("url", url).option("per_page", 3)
    assert sorted(r["number"] for r in read.option("repos", "o/many,o/none").option("token", "secret").load().collect()) == list(range(1, 8))
    assert any("page=4" in a for a, _ in asked) and all(t == "Bearer secret" for _, t in asked)
    with pytest.raises(Exception, match="o/bad: 403: .*rate limit") as e:
        read.option("repos", "o/bad").load().collect()
    assert "x" * 600 not in str(e.value).split("403")[1][:700]
    sheet = spark.read.format("sheet_values").options(url=url, sheet="s1", range="A1:B2")
    assert tuple(sheet.load().first()) == ("A1:B2", [["h", "1"], ["x", None]])
    learned = X.CONNECTORS["google_sheets"][1](spark, {"url": url, "sheet": "s1", "range": "A1:B2"}).first()
    assert learned["topic"] == "sheet-s1" and "h" in learned["content"]
    assert spark.read.format("sheet_values").options(url=url, sheet="none", range="A1").load().filter(F.lit(True)).count() == 0
