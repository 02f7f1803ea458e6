"""Connectors as data sources of Spark: paged pull requests and sheets, from a web address or saved pages."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

#: Pull requests on a page; pages that one task reads; bytes of an error's text that are passed on; seconds to wait for an answer.
PER_PAGE, PAGES, SAID, WAIT = 30, 10, 512, 30


class ConnectorError(RuntimeError):
    pass


class Saved:
    """Pages that Spark or a download has left as `repo=<name>/page=<n>/`, files of JSON in each, on any file system that pyarrow opens."""

    def __init__(self, address: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(address if "://" in address else f"file://{address}" if not address.startswith("file:") else "file://" + address[5:])
        self.kinds = fs

    def _names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(self.kinds.FileSelector(folder, allow_not_found=True))
        return sorted(i.base_name for i in found)

    def repositories(self) -> list[str]:
        return [urllib.parse.unquote(n[5:]) for n in self._names(self.root) if n.startswith("repo=")]

    def _folder(self, repo: str) -> str:
        return f"{self.root}/repo={urllib.parse.quote(repo, safe=' ')}"

    def last_page(self, repo: str) -> int | None:
        return max((int(n[5:]) for n in self._names(self._folder(repo)) if n.startswith("page=")), default=0)

    def page(self, repo: str, number: int, state: str, size: int) -> list[dict]:
        folder = f"{self._folder(repo)}/page={number}"
        rows: list[dict] = []
        for name in self._names(folder):
            if not name.startswith(("_", ".")):
                with self.fs.open_input_stream(f"{folder}/{name}") as f:
                    rows += _decoded(f.read(), f"{repo}, page {number}")
        return [r for r in rows if state == "all" or r.get("state") == state]


class Web:
    """Pages of a web service: `<address>/repos/<name>/pulls?state=&per_page=&page=`."""

    def __init__(self, address: str, token: str | None = None):
        self.address, self.token = address.rstrip("/"), token

    def repositories(self) -> list[str]:
        raise ConnectorError("repos must be named")

    def last_page(self, repo: str) -> None:
        return None  # known when an empty page comes

    def page(self, repo: str, number: int, state: str, size: int) -> list[dict]:
        query = urllib.parse.urlencode({"state": state, "per_page": size, "page": number})
        return _decoded(fetched(f"{self.address}/repos/{urllib.parse.quote(repo)}/pulls?{query}", self.token), f"{repo}, page {number}")


def fetched(url: str, token: str | None) -> bytes:
    """The answer's bytes; any answer but 200 is an error with its status and the beginning of its text."""
    headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=WAIT) as answer:
            return answer.read()
    except urllib.error.HTTPError as e:
        raise ConnectorError(f"{e.code}: {e.read(SAID).decode(errors='replace')}") from None
    except urllib.error.URLError as e:
        raise ConnectorError(f"no answer: {e.reason}") from None


def _decoded(raw: bytes, what: str) -> list[dict]:
    try:
        found = json.loads(raw or b"[]")
    except ValueError as e:
        raise ConnectorError(f"{what}: {e}") from None
    if not isinstance(found, list):
        raise ConnectorError(f"{what}: not a list")
    return found


@dataclass
class PageRange(InputPartition):
    repo: str
    first: int
    last: int | None  # None: until a page is empty


#: How a column comes from a pull request as the service tells it.
_FIELDS = {
    "number": lambda r: r.get("number"), "title": lambda r: r.get("title"), "state": lambda r: r.get("state"), "merged_at": lambda r: r.get("merged_at"), "created_at": lambda r: r.get("created_at"),
    "html_url": lambda r: r.get("html_url"), "body": lambda r: r.get("body"), "user": lambda r: (r.get("user") or {}).get("login"), "labels": lambda r: [x.get("name") for x in r.get("labels") or []],
}
_TYPES = {"number": pa.int32(), "labels": pa.list_(pa.string())}
PULL_REQUESTS = "repo string, number int, title string, state string, merged_at string, created_at string, html_url string, body string, user string, labels array<string>"


class PullRequestReader(DataSourceReader):
    def __init__(self, columns: list[str], options: dict):
        unknown = set(columns) - {"repo", *_FIELDS}
        if unknown:
            raise ConnectorError(f"no such columns: {', '.join(sorted(unknown))}")
        if "url" in options and "path" in options or not {"url", "path"} & set(options):
            raise ConnectorError("either url or path must be given")
        self.columns, self.options = columns, options
        self.size, self.state = int(options.get("per_page", PER_PAGE)), options.get("state", "all")
        self.only: set[str] | None = None

    def _pages(self) -> Saved | Web:
        return Web(self.options["url"], self.options.get("token")) if "url" in self.options else Saved(self.options["path"])

    def pushFilters(self, filters: list[Filter]):
        """`repo = ...` leaves out other repositories, `state = ...` is asked of the service; Spark checks all else."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("repo",):
                self.only = {f.value} if self.only is None else self.only & {f.value}
            elif isinstance(f, EqualTo) and f.attribute == ("state",) and self.state == "all":
                self.state = f.value
            yield f

    def partitions(self) -> list[InputPartition]:
        """`pages` pages of a repository for each task where their number is known, so a large repository isn't one task's."""
        pages, each = self._pages(), int(self.options.get("pages", PAGES))
        named = [r.strip() for r in self.options.get("repos", "").split(",") if r.strip()] or pages.repositories()
        out: list[InputPartition] = []
        for repo in dict.fromkeys(named):
            if self.only is None or repo in self.only:
                last = pages.last_page(repo)
                out += [PageRange(repo, 1, None)] if last is None else [PageRange(repo, n, min(n + each - 1, last)) for n in range(1, last + 1, each)]
        return out

    def read(self, partition: PageRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way of reading no partition at all
            return
        pages, number = self._pages(), partition.first
        while partition.last is None or number <= partition.last:
            try:
                rows = pages.page(partition.repo, number, self.state, self.size)
            except ConnectorError as e:
                raise ConnectorError(f"pull_requests: {partition.repo}: {e}") from None
            if rows:
                columns = [pa.array([partition.repo] * len(rows), pa.string()) if c == "repo" else pa.array([_FIELDS[c](r) for r in rows], _TYPES.get(c, pa.string())) for c in self.columns]
                yield pa.RecordBatch.from_arrays(columns, self.columns)
            elif partition.last is None:
                return
            number += 1


class PullRequests(DataSource):
    """Options: `url` of a service (with `repos` and perhaps `token`) or `path` of saved pages; `state`, `per_page`, `pages`.

    Only the columns of a schema that is given are built.
    """

    @classmethod
    def name(cls) -> str:
        return "pull_requests"

    def schema(self) -> str:
        return PULL_REQUESTS

    def reader(self, schema: StructType) -> PullRequestReader:
        return PullRequestReader(schema.fieldNames(), dict(self.options))


class SheetReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if "url" in self.options:
            range_ = urllib.parse.quote(self.options.get("range", ""), safe="")
            key = f"?key={urllib.parse.quote(self.options['key'])}" if "key" in self.options else ""
            raw = fetched(f"{self.options['url'].rstrip('/')}/{urllib.parse.quote(self.options['sheet'], safe='')}/values/{range_}{key}", self.options.get("token"))
        else:
            saved = Saved(self.options["path"])
            with saved.fs.open_input_stream(saved.root) as f:
                raw = f.read()
        try:
            found = json.loads(raw)
        except ValueError as e:
            raise ConnectorError(f"sheet_values: {e}") from None
        if not isinstance(found, dict):
            raise ConnectorError("sheet_values: not a range of values")
        values = [[None if x is None else str(x) for x in r] for r in found.get("values") or []]
        if values:
            yield pa.RecordBatch.from_arrays([pa.array([found.get("range")], pa.string()), pa.array([values], pa.list_(pa.list_(pa.string())))], ["range", "values"])


class SheetValues(DataSource):
    """A range of a sheet as one row, none if it is empty. Options: `url`, `sheet`, `range` and perhaps `key` or `token`; or `path` of a saved answer."""

    @classmethod
    def name(cls) -> str:
        return "sheet_values"

    def schema(self) -> str:
        return "range string, values array<array<string>>"

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(dict(self.options))


SOURCES = (PullRequests, SheetValues)


def register_sources(spark: SparkSession) -> list[str]:
    """Make the connectors known to `spark.read.format` and SQL by their names; filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in SOURCES:
        spark.dataSource.register(source)
    return [s.name() for s in SOURCES]
