"""The search behind discovery as a data source: runs in parallel, their result pages in turn, three rules to stop."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siteprism.operators.discovery import fetch_target

#: Results of a page at most, and pages of a run (fixed values).
PAGE, PAGES = 20, 10
SCHEMA = "run string, query string, page int, asked int, pos int, url string, title string, description string"

#: A page's body for (run, query, count, page); None where there is none.
Fetch = Callable[[str, str, int, int], str | None]


@dataclass
class Run(InputPartition):
    """One run, which one task reads page by page: each page decides whether there is a next."""

    run: str
    query: str


def results_of(body: str | None) -> tuple[list[tuple[str, str, str]], bool]:
    """A page's results (url, title, description, trimmed; those without a URL left out) and whether there are more."""
    try:
        value = json.loads(body or "")
        web, more = value.get("web"), value.get("query")
        rows = web.get("results") if isinstance(web, dict) else None
    except (ValueError, AttributeError):
        return [], False
    text = lambda r, k: r[k].strip() if isinstance(r.get(k), str) else ""
    found = [(text(r, "url"), text(r, "title"), text(r, "description")) for r in rows or [] if isinstance(r, dict)]
    return [r for r in found if r[0]], isinstance(more, dict) and more.get("more_results_available") is True


def pages_of(fetch: Fetch, run: str, query: str, limit: int, pages: int) -> Iterator[tuple[int, int, list[tuple[str, str, str]]]]:
    """Page, results asked for, and results of each page that a run reads.

    It stops when it has asked for as many results as it wants (``fetch_target``) or read all its pages, after a
    page that says there are no more, and before an empty page.
    """
    pages = max(1, min(pages, PAGES))
    left = fetch_target(limit, pages)
    for page in range(pages):
        if left <= 0:
            return
        asked = min(left, PAGE)
        found, more = results_of(fetch(run, query, asked, page))
        if not found:
            return
        yield page, asked, found
        left -= asked
        if not more:
            return


class Landed:
    """Bodies landed under ``path`` as run=<run>/page=<page>/ folders of text files, in any file system that Arrow knows."""

    def __init__(self, path: str):
        self.path = path

    def _at(self, folder: str):
        from pyarrow import fs

        path = self.path.removeprefix("file:") if not self.path.startswith("file://") else self.path
        system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        return system, f"{root}/{folder}".rstrip("/"), fs

    def runs(self) -> list[str]:
        system, root, fs = self._at("")
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(f.base_name[4:] for f in found if f.base_name.startswith("run=") and f.type == fs.FileType.Directory)

    def __call__(self, run: str, query: str, count: int, page: int) -> str | None:
        system, root, fs = self._at(f"run={run}/page={page}")
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("part-") and f.size)
        return "".join(system.open_input_stream(p).read().decode() for p in files) or None


class Search(DataSource):
    """Options: ``path`` of landed bodies or ``fetch``, a function as module:name; ``query``, ``limit``, ``pages``, and ``runs`` (comma-separated; all that are landed, if not given)."""

    @classmethod
    def name(cls) -> str:
        return "site_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if ("path" in options) == ("fetch" in options):
            raise ValueError("site_search takes either path or fetch")
        if "fetch" in options and not options.get("runs"):
            raise ValueError("site_search with fetch takes runs")
        self.options = options
        self.limit, self.pages = int(options.get("limit", "10")), int(options.get("pages", "3"))

    def _fetch(self) -> Fetch:
        if "path" in self.options:
            return Landed(self.options["path"])
        module, _, name = self.options["fetch"].partition(":")
        return getattr(import_module(module), name)

    def partitions(self) -> list[Run]:
        named = self.options.get("runs")
        runs = [r.strip() for r in named.split(",")] if named else self._fetch().runs()
        return [Run(r, self.options.get("query", "")) for r in runs if r]

    def read(self, partition: Run | None) -> Iterator[tuple]:
        if partition is None:  # no run at all
            return
        for page, asked, found in pages_of(self._fetch(), partition.run, partition.query, self.limit, self.pages):
            for pos, (url, title, description) in enumerate(found):
                yield partition.run, partition.query, page, asked, pos, url, title, description


def register(spark: SparkSession) -> None:
    """Make the source known as ``site_search``."""
    spark.dataSource.register(Search)
