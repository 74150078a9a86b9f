"""Where profiles come from: a site over HTTP, or pages saved from it; and Spark's reader over either.

A backend is asked for pages and answers with HTML; parsing, matching and cleaning are plans over the pages.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import quote, urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .calls import Blocked, Disallowed, Transient, polite, replayed
from .payloads import BLOCK_SIGNS, permitted, robots


class Saved:
    """Pages in a folder: search-<name>.html, profile-<id>-<start>.html, detail-<id>.html."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def _page(self, name: str) -> str | None:
        path = self.folder / f"{quote(name, safe='')}.html"
        return path.read_bytes().decode("utf-8", "replace") if path.exists() else None

    def search(self, name: str) -> str | None:
        return self._page(f"search-{name}")

    def profile(self, person: str, start: int = 0) -> str | None:
        return self._page(f"profile-{person}-{start}")

    def detail(self, publication: str) -> str | None:
        return self._page(f"detail-{publication}")


class Http:
    """Pages of a site.  Its robots rules are read first; unreadable rules forbid all.  Every request but the first waits."""

    def __init__(self, site: str, agent: str, wait: tuple[float, float] = (10.0, 20.0), retries: int = 3, timeout: float = 30.0, sleep: Callable[[float], None] = time.sleep, page_size: int = 100):
        self.site, self.agent, self.wait, self.timeout, self.sleep, self.page_size = site.rstrip("/"), agent, wait, timeout, sleep, page_size
        self._get = replayed(self._once, retries, sleep=sleep)
        self._asked, self._rules = False, None

    def _once(self, path: str) -> str | None:
        if self._asked:
            polite(*self.wait, self.sleep)
        self._asked = True
        request = urllib.request.Request(self.site + path, headers={"User-Agent": self.agent})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as fault:
            if fault.code == 404:
                return None
            if fault.code in (403, 429):
                raise Blocked(f"HTTP {fault.code}") from fault
            raise Transient(f"HTTP {fault.code}") from fault
        except OSError as fault:
            raise Transient(str(fault)) from fault

    def allowed(self, path: str) -> bool:
        if self._rules is None:
            try:
                text = self._get("/robots.txt")
                self._rules = robots(text or "", self.agent)
            except (Blocked, Transient):
                self._rules = [("/", False)]
        return permitted(self._rules, path)

    def page(self, path: str) -> str | None:
        if not self.allowed(path):
            raise Disallowed(path)
        html = self._get(path)
        if html is not None and any(sign in html.lower() for sign in BLOCK_SIGNS):
            raise Blocked("a page that asks for proof of being human")
        return html

    def search(self, name: str) -> str | None:
        return self.page("/citations?" + urlencode({"view_op": "search_authors", "mauthors": name, "hl": "en"}))

    def profile(self, person: str, start: int = 0) -> str | None:
        return self.page("/citations?" + urlencode({"user": person, "hl": "en", "cstart": start, "pagesize": self.page_size}))

    def detail(self, publication: str) -> str | None:
        return self.page("/citations?" + urlencode({"view_op": "view_citation", "citation_for_view": publication, "hl": "en"}))


def profile_pages(backend, person: str, most: int, more: Callable[[str], tuple[int, bool]]) -> Iterator[str]:
    """A person's pages until their publications are all there or `most`; more(html) gives how many a page lists, and
    whether another follows."""
    start = 0
    while start < most:
        html = backend.profile(person, start)
        if html is None:
            return
        yield html
        listed, follows = more(html)
        if not follows or not listed:
            return
        start += listed


def make(kind: str, **options):
    """A backend by name."""
    kinds = {"saved": Saved, "http": Http}
    if kind not in kinds:
        raise ValueError(f"no backend {kind}; there are {', '.join(sorted(kinds))}")
    return kinds[kind](**options)


class _Keys(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


class PageSource(DataSource):
    """spark.read.format("pages").option("backend", "saved").option("folder", ...).option("keys", '["a", "b"]').load():
    what, key, status and html, a partition for each `parts`-th of the keys; errors are rows."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "what string, key string, status string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(dict(self.options))


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        keys, parts = json.loads(self.options["keys"]), int(self.options.get("parts", "1"))
        return [_Keys(keys[k::parts]) for k in range(min(parts, max(1, len(keys))))]

    def read(self, partition):
        own = {"backend", "keys", "parts", "what", "path"}
        backend = make(self.options.get("backend", "saved"), **{k: v for k, v in self.options.items() if k not in own})
        what = self.options.get("what", "profile")
        stopped = False
        for key in partition.keys:
            try:
                html = None if stopped else getattr(backend, what)(key)
                yield what, key, "skipped" if stopped else "ok" if html is not None else "not_found", html
            except Blocked:
                stopped = True
                yield what, key, "blocked", None
            except (Transient, Disallowed) as fault:
                yield what, key, f"error: {type(fault).__name__}", None


def settings(path: str, env: str | None = None) -> dict:
    """Settings of a JSON file, or YAML where its reader is installed, and what an env file adds; blank values are absent."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml  # an optional dependency

        found = yaml.safe_load(text) or {}
    else:
        found = json.loads(text)
    extra = {}
    if env and os.path.exists(env):
        for line in Path(env).read_text().splitlines():
            name, mark, value = line.partition("=")
            if mark and not line.lstrip().startswith("#") and value.strip().strip("\"'"):
                extra[name.strip()] = value.strip().strip("\"'")
    return found | {"env": extra}
