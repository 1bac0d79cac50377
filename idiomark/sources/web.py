"""Python data sources for paged web collections: dictionary searches and wiki categories.

Each query or title is one partition, so pages are fetched where the executors are,
with a pause between requests. A failure is a row with an error, not a failed job.
"""

from __future__ import annotations

import json
import time
import unicodedata
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Pages of a query at most, pause and time-out in seconds, retries and their pause after "too many requests".
MOST_PAGES, PAUSE, TIMEOUT, RETRIES, BACK_OFF = 15, 0.5, 15, 4, 6
AGENT = "idiomark/1.0 courtesy client"


def get(url: str, timeout: float = TIMEOUT, open_url: Callable | None = None, sleep: Callable = time.sleep) -> str:
    """Body of a URL; waits and tries again after status 429."""
    for k in range(RETRIES):
        try:
            with (open_url or urllib.request.urlopen)(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=timeout) as r:
                return r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code != 429 or k == RETRIES - 1:
                raise
            sleep(BACK_OFF * (k + 1))
    raise AssertionError


def quoted(word: str) -> str:
    return urllib.parse.quote(unicodedata.normalize("NFC", word))


class _Part(InputPartition):
    def __init__(self, value: str):
        super().__init__(value)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable[[str, dict], Iterator[tuple]]):
        self.options, self.fetch = dict(options), fetch

    def partitions(self):
        return [_Part(v) for v in json.loads(self.options["values"])]

    def read(self, partition):
        yield from self.fetch(partition.value, self.options)


def search_pages(word: str, options: dict, fetch: Callable[[str], str] = get, sleep: Callable = time.sleep) -> Iterator[tuple]:
    """(query, page_no, html, error) of a word's result pages."""
    import re

    total, page = 1, 1
    while page <= min(total, int(options.get("pages", MOST_PAGES))):
        url = options["url"].format(quoted(word)) + (f"&page={page}" if page > 1 else "")
        try:
            if page > 1:
                sleep(PAUSE)
            body = fetch(url)
        except Exception as e:  # noqa: BLE001
            yield word, page, None, f"{type(e).__name__}: {e}"
            return
        if page == 1:
            total = max([1, *map(int, re.findall(r"page=(\d+)", body))])
        yield word, page, body.partition("<footer")[0], None
        page += 1


def category_members(category: str, options: dict, fetch: Callable[[str], str] = get, sleep: Callable = time.sleep) -> Iterator[tuple]:
    """(category, title) of the articles of a wiki category, over all continuations."""
    more: dict = {}
    while True:
        q = {"action": "query", "list": "categorymembers", "cmtitle": category, "cmlimit": 500, "format": "json"} | more
        got = json.loads(fetch(options["url"] + "?" + urllib.parse.urlencode(q)))
        yield from ((category, m["title"]) for m in got["query"]["categorymembers"] if m["ns"] == 0)
        if "continue" not in got:
            return
        more = got["continue"]
        sleep(PAUSE)


def extract(title: str, options: dict, fetch: Callable[[str], str] = get, sleep: Callable = time.sleep) -> Iterator[tuple]:
    """(title, text, error) of one article."""
    q = {"action": "query", "prop": "extracts", "explaintext": 1, "titles": title, "format": "json"}
    try:
        pages = json.loads(fetch(options["url"] + "?" + urllib.parse.urlencode(q)))["query"]["pages"]
        yield title, next(iter(pages.values())).get("extract") or "", None
    except Exception as e:  # noqa: BLE001
        yield title, None, type(e).__name__


class DictionaryPages(DataSource):
    """Options: url with {} for the word, values (a JSON list of words), pages."""

    @classmethod
    def name(cls):
        return "dictionary_pages"

    def schema(self):
        return "query string, page_no int, html string, error string"

    def reader(self, schema):
        return _Reader(self.options, search_pages)


class CategoryMembers(DataSource):
    """Options: url of the API, values (a JSON list of categories)."""

    @classmethod
    def name(cls):
        return "category_members"

    def schema(self):
        return "category string, title string"

    def reader(self, schema):
        return _Reader(self.options, category_members)


class Extracts(DataSource):
    """Options: url of the API, values (a JSON list of titles)."""

    @classmethod
    def name(cls):
        return "extracts"

    def schema(self):
        return "title string, text string, error string"

    def reader(self, schema):
        return _Reader(self.options, extract)


def register(spark) -> None:
    for source in (DictionaryPages, CategoryMembers, Extracts):
        spark.dataSource.register(source)
