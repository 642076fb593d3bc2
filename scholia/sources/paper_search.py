"""A provider's search as a Spark data source: filters on the date become parameters of the address, each page is a partition.

    spark.dataSource.register(PaperSearch)
    rows = spark.read.format("paper_search").options(provider="openalex", query="dark matter", limit=500, recorded=folder).load()
    papers = providers.openalex(rows.where("publication_date >= '2020-01-01'"))

The answers come from recorded pages: what `record` has written for each address, in a
folder that all machines reach.  An address without a page ends the results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from scholia.functions.dates import DateFilter
from scholia.sources.providers import ALIASES, provider
from scholia.sources.search_urls import MOST, Search, search_url

#: Providers whose dates are days in the address; the others know years, so their filters are looked at again.
BY_DAY = {"arxiv", "openalex", "crossref", "europe_pmc"}
#: Providers that go on by a cursor of the answer before, so that only their first page has an address.
ONE_PAGE = {"europe_pmc"}
#: Where a response has its items.
ITEMS = {"openalex": ["results"], "semantic_scholar": ["data"], "crossref": ["message", "items"], "europe_pmc": ["resultList", "result"], "core": ["results"]}


def _day(text: object) -> date | None:
    try:
        return date.fromisoformat(str(text)[:10])
    except ValueError:
        return None


def _year(y: object) -> date | None:
    return date(y, 1, 1) if isinstance(y, int) and 1 <= y <= 9999 else None


def _parts(item: dict) -> date | None:
    found = ((item.get("published") or {}).get("date-parts") or [[]])[0]
    try:
        return date(*(found + [1, 1])[:3]) if found else None
    except (TypeError, ValueError):
        return None


#: The day of an item, as the provider's mapper reads it.
DAYS = {
    "openalex": lambda x: _day(x.get("publication_date")),
    "semantic_scholar": lambda x: _year(x.get("year")),
    "crossref": _parts,
    "europe_pmc": lambda x: _day(x.get("firstPublicationDate")),
    "core": lambda x: _year(x.get("yearPublished")),
}


def items_of(name: str, response: str) -> Iterator[tuple[str, date | None]]:
    """The items of a response as payloads of their own, with their days; an unreadable response has none."""
    if name == "arxiv":
        for entry in re.findall(r"<entry\b.*?</entry>", response, re.S):
            day = re.search(r"<published>\s*([^<]*)", entry)
            yield f"<feed>{entry}</feed>", _day(day[1]) if day else None
        return
    try:
        found = json.loads(response)
        for key in ITEMS[name]:
            found = found[key]
    except (ValueError, KeyError, TypeError):
        return
    for item in found:
        yield json.dumps(item, ensure_ascii=False), DAYS[name](item)


def page_name(url: str) -> str:
    """The name under which the answer of an address is recorded."""
    return sha1(url.encode()).hexdigest()


def record(responses: DataFrame, folder: str) -> None:
    """Write responses (url, payload) where PaperSearch looks for them, one line each."""
    line = F.regexp_replace("payload", r"[\r\n]+", " ")
    responses.select(F.sha1(F.col("url")).alias("name"), line.alias("value")).write.mode("append").partitionBy("name").text(folder)


@dataclass
class Page(InputPartition):
    """One page of the results: its address and the rank of its first item."""

    url: str
    first: int


class PaperSearch(DataSource):
    """Options: provider, query, limit, recorded; and kind, order, page_size, base."""

    @classmethod
    def name(cls) -> str:
        return "paper_search"

    def schema(self) -> str:
        return "rank long, payload string, publication_date date"

    def reader(self, schema) -> SearchReader:
        return SearchReader(dict(self.options))


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.provider = ALIASES[options["provider"].strip().lower()]
        self.query, self.recorded, self.base = options["query"], options["recorded"], options.get("base", "")
        self.kind, self.order = options.get("kind", "keywords"), options.get("order", "relevance")
        self.limit = int(options.get("limit", 10))
        self.page_size = min(int(options.get("page_size", 100)), MOST.get(self.provider, 2000))
        self.after: date | None = None
        self.before: date | None = None

    def _narrow(self, f: Filter) -> bool:
        """Take a bound on the day into the range; whether it was one."""
        if getattr(f, "attribute", None) != ("publication_date",) or not isinstance(getattr(f, "value", None), date):
            return False
        after = {GreaterThan: 1, GreaterThanOrEqual: 0, EqualTo: 0}.get(type(f))
        before = {LessThan: 0, LessThanOrEqual: 1, EqualTo: 1}.get(type(f))
        if after is not None:
            day = f.value + timedelta(days=after)
            self.after = max(self.after or day, day)
        if before is not None:
            day = f.value + timedelta(days=before)
            self.before = min(self.before or day, day)
        return after is not None or before is not None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802, Spark's name
        bounds = [f for f in filters if self._narrow(f)]
        for f in filters:
            known = isinstance(f, IsNotNull) and f.attribute == ("publication_date",) and bounds
            # a provider that knows days answers with them alone; years are a wider net
            if not ((f in bounds or known) and self.provider in BY_DAY):
                yield f

    def searches(self) -> Iterator[tuple[str, int]]:
        dates = DateFilter(self.after, self.before)
        for first in range(0, min(self.limit, self.page_size) if self.provider in ONE_PAGE else self.limit, self.page_size):
            yield search_url(self.provider, self.base, Search(self.query, self.kind, dates, self.order, self.page_size, first)), first

    def partitions(self) -> list[Page]:
        if self.after and self.before and self.after >= self.before:
            return []
        return [Page(url, first) for url, first in self.searches()]

    def read(self, partition: Page) -> Iterator[tuple[int, str, date | None]]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.recorded)
        found = store.get_file_info(fs.FileSelector(f"{folder}/name={page_name(partition.url)}", allow_not_found=True))
        for file in sorted(f.path for f in found if f.base_name.startswith("part-")):
            with store.open_input_stream(file) as lines:
                for response in lines.read().decode().splitlines():
                    for k, (payload, day) in enumerate(items_of(self.provider, response)):
                        if partition.first + k < self.limit:
                            yield partition.first + k, payload, day


def search(spark: SparkSession, name: str, query: str, recorded: str, limit: int = 10, dates: str | None = None, **options: str) -> DataFrame:
    """Papers of a provider's search; `dates` such as '>=2019 <2024-06' goes to the provider as far as it can say it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PaperSearch)
    rows = spark.read.format("paper_search").options(provider=name, query=query, recorded=recorded, limit=limit, **options).load()
    if dates:
        rows = rows.where(DateFilter.parse(dates).condition("publication_date"))
    return provider(name)(rows)
