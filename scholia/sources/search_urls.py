"""What a search becomes in the query language of each provider: filters, order and page go to the source."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta
from urllib.parse import quote_plus, urlencode

from scholia.functions.dates import DateFilter
from scholia.functions.text import quoted_phrase

#: The fields that OpenAlex and Semantic Scholar are asked for.
OPENALEX_FIELDS = "id,doi,display_name,publication_date,abstract_inverted_index,authorships,open_access,best_oa_location,cited_by_count"
SEMANTIC_SCHOLAR_FIELDS = "title,abstract,externalIds,openAccessPdf,year,authors,citationCount"
#: The largest page of each provider that has one.
MOST = {"openalex": 200, "semantic_scholar": 100, "crossref": 100, "europe_pmc": 100, "core": 100}


@dataclass(frozen=True)
class Search:
    """A search: kind is keywords, title, author or subject; order is relevance, date or citations."""

    text: str
    kind: str = "keywords"
    dates: DateFilter = field(default_factory=DateFilter)
    order: str = "relevance"
    limit: int = 10
    offset: int = 0

    @property
    def last_day(self) -> date | None:
        """The date filter is half open, and the providers' bounds are not."""
        return self.dates.before - timedelta(days=1) if self.dates.before else None


def _bounds(s: Search, first: str, last: str) -> str:
    parts = [f"{name}:{day:%Y-%m-%d}" for name, day in ((first, s.dates.after), (last, s.last_day)) if day]
    return ",".join(parts)


def _arxiv(s: Search) -> tuple[str, list[tuple[str, object]]]:
    prefix = {"title": "ti:", "author": "au:"}.get(s.kind, "all:")
    phrase = quoted_phrase(s.text) != s.text
    query = f'{prefix}"{s.text}"' if phrase else " AND ".join(prefix + term for term in s.text.split())
    if s.dates.after or s.dates.before:
        first = f"{s.dates.after:%Y%m%d}000000" if s.dates.after else "000001010000"
        last = f"{s.last_day:%Y%m%d}235959" if s.last_day else "999912312359"
        query += f" AND submittedDate:[{first} TO {last}]"
    order = "submittedDate" if s.order == "date" else "relevance"
    return "", [("search_query", query), ("start", s.offset), ("max_results", s.limit), ("sortBy", order), ("sortOrder", "descending")]


def _openalex(s: Search) -> tuple[str, list[tuple[str, object]]]:
    fields = {"title": "title.search", "author": "authorships.author.display_name.search", "subject": "topics.display_name.search"}
    out: list[tuple[str, object]] = [("filter", f"{fields[s.kind]}:{s.text}") if s.kind in fields else ("search", s.text)]
    if days := _bounds(s, "from_publication_date", "to_publication_date"):
        out.append(("filter", days))
    # only a full-text search has a relevance to sort by
    order = {"date": "publication_date:desc", "citations": "cited_by_count:desc"}.get(s.order, "relevance_score:desc" if s.kind == "keywords" else None)
    if order:
        out.append(("sort", order))
    return "/works", [*out, ("per_page", min(s.limit, MOST["openalex"])), ("page", s.offset // max(s.limit, 1) + 1), ("select", OPENALEX_FIELDS)]


def _semantic_scholar(s: Search) -> tuple[str, list[tuple[str, object]]]:
    out: list[tuple[str, object]] = [("query", s.text), ("fields", SEMANTIC_SCHOLAR_FIELDS), ("limit", min(s.limit, MOST["semantic_scholar"])), ("offset", s.offset)]
    if s.order != "relevance":
        out.append(("sort", {"citations": "citationCount:desc", "date": "publicationDate:desc"}[s.order]))
    if s.dates.after or s.dates.before:
        out.append(("year", "-".join(f"{day:%Y}" if day else "" for day in (s.dates.after, s.dates.before))))
    return "/graph/v1/paper/search", out


def _crossref(s: Search) -> tuple[str, list[tuple[str, object]]]:
    out: list[tuple[str, object]] = [({"title": "query.bibliographic", "author": "query.author"}.get(s.kind, "query"), s.text), ("rows", min(s.limit, MOST["crossref"])), ("offset", s.offset)]
    if s.order != "relevance":
        out += [("sort", {"date": "published", "citations": "is-referenced-by-count"}[s.order]), ("order", "desc")]
    if days := _bounds(s, "from-pub-date", "until-pub-date"):
        out.append(("filter", days))
    return "/works", out


def _europe_pmc(s: Search) -> tuple[str, list[tuple[str, object]]]:
    query = {"title": f'TITLE:"{s.text}"', "author": f'AUTH:"{s.text}"'}.get(s.kind, quoted_phrase(s.text))
    if s.dates.after or s.dates.before:
        query += f" FIRST_PDATE:[{s.dates.after or date(1900, 1, 1):%Y-%m-%d} TO {s.last_day or date(2999, 12, 31):%Y-%m-%d}]"
    out: list[tuple[str, object]] = [("query", query), ("format", "json"), ("resultType", "core"), ("pageSize", min(s.limit, MOST["europe_pmc"])), ("cursorMark", "*")]
    if s.order != "relevance":
        out.append(("sort", {"date": "P_PDATE_D desc", "citations": "CITED desc"}[s.order]))
    return "/webservices/rest/search", out


def _core(s: Search) -> tuple[str, list[tuple[str, object]]]:
    query = {"title": f'title:"{s.text}"', "author": f'authors:"{s.text}"'}.get(s.kind, quoted_phrase(s.text))
    years = [f"yearPublished{op}{day:%Y}" for op, day in ((">=", s.dates.after), ("<=", s.dates.before)) if day]
    if years:
        query = " AND ".join([f"({query})", *years])
    out: list[tuple[str, object]] = [("q", query), ("limit", min(s.limit, MOST["core"])), ("offset", s.offset)]
    if s.order != "relevance":
        out.append(("sort", {"date": "publishedDate:desc", "citations": "citationCount:desc"}[s.order]))
    return "/v3/search/works", out


DIALECTS = {"arxiv": _arxiv, "openalex": _openalex, "semantic_scholar": _semantic_scholar, "crossref": _crossref, "europe_pmc": _europe_pmc, "core": _core}


def search_url(provider: str, base: str, search: Search, **more: str) -> str:
    """The address of a search; `more` are parameters such as a key or an e-mail address."""
    path, params = DIALECTS[provider](search)
    if provider == "europe_pmc":
        safe = urlencode([(k, v) for k, v in params if k not in ("query", "cursorMark")])
        return f"{base}{path}?query={quote_plus(dict(params)['query'], safe='*')}&{safe}&cursorMark=*"
    return f"{base}{path}?{urlencode([*params, *more.items()], safe='*')}"
